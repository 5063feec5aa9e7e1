"""The filter interaction audit against a plain version that applies every order to every document."""

import random
from itertools import permutations

from tracewright.llm import op11_audit as audit

DOCS = "doc_id long, text string, lang string, source string, good long"


def plain(docs, labels):
    texts = [(i, source or "", text or "") for i, text, _, source, _ in docs]
    first = {}
    for i, _, t in texts:
        if i is not None:
            first[t] = min(i, first.get(t, i))

    def fails(f, i, t):
        words = t.replace("\t", " ").replace("\n", " ").split(" ")
        words = [w for w in words if w]
        return {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > first[t]}[f]

    flag = lambda i, k: i is not None and any(x[0] == i and x[k] == 1 for x in labels)
    rows = [(p, "".join(f for f in "ABCDE" if fails(f, i, t)), flag(i, 1), flag(i, 2)) for i, p, t in texts]
    out = {}
    for part in {p for _, p, _ in texts}:
        mine = [r[1:] for r in rows if r[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for k, f in enumerate(order):
                removed = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                total[f] += len(removed)
                out[part, order, k + 1] = [len(left), len(removed), sum(f in r[0] for r in mine) - len(removed), sum(f == r[0] for r in mine), sum(r[1] for r in removed), sum(r[2] for r in removed)]
        for (p, order, k), row in out.items():
            if p == part:
                row.append(total[order[k - 1]])
    return out


def check(spark, docs, labels):
    got = audit.audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = plain(docs, labels)
    assert len(got) == len(want)
    assert {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got} == want


def test_every_order_against_a_plain_version(spark):
    rng = random.Random(5)
    long = lambda n: " ".join(f"w{k}" for k in range(n))
    texts = ["", None, long(200), long(199), long(250) + " A B C D E F G H I J K L M N O P Q R S T U V W X Y Z" * 2, "x " * 400, long(210) + " $", "A", "\x0b\t \n", "a" * 40_000, long(6_000)]
    docs = [(rng.randrange(60) if k % 9 else None, rng.choice(texts), None, rng.choice([None, "", "s", "t"]), 7) for k in range(80)]
    check(spark, docs + docs[:5], [(rng.randrange(60), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(50)] + [(None, 1, 1)])


def test_a_text_that_a_smaller_id_has_fails_even_where_that_row_is_removed(spark):
    check(spark, [(5, "same", None, "s", 0), (3, "same", None, "t", 0), (3, "same", None, "s", 0), (None, "same", None, "s", 0), (4, "same ", None, "s", 0)], [(5, 1, 1), (5, 0, 0)])


def test_no_documents(spark):
    assert audit.audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []
