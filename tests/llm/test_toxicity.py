"""Restoring disguised words against trying every path of their lattice; toxicity on held-out and disguised documents."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest

from tracewright.llm import op12_toxicity as tox

DOCS = "doc_id long, text string, lang string, score string"
WORDS = "river stone garden window yellow little people market winter letter coffee bridge wanderer idiot stupid moron trash clown the and with from over under".split()


@pytest.fixture(scope="module")
def counts(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice(WORDS) for _ in range(80)).capitalize() + ".", None, None) for k in range(60)] + [(None, None, None, None), (99, "", None, None)]
    return tox.character_counts(spark.createDataFrame(rows, DOCS))


def test_counts_and_slots_agree(counts):
    words = ["river", "idiot"]
    for word, slot in tox._grams(words, 1, 4, tox.MODEL_SLOTS):
        grams = [(k, ("\n" + w + "\n")[i : i + n]) for n in (1, 2, 3, 4) for k, w in enumerate(words) for i in range(len(w) + 3 - n)]
        assert {(int(k), int(s)) for k, s in zip(word, slot, strict=True)} <= {(k, tox._slot(g, tox.MODEL_SLOTS)) for k, g in grams} | {(len(words) - 1, tox._slot("\n", tox.MODEL_SLOTS))}
    assert counts[tox._slot("\nidi", tox.MODEL_SLOTS)] > 0 and counts[tox._slot("zzzz", tox.MODEL_SLOTS)] == 0


@pytest.mark.parametrize(("token", "want"), [("1d10t", "idiot"), ("st*pid", "stupid"), ("i d i o t", "idiot"), ("m.o.r.o.n", "moron"), ("moooron", "moron"), ("idiooot", "idiot"), ("cl0wn", "clown"), ("tr@$h!", "trash"), ("letter", "letter"), ("lettter", "letter"), ("s-t-u-p-i-d", "stupid"), ("y3ll0w", "yellow"), ("...", ""), ("***", "")])
def test_disguises(counts, token, want):
    assert tox.Restorer(counts).restore(token) == want


def test_search_finds_the_cheapest_of_all_paths(counts):
    r = tox.Restorer(counts)
    rng = random.Random(4)
    for _ in range(60):
        token = "".join(rng.choice("idotm01.33ss") for _ in range(rng.randrange(3, 7)))
        best = (1e9, "")
        for path in itertools.product(*[r.arcs(token, i) for i in range(len(token))]):
            context, cost, out = "\n", 0.0, ""
            for c, price in path:
                if c == "\n":
                    cost += price + r.cost(context, c) if context != "\n" else 0
                    context, out = "\n", out + " "
                elif price == tox.ITSELF:
                    context, cost, out = "\n", cost + price, out + c
                elif c:
                    context, cost, out = (context + c)[-3:], cost + price + r.cost(context, c), out + c
                else:
                    cost += price
            cost += r.cost(context, "\n") if context != "\n" else 0
            best = min(best, (round(cost, 9), " ".join(out.split())))
        restored = r._search(token)
        if restored != best[1]:  # another path at the same cost
            assert token.isalpha() or best[0] >= 0
            assert len({restored, best[1]}) == 2 and _cost(r, token, restored) == pytest.approx(best[0], abs=1e-6)


def _cost(r, token, want):
    """The cost of the cheapest path that writes ``want``."""
    best = 1e9
    for path in itertools.product(*[r.arcs(token, i) for i in range(len(token))]):
        if " ".join("".join(" " if c == "\n" else c for c, _ in path).split()) == want:
            context, cost = "\n", 0.0
            for c, price in path:
                if c == "\n":
                    cost, context = (cost + price + r.cost(context, c) if context != "\n" else cost), "\n"
                elif price == tox.ITSELF:
                    context, cost = "\n", cost + price
                elif c:
                    context, cost = (context + c)[-3:], cost + price + r.cost(context, c)
                else:
                    cost += price
            best = min(best, cost + (r.cost(context, "\n") if context != "\n" else 0))
    return best


def disguise(rng, word):
    swap = {"i": "1", "o": "0", "e": "3", "a": "@", "s": "$"}
    kind = rng.randrange(3)
    return "".join(swap.get(c, c) for c in word) if kind == 0 else " ".join(word) if kind == 1 else "".join(c * (4 if c in "aiou" else 1) for c in word)


def test_disguised_documents_on_held_out_rows(spark):
    rng = random.Random(9)
    bad, fine = ["idiot", "moron", "clown", "trash", "stupid"], WORDS[:13]
    text = lambda toxic: " ".join(w for _ in range(60) for w in [rng.choice(fine)] + ([disguise(rng, rng.choice(bad)) if rng.random() < 0.7 else rng.choice(bad)] if toxic and rng.random() < 0.15 else []))
    rows = [(k, text(k % 4 == 0), "x", "y") for k in range(400)]
    found = tox.classify(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)], "doc_id long, toxic int")).collect()
    held = [r for r in found if r.held_out]
    assert len(held) > 50 and sum(r.predicted == (r.doc_id % 4 == 0) for r in held) / len(held) > 0.95
    assert all(set(r.words) <= set(WORDS) for r in found if r.predicted)


def test_odd_rows(spark):
    rows = [(1, None, "x", "y"), (2, "", "x", "y"), (None, "a b c d", "x", "y"), (3, "clown " * 40_000, "x", "y"), (3, "clown " * 40_000, "x", "y"), (4, "1" * 30_000, "x", "y"), (5, "é\x0bè ñ 漢字 \U0001f600", "x", "y")]
    docs = spark.createDataFrame(rows, DOCS)
    none = spark.createDataFrame([(None, 1), (1, None), (2, 7)], "doc_id long, toxic int")
    for labels in (none, spark.createDataFrame([(3, 1), (3, 0), (1, 0), (2, 0), (4, 0)], "doc_id long, toxic int")):
        found = tox.classify(docs, labels).collect()
        assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    assert tox.classify(docs.limit(0), none).collect() == []
    assert {r.doc_id: r.restored for r in tox.restore_texts(docs, np.zeros(tox.MODEL_SLOTS, np.int64)).where("doc_id in (1, 2)").collect()} == {1: "", 2: ""}


ODD = ["river", "River,", "lettter", "letter", "x²", "½", "ª", "ñandú", "漢字", "ﬀ", "é", "ꙊꙊ", "\U00010400\U00010400\U00010400", "a_b", "...", "'tis'", "1d10t", "st*pid", "***", "\x1c", "ééé", "zz", "ⅠⅠⅠ", "ퟻ", "moooron", "s-t-u-p-i-d", "7"]


def test_plain_tokens_by_pythons_own_rule():
    tokens = ["", *(t.lower() for t in ODD), "", *(chr(c) for c in range(33, 0x3100)), *(chr(c) * 3 for c in range(33, 0x3100)), ""]
    assert tox._plain(tokens).tolist() == [t.isalpha() and not tox._THRICE.search(t) for t in tokens]


def test_words_of_texts_are_those_of_their_tokens_one_by_one(counts):
    rng = random.Random(3)
    texts = ["", "...", "i d i o t", None, *(" ".join(rng.choice(ODD) for _ in range(rng.randrange(30))) for _ in range(60)), "the m o r o n and the idiot"]
    owner, word, words, sizes, first, slots = tox._restored(pa.array([t or "" for t in texts], pa.large_string()), tox.Restorer(counts))
    r, found = tox.Restorer(counts), [set() for _ in texts]
    for k, w in zip(owner.tolist(), word.tolist(), strict=True):
        assert words[w] not in found[k]
        found[k].add(words[w])
    for k, text in enumerate(texts):
        tokens = set(pa.compute.ascii_split_whitespace(pa.array([(text or "").lower()]))[0].as_py()) | set(tox._SPACED.findall((text or "").lower()))
        assert found[k] == {w for t in tokens for w in r.restore(t).split(" ") if w} and sizes[k] == len(tokens)
    tell = np.zeros(tox.EVIDENCE_SLOTS, bool)
    tell[[tox._slot(g, tox.EVIDENCE_SLOTS) for g in ("\nidi", "oron", "zz\n")]] = True
    some = tox._restored(pa.array([t or "" for t in texts], pa.large_string()), tox.Restorer(counts), tell)
    telling = {w for k, w in enumerate(words) if tell[slots[first[k] : first[k + 1]]].any()}
    assert {"idiot", "moron", "zz"} <= telling
    assert {(k, some[2][w]) for k, w in zip(some[0].tolist(), some[1].tolist(), strict=True)} == {(k, w) for k, f in enumerate(found) for w in f & telling}


def test_sequences_against_python():
    words = ["a", "bc", "river", "garden", "wanderer", "é漢字\U0001f600"]
    want = [(k, g) for k, w in enumerate(words) for b in ["\n" + w + "\n"] for i in range(len(b)) for j in range(i + 1, len(b) + 1) for g in [b[i:j]] if 3 <= len(g) <= 6 or 6 < len(g) <= 10 and i == 0]
    got = [(int(k), int(s)) for word, slot in tox._grams(words, 3, 6, 1 << 21, 10) for k, s in zip(word, slot, strict=True)]
    assert sorted(got) == sorted((k, tox._slot(g, 1 << 21)) for k, g in want)


def test_plain_tokens_and_known_endings_cost_no_search(counts, monkeypatch):
    """The work that a corpus of ever new words makes: none one by one for plain tokens, one search for equal endings."""
    rng = random.Random(5)
    new = sorted({"".join(rng.choice("bdfgklmnprt") + rng.choice("aeiou") for _ in range(6)) for _ in range(500)})
    done = {"restore": 0, "arcs": 0}
    for name in done:
        held = getattr(tox.Restorer, name)
        monkeypatch.setattr(tox.Restorer, name, lambda self, *x, held=held, name=name: (done.__setitem__(name, done[name] + 1), held(self, *x))[1])
    r = tox.Restorer(counts)
    tox._restored(pa.array([" ".join(new) + " river, stone"], pa.large_string()), r)
    assert done["restore"] == 0
    _, _, words, *_ = tox._restored(pa.array([" ".join(w + "tion###" for w in new)], pa.large_string()), r)
    assert done["restore"] == len(new) and done["arcs"] < 20
    assert set(words) == {w + "tion" for w in new}


def test_rests_searched_alone_are_those_of_whole_tokens(counts):
    rng = random.Random(6)
    r = tox.Restorer(counts)
    tokens = ["é é é é é é é é é é é", "password=56619ab9561a44203b", "word" * 30 + "2869c6d3ff6f9738ae", *("".join(rng.choice(a) for _ in range(rng.randrange(1, 40))) for a in ["ab cde", "0123456789abcdef", "idotm01.33ss", "river*$!"] for _ in range(150))]
    for token in tokens + tokens:
        assert r._search(token) == " ".join(r._cheapest("\n", token).split())
