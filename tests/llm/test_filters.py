"""URL filter, language ID, quality and decontamination."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import op01_url_filter as urls
from tracewright.llm import op02_language_id as language
from tracewright.llm import op05_quality as quality
from tracewright.llm import op08_decontamination as leak

DOCS = "doc_id long, text string, lang string, source string"


def test_hosts_paths_and_rules(spark):
    cases = [
        ("http://WWW.Example.ORG/es/9?q", "www.example.org", "/es/9", "example.org/es/", "block"),
        ("https://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
        ("https://notexample.org/en/12", "notexample.org", "/en/12", "org/", "allow"),
        ("x://a.com/fr/", "a.com", "/fr/", "com/fr/", "allow"),
        ("x://a.com/de/1#y", "a.com", "/de/1", "com/de/", "block"),
        ("x://a.org", "a.org", "", None, None),
        ("a.org/x", "", "", None, None),
        (None, "", "", None, None),
        ("http://ÄB.net?x://y", "Äb.net", "", None, None),
    ]
    df = spark.createDataFrame([(k, u, None) for k, (u, *_) in enumerate(cases)], "page_id long, url string, html string")
    got = {r.page_id: r for r in urls.judge(df).collect()}
    assert len(got) == len(cases)
    for k, (_, host, path, rule, verdict) in enumerate(cases):
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule)
        assert got[k].verdict == verdict if verdict else got[k].verdict in ("allow", "block")


def test_templates_generalise_and_purity_decides(spark):
    rows = [f"http://shop.com/fr/{k}" for k in range(30)] + [f"http://shop.com/de/{k}" for k in range(30)]
    rows += [f"http://other.net/de/{k}" for k in range(5)] + [f"http://other.net/fr/{k}" for k in range(5)] + [f"http://names.net/item/{chr(97 + k)}" for k in range(20)]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {r.page_id: r for r in urls.judge(df).collect()}
    shown = {(r.host, r.template, r.verdict) for r in got.values()}
    assert ("shop.com", "/de/*", "block") in shown and ("shop.com", "/fr/*", "allow") in shown
    assert {v for h, t, v in shown if h == "other.net"} <= {"allow", "block"}
    assert {got[60].verdict, got[65].verdict} == {"allow", "block"}  # taken over from the same templates elsewhere
    assert {t for h, t, _ in shown if h == "names.net"} == {"/*/*"}  # many children, and no labels to tell it apart


def plain_templates(paths):
    """The template of each path of one host, by a recursive walk of its tree."""
    out, parts = {}, {p: p.removeprefix("/").split("/") for p in paths}

    def walk(members, level, template):
        for p in (p for p in members if len(parts[p]) <= level):
            out[p] = template
        members = [p for p in members if len(parts[p]) > level]
        kids = {parts[p][level] for p in members}
        wide = len(kids) >= urls.CHILDREN and len(kids) >= urls.SPREAD * len(members)
        below = {}
        for p in members:
            x = parts[p][level]
            below.setdefault("*" if wide or any(c.isdigit() for c in x) or len(x) >= urls.LONG else x, []).append(p)
        for name, some in below.items():
            walk(some, level + 1, f"{template}/{name}")

    walk(paths, 0, "")
    return out


def test_deep_templates_against_a_plain_walk(spark):
    rng = random.Random(6)
    deep = "/".join("abcdefghijkl")
    paths = [f"/{deep}/{x}{y}/t{k % 3}/end" for k, (x, y) in enumerate((x, y) for x in "mnopq" for y in "rstuv")]
    paths += [f"/{deep}/only/" + "/".join(rng.choice("uvw") for _ in range(k % 6)) for k in range(40)]
    paths += ["/" + "/".join(rng.choice(("a", "b", "7")) for _ in range(rng.randrange(14))) for _ in range(150)] + ["/x" * 200, "", "/"]
    paths = sorted(set(paths))
    got = urls.templates(spark.createDataFrame([("h", p) for p in paths], "host string, path string")).collect()
    assert {r.path: r.template for r in got} == plain_templates(paths)
    assert any(t.count("/*") and t.count("/") > 12 for t in plain_templates(paths).values())


def test_url_filter_on_odd_tables(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge(empty).count() == 0
    same = spark.createDataFrame([(1, "http://a.net/x")] * 3 + [(None, "http://a.net/x"), (2, "http://a.net/" + "p/" * 300)], "page_id long, url string").selectExpr("*", "1 AS host", "2 AS template")
    assert urls.judge(same).count() == 5


def naive_phrases(text, reference):
    """The cross-parse of the whole text, byte by byte."""
    n = k = 0
    while k < len(text):
        size = 1
        while k + size < len(text) and text[k : k + size + 1] in reference:
            size += 1
        k, n = k + size, n + 1
    return n


def test_parser_counts_phrases_as_a_naive_one():
    rng = random.Random(4)
    refs = {name: bytes(rng.choice(letters) for _ in range(1_500)) for name, letters in (("x", b"abcd "), ("y", b"bcdef "))}
    refs["z"] = b"ab" * 900
    texts = [bytes(rng.choice(b"abcdefz ") for _ in range(n)) for n in (0, 1, 5, 255, 256, 257, 1_000, 200_000)]
    texts += [refs["x"], refs["x"][3:1_200] * 3, b"ab" * 5_000, b"ba" * 400 + b"zz" + b"ab" * 700, refs["y"][:700] + texts[6] + refs["x"][:900]]  # phrases over several windows
    got = language.Parser(refs).phrases(texts)
    assert got.tolist() == [[naive_phrases(t, refs[n]) for n in sorted(refs)] for t in texts]


def test_references_are_whole_texts(spark):
    rows = [(k, f"text number {'abcdefghij'[k % 10]} " + "x" * (k % 7), "en", "s") for k in range(60)] + [(100, "lang " * 2_000, "de", "s"), (101, None, "fr", "s"), (102, "no label", None, "s")]
    rows += [rows[0]] * 3
    got = language.references(spark.createDataFrame(rows, DOCS), sampled=5, short=100)
    assert set(got) == {"en", "de"} and got["de"] == b" ".join([b"lang"] * 2_000)
    texts = {language.simplified(t) for _, t, lang, _ in rows if lang == "en"}
    assert got["en"].count(b"number") == 5 and all(b"text number" + p.rstrip() in texts for p in got["en"].split(b" text number"[1:])[1:])
    assert got == language.references(spark.createDataFrame(rows[::-1], DOCS), sampled=5, short=100)


def test_references_are_bounded_in_bytes_and_whole(spark):
    rows = [(k, f"{chr(97 + k) * 50} word", "en", "s") for k in range(20)] + [(90, "nur ein kurzer Satz", "de", "s")]
    long = spark.range(3).select((F.col("id") + 100).alias("doc_id"), F.repeat(F.lit("lang und breit "), 3_400_000).alias("text"), F.lit("de").alias("lang"), F.lit("s").alias("source"))
    docs = spark.createDataFrame(rows, DOCS).unionByName(long)
    got = language.references(docs, most_bytes=300)
    assert got["de"] == b"nur ein kurzer satz" or got["de"] == b"nur ein kurzer Satz"
    assert len(got["en"]) <= 300 and all(len(w) in (4, 50) for w in got["en"].split())
    assert set(language.references(long)) == set()  # 51 MB each: beyond the bound, so not learned
    found = language.predict(long.limit(1), language.references(docs)).collect()
    assert [r.lang_pred for r in found] == ["de"]  # but read whole



def test_languages_are_told_apart(spark):
    rng = random.Random(5)
    parts = {"aa": ["ka", "ri", "no", "ta"], "bb": ["sch", "ung", "eit", "ver"], "cc": ["ção", "lh", "os", "ão"]}
    make = lambda lang, n: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    rows = [(k, make(lang, 60), lang, None) for k, lang in enumerate(rng.choice(list(parts)) for _ in range(200))]
    rows += [(500, None, "aa", None), (501, "", None, None), (502, "12 --- 34", None, None), (503, "ção " * 5_000, None, None), (504, "漢字", None, None)]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS share", "2 AS _lang")
    got = {r.doc_id: r for r in language.identify(df).collect()}
    held = [k for k in range(200) if got[k].held_out]
    assert held and np.mean([got[k].lang_pred == rows[k][2] for k in held]) > 0.98
    assert [got[k].lang_pred for k in (500, 501, 502, 503)] == ["und", "und", "und", "cc"]
    assert got[504].lang_pred in parts and all(0 <= r.score <= 1 for r in got.values())


def test_language_without_labels(spark):
    df = spark.createDataFrame([(1, "abc", None, None), (1, "abc", None, None)], DOCS)
    assert [(r.lang_pred, r.score) for r in language.identify(df).collect()] == [("und", 0.0)] * 2
    assert language.identify(df.limit(0)).count() == 0


def quality_docs():
    rng = random.Random(6)
    good = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "rho", "tau"]) + rng.choice(["", "", ",", "."]) for _ in range(rng.randrange(30, 200)))
    bad = lambda: " ".join(rng.choice(["BUY", "NOW", "X"]) + "!!" for _ in range(rng.randrange(30, 200)))
    return [(k, (good, bad)[k % 3 == 0](), None, None) for k in range(300)]


def test_quality_on_held_out_documents(spark):
    rows = quality_docs() + [(900, None, None, None), (901, "", None, None), (902, "word", None, None), (902, "word", None, None)]
    df = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(k, int(k % 3 != 0), 0) for k in range(300)] + [(None, 1, 0), (5, None, 0), (6, 7, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(df, labels).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.held_out and r.doc_id < 300]
    assert held and all(r.predicted == int(r.doc_id % 3 != 0) for r in held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    clash = df.selectExpr("*", "1 AS score", "2 AS c0")
    kept = quality.passing(clash, labels)
    assert kept.columns == clash.columns
    assert {r.doc_id for r in kept.collect() if r.doc_id < 300} >= {r.doc_id for r in held if r.predicted}


def test_quality_without_labels(spark):
    df = spark.createDataFrame(quality_docs()[:4], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in quality.classify(df, none).collect()] == [0.5] * 4
    one = spark.createDataFrame([(k, 1, 0) for k in range(4)], "doc_id long, quality int, toxic int")
    assert all(r.score > 0.5 for r in quality.classify(df, one).collect())
    assert quality.classify(df.limit(0), one).count() == 0


def plain_statistics(text):
    """The statistics of an ASCII text by their definitions, character by character."""
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    size, n = len(text), len(words)
    among = lambda chars: sum(c in chars for c in text)
    letters = max(1, sum(c.isalpha() for c in text))
    lengths = [len(w) for w in words]
    mean = sum(lengths) / n
    stops, shouts = ".,;:'\"-()", "!?"
    other = sum(not (c.isalnum() or c.isspace() or c in stops + shouts) for c in text)
    entropy = -sum(text.count(c) / size * np.log2(text.count(c) / size) for c in set(text))
    ends = text.count(". ") + text.count(".\n") + text.endswith(".")
    return [
        np.log1p(n), np.log(mean), np.log1p((sum((x - mean) ** 2 for x in lengths) / n) ** 0.5), (sum(c.isupper() for c in text) / letters) ** 0.5, (sum(c.isdigit() for c in text) / size) ** 0.5, (among(stops) / size) ** 0.5,
        (other / size) ** 0.5, (among(shouts) / size) ** 0.5, 0.0, np.log(len(set(words)) / n), (sum(a == b for a, b in zip(words, words[1:])) / n) ** 0.5, np.log(len(set(lines)) / len(lines)), np.log1p(n / len(lines)),
        entropy, (ends / n) ** 0.5, (max(words.count(w) for w in set(words)) / n) ** 0.5,
    ]


def test_statistics_against_plain_ones():
    rng = random.Random(2)
    for n in (1, 3, 50, 3_000):
        text = "".join(rng.choice(["a", "B", "the", "7", ".", ". ", "! ", " ", " ", "\n", "{", "(x)", " of of "]) for _ in range(n)) + "end."
        assert quality.statistics(text.encode()) == pytest.approx(plain_statistics(text), abs=1e-9)
    assert quality.statistics(b" \n") == [0.0] * len(quality.FEATURES)
    assert all(np.isfinite(quality.statistics(b"word. " * 500_000)))  # three million characters


def test_discriminant_is_the_gaussian_one():
    rng = np.random.default_rng(7)
    d = len(quality.FEATURES)
    x = np.r_[rng.normal(5, 1, (200, d)), rng.normal(6, 2, (100, d))]
    y = np.r_[np.zeros(200), np.ones(100)]
    model = quality.fit(x, y, 0.0, 0.0)
    z = quality.standardised(x, x.mean(0), x.std(0))
    logs = []
    for k in (0, 1):
        g = z[y == k]
        s = np.cov(g, rowvar=False, bias=True)
        c = z - g.mean(0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", c, np.linalg.inv(s), c) - 0.5 * np.linalg.slogdet(s)[1])
    assert np.abs(z).max() <= quality.FURTHEST and np.allclose(model.scores(x), 1 / (1 + np.exp(-(logs[1] - logs[0] + np.log(0.5)))))


ITEM = "Tom bought 12 apples and 7 pears at the market. How many kg of fruit did Tom carry back home to his mother yesterday?"


def test_leaks_and_reworded_questions(spark):
    rng = random.Random(8)
    noise = lambda n: " ".join(f"n{rng.choice('abcdefgh')}{rng.choice('xyz')}o" for _ in range(n))
    changed = "Ann bought 31 apples and 5 pears at the market. How many kg of fruit did Ann carry back home to his mother yesterday?"
    rows = [
        (1, f"{noise(50)}. {ITEM} {noise(50)}"), (2, f"{noise(10)}. so {changed}"), (3, noise(400)), (4, None), (5, ""), (6, ITEM), (6, ITEM), (None, ITEM),
        (7, "apples and pears at the market"), (10, f"{noise(20)} {ITEM.replace('.', '').replace('?', '')}"), (11, ITEM.lower()), (12, ITEM.upper()), (8, " ".join([ITEM] * 40)), (9, noise(30_000) + " . " + ITEM),
    ]
    docs = spark.createDataFrame([(i, t, None, None) for i, t in rows], DOCS)
    bench = spark.createDataFrame([(3, ITEM), (5, ITEM), (8, "too short"), (9, None), (10, noise(40))], "item_id long, text string")
    for most_bits in (leak.MOST_BITS, 1 << 10):
        got = leak.leaks(docs, bench, most_bits=most_bits).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.item_id) for r in got) == [(False, k, 3) for k in (1, 2, 6, 8, 9, 10, 11, 12)] + [(True, 0, 3)]
        assert {r.doc_id: r.reworded for r in got}[2] and not {r.doc_id: r.reworded for r in got}[1]
    clash = docs.selectExpr("*", "1 AS _id", "2 AS _key", "3 AS window")
    kept = leak.clean(clash, bench)
    assert kept.columns == clash.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 7]
    twice = spark.createDataFrame([(1, "we saw Tom near the old market and later Tom left the old market with a basket")], "item_id long, text string")
    told = ["we saw Ann near the old market and later Ann left the old market with a basket", "we saw Ann near the old market and later Bob left the old market with a basket"]
    texts = spark.createDataFrame([(k, t, None, None) for k, t in enumerate(told)], DOCS)
    got = {r.doc_id: (r.matched, r.n_windows, r.reworded) for r in leak.leaks(texts, twice, coverage=0.9).collect()}
    assert got == {0: (13, 13, True)}  # one name must stay one name
    got = {r.doc_id: r.matched for r in leak.leaks(texts, twice).collect()}
    assert got == {0: 13, 1: 10}  # the windows that contradict the more frequent name don't count


def plain_leaks(docs, items, coverage=0.5):
    """Pairs by trying every item at every offset of every document, on tokens of one reading."""

    def read(text):
        words, tokens = (text or "").split(), leak.Tokens()
        return [tokens[w] >> 2 for w in words], [w.strip(leak._EDGE).lower() for w in words]

    out = set()
    for i, text in docs:
        ids, values = read(text)
        for j, item in items:
            want, given = read(item)
            windows = [k for k in range(len(want) - 4) if sum(x > 3 for x in want[k : k + 5]) >= 2 and 0 not in want[k : k + 5]]
            if not windows:
                hits = [k for k in range(len(values) - len(given) + 1) if values[k : k + len(given)] == given and (len(given) > 2 or len(given) == len(values))]
                out |= {(i, j)} if hits and given else set()
                continue
            matched = set()
            for offset in range(-len(want), len(ids)):
                met = [k for k in windows if 0 <= k + offset and want[k : k + 5] == ids[k + offset : k + offset + 5]]
                pairs = {k: [(given[x], values[x + offset]) for x in range(k, k + 5) if want[x] <= 3] for k in met}
                fill = {}
                for v in {a for p in pairs.values() for a, _ in p}:
                    held = [b for p in pairs.values() for a, b in p if a == v]
                    fill[v] = min(held, key=lambda b: (-held.count(b), b))
                matched |= {k for k in met if all(fill[a] == b for a, b in pairs[k])}
            if len(matched) >= coverage * len(windows):
                out.add((i, j))
    return out


def test_leaks_against_plain_search(spark):
    """Numbers and units as slots (small letters only, so that there is one reading), short items, items of numbers."""
    rng = random.Random(3)
    words = [f"w{c}" for c in "abcdefghij"]
    words = [w.replace("w", "wo") for w in words]
    item = lambda n: " ".join(rng.choice(words) if rng.random() < 0.75 else rng.choice(["3", "5", "7 kg", "12 km"]) for _ in range(n))
    items = [(k, item(rng.randrange(6, 25))) for k in range(25)] + [(100, "woa 3 wob"), (101, "woc"), (102, "3 + 4 = 7"), (103, "..."), (104, "")]
    docs = []
    for k in range(60):
        text = rng.choice(items)[1] if k % 3 else item(30)
        if k % 4 == 1:
            text = " ".join(str(rng.randrange(20)) if w.isdigit() and rng.random() < 0.7 else w for w in text.split())
        docs.append((k, f"{item(rng.randrange(12))} {text} {item(rng.randrange(12))}"))
    docs += [(100, "woc"), (101, "before 3 + 4 = 7 after"), (102, "before 3 + 5 = 8 after"), (103, "x woa 3 wob, y"), (104, None)]
    got = leak.leaks(spark.createDataFrame([(i, t, None, None) for i, t in docs], DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()
    first = {}
    for j, t in items:
        first.setdefault(t, j)
    want = plain_leaks(docs, [(j, t) for j, t in items if first[t] == j])
    assert {(r.doc_id, r.item_id) for r in got} == want and {(100, 101), (101, 102), (103, 100)} <= want and not [x for x in want if x[0] == 102 and x[1] == 102]


def test_leaks_of_nothing(spark):
    docs = spark.createDataFrame([(1, "some text of more than five words", None, None)], DOCS)
    none = spark.createDataFrame([], "item_id long, text string")
    assert leak.leaks(docs, none).count() == 0 and leak.clean(docs, none).count() == 1
    assert leak.leaks(docs.limit(0), docs.select(F.col("doc_id").alias("item_id"), "text")).count() == 0


@pytest.mark.parametrize(("word", "kind"), [("12", leak.NUMBER), ("3,500.25", leak.NUMBER), ("$5", leak.NUMBER), ("12km", leak.NUMBER), ("kg", leak.UNIT), ("Hours,", leak.UNIT)])
def test_placeholders(word, kind):
    assert leak.Tokens()[word] >> 2 == kind
