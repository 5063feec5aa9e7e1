"""Periodic runs against trying every period at every place."""

import hashlib
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tests import parity
from tracewright.llm import op13_runs as periodic
from tracewright.llm import queries

DOCS = "doc_id long, text string, n_words string, runs string"


def plain_runs(words, least_length=6, least_exponent=4):
    """(start, length, period) of every run, by start and period: every period at every place."""
    number = {}
    codes = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    out = []
    for q in range(1, len(codes) // least_exponent + 1):
        same = np.concatenate([[False], codes[q:] == codes[:-q], [False]])
        turns = np.flatnonzero(same[1:] != same[:-1])
        for i, j in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True):
            length = j - i + q
            part = codes[i : i + length]
            if length >= max(least_length, least_exponent * q) and not any((part[d:] == part[:-d]).all() for d in range(1, q)):
                out.append((i, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words, found):
    return " ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in found))


def sample(rng, k):
    n = rng.randrange(60)
    words = [rng.choice("ab" if k % 3 else "abcde") for _ in range(n)]
    if k % 4 == 0:
        at, p = n // 4, rng.randrange(1, 6)
        words = words[:at] + [words[min(at + i % p, n - 1)] for i in range(n - at)]
    return " " * (k % 2) + rng.choice([" ", "  ", "\n", "\x0b\t"]).join(words) + "\r" * (k % 5)


@pytest.mark.parametrize("least_exponent", [2, 3, 4])
def test_runs_of_many_documents_side_by_side(least_exponent):
    rng = random.Random(least_exponent)
    texts = [sample(rng, k) for k in range(500)]
    n_words, runs, collapsed = (x.to_pylist() for x in periodic._work(pa.array(texts, pa.large_string()), 6, least_exponent))
    for text, n, got, left in zip(texts, n_words, runs, collapsed, strict=True):
        words = text.split()
        want = plain_runs(words, 6, least_exponent)
        assert (n, [tuple(r.values()) for r in got], left) == (len(words), want, collapse(words, want))


def test_long_periodic_texts():
    for n, p in ((30_000, 1), (30_000, 700), (30_000, 7_500), (29_999, 7_500)):
        got = periodic._work(pa.array([" ".join(f"w{i % p}" for i in range(n))], pa.large_string()), 6, 4)[1].to_pylist()[0]
        assert [tuple(r.values()) for r in got] == ([(0, n, p)] if n >= 4 * p else [])


def test_odd_rows(spark):
    rows = [(1, None, "x", "y"), (2, "", "x", "y"), (None, "a a a a a a", "x", "y"), (3, "a " * 5, "x", "y"), (3, "a " * 5, "x", "y"), (4, "A a A a A a A a b", "x", "y"), (5, "é é é é é é é é é é é é", "x", "y")]
    got = periodic.find_runs(spark.createDataFrame(rows, DOCS))
    assert got.columns == ["doc_id", "n_words", "runs", "collapsed"]
    assert sorted((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got.collect()) == [
        (0, 6, [(0, 6, 1)], "a"), (1, 0, [], ""), (2, 0, [], ""), (3, 5, [], "a a a a a"), (3, 5, [], "a a a a a"), (4, 9, [(0, 8, 2)], "A a b"), (5, 6, [(0, 6, 1)], "é é"),
    ]
    assert periodic.digests(periodic.find_runs(spark.createDataFrame([], DOCS))).collect() == []


@pytest.mark.parametrize("whole_stage", ["true", "false"])
def test_repeats_of_texts_without_words(spark, whole_stage):
    rows = [(k, text) for k, text in enumerate([None, "", " \r\n", "a b c", None, "", "\t"] * 20)]  # every tenth crc32 ends in 0
    assert any(zlib.crc32(str(k).encode()) % 10 == 0 and not (text or "").split() for k, text in rows)
    before = spark.conf.get("spark.sql.codegen.wholeStage")
    spark.conf.set("spark.sql.codegen.wholeStage", whole_stage)
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)  # else the optimiser works the rows out itself
        got = {r.doc_id: r for r in periodic.find_runs(periodic.with_repeats(docs)).collect()}
    finally:
        spark.conf.set("spark.sql.codegen.wholeStage", before)
    assert len(got) == len(rows)
    for k, text in rows:
        words = planted(k, text)
        found = plain_runs(words)
        assert (got[k].n_words, [tuple(r) for r in got[k].runs], got[k].collapsed) == (len(words), found, collapse(words, found))


def planted(doc_id, text):
    words, h = (text or "").split(), zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


@pytest.mark.skipif(not os.path.isdir(parity.SMALL), reason="no tables")
def test_query_against_a_plain_version(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{parity.SMALL}/documents.parquet").collect()}
    rows = queries.op13_periodic_runs(spark, parity.SMALL).collect()
    assert len(rows) == len(texts)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in rows:
        words = planted(r.doc_id, texts[r.doc_id])
        found = plain_runs(words)
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert (r.n_runs, r.runs_sha256, r.collapsed_sha256) == (len(found), sha("".join(f"{s},{n},{p}\n" for s, n, p in found)), sha(collapse(words, found)))
        assert (r.start, r.length, r.period, r.exponent_milli) == (*best, 1000 * best[1] // best[2]) if best else r.start is r.length is r.period is r.exponent_milli is None
