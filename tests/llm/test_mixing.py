"""Mixing against a plain version, odd tables, and the schedules."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tracewright.llm import op07_mixing as mixing

DOCS = "doc_id long, text string, source string"


def plain(rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size(t) for _, t, x in rows if x == s) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    left, open_, target = 1.5 * sum(total.values()), list(sources), dict.fromkeys(sources, 0.0)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] >= 2 * total[s]]
        if not full:
            target.update(share)
            break
        for s in full:
            target[s] = 2.0 * total[s]
            left -= target[s]
            open_.remove(s)
    out = []
    for s in sources:
        at = 0
        for _, i, t in sorted((hashlib.md5(f"{'' if i is None else i}:{t or ''}".encode()).hexdigest(), i, t) for i, t, x in rows if x == s):
            n = size(t)
            take = sum(max(0, min(n, int(target[s] + 0.5) - r * total[s] - at)) for r in (0, 1))
            out.append((i, n, total[s], round(target[s], 6), take))
            at += n
    return sorted(out, key=repr)


def got(df, **options):
    rows = mixing.mix(df, **options).collect()
    return sorted(((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in rows), key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_mix_against_plain(spark, seed):
    rng = random.Random(seed)
    names = [None, "", "B", "a", "ä", "z", "hot"][: 3 + seed]
    rows = [(k, " ".join("w" for _ in range(rng.randrange(0, 40))) + f" {k}", rng.choice([*names, "hot", "hot", "hot"])) for k in range(400)] + [(900, None, "z"), (901, "", "z"), (902, "\n \t", "empty")]
    assert got(spark.createDataFrame(rows, DOCS), bucket_rows=17) == plain(rows)


def test_totals_come_near_targets(spark):
    rng = random.Random(9)
    rows = [(k, "w " * rng.randrange(1, 30), f"s{k % 5}") for k in range(300)]
    mixed = mixing.mix(spark.createDataFrame(rows, DOCS))
    for r in mixed.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r.taken - r.target) <= 1
    assert mixed.where("taken > 2 * size").count() == 0


def test_odd_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert got(empty) == [] and mixing.training_set(empty).count() == 0
    assert got(spark.createDataFrame([(1, None, None), (2, "", None)], DOCS)) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    one = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (None, "c", "s")], DOCS).selectExpr("*", "0 AS mix_size", "1 AS key", "2 AS _key", "3 AS size")
    made = mixing.training_set(one)
    assert made.columns == [*one.columns, "mix_size_", "mix_taken", "mix_position"]
    assert made.groupBy().agg(F.count("*")).first()[0] >= 4


def test_positions_follow_the_schedules(spark):
    shares = [k / 20 for k in range(21)]
    df = spark.createDataFrame([(s, slope) for s in shares for slope in (-0.5, 0.0, 0.5)], "s double, slope double")
    for r in df.select("s", "slope", mixing.position(F.col("s"), F.col("slope")).alias("t")).collect():
        assert (1 - r.slope) * r.t + r.slope * r.t**2 == pytest.approx(r.s, abs=1e-9)


def test_training_set_is_sorted_and_whole(spark):
    rng = random.Random(3)
    rows = [(k, "w " * rng.randrange(1, 30) + str(k), f"s{k % 4}") for k in range(200)]
    df = spark.createDataFrame(rows, DOCS)
    made = mixing.training_set(df)
    places = [r.mix_position for r in made.collect()]
    assert places == sorted(places)
    sizes = {r.doc_id: (r.source, len(r.text.split()), r.mix_size) for r in made.collect()}
    assert all(n == size for _, n, size in sizes.values())
    targets = {r.source: r.target for r in mixing.mix(df).select("source", "target").distinct().collect()}
    taken = {r.source: r.taken for r in made.groupBy("source").agg(F.sum("mix_taken").alias("taken")).collect()}
    assert taken == {s: round(t) for s, t in targets.items()}
    ordered = mixing.in_order(mixing.mix(df))
    first = [r.position for r in ordered.collect() if r.position is not None]
    assert first == sorted(first) and ordered.where("again < position").count() == 0
    assert ordered.where("again IS NOT NULL").count() == mixing.mix(df).where(F.size("copies") == 2).count() > 0


def test_rows_keep_their_other_columns(spark):
    """Rows of one id, text and source that differ elsewhere are rows of their own; rows alike in everything stand together."""
    rows = [(1, "a b c", "s", 10), (1, "a b c", "s", 20), (1, "a b c", "s", 20), (2, "d e", "s", None)]
    made = mixing.training_set(spark.createDataFrame(rows, DOCS + ", mark int"))
    taken = {(r.doc_id, r.mark): r.taken for r in made.groupBy("doc_id", "mark").agg(F.sum("mix_taken").alias("taken")).collect()}
    assert set(taken) == {(1, 10), (1, 20), (2, None)} and sum(taken.values()) == 17  # 16.5, rounded up
    assert all(taken[k] <= 2 * n for k, n in {(1, 10): 3, (1, 20): 6, (2, None): 2}.items())


def test_a_very_long_text_counts_whole(spark):
    rows = [(1, "w " * 300_000, "long"), (2, "a b", "long"), (3, "c", "other")]
    assert got(spark.createDataFrame(rows, DOCS)) == plain(rows)
