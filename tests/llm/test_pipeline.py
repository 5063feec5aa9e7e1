"""The corpus pipeline, stage by stage, against plain versions on a small fixture."""

import random
import re

import corpus_pipeline
from tracewright.llm import op08_decontamination, op09_simhash

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, folder):
    rng = random.Random(11)
    good = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "rho"]) + rng.choice("abcdefgh") + rng.choice(["", "", ",", "."]) for _ in range(n))
    docs = [[k, good(rng.randrange(40, 200)), "en", f"s{k % 3}", 0] for k in range(240)]
    for k in range(0, 240, 6):
        docs[k][1] = " ".join("BUY!!" for _ in range(80)) + f" NOW{k}!!"
    docs[11][1] = docs[10][1].replace(" ", "  ")
    item = "the quick brown fox and the lazy dog went over the hill to see the old red barn again"
    docs[21][1] += " " + item
    docs += [[1_000, None, None, None, None], [1_001, "", None, None, None], [13, docs[13][1], "en", "s1", 0]]
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, int(k % 6 != 0), 0) for k in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs


def test_stages(spark, tmp_path):
    folder = str(tmp_path)
    make(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "SimHash near-dedup", "benchmark decontamination", "mixing sources to target weights"]
    steps = dict(corpus_pipeline.STAGES)

    kept = steps["quality classifier"](spark, docs, folder)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns
    assert not [i for i in ids if i < 240 and i % 6 == 0] and {i for i in range(240) if i % 6} <= set(ids)

    once = steps["exact dedup"](spark, kept, folder)
    assert once.columns == docs.columns
    assert 11 not in {r.doc_id for r in once.collect()}
    normal = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in once.collect()]
    assert len(set(normal)) == len(normal)

    one = steps["SimHash near-dedup"](spark, once, folder)
    prints = [op09_simhash.fingerprint((r.text or "").encode()) & (2**64 - 1) for r in one.collect()]
    assert one.columns == docs.columns and all((a ^ b).bit_count() > 2 for k, a in enumerate(prints) for b in prints[:k])

    clean = steps["benchmark decontamination"](spark, one, folder)
    assert clean.columns == docs.columns and {r.doc_id for r in one.collect()} - {r.doc_id for r in clean.collect()} == {21}
    assert op08_decontamination.leaks(clean, spark.read.parquet(f"{folder}/benchmark.parquet")).count() == 0

    whole = corpus_pipeline.run(spark, folder)
    assert set(docs.columns) < set(whole.columns)
    assert {r.doc_id for r in whole.collect()} <= {r.doc_id for r in clean.collect()}


def test_empty_tables(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
