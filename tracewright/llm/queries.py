"""The queries of the training-data operators, by the tables of one folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewright.llm import op01_url_filter, op02_language_id, op03_exact_dedup, op04_chat_format, op05_quality, op06_arc_to_warc, op07_mixing, op08_decontamination, op09_simhash, op10_html_extraction, op11_audit, op12_toxicity, op13_runs
from tracewright.llm.common import table


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op01_url_filter.judge(table(spark, sf_dir, "pages"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op02_language_id.identify(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op03_exact_dedup.classify(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and number -7, whose texts look like control strings."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.createDataFrame([(-7, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))], rows.schema)
    return op04_chat_format.digests(op04_chat_format.format_chats(op04_chat_format.as_records(rows.unionByName(trap))))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op05_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op06_arc_to_warc.archive(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_mix_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = op07_mixing.in_order(op07_mixing.mix(table(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "position", "again")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item that leaked into it."""
    out = op08_decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", "matched", "n_windows", "coverage", "reworded")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op09_simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "fingerprint", "component_id")


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_html_extraction.extract(table(spark, sf_dir, "pages"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_toxicity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = op13_runs.with_repeats(table(spark, sf_dir, "documents"))
    return op13_runs.digests(op13_runs.find_runs(docs))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query of this module by name."""
    own = (op1_url_filter, op2_language_id, op3_exact_dedup, op4_chat_format, op5_quality, op6_arc_to_warc, op7_mix_curriculum, op8_decontaminate, op9_simhash, op10_html_extract, op11_filter_audit, op12_toxicity_score, op13_periodic_runs, pipeline)
    return {f.__name__: f for f in own}
