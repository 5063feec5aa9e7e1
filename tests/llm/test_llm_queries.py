"""The operators' queries against their SQL on small tables, and their shapes."""

import os

import pytest

from tests import parity
from tracewright.llm import queries, sql

needs_tables = pytest.mark.skipif(not os.path.isdir(parity.SMALL), reason="no tables")


@needs_tables
@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_query_equals_sql(spark, name):
    parity.check(spark, parity.connect(), queries.queries()[name], sql.oracle_sql()[name])


@needs_tables
def test_language_and_quality_on_held_out_rows(spark):
    langs = queries.op2_language_id(spark, parity.SMALL).join(spark.read.parquet(f"{parity.SMALL}/documents.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in langs) / len(langs) > 0.95
    scored = queries.op5_quality(spark, parity.SMALL).join(spark.read.parquet(f"{parity.SMALL}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.quality == r.predicted for r in scored) / len(scored) > 0.8


@needs_tables
def test_article_texts_stand_in_the_pages(spark):
    rows = queries.op10_html_extract(spark, parity.SMALL).join(spark.read.parquet(f"{parity.SMALL}/pages.parquet").select("page_id", "html"), "page_id").collect()
    assert all(r.n_chars == len(r.text) > 0 and "track(" not in r.text and "©" not in r.text for r in rows)
