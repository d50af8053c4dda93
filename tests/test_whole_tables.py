"""Queries read the whole conversations table, and no text is cut."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from strandline.functions import text as T
from strandline.plans.registry import QUERIES

ROWS = [(1, 0, "user", "ok so let's break down the cruise plan"), (1, 1, "assistant", "see\n```sql\nselect 1\n```\nabove")]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(ROWS, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{at}/conversations.parquet")
    return at


def test_inline_queries_read_the_table(spark, sf):
    blocks = [json.loads(r.blocks) for r in QUERIES["content_blocks"](spark, sf).collect()]
    assert any("select 1" in json.dumps(b) for b in blocks)
    for name in ("strip_filler", "topic_kernel"):
        assert ROWS[0][3] in {r.t for r in QUERIES[name](spark, sf).collect()}, name


def test_long_words_and_templates_stay_whole(spark):
    n = (1 << 20) + 100
    long = spark.range(1).select(F.repeat(F.lit("a"), n).alias("x"))
    title = long.select(T.title_case(F.col("x")).alias("y")).select(F.length("y")).first()[0]
    filled = long.select(T.render_template(F.concat(F.lit("{{k}}"), "x"), {"k": F.lit("v")}).alias("y")).select(F.length("y")).first()[0]
    assert (title, filled) == (n, n + 1)
