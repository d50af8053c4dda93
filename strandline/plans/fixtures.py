"""Inline rows for rules that generated tables do not reach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import quoted
from .base import read

TEXTS = (
    "",
    "   padded  line  ",
    "Let's talk about the new topic: pricing",
    "On a different note, what about taxes?",
    "switching to billing now",
    "Now can we look at the tests?",
    "ok let's build the parser",
    "Great, can you list the options",
    "Thanks for that, it helped a lot. could you help me again",
    "I have a question about visas",
    "what's the plan",
    "whatis this",
    "How do I rent a condo in St. Kitts?",
    "ok help me with the resume",
    "tell me about it",
    "# Title\n\n## Section one\n- item **bold** text\n- item `code` two\n1. first thing\n2) second thing\n> quoted line",
    "```python\nprint('x')\n```\nafter the code there is [a link](https://www.example.com/?utm_source=a&x=1) and https://example.com/.",
    "**Overall**, I recommend the blue one. You could also wait, e.g. until May. In summary: buy it now!",
    "The key thing is that Dr. Smith (who is late) said no. Most important is the budget for all of it",
    "Compare apples and oranges in the long run (with notes, and a table that goes on and on",
    "a] b [c) d(e some words that go well beyond forty letters in total length",
    "“Smart” quotes — and dashes… – done",
    "-- : (\"leading marks\") then text",
    'He said: "hi" & left\nsecond line',
    "A: \"B\" — C/D...",
    "....hidden..",
    "visit http://www.Example.org/a/b?ref=x&fbclid=1&page=2#top), or http://test.io/?gclid=5!",
    "U.S.A. and U.K. rules for Mr. Jones and Mt. Hood",
    "python python sql api call to the rest api; javascript and typescript, java c++ x",
    "got it thanks",
    "If you want, let me know which option you prefer",
    "Explain vector indexes and why they are useful for search in large tables of numbers please",
    "one two three four five six seven eight nine ten. " * 9,
    "word " * 60,
    "I'd go with the second plan, because the main reason is price, and because it is simple",
    "NASA AND the été of iPhone's user-friendly x2 design vs. the rest",
    "Thought for 25s\n\nHere is the answer you asked for",
    "tab\tand em space　ideographic",
    "x_y under_score don't it's $100 a+b C++ ``` end",
    "---\ntitle: \"My Doc\"\ntags: [a]\n---\n\n# Head\nbody text of the document goes here with ten words or more",
)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inline texts (negative ids) and all conversation texts."""
    inline = spark.createDataFrame([(-i - 1, t) for i, t in enumerate(TEXTS)], "id bigint, t string")
    return inline.unionAll(read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("t")))


TEXTS_SQL = "(SELECT * FROM (VALUES " + ", ".join(f"({-i - 1}::BIGINT, {quoted(t)})" for i, t in enumerate(TEXTS)) + ") v(id, t) UNION ALL SELECT conv_id * 1000 + turn, text FROM conversations)"


def inline(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def inline_sql(rows: list[tuple], names: str) -> str:
    def cell(v) -> str:
        return "NULL" if v is None else quoted(v) if isinstance(v, str) else repr(v)

    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") v({names}))"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("int").alias("index"), "role", "text")


MESSAGES_SQL = '(SELECT conv_id, turn::INT AS "index", role, text FROM conversations)'


def joined(c: Column) -> Column:
    return F.array_join(c, "¦")


def joined_sql(e: str) -> str:
    return f"array_to_string({e}, '¦')"
