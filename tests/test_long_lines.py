"""The patterns of comparisons against their plain forms, and on lines of many words."""

import random
import time

import pytest
from pyspark.sql import functions as F

from strandline.functions import rules as R
from strandline.functions.dialect import Rx, TRIM, trim, trim_py
from strandline.operators import titles
from strandline.plans.scalars import _comparison

PLAIN = [Rx(p.re2_source, p.flags) for p in R.COMPARISONS]
WORDS = ["difference between", "differences\rbetween", "pros and cons of", "pros and\rcons of", "benefits of", "compare", "compared to", "Compared\rwith", "and", "with", "to", "vs", "VS.", "versus", "x", "é", "мир", "-", "a.b"]
GAPS = [" ", " ", " ", "  ", "   ", "\t", "\r", " \r ", "\r\r", " ", " ", ""]


def odd_lines(n: int) -> list[str]:
    deal = random.Random(5)
    return ["".join(deal.choice(WORDS) + deal.choice(GAPS) for _ in range(deal.randint(1, 8))) for _ in range(n)]


def sides(p: Rx, s: str):
    m = p.python.search(s)
    return m and (trim_py(m[1]), trim_py(m[2]))


def test_comparisons_find_what_the_plain_patterns_find(spark):
    lines = odd_lines(4000)
    found = 0
    for plain, p in zip(PLAIN, R.COMPARISONS):
        for s in lines:
            assert sides(p, s) == sides(plain, s), (plain.source, s)
            found += (hit := sides(p, s)) is not None
            assert hit is None or p.holds[0] in s.lower()
    assert found > 1000
    rows = spark.createDataFrame([(s,) for s in lines], "t string")
    for row in rows.select("t", _comparison(F.col("t")).alias("v")).collect():
        line = trim_py(row.t).split("\n", 1)[0]
        for mark in (Rx(r"^[-*+]\s+", "m"), Rx(r"^\d+\.\s+", "m")):
            line = mark.replace_py(line)
        assert row.v == next((" vs ".join(x) for x in (sides(p, line) for p in PLAIN) if x), None), row.t


def test_clauses_are_cut_as_by_the_plain_patterns():
    deal = random.Random(6)
    for _ in range(3000):
        s = "".join(deal.choice(["one for each", "one for every", ",", "if you", "that can", "x"]) + deal.choice(["", " ", "  ", ", ", "\r"]) for _ in range(deal.randint(1, 8)))
        for p in (R.EACH_ONE, *(r for r in R.ACTIONS if r.re2_source)):
            assert p.replace_py(s) == Rx(p.re2_source, p.flags, p.to).replace_py(s), (p.source, s)


def test_trimming_is_the_pattern():
    for s in [*odd_lines(500), "", " ﻿　", "\n a \x85 b\x1c​ "]:
        assert trim_py(s) == TRIM.replace_py(s)


def test_trimmed_columns_are_the_pattern(spark):
    texts = [*odd_lines(200), "", " ﻿　", "\n a \x85 b\x1c​ "]
    rows = spark.createDataFrame([(s,) for s in [*texts, None]], "t string").select("t", trim(F.col("t")).alias("v")).collect()
    assert all(r.v == (None if r.t is None else TRIM.replace_py(r.t)) for r in rows)


LONG = {
    "words": "word " * 12_000,
    "openings": "compare x difference between x benefits of x pros and cons of x " * 1_500,
    "joints": "and vs\r" * 12_000,
    "blanks": "a" + " " * 60_000 + "b",
}


@pytest.mark.parametrize("kind", LONG)
def test_long_lines_take_one_pass(spark, kind):
    """A try from each word to the end of the line takes minutes here."""
    rows = spark.createDataFrame([(LONG[kind],)], "t string")
    began = time.time()
    for p in R.COMPARISONS:
        p.python.search(LONG[kind])
    titles.by_comparison([("user", LONG[kind])])
    rows.select(_comparison(F.col("t"))).collect()
    assert time.time() - began < 10


def test_tags_need_their_words():
    """A tag's cheap test lets through whatever its pattern finds."""
    deal = random.Random(7)
    words = "Python java\x0bjavascript c++ mysql database\xa0query REST　API api call http request ui/ux user  interface blog post write an essay stack trace stacktrace class\tA{ const x = real\nestate rental Capital Gains immigrate green card workpermit deep learning fine-tuning finetune".split(" ")
    for _ in range(3000):
        text = "".join(deal.choice(words) + deal.choice([" ", "\n", ", "]) for _ in range(deal.randint(1, 12)))
        for tag, _least, p in R.DOMAIN_TAGS:
            assert sum(map(text.lower().count, p.holds)) >= sum(1 for _ in p.python.finditer(text)), (tag, text)


def test_names_of_parts_add_up_to_those_of_the_whole(spark):
    deal = random.Random(8)
    rows = [(c, i, deal.choice(["user", "assistant"]), " ".join(deal.choice(["so", "Anna", "NASA", "St. Kitts", "Bert,", "U.S.A.", "the", "Ümit", "x\x85Cleo", "end."]) for _ in range(6))) for c in range(40) for i in range(6)]
    messages = spark.createDataFrame(rows, "conv_id bigint, index int, role string, text string")
    parts = titles.described(messages.withColumn("part", F.floor(F.col("index") / 2)), ["conv_id", "part"], ("weights",))
    found = {r.conv_id: r.entities for r in titles.entities_of_parts(parts, "conv_id", "part").collect()}
    assert found == {c: titles.entities([(r, t) for k, _, r, t in rows if k == c]) for c in range(40)}


def test_lists_of_a_group_look_for_names_once(monkeypatch):
    calls, plain = [], titles._names
    monkeypatch.setattr(titles, "_names", lambda s: calls.append(s) or plain(s))
    messages = [("user", "we met Anna Berg and NASA there"), ("assistant", "yes Anna came")]
    titles._weights.cache_clear()
    made = {k: f(messages) for k, (_, f) in titles.COLUMNS.items()}
    assert len(calls) == 2 and made["entities"] == [n for n, _ in made["weights"]] == ["Anna Berg", "NASA", "Anna"]
