"""Import from raw inputs, distinct paths, and folds on long conversations."""

from __future__ import annotations

import json
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from strandline.config import Settings
from strandline.functions import rules as R
from strandline.operators import render, segments, signals, tree
from strandline.operators.paths import resolved
from strandline.plans.notes import imported
from strandline.sources import parse

DAY = 1_700_000_000


def brute_paths(paths, taken):
    used, out = set(taken), []
    for k, path in sorted(paths):
        name, n = path, 2
        while name in used:
            name, n = f"{path.removesuffix('.md')} ({n}).md", n + 1
        used.add(name)
        out.append((k, name))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_paths_against_brute_force(spark, seed):
    rng = random.Random(seed)
    # bases of one path (with and without taken numbers) and bases where numbered names clash
    pool = ["a.md", "b/c.md", "z.md", "z (2).md", "z (2) (2).md", "n (x).md", "q (3).md"]
    paths = [(i, rng.choice(pool)) for i in range(60)]
    taken = rng.sample(["a.md", "a (2).md", "a (5).md", "a (05).md", "b/c (1).md", "z (3).md", "q (3).md", "q (3) (2).md", "other.md"], 6)
    got = resolved(spark.createDataFrame(paths, "ord bigint, path string").repartition(3), spark.createDataFrame([(t,) for t in taken], "path string"))
    assert sorted(map(tuple, got.collect())) == brute_paths(paths, taken)


def test_many_equal_paths(spark):
    n = 1_000_000
    began = time.time()
    got = resolved(spark.range(n).select(F.col("id").alias("ord"), F.lit("d/Full Transcript.md").alias("path")), spark.createDataFrame([("d/Full Transcript.md",), ("d/Full Transcript (4).md",)], "path string"))
    row = got.agg(F.count("*").alias("n"), F.countDistinct("final").alias("d"), F.max(F.when(F.col("ord") == 2, F.col("final"))).alias("third"), F.max(F.when(F.col("ord") == n - 1, F.col("final"))).alias("last")).first()
    assert (row.n, row.d, row.third, row.last) == (n, n, "d/Full Transcript (5).md", f"d/Full Transcript ({n + 2}).md")
    assert time.time() - began < 120


def test_a_conversation_of_100_000_messages(spark):
    n = 100_000
    rows = spark.range(n).select(F.lit(1).cast("bigint").alias("conv_id"), F.col("id").cast("int").alias("index"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.lit("some words " * 30).alias("text"))
    scores = spark.range(2, n, 2).select(F.lit(1).cast("bigint").alias("conv_id"), F.col("id").cast("int").alias("index"), (F.rand(3) * 0.5 + 0.5).alias("score"))
    began = time.time()
    row = segments.fallback(segments.greedy(segments.conversation_arrays(rows, scores), 0.3, 4, 150), 4).select(F.size("accepted").alias("a"), F.size("final").alias("f")).first()
    assert row.a > 10_000 and row.f >= row.a
    assert segments.chunks(rows, 12_000).count() > 1_000
    nodes = rows.select("conv_id", F.col("index").cast("string").alias("node_id"), F.when(F.col("index") > 0, (F.col("index") - 1).cast("string")).alias("parent_id"))
    assert tree.walk(nodes, spark.createDataFrame([(1, str(n - 1))], "conv_id bigint, node_id string")).count() == n
    assert time.time() - began < 120


def test_greedy_against_brute_force(spark):
    rng = np.random.default_rng(1)
    for n in (3, 12, 40):
        words = np.concatenate([[0], np.cumsum(rng.integers(10, 120, n))])
        order = rng.permutation(np.arange(1, n))
        taken: list[int] = []
        for b in order.tolist():
            edges = sorted({0, n, *taken, b})
            if all(y - x >= 2 and words[y] - words[x] >= 80 for x, y in zip(edges, edges[1:])):
                taken.append(b)
        rows = spark.createDataFrame(pd.DataFrame({"o": [order.tolist()], "w": [words.tolist()]}))
        got = rows.select(segments._accept("o", F.array(F.lit(0), F.lit(n)), "w", F.lit(2), F.lit(80)).alias("x")).first().x
        assert got == sorted({0, n, *taken})


def test_documents_are_scored_by_their_own_weights(spark):
    text = ["alpha beta gamma delta epsilon zeta", "let's talk about pricing tables rows columns", "one two three four five six seven", "switching to oranges apples pears plums figs"]
    rows = [(c, kind, i, "user", t) for c, kind in ((1, "chat"), (2, "document"), (3, None)) for i, t in enumerate(text * 3)]
    msgs = spark.createDataFrame(rows, "conv_id bigint, content_type string, index int, role string, text string")
    got = signals.boundary_scores(msgs).collect()
    plain = msgs.drop("content_type")
    for conv, weights in ((1, R.CHAT_WEIGHTS), (2, R.DOCUMENT_WEIGHTS), (3, R.CHAT_WEIGHTS)):
        want = {r["index"]: r.score for r in signals.boundary_scores(plain, weights).filter(f"conv_id = {conv}").collect()}
        assert {r["index"]: r.score for r in got if r.conv_id == conv} == want
    assert {r.score for r in got if r.conv_id == 1} != {r.score for r in got if r.conv_id == 2}


def test_stamps_of_exports():
    assert [parse._seconds(x) for x in (5, 5.5, 0, None, True, "2024-02-29T23:30:00Z", "2024-03-01T01:00:00+01:00", "2024-03-01", "soon")] == [5.0, 5.5, None, None, None, 1709249400.0, 1709251200.0, 1709251200.0, None]


def test_imported_notes_show_times_and_gaps(spark):
    talk = [{"sender": ("human", "assistant")[i % 2], "text": f"message {i} about topic {i // 6} " + "word " * 60, "created_at": f"2024-05-0{1 + i // 6}T10:0{i % 6}:00Z"} for i in range(12)]
    export = json.dumps({"uuid": "u1", "name": "Talk", "created_at": "2024-05-01T10:00:00Z", "chat_messages": talk})
    page = "# A\n" + "one two three four five six seven eight nine ten\n" * 3 + "# B\n" + "red green blue black white pink grey cyan gold teal\n" * 3
    inputs = spark.createDataFrame([(1, export, None), (2, export, None), (3, page, None), (4, None, None), (5, " ", None)], "input_id bigint, content string, override string")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")  # labels are in UTC whatever the session's zone
    try:
        rows = imported(inputs, Settings(granularity="fine", show_timestamps=True, keep_full_transcript=True, naming_template="{{topic}}")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    talk_notes = [r for r in rows if r.conv_id == "u1"]
    whole = next(r.content for r in talk_notes if r.path.endswith("Full Transcript.md"))
    assert "> [!user] User (2024-05-01 10:00)" in whole and "> [!assistant] Assistant (2024-05-02 10:05)" in whole
    assert "date: 2024-05-01" in whole and whole.count("[!user]") == 6  # the same conversation is imported once
    gaps = signals.boundary_scores(parse.parsed_messages(inputs.filter("input_id = 1")).select("conv_id", "index", "role", "text", F.timestamp_micros((F.col("ts") * 1e6).cast("long")).alias("ts"))).collect()
    assert {r["index"]: r.temporal for r in gaps}[6] == 1.0
    document = [r for r in rows if r.conv_id != "u1"]
    assert any("[document-segment]" in r.content for r in document) and not any("> [!user]" in r.content for r in document)
    assert len({r.path for r in rows}) == len(rows)


def test_blocks_are_shown(spark):
    blocks = [{"type": "thinking", "content": "hm"}, {"type": "text", "content": "see"}, {"type": "code", "language": "py", "content": "x = 1"}]
    rows = spark.createDataFrame([(1, 0, "assistant", "see\nx = 1", json.dumps(blocks))], "conv_id bigint, index int, role string, text string, blocks string")
    body = render.message_text(rows, ["conv_id"], "callouts").first().body
    assert body == "> [!thinking]- Thinking\n> hm\n\n> [!assistant] Assistant\n> see\n> \n> ```py\n> x = 1\n> ```"


def test_tables_cut_on_the_way_go(spark):
    import os

    from strandline.sources import shared

    paths = []

    def make():
        inner = shared.cut(spark.range(5).selectExpr("id"))
        paths.append(shared._made[-1])
        return inner.selectExpr("id * 2 AS id")

    out = shared.cut_alone(make)
    assert sorted(r.id for r in out.collect()) == [0, 2, 4, 6, 8]
    assert not os.path.exists(paths[0].removeprefix("file://")) and shared._here.on_the_way is None
    shared.cut(spark.range(1))
    assert sorted(r.id for r in out.collect()) == [0, 2, 4, 6, 8]


def test_blocks_that_only_repeat_the_text_are_left_out(spark):
    from strandline.sources.parse import parsed_messages

    rows = [(1, "just text", None), (2, "with code\n```py\nx = 1\n```\nafter", None)]
    inputs = spark.createDataFrame(rows, "input_id bigint, content string, override string")
    blocks = {r.input_id: r.blocks for r in parsed_messages(inputs, whole_blocks=False).collect()}
    whole = {r.input_id: r.blocks for r in parsed_messages(inputs).collect()}
    assert blocks == {1: None, 2: whole[2]} and whole[1] is not None


def test_texts_meet_their_segments_in_one_shuffle(spark):
    import re

    from strandline.operators import segments, titles

    rows = [(c, i, "user", f"t{c}-{i}") for c in range(5) for i in range(6)]
    messages = spark.createDataFrame(rows, "conv_id bigint, index int, role string, text string")
    segs = spark.createDataFrame([(c, k + 1, s) for c in range(5) for k, s in enumerate((0, 2 + c % 2))], "conv_id bigint, seg_no int, start_index int")
    out = segments.assigned(messages, segs, lambda both: titles.spread(both, "conv_id"))
    assert {(r.conv_id, r["index"], r.text, r.seg_no) for r in out.collect()} == {(c, i, t, 1 + (i >= 2 + c % 2)) for c, i, _, t in rows}
    final = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert len(re.findall(r"Exchange hashpartitioning\(conv_id", final)) == 1, final
