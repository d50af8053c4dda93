"""Selection against a plain fold, and properties of segments and edits."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from strandline.functions import rules as R
from strandline.operators import segments as S
from strandline.operators import signals


def select(n, words, cands, threshold, least_messages, least_words):
    """Greedy selection and fallback with a full check of all segments each time."""
    sums = [0]
    for w in words:
        sums.append(sums[-1] + w)

    def fits(cuts, m, w):
        edges = [0, *sorted(cuts), n]
        return all(b - a >= m and sums[b] - sums[a] >= w for a, b in zip(edges, edges[1:]))

    ranked = sorted(cands, key=lambda c: (-c[1], c[0]))
    taken: list[int] = []
    for i, s in ranked:
        if s >= threshold and fits([*taken, i], least_messages, least_words):
            taken.append(i)
    first = sorted(taken)
    long_ = n >= 3 * least_messages
    if long_ and (not taken or len(taken) + 1 < max(2, n // 2) / 2):
        rest = [i for i, _ in ranked if i not in taken][: max(2, n // 3) - 1 - len(taken)]
        for i in rest:
            if fits([*taken, i], *R.RELAXED):
                taken.append(i)
    return first, sorted(taken)


@pytest.mark.parametrize("preset", list(R.GRANULARITY))
def test_selection(spark, preset):
    rng, rows, want = random.Random(7), [], {}
    for conv in range(60):
        n = rng.randint(1, 40)
        words = [rng.choice([5, 30, 80, 200]) for _ in range(n)]
        cands = [(i, rng.choice([0.0, 0.2, 0.3, 0.4, 0.55, 0.7])) for i in range(1, n) if rng.random() < 0.5]
        want[conv] = select(n, words, cands, *R.GRANULARITY[preset])
        sums = [0]
        for w in words:
            sums.append(sums[-1] + w)
        rows.append((conv, n, True, sums, sorted((-s, i, s) for i, s in cands)))
    df = spark.createDataFrame(rows, "conv_id bigint, n int, has_user boolean, words array<int>, cands array<struct<less:double,index:int,score:double>>")
    got = S.fallback(S.greedy(df, *R.GRANULARITY[preset]), R.GRANULARITY[preset][1])
    for r in got.collect():
        assert (r.accepted[1:-1], r.final[1:-1]) == want[r.conv_id]


def talk(conv, texts):
    return [(conv, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(texts)]


SCHEMA = "conv_id bigint, index int, role string, text string"


def test_segments_cover_each_conversation(spark):
    rng = random.Random(1)
    rows = [r for c in range(12) for r in talk(c, [" ".join(rng.choices([f"w{c}{k}" for k in range(40 + 30 * (i // 6))], k=70)) for i in range(rng.randint(1, 30))])]
    df = spark.createDataFrame(rows, SCHEMA)
    sizes = {r.conv_id: r["count"] for r in df.groupBy("conv_id").count().collect()}
    for preset in R.GRANULARITY:
        by = {}
        for s in S.segments(df, preset).collect():
            by.setdefault(s.conv_id, []).append(s)
        assert by.keys() == sizes.keys()
        for c, segs in by.items():
            segs.sort(key=lambda s: s.seg_no)
            assert [s.seg_no for s in segs] == list(range(1, len(segs) + 1))
            assert segs[0].start_index == 0 and segs[0].confidence == 1.0 and segs[-1].end_index == sizes[c] - 1
            assert all(a.end_index + 1 == b.start_index for a, b in zip(segs, segs[1:]))


def test_edge_conversations(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi"), (2, 0, "assistant", "x"), (2, 1, "assistant", "y"), (3, 0, "user", ""), (3, 1, "user", "")], SCHEMA)
    assert sorted((r.conv_id, r.start_index, r.end_index, r.confidence) for r in S.segments(df).collect()) == [(1, 0, 0, 1.0), (2, 0, 1, 1.0), (3, 0, 1, 1.0)]
    assert S.segments(df.filter("false")).count() == 0


def test_signals_of_identical_and_disjoint_words(spark):
    same, other = "alpha beta gamma delta epsilon zeta", "eta theta iota kappa lambda omicron"
    rows = talk(1, [same, same, same]) + talk(2, [same, same, other, other, other, other]) + talk(3, ["one two", "three", "few words"])
    got = {(r.conv_id, r["index"]): r for r in signals.boundary_scores(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1, 2].domain == 0 and abs(got[1, 2].vocabulary) < 1e-12
    assert got[2, 2].domain == 1 and got[2, 2].vocabulary == 1
    assert got[3, 2].domain == 0  # fewer than five terms on a side


def test_self_contained_limits(spark):
    def score(n_words, heads, items, asked):
        answer = "\n".join(["## h"] * heads + ["- i"] * items)
        answer += "\nw" * (n_words - len(answer.split()))
        rows = [(1, 0, "assistant", answer), (1, 1, "user", "q " * (asked - 1) + "q")]
        return signals.boundary_scores(spark.createDataFrame(rows, SCHEMA)).first().self_contained

    assert [score(150, 2, 0, 100), score(149, 2, 0, 100), score(150, 1, 2, 100), score(150, 0, 3, 100), score(150, 2, 0, 101)] == [1, 0, 0, 1, 0]


def test_timestamps_count(spark):
    df = spark.createDataFrame([(1, 0, "user", "a b c", "2024-01-01 00:00:00"), (1, 1, "user", "d e f", "2024-01-01 01:00:00")], SCHEMA + ", t string").withColumn("ts", F.to_timestamp("t")).drop("t")
    assert signals.boundary_scores(df).first().temporal == 0.5


def test_chunks(spark):
    six = spark.createDataFrame(talk(1, ["x" * 5000] * 6), SCHEMA)
    spans = lambda df: [(r.start_index, r.end_index) for r in df.orderBy("chunk_no").collect()]
    assert spans(S.chunks(six, compat=True)) == [(0, 2)]
    assert spans(S.chunks(six)) == [(0, 2), (3, 5)]
    assert spans(S.chunks(spark.createDataFrame(talk(1, ["x" * 1500] * 20), SCHEMA))) == [(0, 7), (4, 11), (8, 15), (12, 19)]
    assert spans(S.chunks(spark.createDataFrame(talk(1, ["x"] * 3), SCHEMA))) == [(0, 2)]


def test_edits(spark):
    segs = spark.createDataFrame([(1, 1, 0, 3, 1.0), (1, 2, 4, 7, 0.5), (1, 3, 8, 9, 0.4)], "conv_id bigint, seg_no int, start_index int, end_index int, confidence double")
    rows = lambda df: sorted(tuple(r) for r in df.select("seg_no", "start_index", "end_index", "confidence", "method").collect())
    assert rows(S.merged(segs, 1, 2)) == [(1, 0, 3, 1.0, "heuristic"), (2, 4, 9, 0.5, "manual")]
    assert rows(S.merged(segs, 1, 3))[-1] == (3, 8, 9, 0.4, "heuristic")  # there is no next one
    assert rows(S.split(segs, 1, 2, 6)) == [(1, 0, 3, 1.0, "heuristic"), (2, 4, 5, 0.5, "manual"), (3, 6, 7, 0.0, "manual"), (4, 8, 9, 0.4, "heuristic")]
    assert len(rows(S.split(segs, 1, 2, 4))) == 3  # a cut at the first message changes nothing


def test_model_path_and_fallback(spark):
    from strandline.operators.model_segments import checked, reply, segmented
    from strandline.plans.relations import canned

    df = spark.createDataFrame(talk(1, ["q", "a", "q", "a"]) + talk(2, ["q", "a"]), SCHEMA)
    got = {(r.conv_id, r.start_index, r.end_index, r.method) for r in segmented(df, canned).collect()}
    assert got == {(1, 0, 3, "model"), (2, 0, 1, "heuristic")}
    assert reply('x [{"startIndex": 0, "endIndex": 1}] y') == [{"start": 0, "end": 1, "title": "Untitled", "summary": "", "confidence": 0.5}]
    for bad in ("none", "[]", '[{"startIndex": 3, "endIndex": 1}]', '[{"startIndex": 9, "endIndex": 9}]'):
        with pytest.raises(ValueError):
            checked(reply(bad), 5)


def test_plan_has_one_shuffle_of_messages(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", F.col("turn").alias("index"), "role", "text")
    plan = signals.boundary_scores(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan
