"""Queries of signals, selection, segments and edits over conversation messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..functions.dialect import quoted
from ..operators import segments as S
from ..operators import signals
from .fixtures import MESSAGES_SQL, inline, inline_sql, joined, joined_sql, messages
from .base import read, register

# --- inline conversations: long enough for every preset, English cues, ties


def _talk(conv: int, n: int, words: int, topics: int) -> list[tuple]:
    """n messages of ``words`` words whose vocabulary changes ``topics`` times."""
    openers = ("Let's talk about the plan", "Can you help me with this", "What about the rest", "Now can we go on?", "ok")
    rows = []
    for i in range(n):
        t = i * topics // n
        body = " ".join(f"term{t}x{(i * 7 + k) % 23}" for k in range(words))
        head = openers[(t + i) % len(openers)] if i % 2 == 0 else "## One\n\n## Two\n- a\n- b\n- c\n"
        rows.append((conv, i, "user" if i % 2 == 0 else "assistant", f"{head} {body}"))
    return rows


TALKS = [*_talk(-1, 24, 60, 3), *_talk(-2, 24, 170, 4), *_talk(-3, 12, 60, 6), *_talk(-4, 1, 30, 1), *_talk(-5, 30, 45, 10), (-6, 0, "assistant", "only an answer"), (-6, 1, "assistant", "and another"), *_talk(-7, 16, 140, 2), *_talk(-8, 40, 100, 5)]
TALK_SCHEMA = "conv_id bigint, index int, role string, text string"
ALL_MESSAGES_SQL = f"(SELECT conv_id::BIGINT AS conv_id, \"index\"::INT AS \"index\", role, text FROM {inline_sql(TALKS, 'conv_id, \"index\", role, text')} UNION ALL SELECT * FROM {MESSAGES_SQL})"


def all_messages(spark, sf: str) -> DataFrame:
    return inline(spark, TALKS, TALK_SCHEMA).unionByName(messages(spark, sf))


def scores_sql(msgs: str, weights: dict[str, float]) -> str:
    """WITH-clause that ends in table scores, by joins and not by windows of arrays."""
    total = "0.0::DOUBLE" + "".join(f" + {s} * {weights[s]}::DOUBLE" for s in signals.SIGNALS)
    return f"""
        WITH m AS (SELECT * FROM {msgs}),
        p AS (SELECT m.*, lag(text) OVER w AS prev_text, lag(role) OVER w AS prev_role FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY "index")),
        c AS (SELECT conv_id, "index", {T.transition_sql('text')} AS transition, {T.reintroduction_sql('text')} AS reintroduction, 0.0::DOUBLE AS temporal,
              CASE WHEN prev_role = 'assistant' THEN {T.self_contained_sql('prev_text', 'text')} ELSE 0.0::DOUBLE END AS self_contained
              FROM p WHERE "index" >= 1 AND role = 'user'),
        t AS (SELECT conv_id, "index", unnest({T.content_tokens_sql('text')}) AS term FROM m),
        s AS (SELECT c.conv_id, c."index", t.term, sum(CASE WHEN t."index" < c."index" THEN 1 ELSE 0 END) AS cb, sum(CASE WHEN t."index" >= c."index" THEN 1 ELSE 0 END) AS ca
              FROM c JOIN t ON c.conv_id = t.conv_id AND t."index" BETWEEN c."index" - 4 AND c."index" + 3 GROUP BY ALL),
        g AS (SELECT conv_id, "index", count(*) FILTER (cb > 0) AS nb, count(*) FILTER (ca > 0) AS na, count(*) FILTER (cb > 0 AND ca > 0) AS common, count(*) AS either_,
              sum(cb * ca)::DOUBLE AS dot, sum(cb * cb)::DOUBLE AS bb, sum(ca * ca)::DOUBLE AS aa FROM s GROUP BY ALL),
        x AS (SELECT c.*, CASE WHEN coalesce(nb, 0) < 5 OR coalesce(na, 0) < 5 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - common::DOUBLE / either_::DOUBLE END AS domain,
              CASE WHEN coalesce(nb, 0) = 0 OR coalesce(na, 0) = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - dot / (sqrt(bb) * sqrt(aa)) END AS vocabulary
              FROM c LEFT JOIN g USING (conv_id, "index")),
        scores AS (SELECT conv_id, "index", transition, domain, vocabulary, temporal, self_contained, reintroduction, {total} AS score FROM x)"""


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in names else c for c in df.columns])


_SIX = (*signals.SIGNALS, "score")
_SIX_SQL = ", ".join(f"round({c}, 6) AS {c}" for c in _SIX)
register(
    "boundary_scores",
    lambda spark, sf: rounded(signals.boundary_scores(all_messages(spark, sf)), *_SIX),
    f'{scores_sql(ALL_MESSAGES_SQL, R.CHAT_WEIGHTS)} SELECT conv_id, "index", {_SIX_SQL} FROM scores',
)
register(
    "document_scores",
    lambda spark, sf: rounded(signals.boundary_scores(all_messages(spark, sf), R.DOCUMENT_WEIGHTS), *_SIX).select("conv_id", "index", "score"),
    f'{scores_sql(ALL_MESSAGES_SQL, R.DOCUMENT_WEIGHTS)} SELECT conv_id, "index", round(score, 6) AS score FROM scores',
)
for _name in ("domain", "vocabulary"):
    register(
        f"{_name}_shift",
        lambda spark, sf, n=_name: rounded(signals.boundary_scores(all_messages(spark, sf)).select("conv_id", "index", n), n),
        f'{scores_sql(ALL_MESSAGES_SQL, R.CHAT_WEIGHTS)} SELECT conv_id, "index", round({_name}, 6) AS {_name} FROM scores',
    )
register(
    "self_contained",
    lambda spark, sf: signals.boundary_scores(all_messages(spark, sf)).select("conv_id", "index", "self_contained"),
    f'{scores_sql(ALL_MESSAGES_SQL, R.CHAT_WEIGHTS)} SELECT conv_id, "index", self_contained FROM scores',
)
register(
    "candidates",
    lambda spark, sf: signals.candidates(all_messages(spark, sf)).select("conv_id", "index"),
    f"""SELECT conv_id, "index" FROM {ALL_MESSAGES_SQL} WHERE "index" >= 1 AND role = 'user'""",
)
register(
    "threshold_boundaries",
    lambda spark, sf: _threshold(spark, sf),
    f"""{scores_sql(ALL_MESSAGES_SQL, R.CHAT_WEIGHTS)}, gran AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {v[0]}::DOUBLE)" for k, v in R.GRANULARITY.items())}) v(granularity, threshold))
        SELECT granularity, conv_id, "index" FROM scores, gran WHERE score >= threshold""",
)


def _threshold(spark, sf: str) -> DataFrame:
    scores = signals.boundary_scores(all_messages(spark, sf)).select("conv_id", "index", "score")
    presets = F.array(*[F.struct(F.lit(k).alias("granularity"), F.lit(v[0]).alias("threshold")) for k, v in R.GRANULARITY.items()])
    return scores.select("*", F.inline(presets)).filter("score >= threshold").select("granularity", "conv_id", "index")


register(
    "context_windows",
    lambda spark, sf: signals.candidates(signals.context_windows(messages(spark, sf))).select("conv_id", "index", joined(F.col("before")).alias("before"), joined(F.col("after")).alias("after")),
    f"""WITH m AS (SELECT *, {T.content_tokens_sql('text')} AS toks FROM {MESSAGES_SQL}),
        w AS (SELECT a.conv_id, a."index", {joined_sql('flatten(list(b.toks ORDER BY b."index") FILTER (b."index" < a."index"))')} AS before, {joined_sql('flatten(list(b.toks ORDER BY b."index") FILTER (b."index" >= a."index"))')} AS after
              FROM m a JOIN m b ON a.conv_id = b.conv_id AND b."index" BETWEEN a."index" - 4 AND a."index" + 3 WHERE a."index" >= 1 AND a.role = 'user' GROUP BY ALL)
        SELECT conv_id, "index", coalesce(before, '') AS before, coalesce(after, '') AS after FROM w""",
)
_TERMS_SQL = f"""WITH m AS (SELECT * FROM {MESSAGES_SQL}), t AS (SELECT conv_id, "index" AS j, unnest({T.content_tokens_sql('text')}) AS term FROM m),
        s AS (SELECT m.conv_id, m."index", term, count(*) FILTER (j < m."index") AS cb, count(*) FILTER (j >= m."index") AS ca FROM m JOIN t ON m.conv_id = t.conv_id AND j BETWEEN m."index" - 4 AND m."index" + 3
              WHERE m."index" >= 1 AND m.role = 'user' GROUP BY ALL)"""
register("tf_vectors", lambda spark, sf: signals.term_counts(signals.context_windows(messages(spark, sf))), f'{_TERMS_SQL} SELECT conv_id, "index", term, cb, ca FROM s')
register(
    "domain_tokens",
    lambda spark, sf: signals.candidates(signals.context_windows(messages(spark, sf))).select("conv_id", "index", joined(F.array_sort(F.array_distinct("before"))).alias("before"), joined(F.array_sort(F.array_distinct("after"))).alias("after")),
    f"""{_TERMS_SQL} SELECT conv_id, "index", coalesce({joined_sql('list(term ORDER BY term) FILTER (cb > 0)')}, '') AS before, coalesce({joined_sql('list(term ORDER BY term) FILTER (ca > 0)')}, '') AS after FROM s GROUP BY ALL""",
)
register(
    "temporal_gap",
    lambda spark, sf: _gaps(read(spark, sf, "events")),
    """WITH g AS (SELECT event_id, user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS us FROM events)
       SELECT event_id, user_id, CASE WHEN us / 60000000.0::DOUBLE >= 30 THEN least(1.0::DOUBLE, us / 60000000.0::DOUBLE / 120) ELSE 0.0::DOUBLE END AS gap_score FROM g""",
)


def _gaps(events: DataFrame) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select("event_id", "user_id", F.coalesce(signals.temporal_gap(F.lag("ts").over(w).cast("timestamp"), F.col("ts").cast("timestamp")), F.lit(0.0)).alias("gap_score"))


GAPS = [(1, "2024-01-01 00:00:00", "2024-01-01 00:29:54"), (2, "2024-01-01 00:00:00", "2024-01-01 00:30:00"), (3, "2024-01-01 00:00:00", "2024-01-01 01:00:00"), (4, "2024-01-01 00:00:00", "2024-01-01 02:00:00"), (5, "2024-01-01 00:00:00", "2024-01-01 08:20:00"), (6, "2024-01-01 01:00:00", "2024-01-01 00:00:00"), (7, None, "2024-01-01 00:00:00")]
register(
    "temporal_gap_cases",
    lambda spark, sf: inline(spark, GAPS, "id bigint, a string, b string").select("id", F.coalesce(signals.temporal_gap(F.to_timestamp("a"), F.to_timestamp("b")), F.lit(0.0)).alias("gap_score")),
    f"""WITH g AS (SELECT id, (epoch_us(b::TIMESTAMP) - epoch_us(a::TIMESTAMP)) / 60000000.0::DOUBLE AS m FROM {inline_sql(GAPS, 'id, a, b')})
        SELECT id::BIGINT AS id, CASE WHEN m >= 30 THEN least(1.0::DOUBLE, m / 120) ELSE 0.0::DOUBLE END AS gap_score FROM g""",
)


# --- selection: the oracle walks candidates by recursion


def greedy_sql(msgs: str, preset: str) -> str:
    """scores plus tables z (one row a conversation), r (ranked), first and final (accepted starts with sentinels)."""
    threshold, least_messages, least_words = R.GRANULARITY[preset]
    fold = lambda rows, m, w: f"""  -- one candidate at a time
            SELECT f.conv_id, {rows}.k, CASE WHEN {rows}.b - list_max(list_filter(f.acc, lambda x: x < {rows}.b)) >= {m} AND list_min(list_filter(f.acc, lambda x: x > {rows}.b)) - {rows}.b >= {m}
                AND z.words[{rows}.b + 1] - z.words[list_max(list_filter(f.acc, lambda x: x < {rows}.b)) + 1] >= {w} AND z.words[list_min(list_filter(f.acc, lambda x: x > {rows}.b)) + 1] - z.words[{rows}.b + 1] >= {w}
                THEN list_sort(list_append(f.acc, {rows}.b)) ELSE f.acc END AS acc"""  # noqa: E731
    body = scores_sql(msgs, R.CHAT_WEIGHTS).strip().removeprefix("WITH")
    return f"""
        WITH RECURSIVE {body},
        q AS (SELECT conv_id, "index", sum({T.word_count_sql('text')}) OVER (PARTITION BY conv_id ORDER BY "index") AS upto, role FROM m),
        z AS (SELECT conv_id, count(*)::INT AS n, max(role = 'user') AS has_user, list_prepend(0::HUGEINT, list(upto ORDER BY "index")) AS words FROM q GROUP BY conv_id),
        r AS (SELECT conv_id, "index" AS b, score, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, "index") AS k FROM scores WHERE score >= {threshold}::DOUBLE),
        f AS (SELECT conv_id, 0::BIGINT AS k, [0, n] AS acc FROM z UNION ALL {fold('r', least_messages, least_words)} FROM f JOIN r ON f.conv_id = r.conv_id AND r.k = f.k + 1 JOIN z ON z.conv_id = f.conv_id),
        first AS (SELECT conv_id, arg_max(acc, k) AS acc FROM f GROUP BY conv_id),
        o AS (SELECT first.conv_id, acc, n, (n >= {least_messages * 3} AND (len(acc) = 2 OR len(acc) - 1 < greatest(2, n // 2) / 2.0)) AS again, greatest(2, n // 3) - 1 - (len(acc) - 2) AS room FROM first JOIN z USING (conv_id)),
        rr AS (SELECT s.conv_id, s."index" AS b, row_number() OVER (PARTITION BY s.conv_id ORDER BY s.score DESC, s."index") AS k, o.room FROM scores s JOIN o ON s.conv_id = o.conv_id WHERE again AND NOT list_contains(o.acc, s."index")),
        ff AS (SELECT conv_id, 0::BIGINT AS k, acc FROM o UNION ALL {fold('rr', *R.RELAXED).replace('f.', 'ff.').replace('fff.', 'ff.')} FROM ff JOIN rr ON ff.conv_id = rr.conv_id AND rr.k = ff.k + 1 AND rr.k <= rr.room JOIN z ON z.conv_id = ff.conv_id),
        final AS (SELECT conv_id, arg_max(acc, k) AS acc FROM ff GROUP BY conv_id)"""


def _chosen(spark, sf: str, preset: str) -> DataFrame:
    msgs = all_messages(spark, sf)
    arrays = S.conversation_arrays(msgs, signals.boundary_scores(msgs))
    return S.fallback(S.greedy(arrays, *R.GRANULARITY[preset]), R.GRANULARITY[preset][1])


for _preset in R.GRANULARITY:
    _suffix = "" if _preset == "fine" else f"_{_preset}"
    register(f"greedy_boundaries{_suffix}", lambda spark, sf, p=_preset: _chosen(spark, sf, p).select("conv_id", F.array_join("accepted", ",").alias("accepted")), f"{greedy_sql(ALL_MESSAGES_SQL, _preset)} SELECT conv_id, array_to_string(acc, ',') AS accepted FROM first")
    register(f"fallback_boundaries{_suffix}", lambda spark, sf, p=_preset: _chosen(spark, sf, p).select("conv_id", F.array_join("final", ",").alias("accepted")), f"{greedy_sql(ALL_MESSAGES_SQL, _preset)} SELECT conv_id, array_to_string(acc, ',') AS accepted FROM final")


def segments_sql(preset: str = "fine") -> str:
    return f"""{greedy_sql(ALL_MESSAGES_SQL, preset)},
        cut AS (SELECT z.conv_id, CASE WHEN n < 2 OR NOT has_user THEN [0, n] ELSE acc END AS acc FROM z JOIN final USING (conv_id)),
        e AS (SELECT conv_id, unnest(range(1, len(acc))) AS k, acc FROM cut),
        seg AS (SELECT e.conv_id, k::INT AS seg_no, acc[k]::INT AS start_index, (acc[k + 1] - 1)::INT AS end_index, CASE WHEN acc[k] = 0 THEN 1.0::DOUBLE ELSE coalesce(nullif(s.score, 0), 1.0::DOUBLE) END AS confidence
                FROM e LEFT JOIN scores s ON s.conv_id = e.conv_id AND s."index" = acc[k])"""


for _preset in R.GRANULARITY:
    register(
        "segments" if _preset == "fine" else f"segments_{_preset}",
        lambda spark, sf, p=_preset: rounded(S.segments(all_messages(spark, sf), p), "confidence"),
        f"{segments_sql(_preset)} SELECT conv_id, seg_no, start_index, end_index, round(confidence, 6) AS confidence FROM seg",
    )
ASSIGNED_SQL = f"""{segments_sql()}, am AS (SELECT m.*, seg.seg_no FROM m JOIN seg ON m.conv_id = seg.conv_id AND m."index" BETWEEN seg.start_index AND seg.end_index)"""


def assigned(spark, sf: str) -> DataFrame:
    msgs = all_messages(spark, sf)
    return S.assigned(msgs, S.segments(msgs))


register("assign_segments", lambda spark, sf: assigned(spark, sf).select("conv_id", "index", "seg_no"), f'{ASSIGNED_SQL} SELECT conv_id, "index", seg_no FROM am')
register(
    "segment_sizes",
    lambda spark, sf: assigned(spark, sf).groupBy("conv_id", "seg_no").agg(F.count("*").alias("n_messages"), F.sum(T.word_count(F.col("text"))).alias("n_words")),
    f"{ASSIGNED_SQL} SELECT conv_id, seg_no, count(*) AS n_messages, sum({T.word_count_sql('text')})::BIGINT AS n_words FROM am GROUP BY ALL",
)
register(
    "segment_preview",
    lambda spark, sf: assigned(spark, sf).withColumn("k", F.row_number().over(Window.partitionBy("conv_id", "seg_no").orderBy("index"))).filter("k <= 3").select("conv_id", "seg_no", "index", F.when(F.length("text") > 100, F.concat(F.substring("text", 1, 100), F.lit("..."))).otherwise(F.col("text")).alias("preview")),
    f"""{ASSIGNED_SQL} SELECT conv_id, seg_no, "index", CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS preview FROM am QUALIFY row_number() OVER (PARTITION BY conv_id, seg_no ORDER BY "index") <= 3""",
)

# --- edits on the segments of an inline conversation
_TARGET = -3
register(
    "merge_segments",
    lambda spark, sf: rounded(S.merged(S.segments(all_messages(spark, sf)), _TARGET, 1), "confidence"),
    f"""{segments_sql()} SELECT conv_id, CASE WHEN conv_id = {_TARGET} AND seg_no > 1 THEN seg_no - 1 ELSE seg_no END AS seg_no, min(start_index) AS start_index, max(end_index) AS end_index, round(arg_min(confidence, start_index), 6) AS confidence, CASE WHEN count(*) = 2 THEN 'manual' ELSE 'heuristic' END AS method
        FROM seg GROUP BY 1, 2""",
)
register(
    "split_segment",
    lambda spark, sf: rounded(S.split(S.segments(all_messages(spark, sf)), _TARGET, 1, 1), "confidence"),
    f"""{segments_sql()}, h AS (SELECT *, 'heuristic' AS method FROM seg WHERE NOT (conv_id = {_TARGET} AND seg_no = 1 AND end_index >= 1)
          UNION ALL SELECT conv_id, 1, 0, 0, confidence, 'manual' FROM seg WHERE conv_id = {_TARGET} AND seg_no = 1 AND end_index >= 1 UNION ALL SELECT conv_id, 2, 1, end_index, 0.0, 'manual' FROM seg WHERE conv_id = {_TARGET} AND seg_no = 1 AND end_index >= 1)
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY start_index)::INT AS seg_no, start_index, end_index, round(confidence, 6) AS confidence, method FROM h""",
)
register(
    "rename_segment",
    lambda spark, sf: rounded(S.renamed(S.segments(all_messages(spark, sf)).withColumn("title", F.concat(F.lit("Segment "), F.col("conv_id").cast("string"), F.lit("."), F.col("seg_no").cast("string"))), _TARGET, 1, "Renamed").select("conv_id", "seg_no", "start_index", "confidence", "title"), "confidence"),
    f"{segments_sql()} SELECT conv_id, seg_no, start_index, round(confidence, 6) AS confidence, CASE WHEN conv_id = {_TARGET} AND seg_no = 1 THEN 'Renamed' ELSE 'Segment ' || conv_id || '.' || seg_no END AS title FROM seg",
)

# --- language-model path: chunks, prompts, replies


def chunks_sql(target: int, compat: bool) -> str:
    start = "w.e - 4" if compat else "CASE WHEN w.e - 4 > w.s THEN w.e - 4 ELSE w.e END"
    return f"""WITH RECURSIVE m AS (SELECT *, length(text) AS c FROM {ALL_MESSAGES_SQL}),
        z AS (SELECT conv_id, count(*)::INT AS n, sum(c) AS total FROM m GROUP BY 1),
        e AS (SELECT a.conv_id, a."index" AS s, coalesce(min(b."index") FILTER (b.cum - a.cum + a.c >= {target}) + 1, max(b."index") + 1) AS e
              FROM (SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY "index") AS cum FROM m) a JOIN (SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY "index") AS cum FROM m) b ON a.conv_id = b.conv_id AND b."index" >= a."index" GROUP BY 1, 2),
        w AS (SELECT e.conv_id, 1 AS k, 0 AS s, CASE WHEN total <= {target} THEN n ELSE e END AS e FROM e JOIN z USING (conv_id) WHERE s = 0
              UNION ALL SELECT w.conv_id, w.k + 1, e.s, e.e FROM w JOIN z ON z.conv_id = w.conv_id JOIN e ON e.conv_id = w.conv_id AND e.s = {start} WHERE w.e < z.n AND {start} > w.s)
        SELECT conv_id, k AS chunk_no, s::INT AS start_index, (e - 1)::INT AS end_index FROM w"""


for _suffix, _target, _compat in (("", 12_000, False), ("_small", 1_500, False), ("_compat", 1_500, True)):
    register(f"chunks{_suffix}", lambda spark, sf, t=_target, c=_compat: S.chunks(all_messages(spark, sf), t, 4, c), chunks_sql(_target, _compat))


def llm_prompt(msgs: DataFrame, granularity: str) -> DataFrame:
    line = F.concat(F.lit("["), F.col("index").cast("string"), F.lit("] "), F.col("role"), F.lit(": "), F.replace(F.substring("text", 1, 200), F.lit("\n"), F.lit(" ")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", line.alias("line")))), lambda x: x["line"]), "\n")
    head = R.PROMPT_HEAD.replace("{granularity}", granularity).replace("{hint}", R.GRANULARITY_HINTS[granularity])
    return msgs.groupBy("conv_id").agg(F.concat(F.lit(head), body, F.lit(R.PROMPT_TAIL)).alias("prompt"))


register(
    "llm_prompt",
    lambda spark, sf: llm_prompt(all_messages(spark, sf), "medium"),
    f"""SELECT conv_id, {quoted(R.PROMPT_HEAD.replace('{granularity}', 'medium').replace('{hint}', R.GRANULARITY_HINTS['medium']))} || string_agg('[' || "index" || '] ' || role || ': ' || replace(substr(text, 1, 200), chr(10), ' '), chr(10) ORDER BY "index") || {quoted(R.PROMPT_TAIL)} AS prompt FROM {ALL_MESSAGES_SQL} GROUP BY conv_id""",
)
REPLIES = [(1, 'Sure! [{"startIndex": 0, "endIndex": 3, "title": "A", "summary": "s", "confidence": 0.9}, {"startIndex": 4, "endIndex": 5}] done'), (2, "no array"), (3, '[{"startIndex": 9, "endIndex": 9, "title": "Far"}]'), (4, '[{"startIndex": 3, "endIndex": 1}]'), (5, '[{"startIndex": 0, "endIndex": 1, "title": "X"}, {"startIndex": 0, "endIndex": 4, "title": "Y"}]')]


def parse_replies(replies: DataFrame) -> DataFrame:
    """One row a segment of each reply, with the defaults for what it leaves out."""
    kind = "array<struct<startIndex:int,endIndex:int,title:string,summary:string,confidence:double>>"
    found = F.from_json(F.regexp_extract("reply", "\\[[\\s\\S]*\\]", 0), kind)
    out = replies.select("id", F.posexplode(found).alias("pos", "x"))
    return out.select("id", "pos", F.col("x.startIndex").alias("start_index"), F.col("x.endIndex").alias("end_index"), F.substring(F.coalesce(F.nullif("x.title", F.lit("")), F.lit("Untitled")), 1, 50).alias("title"), F.coalesce("x.summary", F.lit("")).alias("summary"), F.coalesce("x.confidence", F.lit(0.5)).alias("confidence"))


def deduplicated(parsed: DataFrame, n: int) -> DataFrame:
    """First segment of each start within the conversation, by start."""
    w = Window.partitionBy("id", "start_index").orderBy("pos")
    return parsed.filter((F.col("start_index") >= 0) & (F.col("end_index") < n)).withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k")


_REPLY_SQL = f"""WITH a AS (SELECT id::BIGINT AS id, json_extract(regexp_extract(reply, '\\[(?s:.*)\\]', 0), '$[*]') AS js FROM {inline_sql(REPLIES, 'id, reply')} WHERE regexp_matches(reply, '\\[(?s:.*)\\]')),
    x AS (SELECT id, unnest(js) AS j, unnest(range(0, len(js))) AS pos FROM a),
    p AS (SELECT id, pos::INT AS pos, (j->>'startIndex')::INT AS start_index, (j->>'endIndex')::INT AS end_index, substr(coalesce(nullif(j->>'title', ''), 'Untitled'), 1, 50) AS title, coalesce(j->>'summary', '') AS summary, coalesce((j->>'confidence')::DOUBLE, 0.5) AS confidence FROM x)"""
register("llm_reply", lambda spark, sf: parse_replies(inline(spark, REPLIES, "id bigint, reply string")), f"{_REPLY_SQL} SELECT * FROM p")
register(
    "llm_dedup",
    lambda spark, sf: deduplicated(parse_replies(inline(spark, REPLIES, "id bigint, reply string")), 8),
    f"{_REPLY_SQL} SELECT * FROM p WHERE start_index >= 0 AND end_index < 8 QUALIFY row_number() OVER (PARTITION BY id, start_index ORDER BY pos) = 1",
)
register(
    "llm_validate",
    lambda spark, sf: _validated(parse_replies(inline(spark, REPLIES, "id bigint, reply string")), 8),
    f"{_REPLY_SQL} SELECT id, bool_and(start_index BETWEEN 0 AND 7 AND end_index BETWEEN 0 AND 7 AND start_index <= end_index) AS valid FROM p GROUP BY id",
)


def _validated(parsed: DataFrame, n: int) -> DataFrame:
    """Replies are taken whole or not at all."""
    ok = F.col("start_index").between(0, n - 1) & F.col("end_index").between(0, n - 1) & (F.col("start_index") <= F.col("end_index"))
    return parsed.groupBy("id").agg(F.min(ok).alias("valid"))


# --- sessions by the same half-hour rule, and the optional model path with a canned model
def _sessions(spark, sf: str) -> DataFrame:
    from ..streaming.sessions import sessions

    return sessions(read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))).select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n_events")


register(
    "sessions",
    _sessions,
    """WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 1800000000 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
        SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n_events FROM s GROUP BY user_id, k""",
)


def canned(prompt: str) -> str:
    """Stands for a model: one segment from the first to the last message it is shown."""
    import re

    shown = re.findall(r"^\[(\d+)\] (?:user|assistant|system):", prompt, re.M)
    return "" if len(shown) < 3 else f'Here: [{{"startIndex": {shown[0]}, "endIndex": {shown[-1]}, "title": "All", "confidence": 0.7}}]'


def _model(spark, sf: str) -> DataFrame:
    from ..operators.model_segments import segmented

    return segmented(all_messages(spark, sf), canned).select("conv_id", "seg_no", "start_index", "end_index", "method")


register(
    "llm_segments",
    _model,
    f"""WITH k AS MATERIALIZED ({chunks_sql(12_000, False)}), h AS MATERIALIZED ({segments_sql('medium')} SELECT conv_id, seg_no, start_index, end_index FROM seg),
        c AS (SELECT k.conv_id, k.chunk_no, min(m."index") AS s, max(m."index") AS e, count(m."index") AS n FROM k LEFT JOIN {ALL_MESSAGES_SQL} m ON m.conv_id = k.conv_id AND m."index" BETWEEN k.start_index AND k.end_index AND m.role IN ('user', 'assistant', 'system') GROUP BY ALL),
        bad AS (SELECT conv_id FROM c GROUP BY conv_id HAVING min(n) < 3),
        d AS (SELECT conv_id, s, arg_min(e, chunk_no) AS e FROM c WHERE conv_id NOT IN (SELECT conv_id FROM bad) GROUP BY conv_id, s)
        SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY s))::INT AS seg_no, s::INT AS start_index, e::INT AS end_index, 'model' AS method FROM d
        UNION ALL SELECT conv_id, seg_no, start_index, end_index, 'heuristic' FROM h WHERE conv_id IN (SELECT conv_id FROM bad)""",
)
