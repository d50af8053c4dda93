"""Topic-boundary signals of messages (conv_id, index, role, text[, ts]).

All of it runs in one shuffle by conversation: the windows around each message, the explosion
of their terms and both aggregations keep that partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T

def by_turn() -> WindowSpec:
    return Window.partitionBy("conv_id").orderBy("index")


def temporal_gap(before: Column, after: Column) -> Column:
    """0 below half an hour, then growing to 1 at two hours."""
    minutes = (F.unix_micros(after) - F.unix_micros(before)) / F.lit(60_000_000.0)
    return F.when(minutes >= 30, F.least(F.lit(1.0), minutes / 120.0)).otherwise(0.0)


def context_windows(messages: DataFrame, size: int = R.WINDOW) -> DataFrame:
    """Adds toks, before and after (terms of the messages around each start), prev_text, prev_role."""
    out = messages.withColumn("toks", T.content_tokens(F.col("text")))
    out = out.withColumn("before", F.flatten(F.collect_list("toks").over(by_turn().rowsBetween(-size, -1))))
    out = out.withColumn("after", F.flatten(F.collect_list("toks").over(by_turn().rowsBetween(0, size - 1))))
    for c in ("text", "role", "ts"):
        if c in messages.columns:
            out = out.withColumn(f"prev_{c}", F.lag(c).over(by_turn()))
    return out


def candidates(windows: DataFrame) -> DataFrame:
    return windows.filter((F.col("index") >= 1) & (F.col("role") == "user"))


def term_counts(windows: DataFrame, *keep: str) -> DataFrame:
    """One row a candidate and term with its counts before (cb) and after (ca)."""
    both = F.concat(
        F.transform("before", lambda t: F.struct(t.alias("term"), F.lit(1).alias("b"), F.lit(0).alias("a"))),
        F.transform("after", lambda t: F.struct(t.alias("term"), F.lit(0).alias("b"), F.lit(1).alias("a"))),
    )
    rows = candidates(windows).select("conv_id", "index", *keep, F.explode_outer(both).alias("x"))
    return rows.groupBy("conv_id", "index", *keep, F.col("x.term").alias("term")).agg(F.sum(F.coalesce("x.b", F.lit(0))).alias("cb"), F.sum(F.coalesce("x.a", F.lit(0))).alias("ca"))


def shifts(terms: DataFrame, *keep: str) -> DataFrame:
    """domain (distance of term sets) and vocabulary (1 - cosine of counts) of each candidate."""
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    sums = terms.groupBy("conv_id", "index", *keep).agg(
        one(F.col("cb") > 0).alias("nb"),
        one(F.col("ca") > 0).alias("na"),
        one((F.col("cb") > 0) & (F.col("ca") > 0)).alias("common"),
        F.sum(F.col("cb") * F.col("ca")).alias("dot"),
        F.sum(F.col("cb") * F.col("cb")).alias("bb"),
        F.sum(F.col("ca") * F.col("ca")).alias("aa"),
    )
    either = F.col("nb") + F.col("na") - F.col("common")
    domain = F.when((F.col("nb") < 5) | (F.col("na") < 5), 0.0).otherwise(1.0 - F.col("common") / either)
    vocabulary = F.when((F.col("nb") == 0) | (F.col("na") == 0), 0.0).otherwise(1.0 - F.col("dot") / (F.sqrt("bb") * F.sqrt("aa")))
    return sums.withColumn("domain", domain).withColumn("vocabulary", vocabulary)


SIGNALS = ("transition", "domain", "vocabulary", "temporal", "self_contained", "reintroduction")


def boundary_scores(messages: DataFrame, weights: dict[str, float] | None = None, window: int = R.WINDOW) -> DataFrame:
    """conv_id, index, the six signals and score of each candidate; the sum has a fixed order.

    Without ``weights`` a row whose ``content_type`` is document is scored by the weights of documents."""
    typed = weights is None and "content_type" in messages.columns
    w = context_windows(messages, window)
    answered = F.col("prev_role") == "assistant"
    w = w.withColumn("transition", T.transition(F.col("text"))).withColumn("reintroduction", T.reintroduction(F.col("text")))
    w = w.withColumn("self_contained", F.when(answered, T.self_contained(F.col("prev_text"), F.col("text"))).otherwise(0.0))
    w = w.withColumn("temporal", F.coalesce(temporal_gap(F.col("prev_ts"), F.col("ts")), F.lit(0.0)) if "ts" in messages.columns else F.lit(0.0))
    kept = ("transition", "reintroduction", "self_contained", "temporal", *(["content_type"] if typed else []))
    out = shifts(term_counts(w, *kept), *kept)

    def total(by: dict[str, float]) -> Column:
        score = F.lit(0.0)
        for s in SIGNALS:
            score = score + F.col(s) * F.lit(by[s])
        return score

    score = total(weights or R.CHAT_WEIGHTS)
    if typed:
        score = F.when(F.coalesce(F.col("content_type") == "document", F.lit(False)), total(R.DOCUMENT_WEIGHTS)).otherwise(score)
    return out.select("conv_id", "index", *SIGNALS, score.alias("score"))
