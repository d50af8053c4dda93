"""Selection of boundaries under size minima, segments, and edits of segments.

A conversation's candidates are taken in order of score, and each must leave two halves that meet the
minima.  That order is sequential, so it is a function over one conversation's arrays, mapped over Arrow
batches: accepted starts are kept sorted and found by bisection, prefix sums make a size check constant work.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructType

from ..functions import rules as R
from ..functions import text as T
from . import signals


@F.pandas_udf(ArrayType(IntegerType()))
def _accept(order: pd.Series, start: pd.Series, words: pd.Series, least_messages: pd.Series, least_words: pd.Series) -> pd.Series:
    """The sorted starts accepted from ``order`` on top of ``start``, which has 0 and the end as sentinels.

    Accepted segments meet the minima already, so only the two halves of a cut are checked."""

    def one(order, start, words, least_messages, least_words) -> list[int]:
        taken = [int(x) for x in start]
        for b in map(int, order):
            at = bisect_left(taken, b)
            if at == 0 or at == len(taken) or taken[at] == b:
                continue
            low, high = taken[at - 1], taken[at]
            if min(b - low, high - b) >= least_messages and words[b] - words[low] >= least_words and words[high] - words[b] >= least_words:
                insort(taken, b)
        return taken

    return pd.Series([one(*x) for x in zip(order, start, words, least_messages, least_words)])


@F.pandas_udf(ArrayType(DoubleType()))
def _confidences(cuts: pd.Series, index: pd.Series, score: pd.Series) -> pd.Series:
    """The score at each start of a segment; 1 at the first and where it is 0 or missing."""

    def one(cuts, index, score) -> list[float]:
        known = dict(zip(index, score))
        return [1.0 if c == 0 else float(known.get(c) or 1.0) for c in cuts[:-1]]

    return pd.Series([one(*x) for x in zip(cuts, index, score)])


def conversation_arrays(messages: DataFrame, scores: DataFrame) -> DataFrame:
    """Per conversation: n, words (prefix sums from 0), has_user and cands (best first).  Messages may have
    their ``n_words``."""
    n_words = F.col("n_words") if "n_words" in messages.columns else T.word_count(F.col("text"))
    upto = F.sum(n_words).over(signals.by_turn().rowsBetween(Window.unboundedPreceding, 0))
    counted = messages.select("conv_id", "index", "role", upto.cast("int").alias("upto")).groupBy("conv_id").agg(
        F.count("*").cast("int").alias("n"),
        F.max(F.col("role") == "user").alias("has_user"),
        F.array_sort(F.collect_list(F.struct("index", "upto"))).alias("sizes"),
    )
    prefix = F.concat(F.array(F.lit(0)), F.transform("sizes", lambda x: x["upto"]))
    ranked = scores.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), F.col("index").cast("int").alias("index"), "score"))).alias("cands"))
    return counted.withColumn("words", prefix).drop("sizes").join(ranked, "conv_id", "left").withColumn("cands", F.coalesce("cands", F.array().cast("array<struct<less:double,index:int,score:double>>")))


def greedy(arrays: DataFrame, threshold: float, least_messages: int, least_words: int) -> DataFrame:
    """Adds accepted: the starts that the first pass takes, with sentinels 0 and n."""
    good = F.transform(F.filter("cands", lambda c: c["score"] >= threshold), lambda c: c["index"])
    return arrays.withColumn("accepted", _accept(good, F.array(F.lit(0), F.col("n")), F.col("words"), F.lit(least_messages), F.lit(least_words)))


def fallback(chosen: DataFrame, least_messages: int) -> DataFrame:
    """Adds final: with relaxed minima where a long conversation came out under-segmented."""
    n, taken = F.col("n"), F.size("accepted") - 2
    long_ = n >= least_messages * 3
    expected = F.greatest(F.lit(2), F.floor(n / 2))
    room = F.greatest(F.lit(2), F.floor(n / 3)) - 1 - taken
    rest = F.array_except(F.transform("cands", lambda c: c["index"]), F.col("accepted"))
    again = long_ & ((taken == 0) | (taken + 1 < expected / 2))
    some = F.when(again, F.slice(rest, F.lit(1), F.greatest(room, F.lit(0)).cast("int"))).otherwise(F.array().cast("array<int>"))
    return chosen.withColumn("final", _accept(some, F.col("accepted"), F.col("words"), *map(F.lit, R.RELAXED)))


def segments(messages: DataFrame, granularity: str = "fine", weights: dict[str, float] | None = None) -> DataFrame:
    """conv_id, seg_no (from 1), start_index, end_index, confidence.  Messages may have ``scored``: whether
    their conversation may have candidates."""
    threshold, least_messages, least_words = R.GRANULARITY[granularity]
    # a conversation without candidates (most documents) has no terms to count, and its texts stay where they are
    if "scored" in messages.columns:
        several = messages.filter("scored")
    else:
        several = messages.join(signals.candidates(messages).select("conv_id").distinct(), "conv_id", "left_semi")
    arrays = conversation_arrays(messages, signals.boundary_scores(several, weights))
    out = fallback(greedy(arrays, threshold, least_messages, least_words), least_messages)
    cuts = F.when((F.col("n") < 2) | ~F.col("has_user"), F.array(F.lit(0), F.col("n"))).otherwise(F.col("final"))
    out = out.withColumn("cuts", cuts)
    known = _confidences("cuts", F.transform("cands", lambda c: c["index"]), F.transform("cands", lambda c: c["score"]))
    parts = F.arrays_zip(F.slice("cuts", F.lit(1), F.size("cuts") - 1).alias("a"), F.slice("cuts", F.lit(2), F.size("cuts") - 1).alias("b"), known.alias("c"))
    out = out.select("conv_id", F.posexplode(parts).alias("pos", "x"))
    return out.select("conv_id", (F.col("pos") + 1).alias("seg_no"), F.col("x.a").alias("start_index"), (F.col("x.b") - 1).alias("end_index"), F.col("x.c").alias("confidence"))


def assigned(messages: DataFrame, segs: DataFrame, deal: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """Messages with their seg_no: starts go before their messages as rows of their own and a running sum
    numbers them, so texts are shuffled once, by conversation (or dealt by ``deal``, by conversation too)."""
    starts = segs.select("conv_id", F.col("start_index").cast(messages.schema["index"].dataType).alias("index"), F.lit(1).alias("flag"))
    both = deal(messages.withColumn("flag", F.lit(0)).unionByName(starts, allowMissingColumns=True))
    order = Window.partitionBy("conv_id").orderBy("index", F.col("flag").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("seg_no", F.sum("flag").over(order).cast("int")).filter("flag = 0").drop("flag")


# --- edits: each returns a new table


def merged(segs: DataFrame, conv_id: int, first: int) -> DataFrame:
    """Joins segment ``first`` with the next one; it keeps the first's confidence and becomes manual."""
    hit = (F.col("conv_id") == conv_id) & F.col("seg_no").isin(first, first + 1)
    both = segs.filter(hit).groupBy("conv_id").agg(F.min("start_index").alias("start_index"), F.max("end_index").alias("end_index"), F.min_by("confidence", "seg_no").alias("confidence"), F.count("*").alias("k"))
    both = both.filter("k = 2").select("conv_id", F.lit(first).alias("seg_no"), "start_index", "end_index", "confidence", F.lit("manual").alias("method"))
    rest = segs.join(both.select("conv_id", F.lit(True).alias("did")), "conv_id", "left")
    kept = rest.filter(F.col("did").isNull() | ~F.col("seg_no").isin(first, first + 1))
    number = F.when(F.col("did").isNotNull() & (F.col("seg_no") > first), F.col("seg_no") - 1).otherwise(F.col("seg_no"))
    return kept.select("conv_id", number.alias("seg_no"), "start_index", "end_index", "confidence", F.lit("heuristic").alias("method")).unionByName(both)


def split(segs: DataFrame, conv_id: int, seg_no: int, at: int) -> DataFrame:
    """Cuts a segment before message ``at``; the second half has confidence 0."""
    hit = (F.col("conv_id") == conv_id) & (F.col("seg_no") == seg_no) & (F.lit(at) > F.col("start_index")) & (F.lit(at) <= F.col("end_index"))
    halves = F.when(
        hit,
        F.array(
            F.struct(F.col("seg_no"), F.col("start_index"), F.lit(at - 1).alias("end_index"), F.col("confidence"), F.lit("manual").alias("method")),
            F.struct((F.col("seg_no") + 1).alias("seg_no"), F.lit(at).alias("start_index"), F.col("end_index"), F.lit(0.0).alias("confidence"), F.lit("manual").alias("method")),
        ),
    ).otherwise(F.array(F.struct(F.col("seg_no"), F.col("start_index"), F.col("end_index"), F.col("confidence"), F.lit("heuristic").alias("method"))))
    out = segs.select("conv_id", F.explode(halves).alias("s")).select("conv_id", "s.*")
    order = Window.partitionBy("conv_id").orderBy("start_index")
    return out.withColumn("seg_no", F.row_number().over(order))


def renamed(segs: DataFrame, conv_id: int, seg_no: int, title: str) -> DataFrame:
    return segs.withColumn("title", F.when((F.col("conv_id") == conv_id) & (F.col("seg_no") == seg_no), F.lit(title)).otherwise(F.col("title")))


# --- chunks of a conversation for a language model


@F.pandas_udf(ArrayType(StructType().add("s", IntegerType()).add("e", IntegerType())))
def _walk(lengths: pd.Series, target: pd.Series, overlap: pd.Series, compat: pd.Series) -> pd.Series:
    """Starts and ends of the chunks of messages with the given numbers of letters."""

    def one(lengths, target, overlap, compat) -> list[tuple[int, int]]:
        upto, n = np.concatenate([[0], np.cumsum(np.asarray(lengths, dtype=np.int64))]), len(lengths)
        if upto[-1] <= target:
            return [(0, n)]
        out, start, last = [], 0, -1
        while start > last and (not out or out[-1][1] < n):
            end = min(n, max(start + 1, int(np.searchsorted(upto, upto[start] + target))))
            out.append((start, end))
            last, start = start, end - overlap
            if start <= last and not compat:
                start = end
        return out

    return pd.Series([one(*x) for x in zip(lengths, target, overlap, compat)])


def chunks(messages: DataFrame, target: int = 12_000, overlap: int = 4, compat: bool = False) -> DataFrame:
    """conv_id, chunk_no, start_index, end_index: runs of about ``target`` letters that overlap.

    A chunk of no more than ``overlap`` messages would end the walk and lose the rest
    (``compat=True`` keeps that); otherwise the walk goes on behind it."""
    sizes = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("index", F.length("text").alias("c")))).alias("m"))
    walk = _walk(F.transform("m", lambda x: x["c"]), F.lit(target), F.lit(overlap), F.lit(compat))
    return sizes.select("conv_id", F.posexplode(walk).alias("k", "x")).select("conv_id", (F.col("k") + 1).alias("chunk_no"), F.col("x.s").alias("start_index"), (F.col("x.e") - 1).alias("end_index"))
