"""Mixing sources to target weights by systematic sampling.

Every source gets a target number of words: the whole volume shared by weight, no source above
``most`` times its own size, the excess shared again by weight.  Within a source the expected
copies of its documents (target / size of the source) are summed in a fixed order, one random
offset is added, and a document is emitted once for each integer boundary its stretch crosses.
Documents stand in order of size, so the words taken stay near the target.

Only ids, sizes and sources take part in the ranking.  The order within a source is made of
chunks (by a digest of the id) whose row counts are summed first, so a source with a third of
all rows is ranked in many tasks.  The offset is a digest of source and seed: reruns agree.

A null or empty text has 0 words; a null source is a source of its own, the last.  Very long texts count
whole and are taken like others.  Documents of equal size (ties) stand in order of id; rows with equal
ids and sizes may share their copies between them in any order.  Extra columns are kept, whatever their
names.  A source without words has target 0 and nothing is taken from it.  An empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit(text: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of a digest."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 3.0) -> DataFrame:
    """Adds ``weight`` and ``target`` to the one row a source (source, source_size).

    The level L with sum(min(most * size, L * weight)) = total is found by prefix sums over the
    sources in order of most * size / weight: those before the first that stays below its
    bound are at their bound.  Holding one more at its bound would only lower the level, so
    it is the largest of the levels that agree with their own source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    out = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))
    every = Window.partitionBy()
    by_bound = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_bound.rowsBetween(Window.unboundedPreceding, -1)
    bound = F.lit(float(most)) * F.col("source_size")
    out = out.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum(bound).over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    out = out.withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= bound, F.col("level"))).over(every))
    return out.withColumn("target", F.coalesce(F.least(bound, F.col("level") * F.col("weight")), F.lit(0.0))).drop("level")


def planned(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size: Column | None = None, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 3.0, seed: str = "mix", chunk_rows: int = 2_000, broadcast_sources: int = 10_000) -> DataFrame:
    """Each row of ``df`` as the struct ``row``, with size, source_size, target and copies.

    ``size`` replaces the word count of ``text_col``."""
    rows = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), df[id_col].alias("id"), df[source_col].alias("source"), F.coalesce(F.concat(F.lit("s"), df[source_col]), F.lit("n")).alias("name"), (words(df[text_col]) if size is None else size).alias("size"))
    sums = rows.groupBy("source", "name").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    # chunks have about the same number of rows whatever the table's size, so no task sorts more than some of them
    plan = targets(sums, weights, most).withColumn("chunks", F.ceil(F.col("n_rows") / chunk_rows))
    plan = plan.select("name", "source_size", "target", "chunks")
    # few sources, as counted here, meet the rows by broadcast; many by a shuffle, which AQE splits where skewed
    few = rows.select("name").distinct().limit(broadcast_sources + 1).count() <= broadcast_sources
    keyed = rows.drop("source").join(F.broadcast(plan) if few else plan, "name")
    keyed = keyed.withColumn("chunk", F.floor(unit(F.coalesce(F.col("id").cast("string"), F.lit(""))) * F.col("chunks")))
    counts = keyed.groupBy("name", "chunk").agg(F.count("*").alias("n"))
    line = Window.partitionBy("name").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("name", "chunk", F.coalesce(F.sum("n").over(line), F.lit(0)).alias("start"))
    within = Window.partitionBy("name", "chunk").orderBy(F.col("size").desc(), F.col("id"))
    # the rows are ranked in their chunks before they meet the starts: one shuffle of them whatever the join
    keyed = keyed.withColumn("place", F.row_number().over(within)).join(starts, ["name", "chunk"])
    rank = F.col("start") + F.col("place")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = unit(F.concat(F.col("name"), F.lit(f"|{seed}")))
    copies = F.floor(offset + rank * each) - F.floor(offset + (rank - 1) * each)
    return keyed.select("row", "size", "source_size", "target", F.least(copies, F.lit(int(most))).cast("long").alias("copies"))


def mixed(df: DataFrame, **options) -> DataFrame:
    """The rows of ``df``, each as often as the mix takes it."""
    out = planned(df, **options).filter("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")
