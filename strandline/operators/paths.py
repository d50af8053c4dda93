"""Distinct paths for notes: a path that is taken already gets the first free number behind it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut

_END, _NUMBER = "\\.md\\z", "( \\(\\d+\\))+\\z"


def _stem(path: Column) -> Column:
    return F.regexp_replace(path, _END, "")


def _base(path: Column) -> Column:
    """The path without its numbers: only paths of one base can clash."""
    return F.regexp_replace(_stem(path), _NUMBER, "")


def running(df: DataFrame, key: str, order: list[str], value: Column) -> DataFrame:
    """Adds ``total``, the sum of ``value`` over the rows of a key up to each row.

    Rows are dealt in ranges of key and order, so a key with very many rows lies in many tasks; the sums
    of the ranges are added up first, and each row only meets those of its own range."""
    ranged = cut(df.withColumn("__v", value.cast("long")).repartitionByRange(key, *order).withColumn("__range", F.spark_partition_id()))
    before = Window.partitionBy(key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(key, "__range").agg(F.sum("__v").alias("__n")).select(key, "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy(key, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumn("__own", F.sum("__v").over(within)).join(starts, [key, "__range"])
    return summed.withColumn("total", F.col("__start") + F.col("__own")).drop("__v", "__range", "__start", "__own")


def _numbers(paths: DataFrame, taken: DataFrame) -> DataFrame:
    """path, number for the taken forms (1 for the path itself) of the given distinct paths."""
    last = F.regexp_extract(_stem(F.col("path")), " \\(([2-9]|[1-9]\\d{1,17})\\)\\z", 1)
    numbered = F.struct(F.concat(F.regexp_replace(_stem(F.col("path")), " \\(\\d+\\)\\z", ""), F.lit(".md")).alias("path"), F.when(last != "", last).cast("long").alias("number"))
    both = taken.select(F.explode(F.array(F.struct("path", F.lit(1).cast("long").alias("number")), numbered)).alias("x")).select("x.*")
    return both.filter("number is not null").distinct().join(paths, "path", "left_semi")


def resolved(paths: DataFrame, taken: DataFrame) -> DataFrame:
    """ord, final: in order of ``ord`` each path, or its first free form ``name (2).md``, ``name (3).md`` ...

    A base with one path (however many rows have it) needs no walk: its k-th row gets the k-th number
    that is not taken, by running sums.  Bases where several paths meet, such as ``z.md`` and ``z (2).md``,
    are walked in order, a base a task."""
    keyed = cut(paths.withColumn("base", _base(F.col("path"))))
    kinds = keyed.groupBy("base").agg(F.min("path").alias("low"), F.max("path").alias("high"))
    mixed = cut(kinds.filter("low <> high").select("base"))
    plain = running(keyed.join(mixed, "base", "left_anti").select("ord", "path"), "path", ["ord"], F.lit(1)).withColumnRenamed("total", "k")
    hits = cut(_numbers(kinds.filter("low = high").select(F.col("low").alias("path")), taken))
    if hits.isEmpty():
        done = plain.withColumn("number", F.col("k"))
    else:
        # a taken number n with j taken ones up to it has n - j free ones below: it moves all rows beyond them
        free = running(hits, "path", ["number"], F.lit(1)).select("path", (F.col("number") - F.col("total")).alias("at"), F.lit(1).alias("moves"), F.lit(None).cast(paths.schema["ord"].dataType).alias("ord"))
        line = plain.select("path", F.col("k").alias("at"), F.lit(0).alias("moves"), "ord").unionByName(free)
        done = running(line, "path", ["at", "moves"], F.col("moves")).filter("moves = 0").select("ord", "path", (F.col("at") + F.col("total")).alias("number"))
    simple = done.select("ord", F.when(F.col("number") == 1, F.col("path")).otherwise(F.concat(_stem(F.col("path")), F.lit(" ("), F.col("number").cast("string"), F.lit(").md"))).alias("final"))

    def walk(key, mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        used, next_ = set(theirs["path"]), {}
        final = []
        for path in mine["path"]:
            name, stem = path, path.removesuffix(".md")
            n = next_.get(stem, 2)
            while name in used:
                name = f"{stem} ({n}).md"
                n += 1
            if name != path:
                next_[stem] = n
            used.add(name)
            final.append(name)
        return pd.DataFrame({"no": mine["no"], "final": final})

    order = Window.partitionBy("base").orderBy("ord")
    several = cut(keyed.join(mixed, "base", "left_semi").withColumn("no", F.row_number().over(order)))
    theirs = taken.select(_base(F.col("path")).alias("base"), "path").join(mixed, "base", "left_semi")
    walked = several.select("base", "no", "path").groupBy("base").cogroup(theirs.groupBy("base")).applyInPandas(lambda key, a, b: walk(key, a.sort_values("no"), b).assign(base=key[0]), "no int, final string, base string")
    return simple.unionByName(several.join(walked, ["base", "no"]).select("ord", "final"))
