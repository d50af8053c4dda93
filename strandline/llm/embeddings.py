"""Near-duplicate vectors by collision-counting projections.

Vectors of one label are scaled to length 1 and projected on the axes of a random orthonormal
basis.  Two of them link when their cosine is ``least`` or more, that is when the squared
distance of the scaled vectors is at most 2 - 2 * least.  The squared differences of the
projections add up to no more than that, so fewer than (2 - 2 * least) / width**2 of the
projections can differ by more than ``width``: a count of window collisions that every linked
pair reaches.  So the threshold on the count is calibrated to lose no pair at all, and pairs that
reach it are verified by their cosine in double precision.

Vectors are first scaled by powers of two, exactly, so magnitudes neither overflow nor vanish.

Each projection is sorted and every query's window is found by binary search in it; collisions
are counted for blocks of queries against blocks of vectors.  The first projections decide for
nearly all pairs; only those that may still reach the count meet the others.

Equal vectors of a label form a class that takes part once, with its number of rows.  Classes of a
label are dealt into blocks of about ``block`` and each pair of blocks is a task, so a label with a
third of all rows is spread; pairs never become rows: a task returns link counts and a spanning
forest.

Vectors that are null, zero or hold null or non-finite components, and rows with a null label,
link with nothing: n_links 0, component their own id, kept.  Vectors link only at equal
dimension.  A null id is its own class without links.  Rows with equal ids are one vertex.  Links are
symmetric and a component is named by its least id, so ties have no effect.  A block holds ``block`` vectors of
any dimension, or as many as ``block_bytes`` allow of very long ones.  An empty table gives an empty
result.  Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .graph import components


@lru_cache(maxsize=8)
def basis(dim: int, seed: int = 3) -> np.ndarray:
    """Orthonormal directions as columns."""
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows multiplied by powers of two so that their largest component lies between 0.5 and 1."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def windows(queries: np.ndarray, values: np.ndarray, width: float) -> np.ndarray:
    """Which values lie in the window around each query, by one sort and two searches."""
    order = np.argsort(values, kind="stable")
    line = values[order]
    step = np.zeros((len(queries), len(values) + 1), dtype=np.int8)
    at = np.arange(len(queries))
    np.add.at(step, (at, np.searchsorted(line, queries - width, "left")), 1)
    np.add.at(step, (at, np.searchsorted(line, queries + width, "right")), -1)
    hit = np.cumsum(step[:, :-1], axis=1, dtype=np.int8)
    rank = np.empty(len(values), dtype=np.int64)
    rank[order] = np.arange(len(values))
    return hit[:, rank]


def linked(x: np.ndarray, y: np.ndarray, least: float, width: float = 0.1, first: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of x and y whose cosine is ``least`` or more; rows have ordinary magnitudes."""
    dim = x.shape[1]
    nx, ny = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
    turn = basis(dim)
    px, py = (x / nx[:, None]) @ turn, (y / ny[:, None]) @ turn
    reach = 2 - 2 * least + 1e-9
    wide = max(width, float(np.sqrt(reach / max(1, dim // 4))))
    misses = int(reach / (wide * wide))
    first = min(first, dim)
    count = np.zeros((len(x), len(y)), dtype=np.int8)
    for j in range(first):
        count += windows(px[:, j], py[:, j], wide)
    a, b = np.nonzero(count >= first - misses)
    seen = count[a, b].astype(np.int64)
    for j in range(first, dim):
        if not len(a):
            break
        seen += np.abs(px[a, j] - py[b, j]) <= wide
        keep = seen >= j + 1 - misses
        a, b, seen = a[keep], b[keep], seen[keep]
    out_a, out_b = [], []
    for i in range(0, len(a), 200_000):
        p, q = a[i : i + 200_000], b[i : i + 200_000]
        ok = np.einsum("ij,ij->i", x[p], y[q]) / (nx[p] * ny[q]) >= least
        out_a.append(p[ok])
        out_b.append(q[ok])
    return np.concatenate(out_a or [a]), np.concatenate(out_b or [b])


def joined(ids: np.ndarray, sizes: np.ndarray, x: np.ndarray, blocks: np.ndarray, low: int, high: int, least: float, step: int = 512) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links of block ``low`` with block ``high`` (or within one): rows linked to each vector, and
    a forest over the links."""
    mine, other = np.flatnonzero(blocks == low), np.flatnonzero(blocks == high)
    links = np.zeros(len(ids), dtype=np.int64)
    parent = np.arange(len(ids))
    forest = []
    for i in range(0, len(mine), step):
        q = mine[i : i + step]
        against = other if low != high else mine[i:]
        a, b = linked(x[q], x[against], least)
        p, r = q[a], against[b]
        if low == high:
            keep = p < r
            p, r = p[keep], r[keep]
        np.add.at(links, p, sizes[r])
        np.add.at(links, r, sizes[p])
        for u, v in zip(p, r):
            if parent[u] != parent[v]:
                forest.append((int(u), int(v)))
                parent[parent == max(parent[u], parent[v])] = min(parent[u], parent[v])
    return links, forest


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.98, block: int = 2_048, block_bytes: int = 32 << 20) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    rows = df.select(df[id_col].cast("long").alias("id"), df[vector_col].cast("array<double>").alias("v"), df[label_col].cast("string").alias("label"))
    bad = F.coalesce(F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))), F.lit(True))
    fit = F.col("label").isNotNull() & F.col("id").isNotNull() & ~bad & F.exists("v", lambda c: c != 0)
    keyed = rows.withColumn("fit", F.coalesce(fit, F.lit(False)))
    good = keyed.filter("fit").select("id", "label", "v", F.hash("v").alias("h"))
    classes = written(good.groupBy("label", "h", "v").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    sizes = classes.groupBy("label", F.size("v").alias("dim")).agg(F.count("*").alias("n")).select(F.col("label").alias("l"), F.col("dim").alias("d"), F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("n") * 8 * F.col("dim") / block_bytes)).cast("int").alias("blocks"))
    placed = classes.join(sizes, (F.col("label") == F.col("l")) & (F.size("v") == F.col("d")))
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    at = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, own).alias("low"), F.greatest(k, own).alias("high")))
    dealt = placed.select("rep", "copies", "v", "label", "d", own.alias("own"), F.explode(at).alias("at")).withColumn("task", F.xxhash64("label", "d", "at.low", "at.high"))

    def run(table: pa.Table) -> pa.Table:
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        order = np.argsort(table.column("rep").to_numpy())
        ids, copies, own_ = (table.column(c).to_numpy()[order] for c in ("rep", "copies", "own"))
        x = scaled(np.concatenate([c.flatten().to_numpy() for c in table.column("v").chunks]).reshape(len(ids), -1)[order])
        links, forest = joined(ids, copies, x, own_, low, high, least)
        some = np.flatnonzero(links)
        a = np.concatenate([ids[some], ids[[u for u, _ in forest]]]) if forest else ids[some]
        b = np.concatenate([ids[some], ids[[v for _, v in forest]]]) if forest else ids[some]
        n = np.concatenate([links[some], np.zeros(len(forest), dtype=np.int64)])
        return pa.table({"a": a.astype(np.int64), "b": b.astype(np.int64), "n": n})

    found = written(dealt.select("task", "rep", "copies", "v", "own", "at.low", "at.high").groupBy("task").applyInArrow(run, "a bigint, b bigint, n bigint"))
    counts = found.filter("n > 0").groupBy("a").agg(F.sum("n").alias("n"))
    roots = components(found.filter("n = 0").select("a", "b"))
    named = classes.join(counts, classes.rep == counts.a, "left").join(roots, classes.rep == roots.node, "left")
    named = named.filter("copies > 1 or n is not null").select(F.col("label").alias("kl"), F.col("h").alias("kh"), F.col("v").alias("kv"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    all_ = keyed.withColumn("h", F.when(F.col("fit"), F.hash("v")))
    out = all_.join(named, F.col("fit") & (F.col("label") == F.col("kl")) & (F.col("h") == F.col("kh")) & (F.col("v") == F.col("kv")), "left")
    kind = df.schema[id_col].dataType
    return out.select(F.col("id").cast(kind).alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component", "id").cast(kind).alias("component_id"), F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(True)).alias("kept"))
