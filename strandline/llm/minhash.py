"""Near-duplicate documents by circulant MinHash, with exact Jaccard verification.

Signatures: a first permutation (a 64-bit mixer, cut to ``UNIVERSE`` places) scatters the
shingles; a second permutation of the places, shifted circularly by k, gives coordinate k.
So one table of the second permutation serves all coordinates, and the values a shingle gives
to all of them are one contiguous stretch of it.  Coordinates are banded; documents that
share a band are candidates.

1. one pass makes set size, set digest and bands of every document;
2. documents with equal sets form a class; only its least id goes on;
3. within a band bucket every document is tied to the least id (reduced inside each batch first);
   the sets of tied documents are made once, and every tie is verified exactly on them: linear in the
   size of a bucket.  The verified links give the first components;
4. buckets of three or more that still hold several components are searched (the pair in a bucket of
   two is a tie): all their pairs of different components are verified.  Buckets that share documents
   go together, so a set travels once, unless they chain to more than ``most_chunks`` chunks; then each
   bucket goes alone and a pair that shares several bands is verified in the first of them;
5. the links between components join these to the result.

No task gets more than ``chunk`` documents or ``chunk_bytes`` of sets of one bucket against one document, or two
such chunks against each other; larger buckets are dealt to several tasks.  A pair is never a row: a task
emits the links it needs.

Shingles are words as in ``shingles``.  A null or empty text, or one without words, has an empty
set and links with nothing.  A null id links with nothing and is kept.  Rows with equal ids count
as one document whose links are joined.  Very long texts only make longer sets.  Ties have no
effect: links are symmetric and a component is named by its least id.  An empty table gives an
empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import built, held as may_hold
from .common import U64, byte_list, dropped, mix64, slices, written
from .graph import components
from .shingles import forget, overlap, shingle_set

UNIVERSE_BITS = 20
ROWS, BANDS = 5, 28  # a pair of similarity 0.8 shares no band in 1.3e-5 of all cases, of 0.85 in 7e-8


@lru_cache(maxsize=2)
def shifted(coordinates: int, seed: int = 11) -> np.ndarray:
    """Row p holds the second permutation at p, p + 1, ..., circularly."""
    places = 1 << UNIVERSE_BITS
    order = np.argsort(mix64(np.arange(places, dtype=U64) + U64(seed << 40)), kind="stable").astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([order, order[: coordinates - 1]]), coordinates)


def signature(shingles: np.ndarray, coordinates: int = ROWS * BANDS) -> np.ndarray:
    """All coordinates of a set that is not empty."""
    places = (mix64(shingles) >> U64(64 - UNIVERSE_BITS)).astype(np.int64)
    table = shifted(coordinates)
    out = table[places[:2048]].min(0)
    for i in range(2048, len(places), 2048):
        np.minimum(out, table[places[i : i + 2048]].min(0), out=out)
    return out


def bands(sign: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key a band; the number of the band is part of it."""
    parts = sign.reshape(-1, rows).astype(U64)
    with np.errstate(over="ignore"):
        key = np.arange(len(parts), dtype=U64) * U64(0xD1B54A32D192ED03)
        for k in range(rows):
            key = mix64(key + parts[:, k])
    return key


def set_key(s: np.ndarray) -> bytes:
    """A 128-bit digest of a set that is not empty."""
    with np.errstate(over="ignore"):
        return np.array([np.bitwise_xor.reduce(mix64(s + np.arange(len(s), dtype=U64))), mix64(s ^ U64(0x2545F4914F6CDD1D)).sum(dtype=U64)]).tobytes()


FEATURES = "id bigint, n_shingles bigint, set_key binary, bands binary"


def features(df: DataFrame, id_col: str, text_col: str, width: int, batch_bytes: int = 2 << 20) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", batch_bytes):
                size, key, band = [], [], []
                for raw in byte_list(b.column("text")):
                    s = shingle_set(raw, width)
                    size.append(len(s))
                    if len(s):
                        key.append(set_key(s))
                        band.append(bands(signature(s)).tobytes())
                    else:
                        key.append(None)
                        band.append(None)
                yield pa.RecordBatch.from_arrays([b.column("id").cast(pa.int64()), pa.array(size, type=pa.int64()), pa.array(key, type=pa.binary()), pa.array(band, type=pa.binary())], names=["id", "n_shingles", "set_key", "bands"])
        forget()

    return df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(run, FEATURES)


PAIRS = "a bigint, b bigint"


def stars(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For nodes under keys: (kept keys with their least node) as an index, and the least node of
    each entry's key."""
    order = np.lexsort((node, key))
    k, n = key[order], node[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    least = np.repeat(n[first], np.diff(np.append(first, len(k))))
    return order[first], n, least


def pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Distinct pairs with a > b."""
    keep = a != b
    both = np.unique(np.stack([a[keep], b[keep]], axis=1), axis=0) if keep.any() else np.zeros((0, 2), dtype=np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def candidates(sets: DataFrame, parts: int) -> DataFrame:
    """Edges (a, b) that tie each document to the least one of each of its band buckets."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            band = [np.frombuffer(x, dtype=U64) for x in b.column("bands").to_pylist()]
            key = np.concatenate(band)
            node = np.repeat(b.column("id").to_numpy(), [len(x) for x in band])
            kept, n, least = stars(key, node)
            inner = pairs(n, least)
            where = (key[kept] >> U64(40)).astype(np.int64) % parts
            order = np.argsort(where, kind="stable")
            kept, where = kept[order], where[order]
            cut = np.searchsorted(where, np.arange(parts + 1))
            rows = [(p, key[kept[x:y]].tobytes(), node[kept[x:y]].tobytes(), b"", b"") for p, (x, y) in enumerate(zip(cut, cut[1:])) if y > x]
            a, c = inner.column(0).to_numpy(), inner.column(1).to_numpy()
            for i in range(0, len(a), 4096):
                rows.append(((int(a[i]) + i) % parts, b"", b"", a[i : i + 4096].tobytes(), c[i : i + 4096].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*rows), [pa.int32()] + [pa.binary()] * 4)], names=["part", "keys", "nodes", "a", "b"])

    def meet(table: pa.Table) -> pa.Table:
        join = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), dtype=kind)
        key, node = join("keys", U64), join("nodes", np.int64)
        _, n, least = stars(key, node) if len(key) else (None, node, node)
        return pa.Table.from_batches([pairs(np.concatenate([n, join("a", np.int64)]), np.concatenate([least, join("b", np.int64)]))])

    sent = sets.select("id", "bands").mapInArrow(send, "part int, keys binary, nodes binary, a binary, b binary")
    return sent.groupBy("part").applyInArrow(meet, PAIRS).distinct()


def shingled(texts: DataFrame, width: int, wanted: tuple[np.ndarray, int], batch_bytes: int = 2 << 20) -> DataFrame:
    """doc, sk (digest of the set), shingles (the sorted set) of rows (doc, text) that have words and whose
    doc may be in the filter ``wanted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole.filter(pa.array(may_hold(whole.column("doc"), wanted))), "text", batch_bytes):
                sets = [shingle_set(raw, width) for raw in byte_list(b.column("text"))]
                some = [i for i, s in enumerate(sets) if len(s)]
                yield pa.RecordBatch.from_arrays([b.column("doc").take(pa.array(some, type=pa.int64())), pa.array([set_key(sets[i]) for i in some], type=pa.binary()), pa.array([sets[i].tobytes() for i in some], type=pa.binary())], names=["doc", "sk", "shingles"])
        forget()

    return texts.mapInArrow(run, "doc bigint, sk binary, shingles binary")


def alike(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """den * |x & y| >= num * |x | y| for sorted sets."""
    if den * min(len(x), len(y)) < num * max(len(x), len(y)):
        return False
    common = overlap(x, y)
    return den * common >= num * (len(x) + len(y) - common)


def star_links(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Links of documents with the leader they are tied to, of rows (task, leader, salt, leads, id, shingles)."""

    def run(table: pa.Table) -> pa.Table:
        leader, salt, ids = (table.column(c).to_numpy() for c in ("leader", "salt", "id"))
        leads = table.column("leads").to_numpy()
        sets = table.column("shingles")
        order = np.lexsort((~leads, salt, leader))
        a, b = [], []
        head: list[np.ndarray] = []
        now = None
        for i in order.tolist():
            if (leader[i], salt[i]) != now:
                now, head = (leader[i], salt[i]), []
            s = np.frombuffer(sets[i].as_py(), dtype=U64)
            if leads[i]:
                head.append(s)
            elif any(alike(s, h, num, den) for h in head):
                a.append(int(ids[i]))
                b.append(int(leader[i]))
        return pa.Table.from_batches([pairs(np.array(a, dtype=np.int64), np.array(b, dtype=np.int64))])

    return rows.groupBy("task").applyInArrow(run, PAIRS)


def spanning(sets: list[np.ndarray], comp: np.ndarray, band: np.ndarray, key: int | None, side: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Links between the components ``comp`` of the sets of one bucket that join them as far as the
    sets do; pairs are numbers of sets.

    ``band`` holds the bands of each set; a pair is compared if it shares one.  With the ``key`` of a bucket
    that all share, it is compared if that is the first one it shares.  With two values in ``side`` only pairs across them are compared."""
    n = len(sets)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    order = np.argsort(size, kind="stable")
    _, parent = np.unique(comp, return_inverse=True)
    parent, size, side = parent[order], size[order], side[order]
    _, code = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    edge = np.concatenate([[0], np.cumsum(size)])
    # only bands before the bucket's own can take a pair from it
    early = band[order][:, : BANDS if key is None else int(np.flatnonzero(band[0] == U64(key))[0])]
    both = bool(side.any() and not side.all())
    marked = np.zeros(int(code.max()) + 1, dtype=np.int32)
    out = []
    for x in range(1, n):
        low = int(np.searchsorted(size * den, size[x] * num))  # den * |y| >= num * |x|
        y = low + np.flatnonzero(parent[low:x] != parent[x]) if low < x else np.zeros(0, dtype=np.int64)
        if both:
            y = y[side[y] != side[x]]
        if len(y):
            y = y[(early[y] == early[x]).any(1) == (key is None)]
        if not len(y):
            continue
        mine = code[edge[x] : edge[x + 1]]
        marked[mine] = 1
        begin = np.cumsum(size[y]) - size[y]
        common = np.add.reduceat(marked[code[np.repeat(edge[y] - begin, size[y]) + np.arange(int(size[y].sum()))]], begin)
        marked[mine] = 0
        for z in y[den * common >= num * (size[y] + size[x] - common)].tolist():
            if parent[z] != parent[x]:
                out.append((int(order[x]), int(order[z])))
                parent[parent == max(parent[x], parent[z])] = min(parent[x], parent[z])
    return out


def bucket_links(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Links between components, of rows (task, whole, key, i, j, own, id, comp, bands, shingles) that share a
    bucket, or a group of them (``whole``), and a pair of its chunks."""

    def run(table: pa.Table) -> pa.Table:
        key, low, high, own, ids, comp = (table.column(c).to_numpy() for c in ("key", "i", "j", "own", "id", "comp"))
        bands_, sets, whole = table.column("bands"), table.column("shingles"), table.column("whole").to_numpy()
        order = np.lexsort((ids, high, low, key))
        a, b = [], []
        same = (key[order][1:] == key[order][:-1]) & (low[order][1:] == low[order][:-1]) & (high[order][1:] == high[order][:-1])
        cut = np.flatnonzero(np.concatenate([[True], ~same, [True]]))
        for x, y in zip(cut, cut[1:]):
            here = order[x:y]
            if y - x < 2 or (comp[here] == comp[here[0]]).all():
                continue
            found = [np.frombuffer(sets[int(i)].as_py(), dtype=U64) for i in here]
            band = np.stack([np.frombuffer(bands_[int(i)].as_py(), dtype=U64) for i in here])
            for p, q in spanning(found, comp[here], band, None if whole[here[0]] else int(key[here[0]].view(U64)), own[here] == high[here[0]] if low[here[0]] != high[here[0]] else np.zeros(y - x, dtype=bool), num, den):
                u, v = int(comp[here[p]]), int(comp[here[q]])
                a.append(max(u, v))
                b.append(min(u, v))
        return pa.Table.from_batches([pairs(np.array(a, dtype=np.int64), np.array(b, dtype=np.int64))])

    return rows.groupBy("task").applyInArrow(run, PAIRS)


def banded(members: DataFrame) -> DataFrame:
    """A row (key, sk, id, comp, size) for each band of each member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = np.frombuffer(b"".join(b.column("bands").to_pylist()), dtype=np.int64)
            which = pa.array(np.repeat(np.arange(b.num_rows), BANDS))
            yield pa.RecordBatch.from_arrays([pa.array(key), *(b.column(c).take(which) for c in ("sk", "id", "comp", "size"))], names=["key", "sk", "id", "comp", "size"])

    return members.select("bands", "sk", "id", "comp", "size").mapInArrow(run, "key bigint, sk binary, id bigint, comp bigint, size bigint")


def _tasks(bytes_: int, each: int) -> int:
    return max(64, bytes_ // each)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, num: int = 85, den: int = 100, chunk: int = 128, chunk_bytes: int = 8 << 20, task_bytes: int = 4 << 20, most_chunks: int = 16) -> DataFrame:
    """doc id, n_shingles, component_id, kept for every row; links have den * |x & y| >= num * |x | y|."""
    table = written(features(df, id_col, text_col, width))
    rows = table.count()
    parts = max(64, rows // 50_000)
    classes = table.filter("set_key is not null and id is not null").groupBy("set_key").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    reps = table.join(classes, "set_key").filter("id = rep").dropDuplicates(["set_key"])
    ties = written(candidates(reps, parts))
    nodes = ties.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    # sets are made once, and only those of tied documents are shuffled
    text = df.select(df[id_col].cast("long").alias("doc"), df[text_col].alias("text")).filter(F.col("text").isNotNull())
    tied = reps.join(nodes, "id").select("id", F.col("set_key").alias("sk"), "bands")
    members = written(shingled(text, width, built(nodes, nodes.count())).dropDuplicates(["sk", "doc"]).join(tied, "sk").filter("id = doc").select("id", "sk", "bands", "shingles", F.octet_length("shingles").cast("long").alias("size")))
    held = members.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    sizes = members.select("id", "size")
    many = lambda n, size: F.greatest(F.ceil(n / chunk), F.ceil(size / chunk_bytes)).cast("int")

    # ties of documents with the leaders of their buckets
    per = ties.join(sizes, ties.a == sizes.id).groupBy("b").agg(F.count("*").alias("n"), F.sum("size").alias("s")).select(F.col("b").alias("leader"), many(F.col("n"), F.col("s")).alias("salts"))
    deal = lambda d: F.when(F.col("salts") > 1, F.xxhash64("leader", "salt")).otherwise(F.pmod(F.xxhash64("leader"), F.lit(d)))
    followers = ties.join(per, ties.b == per.leader).select("leader", "salts", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"), F.lit(False).alias("leads"), F.col("a").alias("of"))
    leaders = per.select("leader", "salts", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(True).alias("leads"), F.col("leader").alias("of"))
    dealt = followers.unionByName(leaders).withColumn("task", deal(_tasks(4 * held, task_bytes)))
    shipped = dealt.join(members.select("id", "shingles"), dealt.of == F.col("id")).select("task", "leader", "salt", "leads", "id", "shingles")
    links = written(star_links(shipped, num, den))
    dropped(ties)
    first = written(components(links))
    dropped(links)

    # buckets that hold several components; buckets that share documents form a group
    placed = members.join(first, members.id == first.node, "left").withColumn("comp", F.coalesce("component", "id"))
    keyed = written(banded(placed))
    open_ = keyed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("id").alias("least"), F.count("*").alias("n"), F.sum("size").alias("s")).filter("low <> high and n > 2").select("key", "least", many(F.col("n"), F.col("s")).alias("chunks"))
    searched = written(keyed.join(open_, "key").select("key", "chunks", "least", "sk", "id", "comp", "size"))
    dropped(keyed)
    groups = written(components(searched.select(F.col("id").alias("a"), F.col("least").alias("b"))).select(F.col("node").alias("id"), F.col("component").alias("grp")))
    alone = searched.select("sk", "id", "comp", "size").distinct().join(groups, "id")
    shares = alone.groupBy("grp").agg(F.count("*").alias("n"), F.sum("size").alias("s")).select("grp", many(F.col("n") / 2, F.col("s") / 2).alias("chunks"))
    together = alone.join(shares.filter(F.col("chunks") <= most_chunks), "grp").select(F.lit(True).alias("whole"), F.col("grp").alias("key"), "chunks", "sk", "comp")
    apart = searched.join(groups, "id").join(shares.filter(F.col("chunks") > most_chunks).select("grp"), "grp", "left_semi").select(F.lit(False).alias("whole"), "key", "chunks", "sk", "comp")
    placed = together.unionByName(apart).withColumn("own", F.pmod(F.xxhash64("sk"), F.col("chunks")).cast("int"))
    at = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j")))
    placed = placed.select("*", F.explode(at).alias("at")).select("whole", "key", "chunks", "sk", "comp", "own", "at.i", "at.j")
    placed = placed.withColumn("task", F.when(F.col("chunks") > 1, F.xxhash64("key", "i", "j")).otherwise(F.pmod(F.xxhash64("key"), F.lit(_tasks(held, task_bytes)))))
    shipped = placed.join(members.select("sk", "id", "bands", "shingles"), "sk").select("task", "whole", "key", "i", "j", "own", "id", "comp", "bands", "shingles")
    rest = components(bucket_links(shipped, num, den)).select(F.col("node").alias("c"), F.col("component").alias("joined"))

    # a document without a link of its own may still be found in a bucket
    ids = members.select("id").distinct()
    found = ids.join(first, ids.id == first.node, "left").withColumn("c", F.coalesce("component", "id")).drop("component").join(rest, "c", "left").select(F.col("id").alias("node"), F.coalesce("joined", "c").alias("component"))
    named = classes.join(found, classes.rep == found.node, "left").select("set_key", F.coalesce("component", "rep").alias("component"), "rep", "copies")
    named = named.filter("copies > 1 or component <> rep").select("set_key", "component")
    out = table.select("id", "n_shingles", "set_key").join(named, "set_key", "left")
    kind = df.schema[id_col].dataType
    out = out.withColumn("component", F.when(F.col("id").isNotNull(), F.col("component")))
    return out.select(F.col("id").cast(kind).alias(id_col), "n_shingles", F.coalesce("component", "id").cast(kind).alias("component_id"), F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(True)).alias("kept"))
