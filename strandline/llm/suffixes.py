"""Removal of long repeated byte strings by blockwise suffix sorting.

A byte is removed when a string of ``span`` bytes that covers it also starts in a document with
a smaller id.  The suffixes that matter are found and sorted bucket by bucket:

1. ``anchors``: every ``span``-byte string elects the least of its ``GRAM``-byte grams, so equal
   strings elect equal grams; neighbours that elect equal grams form a stretch of the text.  Grams
   elected in one document only cannot start a repeat and are dropped; this takes one shuffle of
   gram hashes.
2. the suffixes of the stretches of one gram are a suffix bucket.  Buckets are sorted one at a
   time, first those that a block of documents can decide alone, then those that remain over all blocks.
3. ``least_ids`` sorts the suffixes of a bucket by the head and the tail of their ``span`` bytes.
   Ties between documents are resolved by the precomputed ranks of the samples of a difference
   cover, the order of their bytes: two tied suffixes always have a sample at the same distance,
   and its rank and the bytes already compared make up the whole string.
4. the least id of equal suffixes tells which strings are removed.  The covered spans go back
   to the blocks of documents, where the bytes that are kept are put together.

No equality rests on a hash; hashes only choose buckets.  Maps reduce hot strings before anything is
shuffled: a block sends a gram once, and of equal suffixes only those of its least document.  So a
bucket holds at most one document a block for each string; there are at most ``MOST_BLOCKS`` blocks,
and beyond them blocks grow.  Texts cross the network compressed and twice at most.

A null or empty text has 0 bytes and loses none; texts below ``span`` bytes lose none.  Very long
texts are read in overlapping pieces for the election and in stretches of at most ``LONGEST``
strings after it; a stretch that repeats a short period takes part with one period, so long runs cost
no more than other text.  Rows with equal ids count as one document: neither is removed for the other,
and each is judged by its own text.  Equal strings within a document tie and stay.  A null id
neither removes nor loses anything.  An empty table gives an empty result; other columns, whatever
their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, byte_list, mix64

SPAN, GRAM = 50, 16
PERIOD, COVER = 13, (0, 1, 3, 9)  # every difference modulo 13 lies between two of the cover
PIECE = 2 << 20  # bytes elected at a time
LONGEST = 4_096  # string starts in a stretch
MOST_BLOCKS = 1 << 20
TWIN = 40  # a place also holds which of the rows with its id is meant, above so many bits
#: for two places modulo PERIOD the least distance at which both have a sample
MEET = np.array([[next(d for d in range(PERIOD) if (a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER) for b in range(PERIOD)] for a in range(PERIOD)])


# --- packing of arrays into cells


def packed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def unpacked(cells: list[bytes], kind) -> np.ndarray:
    engine = zstandard.ZstdDecompressor()
    return np.frombuffer(b"".join(engine.decompress(c) for c in cells if c), dtype=kind)


def by_part(where: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(part, indices) of the entries of each part that has some."""
    order = np.argsort(where, kind="stable")
    cut = np.searchsorted(where[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(cut)):
        yield int(p), order[cut[p] : cut[p + 1]]


def block_of(ids: np.ndarray, blocks: int) -> np.ndarray:
    return (mix64(ids.astype(np.int64).view(U64)) >> U64(20)).astype(np.int64) % blocks


# --- election


def words_at(buf: np.ndarray, n: int, shift: int = 0) -> np.ndarray:
    """The 8 bytes at each of n places as numbers in the order of the bytes; ``buf`` has 8 bytes to spare."""
    out = np.empty(n, dtype=U64)
    for o in range(min(8, n)):
        size = (n - o + 7) // 8
        out[o::8] = np.frombuffer(buf, dtype=">u8", count=size, offset=o + shift)
    return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours from a place on; ends are cut off."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of each text whose strings elect equal grams: text number, first and last string
    start, and hash of the gram."""
    out: list[list[np.ndarray]] = []
    group: list[tuple[int, int, bytes]] = []
    size = 0

    def elect() -> None:
        nonlocal size
        if not group:
            return
        raw = np.frombuffer(b"".join(t for _, _, t in group) + b"\0" * 64, dtype=np.uint8)
        length = np.array([len(t) for _, _, t in group], dtype=np.int64)
        n = int(length.sum())
        start = np.cumsum(length) - length
        least = sliding_min(mix64(mix64(words_at(raw, n)) + words_at(raw, n, 8)), SPAN - GRAM + 1)
        ok = np.zeros(n, dtype=bool)
        for s, m in zip(start.tolist(), length.tolist()):
            ok[s : s + m - SPAN + 1] = True
        at = np.flatnonzero(ok[: len(least)])
        gram = least[at]
        first = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (at[1:] != at[:-1] + 1)]))
        runs = np.diff(np.append(first, len(at)))
        if runs.max() > LONGEST:
            cut = -(-runs // LONGEST)
            first = np.repeat(first, cut) + LONGEST * (np.arange(int(cut.sum())) - np.repeat(np.cumsum(cut) - cut, cut))
        last = np.append(first[1:], len(at)) - 1
        which = np.searchsorted(start, at[first], "right") - 1
        base = np.array([b for _, b, _ in group], dtype=np.int64)[which] - start[which]
        number = np.array([i for i, _, _ in group], dtype=np.int64)[which]
        out.append([number, at[first] + base, at[last] + base, gram[first]])
        group.clear()
        size = 0

    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - SPAN + 1), PIECE):
            piece = t[at : at + PIECE + SPAN - 1]
            if len(piece) < SPAN:
                continue
            if size + len(piece) > PIECE + SPAN and group:
                elect()
            group.append((i, at, piece))
            size += len(piece)
    elect()
    if not out:
        e = np.zeros(0, dtype=np.int64)
        return e, e, e, e.astype(U64)
    return tuple(np.concatenate(c) for c in zip(*out))


# --- suffix buckets


def cover_ranks(word: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For the samples of the cover within reach of a start the rank of the bytes from there on, as
    many as lie within the string of every start that can use the sample."""
    n, deep = len(word), SPAN - PERIOD + 1
    near = np.zeros(n + 1, dtype=np.int32)
    near[:] = np.bincount(starts, minlength=n + 1)
    near -= np.bincount(np.minimum(starts + PERIOD, n), minlength=n + 1).astype(np.int32)
    sampled = np.zeros(n, dtype=bool)
    for c in COVER:
        sampled[c::PERIOD] = True
    place = np.flatnonzero(sampled & (np.cumsum(near[:-1]) > 0))
    place = place[place + deep <= n]
    keys = [word[place + o] for o in [*range(0, deep - 8, 8), deep - 8]]
    order = np.lexsort(keys[::-1])
    change = np.zeros(len(order), dtype=bool)
    for k in keys:
        k = k[order]
        change[1:] |= k[1:] != k[:-1]
    rank = np.zeros(n, dtype=np.int32)
    rank[place[order]] = np.cumsum(change)
    return rank


def firsts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, dtype=np.int64)


def least_ids(raw: np.ndarray, starts: np.ndarray, ids: np.ndarray, bucket: int = 1 << 20, rounds: int = 3) -> np.ndarray:
    """For each suffix the least id among the suffixes with the same first SPAN bytes.

    ``raw`` has SPAN bytes at every start.  Beyond ``bucket`` suffixes they are sorted by ranges of
    their first eight bytes, one range at a time."""
    out = ids.copy()
    if len(starts) == 0 or ids.min() == ids.max():
        return out
    n = len(raw)
    word = words_at(np.concatenate([raw, np.zeros(64, dtype=np.uint8)]), n)
    deep, half = SPAN - PERIOD + 1, U64(32)
    rank = None
    head = word[starts]
    if len(starts) > bucket:
        splits = np.unique(np.sort(head[:: max(1, len(head) // 100_000)])[:: max(1, 100_000 * bucket // len(starts))][1:])
        where = np.searchsorted(splits, head, "right")
    else:
        splits, where = head[:0], np.zeros(len(starts), dtype=np.int64)
    for _, mine in by_part(where, len(splits) + 1):
        s, d = starts[mine], ids[mine]
        # bytes 0 to 11, then 38 to 49
        keys = (head[mine], (word[s + 8] >> half << half) | (word[s + deep] >> half), word[s + SPAN - 8])
        order = np.lexsort(keys[::-1])
        change = np.zeros(len(order), dtype=bool)
        change[0] = True
        for k in keys:
            k = k[order]
            change[1:] |= k[1:] != k[:-1]
        s, d, who, group = s[order], d[order], mine[order], np.cumsum(change)

        def tied(*columns: np.ndarray) -> list[np.ndarray]:
            """Those of groups that still hold several ids; the group is the first column, the id the second."""
            first = firsts(columns[0])
            if not len(first):
                return list(columns)
            several = np.minimum.reduceat(columns[1], first) != np.maximum.reduceat(columns[1], first)
            some = np.repeat(several, np.diff(np.append(first, len(columns[0]))))
            return [c[some] for c in columns]

        group, d, s, who = tied(group, d, s, who)
        if not len(s):
            continue
        if rank is None:
            rank = cover_ranks(word, starts)
        # nearly all are equal to the suffix of the least id they tie with, or to that of those left over
        for _ in range(rounds):
            first = firsts(group)
            size = np.diff(np.append(first, len(group)))
            least = np.repeat(np.minimum.reduceat(d, first), size)
            lead = np.flatnonzero(d == least)
            lead = np.repeat(lead[firsts(group[lead])], size)
            step = MEET[s % PERIOD, s[lead] % PERIOD]
            equal = rank[s + step] == rank[s[lead] + step]
            out[who[equal]] = least[equal]
            rest = ~equal
            group, d, s, who = tied(group[rest], d[rest], s[rest], who[rest])
            if not len(s):
                break
        for delta in range(PERIOD if len(s) else 0):
            has = np.isin((s + delta) % PERIOD, COVER)
            key, i = group[has].astype(np.int64) << 32 | rank[s[has] + delta], np.flatnonzero(has)
            if not len(i):
                continue
            turn = np.argsort(key, kind="stable")
            key, i = key[turn], i[turn]
            cut = firsts(key)
            least = np.repeat(np.minimum.reduceat(d[i], cut), np.diff(np.append(cut, len(key))))
            out[who[i]] = np.minimum(out[who[i]], least)
    return out


def period(x: np.ndarray) -> int:
    """The least period below a gram's reach of all of x, or 0."""
    for q in range(1, SPAN - GRAM):
        if x[-1] == x[-1 - q] and (x[q:] == x[:-q]).all():
            return q
    return 0


def gone(raw: np.ndarray, length: np.ndarray, doc: np.ndarray, gram: np.ndarray, text_bytes: int = 4 << 20) -> np.ndarray:
    """For stretches that lie side by side in ``raw``: whether each of their strings equals one of a
    document with a smaller id.  Buckets (grams) are packed to about ``text_bytes`` and sorted together."""
    begin = np.cumsum(length) - length
    number = length - SPAN + 1  # strings of each stretch
    place = np.cumsum(number) - number
    out = np.zeros(int(number.sum()), dtype=bool)
    own = number.copy()  # strings that take part
    for k in np.flatnonzero(number > 2 * SPAN).tolist():
        own[k] = period(raw[begin[k] : begin[k] + length[k]]) or number[k]
    order = np.argsort(gram, kind="stable")
    edge = firsts(gram[order])
    size = np.diff(np.append(edge, len(order)))
    if len(edge):
        several = np.minimum.reduceat(doc[order], edge) != np.maximum.reduceat(doc[order], edge)
        order = order[np.repeat(several, size)]
        size = size[several]
    ends = np.cumsum(size)
    weight = np.concatenate([[0], np.cumsum(own[order] + SPAN - 1)])
    reach, done = weight[ends], 0
    while done < len(order):
        # whole buckets up to the wanted size, one at least
        to = int(np.searchsorted(reach, weight[done] + text_bytes, "right"))
        to = int(ends[max(to - 1, int(np.searchsorted(ends, done, "right")))])
        mine = order[done:to]
        done = to
        n = own[mine]
        base = np.cumsum(n + SPAN - 1) - (n + SPAN - 1)
        text = raw[np.repeat(begin[mine] - base, n + SPAN - 1) + np.arange(int((n + SPAN - 1).sum()))]
        offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        ids = np.repeat(doc[mine], n)
        hit = least_ids(text, np.repeat(base, n) + offset, ids) < ids
        out[(np.repeat(place[mine], n) + offset)[hit]] = True
        at = np.cumsum(n) - n
        for k in np.flatnonzero(number[mine] > n).tolist():
            x = int(place[mine[k]])
            out[x : x + number[mine[k]]] = np.resize(hit[at[k] : at[k] + n[k]], number[mine[k]])
    return out


def runs(mask: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretch, first and last offset of each run of strings that ``mask`` holds."""
    at = np.flatnonzero(mask)
    place = np.cumsum(number) - number
    which = np.searchsorted(place, at, "right") - 1
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (which[1:] != which[:-1])])) if len(at) else at
    last = np.append(first[1:], len(at)) - 1 if len(at) else at
    which = which[first]
    return which, at[first] - place[which], at[last] - place[which]


# --- stages

ROW = "part int, kind int, a binary, b binary, c binary, d binary, e binary"
_NAMES = [x.split()[0] for x in ROW.split(", ")]
_KINDS = [pa.int32(), pa.int32()] + [pa.binary()] * 5
_SCHEMA = pa.schema(list(zip(_NAMES, _KINDS)))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows) if rows else [[]] * 7, _KINDS)], names=_NAMES)


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([_rows(rows)], schema=_SCHEMA)


def _cells(table: pa.Table, kind: int, *columns: tuple[str, type]) -> list[np.ndarray]:
    table = table.filter(pc.equal(table.column("kind"), kind))
    return [unpacked(table.column(c).to_pylist(), t) for c, t in columns]


def _held(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """(ids, texts) of about ``limit`` bytes; null ids are left out."""
    ids, texts, size = [], [], 0
    for b in batches:
        for key, raw in zip(b.column("id").to_pylist(), byte_list(b.column("text"))):
            if key is None:
                continue
            if size + len(raw) > limit and ids:
                yield np.array(ids, dtype=np.int64), texts
                ids, texts, size = [], [], 0
            ids.append(key)
            texts.append(raw)
            size += len(raw)
    if ids:
        yield np.array(ids, dtype=np.int64), texts


def elected(df: DataFrame, parts: int, hold: int = 24 << 20) -> DataFrame:
    """Rows of grams (kind 0: hash, id, place; kind 1: hashes seen in two documents of a block)
    and of places known to repeat (kind 2: id, place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _held(batches, hold):
            number, place, _, h = anchors(texts)
            if not len(h):
                continue
            key, doc = h >> U64(16), ids[number]
            order = np.argsort(key, kind="stable")
            key, doc, place = key[order], doc[order], place[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
            many = np.repeat(several, np.diff(np.append(first, len(key))))
            rows = []
            one = np.flatnonzero(~many)
            for p, i in by_part((key[one] % U64(parts)).astype(np.int64), parts):
                i = one[i]
                rows.append((p, 0, packed((key[i] & U64(0xFFFFFFFF)).astype("<u4")) + b"", packed((key[i] >> U64(32)).astype("<u2")), packed(doc[i]), packed(place[i].astype("<u4")), None))
            two = key[first[several]]
            for p, i in by_part((two % U64(parts)).astype(np.int64), parts):
                rows.append((p, 1, packed(two[i]), None, None, None, None))
            known = np.flatnonzero(many)
            for k in range(0, len(known), 100_000):
                i = known[k : k + 100_000]
                rows.append(((int(doc[i[0]]) + k) % parts, 2, packed(doc[i]), packed(place[i].astype("<u4")), None, None, None))
            yield _rows(rows)

    return df.mapInArrow(run, ROW)


def repeated(grams: DataFrame, blocks: int) -> DataFrame:
    """Places whose gram is elected in two documents, by block of documents (kind 3)."""

    def run(table: pa.Table) -> pa.Table:
        low, high, doc, place = _cells(table, 0, ("a", "<u4"), ("b", "<u2"), ("c", np.int64), ("d", "<u4"))
        (two,) = _cells(table, 1, ("a", U64))
        known_doc, known_place = _cells(table, 2, ("a", np.int64), ("b", "<u4"))
        key = low.astype(U64) | high.astype(U64) << U64(32)
        order = np.argsort(key, kind="stable")
        key, doc, place = key[order], doc[order], place[order]
        if len(key):
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
            several |= np.isin(key[first], two)
            many = np.repeat(several, np.diff(np.append(first, len(key))))
            doc, place = doc[many], place[many]
        doc, place = np.concatenate([known_doc, doc]), np.concatenate([known_place, place])
        order = np.lexsort((place, doc))
        doc, place = doc[order], place[order]
        return _table([(p, 3, packed(doc[i]), packed(place[i]), None, None, None) for p, i in by_part(block_of(doc, blocks), blocks)])

    return grams.groupBy("part").applyInArrow(run, ROW)


def blocked(df: DataFrame, blocks: int, hold: int = 24 << 20) -> DataFrame:
    """Texts compressed by block of documents (kind 4: ids, lengths, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _held(batches, hold):
            rows = []
            for p, i in by_part(block_of(ids, blocks), blocks):
                mine = [texts[k] for k in i]
                rows.append((p, 4, packed(ids[i]), packed(np.array([len(t) for t in mine], dtype=np.int64)), zstandard.ZstdCompressor(level=1).compress(b"".join(mine)), None, None))
                if len(rows) >= 64:
                    yield _rows(rows)
                    rows = []
            if rows:
                yield _rows(rows)

    return df.mapInArrow(run, ROW)


def _texts(table: pa.Table) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Ids and texts of a block in a fixed order, and for each which of the rows with its id it is."""
    ids, length = _cells(table, 4, ("a", np.int64), ("b", np.int64))
    raw = unpacked(table.column("c").to_pylist(), np.uint8).tobytes()
    end = np.cumsum(length).tolist()
    rows = sorted(zip(ids.tolist(), [raw[a:b] for a, b in zip([0, *end], end)]))
    ids = np.array([k for k, _ in rows], dtype=np.int64)
    first = firsts(ids)
    twin = np.arange(len(ids)) - np.repeat(first, np.diff(np.append(first, len(ids))))
    return ids, [t for _, t in rows], twin


def stretches(texts: DataFrame, places: DataFrame, parts: int) -> DataFrame:
    """Spans that a block removes alone (kind 6: id, place, end), and the strings that are left of its
    repeated stretches by suffix bucket (kind 5: bytes, lengths, ids, places, gram hashes)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        doc, place = _cells(right, 3, ("a", np.int64), ("b", "<u4"))
        if not len(doc) or not left.num_rows:
            return _table([])
        ids, raw, twin = _texts(left)
        some = set(np.unique(doc).tolist())
        pick = [i for i, d in enumerate(ids.tolist()) if d in some]
        raw = [raw[i] for i in pick]
        number, low, high, h = anchors(raw)
        pick = np.array(pick, dtype=np.int64)
        mine = ids[pick[number]]
        _, code = np.unique(np.concatenate([mine, doc]), return_inverse=True)
        code = code.astype(np.int64) << 40
        hit = np.flatnonzero(np.isin(code[: len(mine)] | low, code[len(mine) :] | place.astype(np.int64)))
        if not len(hit):
            return _table([])
        whole = np.frombuffer(b"".join(raw), dtype=np.uint8)
        size = np.array([len(t) for t in raw], dtype=np.int64)
        start = (np.cumsum(size) - size)[number[hit]] + low[hit]
        length = high[hit] - low[hit] + SPAN
        doc, gram, at = mine[hit], h[hit], low[hit] + (twin[pick[number[hit]]] << TWIN)
        out = gone(_gathered(whole, start, length), length, doc, gram)
        rows = _spans(out, length, doc, at, parts)
        which, a, b = runs(~out, length - SPAN + 1)
        for p, i in by_part((gram[which] % U64(parts)).astype(np.int64), parts):
            w, n = which[i], (b[i] - a[i] + SPAN)
            rows.append((p, 5, packed(_gathered(whole, start[w] + a[i], n)), packed(n.astype("<u4")), packed(doc[w]), packed(at[w] + a[i]), packed(gram[w])))
        return _table(rows)

    return texts.groupBy("part").cogroup(places.groupBy("part")).applyInArrow(run, ROW)


def _gathered(raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Pieces of ``raw`` side by side."""
    return raw[np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))]


def _spans(out: np.ndarray, length: np.ndarray, doc: np.ndarray, at: np.ndarray, parts: int) -> list[tuple]:
    """Removed spans as rows of kind 6, dealt to any part."""
    which, a, b = runs(out, length - SPAN + 1)
    rows = []
    for k in range(0, len(which), 100_000):
        w, x, y = which[k : k + 100_000], a[k : k + 100_000], b[k : k + 100_000]
        rows.append(((int(doc[w[0]]) + k) % parts, 6, packed(doc[w]), packed(at[w] + x), packed((y - x + SPAN).astype("<u4")), None, None))
    return rows


def removed(found: DataFrame, blocks: int) -> DataFrame:
    """Removed spans by block of documents (kind 7: ids, places, lengths)."""

    def run(table: pa.Table) -> pa.Table:
        length, doc, at, gram = _cells(table, 5, ("b", "<u4"), ("c", np.int64), ("d", np.int64), ("e", U64))
        length = length.astype(np.int64)
        raw = unpacked(table.filter(pc.equal(table.column("kind"), 5)).column("a").to_pylist(), np.uint8)
        which, a, b = runs(gone(raw, length, doc, gram), length - SPAN + 1)
        known = _cells(table, 6, ("a", np.int64), ("b", np.int64), ("c", "<u4"))
        doc, at, size = (np.concatenate(x) for x in zip(known, (doc[which], at[which] + a, (b - a + SPAN).astype("<u4"))))
        return _table([(p, 7, packed(doc[i]), packed(at[i]), packed(size[i]), None, None) for p, i in by_part(block_of(doc, blocks), blocks)])

    return found.groupBy("part").applyInArrow(run, ROW)


RESULT = "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def cut_out(texts: DataFrame, gone: DataFrame, with_text: bool = False) -> DataFrame:
    """What is left of each document."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, raw, twin = _texts(left)
        doc, at, size = _cells(right, 7, ("a", np.int64), ("b", np.int64), ("c", "<u4"))
        order = np.lexsort((at, doc))
        doc, at, size = doc[order], at[order], size[order].astype(np.int64)
        spans: dict[tuple[int, int], list[tuple[int, int]]] = {}
        if len(doc):
            # spans of a row that touch are one; rows lie so far apart that they never do
            row = np.cumsum(np.concatenate([[0], (doc[1:] != doc[:-1]) | (at[1:] >> TWIN != at[:-1] >> TWIN)])) << TWIN
            a = row + (at & ((1 << TWIN) - 1))
            reach = np.maximum.accumulate(a + size)
            new = np.flatnonzero(np.concatenate([[True], a[1:] > reach[:-1]]))
            last = np.append(new[1:], len(doc)) - 1
            for d, t, x, y in zip(doc[new].tolist(), (at[new] >> TWIN).tolist(), (a[new] - row[new]).tolist(), (reach[last] - row[new]).tolist()):
                spans.setdefault((d, t), []).append((x, y))
        rows = []
        for d, t, w in zip(ids.tolist(), raw, twin.tolist()):
            mine, at_, left_ = spans.get((d, w), []), 0, []
            for x, y in mine:
                left_.append(t[at_:x])
                at_ = y
            left_.append(t[at_:])
            rest = b"".join(left_)
            rows.append((d, len(t), len(t) - len(rest), len(mine), hashlib.sha256(rest).hexdigest(), rest)[: 5 + with_text])
        kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * with_text
        names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text
        return pa.Table.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names=names)

    return texts.groupBy("part").cogroup(gone.groupBy("part")).applyInArrow(run, RESULT + ", kept binary" * with_text)


def dedup_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, part_bytes: int = 8 << 20, block_bytes: int = 4 << 20) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes) of every row."""
    rows = df.select(df[id_col].cast("long").alias("id"), df[text_col].alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    parts, blocks = max(48, total // part_bytes), min(MOST_BLOCKS, max(48, total // block_bytes))
    texts = blocked(rows, blocks)
    places = repeated(elected(rows, parts), blocks)
    out = cut_out(texts, removed(stretches(texts, places, parts), blocks), with_text)
    none = rows.filter("id is null").select("id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long"), F.sha2(F.coalesce("text", F.lit("")), 256), *([F.coalesce("text", F.lit("")).cast("binary")] * with_text))
    return out.unionAll(none).withColumn("id", F.col("id").cast(df.schema[id_col].dataType)).withColumnRenamed("id", id_col)
