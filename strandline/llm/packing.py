"""Hierarchical multi-length packing of token sequences.

Documents are cut into full windows of the longest tier and a remainder; remainders are
routed to the tier of the smallest power of two that holds them, and each tier is packed into
windows of its own size.  The tiers are packed from the longest down, each window taking the
longest piece of its tier first, and what is still open in it is filled from the shorter tiers
(best fit by length).  The last gap of a window is closed by cutting one more piece, whose rest
goes to the tier of its new length, so only the very last window of a run stays short; it is
cut into windows whose lengths are powers of two, which need no padding.

Windows then get a step group: from the longest tier down, a group takes windows of one tier
until it holds ``step_windows * window`` tokens, more windows of a shorter tier than of a longer
one.  Where a tier ends within a group the next shorter one completes it, without a remainder
as the sizes divide each other; so all groups of a run hold equal numbers of tokens but the last.

Packing works within each input partition, so nothing is shuffled, a window never depends on
rows elsewhere, and a lost task is redone alone.

A null or empty text is one end token.  Very long texts are cut into full windows.  Pieces of equal
length (ties) are taken last come, first served; repeated rows are packed like any others, each with its
own pieces.  An empty table gives an empty result.  Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import slices, text_list
from .tokens import transducer


def pack(lengths: list[int], window: int = 2048, least: int = 16) -> list[tuple[int, int, int, int, int]]:
    """(item, start, length, window number, offset) for items of the given token counts.

    Every token lies in exactly one piece and a window has no gaps.  Each window is full
    or has a power of two of tokens.  ``least`` is the shortest gap for which a whole piece is
    looked up in the shorter tiers before one is cut (an eighth of the window, if that is less)."""
    out: list[tuple[int, int, int, int, int]] = []
    made = 0
    # pieces by length, so a tier is a range of lengths; bit n of ``lengths_`` is set if there are any of n tokens
    open_: list[list[tuple[int, int]]] = [[] for _ in range(window + 1)]
    lengths_ = 0

    def put(n: int, i: int, start: int) -> None:
        nonlocal lengths_
        open_[n].append((i, start))
        lengths_ |= 1 << n

    def taken(n: int) -> tuple[int, int]:
        nonlocal lengths_
        piece = open_[n].pop()
        if not open_[n]:
            lengths_ ^= 1 << n
        return piece

    for i, n in enumerate(lengths):
        full = n // window
        for k in range(full):
            out.append((i, k * window, window, made, 0))
            made += 1
        if rest := n - full * window:
            put(rest, i, full * window)
    while lengths_:
        n = lengths_.bit_length() - 1  # the longest piece that is left is of the tier now packed
        tier = min(window, 1 << (n - 1).bit_length())
        here = [(*taken(n), n, 0)]
        room, used = tier - n, n
        while room and lengths_:
            fits = (lengths_ & ((2 << room) - 1)).bit_length() - 1
            longer = lengths_ >> (room + 1)
            if fits > 0 and (room >= min(least, tier >> 3) or fits == room or not longer):
                n = fits
                i, start = taken(n)
            else:  # nothing fits whole: cut the shortest piece that is longer than the gap
                m, n = room + (longer & -longer).bit_length(), room
                i, start = taken(m)
                put(m - n, i, start + n)
            here.append((i, start, n, used))
            used += n
            room -= n
        if not room:
            out += [(i, s, n, made, o) for i, s, n, o in here]
            made += 1
            continue
        size, left = 1 << (used.bit_length() - 1), 0  # the last window: powers of two
        for i, start, n, _ in here:
            while n:
                take = min(n, size - left)
                out.append((i, start, take, made, left))
                start, n, left, used = start + take, n - take, left + take, used - take
                if left == size and used:
                    made, left, size = made + 1, 0, 1 << (used.bit_length() - 1)
        made += 1
    return out


def pack_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, end_id: int = 1, step_windows: int = 8, batch_bytes: int = 4 << 20, hold_tokens: int = 8_000_000) -> DataFrame:
    """One row per piece; sequence ids are unique over the partitions.

    A partition is packed in runs of about ``hold_tokens`` tokens (2 bytes each are kept),
    which bounds memory whatever the size of a partition."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        first = TaskContext.get().partitionId() << 36
        ids: list = []
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal first
            pieces = pack([len(h) for h in held], window)
            if not pieces:
                return
            item, start, size, seq, offset = (np.array(x, dtype=np.int64) for x in zip(*pieces))
            crc = np.array([zlib.crc32(held[i][s : s + n].astype("<u4").tobytes()) for i, s, n, _, _ in pieces], dtype=np.int64)
            total = np.array([len(h) for h in held], dtype=np.int64)
            filled = np.bincount(seq, weights=size).astype(np.int64)
            tier = np.maximum(0, np.ceil(np.log2(filled))).astype(np.int64)
            turn = np.empty(len(filled), dtype=np.int64)
            order = np.lexsort((np.arange(len(filled)), -tier))
            turn[order] = (np.cumsum(filled[order]) - filled[order]) // (step_windows * window)
            for at in range(0, len(item), 50_000):
                cut = slice(at, at + 50_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[i] for i in item[cut]], type=id_type), *(pa.array(x[cut]) for x in (start, size, crc, total[item], seq + first, offset, (1 << tier)[seq], turn[seq] + first))],
                    names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"],
                )
            first += int(seq.max()) + 1
            ids.clear()
            held.clear()

        id_type, tokens = None, 0
        for whole in batches:
            for b in slices(whole, "text", batch_bytes):
                id_type = b.column("id").type
                for key, coded in zip(b.column("id").to_pylist(), machine.ids(text_list(b.column("text")))):
                    if tokens + len(coded) >= hold_tokens and held:
                        yield from flush()
                        tokens = 0
                    ids.append(key)
                    held.append(np.append(coded, np.uint32(end_id)).astype(np.uint16 if len(coded) == 0 or coded.max() < 65536 else np.uint32))
                    tokens += len(coded) + 1
        machine.forget()
        yield from flush()

    narrow = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    return narrow.mapInArrow(run, f"`{id_col}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, tier bigint, step_group bigint")
