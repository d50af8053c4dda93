"""A Bloom filter of integer ids whose size has a fixed bound.

It thins out rows before a shuffle join; ids it lets through by chance only cost shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, mix64

LEAST_BITS, MOST_BITS = 16, 27  # 8 KB to 16 MB, whatever the number of ids


def places(ids: np.ndarray, bits: int) -> np.ndarray:
    h = mix64(ids.astype(np.int64).view(U64))
    return np.concatenate([h >> U64(64 - bits), mix64(h + U64(1)) >> U64(64 - bits)]).astype(np.int64)


def built(ids: DataFrame, count: int) -> tuple[np.ndarray, int]:
    """(words, bits) of the single column of ``ids``; at most 2**MOST_BITS / 64 words reach the driver."""
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * max(1, count)).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(places(b.column(0).to_numpy(), bits))
            if not len(at):
                continue
            word, first = np.unique(at >> 6, return_index=True)
            value = np.bitwise_or.reduceat(U64(1) << (at & 63).astype(U64), first)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(value.view(np.int64))], names=["word", "value"])

    found = ids.mapInArrow(run, "word bigint, value bigint").groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()
    words = np.zeros(1 << (bits - 6), dtype=U64)
    words[found.column("word").to_numpy()] = found.column("value").to_numpy().view(U64)
    return words, bits


def held(ids: pa.Array, filter_: tuple[np.ndarray, int]) -> np.ndarray:
    """Which ids may be in the filter; a null id is never inside."""
    words, bits = filter_
    at = places(ids.fill_null(0).to_numpy(zero_copy_only=False), bits)
    hit = (words[at >> 6] >> (at & 63).astype(U64) & U64(1)).astype(bool).reshape(2, -1).all(0)
    return hit & ~ids.is_null().to_numpy(zero_copy_only=False)


def thinned(df: DataFrame, id_col: str, filter_: tuple[np.ndarray, int], inside: bool = True) -> DataFrame:
    """The rows of ``df`` whose id may be in the filter, or the others; a null id is never inside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = held(b.column(id_col), filter_)
            yield b.filter(pa.array(hit if inside else ~hit))

    return df.mapInArrow(run, df.schema)
