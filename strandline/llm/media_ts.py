"""Media columns as MPEG transport streams.

``mux`` wraps a payload of 8-bit samples in 188-byte packets: a program association table,
a program map table, and packetised elementary packets with presentation times, a program
clock and random-access marks.  ``demux`` reads any such stream back: it parses the program
tables (with their checksums), checks continuity counters, reassembles the elementary
packets and lists time stamps with their random-access points.  A damaged stream never
raises; its faults are counted.

The payload of a text is its UTF-8 bytes (null: empty) with bytes 0 up to a positive multiple
of 64, so equal texts give equal media.  Repeats, ties, extra columns and an empty table need
no special case; very long texts take more packets.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import byte_list, slices

PACKET, PID_MAP, PID_DATA, UNIT, TICKS = 188, 0x1000, 0x0100, 16_384, 3_600


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        c = n << 24
        for _ in range(8):
            c = (c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1
        out.append(c & 0xFFFFFFFF)
    return out


_CRC = _crc_table()


@lru_cache(maxsize=1024)
def section_crc(data: bytes) -> int:
    """The checksum of program tables; 0 over a whole correct section."""
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _section(table: int, key: int, body: bytes) -> bytes:
    data = struct.pack(">BHHBBB", table, 0xB000 | len(body) + 9, key, 0xC1, 0, 0) + body
    return data + struct.pack(">I", section_crc(data))


def _table_packet(pid: int, section: bytes) -> bytes:
    head = struct.pack(">BHBB", 0x47, 0x4000 | pid, 0x10, 0)
    return head + section + b"\xff" * (PACKET - len(head) - len(section))


_TABLES = np.frombuffer(
    _table_packet(0, _section(0, 1, struct.pack(">HH", 1, 0xE000 | PID_MAP)))
    + _table_packet(PID_MAP, _section(2, 1, struct.pack(">HH", 0xE000 | PID_DATA, 0xF000) + struct.pack(">BHH", 0x06, 0xE000 | PID_DATA, 0xF000))),
    dtype=np.uint8,
).reshape(2, PACKET)


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, pts >> 14 & 0xFE | 1, pts >> 7 & 0xFF, pts << 1 & 0xFE | 1])


def mux(payload: bytes, unit: int = UNIT, ticks: int = TICKS, key_every: int = 4) -> bytes:
    """One program with one elementary stream; a PES packet for every ``unit`` bytes."""
    packets, counter = [_TABLES], 0
    for k, at in enumerate(range(0, len(payload), unit)):
        pts = k * ticks & 0x1FFFFFFFF
        body = payload[at : at + unit]
        data = struct.pack(">3sBHBBB", b"\0\0\1", 0xBD, len(body) + 8, 0x84, 0x80, 5) + _stamp(pts) + body
        key = k % key_every == 0
        first = 8  # adaptation field with the clock: length, flags, 6 bytes
        n = 1 + max(0, -(-(len(data) - (184 - first)) // 184))
        out = np.full((n, PACKET), 0xFF, dtype=np.uint8)
        out[:, 0] = 0x47
        out[:, 1] = PID_DATA >> 8
        out[:, 2] = PID_DATA & 0xFF
        out[:, 3] = 0x10 | (counter + np.arange(n)) & 0x0F
        counter += n
        out[0, 1] |= 0x40
        out[0, 3] |= 0x20
        base = pts
        out[0, 4:12] = np.frombuffer(struct.pack(">BBIH", 7, 0x10 | 0x40 * key, base >> 1, (base & 1) << 15 | 0x7E00), dtype=np.uint8)
        raw = np.frombuffer(data, dtype=np.uint8)
        if n == 1:
            spare = 184 - first - len(raw)
            out[0, 4] = 7 + spare
            out[0, 12 + spare :] = raw
        else:
            head, last = 184 - first, (len(raw) - (184 - first)) - 184 * (n - 2)
            out[0, 12:] = raw[:head]
            out[1 : n - 1, 4:] = raw[head : head + 184 * (n - 2)].reshape(n - 2, 184)
            if spare := 184 - last:
                out[n - 1, 3] |= 0x20
                out[n - 1, 4] = spare - 1
                if spare > 1:
                    out[n - 1, 5] = 0
            out[n - 1, 4 + spare :] = raw[len(raw) - last :]
        packets.append(out)
    return np.concatenate(packets).tobytes()


@dataclass
class Stream:
    """What ``demux`` found in one transport stream."""

    payload: bytes = b""
    packets: int = 0
    programs: dict[int, dict[int, int]] = field(default_factory=dict)  # program -> pid -> stream type
    stamps: list[tuple[int, int, bool]] = field(default_factory=list)  # (pts, packet number, random access)
    lost_sync: int = 0
    table_errors: int = 0
    continuity_errors: int = 0
    pes_errors: int = 0


def _sections(chunks: list[bytes]) -> Iterator[bytes]:
    """Sections of a table PID whose chunks each begin at a pointer field."""
    for c in chunks:
        at = 1 + c[0] if c else 0
        while at + 3 <= len(c) and c[at] != 0xFF:
            size = 3 + (struct.unpack_from(">H", c, at + 1)[0] & 0xFFF)
            yield c[at : at + size]
            at += size


def demux(media: bytes, program: int | None = None) -> Stream:
    """Reads a stream back; ``program`` picks one of several (default: the first listed)."""
    out = Stream()
    whole = len(media) // PACKET
    grid = np.frombuffer(media, dtype=np.uint8, count=whole * PACKET).reshape(whole, PACKET)
    good = (grid[:, 0] == 0x47) & (grid[:, 1] & 0x80 == 0)
    out.lost_sync = int(whole - good.sum()) + (len(media) % PACKET > 0)
    number = np.flatnonzero(good)
    grid = grid[good]
    out.packets = len(grid)
    pid = (grid[:, 1].astype(np.int32) & 0x1F) << 8 | grid[:, 2]
    begins, control, counter = grid[:, 1] & 0x40 != 0, grid[:, 3] >> 4 & 3, grid[:, 3] & 15
    start = np.where(control & 2, np.minimum(5 + grid[:, 4].astype(np.int32), PACKET), 4)
    has = control & 1 == 1
    keyed = (control & 2 == 2) & (grid[:, 4] > 0) & (grid[:, 5] & 0x40 != 0)
    fresh = np.ones(len(grid), dtype=bool)
    for p in np.unique(pid):
        if p == 0x1FFF:
            continue
        mine = np.flatnonzero((pid == p) & has)
        step = (counter[mine[1:]].astype(np.int16) - counter[mine[:-1]]) & 15
        again = (step == 0) & (grid[mine[1:], 4:] == grid[mine[:-1], 4:]).all(axis=1)  # a repeat is allowed
        fresh[mine[1:][again]] = False
        out.continuity_errors += int(((step != 1) & ~again).sum())

    def chunks(p: int) -> list[bytes]:
        return [grid[i, start[i] :].tobytes() for i in np.flatnonzero((pid == p) & has & fresh & begins)]

    maps: dict[int, int] = {}
    for s in _sections(chunks(0)):
        if section_crc(s):
            out.table_errors += 1
        elif s[0] == 0:
            maps |= {a: b & 0x1FFF for a, b in struct.iter_unpack(">HH", s[8:-4]) if a}
    for number_, p in maps.items():
        for s in _sections(chunks(p)):
            if section_crc(s):
                out.table_errors += 1
            elif s[0] == 2 and struct.unpack_from(">H", s, 3)[0] == number_:
                at, streams = 12 + (struct.unpack_from(">H", s, 10)[0] & 0xFFF), {}
                while at + 5 <= len(s) - 4:
                    kind, to, extra = struct.unpack_from(">BHH", s, at)
                    streams[to & 0x1FFF] = kind
                    at += 5 + (extra & 0xFFF)
                out.programs[number_] = streams
    streams = out.programs.get(program) if program is not None else next(iter(out.programs.values()), None)
    if not streams:
        return out
    data = np.flatnonzero((pid == next(iter(streams))) & has & fresh)
    heads = np.flatnonzero(begins[data])
    if len(heads) == 0:
        return out
    taken = np.arange(PACKET) >= start[data][:, None]
    flat = grid[data][taken].tobytes()
    edge = np.concatenate([[0], np.cumsum(PACKET - start[data])])
    bodies = []
    for k, h in enumerate(heads):
        raw = flat[edge[h] : edge[heads[k + 1]] if k + 1 < len(heads) else edge[-1]]
        if raw[:3] != b"\0\0\1" or len(raw) < 9:
            out.pes_errors += 1
            continue
        size, flags, extra = struct.unpack_from(">H", raw, 4)[0], raw[7], raw[8]
        if size and len(raw) != size + 6:
            out.pes_errors += 1
        if flags & 0x80 and extra >= 5:
            a, b, c, d, e = raw[9:14]
            out.stamps.append(((a & 0x0E) << 29 | b << 22 | (c & 0xFE) << 14 | d << 7 | e >> 1, int(number[data[h]]), bool(keyed[data[h]])))
        bodies.append(raw[9 + extra : size + 6 if size else None])
    out.payload = b"".join(bodies)
    return out


def padded(text: bytes) -> bytes:
    return text + b"\0" * (-len(text) % 64 or 64 * (not text))


def describe(media: bytes, got: Stream) -> str:
    """Features of the stored form: structure, times, random-access points and sample moments."""
    x = np.frombuffer(got.payload, dtype=np.uint8)
    edges = int(np.count_nonzero(x[1:] != x[:-1]))
    keys = [f"{pts}@{at}" for pts, at, key in got.stamps if key]
    return (
        f"packets={got.packets};programs={len(got.programs)};pes={len(got.stamps)};last_pts={got.stamps[-1][0] if got.stamps else -1};"
        f"random_access={','.join(keys[:1] + keys[-1:])}/{len(keys)};continuity={got.continuity_errors};faults={got.lost_sync + got.table_errors + got.pes_errors};"
        f"sum={int(x.sum(dtype=np.int64))};square={int((x.astype(np.int64) ** 2).sum())};edges={edges}"
    )


def stored(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 8 << 20) -> DataFrame:
    """id, n_bytes (unpadded) and media (the transport stream) of each text."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", batch_bytes):
                raw = byte_list(b.column("text"))
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([len(r) for r in raw], type=pa.int64()), pa.array([mux(padded(r)) for r in raw], type=pa.binary())], names=[id_col, "n_bytes", "media"])

    return df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, media binary")


def read_back(df: DataFrame, id_col: str = "doc_id", batch_bytes: int = 8 << 20) -> DataFrame:
    """Digests, features, stamps and fault counts from the stored streams."""
    kind = df.schema[id_col].dataType.simpleString()
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "continuity_errors", "stamps"]
    stamp = pa.list_(pa.struct([("pts", pa.int64()), ("packet", pa.int64()), ("random_access", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "media", batch_bytes):
                rows = []
                for m in b.column("media").to_pylist():
                    s = demux(m)
                    rows.append((len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-64:]), len(m), hashlib.sha256(m).hexdigest(), describe(m, s), s.continuity_errors, [{"pts": p, "packet": n, "random_access": k} for p, n, k in s.stamps]))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), stamp]
                yield pa.RecordBatch.from_arrays([b.column(id_col), b.column("n_bytes"), *(pa.array(c, type=k) for c, k in zip(zip(*rows), kinds))], names=names)

    return df.select(id_col, "n_bytes", "media").mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, continuity_errors bigint, stamps array<struct<pts:bigint,packet:bigint,random_access:boolean>>")
