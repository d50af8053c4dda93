from __future__ import annotations

import gzip
import hashlib
import os
import zlib

from strandline.llm import media_ts, warc

from .conftest import edge_rows


def test_round_trip_of_every_length():
    for n in [*range(0, 600), 16383, 16384, 16385, 70_001]:
        payload = media_ts.padded(bytes(i * 7 % 251 for i in range(n)))
        assert len(payload) % 64 == 0 and payload
        got = media_ts.demux(media_ts.mux(payload))
        assert got.payload == payload
        assert not (got.continuity_errors or got.lost_sync or got.table_errors or got.pes_errors)


def test_stamps_and_random_access():
    got = media_ts.demux(media_ts.mux(b"x" * 100_000))
    assert [p for p, _, _ in got.stamps] == [k * media_ts.TICKS for k in range(7)]
    assert [k for _, _, k in got.stamps] == [True, False, False, False, True, False, False]
    assert got.programs == {1: {media_ts.PID_DATA: 6}}


def test_damage_is_counted():
    media = media_ts.mux(bytes(range(256)) * 100)
    assert media_ts.demux(media[: 188 * 10] + media[188 * 12 :]).continuity_errors == 1
    twice = media[: 188 * 11] + media[188 * 10 :]  # a repeated packet is allowed
    assert media_ts.demux(twice).continuity_errors == 0 and media_ts.demux(twice).payload == media_ts.demux(media).payload
    bad = bytearray(media)
    bad[10] ^= 1
    assert media_ts.demux(bytes(bad)).table_errors == 1
    assert media_ts.demux(b"").packets == 0 and media_ts.demux(media[:-3]).lost_sync == 1


def test_media_of_edge_rows(edges, nothing):
    rows = media_ts.read_back(media_ts.stored(edges)).collect()
    want = sorted((k is None, k or 0, (t or "").encode()) for k, t, *_ in edge_rows())
    assert len(rows) == len(want)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for _, k, raw in want:
        payload = media_ts.padded(raw)
        assert any(r.n_bytes == len(raw) and r.payload_bytes == len(payload) and r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:]) for r in by.get(k or None, by.get(k, [])))
    assert media_ts.read_back(media_ts.stored(nothing)).count() == 0


PAGES = "page_id bigint, url string, html string, id int, payload string"


def test_warc(spark):
    body = "<p>" + "x" * 200
    rows = [(3, "http://a/ b", body, 1, "p"), (1, None, body, 1, "p"), (2, "u", "short", 1, "p"), (4, "u", "short", 1, "p"), (5, "u", None, 1, "p"), (6, "", "", 1, "p"), (7, "u", "é" * 50 + "\r\n\r\nWARC/1.1\r\n", 1, "p"), (8, "u", body * 3000, 1, "p")]
    df = spark.createDataFrame(rows, PAGES).repartition(3)
    archives = warc.normalised(warc.monolithic(warc.decided(df), archive_bytes=1000))
    got = {r.record_id: r for r in warc.read_back(archives).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6, 7, 8] and all(r.intact for r in got.values())
    assert (got[3].record_type, got[3].refers_to) == ("revisit", 1)
    assert all(got[k].record_type == "response" and got[k].refers_to is None for k in (1, 2, 4, 5, 6, 7, 8))
    for k, _, html, *_ in rows:
        raw = (html or "").encode()
        assert got[k].payload_bytes == len(raw) and got[k].payload_digest == hashlib.sha256(raw).hexdigest()
    assert warc.read_back(warc.normalised(warc.monolithic(warc.decided(spark.createDataFrame([], PAGES))))).count() == 0


def test_archive_and_sidecar_files(spark, tmp_path):
    rows = [(i, "u", f"page {i} " * 40) for i in range(30)] + [(30, "u", "x" * 5_000_000)]
    made = warc.normalised(warc.monolithic(warc.decided(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(2)), archive_bytes=4_000))
    files = warc.write_files(made, str(tmp_path)).collect()
    assert len(files) > 2 and sum(f.records for f in files) == 31
    for f in files:
        assert os.path.getsize(f.path) == f.bytes
        lines = [line.split("\t") for line in open(f.path + ".idx", encoding="utf-8").read().splitlines()]
        data = open(f.path, "rb").read()
        for offset, length, key in lines:  # any reader can seek to one record
            assert f"urn:strandline:{key}>".encode() in zlib.decompress(data[int(offset) : int(offset) + int(length)], 31)
    again = warc.read_back(warc.read_files(spark, str(tmp_path))).collect()
    assert sorted((r.record_id, r.payload_bytes) for r in again) == sorted((k, len(t)) for k, _, t in rows) and all(r.intact for r in again)


def test_normaliser_takes_any_gzip():
    records = [warc.record_bytes(str(i), "u", "d", "response", "x", 3, b"abc" * i, None) for i in range(50)]
    whole, index = warc.normalise(gzip.compress(b"".join(records)))
    assert [k for *_, k in index] == [str(i) for i in range(50)]
    assert [zlib.decompress(whole[o : o + n], 31) for o, n, _ in index] == records
    again, same = warc.normalise(whole)  # members already: nothing changes
    assert again == whole and same == index
