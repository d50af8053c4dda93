from __future__ import annotations

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from strandline.llm import bloom, embeddings, graph, minhash, shingles, suffixes

from .conftest import edge_rows, words


def roots(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute_links(rows, width, num, den):
    sets = collections.defaultdict(list)
    for k, t in rows:
        w = (t or "").encode().lower().split()
        n = min(width, len(w))
        sets[k].append(frozenset(b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset())
    ids = sorted(k for k in sets if k is not None)
    edges = [(a, b) for a in ids for b in ids if a < b for x in sets[a] for y in sets[b] if x and y and den * len(x & y) >= num * len(x | y)]
    return sets, roots(ids, edges)


def near_group(n: int, size: int = 80, changes: int = 4) -> list[tuple[int, str]]:
    """Copies of one text with some words changed: some pairs link, some do not."""
    base, rng = words(77, size).split(), random.Random(9)
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, changes)):
            w[rng.randrange(size)] = f"w{rng.randrange(10**6)}"
        out.append((1000 + i, " ".join(w)))
    return out


@pytest.mark.parametrize(("width", "num", "most_chunks"), [(3, 85, 16), (5, 80, 16), (3, 85, 1)])
def test_minhash_against_brute_force(spark, edges, width, num, most_chunks):
    df = edges.unionByName(spark.createDataFrame(near_group(150), "doc_id bigint, text string"), allowMissingColumns=True)
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    sets, want = brute_links(rows, width, num, 100)
    got = minhash.near_duplicates(df, width=width, num=num, chunk=20, most_chunks=most_chunks).collect()  # groups go in pairs of chunks, or bucket by bucket
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
            assert r.n_shingles in {len(s) for s in sets[r.doc_id]}


def test_minhash_of_nothing(nothing):
    assert minhash.near_duplicates(nothing).count() == 0


def test_circulant_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 1500).astype(np.uint64)
    a, b = np.unique(x[:1200]), np.unique(x[300:])
    j = 900 / 1500
    assert abs((minhash.signature(a) == minhash.signature(b)).mean() - j) < 0.15
    table = minhash.shifted(140)
    assert (table[5][1:] == table[6][:-1]).all()  # each coordinate is the same permutation, one place on
    assert sorted(table[:, 0]) == list(range(1 << minhash.UNIVERSE_BITS))


def test_bloom_filter(spark):
    rows = spark.createDataFrame([(i if i else None, str(i)) for i in range(3000)], "x bigint, word string").repartition(3)
    f = bloom.built(rows.filter("x % 10 = 3").select("x"), 300)
    inside = {r.x for r in bloom.thinned(rows, "x", f).collect()}
    outside = {r.x for r in bloom.thinned(rows, "x", f, inside=False).collect()}
    assert {x for x in range(1, 3000) if x % 10 == 3} <= inside and len(inside) < 600
    assert not inside & outside and len(inside) + len(outside) == 3000 and None in outside
    assert bloom.thinned(rows, "x", bloom.built(rows.filter("false").select("x"), 0)).count() == 0


def test_shingles():
    assert len(shingles.shingle_set(b"", 3)) == 0 and len(shingles.shingle_set(b" \t\x0b\x0c\r\n", 3)) == 0
    assert len(shingles.shingle_set(b"A b", 3)) == 1
    assert (shingles.shingle_set(b"A b c D", 3) == shingles.shingle_set(b"a B  c\nd", 3)).all()
    assert (shingles.shingle_set("É b c".encode(), 3) != shingles.shingle_set("é b c".encode(), 3)).all()  # only A-Z fold


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(64)] + [(5000, 6000 + i) for i in range(50)]
    nodes = {x for e in edges for x in e}
    want = roots(nodes, edges)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got.get(n, n) == want[n] for n in nodes)
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def brute_spans(rows):
    """Removed bytes by definition."""
    first: dict[bytes, int] = {}
    out = []
    for k, t in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        raw = (t or "").encode()
        for p in range(len(raw) - 49):
            first.setdefault(raw[p : p + 50], k)
    for k, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 49):
            if first[raw[p : p + 50]] < k:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for i in range(len(raw)) if gone[i] and not (i and gone[i - 1]))
        out.append((k, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_spans_against_brute_force(spark, edges, nothing):
    more = near_group(60) + [(2000 + i, words(i, 20) + " " + "common passage that many documents of the table share word for word " + words(i + 500, 20)) for i in range(40)]
    more += [(3000, "ab" * 100), (3001, "x" + "ab" * 80), (3002, "z" * 49), (3003, "z" * 50), (3004, "z" * 50), (3005, "z" * 51)]
    more += [(3010, words(900, 40)), (3010, words(901, 40)), (3011, words(901, 40)), (3012, words(900, 40) + " end")]  # two texts of one id
    df = edges.unionByName(spark.createDataFrame(more, "doc_id bigint, text string"), allowMissingColumns=True).repartition(5)
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = suffixes.dedup_spans(df, with_text=True).collect()
    assert sorted(tuple(r)[:5] for r in got if r.doc_id is not None) == brute_spans([r for r in rows if r[0] is not None])
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)
    assert [r.n_removed for r in got if r.doc_id is None] == [0]
    assert suffixes.dedup_spans(nothing).count() == 0


def test_least_ids_by_cover_ranks():
    rng = random.Random(4)
    for alphabet in (b"ab", b"abcdefgh"):
        unit = bytes(rng.choices(alphabet, k=90))
        text, starts, ids = b"", [], []
        for d in range(40):
            piece = unit[rng.randrange(20) :] if d % 2 else bytes(rng.choices(alphabet, k=70))
            starts += [len(text) + i for i in range(len(piece) - 49)]
            ids += [d] * (len(piece) - 49)
            text += piece
        starts, ids = np.array(starts), np.array(ids)
        want = {}
        for s, d in zip(starts, ids):
            want[text[s : s + 50]] = min(want.get(text[s : s + 50], d), d)
        for bucket, rounds in ((1 << 20, 3), (64, 3), (1 << 20, 0)):  # one range of heads, many, and all ties by every sample
            got = suffixes.least_ids(np.frombuffer(text, dtype=np.uint8), starts, ids, bucket, rounds)
            assert got.tolist() == [want[text[s : s + 50]] for s in starts]


def test_cover_ranks_are_the_order_of_the_bytes():
    rng = random.Random(5)
    text = bytes(rng.choices(b"ab", k=30)) * 20 + bytes(rng.choices(b"abc", k=400))
    starts = np.arange(0, len(text) - 49, 3)
    word = suffixes.words_at(np.frombuffer(text + b"\0" * 64, dtype=np.uint8), len(text))
    rank = suffixes.cover_ranks(word, starts)
    places = [p for p in range(len(text) - 37) if p % 13 in suffixes.COVER and any(s <= p < s + 13 for s in starts.tolist())]
    parts = {p: text[p : p + 38] for p in places}
    order = sorted(set(parts.values()))
    assert [rank[p] for p in places] == [order.index(parts[p]) for p in places]
    for a in range(13):
        for b in range(13):
            d = int(suffixes.MEET[a, b])
            assert d <= 12 and (a + d) % 13 in suffixes.COVER and (b + d) % 13 in suffixes.COVER


def test_head_and_tail_alike():
    """Strings that differ only between the bytes sorted first and last, so samples must tell them apart."""
    rng = random.Random(7)
    texts = [b"h" * 12 + bytes(rng.choices(b"xy", k=3)).rjust(26, b"-") + b"t" * 12 for _ in range(200)]
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    got = suffixes.least_ids(raw, np.arange(200) * 50, np.arange(200))
    assert got.tolist() == [texts.index(t) for t in texts]


def test_long_runs_take_part_with_one_period(spark):
    assert [suffixes.period(np.frombuffer(x, dtype=np.uint8)) for x in (b"a" * 200, b"abc" * 70, b"a" * 199 + b"b")] == [1, 3, 0]
    texts = [(1, "=" * 2_000_000), (2, "x" + "=" * 1_000_000 + "y"), (3, "ab" * 6_000), (4, "ba" * 5_000 + "end of it"), (5, "=" * 49 + "!")]
    got = suffixes.dedup_spans(spark.createDataFrame(texts, "doc_id bigint, text string"))
    assert sorted((r.doc_id, r.n_removed, r.n_spans) for r in got.collect()) == [(1, 0, 0), (2, 1_000_000, 1), (3, 0, 0), (4, 10_000, 1), (5, 0, 0)]


def test_a_run_of_20_mb_is_bounded():
    import resource

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    raw = np.full(20 << 20, 61, dtype=np.uint8)
    number, low, high, h = suffixes.anchors([raw.tobytes()])
    assert len(h) < 6_000
    length = high - low + 50
    text = np.full(int(length.sum()), 61, dtype=np.uint8)
    out = suffixes.gone(text, length, np.arange(len(h)) % 2, h)
    want = np.repeat(np.arange(len(h)) % 2 == 1, high - low + 1)
    assert (out == want).all()
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_500_000


def test_every_long_string_elects_a_gram():
    rng = random.Random(6)
    texts = [bytes(rng.choices(b"abc", k=rng.randint(0, 400))) for _ in range(30)] + [b"a" * 300]
    number, low, high, gram = suffixes.anchors(texts)
    elected = {}
    for i, t in enumerate(texts):
        mine = [(a, b, g) for k, a, b, g in zip(number, low, high, gram) if k == i]
        assert sorted(s for a, b, _ in mine for s in range(a, b + 1)) == list(range(max(0, len(t) - 49)))
        for a, b, g in mine:
            for s in range(a, b + 1):
                assert elected.setdefault(t[s : s + 50], g) == g  # equal strings elect equal grams
    assert (number == 30).sum() == 1  # a run is one stretch


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((30, 16))
    rows = []
    for i in range(300):
        v = base[i % 30] + rng.standard_normal(16) * (0.0 if i % 7 == 0 else 0.12)
        rows.append((i, [float(x) for x in v], i % 3 if i % 11 else None))
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] * 16, 1), (503, [1.0, None] * 8, 1), (504, [1.0, 2.0], 1), (505, [2.0, 4.0], 1), (506, [1.0, 2.0], 2), (507, [float("inf")] + [1.0] * 15, 1), (508, [], 1), (None, [1.0, 2.0], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<double>, label int, v string")
    good = {k: (np.array(v), label) for k, v, label in rows if k is not None and v and None not in v and np.isfinite(np.array(v, dtype=float)).all() and np.any(v) and label is not None}
    edges = [(a, b) for a in good for b in good if a < b and good[a][1] == good[b][1] and len(good[a][0]) == len(good[b][0]) and good[a][0] @ good[b][0] / np.linalg.norm(good[a][0]) / np.linalg.norm(good[b][0]) >= 0.98]
    n = collections.Counter(x for e in edges for x in e)
    want = roots([k for k, *_ in rows if k is not None], edges)
    for block in (2048, 20):
        got = embeddings.near_duplicates(df, block=block).collect()
        assert len(got) == len(rows)
        for r in got:
            if r.vec_id is not None:
                assert (r.n_links, r.component_id, r.kept) == (n[r.vec_id], want[r.vec_id], want[r.vec_id] == r.vec_id)
    assert len(edges) > 100
    assert embeddings.near_duplicates(df.filter("false")).count() == 0


def test_vectors_of_any_magnitude(spark):
    base = np.random.default_rng(2).standard_normal(12)
    rows = [(i, (base * f).tolist(), 1) for i, f in enumerate((1.0, 1e200, 1e-200, 3e307 / np.abs(base).max(), 1e-300))] + [(9, (-base).tolist(), 1)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {**{i: (4, 0) for i in range(5)}, 9: (0, 9)}


def test_minhash_of_very_long_texts(spark):
    text = words(1, 300_000)
    rows = [(1, text), (2, text + " and more"), (3, " ".join(text.split()[:200_000])), (4, text.upper())]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), chunk_bytes=1 << 20).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 3, 4: 1}


def test_a_chain_of_weak_collisions_stays_apart(spark):
    """Neighbours share most words and collide, but none is similar enough: every one is its own component."""
    w = words(5, 700).split()
    rows = [(i, " ".join(w[12 * i : 12 * i + 100])) for i in range(50)]
    _, want = brute_links(rows, 3, 85, 100)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), chunk=4).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_one_dimension_and_windows():
    a, b = embeddings.linked(np.array([[1.0], [-2.0]]), np.array([[3.0], [-1.0]]), 0.98)
    assert sorted(zip(a, b)) == [(0, 0), (1, 1)]
    q, v = np.array([0.0, 0.5]), np.array([0.3, -0.1, 0.45, 2.0])
    assert embeddings.windows(q, v, 0.2).tolist() == [[0, 1, 0, 0], [1, 0, 1, 0]]


def test_edge_rows_have_each_case():
    texts = [t for _, t, *_ in edge_rows()]
    assert None in texts and "" in texts and max(map(len, filter(None, texts))) > 100_000


def test_fixture_ids_are_kept(edges):
    assert edges.filter(F.col("doc_id").isNull()).count() == 1
