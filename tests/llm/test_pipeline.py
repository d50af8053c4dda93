from __future__ import annotations

import hashlib
import importlib.util
import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from .conftest import words
from .test_near_copies import brute_links, near_group

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline is not there")
def test_pipeline(spark, edges, nothing):
    import corpus_pipeline as C

    assert 4 <= len(C.STAGES) <= 5
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    sizes = []
    for name, stage in C.STAGES[:-1]:
        docs = C.written(stage(spark, docs, DATA))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        sizes.append(docs.count())
    assert sizes[1] < sizes[0] and sizes[2] == sizes[1]
    assert C.run(spark, DATA).count() > 0
    for df in (edges, nothing):
        for _, stage in C.STAGES:
            df = C.written(stage(spark, df, DATA))
        assert df.columns[:3] == ["doc_id", "start", "length"]


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline is not there")
def test_no_language_to_learn(spark):
    import corpus_pipeline as C

    rows = [(1, "plain words stay", None), (2, None, None), (3, "", None), (4, "12 _ 3", None), (5, "été", None), (6, "² ½", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert sorted(r.doc_id for r in C.language_id(spark, docs, DATA).collect()) == [1, 5]


pipeline = pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline is not there")


def rows_of(df):
    return sorted(map(repr, df.collect()))


@pipeline
def test_language_stage_against_each_text_alone(spark, edges):
    import corpus_pipeline as C
    from strandline.llm import langid

    docs = spark.read.parquet(f"{DATA}/documents.parquet").unionByName(edges.select("doc_id", "text", "lang", "source", F.lit(None).cast("long").alias("n_chars")))
    scorer = langid.Scorer(langid.trained(docs))
    want = [r for r in docs.collect() if scorer.predict([r.text or ""])[0][3]]
    assert rows_of(C.language_id(spark, docs, DATA)) == sorted(map(repr, want)) and len(want) > 90


@pipeline
def test_near_dedup_stage_against_brute_force(spark, edges):
    import corpus_pipeline as C

    docs = edges.unionByName(spark.createDataFrame(near_group(80), "doc_id bigint, text string"), allowMissingColumns=True)
    rows = docs.collect()
    _, root = brute_links([(r.doc_id, r.text) for r in rows], 5, 80, 100)
    want = [r for r in rows if r.doc_id is None or root[r.doc_id] == r.doc_id]
    assert rows_of(C.near_dedup(spark, docs, DATA)) == sorted(map(repr, want)) and len(want) < len(rows) - 5


@pipeline
def test_secret_stage_against_each_text_alone(spark, edges):
    import corpus_pipeline as C
    from strandline.llm import secret_scan

    models = secret_scan.learned(edges)
    want = {(r.doc_id, r.size): r.text if r.text is None else secret_scan.redacted(r.text, secret_scan.scan(r.text, models)) for r in edges.collect()}
    got = C.secret_scan_stage(spark, edges, DATA).collect()
    assert {(r.doc_id, r.size): r.text for r in got} == want and all(r.n_chars is None if r.text is None else r.n_chars == len(r.text) for r in got)
    assert any("[SECRET]" in t for t in want.values() if t)


def brute_mix(rows, chunk_rows, weights=(5.0, 2.0, 1.0), most=3.0):
    """Copies of each (id, source, words): shares are filled one source at a time, then one offset a
    source and integer boundaries of the running expectation."""
    names = sorted({s for _, s, _ in rows if s is not None}) + [None] * any(s is None for _, s, _ in rows)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total = {s: sum(n for _, x, n in rows if x == s) for s in names}
    target, open_ = {}, set(names)
    while True:
        left = sum(total.values()) - sum(target.values())
        level = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if weight[s] * level > most * total[s]}
        if not above:
            break
        target |= {s: most * total[s] for s in above}
        open_ -= above
    target |= {s: weight[s] * level for s in open_}
    unit = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:8], 16) / 2**32
    out = {}
    for s in names:
        mine = [(k, n) for k, x, n in rows if x == s]
        chunks = -(-len(mine) // chunk_rows)
        mine.sort(key=lambda r: (int(unit(str(r[0])) * chunks), -r[1], r[0]))
        offset = unit("n|mix" if s is None else f"s{s}|mix")
        each = target[s] / total[s] if total[s] else 0.0
        for i, (k, _) in enumerate(mine):
            out[k] = math.floor(offset + (i + 1) * each) - math.floor(offset + i * each)
    return out, target, total


@pipeline
def test_mixing_stage_against_brute_force(spark):
    import corpus_pipeline as C

    rng = random.Random(4)
    rows = [(i, words(i, rng.randint(0, 60)), rng.choice(["a", "b", "b", "b", "c", None])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)
    want, target, total = brute_mix([(k, s, len(t.split())) for k, t, s in rows], 2_000)
    got = Counter(r.doc_id for r in C.mixing_stage(spark, docs, DATA).collect())
    assert {k: n for k, n in want.items() if n} == dict(got)
    size = {k: len(t.split()) for k, t, _ in rows}
    for s in target:
        taken = sum(got[k] * size[k] for k, _, x in rows if x == s)
        assert abs(taken - target[s]) <= 3 * max(size.values()) and target[s] <= 3 * total[s] + 1e-6


@pipeline
def test_packing_stage_against_one_partition(spark):
    import corpus_pipeline as C
    from strandline.llm import packing, tokens
    from strandline.llm.queries import vocabulary

    docs = spark.createDataFrame([(i, words(i, 1 + 53 * i % 700)) for i in range(120)], "doc_id bigint, text string").coalesce(1)
    order = docs.collect()
    ids = [np.append(x, np.uint32(1)) for x in tokens.Transducer(vocabulary()).ids([r.text for r in order])]
    want = sorted((order[i].doc_id, s, n, zlib.crc32(ids[i][s : s + n].astype("<u4").tobytes()), len(ids[i]), w, o) for i, s, n, w, o in packing.pack([len(x) for x in ids]))
    got = C.packing_stage(spark, docs, DATA).collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, r.sequence_id, r.offset) for r in got) == want


def test_shared_folder(spark):
    from strandline.llm.common import dropped, shared_dir, written

    df = written(spark.range(10).toDF("x"))
    assert shared_dir(spark) in df.inputFiles()[0] and df.count() == 10
    path = df._strandline_path.removeprefix("file:").removeprefix("//")
    dropped(df)
    assert not os.path.exists(path)
