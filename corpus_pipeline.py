"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next one's docs.  All but the last return the columns of documents.

1. language ID: documents that it rejects (no letters, or nothing like the languages learned) go;
2. MinHash near-dedup on shingles of five words at similarity 0.8: of each group the document with
   the least id stays (rows that share an id are one document);
3. secret scan: every secret found is replaced in the text, no document goes;
4. mixing: documents are repeated or left out so that each source comes near its target;
5. packing: token sequences of at most 2048 tokens, one row a piece.

An empty table passes every stage; a null or empty text is rejected by the first.  Where no language can be
learned (for instance all of lang is null) the first stage rejects only texts without letters.  Very
long texts are read whole by every stage.  Ties and repeated rows: of equal texts the least id stays,
rows that share an id stay or go together, and those of equal size are mixed in order of id.  Columns other than
those of documents are kept by all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import bloom, langid, minhash, mixing, packing, secret_scan
from strandline.llm.common import dropped, small_batches, written
from strandline.llm.queries import vocabulary


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return langid.accepted_only(docs, langid.trained(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = minhash.near_duplicates(docs, width=5, num=80, den=100)
    gone = written(found.filter(~F.col("kept")).select("doc_id").distinct())
    # rows that surely stay pass by; only those that may go meet the ids that go
    filter_ = bloom.built(gone, gone.count())
    sure, rest = (bloom.thinned(docs, "doc_id", filter_, inside) for inside in (False, True))
    return sure.unionAll(rest.join(gone, "doc_id", "left_anti").select(*docs.columns))


def secret_scan_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    out = secret_scan.cleaned(docs, secret_scan.learned(docs))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack_documents(docs, vocabulary())


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: language models, MinHash and tokenizers are beyond SQL; each stage is tested against brute force or against its
#: operator on one text at a time
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir))
        dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
