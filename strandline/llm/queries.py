"""The corpus queries, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embeddings, langid, media_ts, minhash, mixing, packing, secret_scan, suffixes, tokens, warc

from .common import small_batches


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_ts.read_back(media_ts.stored(table(spark, sf_dir, "documents")))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup_spans(table(spark, sf_dir, "documents"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.decided(table(spark, sf_dir, "pages"))
    back = warc.read_back(warc.normalised(warc.monolithic(rows)))
    return back.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary())


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.identified(docs, langid.trained(docs), keep=("doc_id",))
    return out.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "entropy", "accepted")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), vocabulary())


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.scanned(docs, secret_scan.learned(docs))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.words(F.col("text")).alias("size"))
    out = mixing.planned(docs, text_col="size", size=F.col("size"))
    return out.select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


#: the least node reachable over ``links`` (a, b) from each of ``nodes`` (node)
_CLOSURE = """reach AS (SELECT node, node AS root FROM nodes UNION SELECT r.node, CASE WHEN l.a = r.root THEN l.b ELSE l.a END FROM reach r JOIN links l ON r.root = l.a OR r.root = l.b),
        comp AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)"""
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL: dict[str, str] = {
    "op2_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        k0 AS MATERIALIZED (SELECT doc_id, p, md5_number(substr(h, 2 * p + 1, 100)) AS key FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS p FROM d WHERE length(h) >= 100)),
        g AS (SELECT key, min(doc_id) AS first_id FROM k0 GROUP BY key HAVING min(doc_id) < max(doc_id)),
        s AS (SELECT k0.doc_id, p AS a, p + 50 AS b FROM k0 JOIN g ON k0.key = g.key WHERE first_id < k0.doc_id),
        o AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY doc_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM s),
        k AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY a ROWS UNBOUNDED PRECEDING) AS span FROM o),
        m AS (SELECT doc_id, span, min(a) AS a, max(b) AS b FROM k GROUP BY ALL),
        q AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM m),
        r AS (SELECT q.doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM q JOIN d ON q.doc_id = d.doc_id GROUP BY q.doc_id)
        SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN r ON d.doc_id = r.doc_id""",
    "op3_minhash": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        t AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS sh FROM w),
        e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS sh FROM t),
        links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM e x JOIN e y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
        nodes AS (SELECT doc_id AS node FROM documents), {_CLOSURE}
        SELECT t.doc_id, len(sh)::BIGINT AS n_shingles, component_id, t.doc_id = component_id AS kept FROM t JOIN comp ON t.doc_id = comp.node""",
    "op10_embedding_dedup": f"""
        WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
        f AS (SELECT * FROM v WHERE len(list_filter(x, lambda c: c <> 0)) > 0),
        links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM f p JOIN f q ON p.label = q.label AND len(p.x) = len(q.x) AND p.vec_id < q.vec_id WHERE list_cosine_similarity(p.x, q.x) >= 0.98),
        nodes AS (SELECT vec_id AS node FROM embeddings), {_CLOSURE},
        n AS (SELECT node, count(*) AS n FROM (SELECT a AS node FROM links UNION ALL SELECT b FROM links) GROUP BY node)
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN comp ON vec_id = comp.node LEFT JOIN n ON vec_id = n.node""",
    "op4_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        d AS (SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM p),
        f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY 1)
        SELECT d.page_id, d.payload_bytes, d.payload_digest,
               CASE WHEN f.first_id IS NULL OR f.first_id = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN f.first_id <> d.page_id THEN f.first_id END AS refers_to
        FROM d LEFT JOIN f USING (payload_digest)""",
    "op9_mixing": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n,
                     [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT] AS weight FROM d GROUP BY source),
        l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3.0::DOUBLE * source_size) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS lvl,
                     ceil(n / 2000) AS chunks
              FROM s WINDOW b AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        t AS (SELECT *, least(3.0::DOUBLE * source_size, weight * max(CASE WHEN lvl * weight <= 3.0::DOUBLE * source_size THEN lvl END) OVER ()) AS target FROM l),
        k AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.source,
                     floor(('0x' || substr(md5(d.doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE * t.chunks) AS chunk
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY chunk, size DESC, doc_id) AS rank,
                     CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS each,
                     ('0x' || substr(md5(coalesce('s' || source, 'n') || '|mix'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM k)
        SELECT doc_id, size, source_size, target, (least(3, floor(u + rank * each) - floor(u + (rank - 1) * each)))::BIGINT * size AS taken FROM r""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
