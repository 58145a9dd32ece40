"""The contract queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embedding_dedup, exact_dedup, minhash_dedup, packing, pii, quality, suffix_dedup, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings")).drop("class_id")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    told = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select("doc_id", *[count(k) for k in pii.KINDS], F.sha2(told("base"), 256).alias("base_sha256"), told("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents")).drop("locator")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = warc.round_trip(table(spark, sf_dir, "pages"))
    revisit = F.col("main.type") == "revisit"
    return t.select(
        warc.page_of(F.col("metadata.fields"), "long").alias("page_id"),
        F.when(revisit, F.col("original.payload_bytes")).otherwise(F.col("main.payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("original.payload_sha1")).otherwise(F.col("main.payload_sha1")).alias("payload_digest"),
        F.col("main.type").alias("record_type"),
        warc.page_of(F.col("original.fields"), "long").alias("refers_to"),
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), keep_ids=False)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    shared = bpe.shared_codec(docs)
    ids = bpe.encode(docs, shared=shared)
    back = bpe.decode(ids, shared=shared)
    return back.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = suffix_dedup.repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return r.select(
        "doc_id", "n_bytes",
        F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("spans").isNull(), 0).otherwise(F.size("spans")).cast("long").alias("n_spans"),
        F.coalesce(F.sha2("kept", 256), F.col("text_sha256")).alias("kept_sha256"),
        "n_passages",
    )


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80).drop("class_id")


OP3_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (
  SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm
)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""

OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND list_count(embedding) = len(embedding) AND isfinite(list_sum(embedding))
    AND (list_min(embedding) <> 0 OR list_max(embedding) <> 0)
), l AS (
  SELECT a.vec_id AS src, b.vec_id AS dst FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), r(node, reach) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT r.node, l.dst FROM r JOIN l ON r.reach = l.src
), c AS (SELECT node, min(reach) AS component_id FROM r GROUP BY node),
d AS (SELECT src, count(*) AS n FROM l GROUP BY src)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON e.vec_id = c.node LEFT JOIN d ON e.vec_id = d.src
"""

OP4_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages
), m AS (SELECT html, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY html)
SELECT p.page_id, p.n AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN m.top IS NULL OR m.top = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN m.top <> p.page_id THEN m.top END AS refers_to
FROM p LEFT JOIN m ON p.html = m.html AND p.n >= 1000
"""

OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(
    string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
    lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[]
      WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]) END) AS sh
    FROM w)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (
  SELECT src, dst FROM (SELECT a.doc_id AS src, b.doc_id AS dst, count(*) AS n_both FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2) p
  JOIN n x ON x.doc_id = src JOIN n y ON y.doc_id = dst
  WHERE 100 * n_both >= 80 * (x.n + y.n - n_both)
), r(node, reach) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.node, l.dst FROM r JOIN l ON r.reach = l.src
), c AS (SELECT node, min(reach) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON d.doc_id = c.node LEFT JOIN n ON d.doc_id = n.doc_id
"""

OP9_SQL = r"""
WITH b AS (
  SELECT doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), w AS (
  SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 800)) AS k FROM (SELECT doc_id, h, unnest(range(n - 399)) AS i FROM b WHERE n >= 400)
), r AS (
  SELECT doc_id, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)
), g AS (
  SELECT doc_id, i, sum(CASE WHEN i > before + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run
  FROM (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) AS before FROM r)
), s AS (
  SELECT doc_id, run, min(i) AS a, max(i) + 400 AS z FROM g GROUP BY doc_id, run
), o AS (
  SELECT doc_id, run, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY run), 0) AS from_, lead(a) OVER (PARTITION BY doc_id ORDER BY run) IS NULL AS last_ FROM s
), k AS (
  SELECT o.doc_id, count(*) AS n_spans, sum(z - a)::BIGINT AS n_removed,
         string_agg(substr(h, 2 * from_ + 1, 2 * (a - from_)), '' ORDER BY run) || max(CASE WHEN last_ THEN substr(h, 2 * z + 1) END) AS kept
  FROM o JOIN b ON o.doc_id = b.doc_id GROUP BY o.doc_id
), q AS (
  SELECT doc_id, list_filter(string_split_regex(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM b
), v AS (
  SELECT doc_id, i, md5_number(array_to_string(ws[i:i + 50], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 49)) AS i FROM q WHERE len(ws) >= 51)
), vr AS (
  SELECT doc_id, i FROM v WHERE k IN (SELECT k FROM v GROUP BY k HAVING min(doc_id) <> max(doc_id))
), p AS (
  SELECT doc_id, sum(CASE WHEN i > before + 51 THEN 1 ELSE 0 END)::BIGINT AS n_passages
  FROM (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) AS before FROM vr) GROUP BY doc_id
)
SELECT b.doc_id, b.n::BIGINT AS n_bytes, coalesce(k.n_removed, 0)::BIGINT AS n_removed, coalesce(k.n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(k.kept, h))) AS kept_sha256, coalesce(p.n_passages, 0)::BIGINT AS n_passages
FROM b LEFT JOIN k ON b.doc_id = k.doc_id LEFT JOIN p ON b.doc_id = p.doc_id
"""

QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_pii": op2_pii,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_warc": op4_warc,
    "op5_toxicity": op5_toxicity,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_quality": op7_quality,
    "op8_bpe": op8_bpe,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_minhash_dedup": op10_minhash_dedup,
}

ORACLES = {
    "op10_minhash_dedup": OP10_SQL,
    "op1_embedding_dedup": OP1_SQL,
    "op3_exact_dedup": OP3_SQL,
    "op4_warc": OP4_SQL,
    "op9_suffix_dedup": OP9_SQL,
}
