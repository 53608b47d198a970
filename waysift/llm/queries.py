"""The registered queries opN_<name> over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, hnsw, langid, mjpeg, packing, quality, simhash, substrings, toxicity, warc
from .common import fold, read


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return bpe.digest(bpe.decode(encoded, path))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), "toxic", 3, 1, at=0.7)
    return quality.score(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.train(docs, fold("doc_id", 5) != 0)
    return langid.predict(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "rejected")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.dedup(read(spark, sf_dir, "documents"), length=50)
    return found.select("doc_id", "n_words", "n_removed", F.coalesce(F.sha2("kept", 256), F.lower(F.hex("digest"))).alias("kept_sha256"))


def op5_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records, audited against a replica in which records with id % 97 = 5 have lost their page's first character to a #."""
    pages = read(spark, sf_dir, "pages")
    own = warc.records(pages)
    rotten = F.when(F.col("page_id") % 97 == 5, F.concat(F.lit("#"), F.substr("html", F.lit(2)))).otherwise(F.col("html"))
    found = warc.audit(own, warc.records(pages.withColumn("html", rotten)))
    odd = found.select(F.col("record_id").alias("id"), F.col("nth").alias("k"), "status").hint("merge")
    return own.join(odd, F.col("record_id").eqNullSafe(F.col("id")) & (F.col("nth") == F.col("k")), "left").select(F.col("record_id").alias("page_id"), "file", "offset", "n_bytes", "digest", F.coalesce("status", F.lit("intact")).alias("status"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(read(spark, sf_dir, "embeddings"), threshold=0.95)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.train(docs, read(spark, sf_dir, "labels"), "quality", 5, 0, at=0.3)
    return quality.score(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op9_mjpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mjpeg.digest(mjpeg.clips(mjpeg.store(read(spark, sf_dir, "documents"))))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), size=3, budget=2, seed=42)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_toxicity": op2_toxicity,
    "op3_language_id": op3_language_id,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_warc_fixity": op5_warc_fixity,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_quality": op7_quality,
    "op8_packing": op8_packing,
    "op9_mjpeg": op9_mjpeg,
    "op10_simhash": op10_simhash,
}

ORACLE_SQL: dict[str, str] = {
    "op4_substring_dedup": r"""
WITH n AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM n),
g AS (SELECT doc_id, p, md5(string_agg(word, ' ') OVER s) AS h, count(*) OVER s AS k FROM w WINDOW s AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
m AS (SELECT h, min(doc_id) AS first FROM g WHERE k = 50 GROUP BY h),
d AS (SELECT g.doc_id, g.p FROM g JOIN m USING (h) WHERE k = 50 AND first < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS p FROM d),
kept AS (SELECT w.doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY p) AS text FROM w ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT n.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n_kept, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM n LEFT JOIN kept USING (doc_id)""",
    "op5_warc_fixity": r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS a, CASE WHEN page_id % 97 = 5 THEN '#' || substr(coalesce(html, ''), 2) ELSE coalesce(html, '') END AS b FROM pages),
h AS (SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'WARC-Date: 2024-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Block-Digest: sha256:' AS x, chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' AS y, chr(13) || chr(10) || chr(13) || chr(10) AS z, a, b FROM p),
r AS (SELECT page_id, x || sha256(a) || y || strlen(a) || z || a || z AS ra, x || sha256(b) || y || strlen(b) || z || b || z AS rb FROM h),
o AS (SELECT page_id, page_id // 1000 AS file, strlen(ra) AS n_bytes, sha256(ra) AS digest, sha256(rb) AS other, sum(strlen(ra)) OVER w - strlen(ra) AS off_a, sum(strlen(rb)) OVER w - strlen(rb) AS off_b FROM r WINDOW w AS (PARTITION BY page_id // 1000 ORDER BY page_id ROWS UNBOUNDED PRECEDING))
SELECT page_id, file, off_a::BIGINT AS "offset", n_bytes, digest, CASE WHEN digest <> other THEN 'corrupt' WHEN off_a <> off_b THEN 'moved' ELSE 'intact' END AS status FROM o""",
    "op6_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, CASE WHEN len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN list_transform(embedding, lambda x: x::DOUBLE) END AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT c.vec_id, (SELECT count(*) FROM l WHERE l.a = c.vec_id) AS n_links, component_id, c.vec_id = component_id AS kept FROM c""",
}
