"""The corpus pipeline: quality, language, near-duplicates, repeated passages, packing.

Joins of documents with what an operator found about them are merge joins at every
size: what was found grows with the documents, so it is never broadcast.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waysift.llm import langid, packing, quality, simhash, substrings
from waysift.llm.common import bucketed, fold, read, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.3 or more stay."""
    model = quality.train(docs, read(spark, sf_dir, "labels"), "quality", 5, 0, at=0.3)
    return quality.score(docs, model, also=COLUMNS[2:]).filter("score >= 0.3").select(COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents near enough to a language's centroids stay."""
    model = langid.train(docs, fold("doc_id", 5) != 0)
    return langid.predict(docs, model, also=COLUMNS[2:]).filter("not rejected").select(COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with a similarity of 0.8 or more on shingles of five words one stays: that with the smallest id, of those without id or of one id the first row. Rows have keys of their own here, as ids may repeat or be null."""
    rows = bucketed(docs.select(COLUMNS).withColumn("row", F.monotonically_increasing_id()), "row", "rows")
    found = simhash.similar(rows, size=5, similarity=0.8, id_col="row", stored=True).withColumnRenamed("doc_id", "row")
    ids = rows.select("row", "doc_id").join(found.hint("merge"), "row")
    first = table(ids.groupBy("component_id").agg(F.min_by("row", F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("row")).select("row"), "first")
    return rows.join(first.hint("shuffle_hash"), "row", "left_semi").select(COLUMNS)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages of 50 words or more that an earlier document has go; what else a text has stays as it is. Rows of one id are told apart by their words."""
    found = substrings.dedup(docs).filter("n_removed > 0").select("doc_id", "digest", "kept").distinct()
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    cut = docs.select(*COLUMNS, F.unhex(F.sha2(words, 256)).alias("digest")).join(found.hint("merge"), ["doc_id", "digest"], "left")
    text = F.coalesce("kept", "text")
    return cut.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("kept").isNull(), F.col("n_chars")).otherwise(F.length(text)).cast("long").alias("n_chars"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a sequence of at most 1,024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("quality classifier", quality_stage), ("language ID", language_stage), ("SimHash near-dedup", near_duplicate_stage), ("substring dedup", substring_stage), ("packing", packing_stage)]

#: Trained models and token packing have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = table(docs, f"stage{k}")
    return docs
