"""Token counts through a digest cache."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirespark.llm.columns import spaced, whole_text
from quirespark.llm.exact_dedup import frequent_digests
from quirespark.llm.shared import bounded_batches, written
from quirespark.llm.tokenization import encoder, file_digest, text_bytes

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"


def counter(vocabulary: str):
    """A column function: the number of ids of each text."""

    @F.arrow_udf("long")
    def n_tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([len(ids) // 4 for ids in encoder(vocabulary).encode(text_bytes(texts))], pa.int64())

    return n_tokens


def _stored(spark, cache: str, version: str) -> DataFrame:
    """What the cache holds for a tokenizer version; a count that two runs have appended is read once."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = spark.createDataFrame([], CACHE_SCHEMA)
    return rows.filter(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, vocabulary: str, cache: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Normalised content (each run of ASCII white space as one space: this keeps the ids) is joined by digest to the counts
    that `cache`, a Parquet table in shared storage, holds for this version of the tokenizer (the digest of its file).
    Only distinct contents without a stored count are encoded, and their counts are appended; the result then reads the
    cache alone. Copies of a text are dropped before the shuffle by the map-side part of the aggregation, so a hot group
    sends one text per map task. The counts of frequent digests (a bounded number) are broadcast to their rows; all other
    rows meet their counts in a shuffled join.

    Null text is empty text with no tokens. Null or repeated ids give a row each. An empty table gives an empty result
    and appends nothing. Other columns are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    version = file_digest(vocabulary)
    content = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text")).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), spaced(F.col("text")).alias("content"))
    digest = F.unhex(F.sha2(F.col("content").cast("binary"), 256)).alias("digest")
    distinct = content.select(digest, "content").groupBy("digest").agg(F.first("content").alias("content"))
    misses = distinct.join(_stored(spark, cache, version), "digest", "left_anti")
    misses.select("digest", F.lit(version).alias("tokenizer"), counter(vocabulary)("content").alias("n_tokens")).write.mode("append").parquet(cache)
    rows = written(content.select("doc_id", "n_bytes", digest), "content-digests")
    stored = _stored(spark, cache, version)
    hot = F.broadcast(written(stored.join(F.broadcast(frequent_digests(rows)), "digest", "left_semi"), "frequent-counts"))
    counted = rows.join(hot, "digest").unionByName(rows.join(hot, "digest", "left_anti").join(stored, "digest", "left"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
