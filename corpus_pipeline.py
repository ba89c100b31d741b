"""A corpus pipeline over `documents`: five stages, each written as Parquet and read again by the next.

A stage takes (spark, docs, sf_dir), works on every row that its predecessor kept, and returns the columns of documents;
the last returns the packed pieces. Nulls, empty and very long texts, ties and repeated ids are handled as the operators
say. Extra columns of any name are kept as they are, but for the packed pieces; an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.llm import decontam, quality
from quirespark.llm.columns import fold, spaced, unused, whole_text
from quirespark.llm.exact_dedup import exact_groups
from quirespark.llm.ngram_join import near_duplicates
from quirespark.llm.packing import pack
from quirespark.llm.queries import VOCABULARY
from quirespark.llm.shared import removed, written

#: Words that a tokenizing worker remembers: fewer than by default, as the other stages' workers are there too.
MEMO_WORDS = 200_000

def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality ranking does not reject. It learns from the labelled rows of three of four folds."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    ranking = quality.learn(docs, labels, "quality", fold("doc_id", 4) != 2)
    score, predicted = unused(docs, "score"), unused(docs, "predicted")
    return quality.scored(docs, ranking, score=score, predicted=predicted).filter(F.col(predicted) == 1).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact copies: that of the smallest id. Rows are told apart by id and text, so of
    rows that share an id those with other texts stay."""
    own, name, digest = unused(docs, "digest"), "kept id", "kept digest"
    rows = docs.withColumn(own, F.sha2(spaced(whole_text("text")).cast("binary"), 256))
    kept = written(exact_groups(docs).filter("kept").groupBy(F.col("doc_id").alias(name), F.col("text_sha256").alias(digest)).agg(F.count(F.lit(1)).alias("times")), "kept-texts")
    stay = rows.join(kept, rows["doc_id"].eqNullSafe(kept[name]) & (rows[own] == kept[digest]), "left_semi")
    if not kept.filter("times > 1").isEmpty():  # rows of one id and one text: one of them stays
        stay = stay.dropDuplicates(["doc_id", own])
    return stay.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest id. Texts without words are kept. Rows that share
    an id stand or fall together."""
    kept = near_duplicates(docs).filter("n_shingles = 0 or doc_id <=> component_id").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_id"]), "left_semi")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of any benchmark item; nulls and texts without words hold none. Repeated items count
    once, and without items every document stays."""
    index = decontam.build_index(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hits = unused(docs, "hits")
    return decontam.marked(docs, index, hits=hits).filter(F.col(hits)["n_hit"] == 0).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 ids: a row per piece."""
    pieces = pack(docs, public_tokenizers.path(VOCABULARY), end_id=2, limit=4096, memo_words=MEMO_WORDS)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents in turn, with a written table between them."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{k}")
            removed(*before)
            before = [docs]
    return docs


#: The ranking, the near-copy components, tokenizing and packing have no SQL; the pipeline is tested against a model.
ORACLE_SQL = None
