"""The corpus operators as queries over the driver's tables, with their oracles."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.llm import alignment, best_fit, decontam, divergence, exact_dedup, licences, lm_score, quality, toxicity
from quirespark.llm.columns import fold
from quirespark.llm.exact_dedup import exact_groups
from quirespark.llm.ngram_join import near_duplicates
from quirespark.llm.packing import pack
from quirespark.llm.shared import new_dir
from quirespark.llm.token_counts import token_counts
from quirespark.llm.token_files import read_token_files, write_token_files

VOCABULARY = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that documents hold; see licences.licence_matches for nulls, ties and repeats."""
    return licences.licence_matches(table(spark, sf_dir, "documents"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those outside fold 2 of 7; see lm_score.scored."""
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 7) == 2
    return lm_score.scored(docs, lm_score.train(docs.filter(~held_out)), held_out, weights=lm_score.WEIGHTS)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read back from the token files that were written of them; see token_files."""
    shards = write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), new_dir(spark, "token-files"), end_id=1)
    return read_token_files(spark, shards).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learnt outside fold 2 of 4; see quality.learn and quality.scored."""
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 4) == 2
    ranking = quality.learn(docs, table(spark, sf_dir, "labels"), "quality", ~held_out)
    return quality.scored(docs.select("doc_id", "text", held_out.alias("held_out")), ranking).drop("text")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 ids; see packing.pack."""
    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), end_id=2, limit=4096)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "cost")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the benchmark each document holds; contaminated from two items on; see decontam.marked."""
    docs = table(spark, sf_dir, "documents")
    index = decontam.build_index(docs, table(spark, sf_dir, "benchmark"))
    hits = decontam.marked(docs.select("doc_id", "text"), index).select("doc_id", "hits.*")
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("items") >= 2).alias("contaminated"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row that stays for each document; see exact_dedup.exact_groups."""
    return exact_groups(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learnt outside fold 1 of 3; see toxicity.learn and toxicity.scored."""
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 3) == 1
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"), "toxic", ~held_out)
    found = toxicity.scored(docs.select("doc_id", "text", held_out.alias("held_out")), lexicon)
    return found.select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near copies of each document; see ngram_join.near_duplicates."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents through a cache of this run; see token_counts.token_counts."""
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), new_dir(spark, "token-count-cache"), limit=2048)


def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in as few sequences of at most 2048 ids as rounds of best fit take; see best_fit.best_fit."""
    pieces = best_fit.cut_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), end_id=0, limit=2048)
    places = best_fit.best_fit(pieces, 2048)
    own = pieces.select("piece_id", "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"))
    return best_fit.packed(own, places.withColumn("offset", F.col("offset").cast("long")))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How two tokenizers' tokens of each document align; see alignment.cross_aligned."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return alignment.cross_aligned(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How sources of each language differ from it and from one another; see divergence.audit."""
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_licences, op2_lm_score, op3_token_files, op4_quality, op5_packing, op6_decontamination, op7_exact_dedup, op8_toxicity, op9_ngram_join, op10_token_counts, op11_best_fit, op12_alignment, op13_divergence)}
ORACLES = {"op1_licences": licences.SQL, "op7_exact_dedup": exact_dedup.SQL, "op13_divergence": divergence.SQL}
