"""Exact deduplication with a heavy-hitter split, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirespark.llm.columns import spaced, whole_text
from quirespark.llm.shared import written

#: Digests that the frequent-items summary reports at most, and the counters it keeps. Both bound what is broadcast.
HEAVY, COUNTERS = 256, 4096


def frequent_digests(rows: DataFrame, heavy: int = HEAVY, counters: int = COUNTERS) -> DataFrame:
    """Digests that a Misra-Gries summary of the rows names as frequent: at most `heavy`, so they can be broadcast."""
    top = rows.agg(F.expr(f"approx_top_k(hex(digest), {int(heavy)}, {int(counters)})").alias("top"))
    return top.select(F.explode("top").alias("t")).filter(F.col("t.count") > 1).select(F.unhex("t.item").alias("digest"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY, counters: int = COUNTERS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are after each run of ASCII white space became one space; the smallest id of a group stays.
    A Misra-Gries summary (Spark's frequent-items sketch) names the digests that may hold many rows. Their exact smallest
    id and size come from one aggregation with map-side combine; at most `heavy` such winners are broadcast, and their rows
    never meet in one task. All other digests are shuffled as usual; such a group holds less than 1/counters of the rows,
    or is past the first `heavy` digests.

    Null text is empty text, so null and empty texts form one group. A null id is never the one that stays unless the
    group has no other; then keep_id is null and all of its rows are kept, as nothing tells them apart. Rows that repeat
    an id are each returned; every row whose id equals keep_id is kept. An empty table gives an empty result. Only the
    two named columns are read.
    """
    text = spaced(whole_text(text_col))
    rows = written(docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")), "exact-digests")
    winners = rows.join(F.broadcast(frequent_digests(rows, heavy, counters)), "digest", "left_semi").groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    winners = F.broadcast(written(winners, "exact-winners"))
    hot = rows.join(winners, "digest")
    group = Window.partitionBy("digest")
    rest = rows.join(winners, "digest", "left_anti").select("*", F.min("doc_id").over(group).alias("keep_id"), F.count(F.lit(1)).over(group).alias("group_size"))
    return hot.select("doc_id", "digest", "keep_id", "group_size").unionByName(rest).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM d
"""
