"""Places of rows in a total order, worked out in many tasks: range sort, counts per partition, prefix sums."""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirespark.operators.relational import unused
from quirespark.scratch import written

#: Rows of one group that a window may rank in one task; larger groups are ranked over many tasks.
GROUP_ROWS = 100_000


def _sorted(rows: DataFrame, order: list, at: str) -> tuple[DataFrame, DataFrame]:
    """The rows as a written table in range-sorted partitions, with `at`, the partition in the upper and the place there in
    the lower bits; and a small table (part, base): the rows before each partition. Only the latter's counts, one per
    partition, come to the driver."""
    spark = rows.sparkSession
    table = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), "sorted")
    counts = sorted((r.part, r.n) for r in table.groupBy(F.shiftright(at, 33).alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    bases = accumulate([n for _, n in counts], initial=0)
    return table, F.broadcast(spark.createDataFrame([(part, base) for (part, _), base in zip(counts, bases, strict=False)], "part long, base long"))


def _place(rows: DataFrame, bases: DataFrame, at: str, to: str) -> DataFrame:
    part, base = unused(rows, "part"), unused(rows, "base")
    named = bases.select(F.col("part").alias(part), F.col("base").alias(base))
    return rows.withColumn(part, F.shiftright(at, 33)).join(named, part).withColumn(to, F.col(base) + F.col(at).bitwiseAND((1 << 33) - 1)).drop(part, base)


def overall_rank(rows: DataFrame, order: list[str | Column], to: str) -> DataFrame:
    """Adds each row's place, from 0, in an order that tells rows apart (rows that it does not tell apart get places next to
    each other). Nulls come first. No rows give none."""
    at = unused(rows, "_at")
    table, bases = _sorted(rows, order, at)
    return _place(table, bases, at, to).drop(at)


def same(left: DataFrame, keys: list[str], names: list[str]) -> Column:
    """The condition that the left side's keys are the columns named so, null equal to null."""
    return reduce(Column.__and__, [left[k].eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)])


def group_rank(rows: DataFrame, group: list[str], order: list[str | Column], to: str, most: int = GROUP_ROWS) -> DataFrame:
    """Adds each row's place, from 0, among the rows of its group. Nulls are a group like others.

    Where no group has more than `most` rows, a window ranks them. Else the rows are range-sorted by group and order; a
    group that spans partitions, and there is at most one for each border between them, takes places from prefix sums, as
    its first row's place is known to all; the groups within one partition are ranked by a window.
    """
    largest = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    plain = Window.partitionBy(*group)
    if largest <= most:
        return rows.withColumn(to, (F.row_number().over(plain.orderBy(*order)) - 1).cast("long"))
    at = unused(rows, "_at")
    table, bases = _sorted(rows, [*group, *order], at)
    low, high = unused(table, "_low"), unused(table, "_high")
    keys = [unused(table, f"_key{k}") for k in range(len(group))]
    extent = table.groupBy(*group).agg(F.min(at).alias(low), F.max(at).alias(high)).filter(F.shiftright(low, 33) != F.shiftright(high, 33))
    first = unused(table, "_first")
    wide = F.broadcast(written(_place(extent.select(*[F.col(g).alias(k) for g, k in zip(group, keys, strict=True)], F.col(low)), bases, low, first).drop(low), "wide-groups"))
    spanning = _place(table.join(wide, same(table, group, keys)), bases, at, to).withColumn(to, F.col(to) - F.col(first))
    within = table.join(wide, same(table, group, keys), "left_anti").withColumn(to, (F.row_number().over(plain.orderBy(at)) - 1).cast("long"))
    return spanning.drop(first, at, *keys).select(*within.drop(at).columns).unionByName(within.drop(at))


def name_key(path: Column) -> Column:
    """What orders paths as a walk of folders in name order meets them: by each part's name as words are ordered, and by
    its UTF-16 code units where that tells nothing. A folder's entries are one list, files and folders alike."""
    parts = F.split(F.regexp_replace(path, r"\\", "/"), "/")
    return F.transform(parts, lambda p: F.struct(F.collate(p, "UNICODE").alias("word"), F.encode(p, "UTF-16BE").alias("units")))
