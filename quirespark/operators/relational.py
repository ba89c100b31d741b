"""The relational core: current versions, replay, chains, ordered references and merges.

Every "first" or "last" has a total order among its arguments, so no result depends on how rows are dealt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirespark.scratch import written


def unused(rows: DataFrame, stem: str) -> str:
    """A column name that no column of the rows has, in any case."""
    taken = {c.lower() for c in rows.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def last_of(rows: DataFrame, keys: list[str], order: list[str], descending: bool = True) -> DataFrame:
    """One row per key: the last (or first) in the order. The choice is an aggregate with map-side combine, so a hot key
    sends one row per task; the order's columns must not be null and tell rows apart, else any of the tied rows stays."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    whole = F.struct(*order, *rest)
    pick, own = (F.max_by if descending else F.min_by)(whole, F.struct(*order)), unused(rows, "_row")
    return rows.groupBy(*keys).agg(pick.alias(own)).select(*keys, f"{own}.*").select(*rows.columns)


def current_revision(revisions: DataFrame, keys: list[str], context: Column, order: list[str], role: int = 1) -> DataFrame:
    """The head of each space: the last revision of the role in the context that is not encrypted."""
    return last_of(revisions.filter(~F.col("is_encrypted") & (F.col("role") == role) & F.col("context_id").eqNullSafe(context)), keys, order)


def chain_depth(links: DataFrame, node: str, parent: str) -> DataFrame:
    """(node, root, depth) of every node by pointer doubling: log2 of the longest chain in joins. Nodes of a cycle have
    no root and are left out; a parent that is no node ends its chain. Rows whose chain has ended are asked for but never
    ask: they have no parent to be dealt by, and would all meet in one task."""
    links = written(links.select(F.col(node).alias("node"), F.col(parent).alias("parent")), "links")
    ids = links.select(F.col("node").alias("k"))
    ended = lambda rows: rows.filter("up is null").select("node", "root", "depth")
    done = links.filter("parent is null").select("node", F.col("node").alias("root"), F.lit(0).alias("depth"))
    start = links.filter("parent is not null").join(ids, F.col("parent") == F.col("k"), "left")
    rows = start.select("node", F.col("k").alias("up"), F.col("k").isNotNull().cast("int").alias("depth"), F.when(F.col("k").isNull(), F.col("node")).alias("root"))
    before = -1
    while True:
        rows = written(rows, "chains")  # each step reads its rows twice, and its plan stays small
        done, rows = done.unionByName(ended(rows)), rows.filter("up is not null").select("node", "up", "depth")
        left = rows.count()
        if left in (0, before):
            return done
        before = left
        known = done.select("node", F.lit(None).cast(rows.schema["up"].dataType).alias("up"), "depth", "root").unionByName(rows.withColumn("root", F.lit(None).cast(done.schema["root"].dataType)))
        at = known.select(F.col("node").alias("j"), F.col("up").alias("next"), F.col("depth").alias("more"), "root")
        rows = rows.join(at, F.col("up") == F.col("j")).select("node", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), "root")


def latest_known(rows: DataFrame, keys: list[str], order: list[str], value: str, default) -> Column:
    """The last value that is not null up to and including each row, or the default."""
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return F.coalesce(F.last(value, ignorenulls=True).over(window), F.lit(default))


def zip_positions(rows: DataFrame, left: str, right: str, keys: list[str]) -> DataFrame:
    """Two arrays by position as rows (keys, pos, left, right); a position that one of them lacks is null there."""
    return rows.select(*keys, F.posexplode(F.arrays_zip(left, right)).alias("pos", "pair")).select(*keys, "pos", F.col(f"pair.{left}").alias(left), F.col(f"pair.{right}").alias(right))


def islands(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Runs of equal neighbouring values: keys, island (from 1), the value, and how many rows."""
    ordered = Window.partitionBy(*keys).orderBy(*order)
    new = F.lag(value).over(ordered).eqNullSafe(F.col(value)) & (F.row_number().over(ordered) > 1)
    own = unused(rows, "_new")
    marked = rows.withColumn(own, (~new).cast("int")).withColumn("island", F.sum(own).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "island", value).agg(F.count(F.lit(1)).alias("n"))


def difference(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys that are missing on the right, unexpected there, or differ in value."""
    own, other, in_own, in_other = (unused(left.select(*keys), x) for x in ("_a", "_b", "_in_a", "_in_b"))
    a = left.select(*keys, F.col(value).alias(own), F.lit(True).alias(in_own))
    b = right.select(*keys, F.col(value).alias(other), F.lit(True).alias(in_other))
    kind = F.when(F.col(in_other).isNull(), "missing").when(F.col(in_own).isNull(), "unexpected").when(~F.col(own).eqNullSafe(F.col(other)), "differs")
    return a.join(b, keys, "full").select(*keys, kind.alias("kind")).filter("kind is not null")


def progress(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds done and total: the place of each row among those of its keys, and how many there are."""
    own = Window.partitionBy(*keys)
    return rows.withColumn("done", F.row_number().over(own.orderBy(*order))).withColumn("total", F.count(F.lit(1)).over(own))


def changes(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value is not that of the row before among those that have one: repeats in a row count once."""
    ordered = Window.partitionBy(*keys).orderBy(*order)
    own = unused(rows, "before")
    return rows.filter(F.col(value).isNotNull()).withColumn(own, F.lag(value).over(ordered)).filter(F.col(own).isNull() | (F.col(own) != F.col(value))).drop(own)


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with how often: each is a fault where keys have to be single."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
