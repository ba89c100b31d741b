"""Where notes go: nesting, parents, claimed names, text runs and attachments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirespark.operators.ranks import GROUP_ROWS, group_rank
from quirespark.operators.relational import unused
from quirespark.scratch import written


def with_depth(pages: DataFrame, keys: list[str], order: list[str], level: str, depth: str = "depth") -> DataFrame:
    """depth = min(level, depth of the page before + 1), 0 for the first: i + running minimum of (level - i), level 0 first."""
    ordered = Window.partitionBy(*keys).orderBy(*order)
    at = unused(pages, "_i")
    rows = pages.withColumn(at, F.row_number().over(ordered))
    own = F.when(F.col(at) == 1, 0).otherwise(F.greatest(F.col(level), F.lit(0)))
    least = F.min(own - F.col(at)).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(depth, (F.col(at) + least).cast("int")).drop(at)


def with_parent(pages: DataFrame, keys: list[str], order: str, page: str, depth: str = "depth", parent: str = "parent") -> DataFrame:
    """The most recent page one level up, null at level 0. Each page gives its name at its own level and asks at the level
    above, where the last name given before it is its parent's; so a page's row is two, and no list is gathered."""
    own, kind = unused(pages, "_at"), pages.schema[page].dataType
    gives = F.struct(F.col(depth).cast("long").alias("level"), F.col(page).alias("name"), F.lit(False).alias("asks"))
    asks = F.struct((F.col(depth) - 1).cast("long").alias("level"), F.lit(None).cast(kind).alias("name"), F.lit(True).alias("asks"))
    both = pages.withColumn(own, F.explode(F.array(gives, asks)))
    upto = Window.partitionBy(*keys, F.col(own)["level"]).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(parent, F.last(F.col(own)["name"], ignorenulls=True).over(upto)).filter(F.col(own)["asks"]).drop(own)


def _base_and_extension(name: Column) -> tuple[Column, Column]:
    """A name up to its last point, and from there on; a point at the start begins no extension."""
    extension = F.regexp_extract(name, r"(?s)\A.+(\.[^.]*)\z", 1)
    return F.substring(name, F.lit(1), F.char_length(name) - F.char_length(extension)), extension


def _wins(children: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """Adds shift (1 where the parent name itself is lost) and wins to names (k: their number below the parent name;
    earlier: rows of the parent name before their first) whose parents are among `keys` (with shift). A numbered name wins
    if the parent name's rows have not come to its number before it: earlier <= k - shift - (winners of lower numbers).
    The count of winners is bounded from both sides, and the rounds end when the bounds agree: each round settles at least
    the first name that is open."""
    before = Window.partitionBy(*key).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    count = lambda of: F.coalesce(F.sum(F.col(of).cast("int")).over(before), F.lit(0))
    slack = F.col("k") - F.col("shift") - F.col("earlier")
    rows = children.join(keys, key).withColumn("least", F.lit(0).cast("long"))
    while True:
        rows = rows.withColumn("may", F.col("least") <= slack).withColumn("most", count("may")).withColumn("wins", F.col("most") <= slack)
        rows = written(rows.withColumn("least", count("wins")), "name-winners")
        if rows.filter("may <> wins").isEmpty():
            return rows.drop("least", "most", "may")


def claimed(rows: DataFrame, folder: str, name: str, order: str | list[str], to: str = "claimed", most: int = GROUP_ROWS) -> DataFrame:
    """Adds the name that each row gets: its own, or with ` 1`, ` 2`... before the extension, first come first served
    within a folder (exact case) regardless of the name's case. The order tells rows apart; null names stay null.

    The rows of one name take the numbers from 0 on, in order, but for those that other rows hold: a name that is itself
    numbered (`A 1` beside `A`) competes, by its first row alone, for one number of its parent name. Ranks within a name
    come from group_rank, so a name of any number of rows is dealt to many tasks; competitions are settled from parents to
    children, a round for each trailing number that names have; and each row skips as many numbers as winners lie below.
    """
    order = [order] if isinstance(order, str) else order
    low, rank, skipped, shift = (unused(rows, x) for x in ("_low", "_rank", "_skipped", "_shift"))
    places = [unused(rows, f"_place{k}") for k in range(len(order))]
    base, extension = _base_and_extension(F.col(name))
    ranked = group_rank(rows.withColumn(low, F.lower(name)), [folder, low], order, rank, most)
    key = ["folder", "low"]
    firsts = ranked.filter((F.col(rank) == 0) & F.col(name).isNotNull()).select(F.col(folder).alias("folder"), F.col(low).alias("own"), *[F.col(o).alias(p) for o, p in zip(order, places, strict=True)])
    own_base, own_extension = _base_and_extension(F.col("own"))
    number = r"(?s)\A(.*) ([1-9][0-9]{0,17})\z"
    numbered = firsts.withColumn("low", F.concat(F.regexp_extract(own_base, number, 1), own_extension)).withColumn("k", F.regexp_extract(own_base, number, 2)).filter("k <> ''").withColumn("k", F.col("k").cast("long"))
    children = written(numbered.join(firsts.select(F.col("folder").alias("of"), F.col("own").alias("parent")), F.col("folder").eqNullSafe(F.col("of")) & (F.col("low") == F.col("parent")), "left_semi").withColumn("folder", F.struct("folder")), "numbered-names")
    index = F.col(rank)
    result = ranked
    if not children.isEmpty():
        held = ranked.select(F.struct(F.col(folder).alias("folder")).alias("folder"), F.col(low).alias("low"), F.col(rank).alias("row"), *[F.col(o).alias(p) for o, p in zip(order, places, strict=True)])
        held = written(held.join(children.select(*key).distinct(), key, "left_semi"), "parent-names")
        both = held.select(*key, *places, F.lit(None).cast("string").alias("own"), F.lit(None).cast("long").alias("k")).unionByName(children)
        marked = group_rank(group_rank(both, key, places, "place", most).filter("own is not null"), key, places, "turn", most)
        rivals = written(marked.withColumn("earlier", F.col("place") - F.col("turn")).select(*key, "own", "k", "earlier"), "rivals")
        known = rivals.select(*key).distinct().join(rivals.select("folder", F.col("own").alias("low")), key, "left_anti").withColumn("shift", F.lit(0).cast("long"))
        settled = []
        while not known.isEmpty():
            settled.append(_wins(rivals, known, key))
            known = settled[-1].select("folder", F.col("own").alias("low"), (1 - F.col("wins").cast("long")).alias("shift"))
        told = reduce(DataFrame.unionByName, settled)
        winners = group_rank(told.filter("wins"), key, ["k"], "turn", most).select(*key, (F.col("k") - F.col("shift") - F.col("turn")).alias("row"), F.lit(0).alias("kind"))
        asked = held.join(winners.select(*key).distinct(), key, "left_semi").select(*key, "row", F.lit(1).alias("kind"))
        passed = group_rank(winners.unionByName(asked), key, ["row", "kind"], "place", most).filter("kind = 1").select("folder", "low", "row", (F.col("place") - F.col("row")).alias(skipped))
        lost = told.filter("not wins").select("folder", F.col("own").alias("low"), F.lit(1).cast("long").alias(shift))
        result = _looked_up(_looked_up(ranked, passed, [F.struct(F.col(folder).alias("folder")), F.col(low), F.col(rank)], ["folder", "low", "row"]), lost, [F.struct(F.col(folder).alias("folder")), F.col(low)], key)
        index = index + F.coalesce(skipped, F.lit(0)) + F.coalesce(shift, F.lit(0))
    chosen = F.when(index == 0, F.col(name)).otherwise(F.concat(base, F.lit(" "), index.cast("string"), extension))
    return result.select(*[F.col(c) for c in rows.columns if c != to], chosen.alias(to))


def _looked_up(rows: DataFrame, table: DataFrame, values: list[Column], keys: list[str]) -> DataFrame:
    """The table's other columns beside each row, by the values of the keys."""
    names = [unused(rows, f"_by{k}") for k in range(len(keys))]
    for n, v in zip(names, values, strict=True):
        rows = rows.withColumn(n, v)
    return rows.join(table.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], *[c for c in table.columns if c not in keys]), names, "left").drop(*names)


def run_slices(runs: DataFrame, keys: list[str], order: str, boundary: str, length: str) -> DataFrame:
    """Adds first and end of each text run: it starts where the one before ends, and ends at its boundary within the text
    but never before its start."""
    ordered = Window.partitionBy(*keys).orderBy(order)
    end = F.max(F.least(F.greatest(F.col(boundary), F.lit(0)), F.col(length))).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    return runs.withColumn("end", end).withColumn("first", F.coalesce(F.lag("end").over(ordered), F.lit(0)))


def carried_links(runs: DataFrame, keys: list[str], order: list[str], field: str, text: str, url: str, to: str = "link") -> DataFrame:
    """A field's address goes to the next run with text (the field's own row included) that has none of its own; a run
    that has one uses the field up all the same."""
    ordered = Window.partitionBy(*keys).orderBy(*order)
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    group, pending, nth = (unused(runs, x) for x in ("_group", "_pending", "_nth"))
    rows = runs.withColumn(group, F.count(field).over(upto)).withColumn(pending, F.last(field, ignorenulls=True).over(upto))
    full = (F.col(text) != "").cast("int")
    rows = rows.withColumn(nth, F.sum(full).over(Window.partitionBy(*keys, group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    takes = (F.col(text) != "") & (F.col(nth) == 1) & (F.col(group) > 0)
    return rows.withColumn(to, F.coalesce(F.col(url), F.when(takes, F.col(pending)))).drop(group, pending, nth)


def first_copies(assets: DataFrame, folder: str, payload: Column, order: list[str]) -> DataFrame:
    """Adds digest, and written: whether this is the first asset of its content in its folder. Payloads are hashed where
    they lie; only digests and the order are grouped, with map-side combine, and joined back."""
    rows, own = assets.withColumn("digest", F.sha2(payload, 256)), unused(assets, "_first")
    first = rows.groupBy(folder, "digest").agg(F.min(F.struct(*order)).alias(own))
    return rows.join(first, [folder, "digest"]).withColumn("written", F.struct(*order) == F.col(own)).drop(own)
