"""Object spaces as of their current revisions, and the pages of a section, by joins over the decoded relations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirespark.functions import values
from quirespark.operators.relational import current_revision, last_of
from quirespark.scratch import written
from quirespark.sources.object_graph import Relations

#: Types of objects.
SECTION, SERIES, PAGE, OUTLINE, OUTLINE_ELEMENT, TEXT, IMAGE, NUMBER_LIST, OUTLINE_GROUP, TABLE, ROW, CELL, TITLE = 0x60007, 0x60008, 0x6000B, 0x6000C, 0x6000D, 0x6000E, 0x60011, 0x60012, 0x60019, 0x60022, 0x60023, 0x60024, 0x6002C
SECTION_DATA, EMBEDDED, MANIFEST, CONFLICT_DATA, INK, INK_DATA, STROKE, STROKE_STYLE, WORD, TAG_KIND = 0x20031, 0x60035, 0x60037, 0x20038, 0x60014, 0x2003B, 0x20047, 0x120048, 0x20057, 0x120043
#: The space of headers, which holds no section.
HEADER_SPACE = "111e4cf3-7fef-4087-af6a-b9544acd334d:1"
#: Ids of properties.
CONTENT, CHILDREN, STRUCTURE, CHILD_SPACES, SECTION_NAME, SECTION_COLOR = 0x24001C1F, 0x24001C20, 0x24001D5F, 0x2C001D63, 0x1C00349B, 0x14001CBE
CACHED_TITLE, PAGE_TITLE, LEVEL, CREATED, MODIFIED, MODIFIED_32, CONFLICT, DELETED = 0x1C001CF3, 0x1C001D3C, 0x14001DFF, 0x18001C65, 0x18001D77, 0x14001D7A, 0x08001D7C, 0x1C001DE9


def value(properties: Column, prop: int) -> Column:
    """The last of an object's own properties that carries an id, as a struct; null where none does."""
    return F.try_element_at(F.filter(properties, lambda p: (p["id"] == F.lit(prop & 0x7FFFFFFF)) & (p["path"] == "")), F.lit(-1))


def last_value(rows: DataFrame, keys: list[str], prop: str, order: str) -> DataFrame:
    """The same for a table with a row per property: the last per object and id, bit 31 of the id apart."""
    return last_of(rows.withColumn(prop, F.col(prop).bitwiseAND(F.lit(0x7FFFFFFF))), [*keys, prop], [order])


def references(objects: DataFrame, prop: int, keys: list[str], pos: str, to: str) -> DataFrame:
    """A row per reference of a property, in order."""
    return objects.select(*keys, F.posexplode(value(F.col("properties"), prop)["refs"]).alias(pos, to))


def revision_chains(revisions: DataFrame, heads: DataFrame) -> DataFrame:
    """(section, space_id, rev_id, chain_pos) of each space's current revision and what it depends on, the oldest at 0.
    The last of revisions that repeat an id counts; a cycle ends a chain. A task holds the ids of one section."""
    links = revisions.select("section", "rev_ord", "rev_id", "dep_id").join(heads.select("section", "rev_id", F.col("space_id").alias("head_of")), ["section", "rev_id"], "left")

    def follow(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rev_ord")
        above = dict(zip(rows["rev_id"], rows["dep_id"], strict=True))
        found = []
        for space, head in rows.loc[rows["head_of"].notna(), ["head_of", "rev_id"]].drop_duplicates("head_of").itertuples(index=False):
            chain, seen = [], set()
            while head in above and head not in seen:
                chain.append(head)
                seen.add(head)
                head = above[head]
            found += [(rows["section"].iloc[0], space, r, k) for k, r in enumerate(reversed(chain))]
        return pd.DataFrame(found, columns=["section", "space_id", "rev_id", "chain_pos"])

    return links.groupBy("section").applyInPandas(follow, "section string, space_id string, rev_id string, chain_pos int")


def materialized(graph: Relations) -> tuple[DataFrame, DataFrame]:
    """(objects, roots) of all spaces in the default context, as of their current revisions: of an object's declarations
    along the chain the last counts, and so of roots by role. Encrypted revisions are passed over."""
    heads = current_revision(graph.roles.filter("space_id is not null"), ["section", "space_id"], F.lit(None).cast("string"), ["assoc_ord", "rev_ord"])
    chains = written(revision_chains(graph.revisions, heads), "chains")
    at = ["section", "space_id"]
    placed = chains.join(graph.objects.select("section", "rev_id", "obj_ord", "object_id"), ["section", "rev_id"]).drop("rev_id")
    current = last_of(placed, [*at, "object_id"], ["chain_pos", "obj_ord"]).select(*at, "obj_ord")
    objects = current.join(graph.objects.select("section", "obj_ord", "object_id", "jcid", "file_ref", "file_ext", "properties"), ["section", "obj_ord"])
    roots = last_of(chains.join(graph.roots, ["section", "rev_id"]).select(*at, "role", "chain_pos", "root_ord", "object_id"), [*at, "role"], ["chain_pos", "root_ord"])
    return written(objects, "space-objects"), written(roots.select(*at, "role", "object_id"), "space-roots")


def root_objects(objects: DataFrame, roots: DataFrame, role: int) -> DataFrame:
    """The object that each space has for a role."""
    return roots.filter(F.col("role") == role).drop("role").join(objects, ["section", "space_id", "object_id"])


def section_spaces(graph: Relations, objects: DataFrame, roots: DataFrame) -> DataFrame:
    """(section, space_id, section_name, section_color): the first space in the file whose root is a section."""
    first = graph.revisions.filter(F.col("space_id").isNotNull() & (F.col("space_id") != HEADER_SPACE)).groupBy("section", "space_id").agg(F.min("rev_ord").alias("first"))
    own = root_objects(objects, roots, 1).filter(F.col("jcid") == SECTION).select("section", "space_id").join(first, ["section", "space_id"])
    own = own.groupBy("section").agg(F.min_by("space_id", "first").alias("space_id"))
    about = root_objects(objects, roots, 2).filter(F.col("jcid") == SECTION_DATA).select("section", "space_id", value(F.col("properties"), SECTION_NAME)["data"].alias("name"), value(F.col("properties"), SECTION_COLOR)["scalar"].alias("section_color"))
    return own.join(about, ["section", "space_id"], "left").select("section", "space_id", F.coalesce(values.wide_text_column("name"), F.lit("")).alias("section_name"), "section_color")


def listed_pages(sections: DataFrame, objects: DataFrame, roots: DataFrame, most: int = 100_000) -> DataFrame:
    """(section, page_id, page_ord): the spaces that a section's series list, each at its first place, `most` at most (a
    safety limit of the format's reader)."""
    at = ["section", "space_id"]
    tops = root_objects(objects, roots, 1).join(sections.select(*at), at)
    series = references(tops, CHILDREN, at, "series_pos", "object_id").join(objects, [*at, "object_id"]).filter(F.col("jcid") == SERIES)
    pages = references(series, CHILD_SPACES, ["section", "series_pos"], "pos", "page_id")
    first = last_of(pages, ["section", "page_id"], ["series_pos", "pos"], descending=False)
    return first.select("section", "page_id", (F.row_number().over(Window.partitionBy("section").orderBy("series_pos", "pos")) - 1).alias("page_ord")).filter(F.col("page_ord") < most)


def pages(graph: Relations, objects: DataFrame, roots: DataFrame, most: int = 100_000) -> DataFrame:
    """Pages with what is told about them: section, page_id, page_ord, section_name, node_id (the page's own object), title
    (may be empty), level, created, updated, is_conflict, is_deleted (told by the property being there)."""
    sections = section_spaces(graph, objects, roots)
    listed = listed_pages(sections, objects, roots, most)
    keys = ["section", "page_id"]
    of = lambda role: root_objects(objects, roots, role).withColumnRenamed("space_id", "page_id").join(listed.select(*keys), keys)
    children = references(of(1).filter(F.col("jcid") == MANIFEST), CONTENT, keys, "pos", "object_id")
    nodes = children.join(objects.withColumnRenamed("space_id", "page_id"), [*keys, "object_id"]).filter(F.col("jcid") == PAGE)
    first = last_of(nodes.select(*keys, "pos", "object_id"), keys, ["pos"], descending=False)
    props = F.col("properties")
    node = nodes.join(first, [*keys, "pos", "object_id"]).select(*keys, F.col("object_id").alias("node_id"), value(props, PAGE_TITLE)["data"].alias("own_title"), value(props, MODIFIED_32)["scalar"].alias("own_time"))
    about = of(2).select(*keys, F.col("jcid").alias("about"), *(value(props, p)[f].alias(n) for n, p, f in (("cached", CACHED_TITLE, "data"), ("level", LEVEL, "scalar"), ("made", CREATED, "scalar"), ("conflict", CONFLICT, "flag"), ("deleted", DELETED, "data"))))
    changed = of(4).select(*keys, value(props, MODIFIED)["scalar"].alias("changed"))
    rows = listed.join(node, keys).join(about, keys, "left").join(changed, keys, "left").join(sections.select("section", "section_name"), "section")
    return rows.select(
        *keys,
        "page_ord",
        "section_name",
        "node_id",
        F.coalesce(values.wide_text_column("cached"), values.wide_text_column("own_title"), F.lit("")).alias("title"),
        values.page_level(F.col("level")).alias("level"),
        values.file_time(F.col("made")).alias("created"),
        F.coalesce(values.file_time(F.col("changed")), values.time32(F.col("own_time"))).alias("updated"),
        F.coalesce("conflict", F.coalesce(F.col("about") == CONFLICT_DATA, F.lit(False))).alias("is_conflict"),
        F.col("deleted").isNotNull().alias("is_deleted"),
    )
