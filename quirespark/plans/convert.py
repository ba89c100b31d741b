"""Sections to notes: the whole plan from inputs to files and reports."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirespark.functions import binary, names, render, text, values
from quirespark.operators import ink, layout, mapping, spaces
from quirespark.scratch import written
from quirespark.sources import cabinet, object_graph, revision_store
from quirespark.sources.property_sets import GraphLimits


@dataclass(frozen=True)
class Options:
    """notebook: its name; sections: entries to convert; attachments_dir: None for no attachments; nest: subpages in
    folders of their parents; frontmatter, include_deleted: as they say."""

    notebook: str | None = None
    sections: frozenset[str] | None = None
    attachments_dir: str | None = "attachments"
    frontmatter: bool = True
    nest: bool = True
    include_deleted: bool = False
    archive: cabinet.Limits = field(default_factory=cabinet.Limits)
    graph: GraphLimits = field(default_factory=GraphLimits)


@dataclass(frozen=True)
class Converted:
    """notes (input, ord, path, content), attachments (same), skipped (input, ord, page, item, reason), errors (input, ord,
    name, kind, code, message)."""

    notes: DataFrame
    attachments: DataFrame
    skipped: DataFrame
    errors: DataFrame

    def files(self) -> DataFrame:
        return self.notes.select("path", "content").unionByName(self.attachments.select("path", "content"))


def placed_pages(pages: DataFrame, nest: bool) -> DataFrame:
    """Adds depth, folder and stem to pages (section, page_id, page_ord, level, section_folder, file_name, turn): a page lies
    in the folder of the last page one level up, and its name is the first free one there, in the order of `turn`, which
    tells pages of all sections apart. All pages of one depth claim their names at once, after those above them: a round
    for each depth, over all sections."""
    keys = pages.select("section", "page_id", "page_ord", "level", "section_folder", "turn", F.concat("file_name", F.lit(".md")).alias("note"))
    keys = layout.with_depth(keys, ["section"], ["page_ord"], "level") if nest else keys.withColumn("depth", F.lit(0))
    keys = written(layout.with_parent(keys, ["section"], "page_ord", "page_id"), "nested-pages")
    placed: list[DataFrame] = []
    for depth in range((keys.agg(F.max("depth")).first()[0] or 0) + 1):
        own = keys.filter(F.col("depth") == depth).withColumnRenamed("section_folder", "folder")
        if placed:
            above = placed[-1].select("section", F.col("page_id").alias("parent"), render.joined_path(F.col("folder"), F.col("stem")).alias("folder"))
            own = own.drop("folder").join(above, ["section", "parent"])
        named = layout.claimed(own.select("section", "page_id", "depth", "folder", "turn", "note"), "folder", "note", "turn", to="note")
        placed.append(written(named.select("section", "page_id", "depth", "folder", F.regexp_replace("note", r"\.md\z", "").alias("stem")), "placed-pages"))
    return pages.join(reduce(DataFrame.unionByName, placed), ["section", "page_id"])


def claimed_attachments(assets: DataFrame, folder: str) -> DataFrame:
    """Adds asset_folder and asset_name: the first asset of its content in a folder claims a name there, and others of the
    same content have that name. A name without an extension gets the one that its bytes tell."""
    rows = assets.withColumn("asset_folder", render.joined_path(F.col("folder"), F.lit(folder)))
    kind = binary.magic_kind(F.col("payload"))
    rows = rows.withColumn("wished", names.file_name_column(render.with_extension(F.col("suggested"), kind)))
    order = ["input_ord", "section_ord", "page_ord", "number"]
    rows = written(layout.first_copies(rows, "asset_folder", F.col("payload"), order), "assets")
    firsts = rows.filter("written").select("asset_folder", "digest", "wished", *order)
    named = layout.claimed(firsts, "asset_folder", "wished", order, to="asset_name").select("asset_folder", "digest", "asset_name")
    return rows.join(named, ["asset_folder", "digest"])


def convert(inputs: DataFrame, options: Options = Options(), order: DataFrame | None = None) -> Converted:
    """Inputs (input, content) as notes with their attachments. An input, section or page with a fault is a row of errors,
    and the others are converted; notes lie under their notebook, groups and section, which claims its name in order.
    order (input, input_ord): places of the inputs; in name order where it is not given."""
    if order is None:
        order = cabinet.in_name_order(inputs.select("input"), "input")
    found = cabinet.read_sections(inputs, set(options.sections) if options.sections else None, options.archive)
    found = written(found.withColumn("section", F.concat_ws("\0", "input", F.coalesce("entry_ord", F.lit(0)).cast("string"))), "sections")
    own = found.filter("code is null").withColumn("title", text.entry_title(F.col("entry_name"))).withColumn("groups", text.entry_groups(F.col("entry_name")))
    counts = own.groupBy("input").agg(F.count(F.lit(1)).alias("n_sections"), F.max("groups").alias("any_groups"))
    graph = object_graph.relations(own, "section", "content", revision_store.StoreLimits(), options.graph)
    objects, roots = spaces.materialized(graph)
    listed = written(spaces.pages(graph, objects, roots, options.graph.page_nodes), "listed-pages")
    tops = written(spaces.section_spaces(graph, objects, roots), "section-spaces")
    notebook = render.notebook_name(F.lit(options.notebook).cast("string"), F.col("input"), F.col("n_sections"), F.col("any_groups"))
    about = own.select("section", "input", F.col("entry_ord").alias("section_ord"), "title", "groups").join(counts, "input").join(order, "input").join(tops.select("section", "section_name"), "section", "left")
    about = about.withColumn("notebook", notebook).withColumn("label", F.when(F.col("section_name") != "", F.col("section_name")).otherwise(F.col("title")))
    # names of groups and notebooks are few: one call for each section
    parent = render.joined_path(F.when(F.col("notebook") != "", F.col("notebook_file")), F.col("group_files"))
    groups = about.select("section", F.posexplode("groups").alias("k", "g")).select("section", "k", names.file_name_column("g").alias("g")).groupBy("section").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "g"))), lambda x: x["g"]), "/").alias("group_files"))
    about = about.join(groups, "section", "left").withColumn("notebook_file", names.file_name_column("notebook")).withColumn("parent", parent).withColumn("section_file", names.file_name_column("label"))
    decoded = written(about.join(tops.select("section"), "section", "left_semi"), "decoded-sections")
    folders = layout.claimed(decoded.select("section", "parent", "section_file", "input_ord", "section_ord"), "parent", "section_file", ["input_ord", "section_ord"], to="claimed_file")
    about = written(decoded.join(folders.select("section", render.joined_path(F.col("parent"), F.col("claimed_file")).alias("section_folder")), "section"), "section-folders")

    pages = listed.filter(~F.col("is_deleted") | F.lit(options.include_deleted)).drop("section_name")
    elements = written(mapping.elements(pages, objects, options.graph), "elements")
    titles = elements.filter("kind = 'title'").groupBy("section", "page_id").agg(F.max_by("words", "ord").alias("found_title"))
    pages = pages.join(titles, ["section", "page_id"], "left").withColumn("title", F.when(text.trim_space(F.col("title")) == "", F.coalesce("found_title", "title")).otherwise(F.col("title"))).drop("found_title")
    pages = pages.join(about.select("section", "input", "input_ord", "section_ord", "label", "notebook", "groups", "section_folder"), "section").withColumn("file_name", names.file_name_column("title"))
    pages = pages.withColumn("turn", F.struct("input_ord", "section_ord", "page_ord"))
    pages = written(placed_pages(written(pages, "titled-pages"), options.nest).drop("turn"), "pages")

    # assets: those of paragraphs, cells and ink; a payload is joined late, and only to those that name it
    keys = ["section", "page_id"]
    plain = elements.filter("asset is not null").select(*keys, "asset", F.when(F.col("kind") == "ink", ink.drawing_column("strokes")).alias("svg"))
    celled = elements.filter("kind = 'table'").select(*keys, F.explode(F.flatten(F.flatten("cells"))).alias("part")).filter("part.asset is not null").select(*keys, "part.asset", F.lit(None).cast("string").alias("svg"))
    assets = plain.unionByName(celled).select(*keys, "asset.*", "svg").join(pages.select(*keys, "input", "input_ord", "section_ord", "page_ord", "folder", "stem"), keys)
    image_type = F.when(F.coalesce("extension", F.lit("")) != "", F.col("extension")).when(F.col("extension").isNull(), text.extension_of(F.col("name")))
    suggested = F.when(F.col("svg").isNotNull(), F.concat("stem", F.lit(" - Ink.svg"))).when(F.col("image"), render.with_extension(F.concat("stem", F.lit(" image")), image_type)).otherwise(render.with_extension(F.coalesce("name", F.lit("attachment")), F.col("extension")))
    stored = graph.payloads.groupBy("section", "key").agg(F.max_by("ord", "ord").alias("ord"))
    payloads = graph.payloads.join(stored, ["section", "key", "ord"]).select("section", "key", "payload")
    assets = assets.withColumn("suggested", suggested).withColumn("key", values.file_key(F.col("reference"))).join(payloads, ["section", "key"], "left")
    assets = assets.withColumn("payload", F.coalesce(F.col("svg").cast("binary"), "payload"))
    has = (F.coalesce(F.octet_length("payload"), F.lit(0)) > 0) & F.lit(options.attachments_dir is not None)
    kept = claimed_attachments(assets.filter(has), options.attachments_dir or "")
    target = names.uri_column(F.concat(F.lit(f"{options.attachments_dir}/" if options.attachments_dir else ""), F.col("asset_name")))
    label = F.when(F.col("image"), "").otherwise(F.col("suggested"))
    linked = kept.withColumn("target", target).select(*keys, "number", F.concat(F.when(F.col("image"), "!").otherwise(""), F.lit("["), label, F.lit("]("), "target", F.lit(")")).alias("link"))
    links = linked.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("number", "link"))).alias("links"))

    rows = elements.join(links, keys, "left").withColumn("links", F.coalesce("links", F.create_map().cast("map<int,string>")))
    link_of = lambda a: F.try_element_at(F.col("links"), F.coalesce(a["number"], F.lit(-1)))
    cell = lambda parts: render.cell_text(F.transform(parts, lambda p: F.when(p["asset"].isNotNull(), F.coalesce(link_of(p["asset"]), F.lit(""))).otherwise(render.rendered_runs(p["runs"]))))
    grid = F.transform("cells", lambda r: F.transform(r, cell))
    asset_block = render.plain_block(link_of(F.col("asset")))
    recognised = render.plain_block(F.when((F.col("kind") == "ink") & link_of(F.col("asset")).isNotNull(), F.nullif("words", F.lit(""))))
    shown = F.when(F.col("kind") == "paragraph", render.block(F.col("body"), F.col("style"), F.col("level"), F.col("ordered"), F.col("tags"))).when(F.col("kind") == "table", render.plain_block(F.col("table"))).when(F.col("asset").isNotNull(), asset_block)
    rows = rows.withColumn("body", render.rendered_runs(F.col("runs"))).withColumn("grid", grid).withColumn("table", text.gfm_table(F.col("grid")))
    blocks = rows.select(*keys, "ord", F.filter(F.array(shown, F.when(F.col("kind") == "ink", recognised)), lambda x: x.isNotNull()).alias("blocks"))
    gathered = blocks.groupBy(*keys).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("ord", "blocks"))), lambda x: x["blocks"])).alias("blocks"))
    broken = elements.filter("kind = 'fault'").select(*keys, "code")
    bodies = pages.join(broken, keys, "left_anti").join(gathered, keys, "left").withColumn("body", F.coalesce(render.page_body(F.col("blocks")), F.lit("")))
    header = text.front_matter(F.col("title"), F.col("page_id"), F.col("label"), F.coalesce("notebook", F.lit("")), F.col("groups"), F.col("updated"), F.col("is_conflict"), F.col("is_deleted"), F.col("created"))
    whole = F.concat(header if options.frontmatter else F.lit(""), "body", F.lit("\n"))
    turn = F.struct("section_ord", "page_ord")
    notes = bodies.select("input", turn.alias("ord"), render.joined_path(F.col("folder"), F.concat("stem", F.lit(".md"))).alias("path"), whole.cast("binary").alias("content"))
    number = F.struct("section_ord", "page_ord", "number")
    attachments = kept.filter("written").select("input", number.alias("ord"), render.joined_path(F.col("asset_folder"), F.col("asset_name")).alias("path"), F.col("payload").alias("content"))
    item = lambda rows, what, why, at: rows.select("input", F.struct("section_ord", "page_ord", at.cast("int").alias("at")).alias("ord"), F.col("stem").alias("page"), what.alias("item"), F.lit(why).alias("reason"))
    nested = elements.filter("kind = 'nested'").select(*keys, F.col("ord").alias("at")).join(pages, keys)
    skipped = item(assets.filter(~has), F.col("suggested"), "no-data", F.col("number")).unionByName(item(nested, F.col("stem"), "not-representable", F.col("at")))
    told = lambda rows, name, code, at: rows.select("input", at.alias("ord"), name.alias("name"), text.error_kind(code).alias("kind"), code.alias("code"), F.concat_ws(" ", render.reason(text.error_kind(code)), render.advice(code)).alias("message"))
    faulty = graph.faults.join(own.select("section", "input", "title", "entry_ord"), "section")
    pageless = own.join(graph.faults, "section", "left_anti").join(tops, "section", "left_anti").withColumn("code", F.lit("ONENOTE_SECTION_OBJECT_SPACE"))
    first = F.struct(F.coalesce("entry_ord", F.lit(0)).alias("section_ord"), F.lit(-1).alias("page_ord"))
    errors = told(found.filter("code is not null"), F.coalesce("entry_name", "input"), F.col("code"), first).unionByName(told(faulty, F.col("title"), F.col("code"), first)).unionByName(told(pageless, F.col("title"), F.col("code"), first))
    errors = errors.unionByName(told(broken.join(pages, keys), F.col("stem"), F.col("code"), F.struct("section_ord", F.col("page_ord").cast("int").alias("page_ord"))))
    return Converted(notes, attachments, skipped, errors)
