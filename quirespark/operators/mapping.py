"""What a page holds, by joins over its objects: references, styles, tags, lists, files and strokes are looked up once per
object, then the tree of elements is walked a level at a time over all pages, with a sort key, a cycle guard and a depth
limit for every occurrence of an object."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirespark.functions import names, render, text, values
from quirespark.operators import layout
from quirespark.operators import spaces as S
from quirespark.operators.relational import changes, last_of
from quirespark.scratch import removed, written
from quirespark.sources.cabinet import FormatError
from quirespark.sources.property_sets import GraphLimits

#: Ids of properties.
LIST_NODES, CHILD_LEVEL, LIST_FORMAT = 0x24001C26, 0x0C001C03, 0x1C001C1A
WIDE, NARROW, RUN_ENDS, RUN_STYLES, PARAGRAPH_STYLE, STYLE_NAME = 0x1C001C22, 0x1C003498, 0x1C001E12, 0x24001E13, 0x2000342C, 0x1C00345A
MATH, HIGHLIGHT, LINKED, ADDRESS = 0x08003401, 0x14001C0D, 0x08001E14, 0x1C001E20
MARKS = {"bold": 0x08001C04, "italic": 0x08001C05, "underline": 0x08001C06, "strikethrough": 0x08001C07, "superscript": 0x08001C08, "subscript": 0x08001C09}
TAG_STATES, TAG_STATUS, TAG_SHAPE, TAG_LABEL, TAG_OF = 0x40003489, 0x10003470, 0x10003464, 0x1C003468, 0x20003488
IMAGE_NAME, IMAGE_FILE, FILE_NAME, FILE_PATH, FILE_AT, FILE_EXTENSION = 0x1C001DD7, 0x20001C3F, 0x1C001D9C, 0x1C001D9D, 0x20001D9B, 0x1C003424
INK_DATA, STROKES, STROKE_STYLE, INK_PATH, INK_DIMENSIONS, INK_WIDTH, INK_COLOR, INK_CLEAR = 0x20003415, 0x24003416, 0x20003409, 0x1C00340B, 0x1C00340A, 0x1400340D, 0x1400340F, 0x0C003414
SCALE_X, SCALE_Y, RECOGNISED, WORD_PARTS, WORD_TEXT, WORD_STROKES = 0x14001C46, 0x14001C47, 0x200035D7, 0x240035D9, 0x1C0035DA, 0x1C0035DF
#: Tags of a paragraph at most, the status of a tag that is off, pixels of half an inch, depth of words.
TAGS, OFF, DONE, PIXELS, WORD_DEPTH = 9, 0x10, 0x01, 48, 8
_WHITE = names._SPACE
_FIELD = rf'(?s)\A(.*?)﷟[{_WHITE}]*HYPERLINK[{_WHITE}]+"([^"]*)"[{_WHITE}]*(.*)\z'

#: Types of objects that are elements, and of those that hold others.
OUTLINES = (S.OUTLINE, S.OUTLINE_GROUP)
KINDS = (*OUTLINES, S.OUTLINE_ELEMENT, S.TEXT, S.IMAGE, S.EMBEDDED, S.TABLE, S.INK)
HOLDERS = (*OUTLINES, S.OUTLINE_ELEMENT, S.TABLE)
#: Types that are looked up by type, and properties by which a look-up is told to be needed at all.
TYPES = (*KINDS, S.PAGE, S.ROW, S.CELL, S.TITLE, S.NUMBER_LIST, S.INK_DATA, S.STROKE, S.STROKE_STYLE, S.WORD, S.TAG_KIND)
STYLED = (MATH, HIGHLIGHT, LINKED, ADDRESS, *MARKS.values())
ASKED = (*STYLED, S.CHILDREN, S.CONTENT, S.STRUCTURE, RECOGNISED, WORD_PARTS, LIST_NODES, PARAGRAPH_STYLE, STYLE_NAME, TAG_STATES, TAG_OF, TAG_SHAPE, TAG_LABEL, INK_DATA)
#: Pages at most whose keys are sent to all tasks, to leave out the objects of other spaces.
FEW_PAGES = 50_000

_RUN = "struct<text:string,latex:string,highlight:string,url:string,math:boolean," + ",".join(f"{m}:boolean" for m in MARKS) + ">"
_ASSET = "struct<number:int,name:string,extension:string,reference:string,image:boolean>"
_TAGS = "array<struct<label:string,checkable:boolean,completed:boolean,shape:int>>"
_STROKE = "struct<points:array<struct<x:double,y:double>>,color:string,width:double,opacity:double>"
_PART = f"struct<runs:array<{_RUN}>,asset:{_ASSET}>"
_LIST = "struct<level:int,ordered:boolean,format:string>"
COLUMNS = {"kind": "string", "style": "string", "level": "int", "ordered": "boolean", "format": "string", "tags": _TAGS, "runs": f"array<{_RUN}>", "cells": f"array<array<array<{_PART}>>>", "asset": _ASSET, "strokes": f"array<{_STROKE}>", "words": "string", "code": "string"}
_POINT = T.StructType([T.StructField(c, T.DoubleType()) for c in "xy"])
#: Keys within the walk: a page by its number, which told apart all spaces of the objects, and an object by its page and id.
SPACE = ["section", "page_id"]
K = ["page"]
OWN = [*K, "object_id"]


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values and where each begins, and the last ends."""
    column = column.cast(pa.large_binary())
    _, places, data = column.buffers()
    starts = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8)[starts[0] : starts[-1]] if data else np.empty(0, np.uint8), starts - starts[0]


def _runs(wide: pa.Array, narrow: pa.Array, ends: pa.Array) -> pa.Array:
    """The runs of texts of any kind, a text at a time."""
    found = []
    for own_wide, own_narrow, own_ends in zip(wide.to_pylist(), narrow.to_pylist(), ends.to_pylist(), strict=True):
        whole = values.wide_text(own_wide)
        whole = values.byte_text(own_narrow) or "" if whole is None else whole
        raw, start, runs = whole.encode("utf-16le", "surrogatepass"), 0, []
        for end in [*values.number_array(own_ends), len(raw) // 2]:
            end = max(start, min(len(raw) // 2, end))
            runs.append(whole[start:end] if len(raw) == 2 * len(whole) else raw[2 * start : 2 * end].decode("utf-16le", "replace"))
            start = end
        found.append(runs)
    return pa.array(found, pa.list_(pa.string()))


def _plain_runs(wide: pa.Array, ends: pa.Array) -> pa.Array:
    """The runs of wide texts of whole units without halves of pairs, at once: all texts are one, and places in it that do
    not go back bound the runs, as each text begins where the one before ends."""
    data, starts = _bytes(wide)
    units, starts = data.copy().view("<u2"), starts // 2
    keep = np.ones(len(units), bool)
    keep[starts[1:] - 1] = units[starts[1:] - 1] != 0  # a zero at the end
    starts = np.concatenate(([0], np.cumsum(keep)))[starts]
    units = units[keep]
    data, places = _bytes(ends)
    sizes = np.diff(places)
    whole = sizes % 4 == 0
    numbers = (data if whole.all() else data[np.repeat(whole, sizes)]).copy().view("<u4").astype(np.int64)
    counts = np.where(whole, sizes // 4, 0)
    lists = np.concatenate(([0], np.cumsum(counts + 1)))
    bounds = np.repeat(starts[1:], counts + 1)  # of the last run of each text; the others end where their number says
    inner = np.ones(len(bounds), bool)
    inner[lists[1:] - 1] = False
    bounds[inner] = np.minimum(bounds[inner], np.repeat(starts[:-1], counts) + numbers)
    bounds = np.concatenate(([0], np.maximum.accumulate(bounds)))
    at = np.concatenate(([0], np.cumsum(1 + (units >= 0x80).astype(np.int64) + (units >= 0x800))))
    texts = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(at[bounds]), pa.py_buffer(units.tobytes().decode("utf-16le").encode()))
    return pa.ListArray.from_arrays(pa.array(lists, pa.int32()), texts.cast(pa.string()))


@F.arrow_udf(T.ArrayType(T.StringType()))
def run_texts_column(wide: pa.Array, narrow: pa.Array, ends: pa.Array) -> pa.Array:
    """The text of each run of text objects. Places between runs count UTF-16 units and do not go back; halves of pairs
    become replacement characters."""
    data, starts = _bytes(wide)
    sizes = np.diff(starts)
    plain = (sizes > 0) & (sizes % 2 == 0)
    high = np.append(data[1:], np.uint8(0))  # the upper byte of the unit that begins at a byte
    odd = ((high & 0xF8) == 0xD8) & (np.arange(len(data)) % 2 == np.repeat(starts[:-1] % 2, sizes))
    count = np.concatenate(([0], np.cumsum(odd)))
    plain &= count[starts[1:]] == count[starts[:-1]]
    at = np.flatnonzero(plain)
    ended = data[starts[1:][at] - 1] | data[starts[1:][at] - 2] if len(at) else data[:0]
    before = np.maximum(starts[1:][at] - 4, starts[:-1][at])  # of two zeros at the end the loop takes care
    plain[at[(ended == 0) & ((data[before] | data[before + 1]) == 0)]] = False
    if plain.all() and len(wide):
        return _plain_runs(wide, ends)
    chosen = pa.array(plain)
    other = pa.array(~plain)
    found = pa.concat_arrays([_plain_runs(wide.filter(chosen), ends.filter(chosen)), _runs(wide.filter(other), narrow.filter(other), ends.filter(other))]) if plain.any() else _runs(wide, narrow, ends)
    return found.take(pa.array(np.argsort(np.argsort(~plain, kind="stable"), kind="stable"))) if plain.any() else found


@F.arrow_udf(T.ArrayType(T.StringType()))
def latexes_column(texts: pa.Array) -> pa.Array:
    return pa.array([row and [None if x is None else names.latex(x) for x in row] for row in texts.to_pylist()], pa.list_(pa.string()))


@F.arrow_udf(T.StringType())
def first_word_column(data: pa.Array) -> pa.Array:
    return pa.array([next(iter(values.alternatives(x)), None) for x in data.to_pylist()], pa.string())


@F.arrow_udf(T.StructType([T.StructField("stroke", T.StructType([T.StructField("points", T.ArrayType(_POINT)), T.StructField("color", T.StringType()), T.StructField("width", T.DoubleType()), T.StructField("opacity", T.DoubleType())])), T.StructField("code", T.StringType())]))
def stroke_column(path: pa.Array, dims: pa.Array, scale_x: pa.Array, scale_y: pa.Array, width: pa.Array, color: pa.Array, clear: pa.Array, most: pa.Array) -> pa.Array:
    """Strokes of ink paths in pixels; null where a path has no points, and a code where it is broken."""
    found = []
    for data, own_dims, x, y, wide, ink, through, limit in zip(*(c.to_pylist() for c in (path, dims, scale_x, scale_y, width, color, clear, most)), strict=True):
        scales = [1.0 if v is None else v for v in (values.float_value(x), values.float_value(y))]
        try:
            points = None if data is None else values.points(values.ink_path(data, min(limit, 8 * len(data))), values.dimensions(own_dims), *scales)
        except FormatError as e:
            found.append({"stroke": None, "code": e.code})
            continue
        own = values.float_value(wide)
        line = max(0.000001, (1.0 if own is None else own) * abs(scales[0]) / values.UNITS)
        stroke = points and {"points": [{"x": p["x"] * PIXELS, "y": p["y"] * PIXELS} for p in points], "color": values.ink_color(ink), "width": max(1.0, line * PIXELS), "opacity": 1 - min(255, through or 0) / 255}
        found.append({"stroke": stroke or None, "code": None})
    point = pa.struct([("x", pa.float64()), ("y", pa.float64())])
    kind = pa.struct([("points", pa.list_(point)), ("color", pa.string()), ("width", pa.float64()), ("opacity", pa.float64())])
    return pa.array(found, pa.struct([("stroke", kind), ("code", pa.string())]))


@dataclass
class Objects:
    """The objects of all pages as a table written by type (0 for those of TYPES not looked up by type), each with the ids of
    its own properties from the last to the first (null for those of nested sets), and with the pairs of type and id that there are of ASKED properties (id null: the type alone). What no object has is known to be empty
    before anything is joined."""

    rows: DataFrame
    held: set[tuple[int, int | None]]

    @classmethod
    def of(cls, objects: DataFrame) -> Objects:
        kind = F.when(F.col("jcid").isin(*TYPES), F.col("jcid")).otherwise(0).cast("long")
        own_ids = F.transform(F.reverse("properties"), lambda p: F.when(p["path"] == "", p["id"]))
        ids = F.when(F.array_max("properties.path") == "", F.reverse("properties.id")).otherwise(own_ids)
        rows = written(objects.select(*SPACE, *OWN, "jcid", "file_ref", "file_ext", "properties", ids.alias("ids"), kind.alias("type")), "page-objects", "type")
        asked = F.col("id").isin(*[p & 0x7FFFFFFF for p in ASKED])
        ids = rows.select("type", F.explode_outer("properties.id").alias("id")).select("type", F.when(asked, F.col("id")).alias("id")).distinct()
        return cls(rows, {(r.type, r.id) for r in ids.collect()} | {(r.type, None) for r in rows.select("type").distinct().collect()})

    def has(self, kind: int, number: int | None = None) -> bool:
        return (kind, number if number is None else number & 0x7FFFFFFF) in self.held

    def any_has(self, number: int) -> bool:
        return any(p == number & 0x7FFFFFFF for _, p in self.held)

    def of_type(self, *types: int) -> DataFrame:
        found = [t for t in types if self.has(t)]
        return self.rows.filter(F.col("type").isin(*found) if found else F.lit(False))

    def holding(self, *numbers: int) -> DataFrame:
        """The objects of those types of which any has one of the properties."""
        ids = {n & 0x7FFFFFFF for n in numbers}
        return self.of_type(*sorted({t for t, p in self.held if p in ids}))

    def known(self, *types: int) -> DataFrame:
        """(keys, ref, ref_type) of all objects, or of those of some types."""
        return (self.of_type(*types) if types else self.rows).select(*K, F.col("object_id").alias("ref"), F.col("jcid").alias("ref_type"))


def page_number(turn: int) -> Column:
    """A number of a space by its names; another one each turn."""
    return F.xxhash64(F.lit(turn), *SPACE)


def numbered(pages: DataFrame, objects: DataFrame) -> tuple[DataFrame, Objects]:
    """Pages and objects with numbers of their spaces in place of names: one column that sorts and joins by its bits. Where
    two spaces get one number, all are numbered anew."""
    for turn in count():
        found = Objects.of(objects.withColumn("page", page_number(turn)))
        own = pages.withColumn("page", page_number(turn))
        names_of = found.rows.select("page", *SPACE).distinct().unionByName(own.select("page", *SPACE)).distinct()
        if names_of.groupBy("page").count().filter("count > 1").isEmpty():
            return own, found
        removed(found.rows)


def prop(number: int, field: str) -> Column:
    """A field of the last of an object's own properties that carries an id; null where none does. Compiled, as it is asked
    of every object: it reads ids by place and has no lambda."""
    place = F.array_position("ids", F.lit(number & 0x7FFFFFFF).cast("long"))
    return F.get("properties", (F.size("properties") - place).cast("int"))[field]


def once(rows: DataFrame, **own: Column) -> DataFrame:
    """Adds columns that are worked out once a row, however often what follows names them."""
    for name, value in own.items():
        rows = rows.withColumn(name, F.explode(F.array(value)))
    return rows


def referred(objects: DataFrame, number: int, known: DataFrame) -> DataFrame:
    """(keys, object_id, pos, ref, ref_type) of the references of a property to objects that the space has, in order."""
    return objects.select(*OWN, F.posexplode(prop(number, "refs")).alias("pos", "ref")).join(known, [*K, "ref"])


def first_known(objects: DataFrame, number: int, known: DataFrame) -> DataFrame:
    """(keys, object_id, ref): the first reference to an object that the space has."""
    return referred(objects, number, known).groupBy(*OWN).agg(F.min_by("ref", "pos").alias("ref"))


def color_text(value: Column) -> Column:
    """0x00BBGGRR as #rrggbb."""
    part = lambda shift: F.lpad(F.lower(F.hex(F.shiftright(value, shift).bitwiseAND(255))), 2, "0")
    return F.concat(F.lit("#"), part(0), part(8), part(16))


def text_runs(objects: Objects) -> DataFrame:
    """(keys, object_id, runs, texts) of text objects. A run's style is that of its place in the list of styles; link fields
    leave the text, and give their address to the next run with text that has none of its own. Styles are looked up once for
    each different list of them in a page; runs are rows of their own only in texts that may have link fields."""
    own = objects.of_type(S.TEXT).select(*OWN, run_texts_column(prop(WIDE, "data"), prop(NARROW, "data"), prop(RUN_ENDS, "data")).alias("texts"), F.coalesce(prop(RUN_STYLES, "refs"), F.array().cast("array<string>")).alias("styles"))
    own = own.withColumn("styles", F.slice("styles", F.lit(1), F.size("texts"))).withColumn("fields", F.exists("texts", lambda x: x.contains("HYPERLINK")).cast("int"))
    own = written(own, "texts", "fields")

    flag = lambda p: F.coalesce(prop(p, "flag"), F.lit(False))
    highlight = prop(HIGHLIGHT, "scalar")
    style = objects.holding(*STYLED).select(*K, F.col("object_id").alias("style_id"), F.when(flag(LINKED), prop(ADDRESS, "data")).alias("address"), F.when(highlight < 0xFFFFFF, color_text(highlight)).alias("highlight"), *(flag(p).alias(m) for m, p in {"math": MATH, **MARKS}.items()))
    address = F.nullif(values.wide_text_column("address"), F.lit("")) if objects.any_has(ADDRESS) else F.lit(None).cast("string")
    style = _with_uri(style.withColumn("link", address), objects.any_has(ADDRESS))
    # a text has the columns of its runs' styles from its list of styles and number of runs
    lists = own.select(*K, "styles", F.size("texts").alias("n")).distinct()
    each = lists.select(*K, "styles", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k")).withColumn("style_id", F.get("styles", F.col("k"))).join(style, [*K, "style_id"], "left")
    gathered = each.groupBy(*K, "styles", "n").agg(F.sort_array(F.collect_list(F.struct("k", "link", "uri", "highlight", *(F.coalesce(m, F.lit(False)).alias(m) for m in ("math", *MARKS))))).alias("all"))
    columns = ("link", "uri", "highlight", "math", *MARKS)
    own = own.withColumn("n", F.size("texts")).join(gathered.select(*K, "styles", "n", F.array_repeat(F.lit(None).cast("string"), F.col("n")).alias("latexes"), *(F.col("all")[c].alias(c) for c in columns)), [*K, "styles", "n"], "left")

    if objects.any_has(MATH):
        own = own.withColumn("latexes", latexes_column(F.transform("texts", lambda x, k: F.when(F.get("math", k), text.trim_space(x)))))
    run = F.arrays_zip("texts", "latexes", "highlight", "uri", "math", *MARKS)
    plain = own.filter("fields = 0").select(*OWN, run.cast(f"array<{_RUN}>").alias("runs"), "texts")
    if own.filter("fields = 1").select("fields").isEmpty():
        return plain

    rows = own.filter("fields = 1").select(*OWN, F.posexplode(F.arrays_zip("texts", "link", "highlight", "math", *MARKS)).alias("k", "x"))
    rows = rows.select(*OWN, "k", F.col("x.texts").alias("text"), F.col("x.link").alias("url"), "x.highlight", "x.math", *(f"x.{m}" for m in MARKS))
    has = F.col("text").rlike(_FIELD)
    rows = rows.withColumn("field", F.when(has, F.regexp_extract("text", _FIELD, 2))).withColumn("text", F.when(has, F.concat(F.regexp_extract("text", _FIELD, 1), F.regexp_extract("text", _FIELD, 3))).otherwise(F.col("text")))
    rows = layout.carried_links(rows, OWN, ["k"], "field", "text", "url")
    rows = _with_uri(rows.withColumn("link", F.nullif("link", F.lit("")))).withColumn("latex", names.latex_column(F.when(F.col("math"), text.trim_space(F.col("text")))))
    run = F.struct("text", "latex", "highlight", F.col("uri").alias("url"), "math", *MARKS)
    gathered = rows.groupBy(*OWN).agg(F.sort_array(F.collect_list(F.struct("k", run.alias("run")))).alias("all"))
    return plain.unionByName(gathered.select(*OWN, F.transform("all", lambda x: x["run"]).cast(f"array<{_RUN}>").alias("runs"), F.transform("all", lambda x: x["run"]["text"]).alias("texts")))


def _with_uri(rows: DataFrame, any_links: bool = True) -> DataFrame:
    """Adds uri: what the address in link is written as."""
    if not any_links:
        return rows.withColumn("uri", F.lit(None).cast("string"))
    rows = rows.withColumn("page_file", names.file_name_column(render.page_link(F.col("link"))))
    return rows.withColumn("uri", names.uri_column(F.when(F.col("link").isNotNull(), F.coalesce("page_file", "link")))).drop("page_file")


def style_names(objects: Objects) -> DataFrame:
    """(keys, object_id, style): the name of the first paragraph style that the space has."""
    own = objects.of_type(S.TEXT) if objects.has(S.TEXT, PARAGRAPH_STYLE) else objects.of_type()
    named = objects.holding(STYLE_NAME).select(*K, F.col("object_id").alias("ref"), prop(STYLE_NAME, "data").alias("name"))
    return first_known(own, PARAGRAPH_STYLE, objects.known()).join(named, [*K, "ref"]).select(*OWN, values.wide_text_column("name").alias("style"))


def tags_of(objects: Objects) -> DataFrame:
    """(keys, object_id, tags) of objects with tags: of the first nine states those that are on. A tag's shape is the
    state's or its kind's, and check boxes have no label."""
    states = prop(TAG_STATES, "ord")
    rows = objects.of_type(*(k for k in (S.TEXT, S.OUTLINE_ELEMENT) if objects.has(k, TAG_STATES))).filter(states.isNotNull())
    rows = once(rows, root=F.concat(F.lit("/"), states.cast("string"), F.lit("."))).select(*OWN, "properties", "root")
    below = F.filter("properties", lambda p: p["path"].startswith(F.col("root")))
    count = F.coalesce(F.array_max(F.transform("below", lambda p: F.substring_index(F.substring(p["path"], F.length("root") + 1, F.length(p["path"])), "/", 1).cast("int"))) + 1, F.lit(0))
    rows = once(once(rows, below=below), count=F.least(count, F.lit(TAGS))).filter("count > 0").select(*OWN, "below", "root", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("k"))
    rows = once(rows, path=F.concat("root", F.col("k").cast("string")))

    def at(number: int, field: str) -> Column:
        return F.try_element_at(F.filter("below", lambda p: (p["id"] == F.lit(number & 0x7FFFFFFF)) & (p["path"] == F.col("path"))), F.lit(-1))[field]

    rows = rows.select(*OWN, "k", F.coalesce(at(TAG_STATUS, "scalar"), F.lit(0)).alias("status"), at(TAG_SHAPE, "scalar").alias("own_shape"), F.get(at(TAG_OF, "refs"), F.lit(0)).alias("kind_id")).filter(F.col("status").bitwiseAND(OFF) == 0)
    named = objects.holding(TAG_SHAPE, TAG_LABEL) if objects.any_has(TAG_OF) else objects.of_type()
    kinds = named.select(*K, F.col("object_id").alias("kind_id"), F.when(F.col("jcid") == S.TAG_KIND, prop(TAG_SHAPE, "scalar")).alias("kind_shape"), prop(TAG_LABEL, "data").alias("label_data"))
    rows = rows.join(kinds, [*K, "kind_id"], "left").withColumn("label", values.wide_text_column("label_data") if objects.any_has(TAG_OF) else F.col("label_data").cast("string"))
    shape = F.coalesce("own_shape", "kind_shape").cast("int")
    box = F.coalesce(shape.isin(*text.CHECKABLE), F.lit(False))
    tag = F.struct(F.when(~box, F.col("label")).alias("label"), box.alias("checkable"), (F.col("status").bitwiseAND(DONE) != 0).alias("completed"), shape.alias("shape"))
    return rows.groupBy(*OWN).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", tag.alias("tag")))), lambda x: x["tag"]).cast(_TAGS).alias("tags"))


def list_marks(objects: Objects) -> DataFrame:
    """(keys, object_id, list) of outline elements: the last number list that one refers to; all null where there is none."""
    own = objects.of_type(S.OUTLINE_ELEMENT)
    formats = objects.of_type(S.NUMBER_LIST).select(*K, F.col("object_id").alias("ref"), F.coalesce(values.list_format_column(prop(LIST_FORMAT, "data")), F.lit("")).alias("format"))
    formats = last_of(referred(own, LIST_NODES, formats).select(*OWN, "pos", "format"), OWN, ["pos"]).select(*OWN, "format")
    level = F.greatest(F.lit(0), F.coalesce(F.col("child_level"), F.lit(1)) - 1).cast("int")
    rows = own.select(*OWN, prop(CHILD_LEVEL, "scalar").alias("child_level")).join(formats, OWN, "left")
    is_list = F.col("format").isNotNull()
    return rows.select(*OWN, F.struct(F.when(is_list, level).alias("level"), F.contains("format", F.lit("�")).alias("ordered"), F.nullif("format", F.lit("")).alias("format")).cast(_LIST).alias("list"))


def files_of(objects: Objects) -> DataFrame:
    """(keys, object_id, name, extension, reference, image) of images and embedded files: of the first file that the space
    has."""
    any_files = objects.has(S.IMAGE) or objects.has(S.EMBEDDED)
    held = (objects.rows if any_files else objects.of_type()).select(*K, F.col("object_id").alias("ref"), prop(FILE_EXTENSION, "data").alias("data"), "file_ext", "file_ref")
    one = lambda kind, at, name, image: objects.of_type(kind).select(*OWN, prop(name, "data").alias("name"), F.lit(image).alias("image")).join(first_known(objects.of_type(kind), at, objects.known()), OWN, "left")
    rows = one(S.IMAGE, IMAGE_FILE, IMAGE_NAME, True).unionByName(one(S.EMBEDDED, FILE_AT, FILE_NAME, False)).join(held, [*K, "ref"], "left")
    return rows.select(*OWN, values.wide_text_column("name").alias("name"), F.coalesce(values.wide_text_column("data"), "file_ext").alias("extension"), F.col("file_ref").alias("reference"), "image")


def recognised(nodes: DataFrame, objects: Objects) -> DataFrame:
    """(keys, stroke_id, word) from the trees of recognised text below page nodes, to WORD_DEPTH levels; an object counts
    where it is met first, level by level. A word names strokes by numbers under its own GUID; of words that name one
    stroke the last counts."""
    level = nodes.select(*K, F.get("recognised", F.lit(0)).alias("object_id")).join(objects.known().select(*K, F.col("ref").alias("object_id"), F.col("ref_type").alias("jcid")), OWN).withColumn("path", F.array().cast("array<int>"))
    parts = written(referred(objects.holding(WORD_PARTS).filter(F.col("jcid") != S.WORD), WORD_PARTS, objects.known()), "word-parts")
    met = written(level, "recognised")
    found = [met]
    for _ in range(WORD_DEPTH):
        below = met.join(parts, OWN).select(*K, F.col("ref").alias("object_id"), F.col("ref_type").alias("jcid"), F.concat("path", F.array("pos")).alias("path"))
        first = below.groupBy(*OWN, "jcid").agg(F.min("path").alias("path"))
        met = written(first.join(reduce(DataFrame.unionByName, found).select(*OWN), OWN, "left_anti"), "recognised")
        if met.isEmpty():
            break
        found.append(met)
    words = reduce(DataFrame.unionByName, found).filter(F.col("jcid") == S.WORD).select(*OWN, "path").join(objects.of_type(S.WORD), OWN)
    words = words.select(*OWN, "path", first_word_column(prop(WORD_TEXT, "data")).alias("word"), prop(WORD_STROKES, "data").alias("data")).filter("word is not null and octet_length(data) >= 20")
    byte = lambda at: F.conv(F.hex(F.substring("data", at, F.lit(1))), 16, 10).cast("long")
    number = lambda at: byte(at) + byte(at + 1) * 256 + byte(at + 2) * 65536 + byte(at + 3) * (1 << 24)
    rows = words.select(*OWN, "path", "word", "data", F.explode(F.sequence(F.lit(17), F.octet_length("data") - 3, F.lit(20))).alias("at"))
    guid = F.regexp_extract("object_id", r"(?s)\A(.*):", 1)
    rows = rows.select(*K, F.concat(guid, F.lit(":"), number(F.col("at")).cast("string")).alias("stroke_id"), "path", "at", "word")
    return rows.groupBy(*K, "stroke_id").agg(F.max_by("word", F.struct("path", "at")).alias("word"))


def inks_of(nodes: DataFrame, objects: Objects, limits: GraphLimits) -> DataFrame:
    """(keys, object_id, strokes, words, code) of ink with any stroke: the strokes that have points, in order, and what
    their words say. code: of the first broken path."""
    own = objects.of_type(S.INK).select(*OWN, F.get(prop(INK_DATA, "refs"), F.lit(0)).alias("data_id"), prop(SCALE_X, "data").alias("scale_x"), prop(SCALE_Y, "data").alias("scale_y"))
    strokes = referred(objects.of_type(S.INK_DATA), STROKES, objects.known(S.STROKE)).select(*K, F.col("object_id").alias("data_id"), "pos", F.col("ref").alias("stroke_id"))
    paths = objects.of_type(S.STROKE).select(*K, F.col("object_id").alias("stroke_id"), F.get(prop(STROKE_STYLE, "refs"), F.lit(0)).alias("style_id"), prop(INK_PATH, "data").alias("path")).filter("path is not null")
    styles = objects.of_type(S.STROKE_STYLE).select(*K, F.col("object_id").alias("style_id"), prop(INK_DIMENSIONS, "data").alias("dims"), prop(INK_WIDTH, "data").alias("width"), prop(INK_COLOR, "scalar").alias("color"), prop(INK_CLEAR, "scalar").alias("clear"))
    rows = own.join(strokes, [*K, "data_id"]).join(paths, [*K, "stroke_id"]).join(styles, [*K, "style_id"])
    rows = rows.withColumn("made", stroke_column("path", "dims", "scale_x", "scale_y", "width", "color", "clear", F.lit(limits.ink_values))).filter("made.stroke is not null or made.code is not null")
    rows = rows.select(*OWN, "pos", "stroke_id", "made.*")
    if objects.has(S.INK) and objects.has(S.PAGE, RECOGNISED):
        rows = rows.join(recognised(nodes, objects), [*K, "stroke_id"], "left")
    else:
        rows = rows.withColumn("word", F.lit(None).cast("string"))
    told = rows.groupBy(*OWN).agg(F.sort_array(F.collect_list(F.struct("pos", "stroke", F.nullif("word", F.lit("")).alias("word"))), asc=True).alias("all"), F.min_by("code", F.when(F.col("code").isNotNull(), F.col("pos"))).alias("code"))
    words = F.array_join(F.filter(F.transform("all", lambda x: x["word"]), lambda w: w.isNotNull()), " ")
    return told.select(*OWN, F.filter(F.transform("all", lambda x: x["stroke"]), lambda s: s.isNotNull()).alias("strokes"), F.nullif(words, F.lit("")).alias("words"), "code")


def steps_of(objects: Objects, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where the walk goes from an object: (keys, object_id, steps), in order, to elements only; and (keys, object_id,
    shape), the cells of each row of a table. suffix: what a step adds to the sort key; role: what the step is; r, c: the
    cell of a table that it leads into."""
    listed = lambda number, place: F.transform(F.coalesce(prop(number, "refs"), F.array().cast("array<string>")), lambda r, pos: F.struct(F.lit(place).alias("place"), pos.alias("pos"), r.alias("ref")))
    both = F.concat(listed(S.CHILDREN, 1), F.filter(listed(S.CONTENT, 0), lambda x: F.col("jcid") == S.OUTLINE_ELEMENT))
    children = objects.of_type(*HOLDERS, S.ROW, S.CELL).select(*OWN, "jcid", F.explode(both).alias("x")).select(*OWN, "jcid", "x.*").join(known, [*K, "ref"])
    children = written(children, "children") if objects.has(S.TABLE) else children
    nothing = F.lit(None).cast("int")
    role = F.when(F.col("place") == 0, "content").otherwise("child")
    plain = children.filter(F.col("jcid").isin(*OUTLINES, S.OUTLINE_ELEMENT)).select(*OWN, F.array("place", "pos").alias("suffix"), role.alias("role"), nothing.alias("r"), nothing.alias("c"), "ref", "ref_type")
    gathered = lambda steps: steps.filter(F.col("ref_type").isin(*KINDS)).groupBy(*OWN).agg(F.sort_array(F.collect_list(F.struct("suffix", "role", "r", "c", "ref", "ref_type"))).alias("steps"))
    if not objects.has(S.TABLE):
        return gathered(plain), objects.of_type().select(*OWN, F.array().cast("array<int>").alias("shape"))
    placed = lambda of, kind, to, at: children.filter((F.col("jcid") == of) & (F.col("ref_type") == kind)).select(*K, F.col("object_id").alias(of_name[of]), F.col("ref").alias(to), (F.row_number().over(Window.partitionBy(*OWN).orderBy("pos")) - 1).alias(at))
    of_name = {S.TABLE: "table_id", S.ROW: "row_id"}
    rows, cells = placed(S.TABLE, S.ROW, "row_id", "r"), placed(S.ROW, S.CELL, "cell_id", "c")
    grid = rows.join(cells, [*K, "row_id"], "left")
    counts = grid.groupBy(*K, "table_id", "r").agg(F.count("c").cast("int").alias("n"))
    shapes = counts.groupBy(*K, F.col("table_id").alias("object_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "n"))), lambda x: x["n"]).alias("shape"))
    held = children.filter(F.col("jcid") == S.CELL).select(*K, F.col("object_id").alias("cell_id"), "pos", "ref", "ref_type")
    inside = grid.filter("cell_id is not null").join(held, [*K, "cell_id"]).select(*K, F.col("table_id").alias("object_id"), F.array(F.lit(1), "r", "c", "pos").alias("suffix"), F.lit("cell").alias("role"), "r", "c", "ref", "ref_type")
    return gathered(plain.unionByName(inside)), shapes


def walk(nodes: DataFrame, objects: Objects, elements: DataFrame, about: DataFrame, limits: GraphLimits) -> DataFrame:
    """Every occurrence of an element below page nodes (tree 0) and title nodes (tree 1): keys, tree, title_pos, path (its
    sort key), depth, object_id, jcid, empty (an outline element without content), top_chain (the content of an element
    that lies on the page, by whichever contents), list and tags (of the outline elements whose content it is: the list of
    the outermost, the tags of the innermost that has any), table (the path of the table that it lies in), r, c.

    elements: (keys, ref, ref_type) of objects that can be elements; about: steps, list and tags by object. Of an outline
    element's contents only the first that can be an element here counts. An object within itself is left out, as is what
    lies deeper than the limit; nested tables are walked below titles only. A round per level, over all pages; what holds
    nothing takes part in one round alone, and needs no more than its tags.
    """
    none = lambda kind: F.lit(None).cast(kind)
    refs = lambda name, known: nodes.select(*OWN, F.posexplode(name).alias("pos", "ref")).join(known, [*K, "ref"])
    titles = refs("structure", objects.known(S.TITLE)).select(*K, F.col("ref").alias("object_id"), F.col("pos").alias("title_pos"))
    tops = refs("children", elements).withColumn("tree", F.lit(0)).withColumn("title_pos", F.lit(0))
    below = titles.join(referred(objects.of_type(S.TITLE), S.CHILDREN, elements), OWN).withColumn("tree", F.lit(1))
    columns = [*K, "tree", "title_pos", "pos", "ref", "ref_type"]
    level = tops.select(*columns).unionByName(below.select(*columns)).select(*K, "tree", "title_pos", F.array("pos").alias("path"), F.lit(0).alias("depth"), F.col("ref").alias("object_id"), F.col("ref_type").alias("jcid"), F.array().cast("array<string>").alias("above"), F.lit(False).alias("top_chain"), none(_LIST).alias("list"), none(_TAGS).alias("tags"), none("array<int>").alias("table"), none("int").alias("r"), none("int").alias("c"))
    level = written(level, "page-tops")
    columns = [*K, "tree", "title_pos", "path", "depth", "object_id", "jcid", "empty", "top_chain", "list", "tags", "own_tags", "table", "r", "c"]
    holds = F.col("jcid").isin(*HOLDERS)
    found: list[DataFrame] = []
    for depth in range(limits.depth):
        leaves = level.filter(~holds).withColumn("empty", F.lit(False))
        leaves = leaves.join(about.select(*OWN, "own_tags"), OWN, "left") if objects.has(S.TEXT, TAG_STATES) else leaves.withColumn("own_tags", none(_TAGS))
        found.append(leaves.select(*columns))
        within = F.concat("above", F.array("object_id"))
        closed = F.lit(depth + 1 >= limits.depth) | ((F.col("jcid") == S.TABLE) & F.col("table").isNotNull() & (F.col("tree") == 0))
        open_steps = F.when(~closed, F.filter("steps", lambda s: ~F.array_contains(within, s["ref"])))
        rows = once(level.filter(holds).join(about, OWN, "left"), open=open_steps).drop("steps")
        rows = once(rows, content=F.filter("open", lambda s: s["role"] == "content"))
        rows = rows.withColumn("next", F.concat(F.slice("content", 1, 1), F.filter("open", lambda s: s["role"] != "content")))
        rows = rows.withColumn("empty", (F.col("jcid") == S.OUTLINE_ELEMENT) & (F.coalesce(F.size("content"), F.lit(0)) <= 0)).drop("open", "content")
        rows = written(rows, "page-elements")
        if rows.isEmpty():
            break
        found.append(rows.withColumn("list", F.when(F.col("empty"), F.coalesce("list", "own_list")).otherwise(F.col("list"))).select(*columns))
        step, main, enters = F.col("s"), F.col("s")["role"] == "content", (F.col("jcid") == S.TABLE) & F.col("table").isNull()
        level = rows.withColumn("s", F.explode("next")).select(
            *K, "tree", "title_pos", F.concat("path", step["suffix"]).alias("path"), F.lit(depth + 1).alias("depth"), step["ref"].alias("object_id"), step["ref_type"].alias("jcid"), within.alias("above"),
            (main & ((F.col("depth") == 0) | F.col("top_chain"))).alias("top_chain"), F.when(main, F.coalesce("list", "own_list")).alias("list"), F.when(main, F.coalesce("own_tags", "tags")).alias("tags"),
            F.when(enters, F.col("path")).otherwise(F.col("table")).alias("table"), F.when(enters, step["r"]).otherwise(F.col("r")).alias("r"), F.when(enters, step["c"]).otherwise(F.col("c")).alias("c"),
        )
    return reduce(DataFrame.unionByName, found)


def _row(rows: DataFrame, key: Column, **own: Column) -> DataFrame:
    return rows.select(*K, key.alias("key"), own.get("text_id", F.lit(None).cast("string")).alias("text_id"), *(own[c].cast(kind).alias(c) if c in own else F.lit(None).cast(kind).alias(c) for c, kind in COLUMNS.items()))


def elements(pages: DataFrame, objects: DataFrame, limits: GraphLimits = GraphLimits()) -> DataFrame:
    """The rows of all pages (section, page_id, node_id) from their spaces' objects: section, page_id, ord and COLUMNS.
    Paragraphs, tables and assets as they are written (outlines before what lies on the page itself), a row of ink with all
    strokes and the words, one for each nested table that cannot be written, and the title as each title node gives it. A
    page with a fault is one row with its code."""
    own = written(pages.select(*SPACE, "node_id").dropna(subset=SPACE), "page-nodes")
    objects = objects.withColumnRenamed("space_id", "page_id").dropna(subset=SPACE)
    if own.count() <= FEW_PAGES:  # else the objects of other spaces are read, but no page leads to them
        objects = objects.join(F.broadcast(own.select(*SPACE)), SPACE, "left_semi")
    own, objects = numbered(own, objects)
    nodes = objects.of_type(S.PAGE).select(*OWN, prop(S.CHILDREN, "refs").alias("children"), prop(S.STRUCTURE, "refs").alias("structure"), prop(RECOGNISED, "refs").alias("recognised"))
    nodes = written(nodes.join(own.select(*K, F.col("node_id").alias("object_id")), OWN), "node-references")
    inks = inks_of(nodes, objects, limits)
    inks = written(inks, "inks") if objects.has(S.INK, INK_DATA) else inks.filter(F.lit(False))
    able = objects.known(*(k for k in KINDS if k != S.INK)).unionByName(objects.known(S.INK).join(inks.select(*K, F.col("object_id").alias("ref")), [*K, "ref"], "left_semi"))
    steps, shapes = steps_of(objects, able.unionByName(objects.known(S.ROW, S.CELL)))
    rich = objects.has(S.TITLE) or any(objects.has(k) for k in (S.IMAGE, S.EMBEDDED, S.TABLE, S.INK))
    kept = written if rich else lambda rows, _: rows  # what is read but once need not be written
    runs = kept(text_runs(objects), "text-runs")
    about = written(steps.join(list_marks(objects).withColumnRenamed("list", "own_list"), OWN, "full").join(tags_of(objects).withColumnRenamed("tags", "own_tags"), OWN, "full"), "about-objects")
    all_rows = kept(walk(nodes, objects, able, about, limits), "walked")
    faults = all_rows.join(inks.filter("code is not null").select(*OWN, "code"), OWN).groupBy(*K).agg(F.min_by("code", F.struct("tree", "title_pos", "path")).alias("code"))
    all_rows = all_rows.join(faults, K, "left_anti")

    # what lies on the page itself comes after the outlines: an outline element counts as its innermost content
    top = ((F.col("depth") == 0) | F.col("top_chain")) & ((F.col("jcid") != S.OUTLINE_ELEMENT) | F.col("empty"))
    paragraph = (F.col("jcid") == S.TEXT) | F.col("empty")
    slot = F.when(F.col("depth") == 0, F.when(F.col("jcid").isin(*OUTLINES), 0).otherwise(1)).otherwise(F.when(paragraph, 1).otherwise(0))
    # pages are dealt once, for this and for the order of their rows
    rows = all_rows.filter("tree = 0").withColumn("top", F.get("path", F.lit(0))).repartition(*K)
    rows = rows.withColumn("slot", F.max(F.when(top, slot)).over(Window.partitionBy(*K, "top"))).withColumn("key", F.concat(F.array("slot"), "path"))
    assets = rows.filter(F.col("jcid").isin(S.IMAGE, S.EMBEDDED)).select(*OWN, "key").join(files_of(objects), OWN)
    number = (F.row_number().over(Window.partitionBy(*K).orderBy("key")) - 1).cast("int")
    assets = assets.select(*K, "key", F.struct(number.alias("number"), "name", "extension", "reference", "image").alias("asset"))
    rows = kept(rows.join(assets, [*K, "key"], "left"), "placed-elements")

    texts = rows.filter(paragraph).withColumn("tags", F.coalesce(F.when(F.col("jcid") == S.TEXT, F.col("own_tags")), "tags"))
    no_runs = F.array().cast(f"array<{_RUN}>")
    shown = _row(texts.filter("table is null"), F.col("key"), kind=F.lit("paragraph"), level=F.col("list.level"), ordered=F.col("list.ordered"), format=F.col("list.format"), tags=F.col("tags"), text_id=F.col("object_id"))
    shown = shown.unionByName(_row(rows.filter("asset is not null and table is null"), F.col("key"), kind=F.lit("asset"), asset=F.col("asset")))
    part = lambda of, runs, asset: of.filter("table is not null").select(*K, "table", "r", "c", "key", F.struct(runs.cast(f"array<{_RUN}>").alias("runs"), asset.cast(_ASSET).alias("asset")).alias("part"))
    celled = texts.filter("table is not null").join(runs.select(*OWN, "runs"), OWN, "left")
    parts = part(celled, F.coalesce("runs", no_runs), F.lit(None)).unionByName(part(rows.filter("asset is not null"), F.lit(None), F.col("asset")))
    cells = parts.groupBy(*K, "table", "r", "c").agg(F.sort_array(F.collect_list(F.struct("key", "part"))).alias("parts"))
    cells = cells.select(*K, "table", F.concat_ws(",", "r", "c").alias("at"), F.transform("parts", lambda x: x["part"]).alias("parts")).groupBy(*K, "table").agg(F.map_from_entries(F.collect_list(F.struct("at", "parts"))).alias("filled"))
    tables = rows.filter((F.col("jcid") == S.TABLE) & F.col("table").isNull()).drop("table").join(shapes, OWN).join(cells.withColumnRenamed("table", "path"), [*K, "path"], "left")
    cell = lambda r, c: F.coalesce(F.try_element_at("filled", F.concat_ws(",", r, c)), F.array().cast(f"array<{_PART}>"))
    grid = F.transform("shape", lambda n, r: F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda c: cell(r, c)))
    last = F.array(F.lit((1 << 31) - 1))
    shown = shown.unionByName(_row(tables, F.concat("key", last), kind=F.lit("table"), cells=grid))
    shown = shown.unionByName(_row(rows.filter((F.col("jcid") == S.TABLE) & F.col("table").isNotNull()), F.col("key"), kind=F.lit("nested")))

    drawn = rows.filter(F.col("jcid") == S.INK).select(*OWN, "key").join(inks, OWN).select(*K, "key", "strokes", "words")
    strokes = drawn.groupBy(*K).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("key", "strokes"))), lambda x: x["strokes"])).alias("strokes"))
    words = changes(drawn.select(*K, "key", "words"), K, ["key"], "words").groupBy(*K).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("key", "words"))), lambda x: x["words"]), " ").alias("words"))
    counts = rows.filter("asset is not null").groupBy(*K).agg(F.count(F.lit(1)).cast("int").alias("assets"))
    ink = strokes.join(words, K, "left").join(counts, K, "left")
    drawing = F.struct(F.coalesce("assets", F.lit(0)).alias("number"), F.lit(None).cast("string").alias("name"), F.lit("svg").alias("extension"), F.lit(None).cast("string").alias("reference"), F.lit(True).alias("image"))
    shown = shown.unionByName(_row(ink, F.array(F.lit(2)), kind=F.lit("ink"), strokes=F.col("strokes"), words=F.col("words"), asset=drawing))

    # titles: the texts below each title node, in order, without those that are blank
    titles = nodes.select(*K, F.posexplode("structure").alias("title_pos", "ref")).join(objects.known(S.TITLE), [*K, "ref"]).select(*K, "title_pos").join(faults, K, "left_anti")
    said = all_rows.filter("tree = 1").join(runs.select(*OWN, "texts"), OWN, "left").join(inks.select(*OWN, "words"), OWN, "left")
    pieces = said.select(*K, "title_pos", "path", F.posexplode(F.coalesce("texts", F.array("words"))).alias("k", "piece")).filter(text.trim_space(F.col("piece")) != "")
    joined = pieces.groupBy(*K, "title_pos").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", "k", "piece"))), lambda x: x["piece"]), " ").alias("words"))
    titles = titles.join(joined, [*K, "title_pos"], "left")
    shown = shown.unionByName(_row(titles, F.array(F.lit(3), "title_pos"), kind=F.lit("title"), words=text.trim_space(F.coalesce("words", F.lit("")))))
    shown = shown.unionByName(_row(faults, F.array(F.lit(0)), kind=F.lit("fault"), code=F.col("code")))
    order = Window.partitionBy(*K).orderBy("key")
    shown = shown.withColumn("ord", (F.row_number().over(order) - 1).cast("int")).drop("key", "runs", "style").join(own.select(*K, *SPACE).distinct(), K)
    # what is wide comes to its place last
    wide = lambda found: found.withColumnRenamed("object_id", "text_id")
    shown = shown.join(wide(runs.select(*OWN, "runs")), [*K, "text_id"], "left").join(wide(style_names(objects)), [*K, "text_id"], "left")
    return shown.withColumn("runs", F.when(F.col("kind") == "paragraph", F.coalesce("runs", no_runs))).select(*SPACE, "ord", *COLUMNS)
