"""Revisions, objects and payloads of packaged sections, by joins over the relations of their data elements."""

from __future__ import annotations

import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirespark.functions import values
from quirespark.operators.relational import last_of, zip_positions
from quirespark.scratch import written
from quirespark.sources.cabinet import FormatError
from quirespark.sources.property_sets import GraphLimits, id_streams, property_rows
from quirespark.sources.sync_package import DEFAULT_CONTEXT, FILE, FILE_EXTENSION, FILE_REFERENCE, NIL, PROPERTIES, TYPE

CODE = "ONENOTE_FSSHTTPB_"
#: Kinds of references in the order in which their ids are checked.
STREAMS = ("object", "space", "context")
_LONGS = T.ArrayType(T.LongType())
_PROPERTY = pa.struct([("path", pa.string()), ("ord", pa.int32()), ("id", pa.int64()), ("flag", pa.bool_()), ("scalar", pa.int64()), ("data", pa.binary()), ("kind", pa.string()), ("refs", pa.list_(pa.string()))])
_PROPERTY_TYPE = T.StructType([T.StructField(n, t) for n, t in (("path", T.StringType()), ("ord", T.IntegerType()), ("id", T.LongType()), ("flag", T.BooleanType()), ("scalar", T.LongType()), ("data", T.BinaryType()), ("kind", T.StringType()), ("refs", T.ArrayType(T.StringType())))])


@F.arrow_udf(T.StructType([*(T.StructField(s, _LONGS) for s in STREAMS), T.StructField("code", T.StringType())]))
def streams_column(data: pa.Array) -> pa.Array:
    """The compact ids at the head of an object's properties, by what they refer to."""
    found = []
    for x in data.to_pylist():
        try:
            found.append(None if x is None else {**id_streams(x)[0], "code": None})
        except FormatError:
            found.append({"code": f"{CODE}OBJECT_STREAM"})
    return pa.array(found, pa.struct([*((s, pa.list_(pa.int64())) for s in STREAMS), ("code", pa.string())]))


def properties_column(limits: GraphLimits):
    """A column function: the properties of an object from their bytes and its id table, and the file that they name."""
    text = lambda b: None if not b else b[: len(b) // 2 * 2].decode("utf-16le", "replace").rstrip("\0")

    @F.arrow_udf(T.StructType([T.StructField("properties", T.ArrayType(_PROPERTY_TYPE)), T.StructField("file_ref", T.StringType()), T.StructField("file_ext", T.StringType()), T.StructField("code", T.StringType())]))
    def run(data: pa.Array, names: pa.Array) -> pa.Array:
        found = []
        for x, table in zip(data.to_pylist(), names.to_pylist(), strict=True):
            try:
                rows = None if x is None else property_rows(x, {e["index"]: e["guid"] for e in table or []}, limits)
            except FormatError as e:
                found.append({"code": e.code})
                continue
            last = {p.id: p.data for p in rows or [] if not p.path}
            raw = last.get(FILE_REFERENCE)
            file = f"<ifndf>{{{uuid.UUID(bytes_le=raw)}}}" if raw is not None and len(raw) == 16 else text(raw)
            own = None if rows is None else [{"path": p.path, "ord": p.ord, "id": p.id, "flag": p.flag, "scalar": p.scalar, "data": p.data, "kind": p.kind, "refs": p.refs} for p in rows]
            found.append({"properties": own, "file_ref": file, "file_ext": text(last.get(FILE_EXTENSION)), "code": None})
        return pa.array(found, pa.struct([("properties", pa.list_(_PROPERTY)), ("file_ref", pa.string()), ("file_ext", pa.string()), ("code", pa.string())]))

    return run


def reached_cells(cell_map: DataFrame, cell_manifests: DataFrame, rev_map: DataFrame, revisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(section, element, cell_a, cell_b): the cell of each revision element that a cell's chain reaches, of several the
    last; and (section, element, place): heads of chains. cell_map: section, ord, cell_a, cell_b, manifest; cell_manifests:
    section, manifest, current; rev_map: section, ord, revision, mapped (of repeated revisions the last counts);
    revisions: section, ord, element, revision, base. A chain ends before a revision that it has met. A round per link."""
    mapped = last_of(rev_map, ["section", "revision"], ["ord"]).select("section", F.col("revision").alias("current"), F.col("mapped").alias("element"))
    heads = cell_map.join(cell_manifests, ["section", "manifest"]).join(mapped, ["section", "current"]).join(revisions.select("section", "element", "revision", "base"), ["section", "element"])
    heads = heads.withColumn("place", F.row_number().over(Window.partitionBy("section").orderBy("ord")) - 1)
    by_id = written(last_of(revisions.select("section", "revision", "ord", "element", F.col("base").alias("below")), ["section", "revision"], ["ord"]).drop("ord"), "revisions-by-id")
    columns = ["section", "place", "cell_a", "cell_b", "element", "base", "met"]
    level = written(heads.withColumn("met", F.array("revision")).select(*columns), "cell-chains")
    found = [level]
    while True:
        below = level.drop("element").join(by_id.withColumnRenamed("revision", "base"), ["section", "base"]).filter(~F.array_contains("met", F.col("base")))
        level = written(below.select("section", "place", "cell_a", "cell_b", "element", F.col("below").alias("base"), F.concat("met", F.array("base")).alias("met")), "cell-chains")
        if level.isEmpty():
            break
        found.append(level)
    cells = last_of(reduce(DataFrame.unionByName, found).select("section", "element", "place", "cell_a", "cell_b"), ["section", "element"], ["place"]).drop("place")
    return cells, found[0].select("section", "element", "place")


def merged_objects(groups: DataFrame, declared: DataFrame, data: DataFrame) -> DataFrame:
    """(section, element, object_id, first, count, kind, body, blob_id, bad_type) of the objects of revisions' groups.
    Declarations meet data by their places in a group, as far as both go; of each part of an object the last counts, the
    number of its references is the highest, and objects come in the order in which they are first declared. groups:
    section, element, group_pos, group_id; declared: section, group_id, pos, object_id, blob, part, n; data: section,
    group_id, pos, data, ids, cells, data_blob."""
    rows = groups.join(declared.join(data, ["section", "group_id", "pos"]), ["section", "group_id"])
    at = F.struct("group_pos", "pos")
    last = lambda part, value: F.max_by(F.when(F.col("part") == part, value), F.when(F.col("part") == part, at))
    bad = (F.col("part") == TYPE) & (F.coalesce(F.octet_length("data"), F.lit(-1)) != 4)
    return rows.groupBy("section", "element", "object_id").agg(F.min(at).alias("first"), F.max("n").alias("count"), last(TYPE, F.col("data")).alias("kind"), last(PROPERTIES, F.struct("data", "ids", "cells")).alias("body"), last(FILE, F.coalesce("data_blob", "blob")).alias("blob_id"), F.max(bad).alias("bad_type"))


def id_tables(objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(section, obj_ord, names): the id table of each object with properties, from the compact ids of its properties and
    the long ids of its group by their places; and faults (section, at, code). objects: section, rev_ord, obj_ord, cell_a,
    body. References into the object's own cell name spaces, others contexts. Pairs of two nulls are skipped; a pair that
    one side lacks, an ordinal that differs and an index with two names are faults."""
    keys = ["section", "rev_ord", "obj_ord"]
    rows = objects.filter("body is not null").withColumn("s", streams_column("body.data"))
    apart = lambda own: F.filter("body.cells", lambda c: (c["a"] == F.col("cell_a")) == F.lit(own))
    longs = {"object": F.col("body.ids"), "space": F.transform(apart(True), lambda c: c["b"]), "context": F.transform(apart(False), lambda c: c["a"])}
    rows = rows.select(*keys, F.col("s.code").alias("code"), *(F.struct(F.col(f"s.{k}").alias("compact"), longs[k].alias("long")).alias(k) for k in STREAMS))
    pairs = reduce(DataFrame.unionByName, [zip_positions(rows.filter("code is null").select(*keys, F.col(k)["compact"].alias("compact"), F.col(k)["long"].alias("long")), "compact", "long", keys).withColumn("stream", F.lit(n)) for n, k in enumerate(STREAMS)])
    pairs = pairs.filter(~((F.coalesce("compact", F.lit(-1)) == 0) & (F.coalesce("long", F.lit("")) == NIL)))
    guid, number = F.regexp_extract("long", r"(?s)\A(.*):[^:]*\z", 1), F.regexp_extract("long", r"([0-9]+)\z", 1).cast("decimal(38)")
    index = F.shiftright("compact", 8)
    wrong = (index == 0xFFFFFF) | (guid == NIL[:-2]) | (number != F.col("compact").bitwiseAND(255))
    pairs = written(pairs.select(*keys, "stream", "pos", index.alias("index"), guid.alias("guid"), F.when(F.col("compact").isNull() | F.col("long").isNull(), "MAPPING_COUNT").when(wrong, "MAPPING").alias("fault")), "id-pairs")
    # of an index the name that comes first holds; a later pair of another name is a fault
    first = pairs.filter("fault is null").groupBy(*keys, "index").agg(F.min_by("guid", F.struct("stream", "pos")).alias("name"))
    named = pairs.join(first, [*keys, "index"], "left").withColumn("fault", F.coalesce("fault", F.when(F.col("guid") != F.col("name"), "MAPPING")))
    # a stream's counts are checked before its pairs
    turn = F.struct("rev_ord", F.lit(1).alias("stage"), "obj_ord", "stream", (F.col("fault") != "MAPPING_COUNT").alias("pair"))
    faults = named.filter("fault is not null").select("section", turn.alias("at"), F.concat(F.lit(CODE), "fault").alias("code"))
    broken = rows.filter("code is not null").select("section", F.struct("rev_ord", F.lit(1).alias("stage"), "obj_ord", F.lit(-1).alias("stream"), F.lit(False).alias("pair")).alias("at"), "code")
    tables = first.groupBy(*keys).agg(F.collect_list(F.struct("index", F.col("name").alias("guid"))).alias("names"))
    return tables.select("section", "obj_ord", "names"), faults.unionByName(broken)


def package_relations(parts: DataFrame, limits: GraphLimits) -> dict[str, DataFrame]:
    """The relations revisions, roles, roots, objects, payloads and faults (as object_graph.Relations has them) of what
    sync_package.package_rows tells. A section with a fault has one row in faults, that of the first fault in the order of
    its revisions and objects, and none elsewhere."""
    part = lambda name, *columns: parts.filter(F.col("part") == name).selectExpr("section", *columns)
    manifests = part("rev_manifest", "ord", "id AS element", "other AS revision", "extension AS base")
    cells, heads = reached_cells(part("cell_map", "ord", "context AS cell_a", "space AS cell_b", "id AS manifest"), part("cell_manifest", "id AS manifest", "other AS current"), part("rev_map", "ord", "id AS revision", "other AS mapped"), manifests)
    own_context = F.when(~F.col("cell_a").isin(NIL, DEFAULT_CONTEXT), F.col("cell_a"))
    revisions = manifests.join(cells, ["section", "element"]).withColumn("rev_ord", (F.row_number().over(Window.partitionBy("section").orderBy("ord")) - 1).cast("long"))
    revisions = written(revisions.select("section", "rev_ord", "element", F.col("revision").alias("rev_id"), F.when(F.col("base") != NIL, F.col("base")).alias("dep_id"), own_context.alias("context_id"), F.col("cell_b").alias("space_id"), F.lit(False).alias("is_encrypted"), "cell_a"), "package-revisions")
    groups = part("rev_group", "id AS element", "ord AS group_pos", "other AS group_id").join(revisions.select("section", "element"), ["section", "element"])
    objects = merged_objects(groups, part("decl", "id AS group_id", "ord AS pos", "other AS object_id", "extension AS blob", "number AS part", "count AS n"), part("data", "id AS group_id", "ord AS pos", "data", "ids", "cells", "extension AS data_blob"))
    objects = objects.join(revisions.select("section", "element", "rev_ord", "rev_id", "cell_a"), ["section", "element"])
    order = Window.partitionBy("section").orderBy("rev_ord", "first")
    objects = objects.withColumn("obj_ord", (F.row_number().over(order) - 1).cast("long")).withColumn("is_revision", F.row_number().over(Window.partitionBy("section", "object_id").orderBy("obj_ord")) > 1)
    objects = written(objects, "package-objects")
    tables, faults = id_tables(objects)
    made = objects.join(tables, ["section", "obj_ord"], "left").withColumn("made", properties_column(limits)("body.data", "names"))
    made = written(made.drop("names", "body"), "package-properties")
    turn = lambda stage, stream: F.struct("rev_ord", F.lit(stage).alias("stage"), "obj_ord", F.lit(stream).alias("stream"), F.lit(True).alias("pair")).alias("at")
    typed = objects.filter("bad_type").select("section", turn(0, -1), F.lit(f"{CODE}JCID").alias("code"))
    beyond = objects.filter(F.col("obj_ord") >= limits.objects).select("section", turn(1, -2), F.lit("ONENOTE_OBJECT_LIMIT").alias("code"))
    broken = made.filter("made.code is not null").select("section", turn(1, len(STREAMS)), F.col("made.code").alias("code"))
    faults = written(reduce(DataFrame.unionByName, [faults, typed, beyond, broken]).groupBy("section").agg(F.min_by("code", "at").alias("code")), "package-faults")
    whole = lambda rows: rows.join(faults, "section", "left_anti")
    byte = lambda at: F.conv(F.hex(F.substring("kind", at, 1)), 16, 10).cast("long")
    kind = F.coalesce(byte(1) + byte(2) * 256 + byte(3) * 65536 + byte(4) * (1 << 24), F.lit(0))
    made = whole(made)
    keyed = made.withColumn("key", values.file_key(F.col("made.file_ref"))).filter("key <> '' and blob_id is not null").select("section", "obj_ord", "key", "blob_id")
    keyed = last_of(keyed.join(part("blob", "id AS blob_id").distinct(), ["section", "blob_id"], "left_semi"), ["section", "key"], ["obj_ord"], descending=False)
    payloads = keyed.join(part("blob", "id AS blob_id", "data AS payload"), ["section", "blob_id"]).select("section", F.col("obj_ord").alias("ord"), "key", F.octet_length("payload").cast("long").alias("length"), "payload")
    return {
        "revisions": whole(revisions).select("section", "rev_ord", "rev_id", "dep_id", "context_id", "space_id", "is_encrypted"),
        "roles": whole(heads.join(revisions, ["section", "element"])).select("section", F.col("place").cast("long").alias("assoc_ord"), "rev_id", "rev_ord", "context_id", "space_id", F.lit(1).cast("long").alias("role"), "is_encrypted"),
        "roots": whole(part("rev_root", "id AS element", "ord AS root_ord", "number AS role", "other AS object_id").join(revisions.select("section", "element", "rev_id"), ["section", "element"])).select("section", "rev_id", "root_ord", "role", "object_id"),
        "objects": made.select("section", "obj_ord", "object_id", "rev_id", kind.alias("jcid"), "is_revision", F.col("count").alias("ref_count"), "made.file_ref", "made.file_ext", "made.properties"),
        "payloads": payloads,
        "faults": faults,
    }
