"""What keeps the walk's cost per object low: texts cut at once, look-ups without lambdas, pages by number."""

import random
import struct

import pyarrow as pa
from pyspark.sql import functions as F

from quirespark.operators import mapping as M
from quirespark.operators import spaces as S
from tests import section_writer as W

PROPERTIES = "array<struct<path:string,ord:int,id:long,flag:boolean,scalar:long,data:binary,kind:string,refs:array<string>>>"
OBJECTS = f"section string, space_id string, object_id string, jcid long, file_ref string, file_ext string, properties {PROPERTIES}"


def own(prop: int, path: str = "", **fields) -> dict:
    return {"path": path, "ord": 0, "id": prop & 0x7FFFFFFF, "flag": None, "scalar": None, "data": None, "kind": None, "refs": None} | fields


def test_plain_texts_are_cut_at_once(monkeypatch):
    def refused(data):
        raise AssertionError("a text at a time")

    monkeypatch.setattr(M.values, "wide_text", refused)
    wide = [W.wide("bold and plain"), W.wide("é漢﻿\0"), W.wide("x"), W.wide("a\0b")]
    ends = [struct.pack("<II", 4, 8), struct.pack("<III", 2, 1, 99), None, b"odd"]
    found = M.run_texts_column.func(pa.array(wide, pa.binary()), pa.array([None] * 4, pa.binary()), pa.array(ends, pa.binary()))
    assert found.to_pylist() == [["bold", " and", " plain"], ["é漢", "", "﻿", ""], ["x"], ["a\0b"]]


def test_texts_at_once_equal_a_text_at_a_time():
    rng = random.Random(1)
    for k in range(400):
        rows = []
        for _ in range(rng.randrange(12)):
            text = "".join(rng.choice(["a", "é", " x", "b\0c", "漢", "﻿", *["😀"] * (k % 2)]) for _ in range(rng.randrange(9))).encode("utf-16le")
            wide = rng.choice([text, text + b"\0\0", *([text + b"\0\0\0\0", text + b"x", text[1:], text + b"\0\xd8", b"", None, b"\0\0"] if k % 2 else [])])
            ends = rng.choice([None, b"", b"abc", struct.pack("<III", *(rng.choice([0, 1, 3, 9, 2**32 - 1]) for _ in range(3)))])
            rows.append((wide, rng.choice([None, b"n\xe9", b"z\0"]), ends))
        columns = [pa.array([r[c] for r in rows], pa.binary()).slice(k % 3) for c in range(3)]
        assert M.run_texts_column.func(*columns).to_pylist() == M._runs(*columns).to_pylist()


def test_look_ups_take_the_last_own_property_without_lambdas(spark):
    rows = [
        ("s", "p", "o:1", S.TEXT, None, None, [own(M.CHILD_LEVEL, scalar=1), own(M.CHILD_LEVEL, scalar=2), own(M.CHILD_LEVEL, "/0.0", scalar=3)]),
        ("s", "p", "o:2", S.TEXT, None, None, [own(M.CHILD_LEVEL, "/0.0", scalar=3)]),
        ("s", "p", "o:3", S.TEXT, None, None, [own(M.HIGHLIGHT, scalar=4), own(M.CHILD_LEVEL, scalar=5)]),
        ("s", "p", "o:4", S.TEXT, None, None, None),
        ("s", "p", "o:5", S.TEXT, None, None, []),
    ]
    objects = M.Objects.of(spark.createDataFrame(rows, OBJECTS).withColumnRenamed("space_id", "page_id").withColumn("page", F.lit(1).cast("long")))
    found = objects.of_type(S.TEXT).select("object_id", M.prop(M.CHILD_LEVEL, "scalar").alias("level"))
    assert {r.object_id: r.level for r in found.collect()} == {"o:1": 2, "o:2": None, "o:3": 5, "o:4": None, "o:5": None}
    assert "lambda" not in found._jdf.queryExecution().toString()


def test_spaces_of_one_number_are_numbered_anew(spark, monkeypatch):
    usual, turns = M.page_number, []

    def number(turn):
        turns.append(turn)
        return F.lit(7).cast("long") if turn == 0 else usual(turn)

    monkeypatch.setattr(M, "page_number", number)
    spaces = [("s", "a"), ("s", "b"), ("sa", "")]
    objects = spark.createDataFrame([(*x, "o:1", S.TEXT, None, None, []) for x in spaces], OBJECTS).withColumnRenamed("space_id", "page_id")
    pages = spark.createDataFrame([(*x, "o:1") for x in spaces[:2]], "section string, page_id string, node_id string")
    pages, held = M.numbered(pages, objects)
    of = {(r.section, r.page_id): r.page for r in held.rows.collect()}
    assert len(set(of.values())) == 3 and max(turns) == 1
    assert {(r.section, r.page_id): r.page for r in pages.collect()} == {x: of[x] for x in spaces[:2]}
