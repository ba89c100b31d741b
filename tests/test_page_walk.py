"""The walk over relations against a loop over one page, on made-up graphs."""

import random
import struct

import duckdb
import pytest
from pyspark.sql import functions as F

from quirespark import scratch
from quirespark.operators import mapping as M
from quirespark.operators import spaces as S
from quirespark.plans import catalogue, note_queries  # noqa: F401 (registers its queries)
from quirespark.sources.cabinet import FormatError
from quirespark.sources.property_sets import GraphLimits
from tests import page_walk
from tests import section_writer as W

PROPERTIES = "array<struct<path:string,ord:int,id:long,flag:boolean,scalar:long,data:binary,kind:string,refs:array<string>>>"
DIMS = b"".join(W.uuid.UUID(g).bytes_le + bytes(16) for g in (page_walk.values.DIMENSIONS["x"], page_walk.values.DIMENSIONS["y"]))


class Space:
    """Objects with random properties that refer to one another, in any direction."""

    def __init__(self, seed: int, size: int):
        self.rng, self.objects = random.Random(seed), []
        kinds = [S.OUTLINE, S.OUTLINE_GROUP, S.OUTLINE_ELEMENT, S.OUTLINE_ELEMENT, S.OUTLINE_ELEMENT, S.TEXT, S.TEXT, S.IMAGE, S.EMBEDDED, S.TABLE, S.ROW, S.CELL, S.INK, S.INK_DATA, S.STROKE, S.STROKE_STYLE, S.TITLE, S.WORD, S.TAG_KIND, S.NUMBER_LIST, 0x120001, 0x60036, 0x2FFFF]
        self.ids = [f"{'gh'[k % 2]}:{k}" for k in range(size)]
        self.kinds = dict(zip(self.ids, [S.PAGE] + [self.rng.choice(kinds) for _ in self.ids[1:]], strict=True))
        if seed % 2:  # ink is whole only if all its parts are there
            self.kinds |= dict(zip(self.ids[1:8], [S.INK, S.INK_DATA, S.STROKE, S.STROKE_STYLE, 0x2FFFF, S.WORD, S.OUTLINE], strict=False))
        for k, own in enumerate(self.ids):
            self.objects.append({"object_id": own, "jcid": self.kinds[own], "file_ref": self.rng.choice([None, f"<ifndf>{{{k}}}"]), "file_ext": self.rng.choice([None, ".png"]), "properties": None if self.rng.random() < 0.03 else self.properties(k)})

    def some(self, *kinds: int, most: int = 3) -> list[str]:
        fit = [i for i in self.ids if self.kinds[i] in kinds] or self.ids
        return [self.rng.choice(fit if self.rng.random() < 0.85 else self.ids + ["none:1"]) for _ in range(self.rng.choice((0, 1, 1, 2, most)))]

    def words(self) -> str:
        return "".join(self.rng.choice(["a", "é", " ", "\n", "😀", "text ", '﷟HYPERLINK "to" ', '﷟HYPERLINK ""', "²"]) for _ in range(self.rng.randrange(7)))

    def properties(self, k: int) -> list[dict]:
        rng, found = self.rng, []

        def put(prop: int, path: str = "", **own) -> int:
            if rng.random() < 0.9:
                found.append({"path": path, "ord": len(found), "id": prop & 0x7FFFFFFF, "flag": None, "scalar": None, "data": None, "kind": None, "refs": None} | own)
            return len(found) - 1

        elements = (S.OUTLINE, S.OUTLINE_ELEMENT, S.TEXT, S.TEXT, S.IMAGE, S.EMBEDDED, S.TABLE, S.INK)
        kind = self.kinds[self.ids[k]]
        below = {S.TABLE: (S.ROW,), S.ROW: (S.CELL,), S.CELL: (S.TABLE, S.TEXT, S.OUTLINE_ELEMENT, S.IMAGE), S.PAGE: (S.OUTLINE, S.OUTLINE, S.OUTLINE_ELEMENT, S.TEXT, S.TABLE, S.IMAGE, S.INK)}.get(kind, elements)
        refs = [r for _ in range(4 if kind == S.PAGE else 2) for r in self.some(*below, most=3)]
        put(S.CHILDREN, refs=[self.ids[1], *refs] if kind == S.PAGE and len(self.ids) > 1 else refs)
        if kind == S.PAGE:
            put(S.STRUCTURE, refs=self.some(S.TITLE, most=3))
            put(M.RECOGNISED, refs=self.some(0x2FFFF))
        if kind == S.OUTLINE_ELEMENT:
            put(S.CONTENT, refs=self.some(*elements, S.OUTLINE_ELEMENT))
            put(M.LIST_NODES, refs=self.some(S.NUMBER_LIST))
            put(M.CHILD_LEVEL, scalar=rng.randrange(4))
        put(M.WIDE, data=rng.choice([W.wide(self.words()), W.wide("x\0"), b""]))
        put(M.NARROW, data=rng.choice([b"narrow \xe9", b""]))
        put(M.RUN_ENDS, data=rng.choice([b"abc", struct.pack("<III", *(rng.randrange(12) for _ in range(3))), struct.pack("<I", 2)]))
        put(M.RUN_STYLES, refs=self.some(0x120001))
        put(M.PARAGRAPH_STYLE, refs=self.some(0x120001))
        put(M.STYLE_NAME, data=W.wide("h1"))
        for p in (M.MATH, M.LINKED, *M.MARKS.values()):
            put(p, flag=rng.random() < 0.3)
        put(M.ADDRESS, data=W.wide(rng.choice(["http://a/b c", "onenote:x#A%20page&y", "onenote:x#%zz", ""])))
        put(M.HIGHLIGHT, scalar=rng.choice([0xFF00, 0xFFFFFF, 0x1000000, 0]))
        if rng.random() < 0.5:
            at = put(M.TAG_STATES)
            if found and found[at]["id"] == M.TAG_STATES & 0x7FFFFFFF:
                at = found[at]["ord"]
                for n in range(rng.randrange(12)):
                    put(M.TAG_STATUS, f"/{at}.{n}", scalar=rng.choice([0, 1, 0x10, 0x11]))
                    put(M.TAG_SHAPE, f"/{at}.{n}", scalar=rng.randrange(20))
                    put(M.TAG_OF, f"/{at}.{n}", refs=self.some(S.TAG_KIND))
        put(M.TAG_SHAPE, scalar=rng.randrange(20))
        put(M.TAG_LABEL, data=W.wide("label"))
        put(M.LIST_FORMAT, data=rng.choice([W.wide("\x03�.x"), W.wide("\x01-"), b"a", b""]))
        put(M.IMAGE_NAME, data=W.wide("scan.png"))
        put(M.FILE_NAME, data=W.wide("file"))
        put(M.IMAGE_FILE, refs=self.some(0x60036))
        put(M.FILE_AT, refs=self.some(0x60036))
        put(M.FILE_EXTENSION, data=W.wide("gif"))
        put(M.INK_DATA, refs=[*self.some(S.INK_DATA), *self.some(S.INK_DATA)])
        put(M.STROKES, refs=[*self.some(S.STROKE), *self.some(S.STROKE)])
        put(M.STROKE_STYLE, refs=[*self.some(S.STROKE_STYLE), *self.some(S.STROKE_STYLE)])
        put(M.INK_PATH, data=rng.choice([bytes([8, 0, 20, 10, 7]), bytes([4, 2, 4]), b"\0", b""]))
        put(M.INK_DIMENSIONS, data=rng.choice([DIMS, DIMS, DIMS[:32]]))
        put(M.INK_WIDTH, data=struct.pack("<f", 90.0))
        put(M.INK_COLOR, scalar=0xFF)
        put(M.INK_CLEAR, scalar=rng.randrange(300))
        put(M.SCALE_X, data=struct.pack("<f", 2.0))
        put(M.WORD_PARTS, refs=self.some(S.WORD, 0x2FFFF))
        put(M.WORD_TEXT, data=rng.choice([W.wide("hello\0hallo\0"), W.wide("world\0"), b""]))
        strokes = [i for i in self.ids if self.kinds[i] == S.STROKE] or ["g:0"]
        put(M.WORD_STROKES, data=bytes(16) + b"".join(struct.pack("<I", int(rng.choice(strokes).split(":")[1])) + bytes(16) for _ in range(3)))
        return found


def plain(space: Space, limits: GraphLimits) -> list[dict]:
    try:
        return page_walk.page_elements(space.objects, space.ids[0], limits)
    except FormatError as e:
        return [{"kind": "fault", "code": e.code}]


def whole(row: dict) -> dict:
    """A row with every column, and every run with its address, whether or not it has any."""
    full = lambda runs: None if runs is None else [{"url": None} | r for r in runs]
    out = {c: row.get(c) for c in M.COLUMNS}
    out["runs"] = full(out["runs"])
    if out["cells"] is not None:
        out["cells"] = [[[{"runs": full(p["runs"]), "asset": p["asset"]} for p in cell] for cell in r] for r in out["cells"]]
    return out


@pytest.mark.parametrize("limits", [GraphLimits(depth=7), GraphLimits(depth=3)])
def test_walk_equals_loop(spark, limits):
    made = {f"p{k}": Space(k, 12 + 2 * k) for k in range(40)}
    bad = Space(1000, 30)
    for o in bad.objects:  # a broken ink path, met or not
        for p in o["properties"] or []:
            if p["id"] == M.INK_PATH & 0x7FFFFFFF:
                p["data"] = b"\x04\xff"
    made |= {"bad": bad, "none": Space(5, 1)}
    rows = [("s", page, *(o[c] for c in ("object_id", "jcid", "file_ref", "file_ext", "properties"))) for page, space in made.items() for o in space.objects]
    objects = spark.createDataFrame(rows, f"section string, space_id string, object_id string, jcid long, file_ref string, file_ext string, properties {PROPERTIES}").repartition(4)
    pages = spark.createDataFrame([("s", page, space.ids[0]) for page, space in made.items()], "section string, page_id string, node_id string")
    found: dict[str, list] = {}
    for r in M.elements(pages, objects, limits).orderBy("page_id", "ord").collect():
        own = r.asDict(True)
        assert own["ord"] == len(found.setdefault(own["page_id"], []))
        found[own["page_id"]].append(whole(own))
    kinds = set()
    for page, space in made.items():
        expected = [whole(r) for r in plain(space, limits)]
        kinds |= {r["kind"] for r in expected}
        assert [r["kind"] for r in found.get(page, [])] == [r["kind"] for r in expected], page
        for a, b in zip(found.get(page, []), expected, strict=True):
            assert a == b, page
    assert kinds >= {"paragraph", "table", "asset", "ink", "title", "nested"}


def test_no_pages(spark):
    objects = spark.createDataFrame([], f"section string, space_id string, object_id string, jcid long, file_ref string, file_ext string, properties {PROPERTIES}")
    pages = spark.createDataFrame([], "section string, page_id string, node_id string")
    assert M.elements(pages, objects).filter(F.lit(True)).collect() == []


def test_pages_of_texts_write_what_they_need(spark, monkeypatch):
    """Pages without ink, tables, files and titles pay for none of them, also where the objects of all spaces are read; no
    step writes a row for each run of a text."""
    sizes = {}

    def counted(rows, name, *by):
        found = scratch.written(rows, name, *by)
        sizes[name] = sizes.get(name, 0) + found.count()
        return found

    monkeypatch.setattr(M, "written", counted)
    monkeypatch.setattr(M, "FEW_PAGES", 0, raising=False)
    con = duckdb.connect()
    for table in ("orders", "lineitem"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '/root/testdata/sf0.001/{table}.parquet'")
    got = catalogue.QUERIES["page_walk"](spark, "/root/testdata/sf0.001").toArrow()
    con.register("got", got)
    columns = ", ".join(got.column_names)
    for a, b in (("got", f"({catalogue.ORACLES['page_walk']})"), (f"({catalogue.ORACLES['page_walk']})", "got")):
        assert con.sql(f"SELECT {columns} FROM {a} EXCEPT ALL SELECT {columns} FROM {b}").fetchall() == []
    assert not {"inks", "recognised", "word-parts", "children", "elements", "text-runs", "walked", "placed-elements"} & set(sizes)
    assert sum(sizes.values()) < 3 * sizes["page-objects"]
