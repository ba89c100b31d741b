"""Whole conversions of sections written in both encodings."""

import struct

import pytest

from quirespark.operators import mapping as M
from quirespark.operators import spaces as S
from quirespark.plans import convert as C
from quirespark.sources import object_graph, revision_store, sync_package
from quirespark.sources.cabinet import FormatError
from tests import package_loop
from tests import section_writer as W

FILE_REF = 0x1C00343E


def graph_of(data, limits=object_graph.GraphLimits()):
    """The graph of a section of either encoding, by loops."""
    header = revision_store.read_header(data)
    if header.storage == "file-synchronization-package":
        return package_loop.graph_of(sync_package.read_package(data), object_graph.Graph, object_graph.Revision, object_graph.Object, limits)
    return object_graph._Desktop(data, header.length, limits).read(list(revision_store.read_lists(data, revision_store.StoreLimits())))


def page(title="First page", level=1, deleted=False, key="picture", desktop=True):
    """A page with a heading, a styled list, a box, an admonition, a table, a picture, a file without data, and ink."""
    w = W.wide
    para = lambda text, **more: (S.TEXT, {M.WIDE: w(text + "\0"), **more})
    named = f"<ifndf>{{{W.guid(key)}}}"
    box = {M.TAG_STATUS: 1, M.TAG_SHAPE: 3}
    star = {M.TAG_STATUS: 0, M.TAG_OF: [41]}
    path = [4, 0, 0, 10, 5, 0, 3]  # pairs of x and y deltas: x 0, 10 and then y 5, 8
    vector = lambda values: bytes([len(values) << 1]) + bytes([abs(v) << 1 | (v < 0) for v in values])
    dims = b"".join(W.uuid.UUID(g).bytes_le + bytes(16) for g in (C.mapping.values.DIMENSIONS["x"], C.mapping.values.DIMENSIONS["y"]))
    objects = {
        1: (S.MANIFEST, {S.CONTENT: [2]}),
        2: (S.PAGE, {S.MODIFIED_32: 1_400_000_000, S.CHILDREN: [3, 30], S.STRUCTURE: [60], M.RECOGNISED: [70]}),
        3: (S.OUTLINE, {S.CHILDREN: [4, 6, 8, 10, 13, 22, 24, 50]}),
        4: (S.OUTLINE_ELEMENT, {S.CONTENT: [5]}),
        5: (S.TEXT, {M.WIDE: w("A heading"), M.PARAGRAPH_STYLE: [40]}),
        6: (S.OUTLINE_ELEMENT, {S.CONTENT: [7], M.LIST_NODES: [42], M.CHILD_LEVEL: 1}),
        7: (S.TEXT, {M.WIDE: w("plain bold <x> ﷟HYPERLINK \"http://a/b c\" link"), M.RUN_ENDS: struct.pack("<II", 6, 15), M.RUN_STYLES: [43, 44, 43]}),
        8: (S.OUTLINE_ELEMENT, {S.CONTENT: [9]}),
        9: (S.TEXT, {M.WIDE: w("to do\rnext"), M.TAG_STATES: ("sets", [box])}),
        10: (S.OUTLINE_ELEMENT, {S.CONTENT: [11], S.CHILDREN: [12]}),
        11: (S.TEXT, {M.WIDE: w("Mind this"), M.TAG_STATES: ("sets", [star])}),
        12: (S.OUTLINE_ELEMENT, {S.CONTENT: [5]}),
        13: (S.OUTLINE_ELEMENT, {S.CONTENT: [14]}),
        14: (S.TABLE, {S.CHILDREN: [15, 18]}),
        15: (S.ROW, {S.CHILDREN: [16, 17]}),
        16: (S.CELL, {S.CHILDREN: [20]}),
        17: (S.CELL, {S.CHILDREN: [21, 22]}),
        18: (S.ROW, {S.CHILDREN: [19]}),
        19: (S.CELL, {S.CHILDREN: [20, 14, 25]}),  # itself, which is left out, and another table
        20: para("one | two"),
        21: para("  \n "),
        22: (S.IMAGE, {M.IMAGE_NAME: w("scan.png"), M.IMAGE_FILE: [23]}),
        24: (S.EMBEDDED, {M.FILE_NAME: w("report"), M.FILE_AT: [99]}),
        25: (S.TABLE, {}),
        30: para("On the page itself"),
        40: (0x120001, {M.STYLE_NAME: w("h2")}),
        41: (S.TAG_KIND, {M.TAG_SHAPE: 13, M.TAG_LABEL: w("Note")}),
        42: (S.NUMBER_LIST, {M.LIST_FORMAT: w("\x03�.x")}),
        43: (0x120001, {}),
        44: (0x120001, {M.MARKS["bold"]: True, M.HIGHLIGHT: 0x0000FF}),
        50: (S.INK, {M.INK_DATA: [51], M.SCALE_X: struct.pack("<f", 1.0), M.SCALE_Y: struct.pack("<f", 1.0)}),
        51: (S.INK_DATA, {M.STROKES: [52, 53]}),
        52: (S.STROKE, {M.STROKE_STYLE: [54], M.INK_PATH: vector([0, 10, 5, 3])}),
        53: (S.STROKE, {M.STROKE_STYLE: [54], M.INK_PATH: vector(path[1:6])}),
        54: (S.STROKE_STYLE, {M.INK_DIMENSIONS: dims, M.INK_COLOR: 0x00FF0000, M.INK_CLEAR: 51}),
        60: (S.TITLE, {S.CHILDREN: [61]}),
        61: para("Title from its node"),
        70: (0x20055, {M.WORD_PARTS: [71]}),
        71: (S.WORD, {M.WORD_TEXT: w("hello\0hallo\0"), M.WORD_STROKES: bytes(16) + struct.pack("<I", 52)}),
        80: (0x20030, {S.CACHED_TITLE: w(title), S.LEVEL: level, S.CREATED: 133_500_000_000_000_000} | ({S.DELETED: b"1"} if deleted else {})),
        81: (0x20044, {S.MODIFIED: 133_500_000_012_340_000}),
    }
    if desktop:
        objects[23] = (0x60036, (named, ".png"))
    else:
        objects[23] = (0x60036, {FILE_REF: W.guid(key).bytes_le, M.FILE_EXTENSION: w("png")})
    return {"objects": objects, "roots": {1: 1, 2: 80, 4: 81}}


def spaces(desktop=True, **pages):
    top = {"objects": {1: (S.SECTION, {S.CHILDREN: [2]}), 2: (S.SERIES, {S.CHILD_SPACES: ("spaces", list(pages) + list(pages)[:1])}), 3: (S.SECTION_DATA, {S.SECTION_NAME: W.wide("My: section")})}, "roots": {1: 1, 2: 3}}
    return {"section": top} | {k: page(desktop=desktop, **v) for k, v in pages.items()}


PAGES = {"a": {"title": "First page"}, "b": {"title": "First page", "level": 2}, "c": {"title": " "}, "d": {"title": "Gone", "deleted": True}}
BODY = """## A heading

1. plain **==🔴bold &lt;x>==** [link](http://a/b%20c)
- [x] to do  
next

> [!important] Note
> Mind this

## A heading

| one \\| two | ![](attachments/STEM%20image.png) |
| --- | --- |
| one \\| two |  |

![](attachments/STEM%20image.png)

On the page itself

![](attachments/STEM%20-%20Ink.svg)

hello"""


def inputs(spark, rows):
    return spark.createDataFrame(rows, "input string, content binary")


def expected_body(stem):
    return BODY.replace("STEM", stem.replace(" ", "%20")).replace("&lt;", "\\<")


@pytest.mark.parametrize("desktop", [True, False])
def test_notes_of_both_encodings(spark, desktop):
    picture = b"\x89PNG picture"
    made = spaces(desktop, **PAGES)
    if desktop:
        data = W.desktop(made, [("picture", picture)])
    else:
        data = W.packaged(made, [("blob", picture)], {(name, 23): "blob" for name in PAGES})
    done = C.convert(inputs(spark, [("x/one.one", data), ("x/bad.one", data[:120])]))
    assert [(r.name, r.kind, r.code) for r in done.errors.collect()] == [("bad", "malformed", "ONENOTE_TRUNCATED_STRUCTURE" if desktop else "ONENOTE_FSSHTTPB_RANGE")]
    notes = {r.path: bytes(r.content).decode() for r in done.notes.collect()}
    files = {r.path: bytes(r.content) for r in done.attachments.collect()}
    assert sorted(notes) == ["My section/First page.md", "My section/First page/First page.md", "My section/Title from its node.md"]
    note = notes["My section/First page.md"]
    head, body = note.split("---\n", 2)[1:]
    assert body == expected_body("First page") + "\n"
    assert 'title: "First page"' in head and 'section: "My: section"' in head and "\nnotebook" not in head and "\nupdated: 2024-05-12T16:53:20.000Z\n" in head
    assert "created" not in head  # its number is past 2^53, and such are not told
    assert "Title%20from%20its%20node%20-%20Ink.svg" not in notes["My section/Title from its node.md"]  # a copy of a drawing is written once
    assert files["My section/attachments/First page image.png"] == picture and b"<path" in files["My section/attachments/First page - Ink.svg"]
    assert sorted(files) == ["My section/First page/attachments/First page - Ink.svg", "My section/First page/attachments/First page image.png", "My section/attachments/First page - Ink.svg", "My section/attachments/First page image.png"]
    assert {(r.page, r.item, r.reason) for r in done.skipped.collect()} >= {("First page", "report", "no-data"), ("First page", "First page", "not-representable")}


def test_options(spark):
    data = W.desktop(spaces(**PAGES), [("picture", b"p")])
    options = C.Options(notebook="Book", attachments_dir=None, frontmatter=False, nest=False, include_deleted=True)
    done = C.convert(inputs(spark, [("x/one.one", data)]), options)
    notes = {r.path: bytes(r.content).decode() for r in done.notes.collect()}
    assert set(notes) == {f"Book/My section/{x}.md" for x in ("First page", "First page 1", "Gone", "Title from its node")}
    assert notes["Book/My section/Gone.md"].startswith("## A heading\n") and "![" not in notes["Book/My section/Gone.md"]
    assert done.attachments.count() == 0
    assert C.convert(inputs(spark, [])).notes.count() == 0 == C.convert(inputs(spark, [("n", None)])).notes.count()


def test_revisions_are_replayed(spark):
    made = {"section": spaces(a={})["section"], "a": {"objects": {80: (0x20030, {S.CACHED_TITLE: W.wide("Newer")})}, "roots": {2: 80}}}
    data = W.desktop(made, revisions={"a": [page(title="Older")]})
    graph = object_graph.relations(spark.createDataFrame([("s", data), ("t", b"junk"), ("u", None)], "section string, content binary"))
    objects, roots = S.materialized(graph)
    rows = S.pages(graph, objects, roots).collect()
    assert [(r.title, r.level, r.section_name) for r in rows] == [("Newer", 0, "My: section")]
    assert sorted((r.section, r.code) for r in graph.faults.collect()) == [("t", "ONENOTE_TRUNCATED_STRUCTURE"), ("u", "ONENOTE_TRUNCATED_STRUCTURE")]
    assert graph.objects.filter("section = 's'").count() == 3 + 1 + len(page()["objects"])


@pytest.mark.parametrize(
    ("change", "code"),
    [
        (lambda s: s["a"]["objects"].__setitem__(5, (S.TEXT, {S.CHILDREN: [5], 0x7C000001: b""})), "PROPERTY_TYPE"),
        (lambda s: s["a"]["roots"].__setitem__(1, 200), None),
    ],
)
def test_faults_of_objects(change, code):
    made = spaces(a={})
    change(made)
    if code is None:
        assert graph_of(W.desktop(made)).revisions[1].roots[0][1] == 1
        return
    with pytest.raises(FormatError, match=code):
        graph_of(W.desktop(made))


def test_faults_of_the_graph():
    made = spaces(a={})
    limits = object_graph.GraphLimits
    cases = {
        "OBJECT_LIMIT": lambda: graph_of(W.desktop(made), limits=limits(objects=3)),
        "ASSET_LIMIT": lambda: graph_of(W.desktop(made, [("k", b"12345")]), limits=limits(asset_bytes=4)),
        "PROPERTY_LIMIT": lambda: graph_of(W.desktop(made), limits=limits(properties=0)),
        "REVISION_ID": lambda: graph_of(W.desktop(made, extra=[W.node(0x1E, W.long_id("section/0", 1) + bytes(26))])),
        "GLOBAL_ID_INDEX": lambda: graph_of(W.desktop(made, extra=[W.node(0x24, struct.pack("<I", 0) + W.guid(1).bytes_le)])),
        "REVISION_ROLE_TARGET": lambda: graph_of(W.desktop(made, extra=[W.node(0x5C, W.long_id("nothing", 1) + struct.pack("<I", 1))])),
        "FSSHTTPB_TRAILING": lambda: graph_of(W.packaged(spaces(False, a={}), extra=b"\1")),
        "FSSHTTPB_RANGE": lambda: graph_of(W.packaged(spaces(False, a={}))[:200]),
    }
    for code, run in cases.items():
        with pytest.raises(FormatError) as e:
            run()
        assert e.value.code == f"ONENOTE_{code}"
    assert graph_of(W.desktop(made | {"section": made["section"] | {"encrypted": True}})).objects[0].properties is None


def test_stream_values():
    for n in (0, 1, 127, 128, 1 << 14, 1 << 40, (1 << 53) - 1):
        assert sync_package.Stream(W.compact(n)).compact() == n
    with pytest.raises(FormatError, match="HUGE_INTEGER"):
        sync_package.Stream(b"\x80" + b"\xff" * 8).compact()
    g = W.guid("g")
    for raw, n in ((bytes([5 << 3 | 4]), 5), (struct.pack("<H", 700 << 6 | 0x20), 700), ((90000 << 7 | 0x40).to_bytes(3, "little"), 90000), (b"\x80" + struct.pack("<I", 1 << 31), 1 << 31)):
        assert sync_package.Stream(raw + g.bytes_le).long_id() == f"{g}:{n}"
    assert sync_package.Stream(b"\0").long_id() == sync_package.NIL
    counts, deepest = sync_package.histogram(sync_package.walked(W.packaged(spaces(False, a={}))))
    assert counts[sync_package.ELEMENT] == 2 + 3 * 2 and deepest == 4
    assert revision_store.read_header(W.packaged(spaces(False, a={}))).storage == "file-synchronization-package"
