import struct

from pyspark.sql import functions as F

from quirespark.sources import cabinet, notes
from quirespark.streaming import inputs


def archive(entries, block=40, sums=True, method=0, reserve=b""):
    """A one-folder archive of stored blocks."""
    body = b"".join(x for _, x in entries)
    head = 36 + (4 + len(reserve) if reserve else 0)
    files, at = b"", 0
    for name, data in entries:
        files += struct.pack("<IIHHHH", len(data), at, 0, 0, 0, 0x80) + name.encode() + b"\0"
        at += len(data)
    blocks, parts = b"", [body[i : i + block] for i in range(0, len(body), block)]
    for p in parts:
        tail = struct.pack("<HH", len(p), len(p))
        blocks += struct.pack("<I", cabinet.checksum(tail + p) if sums else 0) + tail + p
    first_file = head + 8
    data_at = first_file + len(files)
    size = data_at + len(blocks)
    extra = struct.pack("<HBB", len(reserve), 0, 0) + reserve if reserve else b""
    return b"MSCF" + struct.pack("<IIIIIBBHHHHH", 0, size, 0, first_file, 0, 3, 1, 1, len(entries), 4 if reserve else 0, 0, 0) + extra + struct.pack("<IHH", data_at, len(parts), method) + files + blocks


ENTRIES = [("Group\\Sub/./Ä note.one", b"first section " * 9), ("b.ONE", b"xyz"), ("empty.one", b"")]


def test_round_trip(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    good = archive(ENTRIES[:2], reserve=b"abc")
    bad = bytearray(good)
    bad[-1] ^= 1
    for name, data in (("a.onepkg", good), ("deep/bad.OnePkg", bytes(bad)), ("z.one", b"loose"), ("c.onex", bytes.fromhex("d0cf11e0a1b11ae1")), ("skip.txt", b""), ("mszip.onepkg", archive(ENTRIES[:2], method=1)), ("cut.onepkg", good[:20])):
        (tmp_path / "in" / name).write_bytes(data)
    inputs = cabinet.discover(spark, str(tmp_path / "in"))
    assert inputs.count() == 6
    listed = {(r.input.rsplit("/", 1)[-1], r.entry_name): r for r in cabinet.list_sections(inputs).collect()}
    row = listed["a.onepkg", "Group\\Sub/./Ä note.one"]
    assert (row.title, row.groups, row.folder_index, row.expanded_length, row.code) == ("Ä note", ["Group", "Sub"], 0, 126, None)
    assert listed["cut.onepkg", None].error_kind == "malformed" and listed["c.onex", "c.onex"].error_kind == "unsupported"
    read = {(r.input.rsplit("/", 1)[-1], r.entry_name): r for r in cabinet.read_sections(inputs).collect()}
    assert [bytes(read["a.onepkg", n].content) for n, _ in ENTRIES[:2]] == [x for _, x in ENTRIES[:2]]
    assert read["bad.OnePkg", None].code == "ONENOTE_CAB_CHECKSUM" and read["mszip.onepkg", None].code == "ONENOTE_CAB_MSZIP"
    assert [r.entry_name for r in cabinet.read_sections(inputs, {"b.ONE"}).filter("code is null").collect()] == ["b.ONE"]
    small = {r.code for r in cabinet.read_sections(inputs, limits=cabinet.Limits(expanded_bytes=50)).collect()}
    assert "ONENOTE_CAB_EXPANDED_LIMIT" in small


def test_tree_and_report(spark, tmp_path):
    files = spark.createDataFrame([("a/b.md", b"one"), ("c.md", b"two"), ("../out.md", b"no")], "path string, content binary")
    out = str(tmp_path / "tree")
    assert {r.path: r.error for r in notes.write_tree(files, out).collect()} == {"a/b.md": None, "c.md": None, "../out.md": "outside the output folder"}
    assert {r.error for r in notes.write_tree(files.limit(1), out).collect()} == {"exists"}
    assert {r.error for r in notes.write_tree(files.limit(1), out, overwrite=True).collect()} == {None}
    assert (tmp_path / "tree" / "a" / "b.md").read_bytes() == b"one" and notes.dry_run(files).first().bytes == 8
    table = lambda rows, kind: spark.createDataFrame(rows, f"input string, ord int, {kind}")
    found = notes.report(table([("x", 2, "n2"), ("x", 1, "n1")], "path string"), table([], "path string"), table([("x", 1, "p", "i", "no-data")], "page string, item string, reason string"), table([("y", 1, "n", "limit", "C", "m")], "name string, kind string, code string, message string"))
    rows = {r.input: r for r in found.collect()}
    assert rows["x"].notes == ["n1", "n2"] and rows["x"].attachments == [] and rows["y"].errors[0].kind == "limit" and not rows["y"].cancelled
    assert notes.report_json(found).filter(F.col("json").contains('"notes":["n1","n2"]')).count() == 1


def test_incremental(spark, tmp_path):
    (tmp_path / "in").mkdir()
    seen = []
    for name in ("a.one", "b.one"):
        (tmp_path / "in" / name).write_bytes(b"x")
        inputs.incremental(spark, str(tmp_path / "in"), str(tmp_path / "state"), lambda df, _: seen.extend(r.path.rsplit("/", 1)[-1] for r in df.select("path").collect()))
    assert seen == ["a.one", "b.one"]
