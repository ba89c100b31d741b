"""Archives through the data source: against the plain reading of whole files, with filters pushed and not."""

import struct

import pytest
from pyspark.sql import functions as F

from quirespark.sources import archive_source as A
from quirespark.sources import cabinet
from tests.test_sources import ENTRIES, archive


def folders(*groups, block=40, spoil=None):
    """An archive of one stored folder per group of entries. spoil: (folder, block) whose checksum is wrong."""
    files, spans = b"", []
    for k, entries in enumerate(groups):
        at = 0
        for name, data in entries:
            files += struct.pack("<IIHHHH", len(data), at, k, 0, 0, 0x80) + name.encode() + b"\0"
            at += len(data)
        body = b"".join(x for _, x in entries)
        parts = [body[i : i + block] for i in range(0, len(body), block)]
        span = b""
        for n, p in enumerate(parts):
            tail = struct.pack("<HH", len(p), len(p))
            span += struct.pack("<I", cabinet.checksum(tail + p) ^ (spoil == (k, n))) + tail + p
        spans.append((span, len(parts)))
    first = 36 + 8 * len(groups)
    at, heads = first + len(files), b""
    for span, n in spans:
        heads += struct.pack("<IHH", at, n, 0)
        at += len(span)
    n_entries = sum(map(len, groups))
    return b"MSCF" + struct.pack("<IIIIIBBHHHHH", 0, at, 0, first, 0, 3, 1, len(groups), n_entries, 0, 0, 0) + heads + files + b"".join(s for s, _ in spans)


GROUPS = [("a.one", b"A" * 70), ("b.one", b"B" * 90), ("e.one", b"")], [("c.one", b"C" * 50)], [("d.one", b"D" * 10), ("Ä.one", b"x" * 41)]


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    at = tmp_path_factory.mktemp("archives")
    (at / "deep").mkdir()
    good = folders(*GROUPS)
    data = {"many.onepkg": good, "spoilt.onepkg": folders(*GROUPS, spoil=(0, 2)), "deep/one.ONEPKG": archive(ENTRIES, reserve=b"abc"), "z.one": b"loose", "none.one": b"", "c.onex": bytes.fromhex("d0cf11e0a1b11ae1"), "cut.onepkg": good[:20], "short.onepkg": good[:-5], "zip.onepkg": archive(ENTRIES[:2], method=1), "skip.txt": b"MSCF"}
    for name, x in data.items():
        (at / name).write_bytes(x)
    return at


def told(df):
    return sorted((tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("split", [1, 64 << 20])
def test_sound_archives_as_the_plain_reading(spark, root, split):
    for name in ("many.onepkg", "deep", "z.one", "c.onex"):
        plain = cabinet.read_sections(cabinet.given_inputs(spark, [str(root / name)])[0]).drop("container")
        assert told(A.archives(spark, str(root / name), split_bytes=split)) == told(plain)
    index = A.archives(spark, str(root), contents=False, split_bytes=split)
    assert "content" not in index.columns
    listed = cabinet.list_sections(cabinet.discover(spark, str(root))).select(*index.columns)
    assert told(index.filter("entry_name is null or entry_name <> 'none.one'")) == told(listed)  # Spark's reader of files leaves out empty ones
    assert told(A.archives(spark, str(root / "none.one"), split_bytes=split).drop("input")) == [("none.one", 0, None, 0, None, b"")]


@pytest.mark.parametrize("split", [1, 64 << 20])
def test_faults_are_rows_of_their_entries(spark, root, split):
    rows = {(r.input.rsplit("/", 1)[-1], r.entry_name): r for r in A.archives(spark, str(root), split_bytes=split).collect()}
    of = lambda name: {e: r.code for (n, e), r in rows.items() if n == name}
    # the third block of the first folder is spoilt: a.one ends before it, b.one in or behind it, and e.one, without bytes, at the end
    assert of("spoilt.onepkg") == {"a.one": None, "b.one": "ONENOTE_CAB_CHECKSUM", "e.one": "ONENOTE_CAB_CHECKSUM", "c.one": None, "d.one": None, "Ä.one": None}
    assert bytes(rows["spoilt.onepkg", "a.one"].content) == b"A" * 70 and rows["spoilt.onepkg", "b.one"].content is None
    assert bytes(rows["spoilt.onepkg", "Ä.one"].content) == b"x" * 41
    assert of("cut.onepkg") == {None: "ONENOTE_CAB_SIGNATURE"} and of("short.onepkg") == {None: "ONENOTE_CAB_HEADER"}
    assert set(of("zip.onepkg").values()) == {"ONENOTE_CAB_MSZIP"} and of("c.onex") == {"c.onex": "ONENOTE_ONEX_UNSUPPORTED"}
    small = A.archives(spark, str(root / "many.onepkg"), limits=cabinet.Limits(expanded_bytes=60), split_bytes=split)
    assert {r.entry_name: r.code for r in small.collect()} == {n: "ONENOTE_CAB_EXPANDED_LIMIT" if g is GROUPS[0] else None for g in GROUPS for n, _ in g}


@pytest.mark.parametrize("split", [1, 64 << 20])
@pytest.mark.parametrize("condition", ["entry_name = 'c.one'", "entry_name in ('a.one', 'Ä.one', 'z.one')", "entry_name like '%.ONE' and input like '%/deep/%'", "entry_name is not null and folder_index = 0", "entry_name = 'b.one' or code is not null", "input like '%many%'", "entry_name = 'nothing'"])
def test_pushed_filters_change_no_row(spark, root, split, condition):
    df = A.archives(spark, str(root), split_bytes=split)
    behind = spark.createDataFrame(df.collect(), df.schema)
    assert told(df.filter(condition)) == told(behind.filter(condition))


def test_the_plan_shows_the_pushed_filter(spark, root, capsys):
    A.archives(spark, str(root)).filter("entry_name = 'c.one' and folder_index = 1").explain("formatted")
    plan = capsys.readouterr().out
    assert "PushedFilters: [IsNotNull(entry_name), EqualTo(entry_name,c.one)]" in plan
    behind = plan[plan.index("Condition") :].split("\n")[0]  # what the source does not answer, Spark does
    assert "folder_index" in behind and "entry_name" not in behind


def test_folders_without_wanted_entries_are_not_expanded(root, monkeypatch):
    reader = A.ArchiveReader(str(root / "many.onepkg"), True, cabinet.Limits(), 1)
    assert list(reader.pushFilters([A.EqualTo(("entry_name",), "c.one"), A.EqualTo(("code",), "x")])) == [A.EqualTo(("code",), "x")]
    parts = reader.partitions()
    assert [p.folder for p in parts] == [1]
    opened = []
    monkeypatch.setattr(A, "expanded_folder", lambda data, *args: opened.append(len(data)) or cabinet.expanded_folder(data, *args))
    assert [b.column("content")[0].as_py() for p in parts for b in reader.read(p)] == [b"C" * 50]
    assert opened == [50 + 2 * 8]  # the folder's own blocks, and no other bytes
    every = A.ArchiveReader(str(root / "many.onepkg"), True, cabinet.Limits(), 1)
    assert [p.folder for p in every.partitions()] == [0, 1, 2]


def test_paths(spark, root, tmp_path):
    assert A.archives(spark, str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="No such file or folder"):
        A.archives(spark, str(tmp_path / "nothing")).count()
    assert A.archives(spark, f"file://{root}/many.onepkg").agg(F.sum("expanded_length")).first()[0] == 261
