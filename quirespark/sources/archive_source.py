"""Archives as a data source of Spark: `archives(spark, path)`, or format "quire_archive" once it is registered.

A row per entry, and one for each loose file. Filters on `input` and `entry_name` are pushed to the source: a file that they
rule out is not opened, and a folder that holds no wanted entry is not expanded. A large archive is read by a task for each
of its folders, which reads that folder's bytes alone; small files share tasks. Files lie where pyarrow's file systems reach.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    StringContains,
    StringEndsWith,
    StringStartsWith,
)

from quirespark.sources.cabinet import (
    INPUT_PATTERN,
    Entry,
    FormatError,
    Layout,
    Limits,
    compound_code,
    expanded_folder,
    read_layout,
)

NAME = "quire_archive"
INDEX = "input string, entry_name string, entry_ord int, folder_index int, expanded_length long, code string"
TYPES = {"input": pa.string(), "entry_name": pa.string(), "entry_ord": pa.int32(), "folder_index": pa.int32(), "expanded_length": pa.int64(), "code": pa.string(), "content": pa.binary()}

#: Bytes that an archive's index is first looked for in.
HEAD = 1 << 16

#: Columns whose filters the source answers itself.
KEYS = ("input", "entry_name")

_TESTS: dict[type, Callable[[Filter, str], bool]] = {
    EqualTo: lambda f, v: v == f.value,
    In: lambda f, v: v in f.value,
    IsNotNull: lambda f, v: True,
    StringContains: lambda f, v: f.value in v,
    StringEndsWith: lambda f, v: v.endswith(f.value),
    StringStartsWith: lambda f, v: v.startswith(f.value),
}


@dataclass
class Files(InputPartition):
    """Files (path, length) that a task reads; folder: the only one of them that it reads, of one file."""

    files: list[tuple[str, int]]
    folder: int | None = None


def _store(path: str) -> tuple[pafs.FileSystem, str, str]:
    """The file system of a path, the path there, and what stands before such a path in the names that Spark gives."""
    found = re.match(r"([a-z][a-z0-9+.-]+):(//[^/]*)?", path)
    if found is None or found[1] == "file":
        return pafs.LocalFileSystem(), os.path.abspath(path[len(found[0]) :] if found else path), "file:"
    store, at = pafs.FileSystem.from_uri(path)
    return store, at, path[: len(path) - len(at)] if path.endswith(at) else found[0]


def _layout(f: pa.NativeFile, size: int, limits: Limits) -> Layout:
    """The index, from as few of the first bytes as hold it."""
    n = HEAD
    while True:
        try:
            return read_layout(f.read_at(min(n, size), 0), limits, size)
        except FormatError as e:
            if n >= size or e.code not in ("ONENOTE_CAB_TRUNCATED", "ONENOTE_CAB_STRING"):
                raise
            n *= 4


def _expanded(f: pa.NativeFile, size: int, layout: Layout, folder: int, ends: list[int], limits: Limits) -> tuple[bytes, str | None]:
    """A folder's bytes as far as they can be had, up to one of the ends (ascending), and why not further."""
    start, blocks, method = layout.folders[folder]
    next_one = min((s for s, _, _ in layout.folders if s > start), default=size)
    data = f.read_at(max(next_one - start, 0), start)

    def upto(end: int) -> bytes:
        return expanded_folder(data, (0, blocks, method), layout.reserve, limits.expanded_bytes, end)

    try:
        try:
            return upto(ends[-1]), None
        except FormatError as e:
            if e.code != "ONENOTE_CAB_TRUNCATED" or next_one >= size:
                raise
            data = f.read_at(size - start, start)  # folders that overlap
            return upto(ends[-1]), None
    except FormatError as e:
        code = e.code

    def fails(end: int) -> bool:
        try:
            upto(end)
        except FormatError:
            return True
        return False

    good = bisect_left(ends, True, key=fails)
    last = ends[good - 1] if good else 0
    return upto(last)[:last] if last else b"", code  # what lies behind was not verified


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, contents: bool, limits: Limits, split_bytes: int) -> None:
        self.path, self.contents, self.limits, self.split_bytes = path, contents, limits, split_bytes
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802 (the interface's name)
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in KEYS:
                self.filters.append(f)
            else:
                yield f

    def wanted(self, column: str, value: str | None) -> bool:
        own = [f for f in self.filters if f.attribute[0] == column]
        return all(value is not None and _TESTS[type(f)](f, value) for f in own)

    def partitions(self) -> list[InputPartition]:
        store, at, scheme = _store(self.path)
        found = store.get_file_info(at)
        if found.type == pafs.FileType.NotFound:
            raise FileNotFoundError(f"No such file or folder: {self.path}")
        below = [found] if found.is_file else [i for i in store.get_file_info(pafs.FileSelector(at, recursive=True)) if i.is_file and re.search(INPUT_PATTERN, i.path)]
        files = [(i.path, i.size) for i in sorted(below, key=lambda i: i.path) if self.wanted("input", scheme + i.path)]
        parts: list[Files] = []
        room = 0
        for path, size in files:
            if size >= self.split_bytes and self.contents:
                parts += [Files([(path, size)], k) for k in self._folders(store, path, size)]
                room = 0
            elif room >= size and parts:
                parts[-1].files.append((path, size))
                room -= size
            else:
                parts.append(Files([(path, size)]))
                room = self.split_bytes - size
        return parts or [Files([])]

    def _folders(self, store: pafs.FileSystem, path: str, size: int) -> list[int | None]:
        """The folders of a large archive that wanted entries lie in; [None] for what is no archive, or a faulty one."""
        with store.open_input_file(path) as f:
            if f.read_at(4, 0) != b"MSCF":
                return [None]
            try:
                layout = _layout(f, size, self.limits)
            except FormatError:
                return [None]
        return sorted({e.folder for e in layout.entries if self.wanted("entry_name", e.name)})

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        store, _, scheme = _store(self.path)
        names = [c for c in TYPES if self.contents or c != "content"]
        for path, size in partition.files:
            with store.open_input_file(path) as f:
                for row in self._rows(f, path, size, partition.folder):
                    values = [scheme + path, *row][: len(names)]
                    yield pa.RecordBatch.from_arrays([pa.array([v], TYPES[c]) for c, v in zip(names, values, strict=True)], names=names)

    def _rows(self, f: pa.NativeFile, path: str, size: int, folder: int | None) -> Iterator[tuple]:
        head = f.read_at(min(8, size), 0)
        if head[:4] != b"MSCF":
            own = path.rsplit("/", 1)[-1]
            if self.wanted("entry_name", own):
                compound = head.hex() == "d0cf11e0a1b11ae1"
                data = f.read_at(size, 0) if self.contents or compound else None
                yield own, 0, None, size, compound_code(data) if compound else None, data
            return
        try:
            layout = _layout(f, size, self.limits)
        except FormatError as e:
            if self.wanted("entry_name", None):
                yield None, None, None, None, e.code, None
            return
        chosen: dict[int, list[tuple[int, Entry]]] = {}
        for k, e in enumerate(layout.entries):
            if (folder is None or e.folder == folder) and self.wanted("entry_name", e.name):
                chosen.setdefault(e.folder, []).append((k, e))
        for own, entries in sorted(chosen.items()):
            data, fault = b"", None
            if self.contents and own < len(layout.folders):
                ends = sorted({e.offset + e.length for _, e in entries})
                data, fault = _expanded(f, size, layout, own, ends, self.limits)
            for k, e in entries:
                missing = self.contents and e.offset + e.length > len(data)
                code = "ONENOTE_CAB_FOLDER" if own >= len(layout.folders) else (fault or "ONENOTE_CAB_ENTRY_RANGE") if missing else None
                yield e.name, k, own, e.length, code, None if code else data[e.offset : e.offset + e.length]


class ArchiveSource(DataSource):
    """Options: path; contents (true: with the column content); splitBytes (archives of as many bytes are read by a task
    for each folder); entryBytes, expandedBytes (of a folder), maxEntries."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def _contents(self) -> bool:
        return self.options.get("contents", "true").lower() != "false"

    def schema(self) -> str:
        return INDEX + (", content binary" if self._contents() else "")

    def reader(self, schema) -> ArchiveReader:
        least = Limits()
        own = {k: int(self.options.get(option, getattr(least, k))) for k, option in (("entry_bytes", "entryBytes"), ("expanded_bytes", "expandedBytes"), ("entries", "maxEntries"))}
        return ArchiveReader(self.options["path"], self._contents(), Limits(**own), int(self.options.get("splitBytes", 64 << 20)))


def archives(spark: SparkSession, path: str, contents: bool = True, limits: Limits = Limits(), split_bytes: int = 64 << 20) -> DataFrame:
    """Entries of the archives, and loose files, below a folder (or of one file): input, entry_name, entry_ord, folder_index,
    expanded_length, code and, if asked for, content. Without contents only the indexes of archives are read.

    Filters on input and entry_name reach the source (the session's spark.sql.python.filterPushdown.enabled is set), and
    give the rows that they would give behind it. An entry that cannot be had is a row with a code and no content, and the
    others are read; of an archive whose index is faulty there is one row, without an entry. Each folder is held to
    limits.expanded_bytes by itself. An empty file is a row of no bytes; a folder without inputs gives no rows.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveSource)
    own = {"entryBytes": "entry_bytes", "expandedBytes": "expanded_bytes", "maxEntries": "entries"}
    options = {k: str(asdict(limits)[v]) for k, v in own.items()}
    return spark.read.format(NAME).options(contents=str(contents).lower(), splitBytes=str(split_bytes), **options).load(path)
