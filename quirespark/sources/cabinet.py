"""Cabinet archives as tables: an index of entries, and the entries' bytes.

Faults of an input are rows with an error code, never failed jobs. Folders that no wanted entry lies in are not expanded.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import takewhile
from operator import xor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.functions import binary, text
from quirespark.operators.ranks import name_key, overall_rank
from quirespark.scratch import located, written
from quirespark.sources import lzx


class FormatError(ValueError):
    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


@dataclass(frozen=True)
class Limits:
    """Bytes of an entry, bytes of all folders together, entries."""

    entry_bytes: int = 512 << 20
    expanded_bytes: int = 2 << 30
    entries: int = 4096


@dataclass(frozen=True)
class Entry:
    name: str
    length: int
    folder: int
    offset: int


@dataclass(frozen=True)
class Layout:
    """folders: (first block, blocks, compression). reserve: bytes before each block's payload."""

    folders: list[tuple[int, int, int]]
    entries: list[Entry]
    reserve: int


def _unpack(form: str, data: bytes, at: int) -> tuple:
    try:
        return struct.unpack_from("<" + form, data, at)
    except struct.error:
        raise FormatError("ONENOTE_CAB_TRUNCATED") from None


def _name(data: bytes, at: int) -> tuple[bytes, int]:
    end = data.find(b"\0", at)
    if end < 0:
        raise FormatError("ONENOTE_CAB_STRING")
    return data[at:end], end + 1


def read_layout(data: bytes, limits: Limits = Limits(), total: int | None = None) -> Layout:
    """The folders and entries that an archive's first bytes name. total: its length, where data is only its begin."""
    if len(data) < 36 or data[:4] != b"MSCF":
        raise FormatError("ONENOTE_CAB_SIGNATURE")
    (size,), (first,), (n_folders, n_entries, flags) = _unpack("I", data, 8), _unpack("I", data, 16), _unpack("HHH", data, 26)
    if size > (len(data) if total is None else total) or not n_folders or n_entries > limits.entries:
        raise FormatError("ONENOTE_CAB_HEADER")
    at, folder_extra, block_extra = 36, 0, 0
    if flags & 4:
        header_extra, folder_extra, block_extra = _unpack("HBB", data, at)
        at += 4 + header_extra
    for bit in (1, 2):  # the names of the archives before and after, two strings each
        for _ in range(2 if flags & bit else 0):
            at = _name(data, at)[1]
    folders = [_unpack("IHH", data, at + k * (8 + folder_extra)) for k in range(n_folders)]
    entries, at = [], first
    for _ in range(n_entries):
        length, offset, folder, _, _, attributes = _unpack("IIHHHH", data, at)
        raw, at = _name(data, at + 16)
        if length > limits.entry_bytes:
            raise FormatError("ONENOTE_CAB_ENTRY_LIMIT")
        entries.append(Entry(raw.decode("utf-8", "replace") if attributes & 0x80 else raw.decode("latin-1"), length, folder, offset))
    return Layout(folders, entries, block_extra)


def checksum(data: bytes) -> int:
    """XOR of little-endian words; the rest is one big-endian number."""
    whole = len(data) // 4
    return reduce(xor, struct.unpack_from(f"<{whole}I", data), 0) ^ int.from_bytes(data[4 * whole :], "big")


def expanded_folder(data: bytes, folder: tuple[int, int, int], reserve: int, room: int, needed: int) -> bytes:
    at, blocks, method = folder
    parts, total = [], 0
    for _ in range(blocks):
        declared, packed, size = _unpack("IHH", data, at)
        start = at + 8 + reserve
        if start + packed > len(data):
            raise FormatError("ONENOTE_CAB_TRUNCATED")
        if declared and total < needed and checksum(data[at + 4 : start + packed]) != declared:
            raise FormatError("ONENOTE_CAB_CHECKSUM")
        parts.append((data[start : start + packed], size))
        total += size
        if total > room:
            raise FormatError("ONENOTE_CAB_EXPANDED_LIMIT")
        at = start + packed
    kind = method & 15
    if kind == 0:
        if any(len(p) != n for p, n in parts):
            raise FormatError("ONENOTE_CAB_UNCOMPRESSED")
        return b"".join(p for p, _ in parts)
    if kind == 3:
        return lzx.expand(parts, method >> 8 & 31, needed, FormatError)
    raise FormatError("ONENOTE_CAB_MSZIP" if kind == 1 else "ONENOTE_CAB_COMPRESSION")


def extract(data: bytes, wanted: set[str] | None = None, limits: Limits = Limits()) -> Iterator[tuple[Entry, bytes]]:
    """Wanted entries (None: all) with their bytes, in the archive's order."""
    layout = read_layout(data, limits)
    chosen = [e for e in layout.entries if wanted is None or e.name in wanted]
    needed: dict[int, int] = {}
    for e in chosen:
        if e.folder >= len(layout.folders):
            raise FormatError("ONENOTE_CAB_FOLDER")
        needed[e.folder] = max(needed.get(e.folder, 0), e.offset + e.length)
    expanded, room = {}, limits.expanded_bytes
    for k in sorted(k for k, n in needed.items() if n):
        expanded[k] = expanded_folder(data, layout.folders[k], layout.reserve, room, needed[k])
        room -= len(expanded[k])
    taken = 0
    for e in chosen:
        if e.folder not in expanded or e.offset + e.length > len(expanded[e.folder]):
            raise FormatError("ONENOTE_CAB_ENTRY_RANGE")
        taken += e.length
        if taken > limits.expanded_bytes:
            raise FormatError("ONENOTE_CAB_EXPANDED_LIMIT")
        yield e, expanded[e.folder][e.offset : e.offset + e.length]


#: Streams of a compound file that tell rights protection.
PROTECTED_STREAMS = {"EncryptedPackage", "DRMEncryptedTransform", "DRMEncryptedDataSpace"}


def compound_code(data: bytes) -> str:
    """Why a compound file is declined: its directory names streams of a protected document, or it is of no kind we know.
    The directory is followed as far as the file goes, also through tables that the header has no room to name."""
    try:
        sector, (n_fat, first) = 1 << struct.unpack_from("<H", data, 30)[0] % 32, struct.unpack_from("<II", data, 44)
        words = sector // 4
        whole = lambda k: len(data[(k + 1) * sector : (k + 2) * sector]) == sector
        read = lambda k: struct.unpack_from(f"<{words}I", data, (k + 1) * sector)
        tables, further, met = list(struct.unpack_from("<109I", data, 76)), struct.unpack_from("<I", data, 68)[0], set()
        while words > 1 and len(tables) < n_fat and further not in met and whole(further):
            met.add(further)
            *more, further = read(further)
            tables += more
        chain = [x for t in takewhile(whole, tables[:n_fat]) for x in read(t)]
    except struct.error:
        return "ONENOTE_ONEX_UNSUPPORTED"
    seen, at = set(), first
    while at not in seen and whole(at):
        seen.add(at)
        for k in range((at + 1) * sector, (at + 2) * sector - 127, 128):
            size = struct.unpack_from("<H", data, k + 64)[0]
            if size >= 2 and data[k + 66] and data[k : k + size - 2].decode("utf-16le", "replace") in PROTECTED_STREAMS:
                return "ONENOTE_ONEX_PROTECTED"
        at = chain[at] if at < len(chain) else 0xFFFFFFFE
    return "ONENOTE_ONEX_UNSUPPORTED"


#: Names of inputs, in any case, as the file listing's pattern: other files are not opened.
INPUT_NAMES = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in x) for x in ("one", "onepkg", "onex")) + "}"

#: The same for a whole path.
INPUT_PATTERN = r"(?i)\.(one|onepkg|onex)$"


def discover(spark: SparkSession, path: str) -> DataFrame:
    """Inputs below a folder (or one file): input, content, length, mod. Where contents are not asked for, none is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", INPUT_NAMES).load(path)
    return found.select(F.col("path").alias("input"), "content", "length", F.col("modificationTime").alias("mod"))


def in_name_order(rows: DataFrame, name: str, to: str = "input_ord") -> DataFrame:
    """Adds each row's place in the order in which a walk of folders, in name order, meets paths; see ranks.name_key. The
    sort is of names alone, in many tasks, so give it no contents."""
    return overall_rank(rows, [name_key(F.col(name)), F.col(name)], to)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """The inputs' names in order, without their contents: input, length, mod, input_ord."""
    return in_name_order(discover(spark, path).drop("content"), "input")


def given_inputs(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """Inputs (input, content) of files and folders, and their order (input, input_ord): files as given, whatever their
    names are, and those below a folder in name order. An input that is met twice counts where it is met first. A path
    that does not exist raises FileNotFoundError before anything is read."""
    found, met = [], F.lit(False)
    for k, path in enumerate(paths):
        at, store = located(spark, path)
        if not store.exists(at):
            raise FileNotFoundError(f"No such file or folder: {path}")
        folder, root = store.getFileStatus(at).isDirectory(), store.makeQualified(at).toString().rstrip("/")
        rows = discover(spark, path) if folder else spark.read.format("binaryFile").load(path).select(F.col("path").alias("input"), "content")
        below = F.substring("input", len(root) + 2, 1 << 30) if folder else F.lit("")
        found.append(rows.filter(~met).select("input", "content", F.lit(k).alias("given"), below.alias("below")))
        own = F.col("input").startswith(root + "/") & F.col("input").rlike(INPUT_PATTERN) if folder else F.col("input") == root
        met = met | own
    inputs = reduce(DataFrame.unionByName, found)
    order = overall_rank(inputs.drop("content"), ["given", name_key(F.col("below")), "below"], "input_ord").select("input", "input_ord")
    return inputs.select("input", "content"), written(order, "input-order")


def _rows(inputs: DataFrame, with_bytes: bool, wanted: set[str] | None, limits: Limits) -> DataFrame:
    schema = "input string, entry_name string, entry_ord int, folder_index int, expanded_length long, code string" + (", content binary" if with_bytes else "")
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.binary()][: len(names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list[list] = []
                try:
                    if data is None or data[:4] != b"MSCF":
                        kind = compound_code(data) if data and data[:8].hex() == "d0cf11e0a1b11ae1" else None
                        own = path.replace("\\", "/").rsplit("/", 1)[-1]
                        if wanted is None or own in wanted:
                            rows.append([path, own, 0, None, len(data or b""), kind, data])
                    elif with_bytes:
                        rows += [[path, e.name, k, e.folder, e.length, None, x] for k, (e, x) in enumerate(extract(data, wanted, limits))]
                    else:
                        rows += [[path, e.name, k, e.folder, e.length, None] for k, e in enumerate(read_layout(data, limits).entries) if wanted is None or e.name in wanted]
                except FormatError as e:
                    rows.append([path, None, None, None, None, e.code, None])
                for r in rows:
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(r, types, strict=False)], names=names)

    return inputs.select("input", "content").mapInArrow(run, schema)


def list_sections(inputs: DataFrame, wanted: set[str] | None = None, limits: Limits = Limits()) -> DataFrame:
    """Sections without decoding any: input, entry_name, entry_ord, folder_index, expanded_length, code (of a fault),
    error_kind, title, groups. A loose file is one section."""
    rows = _rows(inputs, False, wanted, limits)
    return rows.select("*", F.when(F.col("code").isNotNull(), text.error_kind(F.col("code"))).alias("error_kind"), text.entry_title(F.col("entry_name")).alias("title"), text.entry_groups(F.col("entry_name")).alias("groups"))


def read_sections(inputs: DataFrame, wanted: set[str] | None = None, limits: Limits = Limits()) -> DataFrame:
    """Sections with their bytes, and the container each is in by its own first bytes."""
    return _rows(inputs, True, wanted, limits).withColumn("container", binary.container_kind(F.col("content")))
