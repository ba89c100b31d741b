"""Property sets: typed values of an object, and the references that they take from the object's id streams in turn."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

from quirespark.sources.cabinet import FormatError

#: Representations of values by type code. Sizes of plain numbers; reference streams with the number of ids
#: (None: a count comes first).
NUMBERS = {0x03: 1, 0x04: 2, 0x05: 4, 0x06: 8}
REFERENCES = {0x08: ("object", 1), 0x09: ("object", None), 0x0A: ("space", 1), 0x0B: ("space", None), 0x0C: ("context", 1), 0x0D: ("context", None)}
NOTHING, FLAG, BYTES, SETS, SET = 0x01, 0x02, 0x07, 0x10, 0x11
STREAMS = ("object", "space", "context")
#: Bits of a stream's header.
NO_SPACES, MORE, RESERVED, COUNT = 1 << 31, 1 << 30, 0x3F000000, 0xFFFFFF
#: Whole numbers above this are not told.
EXACT = (1 << 53) - 1


@dataclass(frozen=True)
class GraphLimits:
    objects: int = 1_000_000
    properties: int = 65_536
    depth: int = 128
    asset_bytes: int = 64 << 20
    total_asset_bytes: int = 256 << 20
    page_nodes: int = 100_000
    ink_values: int = 1_000_000


@dataclass(frozen=True)
class Property:
    """path: the set it is in, as the places of the properties and sets above it; empty for the object's own set."""

    path: str
    ord: int
    id: int
    flag: bool | None = None
    scalar: int | None = None
    data: bytes | None = None
    kind: str | None = None
    refs: list[str] | None = None
    sets: int | None = None


class _Reader:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise FormatError("ONENOTE_TRUNCATED_PROPERTY_SET")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, size: int = 4) -> int:
        return int.from_bytes(self.take(size), "little")


def id_streams(data: bytes, most: int = 1_000_000) -> tuple[dict[str, list[int]], int]:
    """The compact ids of each stream, and where the set begins. The streams of spaces and contexts may be missing."""
    reader, found = _Reader(data), {}
    for name in STREAMS:
        header = reader.number()
        if header & RESERVED or header & COUNT > most:
            raise FormatError("ONENOTE_OBJECT_STREAM_HEADER")
        n = header & COUNT
        found[name] = list(struct.unpack(f"<{n}I", reader.take(4 * n)))
        if name == "object" and header & NO_SPACES or name == "space" and not header & MORE:
            break
    return found, reader.at


def property_rows(data: bytes, names: dict[int, str], limits: GraphLimits = GraphLimits()) -> list[Property]:
    """All properties of an object's set and of the sets within it, each before those within it. names: the global id
    table, by which compact ids are told."""
    streams, start = id_streams(data, limits.objects)
    ids: dict[str, Iterator[str]] = {}
    for kind, compact in streams.items():
        if any(c >> 8 not in names for c in compact):
            raise FormatError("ONENOTE_COMPACT_ID")
        ids[kind] = iter([f"{names[c >> 8]}:{c & 255}" for c in compact])
    reader, rows = _Reader(data, start), []

    def taken(kind: str, n: int) -> list[str]:
        found = [x for _, x in zip(range(n), ids.get(kind, iter(())), strict=False)]
        if len(found) < n:
            raise FormatError("ONENOTE_REFERENCE_STREAM")
        return found

    def counted() -> int:
        n = reader.number()
        if n > limits.objects:
            raise FormatError("ONENOTE_REFERENCE_COUNT")
        return n

    def read(path: str, depth: int) -> None:
        if depth >= limits.depth:
            raise FormatError("ONENOTE_PROPERTY_DEPTH")
        n = reader.number(2)
        if len(rows) + n > limits.properties:
            raise FormatError("ONENOTE_PROPERTY_LIMIT")
        for k, raw in enumerate(struct.unpack(f"<{n}I", reader.take(4 * n))):
            form, own = raw >> 26 & 31, {"path": path, "ord": k, "id": raw & 0x7FFFFFFF}
            inner = 0
            if form in NUMBERS:
                own["data"] = reader.take(NUMBERS[form])
                value = int.from_bytes(own["data"], "little")
                own["scalar"] = value if value <= EXACT else None
            elif form in REFERENCES:
                kind, n_ids = REFERENCES[form]
                own |= {"kind": kind, "refs": taken(kind, counted() if n_ids is None else n_ids)}
            elif form == FLAG:
                own["flag"] = raw >> 31 == 1
            elif form == BYTES:
                size = reader.number()
                if size >= 1 << 30:
                    raise FormatError("ONENOTE_PROPERTY_DATA_LENGTH")
                own["data"] = reader.take(size)
            elif form == SETS:
                inner = counted()
                if inner and reader.number() >> 26 & 31 != SET:
                    raise FormatError("ONENOTE_PROPERTY_ARRAY_TYPE")
                own["sets"] = inner
            elif form == SET:
                inner = own["sets"] = 1
            elif form != NOTHING:
                raise FormatError("ONENOTE_PROPERTY_TYPE")
            rows.append(Property(**own))
            for i in range(inner):
                read(f"{path}/{k}.{i}", depth + 1)

    read("", 0)
    return rows
