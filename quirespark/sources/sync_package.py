"""The packaged section encoding: a stream of framed structures, its data elements, and the object graph that they hold."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

from quirespark.sources.cabinet import FormatError

#: Where the stream begins, how deep it may nest, and what its structures are.
START, DEEPEST = 68, 64
ELEMENT, BLOB, DECLARE_BLOB, ROOT_CELL, REVISION_ROOT, CURRENT, SCHEMA_ID = 0x01, 0x02, 0x05, 0x07, 0x0A, 0x0B, 0x0C
REVISION_MAP, CELL_MAP, MANIFEST_MAP, PACKAGE = 0x0D, 0x0E, 0x11, 0x15
DATA, DECLARE, GROUP_OF, MANIFEST, DATA_BLOB, DECLARATIONS, GROUP_DATA = 0x16, 0x18, 0x19, 0x1A, 0x1C, 0x1D, 0x1E
#: Kinds of data elements, and parts of an object.
INDEX, STORAGE, CELL, REVISION, GROUP, FRAGMENT, PAYLOAD = 1, 2, 3, 4, 5, 6, 10
PROPERTIES, FILE, TYPE = 1, 2, 4
#: The context that stands for none, and the properties that name a file and its extension.
NIL, DEFAULT_CONTEXT = "00000000-0000-0000-0000-000000000000:0", "84defab9-aaa3-4a0d-a3a8-520c77ac7073:1"
FILE_REFERENCE, FILE_EXTENSION = 0x1C00343E, 0x1C003424


def _fault(what: str) -> FormatError:
    return FormatError(f"ONENOTE_FSSHTTPB_{what}")


class Stream:
    """Reads values from a range of bytes; going past its end is a fault."""

    def __init__(self, data: bytes, at: int = 0, end: int | None = None):
        self.data, self.at, self.end = data, at, len(data) if end is None else end
        if self.end > len(data):
            raise _fault("RANGE")

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > self.end:
            raise _fault("RANGE")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, size: int) -> int:
        return int.from_bytes(self.take(size), "little")

    def compact(self) -> int:
        """A whole number whose first byte tells by its lowest set bit how many bytes it has."""
        if self.at >= self.end:
            raise _fault("RANGE")
        first = self.data[self.at]
        if first == 0:
            return self.number(1)
        width = (first & -first).bit_length()
        value = self.number(9) >> 8 if width == 8 else self.number(width) >> width
        if value > (1 << 53) - 1:
            raise _fault("HUGE_INTEGER")
        return value

    def guid(self) -> str:
        return str(uuid.UUID(bytes_le=self.take(16)))

    def long_id(self) -> str:
        """A GUID with a number, in one of five forms."""
        first = self.number(1)
        if first == 0:
            return NIL
        for bits, rest in ((3, 0), (6, 1), (7, 2), (8, 4)):
            if first & ((1 << bits) - 1) == 1 << (bits - 1):
                number = first >> bits | self.number(rest) << (8 - bits)
                return f"{self.guid()}:{number}"
        raise _fault("EXTENDED_GUID")

    def cell(self) -> tuple[str, str]:
        return self.long_id(), self.long_id()

    def many(self, one) -> list:
        return [one() for _ in range(self.compact())]

    def serial(self) -> tuple[str, int]:
        mark = self.number(1)
        if mark not in (0, 0x80):
            raise _fault("SERIAL_NUMBER")
        return (self.guid(), self.number(8)) if mark else (NIL[:-2], 0)

    def header(self) -> tuple[bool, int, bool, int]:
        """(begins, type, has children, length of its own data); both ends come in a short and a long form."""
        if self.at >= self.end:
            raise _fault("RANGE")
        form = self.data[self.at] & 3
        if form & 1:
            return False, self.number(2 if form == 3 else 1) >> 2, False, 0
        word = self.number(4 if form == 2 else 2)
        bits = 14 if form == 2 else 6
        length = word >> (3 + bits)
        return True, word >> 3 & ((1 << bits) - 1), bool(word & 4), self.compact() if form == 2 and length == 0x7FFF else length


@dataclass
class Structure:
    type: int
    first: int
    end: int
    children: list[Structure] = field(default_factory=list)

    def whole(self, data: bytes, read):
        """What `read` makes of its own data, all of which it has to use."""
        stream = Stream(data, self.first, self.end)
        found = read(stream)
        if stream.at != self.end:
            raise _fault("STRUCTURE_LENGTH")
        return found


def walked(data: bytes, start: int = START) -> Structure:
    """The outermost structure with all within it. Only zeros may follow it."""
    stream = Stream(data, start)
    top = Structure(-1, start, start)
    open_: list[Structure] = [top]
    while len(open_) > 1 or not top.children:
        begins, kind, nests, length = stream.header()
        if not begins:
            if len(open_) == 1 or open_[-1].type != kind:
                raise _fault("UNBALANCED")
            open_.pop()
            continue
        found = Structure(kind, stream.at, stream.at + length)
        stream.take(length)
        open_[-1].children.append(found)
        if nests:
            open_.append(found)
            if len(open_) - 2 > DEEPEST:
                raise _fault("DEPTH")
            if stream.at >= stream.end:
                raise _fault("UNBALANCED")
    if data[stream.at :].strip(b"\0"):
        raise _fault("TRAILING")
    return top.children[0]


def histogram(root: Structure) -> tuple[Counter, int]:
    """How often each type occurs, and how deep the structures nest."""
    found, deepest, level, here = Counter(), 0, 0, [root]
    while here:
        found.update(x.type for x in here)
        deepest = level
        here, level = [c for x in here for c in x.children], level + 1
    return found, deepest


@dataclass
class Package:
    """The relations of a package. cell_map: (cell, manifest element); revision_map: (revision, element); cells: element ->
    current revision; revisions: element -> (revision, base, roots, groups); groups: element -> (declarations, data)."""

    schema: str | None = None
    indexed: bool = False
    manifest_map: list = field(default_factory=list)
    cell_map: list = field(default_factory=list)
    revision_map: list = field(default_factory=list)
    storage_roots: list = field(default_factory=list)
    cells: dict = field(default_factory=dict)
    revisions: dict = field(default_factory=dict)
    groups: dict = field(default_factory=dict)
    blobs: dict = field(default_factory=dict)


def _only(children: list[Structure], *types: int) -> list[Structure]:
    for c in children:
        if c.type not in types:
            raise _fault("MISSING_STRUCTURE")
    return children


def _first(structure: Structure, kind: int) -> Structure:
    if not structure.children:
        raise _fault("MISSING_STRUCTURE")
    return _only(structure.children[:1], kind)[0]


def read_package(data: bytes) -> Package:
    found = Package()
    for element in _first(walked(data), PACKAGE).children:
        if element.type != ELEMENT:
            raise _fault("NOT_DATA_ELEMENT")
        own, _, kind = element.whole(data, lambda s: (s.long_id(), s.serial(), s.compact()))
        if kind == INDEX:
            found.indexed, found.manifest_map, found.cell_map, found.revision_map = True, [], [], []
            forms = {MANIFEST_MAP: (found.manifest_map, lambda s: (s.long_id(), s.serial())), CELL_MAP: (found.cell_map, lambda s: (s.cell(), s.long_id(), s.serial())), REVISION_MAP: (found.revision_map, lambda s: (s.long_id(), s.long_id(), s.serial()))}
            for c in _only(element.children, *forms):
                into, form = forms[c.type]
                into.append(c.whole(data, form)[:2])
        elif kind == STORAGE:
            found.schema = _first(element, SCHEMA_ID).whole(data, Stream.guid)
            found.storage_roots = [c.whole(data, lambda s: (s.long_id(), s.cell())) for c in _only(element.children[1:], ROOT_CELL)]
        elif kind == CELL:
            found.cells[own] = _first(element, CURRENT).whole(data, Stream.long_id)
        elif kind == REVISION:
            revision, base = _first(element, MANIFEST).whole(data, Stream.cell)
            rest = _only(element.children[1:], REVISION_ROOT, GROUP_OF)
            found.revisions[own] = (revision, base, [c.whole(data, Stream.cell) for c in rest if c.type == REVISION_ROOT], [c.whole(data, Stream.long_id) for c in rest if c.type == GROUP_OF])
        elif kind == GROUP:
            declared, values = [], []
            for part in _only(element.children, DECLARATIONS, GROUP_DATA):
                if part.type == DECLARATIONS:
                    for c in _only(part.children, DECLARE, DECLARE_BLOB):
                        declared.append(c.whole(data, (lambda s: (s.long_id(), None, s.compact(), s.compact(), s.compact() + s.compact())) if c.type == DECLARE else (lambda s: (s.long_id(), s.long_id(), s.compact(), None, s.compact() + s.compact()))))
                else:
                    for c in _only(part.children, DATA, DATA_BLOB):
                        values.append(c.whole(data, lambda s, plain=c.type == DATA: (s.many(s.long_id), s.many(s.cell), s.take(s.compact()) if plain else None, None if plain else s.long_id())))
            found.groups[own] = (declared, values)
        elif kind == PAYLOAD:
            blob = _first(element, BLOB)
            found.blobs[own] = data[blob.first : blob.end]
        elif kind != FRAGMENT:
            raise _fault("DATA_ELEMENT_TYPE")
    if not found.indexed:
        raise _fault("NO_STORAGE_INDEX")
    if found.schema is None:
        raise _fault("NO_STORAGE_MANIFEST")
    return found


def package_rows(data: bytes) -> Iterator[dict]:
    """The relations of a package as rows of object_graph's wide table; operators.packages joins them."""
    package = read_package(data)
    for k, ((a, b), manifest) in enumerate(package.cell_map):
        yield {"part": "cell_map", "ord": k, "id": manifest, "context": a, "space": b}
    for k, (revision, element) in enumerate(package.revision_map):
        yield {"part": "rev_map", "ord": k, "id": revision, "other": element}
    for own, current in package.cells.items():
        yield {"part": "cell_manifest", "ord": 0, "id": own, "other": current}
    for k, (own, (revision, base, roots, groups)) in enumerate(package.revisions.items()):
        yield {"part": "rev_manifest", "ord": k, "id": own, "other": revision, "extension": base}
        for i, (role, root) in enumerate(roots):
            yield {"part": "rev_root", "ord": i, "id": own, "other": root, "number": int(role.rsplit(":", 1)[1])}
        for i, group in enumerate(groups):
            yield {"part": "rev_group", "ord": i, "id": own, "other": group}
    for own, (declared, values) in package.groups.items():
        for i, (name, blob, part, _, n) in enumerate(declared):
            yield {"part": "decl", "ord": i, "id": own, "other": name, "extension": blob, "number": part, "count": n}
        for i, (ids, cells, held, blob) in enumerate(values):
            yield {"part": "data", "ord": i, "id": own, "data": held, "extension": blob, "ids": ids, "cells": [{"a": a, "b": b} for a, b in cells]}
    for own, held in package.blobs.items():
        yield {"part": "blob", "ord": 0, "id": own, "data": held}
