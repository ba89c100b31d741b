"""Revisions, objects and payloads of sections of either encoding, as relations.

A section is decoded in the task that holds it to rows of one wide table, which is written once; the relations are
projections of it, and for packaged sections joins over its elements (operators.packages). From there on everything is joins and aggregates (operators.spaces).
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field, fields

import pyarrow as pa
from pyspark.sql import DataFrame

from quirespark.operators.packages import package_relations
from quirespark.scratch import written
from quirespark.sources import revision_store as store
from quirespark.sources import sync_package
from quirespark.sources.cabinet import FormatError
from quirespark.sources.property_sets import GraphLimits, Property, property_rows

#: Node ids of the graph.
SPACE_START, ROLE, ROLE_IN_CONTEXT, TABLE_ENTRY, GROUP_LIST, PAYLOAD = 0x014, 0x05C, 0x05D, 0x024, 0x0B0, 0x094
REVISIONS = {0x01B: 48, 0x01E: 40, 0x01F: 40}  # where the role is
CONTEXT_REVISION, CONTEXT_AT = 0x01F, 46
TABLE_STARTS, ROOTS = {0x021, 0x022}, {0x059: 4, 0x05A: 20}
#: Object declarations by where the count is behind the id, its size, and where the type is.
DECLARED = {0x02D: (10, 1, None), 0x02E: (10, 4, None), 0x041: (4, 1, 0), 0x042: (8, 4, 0), 0x0A4: (9, 1, 4), 0x0A5: (9, 4, 4), 0x0C4: (9, 1, 4), 0x0C5: (9, 4, 4)}
REVISED, PLAIN_TYPE = {0x041, 0x042}, 0x00020001
FILES = {0x072: 1, 0x073: 4}
FILE_HEAD, FILE_FOOT = "bde316e7-2665-4511-a4c4-8d4d0b7a9eac", "71fba722-0f79-4a0b-bb13-899256426b24"
EMPTY = "00000000-0000-0000-0000-000000000000:0"


@dataclass
class Revision:
    id: str
    dependency: str | None = None
    encrypted: bool = False
    context: str | None = None
    space: str | None = None
    roots: list[tuple[str, int]] = field(default_factory=list)
    roles: list[tuple[str | None, int, int]] = field(default_factory=list)


@dataclass
class Object:
    id: str
    type: int
    count: int
    revision: str | None
    revised: bool
    properties: list[Property] | None = None
    file: str | None = None
    extension: str | None = None


@dataclass
class Graph:
    revisions: list[Revision] = field(default_factory=list)
    objects: list[Object] = field(default_factory=list)
    payloads: list[tuple[str, bytes]] = field(default_factory=list)


@dataclass
class _Scope:
    """What a list's nodes are read under: the global id table, the revision and the space."""

    names: dict[int, str] = field(default_factory=dict)
    revision: Revision | None = None
    space: str | None = None


def _unpacked(form: str, data: bytes, at: int) -> int:
    if at < 0 or at + struct.calcsize(form) > len(data):
        raise FormatError("ONENOTE_TRUNCATED_STRUCTURE")
    return struct.unpack_from(form, data, at)[0]


def _guid(data: bytes, at: int) -> str:
    return str(uuid.UUID(bytes_le=_unpacked("16s", data, at)))


def _long_id(data: bytes, at: int) -> str:
    return f"{_guid(data, at)}:{_unpacked('<I', data, at + 16)}"


def _counted_text(data: bytes, at: int) -> tuple[str, int]:
    n = 2 * _unpacked("<I", data, at)
    if at + 4 + n > len(data):
        raise FormatError("ONENOTE_STORAGE_STRING")
    return data[at + 4 : at + 4 + n].decode("utf-16le", "replace"), at + 4 + n


def ordered_nodes(lists: list[tuple[int, int, list[store.Node]]]) -> Iterator[tuple[_Scope, store.Node]]:
    """Every list's nodes once, those of a list that a node refers to right behind it. The lists of object groups begin
    with the revision and space of the node that names them; others with none; every list has an id table of its own."""
    by_place = {at: nodes for at, _, nodes in lists}
    root = lists[0][0]
    seen, stack = {root}, [(_Scope(), iter(by_place[root]))]
    while stack:
        scope, nodes = stack[-1]
        node = next(nodes, None)
        if node is None:
            stack.pop()
            continue
        yield scope, node
        at = node.target[0] if node.target and node.base == store.BASES[2] else None
        if at in by_place and at not in seen:
            seen.add(at)
            own = scope.revision if node.id == GROUP_LIST else None
            stack.append((_Scope({}, own, own.space if own else None), iter(by_place[at])))


class _Desktop:
    """Gathers a graph from nodes; `handlers` maps each node id to what it does."""

    def __init__(self, data: bytes, length: int, limits: GraphLimits):
        self.data, self.length, self.limits = data, length, limits
        self.graph, self.known, self.types, self.roles, self.bytes = Graph(), {}, {}, 0, 0
        self.handlers = {SPACE_START: self.space, ROLE: self.role, ROLE_IN_CONTEXT: self.role, TABLE_ENTRY: self.entry, PAYLOAD: self.payload}
        self.handlers |= dict.fromkeys(REVISIONS, self.revision) | dict.fromkeys(TABLE_STARTS, lambda s, n: s.names.clear())
        self.handlers |= dict.fromkeys(ROOTS, self.root) | dict.fromkeys(DECLARED, self.declared) | dict.fromkeys(FILES, self.file)

    def read(self, lists) -> Graph:
        for scope, node in ordered_nodes(lists):
            handle = self.handlers.get(node.id)
            if handle:
                handle(scope, node)
        return self.graph

    def named(self, scope: _Scope, data: bytes, at: int) -> str:
        compact = _unpacked("<I", data, at)
        if compact >> 8 not in scope.names:
            raise FormatError("ONENOTE_COMPACT_ID")
        return f"{scope.names[compact >> 8]}:{compact & 255}"

    def piece(self, target: tuple[int, int], at: int, n: int) -> bytes:
        if target[0] + target[1] > self.length or at + n > target[1]:
            raise FormatError("ONENOTE_CHUNK_REFERENCE_BOUNDS")
        if target[0] + at + n > len(self.data):
            raise FormatError("ONENOTE_TRUNCATED_STRUCTURE")
        return self.data[target[0] + at : target[0] + at + n]

    def ordered_role(self) -> int:
        self.roles += 1
        return self.roles - 1

    def space(self, scope: _Scope, node: store.Node) -> None:
        scope.space = _long_id(node.data, 0)

    def revision(self, scope: _Scope, node: store.Node) -> None:
        at = REVISIONS[node.id]
        own, base = _long_id(node.data, 0), _long_id(node.data, 20)
        if own in self.known:
            raise FormatError("ONENOTE_REVISION_ID")
        context = _long_id(node.data, CONTEXT_AT) if node.id == CONTEXT_REVISION else None
        found = Revision(own, None if base == EMPTY else base, _unpacked("<H", node.data, at + 4) != 0, context, scope.space)
        found.roles.append((context, _unpacked("<I", node.data, at), self.ordered_role()))
        self.known[own] = scope.revision = found
        self.graph.revisions.append(found)

    def role(self, scope: _Scope, node: store.Node) -> None:
        role, of = _unpacked("<I", node.data, 20), self.known.get(_long_id(node.data, 0))
        if role > 0xFFFF:
            raise FormatError("ONENOTE_REVISION_ROLE")
        if of is None or scope.space is None or of.space != scope.space:
            raise FormatError("ONENOTE_REVISION_ROLE_TARGET")
        context = _long_id(node.data, 24) if node.id == ROLE_IN_CONTEXT else EMPTY
        of.roles.append((None if context == EMPTY else context, role, self.ordered_role()))

    def entry(self, scope: _Scope, node: store.Node) -> None:
        index, name = _unpacked("<I", node.data, 0), _guid(node.data, 4)
        if index >= 0xFFFFFF or index in scope.names:
            raise FormatError("ONENOTE_GLOBAL_ID_INDEX")
        if f"{name}:0" == EMPTY:
            raise FormatError("ONENOTE_GLOBAL_ID_GUID")
        scope.names[index] = name

    def root(self, scope: _Scope, node: store.Node) -> None:
        if scope.revision is not None:
            at = ROOTS[node.id]
            own = self.named(scope, node.data, 0) if at == 4 else _long_id(node.data, 0)
            scope.revision.roots.append((own, _unpacked("<I", node.data, at)))

    def placed(self, found: Object) -> None:
        if len(self.graph.objects) >= self.limits.objects:
            raise FormatError("ONENOTE_OBJECT_LIMIT")
        self.graph.objects.append(found)
        if found.type:
            self.types[found.id] = found.type

    def declared(self, scope: _Scope, node: store.Node) -> None:
        if node.target in (None, (0, 0)):
            raise FormatError("ONENOTE_OBJECT_REFERENCE")
        own = self.named(scope, node.data, node.skip)
        count_at, size, type_at = DECLARED[node.id]
        revised = node.id in REVISED
        kind = self.types.get(own, 0) if revised else PLAIN_TYPE if type_at is None else _unpacked("<I", node.data, node.skip + type_at)
        count = _unpacked("<I" if size == 4 else "<B", node.data, node.skip + count_at)
        found = Object(own, kind, count >> 2 if revised and size == 1 else count, scope.revision.id if scope.revision else None, revised)
        if not (scope.revision and scope.revision.encrypted):
            found.properties = property_rows(self.piece(node.target, 0, node.target[1]), scope.names, self.limits)
        self.placed(found)

    def file(self, scope: _Scope, node: store.Node) -> None:
        size = FILES[node.id]
        own, kind = self.named(scope, node.data, 0), _unpacked("<I", node.data, 4)
        count = _unpacked("<I" if size == 4 else "<B", node.data, 8)
        reference, at = _counted_text(node.data, 8 + size)
        extension, _ = _counted_text(node.data, at)
        self.placed(Object(own, kind, count, scope.revision.id if scope.revision else None, False, None, reference, extension))

    def payload(self, scope: _Scope, node: store.Node) -> None:
        if node.target in (None, (0, 0)):
            return
        name, room = _guid(node.data, node.skip), node.target[1] - 52
        if room < 0:
            raise FormatError("ONENOTE_FILE_DATA_LENGTH")
        head, foot = self.piece(node.target, 0, 36), self.piece(node.target, node.target[1] - 16, 16)
        (n,) = struct.unpack_from("<Q", head, 16)
        if n > room:
            raise FormatError("ONENOTE_FILE_DATA_LENGTH")
        if n > self.limits.asset_bytes or self.bytes + n > self.limits.total_asset_bytes:
            raise FormatError("ONENOTE_ASSET_LIMIT")
        if (_guid(head, 0), _guid(foot, 0)) != (FILE_HEAD, FILE_FOOT):
            raise FormatError("ONENOTE_FILE_DATA_FRAMING")
        self.bytes += n
        self.graph.payloads.append((name, self.piece(node.target, 36, n)))


def section_rows(data: bytes, store_limits: store.StoreLimits = store.StoreLimits(), limits: GraphLimits = GraphLimits()) -> Iterator[dict]:
    """What a section holds, by the encoding that its header names: its graph, or the relations of its package."""
    header = store.read_header(data)
    if header.storage == "file-synchronization-package":
        return sync_package.package_rows(data)
    return graph_rows(_Desktop(data, header.length, limits).read(list(store.read_lists(data, store_limits))))


#: The wide table: `part` says which relation a row is of.
ROWS = pa.schema(
    [
        ("section", pa.string()),
        ("part", pa.string()),
        ("ord", pa.int64()),
        ("id", pa.string()),
        ("other", pa.string()),
        ("context", pa.string()),
        ("space", pa.string()),
        ("number", pa.int64()),
        ("flag", pa.bool_()),
        ("count", pa.int64()),
        ("data", pa.binary()),
        ("extension", pa.string()),
        ("ids", pa.list_(pa.string())),
        ("cells", pa.list_(pa.struct([("a", pa.string()), ("b", pa.string())]))),
        ("properties", pa.list_(pa.struct([("path", pa.string()), ("ord", pa.int32()), ("id", pa.int64()), ("flag", pa.bool_()), ("scalar", pa.int64()), ("data", pa.binary()), ("kind", pa.string()), ("refs", pa.list_(pa.string()))]))),
    ]
)
SCHEMA = "section string, part string, ord long, id string, other string, context string, space string, number long, flag boolean, count long, data binary, extension string, ids array<string>, cells array<struct<a:string,b:string>>, properties array<struct<path:string,ord:int,id:long,flag:boolean,scalar:long,data:binary,kind:string,refs:array<string>>>"


def graph_rows(graph: Graph) -> Iterator[dict]:
    for k, r in enumerate(graph.revisions):
        yield {"part": "revision", "ord": k, "id": r.id, "other": r.dependency, "context": r.context, "space": r.space, "flag": r.encrypted}
        for context, role, at in r.roles:
            yield {"part": "role", "ord": at, "id": r.id, "context": context, "space": r.space, "number": role, "flag": r.encrypted, "count": k}
        for i, (own, role) in enumerate(r.roots):
            yield {"part": "root", "ord": i, "id": r.id, "other": own, "number": role}
    for k, x in enumerate(graph.objects):
        rows = None if x.properties is None else [{"path": p.path, "ord": p.ord, "id": p.id, "flag": p.flag, "scalar": p.scalar, "data": p.data, "kind": p.kind, "refs": p.refs} for p in x.properties]
        yield {"part": "object", "ord": k, "id": x.id, "other": x.revision, "space": x.file, "number": x.type, "flag": x.revised, "count": x.count, "extension": x.extension, "properties": rows}
    for k, (name, data) in enumerate(graph.payloads):
        yield {"part": "payload", "ord": k, "id": name, "count": len(data), "data": data}


@dataclass(frozen=True)
class Relations:
    """revisions (section, rev_ord, rev_id, dep_id, context_id, space_id, is_encrypted), roles (section, assoc_ord, rev_id,
    rev_ord, context_id, space_id, role, is_encrypted), roots (section, rev_id, root_ord, role, object_id), objects (section,
    obj_ord, object_id, rev_id, jcid, is_revision, ref_count, file_ref, file_ext, properties), payloads (section, ord, key,
    length, payload), faults (section, code)."""

    revisions: DataFrame
    roles: DataFrame
    roots: DataFrame
    objects: DataFrame
    payloads: DataFrame
    faults: DataFrame


def relations(sections: DataFrame, key: str = "section", content: str = "content", store_limits: store.StoreLimits = store.StoreLimits(), limits: GraphLimits = GraphLimits()) -> Relations:
    """Decodes each section once. A section with a fault has one row in faults and none elsewhere; null contents count as
    empty, which is a fault; an empty table gives empty relations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows = [{"section": name} | r for r in section_rows(data or b"", store_limits, limits)]
                except FormatError as e:
                    rows = [{"section": name, "part": "fault", "ord": 0, "id": e.code}]
                for at in range(0, len(rows), 2000):
                    yield pa.RecordBatch.from_pylist(rows[at : at + 2000], schema=ROWS)

    rows = written(sections.select(key, content).mapInArrow(run, SCHEMA), "object-graph")
    part = lambda name, *columns: rows.filter(rows["part"] == name).selectExpr("section", *columns)
    graph = Relations(
        part("revision", "ord AS rev_ord", "id AS rev_id", "other AS dep_id", "context AS context_id", "space AS space_id", "flag AS is_encrypted"),
        part("role", "ord AS assoc_ord", "id AS rev_id", "count AS rev_ord", "context AS context_id", "space AS space_id", "number AS role", "flag AS is_encrypted"),
        part("root", "id AS rev_id", "ord AS root_ord", "number AS role", "other AS object_id"),
        part("object", "ord AS obj_ord", "id AS object_id", "other AS rev_id", "number AS jcid", "flag AS is_revision", "count AS ref_count", "space AS file_ref", "extension AS file_ext", "properties"),
        part("payload", "ord", "id AS key", "count AS length", "data AS payload"),
        part("fault", "id AS code"),
    )
    packaged = rows.filter("part in ('cell_map', 'rev_map', 'cell_manifest', 'rev_manifest', 'rev_root', 'rev_group', 'decl', 'data', 'blob')")
    if packaged.isEmpty():
        return graph
    more = package_relations(packaged, limits)
    return Relations(**{f.name: getattr(graph, f.name).unionByName(more[f.name].select(*getattr(graph, f.name).columns)) for f in fields(Relations)})
