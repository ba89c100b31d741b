"""Writes small sections of both encodings. Spaces: name -> {"objects": {id: (type, {property: value})}, "roots": {role: id}}.

Ids are small numbers; an object's long id is the GUID of its space with that number. Values: bool, int, bytes, a list of ids
(of objects), ("spaces", names), or ("sets", list of dicts).
"""

import struct
import uuid
import zlib

from quirespark.sources import object_graph, revision_store, sync_package

STORES = {name: uuid.UUID(x).bytes_le for x, name in revision_store.FORMATS.items()}
KINDS = {name: uuid.UUID(x).bytes_le for x, name in revision_store.KINDS.items()}


def guid(name):
    return uuid.uuid5(uuid.NAMESPACE_URL, str(name))


def long_id(name, n):
    return guid(name).bytes_le + struct.pack("<I", n)


def wide(text):
    return text.encode("utf-16le")


def encoded(props, index, own, spaces, oids=None, osids=None):
    """A property set's bytes, with its references appended to the streams. index: GUID name -> place in the id table."""
    ids, body = b"", b""
    for prop, value in props.items():
        form = prop >> 26 & 31
        raw = prop & 0x7FFFFFFF
        if form == 2:
            raw |= int(value) << 31
        elif form in (3, 4, 5, 6):
            body += value.to_bytes({3: 1, 4: 2, 5: 4, 6: 8}[form], "little") if isinstance(value, int) else value
        elif form == 7:
            body += struct.pack("<I", len(value)) + value
        elif form in (8, 9):
            body += struct.pack("<I", len(value)) if form == 9 else b""
            oids += [(own, n) for n in value]
        elif form in (10, 11):
            body += struct.pack("<I", len(value[1])) if form == 11 else b""
            osids += [(name, 1) for name in value[1]]
        elif form == 16:
            body += struct.pack("<I", len(value[1])) + (struct.pack("<I", 0x11 << 26) if value[1] else b"")
            body += b"".join(encoded(x, index, own, spaces, oids, osids) for x in value[1])
        ids += struct.pack("<I", raw)
    return struct.pack("<H", len(props)) + ids + body


def object_data(props, index, own, spaces):
    oids, osids = [], []
    body = encoded(props, index, own, spaces, oids, osids)
    compact = lambda refs: b"".join(struct.pack("<I", index[name] << 8 | n) for name, n in refs)
    return struct.pack("<I", len(oids)) + compact(oids) + struct.pack("<I", len(osids)) + compact(osids) + body, oids, osids


def node(node_id, body=b"", base=0):
    return struct.pack("<I", node_id | (4 + len(body)) << 10 | base << 27 | 1 << 31) + body


class Desktop:
    def __init__(self):
        self.data, self.counts = bytearray(1024), []

    def put(self, part):
        at = len(self.data)
        self.data += part + bytes(-len(part) % 8)
        return struct.pack("<QI", at, len(part))

    def list(self, nodes):
        list_id = 16 + len(self.counts)
        self.counts.append((list_id, len(nodes)))
        return self.put(revision_store.HEAD_MARK + struct.pack("<II", list_id, 0) + b"".join(nodes) + struct.pack("<QI", *revision_store.NIL) + revision_store.FOOT_MARK)


def desktop(spaces, payloads=(), revisions=None, extra=()):
    """revisions: names of older revisions for each space, each with objects of its own, before the spaces' objects."""
    out, manifests = Desktop(), []
    names = list(spaces)
    index = {name: k for k, name in enumerate(names)}
    for name, space in spaces.items():
        nodes = [node(0x14, long_id(name, 1) + bytes(4))]
        chain = [*(revisions or {}).get(name, []), space]
        for k, rev in enumerate(chain):
            nodes.append(node(0x1E, long_id(f"{name}/{k}", 1) + (long_id(f"{name}/{k - 1}", 1) if k else bytes(20)) + struct.pack("<IH", 1, int(rev.get("encrypted", False)))))
            nodes += [node(0x22, b"\0"), *(node(0x24, struct.pack("<I", i) + guid(x).bytes_le) for i, x in enumerate(names)), node(0x28)]
            for n, (kind, props) in rev["objects"].items():
                if isinstance(props, tuple):  # a file's declaration: reference, extension
                    texts = b"".join(struct.pack("<I", len(t)) + wide(t) for t in props)
                    nodes.append(node(0x72, struct.pack("<IIB", index[name] << 8 | n, kind, 1) + texts))
                else:
                    at = out.put(object_data(props, index, name, spaces)[0])
                    nodes.append(node(0xA4, at + struct.pack("<II", index[name] << 8 | n, kind) + b"\0\1", 1))
            nodes += [node(0x59, struct.pack("<II", index[name] << 8 | n, role)) for role, n in rev["roots"].items()]
            nodes += [*extra, node(0x1C)]
        manifests.append(out.list([node(0x0C, long_id(name, 1)), node(0x10, out.list(nodes), 2)]))
    files = []
    for key, data in payloads:
        frame = uuid.UUID(object_graph.FILE_HEAD).bytes_le + struct.pack("<Q", len(data)) + bytes(12) + data + bytes(-len(data) % 8) + uuid.UUID(object_graph.FILE_FOOT).bytes_le
        files.append(node(0x94, out.put(frame) + guid(key).bytes_le, 1))
    tail = [node(0x90, out.list(files), 2)] if files else []
    root = out.list([*(node(0x08, m, 2) for m in manifests), node(0x04, long_id(names[0], 1)), *tail])
    entries = b"".join(struct.pack("<II", *c) for c in out.counts)
    log = out.put(entries + struct.pack("<II", 1, zlib.crc32(entries)) + struct.pack("<QI", *revision_store.NIL))
    out.data[:16], out.data[48:64] = KINDS["section"], STORES["revision-store"]
    struct.pack_into("<4I", out.data, 64, *[revision_store.VERSIONS["section"]] * 4)
    struct.pack_into("<I", out.data, 96, 1)
    out.data[160:172], out.data[172:184] = log, root
    struct.pack_into("<Q", out.data, 196, len(out.data))
    return bytes(out.data)


def compact(n):
    """The shortest form of a whole number."""
    for width in range(1, 8):
        if n < 1 << 7 * width:
            return b"\0" if n == 0 else (n << width | 1 << (width - 1)).to_bytes(width, "little")
    return b"\x80" + n.to_bytes(8, "little")


def sync_id(name, n):
    g = guid(name).bytes_le
    return bytes([n << 3 | 4]) + g if n < 32 else b"\x80" + struct.pack("<I", n) + g


def framed(kind, data=b"", children=None):
    head = struct.pack("<I", 2 | (4 if children is not None else 0) | kind << 3 | min(len(data), 0x7FFF) << 17)
    end = struct.pack("<H", 3 | kind << 2) if children is not None else b""
    return head + (compact(len(data)) if len(data) >= 0x7FFF else b"") + data + b"".join(children or []) + end


def packaged(spaces, payloads=(), files=None, extra=b""):
    """files: (space, object) -> key of a payload. Each space is a cell with one revision and one group."""
    p = sync_package
    nil_context = b"\0"
    files = files or {}
    element = lambda name, kind, children: framed(p.ELEMENT, sync_id(name, 1) + b"\0" + compact(kind), children)
    cells, elements = [], []
    names = list(spaces)
    index = {name: k for k, name in enumerate(names)}
    for name, space in spaces.items():
        cells += [framed(p.CELL_MAP, nil_context + sync_id(name, 1) + sync_id(f"cell {name}", 1) + b"\0"), framed(p.REVISION_MAP, sync_id(f"rev {name}", 2) + sync_id(f"rev element {name}", 1) + b"\0")]
        elements.append(element(f"cell {name}", p.CELL, [framed(p.CURRENT, sync_id(f"rev {name}", 2))]))
        roots = [framed(p.REVISION_ROOT, sync_id("role", role) + sync_id(name, n)) for role, n in space["roots"].items()]
        elements.append(element(f"rev element {name}", p.REVISION, [framed(p.MANIFEST, sync_id(f"rev {name}", 2) + b"\0"), *roots, framed(p.GROUP_OF, sync_id(f"group {name}", 1))]))
        declared, data = [], []
        for n, (kind, props) in space["objects"].items():
            raw, oids, osids = object_data(props, index, name, spaces)
            refs = compact(len(oids)) + b"".join(sync_id(*r) for r in oids) + compact(len(osids)) + b"".join(nil_context + sync_id(*r) for r in osids)
            for part, value, r in ((p.TYPE, struct.pack("<I", kind), b"\0\0"), (p.PROPERTIES, raw, refs)):
                declared.append(framed(p.DECLARE, sync_id(name, n) + compact(part) + compact(len(value)) + compact(len(oids)) + compact(len(osids))))
                data.append(framed(p.DATA, r + compact(len(value)) + value))
            if (name, n) in files:
                declared.append(framed(p.DECLARE_BLOB, sync_id(name, n) + sync_id(files[name, n], 1) + compact(p.FILE) + b"\0\0"))
                data.append(framed(p.DATA_BLOB, b"\0\0" + sync_id(files[name, n], 1)))
        elements.append(element(f"group {name}", p.GROUP, [framed(p.DECLARATIONS, children=declared), framed(p.GROUP_DATA, children=data)]))
    elements += [element(key, p.PAYLOAD, [framed(p.BLOB, value)]) for key, value in payloads]
    head = [element("index", p.INDEX, cells), element("storage", p.STORAGE, [framed(p.SCHEMA_ID, guid("schema").bytes_le)])]
    out = bytearray(sync_package.START)
    out[:16], out[48:64] = KINDS["section"], STORES["file-synchronization-package"]
    return bytes(out) + framed(revision_store.PACKAGING, sync_id("index", 1) + uuid.UUID(next(iter(revision_store.CELL_SCHEMAS))).bytes_le, [framed(p.PACKAGE, b"\0", [*head, *elements])]) + extra + bytes(5)
