"""The object graph of a packaged section by loops over its elements: what the joins have to equal."""

from __future__ import annotations

import uuid

from quirespark.sources.cabinet import FormatError
from quirespark.sources.property_sets import GraphLimits, id_streams, property_rows
from quirespark.sources.sync_package import DEFAULT_CONTEXT, FILE, FILE_EXTENSION, FILE_REFERENCE, NIL, PROPERTIES, TYPE, Package, _fault


def assigned(package: Package) -> dict[str, tuple[tuple[str, str], int | None]]:
    """The cell of each revision element that a cell's chain reaches, and the cell's place where the element is its head.
    Later cells overwrite earlier ones."""
    elements = {revision: element for revision, element in package.revision_map}
    by_id = {revision: element for element, (revision, *_) in package.revisions.items()}
    cells, heads, order = {}, {}, 0
    for cell, manifest in package.cell_map:
        element = elements.get(package.cells.get(manifest))
        if element not in package.revisions:
            continue
        heads.setdefault(element, []).append(order)
        order += 1
        seen = set()
        while element is not None and package.revisions[element][0] not in seen:
            seen.add(package.revisions[element][0])
            cells[element] = cell
            element = by_id.get(package.revisions[element][1])
    return {e: (cell, heads.get(e, [])) for e, cell in cells.items()}


def merged(package: Package, groups: list[str]) -> dict[str, dict]:
    """The objects of a revision's groups by id, in the order they are first declared: declarations and data meet by
    their places, and each part of an object (type, properties, file) is the last that was given."""
    found: dict[str, dict] = {}
    for name in groups:
        for (own, blob, part, _, n), (ids, cells, data, data_blob) in zip(*package.groups.get(name, ([], [])), strict=False):
            item = found.setdefault(own, {"type": 0, "properties": None, "ids": [], "cells": [], "blob": None, "count": 0})
            item["count"] = max(item["count"], n)
            if part == TYPE:
                if data is None or len(data) != 4:
                    raise _fault("JCID")
                item["type"] = int.from_bytes(data, "little")
            elif part == PROPERTIES:
                item |= {"properties": data, "ids": ids, "cells": cells}
            elif part == FILE:
                item["blob"] = data_blob or blob
    return found


def global_names(item: dict, cell: tuple[str, str]) -> dict[int, str]:
    """The id table that an object's references need: compact ids and long ids by their places. References into the
    object's own cell name spaces, others contexts."""
    try:
        streams, _ = id_streams(item["properties"])
    except FormatError:
        raise _fault("OBJECT_STREAM") from None
    own = {"object": item["ids"], "space": [b for a, b in item["cells"] if a == cell[0]], "context": [a for a, _ in item["cells"] if a != cell[0]]}
    names: dict[int, str] = {}
    for kind, compact in streams.items():
        if len(compact) != len(own[kind]):
            raise _fault("MAPPING_COUNT")
        for c, long in zip(compact, own[kind], strict=True):
            if c == 0 and long == NIL:
                continue
            name, number = long.rsplit(":", 1)
            if c >> 8 == 0xFFFFFF or f"{name}:0" == NIL or int(number) != c & 255 or names.setdefault(c >> 8, name) != name:
                raise _fault("MAPPING")
    return names


def file_key(reference: str | None) -> str | None:
    """The name of a payload in a reference such as `<ifndf>{GUID}`; null for any other text."""
    if reference is None or not reference.lower().startswith("<ifndf>"):
        return None
    found = reference[7:].strip().rstrip("\0")
    found = found[1:] if found.startswith("{") else found
    return (found[:-1] if found.endswith("}") else found).lower()


def graph_of(package: Package, graph_type, revision_type, object_type, limits: GraphLimits = GraphLimits()):
    cells, graph, seen, stored = assigned(package), graph_type(), set(), set()
    for element, (revision, base, roots, groups) in package.revisions.items():
        if element not in cells:
            continue
        cell, heads = cells[element]
        context = None if cell[0] in (NIL, DEFAULT_CONTEXT) else cell[0]
        found = revision_type(revision, None if base == NIL else base, False, context, cell[1])
        found.roots = [(own, int(role.rsplit(":", 1)[1])) for role, own in roots]
        found.roles = [(context, 1, k) for k in heads]
        graph.revisions.append(found)
        for own, item in merged(package, groups).items():
            if len(graph.objects) >= limits.objects:
                raise FormatError("ONENOTE_OBJECT_LIMIT")
            x = object_type(own, item["type"], item["count"], revision, own in seen)
            seen.add(own)
            if item["properties"] is not None:
                x.properties = property_rows(item["properties"], global_names(item, cell), limits)
                last = {p.id: p.data for p in x.properties if not p.path}
                raw = last.get(FILE_REFERENCE)
                text = lambda b: None if not b else b[: len(b) // 2 * 2].decode("utf-16le", "replace").rstrip("\0")
                x.file = f"<ifndf>{{{uuid.UUID(bytes_le=raw)}}}" if raw is not None and len(raw) == 16 else text(raw)
                x.extension = text(last.get(FILE_EXTENSION))
            graph.objects.append(x)
            key = file_key(x.file)
            if item["blob"] in package.blobs and key and key not in stored:
                stored.add(key)
                graph.payloads.append((key, package.blobs[item["blob"]]))
    return graph
