"""A page read by one recursive loop over its objects: what the walk over relations has to equal."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from quirespark.functions import names, values
from quirespark.functions.text import CHECKABLE
from quirespark.operators import spaces as S
from quirespark.operators.mapping import ADDRESS, CHILD_LEVEL, DONE, FILE_AT, FILE_EXTENSION, FILE_NAME, HIGHLIGHT, IMAGE_FILE, IMAGE_NAME, INK_CLEAR, INK_COLOR, INK_DATA, INK_DIMENSIONS, INK_PATH, INK_WIDTH, LINKED, LIST_FORMAT, LIST_NODES, MARKS, MATH, NARROW, OFF, PARAGRAPH_STYLE, PIXELS, RECOGNISED, RUN_ENDS, RUN_STYLES, SCALE_X, SCALE_Y, STROKE_STYLE, STROKES, STYLE_NAME, TAG_LABEL, TAG_OF, TAG_SHAPE, TAG_STATES, TAG_STATUS, TAGS, WIDE, WORD_DEPTH, WORD_PARTS, WORD_STROKES, WORD_TEXT
from quirespark.sources.property_sets import GraphLimits

_WHITE = names._SPACE
_FIELD = re.compile(rf'﷟[{_WHITE}]*HYPERLINK[{_WHITE}]+"([^"]*)"[{_WHITE}]*')


@dataclass
class Node:
    """kind: paragraph, outline, table, image, file, ink."""

    kind: str
    children: list[Node] = field(default_factory=list)
    own: dict = field(default_factory=dict)


class Page:
    """The objects of one page space by id. Properties are found by id; of several the last counts."""

    def __init__(self, objects: list[dict], limits: GraphLimits = GraphLimits()):
        self.objects, self.limits = {}, limits
        for o in objects:
            own: dict[str, dict[int, dict]] = {}
            for p in o["properties"] or []:
                own.setdefault(p["path"], {})[p["id"]] = p
            self.objects[o["object_id"]] = (o["jcid"], own, o)
        self.build: dict[int, Callable] = {S.OUTLINE: self.outline, S.OUTLINE_GROUP: self.outline, S.OUTLINE_ELEMENT: self.outline_element, S.TEXT: self.paragraph, S.IMAGE: self.image, S.EMBEDDED: self.embedded, S.TABLE: self.table, S.INK: self.ink}
        self.words: dict[str, str] = {}

    def kind(self, own: str | None) -> int | None:
        return self.objects[own][0] if own in self.objects else None

    def get(self, own: str | None, prop: int, what: str, path: str = ""):
        found = self.objects[own][1].get(path, {}).get(prop & 0x7FFFFFFF) if own in self.objects else None
        return None if found is None else found[what]

    def refs(self, own: str | None, prop: int, path: str = "") -> list[str]:
        return self.get(own, prop, "refs", path) or []

    def text(self, own: str | None, prop: int) -> str | None:
        return values.wide_text(self.get(own, prop, "data"))

    def first_known(self, own: str, prop: int) -> str | None:
        return next((r for r in self.refs(own, prop) if r in self.objects), None)

    def element(self, own: str, depth: int = 0, path: frozenset = frozenset()) -> Node | None:
        """An object's element; none for types that are not written, past the depth limit, and for an object within itself."""
        make = self.build.get(self.kind(own))
        if make is None or depth >= self.limits.depth or own in path:
            return None
        return make(own, depth, path | {own})

    def elements(self, owner: str, prop: int, depth: int, path: frozenset) -> list[Node]:
        return [x for r in self.refs(owner, prop) if (x := self.element(r, depth + 1, path))]

    def outline(self, own, depth, path) -> Node:
        return Node("outline", self.elements(own, S.CHILDREN, depth, path))

    def outline_element(self, own, depth, path) -> Node:
        """Its first content with its list, tags and children; a paragraph takes them up, others are put before them."""
        main = next((x for r in self.refs(own, S.CONTENT) if (x := self.element(r, depth + 1, path))), None)
        children, marks = self.elements(own, S.CHILDREN, depth, path), self.list_marks(own)
        if main is None:
            return Node("paragraph", children, {"runs": [], **marks})
        if main.kind != "paragraph":
            return Node("outline", [main, *children])
        main.own |= marks
        main.own["tags"] = main.own.get("tags") or self.tags(own)
        main.children += children
        return main

    def list_marks(self, own: str) -> dict:
        of = [r for r in self.refs(own, LIST_NODES) if self.kind(r) == S.NUMBER_LIST]
        if not of:
            return {"level": None, "ordered": None, "format": None}
        data, level = self.get(of[-1], LIST_FORMAT, "data"), self.get(own, CHILD_LEVEL, "scalar")
        return {"level": max(0, (1 if level is None else level) - 1), "ordered": values.is_ordered(data), "format": values.list_format(data) or None}

    def tags(self, own: str) -> list[dict] | None:
        """The tags of a paragraph: of the first nine states those that are on. The shape is the state's or its kind's."""
        states = self.get(own, TAG_STATES, "ord")
        if states is None:
            return None
        found = []
        for k in range(TAGS):
            path = f"/{states}.{k}"
            if path not in self.objects[own][1] and k >= self.set_count(own, states):
                break
            status, shape = self.get(own, TAG_STATUS, "scalar", path) or 0, self.get(own, TAG_SHAPE, "scalar", path)
            if status & OFF:
                continue
            kind = next(iter(self.refs(own, TAG_OF, path)), None)
            if shape is None and self.kind(kind) == S.TAG_KIND:
                shape = self.get(kind, TAG_SHAPE, "scalar")
            box = shape in CHECKABLE
            found.append({"label": None if box else self.text(kind, TAG_LABEL), "checkable": box, "completed": bool(status & DONE), "shape": shape})
        return found or None

    def set_count(self, own: str, states: int) -> int:
        return 1 + max((int(p[len(f"/{states}.") :].split("/")[0]) for p in self.objects[own][1] if p.startswith(f"/{states}.")), default=-1)

    def paragraph(self, own, depth, path) -> Node:
        text = self.text(own, WIDE)
        text = values.byte_text(self.get(own, NARROW, "data")) or "" if text is None else text
        raw, start, runs = text.encode("utf-16le", "surrogatepass"), 0, []
        ends, styles = values.number_array(self.get(own, RUN_ENDS, "data")), self.refs(own, RUN_STYLES)
        for k, end in enumerate([*ends, len(raw) // 2]):  # places count UTF-16 units
            end = max(start, min(len(raw) // 2, end))
            runs.append({"text": raw[2 * start : 2 * end].decode("utf-16le", "replace")} | (self.style(styles[k]) if k < len(styles) else {}))
            start = end
        style = self.first_known(own, PARAGRAPH_STYLE)
        return Node("paragraph", [], {"runs": linked(runs), "tags": self.tags(own), "style": self.text(style, STYLE_NAME)})

    def style(self, own: str) -> dict:
        found = {m: bool(self.get(own, p, "flag")) for m, p in {"math": MATH, **MARKS}.items()}
        color = self.get(own, HIGHLIGHT, "scalar")
        if color is not None and color < 0xFFFFFF:
            found["highlight"] = values.ink_color(color)
        if self.get(own, LINKED, "flag"):
            found["url"] = self.text(own, ADDRESS) or None
        return found

    def table(self, own, depth, path) -> Node:
        of = lambda x, kind: [r for r in self.refs(x, S.CHILDREN) if self.kind(r) == kind]
        return Node("table", [], {"rows": [[self.elements(c, S.CHILDREN, depth, path) for c in of(r, S.CELL)] for r in of(own, S.ROW)]})

    def _file(self, own: str, prop: int, kind: str, name: int) -> Node:
        held = self.first_known(own, prop)
        extension = self.text(held, FILE_EXTENSION)
        about = self.objects[held][2] if held else {"file_ext": None, "file_ref": None}
        return Node(kind, [], {"name": self.text(own, name), "extension": about["file_ext"] if extension is None else extension, "reference": about["file_ref"]})

    def image(self, own, depth, path) -> Node:
        return self._file(own, IMAGE_FILE, "image", IMAGE_NAME)

    def embedded(self, own, depth, path) -> Node:
        return self._file(own, FILE_AT, "file", FILE_NAME)

    def ink(self, own, depth, path) -> Node | None:
        data = next(iter(self.refs(own, INK_DATA)), None)
        if self.kind(data) != S.INK_DATA:
            return None
        scale = [1.0 if x is None else x for x in (values.float_value(self.get(own, p, "data")) for p in (SCALE_X, SCALE_Y))]
        strokes, words = [], []
        for r in self.refs(data, STROKES):
            found = self.stroke(r, *scale) if self.kind(r) == S.STROKE else None
            if found:
                strokes.append(found)
                words += [self.words[r]] if self.words.get(r) else []
        return Node("ink", [], {"strokes": strokes, "words": " ".join(words) or None}) if strokes else None

    def stroke(self, own: str, scale_x: float, scale_y: float) -> dict | None:
        style, data = next(iter(self.refs(own, STROKE_STYLE)), None), self.get(own, INK_PATH, "data")
        if self.kind(style) != S.STROKE_STYLE or data is None:
            return None
        found = values.points(values.ink_path(data, min(self.limits.ink_values, 8 * len(data))), values.dimensions(self.get(style, INK_DIMENSIONS, "data")), scale_x, scale_y)
        if found is None:
            return None
        width, clear = values.float_value(self.get(style, INK_WIDTH, "data")), self.get(style, INK_CLEAR, "scalar") or 0
        wide = max(0.000001, (1.0 if width is None else width) * abs(scale_x) / values.UNITS)
        return {"points": [{"x": p["x"] * PIXELS, "y": p["y"] * PIXELS} for p in found], "color": values.ink_color(self.get(style, INK_COLOR, "scalar")), "width": max(1.0, wide * PIXELS), "opacity": 1 - min(255, clear) / 255}

    def recognise(self, node: str) -> None:
        """Words by stroke, from the page's tree of recognised text; a word names strokes by numbers under its own GUID."""
        root = next(iter(self.refs(node, RECOGNISED)), None)
        stack, seen = [(root, 0)] if root else [], set()
        while stack:
            own, depth = stack.pop()
            if depth > WORD_DEPTH or own in seen:
                continue
            seen.add(own)
            if self.kind(own) == S.WORD:
                word, data = values.alternatives(self.get(own, WORD_TEXT, "data"))[:1], self.get(own, WORD_STROKES, "data")
                for k in range(16, len(data or b"") - 3, 20) if word else ():
                    self.words[f"{own.rsplit(':', 1)[0]}:{int.from_bytes(data[k : k + 4], 'little')}"] = word[0]
            else:
                stack += [(r, depth + 1) for r in reversed(self.refs(own, WORD_PARTS))]


def linked(runs: list[dict]) -> list[dict]:
    """Takes link fields out of runs; a field's address goes to the next run with text that has none of its own."""
    waiting = None
    for run in runs:
        found = _FIELD.search(run["text"])
        if found:
            run["text"], waiting = run["text"][: found.start()] + run["text"][found.end() :], found[1]
        if waiting is not None and run["text"]:
            run["url"] = waiting if run.get("url") is None else run["url"]
            waiting = None
    return runs


def page_title_of(url: str) -> str | None:
    """The page that a link within the notebook names."""
    found = re.match(r"(?is)onenote:[^#]*#([^&]*)", url)
    if not found or not found[1]:
        return None
    try:
        raw = re.sub(rb"%([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), found[1].encode("utf-8", "surrogatepass"))
        return found[1] if re.search(r"%(?![0-9A-Fa-f]{2})", found[1]) else raw.decode("utf-8")
    except UnicodeDecodeError:
        return found[1]


def finished_run(run: dict) -> dict:
    """A run as rendering needs it: its formula, and its link's target as a file name or an address, escaped."""
    out = {"text": run["text"], "highlight": run.get("highlight"), "latex": names.latex(run["text"].strip(names._STRIP)) if run.get("math") else None}
    url = run.get("url")
    if url:
        title = page_title_of(url)
        out["url"] = names.uri(names.file_name(title) if title else url)
    return out | {m: bool(run.get(m)) for m in ("math", *MARKS)}


def plain_text(node: Node) -> Iterator[str]:
    """The texts of an element and of those within it, in order."""
    if node.kind == "ink":
        yield node.own["words"] or ""
    for run in node.own.get("runs", ()):
        yield run["text"]
    for row in node.own.get("rows", ()):
        for cell in row:
            for child in cell:
                yield from plain_text(child)
    for child in node.children:
        yield from plain_text(child)


def page_elements(objects: list[dict], node: str, limits: GraphLimits = GraphLimits()) -> list[dict]:
    """Rows of a page: paragraphs, tables and assets as they are written (outlines before what lies on the page itself),
    a row of ink with all strokes and the words, one for each nested table that cannot be written, and the title as its
    title nodes give it."""
    page = Page(objects, limits)
    page.recognise(node)
    top = [x for r in page.refs(node, S.CHILDREN) if (x := page.element(r))]
    rows: list[dict] = []
    strokes: list[dict] = []
    words: list[str] = []
    assets = 0

    def asset(of: Node) -> dict:
        nonlocal assets
        assets += 1
        return {"number": assets - 1, "name": of.own["name"], "extension": of.own["extension"], "reference": of.own["reference"], "image": of.kind == "image"}

    def inked(of: Node) -> None:
        strokes.extend(of.own["strokes"])
        if of.own["words"] and of.own["words"] != (words[-1] if words else None):
            words.append(of.own["words"])

    def in_cell(of: Node) -> Iterator[dict]:
        if of.kind == "paragraph":
            yield {"runs": [finished_run(r) for r in of.own["runs"]], "asset": None}
        elif of.kind in ("image", "file"):
            yield {"runs": None, "asset": asset(of)}
        elif of.kind == "ink":
            inked(of)
        elif of.kind == "table":
            rows.append({"kind": "nested"})
        for child in of.children:
            yield from in_cell(child)

    def write(of: Node) -> None:
        if of.kind == "paragraph":
            rows.append({"kind": "paragraph", "runs": [finished_run(r) for r in of.own["runs"]], **{k: of.own.get(k) for k in ("style", "level", "ordered", "format", "tags")}})
        elif of.kind == "table" and of.own["rows"]:
            rows.append({"kind": "table", "cells": [[[p for x in cell for p in in_cell(x)] for cell in row] for row in of.own["rows"]]})
        elif of.kind in ("image", "file"):
            rows.append({"kind": "asset", "asset": asset(of)})
        elif of.kind == "ink":
            inked(of)
        for child in of.children:
            write(child)

    for outlines in (True, False):
        for x in top:
            if (x.kind == "outline") == outlines:
                write(x)
    if strokes:
        rows.append({"kind": "ink", "strokes": strokes, "words": " ".join(words) or None, "asset": {"number": assets, "name": None, "extension": "svg", "reference": None, "image": True}})
    for r in page.refs(node, S.STRUCTURE):
        if page.kind(r) == S.TITLE:
            parts = [t for c in page.refs(r, S.CHILDREN) if (x := page.element(c)) for t in plain_text(x)]
            rows.append({"kind": "title", "words": " ".join(t for t in parts if t.strip(names._STRIP)).strip(names._STRIP)})
    return rows
