"""Markdown and file-name text functions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space of the page format (wider than ASCII, with the byte-order mark), as a regex class body.
SPACE = r"\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"

#: Highlight inks (red, green, blue) by marker, in order of preference.
INKS = [("🔴", 255, 0, 0), ("🔴", 255, 105, 180), ("🟠", 255, 165, 0), ("🟡", 255, 255, 0), ("🟢", 0, 255, 0), ("🟢", 0, 128, 0), ("🔵", 0, 0, 255), ("🔵", 0, 255, 255), ("🟣", 128, 0, 128), ("🟣", 255, 0, 255)]

#: Tag shapes that are admonitions, and those that are check boxes.
CALLOUTS = {13: "important", 15: "question", 17: "danger", 21: "tip", 111: "question"}
CHECKABLE = [*range(1, 13), 28, 30, 32, 48, 50, 52, 69, 71, 73, *range(89, 100)]

#: Error codes of inputs that are sound but not supported.
UNSUPPORTED = ["ONENOTE_CAB_MSZIP", "ONENOTE_CAB_COMPRESSION", "ONENOTE_CAB_LZX_WINDOW", "ONENOTE_NOT_REVISION_STORE", "ONENOTE_UNKNOWN_FILE_FORMAT", "ONENOTE_ONEX_UNSUPPORTED", "ONENOTE_PROPERTY_TYPE"]


def trim_space(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def escape_inline(text: Column) -> Column:
    """Backslashes before brackets, backticks and less-than signs."""
    return F.regexp_replace(text, r"[\[\]`<]", r"\\$0")


def escape_line_start(line: Column) -> Column:
    """A backslash before what Markdown would read as a heading, quote, table, list, fence or rule at a line's start."""
    # fixed values: what Markdown reads as a mark at a line's start
    marks = [rf"#{{1,6}}(?=[{SPACE}]|\z)", ">", r"\|", rf"[-*+](?=[{SPACE}])", rf"[0-9]+[.)](?=[{SPACE}])", "`{3,}", "~{3,}", r"-{3,}\z", r"={3,}\z"]
    return F.regexp_replace(line, rf"\A([{SPACE}]*)({'|'.join(marks)})", r"$1\\$2")


def escape_lines(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, "\n"), escape_line_start), "\n")


def collapse_body(text: Column) -> Column:
    """Line ends as LF, at most one blank line in a row, no white space around."""
    return trim_space(F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "\n{3,}", "\n\n"))


def heading_prefix(style: Column) -> Column:
    level = F.regexp_extract(F.lower(F.coalesce(style, F.lit(""))), r"\Ah([1-6])\z", 1)
    return F.when(level != "", F.concat(F.repeat(F.lit("#"), level.try_cast("int")), F.lit(" "))).otherwise("")


def list_prefix(level: Column, ordered: Column) -> Column:
    """Empty where there is no list (a null level)."""
    return F.coalesce(F.concat(F.repeat(F.lit("\t"), level), F.when(ordered, "1. ").otherwise("- ")), F.lit(""))


def task_prefix(tags: Column, level: Column) -> Column:
    """The box of the first checkable tag (array of structs with checkable, completed); null where there is none."""
    first = F.element_at(F.filter(tags, lambda t: t["checkable"]), 1)
    return F.when(F.exists(tags, lambda t: t["checkable"]), F.concat(F.repeat(F.lit("\t"), F.coalesce(level, F.lit(0))), F.when(first["completed"], "- [x] ").otherwise("- [ ] ")))


def callout(tags: Column) -> Column:
    """The admonition of the first tag that has one and is no check box; null where there is none."""
    kinds = F.create_map(*[F.lit(x) for pair in CALLOUTS.items() for x in pair])
    found = F.filter(tags, lambda t: ~t["checkable"] & t["shape"].isin(*CALLOUTS))
    return F.when(F.size(found) > 0, F.element_at(kinds, F.get(found, F.lit(0))["shape"]))


def checkable(shape: Column) -> Column:
    return shape.isin(*CHECKABLE)


def channels(color: Column) -> list[Column]:
    return [F.conv(F.substring(color, at, 2), 16, 10).cast("int") for at in (2, 4, 6)]


def highlight_marker(color: Column) -> Column:
    """The marker of the nearest ink by squared distance (the earlier on a tie); empty for anything but #rrggbb."""
    rgb = channels(color)
    square = lambda ink: reduce(lambda a, b: a + b, ((F.lit(x) - c) * (F.lit(x) - c) for x, c in zip(ink[1:], rgb, strict=True)))
    nearest = F.array_min(F.array(*(F.struct(square(ink).alias("d"), F.lit(k).alias("k"), F.lit(ink[0]).alias("m")) for k, ink in enumerate(INKS))))
    return F.when(color.rlike(r"\A#[0-9A-Fa-f]{6}\z"), nearest["m"]).otherwise("")


def color_text(value: Column) -> Column:
    """0x00BBGGRR as #rrggbb; null for white and for colours with a high byte."""
    part = lambda shift: F.lpad(F.lower(F.hex(F.shiftright(value, shift).bitwiseAND(F.lit(255)))), 2, "0")
    return F.when((value >= 0) & (value < 0xFFFFFF), F.concat(F.lit("#"), part(0), part(8), part(16)))


def table_cell(text: Column) -> Column:
    return trim_space(F.replace(F.regexp_replace(text, rf"[{SPACE}]+", " "), F.lit("|"), F.lit("\\|")))


def gfm_table(rows: Column) -> Column:
    """A table from an array of arrays of cells: rows are padded to the widest, the first is the header."""
    width = F.array_max(F.transform(rows, F.size))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    padded = F.transform(rows, lambda r: line(F.concat(F.transform(r, table_cell), F.array_repeat(F.lit(""), width - F.size(r)))))
    rule = line(F.array_repeat(F.lit("---"), width))
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.slice(padded, 1, 1), F.array(rule), F.slice(padded, 2, F.greatest(F.size(rows) - 1, F.lit(0)))), "\n"))


def tidy_name(name: Column) -> Column:
    """The rules. Names without what file systems or links reserve, in this order: dots alone, trailing dots and spaces, device names,
    link characters, leading dots and space."""
    rules = [r"\A\.+\z", r"[. ]+\z", r"(?i)\A(con|prn|aux|nul|com[0-9]|lpt[0-9])(\..*)?\z", r"[\[\]#|^]", rf"\A[.{SPACE}]+"]
    return reduce(lambda c, rule: F.regexp_replace(c, rule, ""), rules, name)


def sanitize_name(name: Column) -> Column:
    """A file name for a title that is in composed form and within the length limit (see names.file_name for any title)."""
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"[/\\]", "-"), r'[?<>:*|"\x00-\x1F\x80-\x9F]', "")
    found = trim_space(tidy_name(clean))
    return F.when(found == "", "Untitled").otherwise(found)


def extension_of(name: Column) -> Column:
    found = F.regexp_extract(name, rf"\.([^.{SPACE}\\/]+)\z", 1)
    return F.when(found != "", found)


def entry_title(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)\z", 1), r"(?i)\.one\z", "")


def entry_groups(path: Column) -> Column:
    parts = F.split(path, r"[/\\]")
    return F.filter(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: (p != "") & (p != "."))


def json_text(text: Column) -> Column:
    """A JSON string literal; control characters that have no short escape are told by small hexadecimal digits."""
    found = F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r"(?s)\A\{\"v\":(.*)\}\z", 1)
    # escapes of control characters all read 00 and two digits; a backslash of the text itself is doubled and stays
    parts = F.regexp_extract_all(found, F.lit(r"(?s)(\\.(?:(?<=u)[0-9A-F]{4})?|[^\\]+)"), 1)
    return F.array_join(F.transform(parts, lambda x: F.when(x.startswith("\\u"), F.lower(x)).otherwise(x)), "")


def front_matter(title: Column, page_id: Column, section: Column, notebook: Column, groups: Column, updated: Column, conflict: Column, deleted: Column, created: Column | None = None) -> Column:
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value)
    stamp = lambda at: F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.concat_ws(
        "\n",
        F.lit("---"),
        line("title", json_text(title)),
        F.lit("source: onenote"),
        line("onenote-id", json_text(page_id)),
        line("section", json_text(section)),
        F.when(notebook != "", line("notebook", json_text(notebook))),
        F.when(F.size(groups) > 0, line("section-group", json_text(F.array_join(groups, "/")))),
        line("created", stamp(created)) if created is not None else F.lit(None).cast("string"),
        line("updated", stamp(updated)),
        F.when(conflict, "conflict: true"),
        F.when(deleted, "deleted: true"),
        F.lit("---"),
        F.lit(""),
    )


def error_kind(code: Column) -> Column:
    return F.when(code.endswith("_LIMIT") | (code == "ONENOTE_OFFSET_RANGE"), "limit").when(code == "ONENOTE_ONEX_PROTECTED", "protected").when(code.isin(*UNSUPPORTED), "unsupported").otherwise("malformed")
