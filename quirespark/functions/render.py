"""Notes as Markdown: runs, blocks, cells and page bodies as column expressions.

A run is a struct of text, highlight, url (the link's target), latex (what a mathematical run reads) and the flags math,
bold, italic, underline, strikethrough, superscript, subscript.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirespark.functions import text as T

FLAGS = ["math", "bold", "italic", "underline", "strikethrough", "superscript", "subscript"]
RUN = "struct<text:string,latex:string,highlight:string,url:string," + ",".join(f"{f}:boolean" for f in FLAGS) + ">"
TAG = "struct<label:string,checkable:boolean,completed:boolean,shape:int>"
#: Marks around a run, from the inside out.
MARKS = [("superscript", "<sup>", "</sup>"), ("subscript", "<sub>", "</sub>"), ("underline", "<u>", "</u>"), ("bold", "**", "**"), ("italic", "*", "*"), ("strikethrough", "~~", "~~")]


def rendered_run(run: Column) -> Column:
    """A run with its marks, which stand inside the white space around it. A mathematical run is only that."""
    whole = F.coalesce(run["text"], F.lit(""))
    bare = T.trim_space(whole)
    lead, tail = F.regexp_extract(whole, rf"\A[{T.SPACE}]*", 0), F.regexp_extract(whole, rf"[{T.SPACE}]*\z", 0)
    # each part of the expression occurs once: marks are put before and behind, not around again and again
    before = [F.when(run["url"].isNotNull(), "[").otherwise("")] + [F.when(run[f], x).otherwise("") for f, x, _ in reversed(MARKS)]
    behind = [F.when(run[f], x).otherwise("") for f, _, x in MARKS] + [F.when(run["url"].isNotNull(), F.concat(F.lit("]("), run["url"], F.lit(")"))).otherwise("")]
    lit = run["highlight"].isNotNull()
    core = F.concat(*before, F.when(lit, F.concat(F.lit("=="), T.highlight_marker(run["highlight"]))).otherwise(""), T.escape_inline(bare), F.when(lit, "==").otherwise(""), *behind)
    latex = F.when(F.coalesce(run["latex"], F.lit("")) == "", "").otherwise(F.concat(lead, F.lit("$"), run["latex"], F.lit("$"), tail))
    return F.when(bare == "", whole).when(run["math"], latex).otherwise(F.concat(lead, core, tail))


def rendered_runs(runs: Column) -> Column:
    """A paragraph's runs: line ends as LF, no white space around; empty without runs."""
    joined = F.array_join(F.transform(runs, rendered_run), "")
    return F.coalesce(T.trim_space(F.regexp_replace(joined, "\r\n?", "\n")), F.lit(""))


def block(body: Column, style: Column, level: Column, ordered: Column, tags: Column) -> Column:
    """A paragraph's text as a block: struct of text, list_item, callout (the opening line), quoted (its lines as quotes).

    A box or a list mark comes before it, else the marks of a heading; further lines are hard breaks, indented as the list
    is. An admonition is one only outside lists and boxes. Null for an empty text (a null level: no list)."""
    task = T.task_prefix(tags, level)
    prefix = F.coalesce(task, T.list_prefix(level, ordered), F.lit(""))
    indent = F.repeat(F.lit("\t"), F.coalesce(level, F.lit(0)))
    lines = F.transform(F.split(body, "\n"), T.escape_line_start)
    whole = F.concat(F.when(prefix != "", prefix).otherwise(T.heading_prefix(style)), F.array_join(F.transform(lines, lambda x, i: F.when(i > 0, F.concat(indent, x)).otherwise(x)), "  \n"))
    kind = F.when(level.isNull() & task.isNull(), T.callout(tags))
    of = F.filter(tags, lambda t: ~t["checkable"] & t["shape"].isin(*T.CALLOUTS))
    label = F.get(of, F.lit(0))["label"]
    opening = F.concat(F.lit("> [!"), kind, F.lit("]"), F.when(label != "", F.concat(F.lit(" "), label)).otherwise(""))
    quoted = F.array_join(F.transform(F.split(whole, "\n"), lambda x: F.concat(F.lit("> "), x)), "\n")
    shown = F.when(opening.isNotNull(), F.concat(opening, F.lit("\n"), quoted)).otherwise(whole)
    in_list = task.isNotNull() | level.isNotNull()
    return F.when(body != "", F.struct(shown.alias("text"), in_list.alias("list_item"), opening.alias("callout"), F.when(opening.isNotNull(), quoted).alias("quoted")))


def plain_block(body: Column) -> Column:
    """A block that is neither in a list nor an admonition; null for a null text."""
    return F.when(body.isNotNull(), F.struct(body.alias("text"), F.lit(False).alias("list_item"), F.lit(None).cast("string").alias("callout"), F.lit(None).cast("string").alias("quoted")))


def page_body(blocks: Column) -> Column:
    """Blocks in order as a page: a blank line between them but between neighbouring list items; neighbouring admonitions
    with the same opening become one; at most one blank line in a row, no white space around."""
    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("list_item"), F.lit(None).cast("string").alias("callout"), F.lit(0).alias("n"))

    def joined(state: Column, b: Column) -> Column:
        merges = F.coalesce((state["callout"] == b["callout"]) & (state["n"] > 0), F.lit(False))
        gap = F.when(state["n"] == 0, "").when(state["list_item"] & b["list_item"], "\n").otherwise("\n\n")
        shown = F.when(merges, F.concat(F.lit("\n>\n"), b["quoted"])).otherwise(F.concat(gap, b["text"]))
        return F.struct(F.concat(state["text"], shown).alias("text"), b["list_item"].alias("list_item"), b["callout"].alias("callout"), (state["n"] + 1).alias("n"))

    return F.coalesce(T.collapse_body(F.aggregate(blocks, start, joined)["text"]), F.lit(""))


def cell_text(parts: Column) -> Column:
    """A cell's texts that are not empty, with spaces between."""
    return F.array_join(F.filter(parts, lambda x: F.coalesce(x, F.lit("")) != ""), " ")


def with_extension(base: Column, extension: Column) -> Column:
    """A name with an extension, unless it has one or there is none to add."""
    dotted = F.when(extension.startswith("."), extension).otherwise(F.concat(F.lit("."), extension))
    return F.when((F.coalesce(extension, F.lit("")) == "") | T.extension_of(base).isNotNull(), base).otherwise(F.concat(base, dotted))


def page_link(url: Column) -> Column:
    """The page title in a link to a page of the notebook (as percent escapes, which may be broken: then as it stands);
    null for any other address."""
    tail = F.regexp_extract(url, r"(?is)\Aonenote:[^#]*#([^&]*)", 1)
    return F.when(tail != "", F.coalesce(F.try_url_decode(F.replace(tail, F.lit("+"), F.lit("%2B"))), tail))


def joined_path(*parts: Column) -> Column:
    """Parts with slashes between; null and empty ones are left out."""
    return F.array_join(F.filter(F.array(*parts), lambda x: F.coalesce(x, F.lit("")) != ""), "/")


def notebook_name(given: Column, file: Column, sections: Column, groups: Column) -> Column:
    """The name given, else the file's own where it holds several sections or groups; null for a lone section."""
    base = F.regexp_replace(F.regexp_extract(file, r"([^\\/]*)\z", 1), r"(?i)\.(one|onepkg|onex)\z", "")
    return F.coalesce(given, F.when((sections > 1) | (F.size(groups) > 0), base))


def summary(written: bool, notes: int, attachments: int, out: str) -> str:
    return f"{'Wrote' if written else 'Would write'} {notes} notes and {attachments} attachments" + (f" to {out}" if written else "")


#: Reasons by the kind of an error.
REASONS = {
    "unsupported": "this file uses a OneNote feature the reader does not implement",
    "protected": "the file is rights-protected, so its contents are encrypted",
    "malformed": "the file is damaged or is not a OneNote section",
    "limit": "the file exceeds a safety limit for its size or structure",
    "unknown": "unexpected failure",
}
#: What to do about a limit, by its code.
ADVICE = {
    "ONENOTE_CAB_ENTRY_LIMIT": "An entry may be larger with --max-entry-bytes (say 2G).",
    "ONENOTE_CAB_EXPANDED_LIMIT": "An archive may expand to more with --max-expanded-bytes (say 6G); a task holds one archive, so executors need that memory.",
    "ONENOTE_OBJECT_LIMIT": "A section may have more objects with --max-objects; --sections leaves others out.",
    "ONENOTE_ASSET_LIMIT": "An embedded file may be larger with --max-asset-bytes (say 512M), all of a section together with --max-total-asset-bytes; --no-attachments leaves them out.",
}
LIMIT_ADVICE = "--list shows the sections and how large they expand; --sections converts some of them."


def _looked_up(table: dict[str, str], key: Column, otherwise: Column) -> Column:
    return F.coalesce(reduce(lambda c, kv: c.when(key == kv[0], kv[1]), table.items(), F.when(F.lit(False), "")), otherwise)


def reason(kind: Column) -> Column:
    return _looked_up(REASONS, kind, F.lit(REASONS["unknown"]))


def advice(code: Column) -> Column:
    """What to do about an error of a code; null but for limits."""
    return _looked_up(ADVICE, code, F.when(T.error_kind(code) == "limit", LIMIT_ADVICE))
