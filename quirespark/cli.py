"""The command line: converts inputs to a tree of notes, or lists their sections.

Exit codes: 0, every input converted; 1, an input, section or file failed; 2, the command line cannot be followed.
"""

from __future__ import annotations

import argparse
import json
import re
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.functions import render
from quirespark.plans import convert
from quirespark.sources import cabinet, notes
from quirespark.sources.property_sets import GraphLimits


def size(text: str) -> int:
    """A number of bytes, plain or in K, M or G."""
    found = re.fullmatch(r"([0-9]+(?:\.[0-9]+)?)\s*([kmg]?)b?", text.strip(), re.I)
    if not found:
        raise argparse.ArgumentTypeError(f'a size such as 512M or 4G, not "{text}"')
    return int(float(found[1]) * 1024 ** " kmg".index(found[2].lower() or " "))


def count(text: str) -> int:
    if not re.fullmatch(r"[0-9]+", text) or int(text) < 1:
        raise argparse.ArgumentTypeError(f'a whole number, not "{text}"')
    return int(text)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quirespark", description="Notes from note sections.")
    p.add_argument("inputs", nargs="+")
    p.add_argument("-o", "--out", default="out")
    for flag in ("--list", "--dry-run", "--overwrite", "--no-attachments", "--no-frontmatter", "--no-nest", "--include-deleted", "--json"):
        p.add_argument(flag, action="store_true")
    p.add_argument("-q", "--quiet", action="store_true")
    p.add_argument("--sections", type=lambda x: frozenset(y.strip() for y in x.split(",") if y.strip()))
    p.add_argument("--notebook")
    p.add_argument("--attachments", default="attachments")
    for flag in ("--max-entry-bytes", "--max-expanded-bytes", "--max-asset-bytes", "--max-total-asset-bytes"):
        p.add_argument(flag, type=size)
    for flag in ("--max-entries", "--max-objects"):
        p.add_argument(flag, type=count)
    return p


def options(args: argparse.Namespace) -> convert.Options:
    """A larger limit on one asset raises that on all of a section, unless that is given too."""
    least = GraphLimits()
    one = args.max_asset_bytes or least.asset_bytes
    total = args.max_total_asset_bytes or max(least.total_asset_bytes, one)
    if total < one:
        parser().error("--max-total-asset-bytes must be at least --max-asset-bytes")
    names = ("entry_bytes", "expanded_bytes", "entries")
    archive = {k: v for k, v in zip(names, (args.max_entry_bytes, args.max_expanded_bytes, args.max_entries), strict=True) if v}
    return convert.Options(
        notebook=args.notebook,
        sections=args.sections,
        attachments_dir=None if args.no_attachments else args.attachments,
        frontmatter=not args.no_frontmatter,
        nest=not args.no_nest,
        include_deleted=args.include_deleted,
        archive=cabinet.Limits(**archive),
        graph=GraphLimits(objects=args.max_objects or least.objects, asset_bytes=one, total_asset_bytes=total),
    )


def listed(spark: SparkSession, inputs: DataFrame, order: DataFrame, chosen: convert.Options, as_json: bool) -> int:
    """Prints each input's sections in order, an input at a time; 1 if any input cannot be listed."""
    wanted = set(chosen.sections) if chosen.sections else None
    section = F.when(F.col("code").isNull(), F.struct(F.col("entry_name").alias("name"), "title", "groups", F.col("folder_index").alias("folderIndex"), F.when(F.col("folder_index").isNotNull(), F.col("expanded_length")).alias("expandedLength")))
    fault = F.when(F.col("code").isNotNull(), F.concat_ws(" ", F.concat("code", F.lit(": "), render.reason(F.col("error_kind"))), render.advice(F.col("code"))))
    rows = cabinet.list_sections(inputs, wanted, chosen.archive).select("input", F.struct(F.coalesce("entry_ord", F.lit(-1)).alias("at"), section.alias("section")).alias("s"), fault.alias("fault"))
    told = rows.groupBy("input").agg(F.sort_array(F.collect_list("s")).alias("all"), F.max("fault").alias("error"))
    sections = F.filter(F.transform("all", lambda x: x["section"]), lambda x: x.isNotNull())
    items = order.join(told, "input", "left").select("input_ord", "input", F.coalesce(sections, F.array().cast(told.select(sections.alias("x")).schema["x"].dataType)).alias("sections"), "error")
    failed, n = False, 0
    if as_json:
        print("[")
    for r in items.orderBy("input_ord").toLocalIterator():
        failed |= r.error is not None
        own = [{k: v for k, v in s.asDict().items() if v is not None} for s in r.sections]
        if as_json:
            text = json.dumps({"file": r.input, "sections": own} | ({"error": r.error} if r.error else {}), indent=2, ensure_ascii=False)
            print((",\n" if n else "") + "\n".join("  " + line for line in text.split("\n")), end="")
        else:
            print(r.input)
            if r.error:
                print(f"  ! {r.error}")
            for s in own:
                more = f"\t{s['expandedLength'] / (1 << 20):.1f} MiB\tfolder {s['folderIndex']}" if "folderIndex" in s else ""
                print(f"  {' / '.join([*s['groups'], s['title']])}\t{s['name']}{more}")
        n += 1
    if as_json:
        print(("\n" if n else "") + "]")
    return int(failed)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    chosen = options(args)
    spark = spark or SparkSession.builder.getOrCreate()
    try:
        inputs, order = cabinet.given_inputs(spark, args.inputs)
        if order.isEmpty():
            raise FileNotFoundError("No .one, .onepkg or .onex files in the given paths")
    except FileNotFoundError as e:
        print(f"{e}\n\n{parser().format_usage()}", end="", file=sys.stderr)
        return 2
    if args.list:
        return listed(spark, inputs, order, chosen, args.json)
    done = convert.convert(inputs, chosen, order)
    parts = (done.notes, done.attachments, done.errors)
    if not args.dry_run:
        parts = notes.write_notes(*parts, args.out, args.overwrite)
    told = lambda rows: rows.withColumn("ord", F.struct(*(F.coalesce(f"ord.{k}", F.lit(-1)).cast("int").alias(k) for k in rows.schema["ord"].dataType.names)))
    made, attached, errors = map(told, parts)
    reports = [r.asDict(True) for r in notes.report(made, attached, told(done.skipped), errors, order).orderBy("input_ord").drop("input_ord").collect()]
    if args.json:
        print(notes.report_envelope(reports, args.out, args.dry_run))
    else:
        for r in reports:
            if not args.quiet:
                counts = [(len(r[k]), k) for k in ("notes", "attachments")] + [(len(r[k]), w) for k, w in (("skipped", "skipped"), ("errors", "failed")) if r[k]]
                print(f"{r['input']}: " + ", ".join(f"{n} {what}" for n, what in counts), file=sys.stderr)
            for e in r["errors"]:
                print(f"  ! {e['name']}: {e['message']}", file=sys.stderr)
        if not args.quiet:
            print(render.summary(not args.dry_run, *(sum(len(r[k]) for r in reports) for k in ("notes", "attachments")), args.out))
    return 1 if any(r["errors"] for r in reports) else 0


if __name__ == "__main__":
    sys.exit(main())
