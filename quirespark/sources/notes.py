"""Sinks: note trees written from the executors, and reports."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirespark.scratch import written


def write_tree(files: DataFrame, out: str, overwrite: bool = False) -> DataFrame:
    """Writes files (path below `out`, content binary) to a folder that all executors mount; a relative one lies below the
    driver's working folder. One row per file: path, length, error (a file that exists is refused unless overwrite; what the
    system says where it cannot be written). A file appears under its name only when whole."""
    out = os.path.abspath(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, sizes, errors = batch.column(0).to_pylist(), [], []
            for path, data in zip(paths, batch.column(1).to_pylist(), strict=True):
                to = os.path.join(out, path)
                inside = os.path.abspath(to).startswith(os.path.abspath(out) + os.sep)
                error = None if inside else "outside the output folder"
                if inside:
                    part = os.path.join(os.path.dirname(to), f".{uuid.uuid4().hex}.part")  # a name of its own may be as long as names get
                    try:
                        os.makedirs(os.path.dirname(to), exist_ok=True)
                        with open(part, "xb") as f:
                            f.write(data or b"")
                        if overwrite:
                            os.replace(part, to)
                        else:
                            os.link(part, to)
                    except FileExistsError:
                        error = "exists"
                    except OSError as e:
                        error = e.strerror or str(e)
                    finally:
                        if os.path.exists(part):
                            os.remove(part)
                sizes.append(None if error else len(data or b""))
                errors.append(error)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64()), pa.array(errors, pa.string())], names=["path", "length", "error"])

    return files.select(F.col("path").cast("string").alias("path"), F.col("content").cast("binary").alias("content")).mapInArrow(run, "path string, length long, error string")


def dry_run(files: DataFrame) -> DataFrame:
    """How many files and bytes a write would make."""
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).cast("long").alias("bytes"))


def write_notes(notes: DataFrame, attachments: DataFrame, errors: DataFrame, out: str, overwrite: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Writes attachments and then notes (input, ord, path, content) below `out`, and returns what was written of both
    (without content), and the errors with one more for each page that a refused file stopped.

    A page whose attachment is refused is not written, as its note would show another file; attachments that were written
    before stay. A refused file overwrites nothing.
    """
    page = [F.col("input"), F.col("ord.section_ord").alias("section_ord"), F.col("ord.page_ord").alias("page_ord")]
    keys = ["input", "section_ord", "page_ord"]
    told = lambda rows: written(rows.select(*page, "ord", "path"), "told-files")
    own_notes, own_files = told(notes), told(attachments)
    stored = written(write_tree(attachments, out, overwrite), "stored-attachments")
    failed = own_files.join(stored.filter("error is not null").select("path", "error"), "path").groupBy(*keys).agg(F.min(F.struct(F.col("path").alias("file"), "error")).alias("e")).select(*keys, "e.*")
    kept = notes.join(own_notes.join(failed, keys, "left_semi").select("path"), "path", "left_anti")
    noted = written(write_tree(kept, out, overwrite), "stored-notes")
    refused = own_notes.join(noted.filter("error is not null").select("path", "error"), "path").select(*keys, F.col("path").alias("file"), "error")
    stopped = written(failed.unionByName(refused).join(own_notes.select(*keys, "path"), keys), "stopped-pages")
    name = F.regexp_replace(F.regexp_extract("path", r"([^/]*)\z", 1), r"\.md\z", "")
    message = F.concat(F.col("file"), F.when(F.col("error") == "exists", " exists; --overwrite replaces it").otherwise(F.concat(F.lit(": "), "error")))
    more = stopped.select("input", F.struct("section_ord", "page_ord").alias("ord"), name.alias("name"), F.lit("unknown").alias("kind"), F.lit("WRITE_REFUSED").alias("code"), message.alias("message"))
    same_type = more.withColumn("ord", F.col("ord").cast(errors.schema["ord"].dataType))
    rest = own_notes.join(stopped.select("path"), "path", "left_anti").select("input", "ord", "path")
    return rest, own_files.join(stored.filter("error is null").select("path"), "path", "left_semi").select("input", "ord", "path"), errors.unionByName(same_type)


def report(notes: DataFrame, attachments: DataFrame, skipped: DataFrame, errors: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """One row per input: input, notes, attachments, skipped, errors, cancelled. Each table has input, ord and its own
    columns (notes and attachments: path; skipped: page, item, reason; errors: name, kind, code, message). order (input,
    input_ord): all inputs, also those that gave nothing, with their places, which the report then has."""

    def gathered(rows: DataFrame, name: str, value, kind: str) -> DataFrame:
        item = F.struct("ord", value.alias("v"))
        return rows.groupBy("input").agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["v"]).cast(kind).alias(name))

    parts = [
        (gathered(notes, "notes", F.col("path"), "array<string>"), "notes"),
        (gathered(attachments, "attachments", F.col("path"), "array<string>"), "attachments"),
        (gathered(skipped, "skipped", F.struct("page", "item", "reason"), "array<struct<page:string,item:string,reason:string>>"), "skipped"),
        (gathered(errors, "errors", F.struct("name", "kind", "code", "message"), "array<struct<name:string,kind:string,code:string,message:string>>"), "errors"),
    ]
    inputs = order if order is not None else reduce(DataFrame.unionByName, [rows.select("input") for rows in (notes, attachments, skipped, errors)]).distinct()
    for part, name in parts:
        kind = part.schema[name].dataType
        inputs = inputs.join(part, "input", "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))
    return inputs.withColumn("cancelled", F.lit(False))


def report_json(reports: DataFrame) -> DataFrame:
    return reports.select("input", F.to_json(F.struct(*reports.columns)).alias("json"))


def report_envelope(reports: list[dict], out: str, dry: bool) -> str:
    """The reports of a run, of few inputs, as one JSON text."""
    whole = {"ok": not any(r["errors"] for r in reports), "out": out, "dryRun": dry, "reports": reports}
    return json.dumps(whole, indent=2, ensure_ascii=False)
