"""Column expressions that several corpus operators use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space as the result contracts name it: \x20 and \x09 to \x0D.
SPACE = r"\x20\x09-\x0D"


def whole_text(name: str) -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def spaced(text: Column) -> Column:
    """Every run of white space as one space. Single spaces, the usual case, are not touched."""
    return F.regexp_replace(text, rf"[{SPACE}]{{2,}}|[\x09-\x0D]", " ")


def fold(id_name: str, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_name).cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def unused(rows: DataFrame, stem: str) -> str:
    """A column name that no column of the rows has, in any case."""
    taken = {c.lower() for c in rows.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem
