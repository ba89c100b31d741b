"""Text functions that need Unicode normal forms or byte limits: Arrow batches, never a row at a time."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPACE = "\t-\r \xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_STRIP = "".join(chr(c) for c in [*range(9, 14), 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF])
#: Names are cut to this many UTF-8 bytes.
NAME_BYTES = 240

#: Script characters and what they stand for.
_UP = dict(zip("⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿⁱ", "0123456789+-=()ni", strict=True))
_DOWN = dict(zip("₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎", "0123456789+-=()", strict=True))
#: Names that file systems reserve.
_DEVICE = re.compile(r"(con|prn|aux|nul|com[0-9]|lpt[0-9])(\..*)?\Z", re.I)


def latex(text: str) -> str:
    for table, mark in ((_UP, "^"), (_DOWN, "_")):
        text = re.sub(f"[{''.join(table)}]+", lambda m, t=table, k=mark: k + "{" + "".join(t[c] for c in m[0]) + "}", text)
    return re.sub("[\u2061-\u2064]", "", unicodedata.normalize("NFKC", text)).strip(_STRIP)


def uri(text: str) -> str:
    """Percent-encoding that leaves reserved characters."""
    return quote(text, safe=";,/?:@&=+$-_.!~*'()#")


def _tidy(name: str) -> str:
    name = "" if name and not name.strip(".") else name.rstrip(". ")
    name = "" if _DEVICE.match(name) else name
    return re.sub(rf"\A[.{_SPACE}]+", "", re.sub(r"[\[\]#|^]", "", name))


def file_name(title: str | None) -> str:
    """A title as a file name: composed form, no reserved characters or names, at most NAME_BYTES bytes (cut between
    characters, and at the last space if that keeps more than half)."""
    text = unicodedata.normalize("NFC", title or "").translate({ord(c): "-" for c in "/\\"} | dict.fromkeys(map(ord, '?<>:*|"')) | dict.fromkeys([*range(0x20), *range(0x80, 0xA0)]))
    name = _tidy(text)
    if len(name.encode("utf-8", "replace")) > NAME_BYTES:
        cut = name.encode("utf-8", "replace")[:NAME_BYTES].decode("utf-8", "ignore")
        space = cut.rfind(" ")
        name = _tidy(cut[:space] if space > len(cut) / 2 else cut)
    return name.strip(_STRIP) or "Untitled"


def _column(f):
    @F.arrow_udf(T.StringType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([None if x is None else f(x) for x in texts.to_pylist()], pa.string())

    return run


latex_column, uri_column, file_name_column, json_column = (_column(f) for f in (latex, uri, file_name, lambda x: json.dumps(x, ensure_ascii=False)))
