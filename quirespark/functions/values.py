"""What the bytes of property values mean. Nulls stay null."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirespark.sources.cabinet import FormatError

#: Ids of ink dimensions; units of half an inch.
DIMENSIONS = {"x": "598a6a8f-52c0-4ba0-93af-af357411a561", "y": "b53f9f75-04e0-4498-a7ee-c30dbb5a9011", "pressure": "2d500773-f4f9-4e18-b3f2-2ce1b1a3610c"}
UNITS = 1270
#: Milliseconds from 1601 and seconds from 1970 to 1980 against 1970.
FILE_EPOCH, TIME32_EPOCH = 11644473600000, 315532800


def wide_text(data: bytes | None) -> str | None:
    """UTF-16 text without zeros at its end; null for no bytes. Broken pairs become replacement characters."""
    return data[: len(data) // 2 * 2].decode("utf-16le", "replace").rstrip("\0") if data else None


def byte_text(data: bytes | None) -> str | None:
    """A character for each byte, without zeros at the end."""
    return data.decode("latin-1").rstrip("\0") if data else None


def float_value(data: bytes | None) -> float | None:
    return struct.unpack("<f", data)[0] if data is not None and len(data) == 4 else None


def number_array(data: bytes | None) -> list[int]:
    """Unsigned 32-bit numbers; none where the bytes are not whole ones."""
    return list(struct.unpack(f"<{len(data) // 4}I", data)) if data and len(data) % 4 == 0 else []


def list_format(data: bytes | None) -> str:
    """A number list's format: its first character is its length."""
    text = data[: len(data) // 2 * 2].decode("utf-16le", "replace") if data and len(data) > 1 else ""
    return text[1 : 1 + min(ord(text[0]), len(text) - 1)] if text else ""


def is_ordered(data: bytes | None) -> bool:
    """A format with a place for the number is that of an ordered list."""
    return "�" in list_format(data)


def dimensions(data: bytes | None) -> list[str]:
    """Ids of the dimensions of an ink path: records of 32 bytes."""
    return [str(uuid.UUID(bytes_le=data[k : k + 16])) for k in range(0, len(data or b"") - 31, 32)]


def alternatives(data: bytes | None) -> list[str]:
    """Recognised words in order of preference."""
    return [x for x in data[: len(data) // 2 * 2].decode("utf-16le", "replace").split("\0") if x] if data and len(data) > 1 else []


def ink_path(data: bytes | None, most: int = 1_000_000) -> list[int]:
    """A counted vector of signed numbers of seven bits a byte, the lowest bit being the sign."""
    found: list[int] = []
    value = shift = size = 0
    wanted = None
    for byte in data or b"":
        if wanted is not None and len(found) == wanted:
            break
        value, shift, size = value | (byte & 127) << shift, shift + 7, size + 1
        if size > 10 or size == 10 and byte > 127 or byte > 127 and shift > 49:
            raise FormatError("ONENOTE_INK_VARINT")
        if byte < 128:
            if wanted is None:
                wanted = value >> 1
                if wanted > most:
                    raise FormatError("ONENOTE_INK_PATH_LIMIT")
            else:
                found.append(-(value >> 1) if value & 1 else value >> 1)
            value = shift = size = 0
    if size:
        raise FormatError("ONENOTE_INK_VARINT")
    if len(found) < (wanted or 0):
        raise FormatError("ONENOTE_INK_PATH_TRUNCATED")
    return found


def points(values: list[int], dims: list[str], scale_x: float, scale_y: float) -> list[dict] | None:
    """Points of a path, in half inches: values lie dimension by dimension, each but the first as the difference to the one
    before. Null without x or y, without values, or where they do not divide by the dimensions."""
    at = [dims.index(DIMENSIONS[k]) if DIMENSIONS[k] in dims else -1 for k in ("x", "y")]
    if min(at) < 0 or not values or len(values) % len(dims):
        return None
    n = len(values) // len(dims)
    sums = []
    for k in at:
        total, own = 0, []
        for v in values[k * n : (k + 1) * n]:
            total += v
            own.append(total)
        sums.append(own)
    return [{"x": x * scale_x / UNITS, "y": y * scale_y / UNITS} for x, y in zip(*sums, strict=True)]


def ink_color(value: int | None) -> str:
    """0x00BBGGRR as #rrggbb; black without a value."""
    v = value or 0
    return f"#{v & 255:02x}{v >> 8 & 255:02x}{v >> 16 & 255:02x}"


def _texts(f):
    @F.arrow_udf(T.StringType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array([f(x) for x in column.to_pylist()], pa.string())

    return run


wide_text_column, byte_text_column, list_format_column = (_texts(f) for f in (wide_text, byte_text, list_format))


def file_time(value: Column) -> Column:
    """100 ns ticks from 1601 as a timestamp; null for 0."""
    millis = (value / F.lit(10000.0) - F.lit(float(FILE_EPOCH))).cast("long")
    return F.when(value != 0, F.timestamp_millis(millis))


def time32(value: Column) -> Column:
    """Seconds from 1980 as a timestamp."""
    return F.timestamp_seconds(value.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)) + TIME32_EPOCH)


def page_level(value: Column) -> Column:
    """Levels count from 1, and a page without one is at the top."""
    return F.greatest(F.lit(0), F.coalesce(value, F.lit(1)) - 1).cast("int")


def file_key(reference: Column) -> Column:
    """The name of a payload in a reference such as `<ifndf>{GUID}`; null for any other text."""
    bare = F.regexp_replace(F.trim(F.substring(reference, 8, 1 << 30)), r"\x00+\z", "")
    return F.when(F.lower(reference).startswith("<ifndf>"), F.lower(F.regexp_replace(F.regexp_replace(bare, r"\A\{", ""), r"\}\z", "")))
