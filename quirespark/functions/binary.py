"""Functions over bytes: file kinds and archive checksums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kinds by leading bytes, as (first byte from 1, hexadecimal, kind), in order of precedence.
LEADING = [(1, "89504E47", "png"), (1, "FFD8FF", "jpg"), (1, "47494638", "gif"), (1, "25504446", "pdf"), (1, "49492A00", "tiff"), (1, "4D4D002A", "tiff"), (1, "424D", "bmp"), (1, "1F8B", "gz"), (1, "494433", "mp3")]
#: Kinds of tagged containers: RIFF forms, brands after ftyp, and archives.
RIFF = {"WEBP": "webp", "WAVE": "wav"}
BRANDS = [("avi", "avif"), ("hei", "heic"), ("mif1", "heic"), ("msf1", "heic"), ("qt", "mov")]


def magic_kind(data: Column) -> Column:
    """The file extension that the first bytes tell, or null."""
    head = F.hex(F.substring(data, 1, 12))
    at = lambda first, n: F.substring(head, 2 * first - 1, 2 * n)
    code = lambda text: text.encode().hex().upper()
    found = F.when(F.lit(False), "")
    for first, value, kind in LEADING:
        found = found.when(at(first, len(value) // 2) == value, kind)
    for tag, kind in RIFF.items():
        found = found.when((at(1, 4) == code("RIFF")) & (at(9, 4) == code(tag)), kind)
    boxed = at(5, 4) == code("ftyp")
    for brand, kind in BRANDS:
        found = found.when(boxed & at(9, 4).startswith(code(brand)), kind)
    return found.when(boxed, "mp4").when(at(1, 4) == "504B0304", "zip")


def container_kind(data: Column) -> Column:
    """cabinet, compound or section, by the first bytes."""
    head = F.hex(F.substring(data, 1, 8))
    return F.when(head.startswith("4D534346"), "cabinet").when(head == "D0CF11E0A1B11AE1", "compound").otherwise("section")


@F.arrow_udf(T.LongType())
def cabinet_checksum(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """XOR of the little-endian 32-bit words; the bytes after the last whole word are one big-endian number."""

    def of(data: bytes | None) -> int | None:
        if data is None:
            return None
        whole = len(data) // 4
        return int(np.bitwise_xor.reduce(np.frombuffer(data, "<u4", whole), initial=0)) ^ int.from_bytes(data[4 * whole :], "big")

    for column in batches:
        yield pa.array([of(x) for x in column.to_pylist()], pa.int64())
