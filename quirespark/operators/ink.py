"""Ink: coordinate vectors, strokes and their bounds, and drawings."""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Units of a drawing's margin.
PADDING = 10


def signed_varints(data: bytes) -> list[int]:
    """Numbers of seven bits a byte, least first, that go on while the high bit is set; the lowest bit is the sign."""
    out, value, shift = [], 0, 0
    for byte in data:
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            out.append(-(value >> 1) if value & 1 else value >> 1)
            value, shift = 0, 0
    if shift:
        raise ValueError("a number is cut off")
    return out


def encoded_varints(values: list[int]) -> bytes:
    out = bytearray()
    for v in values:
        rest = abs(v) << 1 | (v < 0)
        while rest > 127:
            out.append(rest & 127 | 128)
            rest >>= 7
        out.append(rest)
    return bytes(out)


@F.arrow_udf(T.ArrayType(T.LongType()))
def varint_column(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Null where the bytes are null or end within a number."""

    def safe(x):
        try:
            return None if x is None else signed_varints(x)
        except ValueError:
            return None

    for data in batches:
        yield pa.array([safe(x) for x in data.to_pylist()], pa.list_(pa.int64()))


def absolute(deltas: DataFrame, keys: list[str], order: str, delta: str, to: str) -> DataFrame:
    """Running sums of coordinate differences."""
    ordered = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return deltas.withColumn(to, F.sum(delta).over(ordered))


def bounds(points: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    return points.groupBy(*keys).agg(F.min(x).alias("min_x"), F.min(y).alias("min_y"), F.max(x).alias("max_x"), F.max(y).alias("max_y"))


def number_text(v: float) -> str:
    """A number in its shortest form: whole numbers without a point, very small and large ones with an exponent."""
    v = float(v)
    if not math.isfinite(v):
        return "NaN" if v != v else "Infinity" if v > 0 else "-Infinity"
    if v == int(v) and abs(v) < 1e21:
        return str(int(v))
    text = repr(v)
    if "e" in text:
        mantissa, exponent = text.split("e")
        k = int(exponent)
        if -7 < k < 0:
            return f"{v:.{-k + len(mantissa.replace('-', '').replace('.', '')) - 1}f}"
        return f"{mantissa}e{'+' if k > 0 else '-'}{abs(k)}"
    return text


def fixed_text(v: float, digits: int = 2) -> str:
    """A number with so many digits behind the point, halves of its exact value away from zero."""
    return str(Decimal(v).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) if math.isfinite(v) else number_text(v)


def drawing(strokes: list[dict]) -> str | None:
    """Strokes (points, color, width, opacity) as SVG: a dot for one point, a path for more; null without points."""
    drawn = [s for s in strokes if s["points"]]
    if not drawn:
        return None
    xs, ys = ([p[k] for s in drawn for p in s["points"]] for k in ("x", "y"))
    at = lambda p: (number_text(p["x"] - min(xs) + PADDING), number_text(p["y"] - min(ys) + PADDING))
    shapes = []
    for s in drawn:
        faint = f' opacity="{fixed_text(s["opacity"])}"' if s["opacity"] < 1 else ""
        spots = [at(p) for p in s["points"]]
        if len(spots) == 1:
            shapes.append(f'<circle cx="{spots[0][0]}" cy="{spots[0][1]}" r="{number_text(s["width"] / 2)}" fill="{s["color"]}"{faint}/>')
        else:
            path = " ".join(f"{'L' if k else 'M'} {x} {y}" for k, (x, y) in enumerate(spots))
            shapes.append(f'<path d="{path}" stroke="{s["color"]}" stroke-width="{number_text(s["width"])}" fill="none" stroke-linecap="round" stroke-linejoin="round"{faint}/>')
    w, h = (number_text(max(v) - min(v) + 2 * PADDING) for v in (xs, ys))
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{w}" height="{h}" viewBox="0 0 {w} {h}">' + "\n".join(shapes) + "</svg>"


@F.arrow_udf(T.StringType())
def drawing_column(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for pages in batches:
        yield pa.array([drawing(x or []) for x in pages.to_pylist()], pa.string())
