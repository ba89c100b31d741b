"""Best-fit packing of pieces of documents into sequences, in bulk-synchronous rounds."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirespark.llm.columns import whole_text
from quirespark.llm.shared import bounded_batches, removed, written
from quirespark.llm.tokenization import encoder, text_bytes

PIECES = "doc_id long, piece int, start long, length int, ids binary"
#: A partition of a round has about this many rows at least.
PART_ROWS = 4096
STATE = "kind byte, id long, size int, used int, part int, rank long, sequence_id long, offset int"
#: Kinds of rows of a round: open sequences, pieces without a place, pieces with one.
GAP, WAITS, PLACED = 0, 1, 2


def cut_pieces(docs: DataFrame, vocabulary: str, end_id: int, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids of every document and then end_id, cut into pieces of `limit` ids and a rest where there are more: a written
    table of piece_id (unique), doc_id, piece (from 0), start, length, ids (binary, little-endian unsigned 32-bit).

    Null text is empty text: the end id alone. Null or repeated document ids are cut like any others. An empty table gives
    an empty one. Other columns are not read.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part, rows = batch.slice(lo, 256), []
                for name, encoded in zip(part.column(0).to_pylist(), encoder(vocabulary).encode(text_bytes(part.column(1))), strict=True):
                    whole = encoded + end
                    rows += [(name, k, at // 4, (min(len(whole), at + 4 * limit) - at) // 4, whole[at : at + 4 * limit]) for k, at in enumerate(range(0, len(whole), 4 * limit))]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in PIECES.split(", ")])

    bounded_batches(docs.sparkSession)
    cut = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(run, PIECES)
    return written(cut.withColumn("piece_id", F.monotonically_increasing_id()), "pieces")


def sweep(rows: list[tuple[int, int, int, int]]) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int]], list[tuple[int, int, int]]]:
    """Best fit among rows (size, kind, id, used) in descending size, of equal sizes gaps first: each piece goes to its
    successor, the smallest open gap that holds it. A gap that became smaller waits until the sweep comes to its size.

    Returns places (piece, size, sequence, offset), pieces without one (piece, size) in descending size, and gaps
    (sequence, size, used) in ascending size.
    """
    stack: list[list[int]] = []  # [size, sequence, used]: the last is the smallest
    later: list[tuple[int, int, list[int]]] = []
    places, waits = [], []
    for turn, (size, kind, name, used) in enumerate(rows):
        while later and -later[0][0] >= size:
            stack.append(heapq.heappop(later)[2])
        if kind == GAP:
            stack.append([size, name, used])
        elif stack:
            gap = stack.pop()
            places.append((name, size, gap[1], gap[2]))
            gap[0] -= size
            gap[2] += size
            if gap[0] >= size:
                stack.append(gap)
            elif gap[0]:
                heapq.heappush(later, (-gap[0], turn, gap))
        else:
            waits.append((name, size))
    gaps = [gap for *_, gap in sorted(later, reverse=True)] + stack[::-1]
    return places, waits, [(name, size, used) for size, name, used in gaps]


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's sweep. Gaps that hold any piece of a later partition get a rank, ascending from the smallest; those
    that became smaller than the partition's last row get rank -1 and wait for the next round."""
    rows: list[tuple[int, int, int, int]] = []
    for batch in batches:
        rows += zip(*(batch.column(c).to_pylist() for c in ("size", "kind", "id", "used")), strict=True)
    if not rows:
        return
    part, last = TaskContext.get().partitionId(), rows[-1][0]
    places, waits, gaps = sweep(rows)
    small = sum(size < last for _, size, _ in gaps)
    out = [(GAP, name, size, used, part, max(k - small, -1), None, None) for k, (name, size, used) in enumerate(gaps)]
    out += [(WAITS, name, size, None, part, k, None, None) for k, (name, size) in enumerate(waits)]
    out += [(PLACED, name, size, None, part, None, to, offset) for name, size, to, offset in places]
    kinds = (pa.int8(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
    for at in range(0, len(out), 65536):
        columns = zip(*out[at : at + 65536], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in STATE.split(", ")])


def matches(parts: list[tuple[int, int, int, int, int]]) -> tuple[list[tuple[int, int, int, int, int, int]], dict[int, int], dict[int, int]]:
    """What pieces of partitions go to gaps of earlier ones, told by counts alone. parts: (part, waiting pieces, the
    largest of them, ranked gaps, the smallest of them) in descending size.

    Returns spans (part, first rank, end rank, gap part, first gap rank, pieces per gap): of the pieces that want the same
    gaps those of lower rank go first, and a gap takes as many as surely fit; and how many pieces and gaps of each part
    were used. Later parts meet the smallest gaps first, as the gaps of the last part are on top.
    """
    spans, taken, spent, stack = [], {}, {}, []
    for part, waiting, largest, gaps, smallest in parts:
        at = 0
        while at < waiting and stack:
            source, left, least = stack[-1]
            each = max(1, least // largest)
            n = min(waiting - at, left * each)
            spans.append((part, at, at + n, source, spent.get(source, 0), each))
            used = -(-n // each)
            spent[source] = spent.get(source, 0) + used
            at += n
            stack[-1] = (source, left - used, least)
            if left == used:
                stack.pop()
        taken[part] = at
        if gaps:
            stack.append((part, gaps, smallest))
    return spans, taken, spent


def _round(spark: SparkSession, state: DataFrame, parts: int) -> tuple[list[DataFrame], DataFrame, DataFrame, DataFrame, int, int, int]:
    """One round over gaps and pieces. Returns its tables, places, gaps and pieces that are left, and as numbers the pieces
    placed, those left, and the sum of their sizes before pieces met gaps of other partitions."""
    order = [F.col("size").desc(), F.col("kind").asc(), F.xxhash64("id").asc(), F.col("id").asc()]
    swept = written(state.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_swept, STATE), "swept")
    waits, ranked = F.col("kind") == WAITS, (F.col("kind") == GAP) & (F.col("rank") >= 0)
    count = lambda which: F.count(F.when(which, 1))
    told = swept.groupBy("part").agg(count(waits).alias("waiting"), F.max(F.when(waits, F.col("size"))).alias("largest"), count(ranked).alias("gaps"), F.min(F.when(ranked, F.col("size"))).alias("smallest"), F.sum(F.when(waits, F.col("size").cast("long"))).alias("volume"), count(F.col("kind") == PLACED).alias("placed"))
    rows = sorted(told.collect())  # a row per partition of the sweep
    spans, taken, spent = matches([(r.part, r.waiting, r.largest, r.gaps, r.smallest) for r in rows])
    used = F.broadcast(spark.createDataFrame([(r.part, taken[r.part], spent.get(r.part, 0)) for r in rows], "part int, taken long, spent long"))
    kept = swept.join(used, "part")
    gaps = kept.filter((F.col("kind") == GAP) & ((F.col("rank") < 0) | (F.col("rank") >= F.col("spent")))).select("id", "size", "used")
    left = kept.filter(waits & (F.col("rank") >= F.col("taken"))).select("id", "size")
    places = swept.filter(F.col("kind") == PLACED).select("id", "sequence_id", "offset")
    tables = [swept]
    if spans:
        span = F.broadcast(spark.createDataFrame(spans, "part int, lo long, hi long, gap_part int, gap_lo long, each long"))
        pieces = swept.filter(waits).select("part", "rank", "id", "size").join(span, "part").filter("rank >= lo and rank < hi")
        pieces = pieces.select("id", "size", "gap_part", (F.col("gap_lo") + F.floor((F.col("rank") - F.col("lo")) / F.col("each"))).alias("gap_rank"), "rank")
        open_gaps = swept.filter(ranked).select(F.col("part").alias("gap_part"), F.col("rank").alias("gap_rank"), F.col("id").alias("sequence_id"), F.col("size").alias("gap"), "used")
        same = Window.partitionBy("gap_part", "gap_rank")
        met = pieces.join(open_gaps, ["gap_part", "gap_rank"]).withColumn("upto", F.sum("size").over(same.orderBy("rank"))).withColumn("all", F.sum("size").over(same)).withColumn("turn", F.row_number().over(same.orderBy("rank")))
        met = written(met.select("id", "sequence_id", (F.col("used") + F.col("upto") - F.col("size")).cast("int").alias("offset"), "turn", (F.col("gap") - F.col("all")).cast("int").alias("gap"), (F.col("used") + F.col("all")).cast("int").alias("used")), "met")
        tables.append(met)
        places = places.unionByName(met.select("id", "sequence_id", "offset"))
        gaps = gaps.unionByName(met.filter("turn = 1 and gap > 0").select(F.col("sequence_id").alias("id"), F.col("gap").alias("size"), "used"))
    met_count = sum(taken.values())
    return tables, places, gaps, left, sum(r.placed for r in rows) + met_count, sum(r.waiting for r in rows) - met_count, sum(r.volume or 0 for r in rows)


def best_fit(pieces: DataFrame, limit: int, parts: int | None = None) -> DataFrame:
    """A place for every piece (piece_id: unique, length: 1 to limit): a written table of piece_id, sequence_id, offset.

    Pieces of over half the limit open sequences of their own, and as many empty ones are opened as the others surely need.
    Then, in phases of falling size (down to a quarter of the limit, an eighth, all), rounds run until no piece waits:
    pieces and gaps are range-sorted by size into `parts` partitions (the session's shuffle partitions; fewer where a
    partition would have less than PART_ROWS rows); each task sweeps its own range; what it could not match meets gaps of larger ranges by rank; gaps shrink, and the round repeats. Only
    counts per partition come to the driver. When a round places nothing, no gap holds any piece that waits, and as many
    empty sequences are opened as those pieces surely need. Equal sizes: gaps before pieces, then by a hash of the id, so
    pieces of one size, however many, are dealt to many tasks. An empty table gives an empty one; extra columns are not read.
    """
    spark = pieces.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    all_pieces = pieces.select(F.col("piece_id").alias("id"), F.col("length").cast("int").alias("size"))
    large = F.col("size") > limit // 2
    room = all_pieces.agg(F.sum(F.when(~large, F.col("size").cast("long"))), F.sum(F.when(large, limit - F.col("size")).cast("long"))).first()
    opened = 0

    def empty(volume: int) -> list[DataFrame]:
        nonlocal opened
        n = max(0, -(-volume // limit))
        fresh = spark.range(opened, opened + n).select((-1 - F.col("id")).alias("id"), F.lit(limit).alias("size"), F.lit(0).alias("used"))
        opened += n
        return [fresh] if n else []

    alone = all_pieces.filter(large)
    places = [alone.select("id", F.col("id").alias("sequence_id"), F.lit(0).alias("offset"))]
    gaps = [alone.filter(F.col("size") < limit).select("id", (limit - F.col("size")).cast("int").alias("size"), F.col("size").alias("used")), *empty((room[0] or 0) - (room[1] or 0))]
    tables, high = [], limit // 2 + 1
    for low in dict.fromkeys((limit // 4, limit // 8, 1)):
        waits = all_pieces.filter((F.col("size") >= low) & (F.col("size") < high))
        held, high, left = [], low, not waits.isEmpty()
        while left:
            held += [g.filter(F.col("size") < low) for g in gaps]
            open_gaps = reduce(DataFrame.unionByName, [g.filter(F.col("size") >= low) for g in gaps])
            state = open_gaps.withColumn("kind", F.lit(GAP).cast("byte")).unionByName(waits.select("id", "size", F.lit(None).cast("int").alias("used"), F.lit(WAITS).cast("byte").alias("kind")))
            made, placed, gap_rows, waits, n_placed, left, volume = _round(spark, state, max(1, min(parts, -(-state.count() // PART_ROWS))))
            tables += made
            places.append(placed)
            gaps = [gap_rows, *(empty(volume) if left and not n_placed else [])]
        gaps = held + gaps
    found = written(reduce(DataFrame.unionByName, places).withColumnRenamed("id", "piece_id"), "places")
    removed(*tables)
    return found


def packed(pieces: DataFrame, places: DataFrame) -> DataFrame:
    """Pieces, with what columns the caller chose of them, and their sequence_id and offset."""
    return pieces.join(places, "piece_id").drop("piece_id")
