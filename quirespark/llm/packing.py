"""Cost-balanced packing of documents into training sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirespark.llm.columns import whole_text
from quirespark.llm.shared import bounded_batches
from quirespark.llm.tokenization import MEMO_WORDS, encoder, text_bytes

#: Ids that are packed together: what a task holds, and the block within which costs are balanced.
BLOCK_TOKENS = 4 << 20
#: Estimated cost of a piece of n tokens: n + n * n * QUADRATIC.
QUADRATIC = 1 / 2048

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, cost double"


def capacities(total: int, limit: int) -> np.ndarray:
    """Sequences of a block: full ones, and for the rest one for each power of two in it, which needs no padding."""
    rest = total % limit
    return np.array([limit] * (total // limit) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1], np.int64)


def assign(lengths: np.ndarray, limit: int, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one block.

    A document over the limit is first cut to pieces of the limit and a rest. Pieces go in descending order to the
    sequence of lowest cost that has room for the whole piece; where none has, the piece is cut to the room that the
    cheapest open sequence still has and the remainder goes on. Equal costs: the first sequence. Every sequence ends full.
    """
    room = capacities(int(lengths.sum()), limit)
    used, cost, found = np.zeros(len(room), np.int64), np.zeros(len(room)), []
    pieces = [(min(limit, n - at), doc, at) for doc, n in enumerate(lengths.tolist()) for at in range(0, n, limit)]
    for length, doc, start in sorted(pieces, key=lambda p: (-p[0], p[1], p[2])):
        while length:
            left = room - used
            fits = left >= length
            to = int(np.where(fits if fits.any() else left > 0, cost, np.inf).argmin())
            part = min(length, int(left[to]))
            found.append((doc, start, part, to, int(used[to])))
            used[to] += part
            cost[to] += part + part * part * quadratic
            start, length = start + part, length - part
    return found


def pack(docs: DataFrame, vocabulary: str, end_id: int, limit: int = 4096, block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text", memo_words: int = MEMO_WORDS) -> DataFrame:
    """Packs all documents into sequences of at most `limit` (a power of two) ids. One row per piece: doc_id, start,
    length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset, cost.

    A document's ids are its text's and then end_id. Each task packs its own rows in blocks of about block_tokens ids,
    without a shuffle; a sequence's id holds the task, the block and its place there. All sequences of a block are full:
    `limit` ids, or a power of two for its rest.

    Null text is empty text: the end id alone. Null or repeated ids are packed like any others. An empty table gives no
    rows. A document longer than a block makes a block of its own. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, block, names, ids, held = TaskContext.get().partitionId(), 0, [], [], 0
        end = np.array([end_id], "<u4").tobytes()

        def packed() -> Iterator[pa.RecordBatch]:
            lengths = np.array([len(x) // 4 for x in ids], np.int64)
            found = assign(lengths, limit)
            for at in range(0, len(found), 4096):
                doc, start, length, to, offset = (np.array(x, np.int64) for x in zip(*found[at : at + 4096], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([names[d] for d in doc.tolist()], pa.int64()),
                        pa.array(start),
                        pa.array(length),
                        pa.array([ids[d][4 * s : 4 * (s + n)] for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)], pa.binary()),
                        pa.array(lengths[doc]),
                        pa.array((np.int64(task) << 40) + (np.int64(block) << 20) + to),
                        pa.array(offset),
                        pa.array(length + length * length * QUADRATIC),
                    ],
                    names=[c.split()[0] for c in SCHEMA.split(", ")],
                )

        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                for name, encoded in zip(part.column(0).to_pylist(), encoder(vocabulary, memo_words).encode(text_bytes(part.column(1))), strict=True):
                    names.append(name)
                    ids.append(encoded + end)
                    held += len(encoded) // 4 + 1
                    if held >= block_tokens:
                        yield from packed()
                        block, names, ids, held = block + 1, [], [], 0
        if ids:
            yield from packed()

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(run, SCHEMA)
