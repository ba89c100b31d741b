"""Token ids as flat binary files with 64-bit document offsets.

A shard is four files: `.ids` (unsigned little-endian integers, 16 bits where the vocabulary allows it, else 32),
`.offsets` (unsigned 64-bit, one more than documents, counted in ids from the shard's start), `.docs` (signed 64-bit
document ids) and `.valid` (one byte per document, 0 where its id is null). Shards follow one another in ascending id
order; a shard's first id in the whole corpus is the sum of the lengths of those before it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.llm.columns import whole_text
from quirespark.llm.shared import bounded_batches, mapped, write_whole
from quirespark.llm.tokenization import encoder, text_bytes


#: Ids of a shard: with the document that reaches so many it is closed, and what a task holds is written.
SHARD_TOKENS = 1 << 24


@dataclass(frozen=True)
class Shard:
    """base: ids in all shards before this one."""

    path: str
    n_docs: int
    n_tokens: int
    base: int


def write_token_files(docs: DataFrame, vocabulary: str, path: str, end_id: int, wide: bool = False, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> list[Shard]:
    """Encodes every text, appends end_id, and writes the ids in ascending document order under `path` (shared storage).

    Returns the manifest, a row per shard. The texts are range-partitioned by id once; a task sorts its range, encodes it in
    blocks and writes a shard whenever it holds shard_tokens ids, and one for the rest: what it holds does not grow with its
    range. Files bear names of the attempt's own, so a task that runs again after an executor was lost leaves no
    half-written file in the manifest.

    Null text is empty: the end id alone. Null ids come first. Rows that repeat an id stay next to each other, ordered
    by text. An empty table gives an empty manifest. Other columns are not read.
    """
    dtype = "<u4" if wide else "<u2"
    bounded_batches(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, names, valid, closed, held = [], [], [], [], 0, 0
        end = np.array([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()

        def shard() -> pa.RecordBatch:
            name = f"{path}/shard-{part:08d}-{closed:06d}-{uuid.uuid4().hex}"
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
            write_whole(f"{name}.ids", np.concatenate(ids).data)
            write_whole(f"{name}.offsets", offsets.data)
            write_whole(f"{name}.docs", np.array(names, "<i8").data)
            write_whole(f"{name}.valid", np.array(valid, "u1").data)
            return pa.RecordBatch.from_pydict({"part": [part], "number": [closed], "path": [name], "n_docs": [len(lengths)], "n_tokens": [int(offsets[-1])]})

        for batch in batches:
            for own, encoded in zip(batch.column(0).to_pylist(), encoder(vocabulary).encode(text_bytes(batch.column(1))), strict=True):
                whole = np.frombuffer(encoded + end, "<u4")
                if not wide and whole.max(initial=0) > 0xFFFF:
                    raise ValueError("an id needs 32 bits: pass wide=True")
                ids.append(whole.astype(dtype))
                lengths.append(len(whole))
                names.append(own or 0)
                valid.append(own is not None)
                held += len(whole)
                if held >= shard_tokens:
                    yield shard()
                    ids, lengths, names, valid, closed, held = [], [], [], [], closed + 1, 0
        if lengths:
            yield shard()

    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    rows = sorted(ordered.mapInArrow(write, "part long, number long, path string, n_docs long, n_tokens long").collect())
    shards, base = [], 0
    for row in rows:
        shards.append(Shard(row.path, row.n_docs, row.n_tokens, base))
        base += row.n_tokens
    return shards


def read_token_files(spark: SparkSession, shards: list[Shard], wide: bool = False) -> DataFrame:
    """One row per document from the files: doc_id, start (ids of all documents before it), n_tokens, ids (binary,
    little-endian unsigned 32-bit). A task maps one shard; an empty manifest gives no rows."""
    dtype = "<u4" if wide else "<u2"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                shard = shards[k]
                ids, offsets, names, valid = (mapped(f"{shard.path}.{kind}", t) for kind, t in (("ids", dtype), ("offsets", "<u8"), ("docs", "<i8"), ("valid", "u1")))
                for at in range(0, shard.n_docs, 2048):
                    cut = offsets[at : at + 2049].astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.asarray(names[at : at + 2048]), pa.int64(), mask=valid[at : at + 2048] == 0),
                            pa.array(cut[:-1] + shard.base, pa.int64()),
                            pa.array(np.diff(cut), pa.int64()),
                            pa.array([ids[a:b].astype("<u4").tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )

    return spark.range(0, len(shards), 1, max(1, len(shards))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")
