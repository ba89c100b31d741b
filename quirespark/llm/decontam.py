"""Benchmark decontamination: a prefix-filtered join of document words with item-sized windows."""

from __future__ import annotations

import pickle
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirespark.llm.columns import whole_text
from quirespark.llm.shared import bounded_batches, local_path, mapped, new_dir, write_whole, written
from quirespark.llm.tokenization import text_bytes

WINDOW = 8
#: Bytes of item text in one block of the index: what a worker holds at a time, whatever the benchmark's size.
BLOCK_BYTES = 16 << 20
#: Words that a task counts at a time, about.
COUNTED_WORDS = 1 << 20

#: The word class of the contract: digits, a-z (A-Z in lower case) and everything that is not ASCII.
_FOLD = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else c + 32 if 65 <= c < 91 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def windows(text: bytes, size: int = WINDOW) -> set[tuple[bytes, ...]]:
    """An item's windows of `size` words; all of its words where there are fewer; none without words."""
    w = words(text)
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


#: word -> (its place in a window, the window's words) -> window -> items
Index = dict[bytes, dict[tuple[int, int], dict[tuple[bytes, ...], tuple[str, ...]]]]


def prefix_index(items: list[tuple[str, bytes]], seen: dict[bytes, int], size: int = WINDOW) -> Index:
    """Each window under its rarest word in the corpus (ties: the smaller word). A text that contains the window contains
    that word, so one prefix token is enough; its place in the window and the window's length bound where the window can
    lie, so an occurrence of the word asks once for each such pair, however many windows share the word."""
    owners: dict[tuple[bytes, ...], set[str]] = {}
    for item, text in items:
        for w in windows(text, size):
            owners.setdefault(w, set()).add(item)
    index: Index = {}
    for w in sorted(owners):
        rarest = min(set(w), key=lambda x: (seen.get(x, 0), x))
        if seen.get(rarest, 0):  # else no text has it
            index.setdefault(rarest, {}).setdefault((w.index(rarest), len(w)), {})[w] = tuple(sorted(owners[w]))
    return index


def occurrences(text_words: list[bytes], index: Index) -> list[tuple[int, int, tuple[str, ...]]]:
    """(first word, end, items) of every window that occurs."""
    found, n = [], len(text_words)
    for i, word in enumerate(text_words):
        if word in index:
            for (offset, length), own in index[word].items():
                a = i - offset
                b = a + length
                if a >= 0 and b <= n and (items := own.get(tuple(text_words[a:b]))):
                    found.append((a, b, items))
    return found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


@lru_cache(maxsize=1)
def _loaded(uri: str):
    if local_path(uri) is not None:
        with open(local_path(uri), "rb") as f:
            return pickle.load(f)
    return pickle.loads(mapped(uri, "u1").tobytes())


def build_index(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> list[str]:
    """Files in shared storage, each the prefix index of a block of items.

    Items are dealt to blocks of about `block_bytes` by hash, words are ordered by how often they occur in all of `docs`
    (one pass, which counts the benchmark's words only), and each block's index is built and written by a task; the driver
    gets the files' names alone. Files have names of their own attempt, so tasks may run again.

    Null ids and null texts of items are left out, repeated rows count once, items that repeat an id are one item; null
    texts of documents have no words. Ties in rarity go to the smaller word. Without items, or where no word of a block
    occurs in `docs` (an empty table), there is no file, and nothing is hit.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    at = new_dir(spark, "benchmark-index")
    item, text = F.col(item_col).cast("string").alias("i"), F.col(item_text_col).cast("string").alias("t")
    rows = written(benchmark.select(item, text).filter("i is not null and t is not null").distinct(), "benchmark-items")
    n_blocks = -(-(rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // block_bytes)
    if not n_blocks:
        return []

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
        """The other columns of rows in order of block, a block at a time."""
        block, held = None, []
        for batch in batches:
            for own, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != block and held:
                    yield block, held
                    held = []
                block = own
                held.append(tuple(row))
        if held:
            yield block, held

    def file(kind: str, block: int, data) -> pa.RecordBatch:
        write_whole(uri := f"{at}/{kind}-{block:06d}-{uuid.uuid4().hex}", pickle.dumps(data))
        return pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "uri": [uri]})

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, items in each(batches):
            yield file("items", block, [(i, t.encode()) for i, t in items])

    def dealt(rows: DataFrame) -> DataFrame:
        n = min(n_blocks, int(spark.conf.get("spark.sql.shuffle.partitions")))
        return rows.repartition(n, "block").sortWithinPartitions("block")

    of_block = F.pmod(F.xxhash64("i", "t"), F.lit(n_blocks)).cast("int").alias("block")
    blocks = {r.block: r.uri for r in dealt(rows.select(of_block, "i", "t")).mapInArrow(save, "block int, uri string").collect()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Counter] = {k: Counter() for k in blocks}
        vocabulary, loaded = None, None

        def out() -> Iterator[pa.RecordBatch]:
            for k, c in seen.items():
                yield pa.RecordBatch.from_pydict({"block": pa.array([k] * len(c), pa.int32()), "word": pa.array(list(c), pa.binary()), "n": pa.array(list(c.values()), pa.int64())})
                c.clear()

        for batch in batches:
            texts = [words(t) for t in text_bytes(batch.column(0))]
            for k, uri in blocks.items():
                if loaded != k:
                    vocabulary, loaded = {w for _, t in _loaded(uri) for w in words(t)}, k
                for t in texts:
                    seen[k].update(filter(vocabulary.__contains__, t))
            if sum(map(len, seen.values())) > COUNTED_WORDS:
                yield from out()
        yield from out()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, counts in each(batches):
            yield file("index", block, prefix_index(_loaded(blocks[block]), {bytes(w): n for w, n in counts}, size))

    counts = docs.select(whole_text(text_col).alias("text")).mapInArrow(count, "block int, word binary, n long").groupBy("block", "word").agg(F.sum("n").alias("n"))
    built = dealt(counts).mapInArrow(build, "block int, uri string").collect()
    return [r.uri for r in sorted(built, key=lambda r: r.block)]


HITS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("end", T.IntegerType())])))])


def marked(docs: DataFrame, index: list[str], text_col: str = "text", hits: str = "hits") -> DataFrame:
    """Adds to every row what of the benchmark its text holds: a struct of n_words, n_hit (words inside any occurrence of
    a window), items (ids as strings, sorted) and spans (first word, end; merged).

    Documents are not shuffled, and a block of the index at a time is matched with a batch of them. Null and empty texts
    have no words and no hits; items without an id, a text or words match nothing; items that repeat an id are one item;
    repeated documents are each marked. An empty table stays empty. A column named as `hits` is replaced, others stay.
    """
    kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())])))])

    @F.arrow_udf(HITS)
    def mark(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            texts = [words(t) for t in text_bytes(column)]
            spans: list[list] = [[] for _ in texts]
            items: list[set] = [set() for _ in texts]
            for uri in index:
                block = _loaded(uri)
                for k, t in enumerate(texts):
                    for a, b, names in occurrences(t, block):
                        spans[k].append((a, b))
                        items[k].update(names)
            flat = [merged(s) for s in spans]
            yield pa.array([{"n_words": len(t), "n_hit": sum(b - a for a, b in f), "items": sorted(i), "spans": [{"first": a, "end": b} for a, b in f]} for t, f, i in zip(texts, flat, items, strict=True)], kind)

    bounded_batches(docs.sparkSession)
    return docs.withColumn(hits, mark(whole_text(text_col)))
