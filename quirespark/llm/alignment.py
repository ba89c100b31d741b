"""Alignment of two tokenizers: groups of tokens whose ends meet, and how well linked tokens agree over the whole corpus."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirespark.llm.columns import unused, whole_text
from quirespark.llm.shared import bounded_batches, removed, written
from quirespark.llm.tokenization import text_bytes

#: Labels of a byte: no token ends there, one of A, one of B, both.
NONE, A_END, B_END, BOTH = 0, 1, 2, 3
#: A span up to and with a byte where both end.
SPAN = re.compile(rb"[^\x03]*\x03")
#: Bytes of text that are aligned at a time.
BLOCK_BYTES = 4 << 20
#: Pairs at most whose counts are given to every task: 16 bytes each.
FREQUENT_PAIRS = 1 << 18

#: The splitting pattern of this kind of byte-level vocabulary, as its library applies it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

ALIGNED = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 binary, links binary"


def byte_alphabet() -> dict[str, int]:
    """The letters by which a byte-level vocabulary writes bytes: printable Latin-1 as itself, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """A byte-level vocabulary file of the tokenizers library. Special strings in a text are plain text.

    Where the file is plain byte-level BPE whose ids follow its merges, ids come from the tiktoken library, which merges by
    rank as the tokenizers library does and is faster; a text that it cannot split, and any other file, from the latter."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._library.encode_special_tokens = True
        letters = byte_alphabet()
        vocabulary = self._library.get_vocab(with_added_tokens=True)
        added = {i for i, t in self._library.get_added_tokens_decoder().items()}
        self.entries: list[bytes] = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            known = all(c in letters for c in token)
            self.entries[i] = bytes(letters[c] for c in token) if known and i not in added else token.encode()
        with open(path, encoding="utf-8") as f:
            self._ranks = self._by_rank(json.load(f), added)

    def _by_rank(self, file: dict, added: set[int]):
        """The same vocabulary by rank, or None where merges by rank may differ from the file's own."""
        model, before = file["model"], file.get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not file.get("normalizer")
        if not plain or model.get("type") != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
            return None
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = [model["vocab"].get(a + b, -1) for a, b in merges]
        single = {i for t, i in model["vocab"].items() if len(t) == 1}
        ids = set(model["vocab"].values()) - added
        if made != sorted(set(made)) or -1 in made or len(single) != 256 or single | set(made) != ids:
            return None
        import tiktoken

        return tiktoken.Encoding("by rank", pat_str=PATTERN, mergeable_ranks={self.entries[i]: i for i in ids}, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self._ranks is None:
            return [e.ids for e in self._library.encode_batch_fast(texts, add_special_tokens=False)]
        found = []
        for text in texts:
            try:
                found.append(self._ranks.encode_ordinary(text))
            except Exception:  # its pattern gives up on some very long runs
                found.append(self._library.encode(text, add_special_tokens=False).ids)
        return found


class Pieces:
    """A sentencepiece model; it writes a space before each text and shows spaces as U+2581."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self._library = SentencePieceProcessor(model_file=path)
        own = range(self._library.get_piece_size())
        self.entries = [bytes([int(self._library.id_to_piece(i)[3:5], 16)]) if self._library.is_byte(i) else self._library.id_to_piece(i).replace("▁", " ").encode() for i in own]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._library.encode(texts, num_threads=1)


_LOADED: dict[tuple[str, str], tuple] = {}


def _tokenizers(a: str, b: str) -> tuple:
    """This worker's tokenizers, the lengths of their entries, and their ids as text with what may follow them."""
    if (a, b) not in _LOADED:
        first, second = ByteLevel(a), Pieces(b)
        sizes = [np.array([len(x) for x in t.entries], np.int64) for t in (first, second)]
        shown = [f"{i}{end}" for t, ends in ((first, ",|"), (second, ",;")) for i in range(len(t.entries)) for end in ends]
        _LOADED[a, b] = first, second, *sizes, pa.array([s.encode() for s in shown], pa.large_binary()), 2 * len(first.entries)
    return _LOADED[a, b]


def labels(ends_a: np.ndarray, ends_b: np.ndarray, size: int) -> bytes:
    """A label for each byte of a text, or of many one after another: ends are the places after a token's last byte."""
    found = np.zeros(size, np.uint8)
    found[ends_a - 1] = A_END
    found[ends_b - 1] |= B_END
    return found.tobytes()


def group_sizes(label_string: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of A and of B in each group: the labels within its span, the last of which counts for both."""
    spans = SPAN.findall(label_string)
    inner = (np.fromiter((span.count(label) for span in spans), np.int64, len(spans)) for label in (A_END, B_END))
    return tuple(n + 1 for n in inner)


def _joined(ids: list[list[int]], entries: list[bytes]) -> list[bytes]:
    return [b"".join(map(entries.__getitem__, x)) for x in ids]


def align(texts: list[bytes], a: str, b: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes | None], list[bytes]]:
    """Of each text: its tokens of A, of B, its groups, the sha256 of its groups as text, and the links' id pairs
    (a << 32 | b, 64-bit little-endian). A text without tokens has zeros, None and no links."""
    first, second, size_a, size_b, shown, start_b = _tokenizers(a, b)
    plain = [t.decode("utf-8", "replace") for t in texts]
    whole = [b" " + t for t in texts]
    ids_a, ids_b = first.encode([" " + t for t in plain]), second.encode(plain)
    good = [bool(t) and x == w and y == w for t, w, x, y in zip(texts, whole, _joined(ids_a, first.entries), _joined(ids_b, second.entries), strict=True)]
    n_a, n_b = (np.array([len(x) if g else 0 for x, g in zip(ids, good, strict=True)], np.int64) for ids in (ids_a, ids_b))
    flat_a, flat_b = (np.fromiter((i for x, g in zip(ids, good, strict=True) if g for i in x), np.int64) for ids in (ids_a, ids_b))
    if not len(flat_a):
        return n_a, n_b, n_a, [None] * len(texts), [b""] * len(texts)
    ends_a, ends_b = np.cumsum(size_a[flat_a]), np.cumsum(size_b[flat_b])
    in_a, in_b = group_sizes(labels(ends_a, ends_b, int(ends_a[-1])))
    last_a, last_b = np.cumsum(in_a), np.cumsum(in_b)
    # the groups as text: of each group its ids of A, then those of B, every id with the sign that follows it
    group_a, group_b = np.repeat(np.arange(len(in_a)), in_a), np.repeat(np.arange(len(in_b)), in_b)
    code_a, code_b = 2 * flat_a, start_b + 2 * flat_b
    code_a[last_a - 1] += 1
    code_b[last_b - 1] += 1
    order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
    signs = shown.take(pa.array(np.concatenate([code_a, code_b])[order]))
    text_ends = np.frombuffer(signs.buffers()[1], "<i8", len(signs) + 1)[np.concatenate([[0], np.cumsum(n_a + n_b)])]
    data = memoryview(signs.buffers()[2])
    digests = [hashlib.sha256(data[lo : hi - 1]).digest() if g else None for g, lo, hi in zip(good, text_ends[:-1].tolist(), text_ends[1:].tolist(), strict=True)]
    ends = np.concatenate([[0], np.searchsorted(last_a, np.cumsum(n_a), "right")])  # groups up to each text's end
    links = ((flat_a[last_a - 1] << 32) | flat_b[last_b - 1]).astype("<i8")
    return n_a, n_b, np.diff(ends), digests, [links[lo:hi].tobytes() for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def aligned(docs: DataFrame, a: str, b: str, text_col: str = "text") -> DataFrame:
    """Documents with the columns of ALIGNED, without the text; one pass, no shuffle.

    a: a byte-level vocabulary file, which encodes a space and the text; b: a sentencepiece model that adds the space.
    Every byte gets a label (NONE, A_END, B_END, BOTH), and a regular expression takes the spans up to each BOTH: groups,
    whose labels count their tokens. links: the (A, B) id pair that ends each group, 64 bits each, in order; as no entry is
    empty, one link ends a group. groups_sha256 is over `a1,a2|b1;...`; null without tokens. Null and empty texts, and
    those whose tokens' bytes are not a space and the text, have no tokens: zeros.
    """
    bounded_batches(docs.sparkSession)
    text, made = unused(docs, "whole_text"), unused(docs, "aligned")

    @F.arrow_udf("struct<" + ALIGNED.replace(" ", ":").replace(",:", ",") + ">")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            parts, texts, at = [], text_bytes(column), 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= BLOCK_BYTES):
                    size += len(texts[end])
                    end += 1
                n_a, n_b, n_groups, digests, links = align(texts[at:end], a, b)
                parts.append([pa.array(n_a), pa.array(n_b), pa.array(n_groups), pa.array(n_groups), pa.array(digests, pa.binary()), pa.array(links, pa.binary())])
                at = end
            columns = [pa.concat_arrays(c) for c in zip(*parts, strict=True)] if parts else [pa.array([], t) for t in (*[pa.int64()] * 4, pa.binary(), pa.binary())]
            yield pa.StructArray.from_arrays(columns, names=[c.split()[0] for c in ALIGNED.split(", ")])

    others = [c for c in docs.columns if c != text_col]
    return docs.withColumn(text, whole_text(text_col)).withColumn(made, run(F.col(text))).select(*others, f"{made}.*")


def _pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n): how many links of all documents hold a pair. Each batch sends its different pairs, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, n = np.unique(_flat(batch.column(0))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n.astype(np.int64))], names=["pair", "n"])

    return rows.select("links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _flat(links: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a batch one after another, and how many each row has."""
    sizes = pc.fill_null(pc.binary_length(links), 0).to_numpy(zero_copy_only=False) // 8
    return np.frombuffer(b"".join(x or b"" for x in links.to_pylist()), "<i8"), sizes.astype(np.int64)


def _frequent(pairs: DataFrame, most: int) -> DataFrame:
    """The pairs whose count reaches a bound that at most `most` pairs reach: the bound comes from a histogram of counts,
    eight steps to a power of two."""
    step = F.floor(F.log2("n") * 8).cast("int")
    total, bound = 0, None
    for r in sorted(pairs.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("pairs")).collect(), reverse=True):  # at most 512 rows
        total += r.pairs
        if total > most:
            break
        bound = r.step
    return pairs.filter(step >= bound) if bound is not None else pairs.limit(0)


def agreement(rows: DataFrame, frequent_pairs: int = FREQUENT_PAIRS, row_id: str = "row_id") -> DataFrame:
    """Adds n_best and count_sum to rows (row_id: unique; links as `aligned` gives them), and drops links.

    A pair's count is how many links of all rows hold it. n_best: links whose count is the highest that any pair with their
    B id has, ties included; count_sum: the counts of the row's links, summed. Counts of frequent pairs, a bounded number,
    are broadcast, and rows sum them where they lie; a row's other pairs, each once with how often it has it, meet their
    counts in a shuffled join. A row without links has zeros.
    """
    spark = rows.sparkSession
    counts = written(_pair_counts(rows), "pair-counts")
    b_id = F.col("pair").bitwiseAND(0xFFFFFFFF)
    highest = counts.groupBy(b_id.alias("b_id")).agg(F.max("n").alias("highest"))  # a row per entry of B
    pairs = written(counts.join(highest, b_id == F.col("b_id")).select("pair", "n", (F.col("n") == F.col("highest")).alias("best")), "pairs")
    known = _frequent(pairs, frequent_pairs).toArrow().sort_by("pair")  # at most frequent_pairs rows
    shared = spark.sparkContext.broadcast(tuple(np.asarray(known[c]).astype(np.int64) for c in ("pair", "n", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counted, best = shared.value
        for batch in batches:
            flat, sizes = _flat(batch.column(1))
            row = np.repeat(np.arange(len(sizes)), sizes)
            at = np.minimum(np.searchsorted(names, flat), max(len(names) - 1, 0))
            found = names[at] == flat if len(names) else np.zeros(len(flat), bool)
            sums, bests = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            np.add.at(sums, row[found], counted[at[found]])
            np.add.at(bests, row[found], best[at[found]])
            order = np.lexsort((flat[~found], row[~found]))
            rare, of = flat[~found][order], row[~found][order]
            new = np.ones(len(rare), bool)
            new[1:] = (rare[1:] != rare[:-1]) | (of[1:] != of[:-1])
            starts = np.flatnonzero(new)
            times = np.diff(np.append(starts, len(rare)))
            ends = np.searchsorted(of[starts], np.arange(len(sizes) + 1))
            items = pa.StructArray.from_arrays([pa.array(rare[starts]), pa.array(times.astype(np.int64))], names=["pair", "times"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bests), pa.array(sums), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), items)], names=["row_id", "n_best", "count_sum", "rare"])

    summed = written(rows.select(F.col(row_id).alias("row_id"), "links").mapInArrow(run, "row_id long, n_best long, count_sum long, rare array<struct<pair:long,times:long>>"), "frequent-links")
    rare = summed.select("row_id", F.explode("rare").alias("x")).select("row_id", "x.*").join(pairs, "pair").groupBy("row_id").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("best"), F.sum(F.col("n") * F.col("times")).alias("counts"))
    told = written(summed.select("row_id", "n_best", "count_sum").join(rare, "row_id", "left").select(F.col("row_id").alias(row_id), (F.col("n_best") + F.coalesce("best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("counts", F.lit(0))).alias("count_sum")), "agreement")
    removed(counts, pairs, summed)
    return rows.drop("links").join(told, row_id)


def cross_aligned(docs: DataFrame, a: str, b: str, text_col: str = "text", frequent_pairs: int = FREQUENT_PAIRS) -> DataFrame:
    """Documents without their text, with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 (hex, '' without
    tokens); see aligned and agreement.

    Texts are tokenized once and the rows written. Null, empty and repeated texts, null or repeated ids are rows like any
    others; other columns are kept but for those of these names, which are replaced. An empty table gives an empty one.
    """
    made = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "links")
    kept = docs.select(*(c for c in docs.columns if c.lower() not in made))
    name = unused(kept, "row_id")
    rows = written(aligned(kept, a, b, text_col).withColumn(name, F.monotonically_increasing_id()), "aligned")
    return agreement(rows, frequent_pairs, name).withColumn("groups_sha256", F.coalesce(F.lower(F.hex("groups_sha256")), F.lit(""))).drop(name)
