"""Language-model scores from a log-frequency Bloom filter of n-gram counts."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirespark.llm.columns import whole_text
from quirespark.llm.shared import bounded_batches, mapped, new_dir, write_whole, written
from quirespark.llm.tokenization import text_bytes

#: The filter is cut into segments by the first bits of an n-gram's hash. It grows with the entries.
SEGMENT_BITS = 12
SEGMENTS = 1 << SEGMENT_BITS
#: A filter of up to so many bytes is mapped into workers' memory. A larger one stays a table, to whose segments the probes go.
MAPPED_BYTES = 1 << 27
BITS_PER_ENTRY, PROBES = 10, 4
#: Counts are kept as 1 + floor(log(count) / log(BASE)).
BASE, MAX_LEVEL = 1.5, 64
#: Words whose exact counts are broadcast at most; the exact counts of all others are joined.
HEAD_WORDS = 1 << 18
#: Words that a task or a worker remembers at most; then it starts anew.
MEMO_WORDS = 500_000
#: N-grams that a task counts at a time.
CHUNK = 2 << 20
#: Tokens of a block of texts that asks a filter which is not mapped.
BLOCK = 1 << 20
#: N-grams that are probed at a time, so that what is computed for them stays in the CPU's cache.
RUN = 1 << 14
#: Candidate weights of the unigram distribution.
WEIGHTS = (1.0, 10.0, 100.0, 1000.0, 10000.0)

#: The end of a text as a word; no word holds white space.
END = b"\n"
_START = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return x ^ (x >> np.uint64(33))


word_hash = xxhash.xxh64_intdigest


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(left * np.uint64(0xD6E8FEB86659FD93) + right)


def split_hash(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segment, and the identity of an n-gram within it."""
    return (h >> np.uint64(64 - SEGMENT_BITS)).astype(np.int64), ((h >> np.uint64(32 - SEGMENT_BITS)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def quantised(counts: np.ndarray) -> np.ndarray:
    return np.minimum(1 + np.floor(np.log(counts) / math.log(BASE) + 1e-9).astype(np.int64), MAX_LEVEL)


def _levels() -> np.ndarray:
    """The mean of the counts of each level; 0 for level 0."""
    edges = [math.ceil(BASE**q - 1e-9) for q in range(MAX_LEVEL + 1)]
    return np.array([0.0] + [(a + max(a, b - 1)) / 2 for a, b in zip(edges, edges[1:], strict=False)])


LEVELS = _levels()


def _positions(identity: np.ndarray, level: int, bits: np.ndarray) -> Iterator[np.ndarray]:
    """Places below `bits`, which is less than 2^32 and need not be a power of two."""
    with np.errstate(over="ignore"):
        x = _mix(identity.astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + np.uint64(level))
        low, step = x & np.uint64(0xFFFFFFFF), (x >> np.uint64(32)) | np.uint64(1)
        for i in range(PROBES):
            yield ((((low + np.uint64(i) * step) & np.uint64(0xFFFFFFFF)) * bits) >> np.uint64(32)).astype(np.int64)


def segment_bits(identity: np.ndarray, counts: np.ndarray) -> bytes:
    """A segment's bits: an n-gram of level q is entered with each of 1 to q. There are BITS_PER_ENTRY for each entry, so
    the false-positive rate is the same at any size."""
    levels = quantised(counts)
    bits = max(64, (int(levels.sum()) * BITS_PER_ENTRY + 7) // 8 * 8)
    found = np.zeros(bits, np.uint8)
    for q in range(1, int(levels.max(initial=0)) + 1):
        for at in _positions(identity[levels >= q], q, np.uint64(bits)):
            found[at] = 1
    return np.packbits(found, bitorder="little").tobytes()


def probed(data: np.ndarray, identity: np.ndarray, first: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Levels by repeated probes of the segments that begin at byte `first` of the data: the last level that is present
    with all before it."""
    level = np.zeros(len(identity), np.uint8)
    for k in range(0, len(identity), RUN):
        run = slice(k, k + RUN)
        own, left = (identity[run], first[run], bits[run]), np.arange(k, min(k + RUN, len(identity)))
        for q in range(1, MAX_LEVEL + 1):
            there = np.ones(len(left), bool)
            for i, at in enumerate(_positions(own[0], q, own[2])):
                there &= ((data[own[1] + (at >> 3)] >> (at & 7).astype(np.uint8)) & 1).astype(bool)
                if i < PROBES - 1 and not there.any():
                    break
            own, left = tuple(c[there] for c in own), left[there]
            level[left] = q
            if not len(left):
                break
    return level


@dataclass
class Filter:
    """All segments one after another, a file in shared storage that workers map into memory: its place, and the first
    byte and the bits of each segment. The workers of a machine share the mapped pages."""

    uri: str
    first: np.ndarray
    bits: np.ndarray
    _data: np.ndarray | None = None

    @staticmethod
    def of(segments: dict[int, bytes], uri: str) -> Filter:
        size = np.array([len(segments.get(k, b"\0")) for k in range(SEGMENTS)], np.int64)
        write_whole(uri, b"".join(segments.get(k, b"\0") for k in range(SEGMENTS)))
        return Filter(uri, np.concatenate([[0], np.cumsum(size)[:-1]]), (size * 8).astype(np.uint64))

    def __getstate__(self):
        return self.__dict__ | {"_data": None}

    @property
    def data(self) -> np.ndarray:
        if self._data is None:
            self._data = mapped(self.uri, "u1")
        return self._data

    def levels(self, h: np.ndarray) -> np.ndarray:
        """Levels of the counts. Sorted hashes probe one segment after another."""
        segment, identity = split_hash(h)
        return probed(self.data, identity, self.first[segment], self.bits[segment])

    def counts(self, h: np.ndarray) -> np.ndarray:
        """Approximate counts."""
        return LEVELS[self.levels(h)]


@dataclass(frozen=True)
class Model:
    """words: all exact counts, as a table (word, n). head: the counts of the most frequent words, broadcast.
    filter: None where it is not mapped but stays a table; segments: that table (segment, bits)."""

    words: DataFrame
    filter: Filter | None
    segments: DataFrame
    head: object
    train_tokens: int
    distinct: int
    documents: int
    weight: float = 100.0


def _blobs(words: Counter, pairs: np.ndarray) -> pa.RecordBatch:
    """What a task counted, a row per segment: n-gram identities with counts of up to 255 each, and words with counts."""
    h, n = np.unique(pairs, return_counts=True)
    times = (n + 254) // 255
    part = np.full(int(times.sum()), 255, np.uint8)
    part[np.cumsum(times) - 1] = n - 255 * (times - 1)
    segment, identity = split_hash(np.repeat(h, times))
    cut = np.searchsorted(segment, np.arange(SEGMENTS + 1))
    names = list(words)
    own = np.fromiter((word_hash(w) >> (64 - SEGMENT_BITS) for w in names), np.int64, len(names))
    order = np.argsort(own, kind="stable")
    bounds = np.searchsorted(own[order], np.arange(SEGMENTS + 1))
    counts = np.fromiter(words.values(), "<i8", len(names))[order]
    names = [names[i] for i in order.tolist()]
    rows = [k for k in range(SEGMENTS) if cut[k + 1] > cut[k] or bounds[k + 1] > bounds[k]]
    return pa.RecordBatch.from_pydict(
        {
            "segment": pa.array(rows, pa.int32()),
            "grams": pa.array([identity[cut[k] : cut[k + 1]].astype("<u4").tobytes() for k in rows], pa.binary()),
            "times": pa.array([part[cut[k] : cut[k + 1]].tobytes() for k in rows], pa.binary()),
            "words": pa.array([b" ".join(names[bounds[k] : bounds[k + 1]]) for k in rows], pa.binary()),
            "counts": pa.array([counts[bounds[k] : bounds[k + 1]].tobytes() for k in rows], pa.binary()),
        }
    )


def train(docs: DataFrame, text_col: str = "text", head_words: int = HEAD_WORDS, mapped_bytes: int = MAPPED_BYTES) -> Model:
    """Counts the words and word pairs of all of `docs` and builds the filter.

    Each task counts its rows and sends one blob per segment; a segment's blobs meet in one task, which writes the exact
    word counts and the segment's bits. So one shuffle carries all counts, pre-aggregated, and a frequent word or pair is
    one entry per task. Words are counted exactly; pairs by 44 bits of a hash. The head is
    broadcast. The filter grows with the distinct n-grams at a fixed false-positive rate: up to `mapped_bytes` it is given to
    workers as a mapped file, past that it stays a table and no process holds more of it than a segment at a time.
    """
    spark = docs.sparkSession
    bounded_batches(spark)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        pairs, held = [], 0
        end = np.uint64(word_hash(END))
        for batch in batches:
            for text in text_bytes(batch.column(0)):
                w = text.lower().split()
                words.update(w)
                words[END] += 1
                h = np.fromiter(map(word_hash, w), np.uint64, len(w))
                pairs.append(pair_hash(np.concatenate([[_START], h]), np.concatenate([h, [end]])))
                held += len(w) + 1
                if held >= CHUNK:
                    yield _blobs(words, np.concatenate(pairs))
                    words, pairs, held = Counter(), [], 0
        if held:
            yield _blobs(words, np.concatenate(pairs))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, grams, times, words, held = -1, [], [], Counter(), 0

        def compact() -> None:
            nonlocal grams, times, held
            identity, back = np.unique(np.concatenate(grams), return_inverse=True)
            grams, times, held = [identity], [np.bincount(back, np.concatenate(times), len(identity))], 0

        def out() -> Iterator[pa.RecordBatch]:
            compact()
            own = np.fromiter(map(word_hash, words), np.uint64, len(words))
            identity = np.concatenate([grams[0], split_hash(own)[1]])
            counts = np.concatenate([times[0], np.fromiter(words.values(), np.float64, len(words))])
            bits = segment_bits(identity, counts)
            yield pa.RecordBatch.from_pydict({"segment": pa.array([at], pa.int32()), "bits": pa.array([bits], pa.binary()), "word": pa.array([None], pa.binary()), "n": pa.array([None], pa.int64())})
            yield pa.RecordBatch.from_pydict({"segment": pa.array([None] * len(words), pa.int32()), "bits": pa.array([None] * len(words), pa.binary()), "word": pa.array(list(words), pa.binary()), "n": pa.array(list(words.values()), pa.int64())})

        for batch in batches:
            for segment, g, t, w, c in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if segment != at:
                    if at >= 0:
                        yield from out()
                    at, grams, times, words, held = segment, [], [], Counter(), 0
                grams.append(np.frombuffer(g, "<u4"))
                times.append(np.frombuffer(t, np.uint8))
                held += len(t)
                if w:
                    for x, n in zip(w.split(b" "), np.frombuffer(c, "<i8").tolist(), strict=True):
                        words[x] += n
                if held > CHUNK:
                    compact()
        if at >= 0:
            yield from out()

    blobs = docs.select(whole_text(text_col).alias("text")).mapInArrow(count, "segment int, grams binary, times binary, words binary, counts binary")
    parts = written(blobs.repartition("segment").sortWithinPartitions("segment").mapInArrow(merge, "segment int, bits binary, word binary, n long"), "lm-counts")
    words = parts.filter("word is not null").select("word", "n")
    step = F.floor(F.log2("n") * 8)
    sizes = {r.step: (r.types, r.tokens) for r in words.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("types"), F.sum("n").alias("tokens")).collect()}
    room, least = head_words, None
    for s in sorted(sizes, reverse=True):
        room -= sizes[s][0]
        if room < 0:
            break
        least = s
    head = words.filter(step >= least).toArrow().combine_chunks() if least is not None else None
    top = (b" ".join(head["word"].to_pylist()), np.asarray(head["n"], np.int64)) if head is not None and head.num_rows else (b"", np.empty(0, np.int64))
    ends = words.filter(F.col("word") == F.lit(END)).first()
    segments = parts.filter("bits is not null").select("segment", "bits")
    size = segments.agg(F.sum(F.octet_length("bits").cast("long"))).first()[0] or 0
    found = Filter.of({r.segment: bytes(r.bits) for r in segments.toLocalIterator()}, new_dir(spark, "lm-filter") + "/bits") if size <= mapped_bytes else None
    sc = spark.sparkContext
    return Model(words, found, segments, sc.broadcast(top), sum(x[1] for x in sizes.values()), sum(x[0] for x in sizes.values()), ends.n if ends else 0)


def log_probability(pair, context, word, weight: float, n: int, v: int, held: float = 0.0) -> np.ndarray:
    """log10 of (count(v w) + weight * P(w)) / (count(v) + weight), P(w) = (count(w) + 1) / (N + V + 1). held: what to
    take from the counts, to try a text that was counted as if it had not been."""
    unigram = (np.maximum(word - held, 0) + 1) / (n + v + 1)
    return np.log10((np.maximum(pair - held, 0) + weight * unigram) / (np.maximum(context - held, 0) + weight))


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)[:-1]])


def _pairs(h: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The hash of each token with what stands before it."""
    before = np.concatenate([[_START], h[:-1]])
    before[_starts(lengths)] = _START
    return pair_hash(before, h)


@lru_cache(maxsize=2)
def _tables(weights: tuple, n: int, v: int, documents: int, held: float) -> list[np.ndarray]:
    """For each weight the log10 probabilities by the levels of context, pair and word, as _codes numbers them. A pair is
    not more frequent than its context; the last context is the start of a text."""
    context = np.append(LEVELS, documents)[:, None, None]
    pair = np.minimum(LEVELS[None, :, None], context)
    return [log_probability(pair, context, LEVELS[None, None, :], w, n, v, held).ravel() for w in weights]


def _codes(pair: np.ndarray, word: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Where the tables have each token, by the levels of its pair, of what stands before it, and of itself."""
    context = np.concatenate([[0], word[:-1]]).astype(np.int32)
    context[_starts(lengths)] = len(LEVELS)
    return (context * len(LEVELS) + pair) * len(LEVELS) + word


class Scorer:
    """A worker's side of a model: what it has found out about the words it met."""

    def __init__(self, model_filter: Filter | None, head: tuple[bytes, np.ndarray]):
        self.filter = model_filter
        self.head = dict(zip(head[0].split(b" "), head[1].tolist(), strict=True)) if head[0] else {}
        self.at: dict[bytes, int] = {}
        self.columns = (np.empty(0, np.uint64), np.empty(0, np.uint8), np.empty(0, np.int64))

    def indexed(self, new: set[bytes]) -> None:
        """Hash, level (0 if the filter is not mapped) and exact count (-1: not in the head) of words not met before."""
        names = list(new)
        h = np.fromiter(map(word_hash, names), np.uint64, len(names))
        exact = np.fromiter((self.head.get(w, -1) for w in names), np.int64, len(names))
        self.at.update(zip(names, range(len(self.at), len(self.at) + len(names)), strict=True))
        level = self.filter.levels(h) if self.filter else np.zeros(len(h), np.uint8)
        self.columns = tuple(np.concatenate([a, b]) for a, b in zip(self.columns, (h, level, exact), strict=True))

    def tokens(self, texts: list[bytes]):
        """Of all tokens of some texts, ends included: words, text, exact count or -1, hash, level; and the number of each
        text's tokens."""
        split = [[*t.lower().split(), END] for t in texts]
        new = set().union(*split).difference(self.at)
        if len(self.at) + len(new) > MEMO_WORDS:
            self.at, self.columns = {}, tuple(c[:0] for c in self.columns)
            new = set().union(*split)
        if new:
            self.indexed(new)
        flat = [w for s in split for w in s]
        where = np.fromiter(map(self.at.__getitem__, flat), np.int64, len(flat))
        lengths = np.array([len(s) for s in split], np.int64)
        h, level, exact = (c[where] for c in self.columns)
        return flat, np.repeat(np.arange(len(texts)), lengths), exact, h, level, lengths

    def codes(self, h: np.ndarray, word: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Where the tables have some tokens, by the mapped filter."""
        pairs, back = np.unique(_pairs(h, lengths), return_inverse=True)
        return _codes(self.filter.levels(pairs)[back], word, lengths)


_SCORERS: dict[str, Scorer] = {}


def _scorer(key: str, model_filter, head) -> Scorer:
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(model_filter, head.value)
    return _SCORERS[key]


def _texts(batch: pa.RecordBatch, column: int, size: int = 2 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of a batch's texts of about `size` bytes: the first row, the texts."""
    rows, held, at = [], 0, 0
    for k, text in enumerate(text_bytes(batch.column(column))):
        rows.append(text)
        held += len(text)
        if held >= size:
            yield at, rows
            rows, held, at = [], 0, k + 1
    if rows:
        yield at, rows


def _likelihoods(codes: np.ndarray, lengths: np.ndarray, training: np.ndarray, weights: tuple, tried: bool, n: int, v: int, documents: int) -> tuple[list[np.ndarray], list[float]]:
    """The scores of some texts for each weight; and if `tried`, what each weight gives to those of them that were trained
    on, each token as if not counted."""
    text = np.repeat(np.arange(len(lengths)), lengths)
    found = [np.bincount(text, t[codes], len(lengths)).astype(np.float64) for t in _tables(weights, n, v, documents, 0.0)]
    if not tried:
        return found, []
    times = np.bincount(codes[np.repeat(training, lengths)])
    there = np.flatnonzero(times)
    return found, [float((times[there] * t[there]).sum()) for t in _tables(weights, n, v, documents, 1.0)]


def _asked(h: np.ndarray, lengths: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a block asks for: the hashes of its distinct pairs, then of its words, in ascending order; their order; and
    where each token's pair stands before ordering. words: ascending."""
    pairs, back = np.unique(_pairs(h, lengths), return_inverse=True)
    both = np.concatenate([pairs, words])
    order = np.argsort(both, kind="stable")
    return both[order], order, back


def _planned(h: np.ndarray) -> bytes:
    """A block's token hashes: the distinct ones, frequent ones first, and the place of each token's there, the lowest
    bytes of all, then the next, so that they compress well."""
    words, where, times = np.unique(h, return_inverse=True, return_counts=True)
    order = np.argsort(-times, kind="stable")
    place = np.empty(len(words), "<u4")
    place[order] = np.arange(len(words))
    return b"".join([len(words).to_bytes(8, "little"), words[order].astype("<u8").tobytes(), place[where].view("u1").reshape(-1, 4).T.tobytes()])


def _unplanned(plan: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of a block, and the place of each token's there."""
    k = int.from_bytes(plan[:8], "little")
    planes = np.frombuffer(plan, "u1", offset=8 + 8 * k).reshape(4, -1)
    return np.frombuffer(plan, "<u8", k, 8), np.ascontiguousarray(planes.T).view("<u4").ravel()


def _answered(model: Model, asked: DataFrame, plans: str, schema: str, shares, weights: tuple, tried: bool) -> DataFrame:
    """The rows of _found by a filter that stays a table. Each block of texts asks each segment for its distinct n-grams
    there (block, segment, data); the segment's levels go back to the block, whose tokens and rows lie in a file of the
    folder `plans`. A block's name tells its contents, so that a task that runs again writes and asks the same."""
    n, v, documents = model.train_tokens, model.distinct, model.documents
    names = [c.split()[0] for c in schema.split(", ")]

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, bits = -1, np.zeros(8, "u1")
        for batch in batches:
            data, size, rows = [bits], len(bits), []
            for k, (segment, block) in enumerate(zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True)):
                if block is None or segment != at:  # another segment; if it has no row, no n-gram of the training texts is there
                    at, bits = segment, np.frombuffer(batch.column(2)[k].as_py(), "u1") if block is None else np.zeros(8, "u1")
                    data.append(bits)
                    size += len(bits)
                if block is not None:
                    rows.append((k, size - len(bits), 8 * len(bits)))
            if not rows:
                continue
            k, first, own = (np.array(x, np.int64) for x in zip(*rows, strict=True))
            asks = batch.column(2).take(pa.array(k))
            ids = [np.frombuffer(x, "<u4") for x in asks.to_pylist()]
            length = np.array([len(x) for x in ids], np.int64)
            levels = probed(np.concatenate(data), np.concatenate(ids), np.repeat(first, length), np.repeat(own.astype(np.uint64), length))
            ends = np.concatenate([[0], np.cumsum(length)]).astype("<i4")
            back = pa.Array.from_buffers(pa.binary(), len(k), [None, pa.py_buffer(ends), pa.py_buffer(levels)])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(k)), batch.column(1).take(pa.array(k)), back], names=["block", "segment", "data"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, levels = None, []

        def out() -> Iterator[pa.RecordBatch]:
            plan, *tables = pa.ipc.open_stream(pa.py_buffer(mapped(f"{plans}/{at:x}", "u1")))
            words, where = _unplanned(plan.column("data")[0].as_py())
            own = [t for t in tables if t.column("n_tokens").null_count == 0]
            lengths = np.concatenate([t.column("n_tokens").to_numpy() for t in own])
            training = np.concatenate([np.array([x is False for x in t.column("held_out").to_pylist()], bool) for t in own])
            ascending = np.argsort(words)
            asks, order, back = _asked(words[where], lengths, words[ascending])
            given = np.concatenate(levels)
            if len(given) != len(asks):
                raise ValueError(f"block {at:x} asked for {len(asks)} n-grams and got {len(given)}")
            level = np.empty(len(asks), np.uint8)
            level[order] = given
            word = np.empty(len(words), np.uint8)
            word[ascending] = level[len(level) - len(words) :]
            scores, sums = _likelihoods(_codes(level[back], word[where], lengths), lengths, training, weights, tried, n, v, documents)
            done = 0
            for t in tables:
                columns = {c: t.column(c) for c in names}
                if t.column("n_tokens").null_count == 0:
                    columns |= {f"s{i}": pa.array(s[done : done + t.num_rows]) for i, s in enumerate(scores)}
                    done += t.num_rows
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)
            if tried:
                yield shares(own[0].column("row")[0].as_py(), sums)

        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if block != at:
                    if at is not None:
                        yield from out()
                    at, levels = block, []
                levels.append(np.frombuffer(data, "u1"))
        if at is not None:
            yield from out()

    met = asked.unionByName(model.segments.select(F.lit(None).cast("long").alias("block"), "segment", F.col("bits").alias("data")))
    answers = met.repartition("segment").sortWithinPartitions("segment", F.col("block").asc_nulls_first()).mapInArrow(answer, "block long, segment int, data binary")
    return answers.repartition("block").sortWithinPartitions("block", "segment").select("block", "data").mapInArrow(finish, schema)


def _found(docs: DataFrame, model: Model, held_out: Column, weights: tuple, tried: bool, id_col: str, text_col: str) -> DataFrame:
    """Rows of three kinds: one per document, with s0, s1... for the weights; one per document and word whose exact count
    is not in the head (key, times); and if `tried`, rows -1 - k with shares of the likelihood of weight k in s0."""
    model_filter, head, n, v, documents = model.filter, model.head, model.train_tokens, model.distinct, model.documents
    scores = [f"s{i}" for i in range(len(weights))]
    schema = "row long, key binary, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, times long, " + ", ".join(f"{s} double" for s in scores)
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}
    types = {c.split()[0]: kinds[c.split()[1]] for c in schema.split(", ")}
    plans = new_dir(docs.sparkSession, "lm-plans") if model_filter is None else ""
    scorer_key = model_filter.uri if model_filter else plans

    def table(rows: int, **columns) -> pa.RecordBatch:
        own = {k: c if isinstance(c, pa.Array) else pa.array(c, types[k]) for k, c in columns.items()}
        return pa.RecordBatch.from_arrays([own[k] if k in own else pa.nulls(rows, types[k]) for k in names], names=names)

    def shares(row: int, sums: list[float]) -> pa.RecordBatch:
        return table(len(sums), row=[-1 - i for i in range(len(sums))], key=[b" %d %d" % (row, i) for i in range(len(sums))], s0=sums)

    def asks(row: int, hashes: list[np.ndarray], lengths: list[np.ndarray], tables: list[pa.RecordBatch]) -> pa.RecordBatch:
        """Writes a block that begins at a row to its file, and gives what it asks for."""
        h = np.concatenate(hashes)
        plan = _planned(h)
        asked = _asked(h, np.concatenate(lengths), np.unique(h))[0]
        block = xxhash.xxh64_intdigest(plan, seed=row) >> 1
        whole = pa.schema([*((c, types[c]) for c in names), ("data", pa.binary())])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, whole, options=pa.ipc.IpcWriteOptions(compression="zstd")) as file:
            for t, data in ((table(1), plan), *((t, None) for t in tables)):
                file.write_batch(pa.RecordBatch.from_arrays([*t.columns, pa.array([data] * t.num_rows, pa.binary())], schema=whole))
        write_whole(f"{plans}/{block:x}", sink.getvalue())
        segment, identity = split_hash(asked)
        there, cut = np.unique(segment, return_index=True)
        ends = np.append(cut, len(asked)).astype("<i4") * 4
        data = pa.Array.from_buffers(pa.binary(), len(there), [None, pa.py_buffer(ends), pa.py_buffer(identity.astype("<u4"))])
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(there), block, np.int64)), pa.array(there.astype(np.int32)), data], names=["block", "segment", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = first = TaskContext.get().partitionId() << 36
        hashes, counted, tables = [], [], []
        for batch in batches:
            scorer = _scorer(scorer_key, model_filter, head)
            for at, texts in _texts(batch, 2):
                words, text, exact, h, level, lengths = scorer.tokens(texts)
                k, known = len(texts), exact >= 0
                base = np.bincount(text[known], np.log10((exact[known] + 1) / (n + v + 1)), k).astype(np.float64)
                rows = np.arange(row, row + k)
                own = {"row": rows, "key": [b" %d" % r for r in rows.tolist()], "doc_id": batch.column(0).slice(at, k), "held_out": batch.column(1).slice(at, k)}
                own |= {"n_tokens": lengths, "n_known": np.bincount(text[known], minlength=k).astype(np.int64), "base_score": base}
                rest = Counter((t, words[i]) for t, i in zip(text[~known].tolist(), np.flatnonzero(~known).tolist(), strict=True))
                others = [table(len(rest), row=[row + t for t, _ in rest], key=[w for _, w in rest], times=list(rest.values()))] if rest else []
                if model_filter is not None:
                    training = np.array([x is False for x in own["held_out"].to_pylist()], bool)
                    value, sums = _likelihoods(scorer.codes(h, level, lengths), lengths, training, weights, tried, n, v, documents)
                    yield table(k, **own, **dict(zip(scores, value, strict=True)))
                    yield from others
                    if tried:
                        yield shares(row, sums)
                else:
                    hashes.append(h)
                    counted.append(lengths)
                    tables += [table(k, **own), *others]
                row += k
                if sum(map(len, hashes)) >= BLOCK:
                    yield asks(first, hashes, counted, tables)
                    first, hashes, counted, tables = row, [], [], []
        if hashes:
            yield asks(first, hashes, counted, tables)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), whole_text(text_col).alias("text"))
    if model_filter is not None:
        return texts.mapInArrow(run, schema)
    return _answered(model, texts.mapInArrow(run, "block long, segment int, data binary"), plans, schema, shares, weights, tried)


def _likeliest(sums: list, weights: tuple) -> int | None:
    """The place of the weight that has the largest sum (ties: the smallest weight)."""
    found = {-1 - r.row: r.s0 for r in sums}
    return max(found, key=lambda k: (round(found[k], 3), -weights[k])) if found else None


def weighed(model: Model, docs: DataFrame, text_col: str = "text") -> Model:
    """The model with the unigram weight that makes all of the training texts likeliest, each token as if not counted."""
    texts = docs.select(F.col(text_col).alias("text"), F.lit(None).cast("long").alias("doc_id"))
    sums = _found(texts, model, F.lit(False), WEIGHTS, True, "doc_id", "text").filter("row < 0").groupBy("row").agg(F.sum("s0").alias("s0")).collect()
    best = _likeliest(sums, WEIGHTS)
    return replace(model, weight=WEIGHTS[best]) if best is not None else model


def scored(docs: DataFrame, model: Model, held_out: Column, id_col: str = "doc_id", text_col: str = "text", weights: tuple[float, ...] | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens: white-space-separated words with A-Z in lower case, then one end. base_score: the add-one unigram log10
    probability from exact counts. Those of frequent words are broadcast; a text's other words go through a join with the
    table of all counts, under a key of their own each, so that no hot key arises. score: log10 probability by the
    filter's bigram model.

    The unigram weight is the model's. If `weights` are given, it is that of them which makes all rows that are not held
    out likeliest, each token as if not counted: what `weighed` finds over the training texts, without a pass of its own.

    Null text is empty text: one token, the end. Null and repeated ids get a row each. A column that `held_out` does not
    need is not read. An empty table gives an empty result; a model of no training texts gives every token the same
    probability.
    """
    n, v = model.train_tokens, model.distinct
    tried = weights is not None
    weights = weights or (model.weight,)
    found = _found(docs, model, held_out, weights, tried, id_col, text_col)
    joined = found.join(model.words.select(F.col("word").alias("key"), "n"), "key", "left")
    seen = F.coalesce(F.col("n"), F.lit(0))
    rows = (
        joined.groupBy("row")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.max("held_out").alias("held_out"),
            F.max("n_tokens").alias("n_tokens"),
            (F.max("n_known") + F.coalesce(F.sum(F.when(seen > 0, F.col("times"))), F.lit(0))).alias("n_known"),
            (F.max("base_score") + F.coalesce(F.sum(F.col("times") * F.log10((seen + 1) / F.lit(float(n + v + 1)))), F.lit(0.0))).alias("base_score"),
            *(F.sum(f"s{i}").alias(f"s{i}") for i in range(len(weights))),
        )
    )
    best = 0
    if tried:
        rows = written(rows, "lm-scores")
        best = _likeliest(rows.filter("row < 0").select("row", "s0").collect(), weights)
        best = weights.index(model.weight) if best is None and model.weight in weights else best or 0
        rows = rows.filter("row >= 0")
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", F.col(f"s{best}").alias("score"))
