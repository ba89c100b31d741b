"""Near-duplicate texts: an exact Jaccard join of word n-gram sets by vertical partitioning.

All n-grams have one global order: those that are not known to be frequent by their hash, then the frequent ones by how
often they occur. The order is cut into FRAGMENTS; a document's set becomes a segment for each, overlaps are counted
segment by segment, and a pair's partial counts are summed. Pairs are counted only if they share an n-gram of their
prefixes (the first |s| - ceil(0.8 |s|) + 1 of a set; any two sets that link share one).

Documents with equal sets are one node. What is asked for is which documents hang together, so within the nodes of an
n-gram not all pairs are counted: in the first rounds each node meets one hub of the n-gram, and afterwards only pairs
whose ends are not yet known to hang together are counted, all of them. No link between components is lost.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirespark.llm.columns import whole_text
from quirespark.llm.components import components
from quirespark.llm.shared import bounded_batches, new_dir, written
from quirespark.llm.tokenization import text_bytes

SIZE, SIMILARITY = 5, 80
FRAGMENTS = 4
#: Frequent n-grams whose place in the order is known (broadcast, 16 bytes each); least documents of one.
FREQUENT, LEAST = 1 << 18, 8
#: Nodes of one n-gram, and pairs of one hub, that one key holds at most, about; more are dealt to several.
GROUP = 512
#: Rounds with hubs before all remaining pairs are counted.
ROUNDS = 2
#: N-grams that a task counts together.
CHUNK = 4 << 20
#: Bits of the filter of nodes that have a candidate, broadcast (4 MB).
NODE_BITS = 1 << 25

_FACTORS = np.random.default_rng(1).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def gram_sets(texts: list[bytes], size: int = SIZE) -> Iterator[np.ndarray]:
    """Each text's distinct hashed n-grams, ascending; the whole sequence where it has fewer words; empty without words."""
    for text in texts:
        words = text.lower().split()
        h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        n = min(size, len(h))
        if not n:
            yield h
            continue
        with np.errstate(over="ignore"):
            total = np.full(len(h) - n + 1, n, np.uint64)
            for k in range(n):
                total += h[k : len(h) - n + 1 + k] * _FACTORS[k]
        total = np.sort(_mix(total))
        first = np.ones(len(total), bool)
        np.not_equal(total[1:], total[:-1], out=first[1:])
        yield total[first]


def digest(grams: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63) if len(grams) else 0


def prefix_size(n: int, similarity: int = SIMILARITY) -> int:
    return n - (n * similarity + 99) // 100 + 1 if n else 0


class Order:
    """The global order: frequent n-grams, ascending by hash, with their rank (rarest first) and how often they occur."""

    def __init__(self, grams: np.ndarray, times: np.ndarray):
        by_times = np.lexsort((grams, times))
        rank = np.empty(len(grams), np.int64)
        rank[by_times] = np.arange(len(grams))
        order = np.argsort(grams)
        self.grams, self.rank, self.times = grams[order], rank[order], times[order]
        self.mask = np.zeros(1 << 20, bool)
        self.mask[(self.grams >> np.uint64(44)).astype(np.int64)] = True

    def places(self, grams: np.ndarray) -> np.ndarray:
        """Where in `self.grams` each n-gram is, -1 if it isn't known as frequent."""
        found = np.full(len(grams), -1, np.int64)
        maybe = np.flatnonzero(self.mask[(grams >> np.uint64(44)).astype(np.int64)])
        if len(maybe) and len(self.grams):
            at = np.minimum(np.searchsorted(self.grams, grams[maybe]), len(self.grams) - 1)
            same = self.grams[at] == grams[maybe]
            found[maybe[same]] = at[same]
        return found

    def prefix(self, grams: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The first n of a set in the global order, and how often each occurs if it is frequent, else 0."""
        place = self.places(grams)
        rare = grams[place < 0][:n]
        often = place[place >= 0]
        often = often[np.argsort(self.rank[often])][: n - len(rare)]
        return np.concatenate([rare, self.grams[often]]), np.concatenate([np.zeros(len(rare), np.int64), self.times[often]])


def fragments(grams: np.ndarray, order: Order, count: int = FRAGMENTS) -> np.ndarray:
    """The fragment of each n-gram: the frequent ones are the last, the others lie in ranges of the hash."""
    return np.where(order.places(grams) >= 0, count - 1, (grams >> np.uint64(32)).astype(np.int64) * (count - 1) >> 32)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _first_pass(docs: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Members (doc_id, node, n_shingles) of every row, and (gram, n) of n-grams that occur at least twice in the rows a
    task counts together."""
    names = ["doc_id", "node", "n_shingles", "gram", "n"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            g, times = np.unique(np.concatenate(held), return_counts=True)
            twice = times > 1
            k = int(twice.sum())
            return pa.RecordBatch.from_arrays([*(pa.nulls(k, pa.int64()) for _ in range(3)), _signed(g[twice]), pa.array(times[twice], pa.int64())], names=names)

        for batch in batches:
            nodes, sizes = [], []
            for grams in gram_sets(text_bytes(batch.column(1)), size):
                nodes.append(digest(grams))
                sizes.append(len(grams))
                held.append(grams)
                n += len(grams)
                if n >= CHUNK:
                    yield out()
                    held, n = [], 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.nulls(len(nodes), pa.int64()), pa.nulls(len(nodes), pa.int64())], names=names)
        if held:
            yield out()

    rows = written(docs.mapInArrow(count, "doc_id long, node long, n_shingles long, gram long, n long"), "first-pass")
    return rows.filter("n is null").select("doc_id", "node", "n_shingles"), rows.filter("n is not null").select("gram", "n")


def _frequent(counts: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that, by the sums of those counts, are in `least` documents: the most frequent, up to a bound."""
    counts = written(counts.groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= least), "frequent-grams")
    step = F.floor(F.log2("n") * 4)
    room, lowest = FREQUENT, None
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), key=lambda r: -r.step):
        room -= r["count"]
        if room < 0:
            break
        lowest = r.step
    if lowest is None:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    top = counts.filter(step >= lowest).toArrow()
    return np.asarray(top["gram"]).view(np.uint64).copy(), np.asarray(top["n"]).copy()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, similarity: int = SIMILARITY, group: int = GROUP) -> DataFrame:
    """One row per document: doc_id, n_shingles (distinct), component_id (the smallest id reachable by links, its own
    included). Two documents link if 100 * intersection >= similarity * union of their sets of n-grams of `size` words
    (white-space-separated, A-Z in lower case; a text of fewer words is one n-gram).

    Texts without words, null ones too, have 0 n-grams and link with nothing. Rows that repeat an id are each returned,
    and may carry different components if their texts differ. Rows without an id keep their place in a component but
    never name it; a component of such rows alone has a null id. An empty table gives an empty result. Other columns are
    not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    bounded_batches(spark)
    members, counts = _first_pass(docs, size)
    order = spark.sparkContext.broadcast(Order(*_frequent(counts, LEAST)))

    postings = _postings(docs, order, size, similarity, group)
    nodes = _bitmap(postings)
    table = _segments(docs, order, nodes, size)
    try:
        edges, tested, labels = None, None, None
        for turn in range(ROUNDS + 1):
            pairs = _hub_pairs(postings, labels, turn, similarity) if turn < ROUNDS else _remaining_pairs(postings, labels, similarity, group)
            if tested is not None:
                pairs = pairs.join(tested, ["a", "b"], "left_anti")
            pairs = written(pairs, "candidate-pairs")
            tested = pairs.select("a", "b") if tested is None else tested.unionByName(pairs.select("a", "b"))
            linked = written(_verified(pairs, table, similarity, group), "links")
            edges = linked if edges is None else edges.unionByName(linked)
            labels = components(edges)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    named = labels.withColumnRenamed("component", "c")
    node_ids = members.groupBy("node").agg(F.min("doc_id").alias("least")).join(named, "node", "left").withColumn("c", F.coalesce("c", "node"))
    least = node_ids.groupBy("c").agg(F.min("least").alias("component_id"))
    of_node = written(node_ids.join(least, "c").select("node", "component_id"), "node-components")
    found = members.filter("n_shingles > 0").join(of_node, "node").select("doc_id", "n_shingles", "component_id")
    return found.unionByName(members.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def _postings(docs: DataFrame, order, size: int, similarity: int, group: int) -> DataFrame:
    """(gram, salt, node, size, place): the prefixes of all nodes, for n-grams that more than one node has in its prefix.
    place is the n-gram's position in the node's ordered set. A frequent n-gram is dealt to several salts, else salt is -1."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = set()
        for batch in batches:
            grams, salts, owners, sizes, lengths = [], [], [], [], []
            for s in gram_sets(text_bytes(batch.column(0)), size):
                node = digest(s)
                if not len(s) or node in done:
                    continue
                if len(done) > 1 << 20:
                    done.clear()
                done.add(node)
                first, times = order.value.prefix(s, prefix_size(len(s), similarity))
                grams.append(first)
                salts.append(np.where(times > group, node % np.maximum(1, -(-times // group)), -1))
                owners.append(node)
                sizes.append(len(s))
                lengths.append(len(first))
            if owners:
                by = np.repeat(np.arange(len(owners)), lengths)
                yield pa.RecordBatch.from_arrays(
                    [_signed(np.concatenate(grams)), pa.array(np.concatenate(salts), pa.int32()), pa.array(np.array(owners, np.int64)[by]), pa.array(np.array(sizes, np.int32)[by]), pa.array(np.concatenate([np.arange(n, dtype=np.int32) for n in lengths]))],
                    names=["gram", "salt", "node", "size", "place"],
                )

    names = ["gram", "salt", "node", "size", "place"]

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From rows in order of gram, salt and node, those that may link: one group of rows at a time is carried over."""
        held = [np.empty(0, np.int64)] * 5
        for batch in batches:
            rows = [np.concatenate([h, np.asarray(batch.column(i)).astype(np.int64)]) for i, h in enumerate(held)]
            last = len(rows[0])
            if last:
                last = int(np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))[-1:].sum() + ((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1])).any())
            held = [r[last:] for r in rows]
            yield from out([r[:last] for r in rows])
        yield from out(held)

    def out(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        kept = [r[may_link(*rows, similarity)] for r in rows]
        if len(kept[0]):
            yield pa.RecordBatch.from_arrays([pa.array(k if c in ("gram", "node") else k.astype(np.int32)) for c, k in zip(names, kept, strict=True)], names=names)

    schema = "gram long, salt int, node long, size int, place int"
    rows = docs.select("text").mapInArrow(prefixes, schema).repartition("gram", "salt").sortWithinPartitions("gram", "salt", "node")
    return written(rows.mapInArrow(shared, schema), "postings")


def may_link(gram: np.ndarray, salt: np.ndarray, node: np.ndarray, size: np.ndarray, place: np.ndarray, similarity: int) -> np.ndarray:
    """Of whole groups of rows in order of gram, salt and node, the places of those that another node of the group may
    link with, by size and position: its size lies within the ratio, and the smallest such size leaves room enough behind
    this row's place. Rows of a dealt n-gram may have partners elsewhere and all stay."""
    if not len(gram):
        return np.empty(0, np.int64)
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (salt[1:] != salt[:-1])
    at = np.flatnonzero(new | np.concatenate([[True], node[1:] != node[:-1]]))
    group = np.cumsum(new)[at]
    n, p, dealt = size[at], place[at], salt[at] >= 0
    order = np.lexsort((n, group))
    key = (group << 32 | n)[order]
    low, high = (n * similarity + 99) // 100, n * 100 // similarity
    first, end = np.searchsorted(key, group << 32 | low), np.searchsorted(key, group << 32 | high, "right")
    own = np.empty(len(at), np.int64)
    own[order] = np.arange(len(at))
    other = np.minimum(np.where(first == own, first + 1, first), len(at) - 1)
    least = n[order][other]
    ok = dealt | ((end - first > 1) & ((n - p) * (100 + similarity) >= similarity * (n + least)))
    left = np.bincount(group[ok], minlength=group[-1] + 1)
    return at[ok & (dealt | (left[group] > 1))]


def _bitmap(postings: DataFrame):
    """Which nodes have a posting, as bits by the node modulo NODE_BITS: some others may seem to."""
    at = F.pmod("node", F.lit(NODE_BITS))
    rows = postings.groupBy(F.shiftright(at, 15).alias("page")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit(32767))).alias("bits")).collect()
    bits = np.zeros(NODE_BITS >> 3, np.uint8)
    for r in rows:
        bits[r.page << 12 : (r.page + 1) << 12] = np.frombuffer(r.bits, np.uint8)
    return postings.sparkSession.sparkContext.broadcast(bits)


def _segments(docs: DataFrame, order, nodes, size: int) -> str:
    """A table of (node, fragment, segment) of all nodes in the bitmap, bucketed by node, so that joins with it move
    candidate pairs and not sets."""
    spark = docs.sparkSession

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = set()
        for batch in batches:
            owners, parts, segments = [], [], []
            for s in gram_sets(text_bytes(batch.column(0)), size):
                node = digest(s)
                at = node % NODE_BITS
                if not len(s) or node in done or not nodes.value[at >> 3] >> (at & 7) & 1:
                    continue
                if len(done) > 1 << 20:
                    done.clear()
                done.add(node)
                of = fragments(s, order.value)
                for k in np.unique(of).tolist():
                    owners.append(node)
                    parts.append(k)
                    segments.append(s[of == k].view(np.int64))
            if owners:
                bounds = np.concatenate([[0], np.cumsum([len(s) for s in segments])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), pa.array(parts, pa.int32()), pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(segments)))], names=["node", "fragment", "grams"])

    table = f"segments_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("text").mapInArrow(cut, "node long, fragment int, grams array<long>").repartition(n, "node").dropDuplicates(["node", "fragment"])
    rows.write.option("path", new_dir(spark, "segments")).option("compression", "zstd").bucketBy(n, "node").saveAsTable(table)
    return table


def _may_link(similarity: int):
    """Bounds on a match of two prefixes: the sizes' ratio, and the positional bound. If this is the first n-gram that the
    two sets share, their overlap is at most 1 and what the shorter rest holds; a pair that links passes at its first."""
    n, m = F.col("size"), F.col("other_size")
    most = F.least(n - F.col("place"), m - F.col("other_place"))
    return (n * 100 >= m * similarity) & (m * 100 >= n * similarity) & (most * (100 + similarity) >= similarity * (n + m))


def _labelled(postings: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return postings.withColumn("c", F.col("node"))
    return postings.join(labels.withColumnRenamed("component", "c"), "node", "left").withColumn("c", F.coalesce("c", "node"))


def _pairs(rows: DataFrame) -> DataFrame:
    """(a, size_a, b, size_b) once for each pair of nodes, a < b."""
    ahead = F.col("node") < F.col("other")
    return rows.select(F.least("node", "other").alias("a"), F.when(ahead, F.col("size")).otherwise(F.col("other_size")).alias("size_a"), F.greatest("node", "other").alias("b"), F.when(ahead, F.col("other_size")).otherwise(F.col("size")).alias("size_b")).distinct()


def _hub_pairs(postings: DataFrame, labels: DataFrame | None, turn: int, similarity: int) -> DataFrame:
    """Each node of an n-gram with the n-gram's hub, unless known to hang together. All salts of an n-gram have one hub, as
    two hubs of one group of copies need not link; a hub is picked within each salt first, and then among those.

    The first hub is the node with most shared n-grams in its prefix: in a group of edited copies that is one with few
    edits. Later hubs are drawn anew for each n-gram among the nodes of its largest component, so that a node which is
    not linked yet meets many of them."""
    rows = _labelled(postings, labels)
    if labels is None:
        rows = rows.join(postings.groupBy("node").agg((-F.count(F.lit(1))).alias("by")), "node").withColumn("by", F.struct("by", F.xxhash64("node").alias("hash")))
    else:
        parts = rows.groupBy("gram", "salt", "c").agg(F.count(F.lit(1)).alias("n"))
        largest = parts.groupBy("gram", "salt").agg(F.max(F.struct("n", "c")).alias("l"), F.count(F.lit(1)).alias("parts")).filter("parts > 1 or salt >= 0").select("gram", "salt", F.col("l.c").alias("largest"))
        rows = rows.join(largest, ["gram", "salt"])
        rows = rows.withColumn("by", F.struct((F.col("c") != F.col("largest")).cast("long").alias("by"), F.xxhash64("node", "gram", F.lit(turn)).alias("hash"))).drop("largest")
    pick = F.min(F.struct("by", F.col("node").alias("other"), F.col("size").alias("other_size"), F.col("c").alias("other_c"), F.col("place").alias("other_place"))).alias("hub")
    picked = rows.groupBy("gram", "salt").agg(pick)
    best = picked.groupBy("gram").agg(F.min("hub").alias("hub"))
    hubs = picked.select("gram", "salt").join(best, "gram").select("gram", "salt", *(f"hub.{c}" for c in ("other", "other_size", "other_c", "other_place")))
    rows = rows.drop("by").join(hubs, ["gram", "salt"])
    return _pairs(rows.filter((F.col("c") != F.col("other_c")) & _may_link(similarity)))


def _remaining_pairs(postings: DataFrame, labels: DataFrame, similarity: int, group: int) -> DataFrame:
    """All pairs of nodes that share an n-gram of their prefixes and aren't known to hang together. The nodes of an
    n-gram's largest component stand on one side of the join only, so those do not meet each other. The nodes of that side
    are dealt to parts, each of which meets all of the other, so a common n-gram is not one task's."""
    rows = written(_labelled(postings, labels), "labelled-postings")
    sizes = rows.groupBy("gram", "c").agg(F.count(F.lit(1)).alias("n"))
    live = sizes.groupBy("gram").agg(F.max(F.struct("n", "c")).alias("largest"), F.count(F.lit(1)).alias("parts"), F.ceil(F.sum("n") / (2 * group)).cast("int").alias("spread")).filter("parts > 1").select("gram", "spread", F.col("largest.c").alias("largest"))
    kept = rows.join(live, "gram")
    left = kept.filter("c <> largest").select("gram", F.pmod(F.xxhash64("node"), F.col("spread")).cast("int").alias("dealt"), "node", "size", "c", "place")
    right = kept.withColumn("dealt", F.explode(F.sequence(F.lit(0), F.col("spread") - 1))).select("gram", "dealt", F.col("node").alias("other"), F.col("size").alias("other_size"), F.col("c").alias("other_c"), F.col("place").alias("other_place"), "largest")
    met = left.join(right, ["gram", "dealt"]).filter((F.col("c") != F.col("other_c")) & ((F.col("other_c") == F.col("largest")) | (F.col("node") < F.col("other"))) & _may_link(similarity))
    return _pairs(met)


def _spread(pairs: DataFrame, group: int) -> DataFrame:
    """The pairs as (near, far, size_near, size_far, salt). A node of more than `group` pairs, as a hub is, is their far
    end (b, where both ends have so many), dealt to salts of about `group` pairs; others have salt 0."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    hubs = written(ends.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / group).cast("int").alias("spread")).filter("spread > 1"), "hubs")
    of = pairs.join(hubs.toDF("a", "spread_a"), "a", "left").join(hubs.toDF("b", "spread_b"), "b", "left")
    turned = F.col("spread_a").isNotNull() & F.col("spread_b").isNull()
    near, size_near = F.when(turned, F.col("b")).otherwise(F.col("a")), F.when(turned, F.col("size_b")).otherwise(F.col("size_a"))
    far, size_far = F.when(turned, F.col("a")).otherwise(F.col("b")), F.when(turned, F.col("size_a")).otherwise(F.col("size_b"))
    spread = F.coalesce("spread_b", "spread_a", F.lit(1))
    return of.select(near.alias("near"), far.alias("far"), size_near.alias("size_near"), size_far.alias("size_far"), spread.alias("spread"), F.pmod(F.xxhash64(near), spread).cast("int").alias("salt"))


def _verified(pairs: DataFrame, table: str, similarity: int, group: int) -> DataFrame:
    """The pairs that link: partial overlaps fragment by fragment, summed per pair. Segments of a hub are repeated for
    each of its salts, so its pairs are not one task's."""
    segments = pairs.sparkSession.table(table)
    pairs = written(_spread(pairs, group), "spread-pairs")
    hubs = pairs.filter("spread > 1").select("far", "salt").distinct()
    keys = ["near", "far", "size_near", "size_far"]
    partial = None
    for k in range(FRAGMENTS):
        own = segments.filter(F.col("fragment") == k).select("node", "grams")
        left = pairs.join(own.toDF("near", "left"), "near")
        right = own.toDF("far", "right")
        for met in (left.filter("spread = 1").join(right, "far"), left.filter("spread > 1").join(hubs.join(right, "far"), ["far", "salt"])):
            part = met.select(*keys, F.size(F.array_intersect("left", "right")).alias("overlap"))
            partial = part if partial is None else partial.unionByName(part)
    total = partial.groupBy(*keys).agg(F.sum("overlap").alias("overlap"))
    linked = total.filter(F.col("overlap") * 100 >= similarity * (F.col("size_near") + F.col("size_far") - F.col("overlap")))
    return linked.select(F.least("near", "far").alias("a"), F.greatest("near", "far").alias("b"))
