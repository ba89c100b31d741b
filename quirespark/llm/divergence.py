"""How the sources of each language differ: the terms that a source uses more than its language, and sources pair by pair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirespark.llm.columns import whole_text
from quirespark.llm.shared import bounded_batches, removed, written
from quirespark.llm.tokenization import text_bytes

#: Documents of a language that hold a term that is kept, at least.
LEAST_DOCS = 3
#: Terms of a source that are told.
TOP = 200
#: Probabilities are parts of this.
SCALE = 1_000_000_000
#: Bytes of text that are counted at a time, and pairs of a term's postings that are.
BLOCK_BYTES, BLOCK_PAIRS = 16 << 20, 1 << 22

#: A-Z in small, all other ASCII but a-z as a space; bytes from 0x80 on, all of them letters of terms, stay.
_FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
COUNTS = "lang string, source string, term string, n long, docs long"


def share(count: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)), exact; null without terms."""
    return F.expr(f"case when {terms} > 0 then 1 + (cast({count} + 1 as decimal(20)) * {SCALE}) div cast({total} + {terms} as decimal(20)) end")


def gap(p: str, q: str) -> Column:
    """floor((p - q)^2 / q), exact for shares."""
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div ({q})")


def _counted(texts: list[bytes], groups: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of a block, and for each (group, word) in it: group, word, occurrences, texts."""
    split = pc.ascii_split_whitespace(pa.array([t.translate(_FOLDED) for t in texts], pa.large_binary()).view(pa.large_string()))
    words = split.flatten().dictionary_encode()
    size, code = max(len(words.dictionary), 1), np.asarray(words.indices, np.int64)
    row = np.repeat(np.arange(len(texts)), np.diff(np.asarray(split.offsets)))
    keep = np.asarray(pc.not_equal(words.dictionary, pa.scalar("", words.dictionary.type)).take(words.indices), bool) if len(code) else np.zeros(0, bool)
    row, code = row[keep], code[keep]
    keys, n = np.unique(groups[row] * size + code, return_counts=True)
    once = np.unique(row * size + code)
    docs = np.unique(groups[once // size] * size + once % size, return_counts=True)[1]  # of the same keys
    return words.dictionary, keys // size, keys % size, n, docs


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """A written table (lang, source, term, n, docs): occurrences of each term in each source of a language, and the
    documents (rows) that hold it. Each source has one more row, of null term, with n 0 and all its documents.

    Terms are runs of A-Z, a-z and characters past ASCII; only A-Z count as their small letters. Nulls are empty strings.
    Tasks count whole blocks of texts before anything is shuffled.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[tuple[str, str], int] = {}
        texts: list[bytes] = []
        groups: list[int] = []
        held = 0

        def told() -> pa.RecordBatch:
            words, group, word, n, found = _counted(texts, np.array(groups, np.int64))
            rows = np.bincount(np.array(groups, np.int64), minlength=len(names))
            own = np.flatnonzero(rows)
            of = pa.array(np.concatenate([group, own]))
            lang, source = (pa.array([x[k] for x in names], pa.string()).take(of) for k in (0, 1))
            term = pa.concat_arrays([words.take(pa.array(word)).cast(pa.string()), pa.nulls(len(own), pa.string())])
            return pa.RecordBatch.from_arrays([lang, source, term, pa.array(np.concatenate([n, np.zeros(len(own), np.int64)])), pa.array(np.concatenate([found, rows[own]]))], names=[c.split()[0] for c in COUNTS.split(", ")])

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2)), strict=True):
                texts.append(text)
                groups.append(names.setdefault((lang, source), len(names)))
                held += len(text)
                if held >= BLOCK_BYTES:
                    yield told()
                    texts, groups, held = [], [], 0
        if texts:
            yield told()

    rows = docs.select(whole_text(lang_col).alias("lang"), whole_text(source_col).alias("source"), whole_text(text_col).alias("text")).mapInArrow(run, COUNTS)
    return written(rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")


def postings(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two written tables of what term_counts gives. Groups: group_id, lang, source, own_terms (kept terms that occur),
    kept (the language's kept terms), zero (the share of a kept term that does not occur). Postings, a row for each kept
    term that occurs in a group: group_id, lang, term, zero, bucket (of its count), p (its share in the group), q (in the
    language)."""
    kept = written(counts.filter("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= LEAST_DOCS).select("lang", "term", "lang_n"), "kept-terms")
    own = written(counts.filter("term is not null").select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "own-terms")
    langs = kept.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count(F.lit(1)).alias("kept"))
    sums = own.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("own_terms"))
    groups = counts.filter("term is null").select("lang", "source").join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    groups = written(groups.withColumn("zero", share("0L", "total", "kept")).withColumn("group_id", F.monotonically_increasing_id()), "groups")
    rows = own.join(groups, ["lang", "source"]).withColumn("bucket", F.when(F.col("n") < 16, F.col("n")).otherwise(F.floor(F.log2("n") * 4)).cast("int"))
    posts = written(rows.select("group_id", "lang", "term", "zero", "bucket", share("n", "total", "kept").alias("p"), share("lang_n", "lang_total", "kept").alias("q")), "postings")
    removed(kept, own)
    return groups, posts


def top_terms(posts: DataFrame, top: int = TOP) -> DataFrame:
    """The terms of each group with p > q of the highest gap(p, q): a written table of group_id, item, value, rank (value
    descending, term ascending, up to `top`).

    Terms of a group lie in buckets of near counts. A bucket's largest p and smallest q bound what any of its terms
    reaches. Rounds evaluate, of each group, the buckets of the highest bounds that hold at least `top` terms (four times
    as many in each later round); buckets whose bound is strictly below the group's value at rank `top` are never
    evaluated, and the rounds end when no other is left. Each task sends at most `top` terms of a group.
    """
    over = posts.filter("p > q")
    bounds = over.groupBy("group_id", "bucket").agg(F.count(F.lit(1)).alias("terms"), F.max("p").alias("most"), F.min("q").alias("least"))
    left = written(bounds.select("group_id", "bucket", "terms", gap("most", "least").alias("bound")), "bounds")
    ranked = Window.partitionBy("group_id").orderBy(F.col("value").desc(), F.col("item").asc())
    best, wanted, old = None, top, []
    while True:
        before = F.coalesce(F.sum("terms").over(Window.partitionBy("group_id").orderBy(F.col("bound").desc(), "bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        turned = written(left.withColumn("now", before < wanted), "bucket-turns")
        found = over.join(turned.filter("now").select("group_id", "bucket"), ["group_id", "bucket"]).select("group_id", F.col("term").alias("item"), gap("p", "q").alias("value"))
        found = found if best is None else found.unionByName(best.select("group_id", "item", "value"))
        best = written(found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top), "top-terms")
        last = best.filter(F.col("rank") == top).select("group_id", F.col("value").alias("kth"))
        old += [left, turned]
        left = written(turned.filter("not now").join(last, "group_id", "left").filter("kth is null or bound >= kth").select("group_id", "bucket", "terms", "bound"), "bounds")
        if left.isEmpty():
            removed(*old, left)
            return best
        old.append(best)
        wanted *= 4


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings in order of (lang, term): for groups a and b that share terms, what those terms change against both groups
    lacking the other's."""
    gap_of = lambda p, q: (p - q) ** 2 // q

    def summed(group: np.ndarray, p: np.ndarray, zero: np.ndarray, new: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(p)))
        first, many = np.repeat(starts, sizes), np.repeat(sizes, sizes)  # of each row's term
        upto, lo = np.cumsum(many), 0
        while lo < len(p):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + BLOCK_PAIRS, "right")))
            m = many[lo:hi]
            i = np.repeat(np.arange(lo, hi), m)
            j = np.arange(len(i)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(first[lo:hi], m)
            i, j = i[i != j], j[i != j]
            value = gap_of(p[i], p[j]) - gap_of(p[i], zero[j]) - gap_of(zero[i], p[j]) + gap_of(zero[i], zero[j])
            names, at = np.unique(np.concatenate([group[i], group[j]]), return_inverse=True)
            code = at[: len(i)] * len(names) + at[len(i) :]
            if len(names) ** 2 <= BLOCK_PAIRS:
                sums, seen = np.zeros(len(names) ** 2, np.int64), np.zeros(len(names) ** 2, bool)
                np.add.at(sums, code, value)
                seen[code] = True
                pairs = np.flatnonzero(seen)
                sums = sums[pairs]
            else:
                pairs, at = np.unique(code, return_inverse=True)
                sums = np.zeros(len(pairs), np.int64)
                np.add.at(sums, at, value)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(names[pairs // len(names)]), pa.array(names[pairs % len(names)]), pa.array(sums)], names=["a", "b", "met"])
            lo = hi

    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = (table if held is None else pa.concat_tables([held, table])).combine_chunks()
        changes = pc.or_(*(pc.not_equal(table[c].slice(1), table[c].slice(0, len(table) - 1)) for c in ("lang", "term"))) if len(table) > 1 else pa.chunked_array([pa.array([], pa.bool_())])
        new = np.concatenate([[True], np.asarray(changes, bool)])
        last = int(np.flatnonzero(new)[-1])  # its term may go on in the next batch
        if last:
            yield from summed(*(np.asarray(table[c].slice(0, last), np.int64) for c in ("group_id", "p", "zero")), new[:last])
        held = table.slice(last)
    if held is not None:
        yield from summed(*(np.asarray(held[c], np.int64) for c in ("group_id", "p", "zero")), np.arange(len(held)) == 0)


def pair_values(groups: DataFrame, posts: DataFrame) -> DataFrame:
    """For each two groups a, b of a language (group ids): the sum of gap(p of a, p of b) over the language's kept terms.

    Terms in neither count at once; terms in one of them by how many of its terms have each share, as the other's is that
    of a missing term; only terms in both are met, term by term, among the groups that hold the term: postings lie sorted
    by term, so no group's rows come together, and pairs of a long list are made in slices and summed at once.
    """
    long_sum = lambda x: F.sum(x.cast("decimal(38)"))
    met = posts.select("lang", "term", "group_id", "p", "zero").repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(_met, "a long, b long, met long").groupBy("a", "b").agg(long_sum(F.col("met")).alias("met"))
    shares = posts.groupBy("group_id", "lang", "p").agg(F.count(F.lit(1)).alias("terms"))
    other = groups.select("lang", F.col("group_id").alias("b"), "zero")
    one = shares.join(other, "lang").filter("group_id <> b").groupBy(F.col("group_id").alias("a"), "b").agg(long_sum(F.col("terms").cast("decimal(20)") * gap("p", "zero")).alias("there"), long_sum(F.col("terms").cast("decimal(20)") * gap("zero", "p")).alias("back"))
    one = written(one, "one-sided")
    pairs = groups.select("lang", "kept", F.col("group_id").alias("a"), F.col("own_terms").alias("terms_a"), F.col("zero").alias("zero_a")).join(groups.select("lang", F.col("group_id").alias("b"), F.col("own_terms").alias("terms_b"), F.col("zero").alias("zero_b")), "lang").filter("a <> b")
    pairs = pairs.join(one.select("a", "b", "there"), ["a", "b"], "left").join(one.select(F.col("a").alias("b"), F.col("b").alias("a"), "back"), ["a", "b"], "left").join(met, ["a", "b"], "left")
    neither = (F.col("kept") - F.col("terms_a") - F.col("terms_b")).cast("decimal(20)") * gap("zero_a", "zero_b")
    parts = [F.coalesce(x, F.lit(0)) for x in (F.col("there"), F.col("back"), neither, F.col("met"))]
    return pairs.select("a", "b", (parts[0] + parts[1] + parts[2] + parts[3]).cast("long").alias("value"))


def audit(docs: DataFrame, top: int = TOP, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank. Part `term`: the terms that a source of a language uses more than the language,
    up to rank `top`; part `pair`: every other source of the language. Values: see gap, share and pair_values; equal values
    rank by item, in byte order.

    Null text, lang and source are empty strings; every row counts as a document, repeated ids and texts too. A source
    without terms has pairs, of which it lacks every term; a language without kept terms has pairs of value 0. An empty
    table gives an empty one. Other columns are not read.
    """
    counts = term_counts(docs, lang_col, source_col, text_col)
    groups, posts = postings(counts)
    removed(counts)
    names = groups.select("group_id", "lang", "source")
    terms = top_terms(posts, top).join(names, "group_id").select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    values = pair_values(groups, posts)
    pairs = values.join(names.withColumnRenamed("group_id", "a"), "a").join(names.select(F.col("group_id").alias("b"), F.col("source").alias("item")), "b")
    ranked = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc())
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank"))
    return terms.unionByName(pairs)


#: The audit of `documents` for DuckDB.
SQL = """
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT lang, source, doc, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS word FROM d),
t AS (SELECT lang, source, doc, translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM w),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= 3),
langs AS (SELECT lang, sum(n) AS total, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
own AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
sums AS (SELECT lang, source, sum(n) AS total FROM own GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n,
        1 + (1000000000::HUGEINT * (coalesce(o.n, 0) + 1)) // (coalesce(s.total, 0)::HUGEINT + l.v) AS p,
        1 + (1000000000::HUGEINT * (k.n + 1)) // (l.total::HUGEINT + l.v) AS q
      FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source
      LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value,
            row_number() OVER (PARTITION BY lang, source ORDER BY (p - q) * (p - q) // q DESC, term) AS rank
          FROM p WHERE n > 0 AND p > q),
sided AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT) AS value
          FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT g.lang, g.source, h.source AS item, coalesce(s.value, 0)::BIGINT AS value
          FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
          LEFT JOIN sided s ON s.lang = g.lang AND s.source = g.source AND s.item = h.source)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM terms WHERE rank <= 200
UNION ALL
SELECT lang, source, 'pair', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER FROM pairs
"""
