"""Toxic passages by maximum-scoring segment search."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirespark.llm.columns import whole_text
from quirespark.llm.quality import sampled_labels
from quirespark.llm.shared import bounded_batches, removed, written
from quirespark.llm.tokenization import text_bytes

#: Labelled documents that are learnt from at most, chosen by a hash of the id. All of their words are kept.
LABELLED = 20_000
#: Pseudo-counts of the Dirichlet prior that each token starts from, dealt to the classes by their sizes.
PRIOR = 2.0
#: Standard errors by which log-odds are drawn to 0.
CAUTION = 2.0
#: What is taken off every token's log-odds, so that chance alone lets no passage grow; significant passages are those
#: of which chance would put fewer than so many into a text.
DRIFT, SIGNIFICANT = 0.05, 0.05
#: A word that was not seen is scored by its first letters, the longest known first.
STEMS = (6, 5, 4)
#: Parts of the labelled sample; a part is calibrated on with the counts of the others.
FOLDS = 4
MEMO_WORDS = 500_000

_FOLD = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else c + 32 if 65 <= c < 91 else 32 for c in range(256))


def tokens(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of all other non-ASCII characters, A-Z in lower case."""
    return text.translate(_FOLD).split()


def word_key(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def stem_keys(word: bytes) -> list[int]:
    """Keys of a word's first letters, the longest first."""
    letters = word.decode("utf-8", "replace")
    return [xxhash.xxh3_64_intdigest(letters[:k].encode(), k) for k in STEMS if len(letters) > k]


def log_odds(toxic: np.ndarray, clean: np.ndarray, toxic_total: float, clean_total: float) -> np.ndarray:
    """How much likelier tokens are in toxic texts, as a log ratio. The Dirichlet prior gives each token PRIOR counts, dealt
    to the classes by their sizes; the ratio is then drawn to 0 by CAUTION standard errors, so what was seen seldom says
    little."""
    share = toxic_total / (toxic_total + clean_total)
    a, b = toxic + PRIOR * share, clean + PRIOR * (1 - share)
    ratio = np.log(a / share) - np.log(b / (1 - share))
    return np.sign(ratio) * np.maximum(0, np.abs(ratio) - CAUTION * np.sqrt(1 / a + 1 / b))


def segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first, end) of a sequence, in linear time: neighbours of one sign are taken
    together, and each positive run is merged with those before it along links to the nearest lower beginning."""
    n = len(scores)
    if not n:
        return []
    positive = scores > 0
    at = np.flatnonzero(np.concatenate([[True], positive[1:] != positive[:-1]]))
    total = np.concatenate([[0.0], np.cumsum(scores)])
    first, end = at, np.concatenate([at[1:], [n]])
    runs = positive[at]
    found: list[tuple[float, float, int, int, int]] = []  # sum left of it, sum up to its end, first, end, nearest lower before
    for left, right, a, b in zip(total[first[runs]].tolist(), total[end[runs]].tolist(), first[runs].tolist(), end[runs].tolist(), strict=True):
        k = len(found) - 1
        while True:
            while k >= 0 and found[k][0] >= left:
                k = found[k][4]
            if k < 0 or found[k][1] >= right:
                found.append((left, right, a, b, k))
                break
            left, a = found[k][0], found[k][2]
            below = found[k][4]
            del found[k:]
            k = below
    return [(right - left, a, b) for left, right, a, b, _ in found]


@dataclass
class Lexicon:
    """keys: hashes of words and stems, ascending; odds: their log-odds. rate and scale: the parameters of the
    extreme-value law (lambda and K); base and slope: the logistic calibration of the evidence."""

    keys: np.ndarray
    odds: np.ndarray
    rate: float = 1.0
    scale: float = 0.1
    base: float = 0.0
    slope: float = 1.0
    memo: dict[bytes, float] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"memo": {}}

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Log-odds of keys; NaN for those not known."""
        if not len(self.keys):
            return np.full(len(keys), np.nan)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.odds[at], np.nan)

    def learned(self, words: list[bytes]) -> None:
        own = self.lookup(np.fromiter(map(word_key, words), np.uint64, len(words)))
        for word, x in zip(words, own.tolist(), strict=True):
            if x != x:  # not seen as a word
                known = self.lookup(np.array(stem_keys(word), np.uint64))
                known = known[~np.isnan(known)]
                x = float(known[0]) if len(known) else 0.0
            self.memo[word] = x

    def token_scores(self, words: list[bytes]) -> np.ndarray:
        new = set(words).difference(self.memo)
        if len(self.memo) + len(new) > MEMO_WORDS:
            self.memo.clear()
            new = set(words)
        self.learned(list(new))
        return np.fromiter(map(self.memo.__getitem__, words), np.float64, len(words)) - DRIFT

    def raw(self, text: bytes) -> tuple[int, list[tuple[float, int, int]]]:
        words = tokens(text)
        return len(words), segments(self.token_scores(words))

    def evidence(self, n: int, scores: np.ndarray) -> np.ndarray:
        """Minus the log of how many passages of at least such scores chance would put into a text of n tokens."""
        return self.rate * scores - math.log(self.scale * max(n, 1))

    def total(self, n: int, scores: np.ndarray) -> float:
        """The evidence of a text's passages together: a passage far from chance counts in full, others hardly."""
        return float(np.logaddexp(0, self.evidence(n, scores)).sum())

    def probability(self, totals):
        return 1 / (1 + np.exp(-np.clip(self.base + self.slope * np.log1p(totals), -35, 35)))

    def judged(self, text: bytes) -> tuple[float, list[dict]]:
        """A text's score, and its significant passages."""
        n, found = self.raw(text)
        scores = np.array([s for s, _, _ in found])
        evidence = self.evidence(n, scores)
        passages = [{"first": a, "end": b, "evidence": e} for (_, a, b), e in zip(found, evidence.tolist(), strict=True) if e >= -math.log(SIGNIFICANT)]
        return float(self.probability(self.total(n, scores))), passages


def extreme_rate(scores: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of the expected value of exp(rate * score) = 1 under those weights: lambda of the extreme-value
    law of the largest segment. Scores that are never positive, or positive on average, have none; then 1."""
    p = weights / max(weights.sum(), 1e-300)
    if not len(scores) or scores.max() <= 0 or p @ scores >= 0:
        return 1.0
    value = lambda r: float(p @ np.exp(np.clip(r * scores, -700, 700))) - 1
    lo, hi = 0.0, 1.0
    while value(hi) < 0 and hi < 64:
        lo, hi = hi, 2 * hi
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if value(mid) < 0 else (lo, mid)
    return hi


def calibrated(lexicon: Lexicon, totals: np.ndarray, y: np.ndarray) -> Lexicon:
    """Fits the logistic curve over the log of the evidence; the slope stays positive."""
    x = np.log1p(totals)
    b, s = -1.0, 1.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(b + s * x, -35, 35)))
        g = np.array([(y - p).sum() - 1e-3 * b, ((y - p) * x).sum() - 0.1 * s])
        v = p * (1 - p)
        h = np.array([[v.sum() + 1e-3, (v * x).sum()], [(v * x).sum(), (v * x * x).sum() + 0.1]])
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        b, s = b + step[0], max(1e-3, s + step[1])
    return replace(lexicon, base=float(b), slope=float(s), memo={})


def lexicon_of(keys: np.ndarray, toxic: np.ndarray, clean: np.ndarray, words: np.ndarray, toxic_total: float, clean_total: float) -> Lexicon:
    """keys ascending, with counts by class; `words` marks those that are words and not stems. A token that was not seen
    scores as one with no counts; its share of clean texts is that of tokens seen once."""
    odds = log_odds(toxic, clean, toxic_total, clean_total)
    share = toxic_total / (toxic_total + clean_total)
    once = float(((toxic + clean == 1) & words).sum())
    scores = np.concatenate([odds[words], [0.0]]) - DRIFT
    weights = np.concatenate([clean[words] + PRIOR * (1 - share), [max(once, 1.0)]])
    return Lexicon(keys, odds.astype(np.float32), extreme_rate(scores, weights))


def learn(docs: DataFrame, labels: DataFrame, label: str, usable: Column, id_col: str = "doc_id", text_col: str = "text", bound: int = LABELLED) -> Lexicon:
    """Log-odds of words and stems between the labelled classes (see log_odds), over a bounded sample of the labelled rows
    for which `usable` holds. A token counts once for each document, and every token of the sample is kept.

    The sample is dealt to FOLDS parts by a hash of the id. Each part's passages are found with the counts of the other
    parts, so the extreme-value law and the curve are fitted to texts that the log-odds have not seen. Null texts are
    empty, rows without an id or a label are left out, an id with several labels has the largest. Without both labels
    every text gets about the labels' mean; without any, about 0."""
    bounded_batches(docs.sparkSession)
    own = docs.filter(usable).select(F.col(id_col).alias("label_id"), whole_text(text_col).alias("text"))
    sample = own.join(F.broadcast(sampled_labels(labels, label, id_col, bound)), "label_id")
    part = F.pmod(F.xxhash64("label_id", F.lit("part")), F.lit(FOLDS)).cast("int")
    sample = written(sample.select("text", F.col("label").cast("int").alias("label"), part.alias("part")), "toxicity-sample")
    slots = [f"n{k}" for k in range(2 * FOLDS)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, bool], list[int]] = {}

        def out() -> pa.RecordBatch:
            columns = np.array(list(seen.values()), np.int64).reshape(-1, 2 * FOLDS)
            rows = pa.RecordBatch.from_arrays(
                [pa.array(np.array([k for k, _ in seen], np.uint64).view(np.int64)), pa.array([w for _, w in seen], pa.bool_()), *(pa.array(c) for c in columns.T)],
                names=["key", "word", *slots],
            )
            seen.clear()
            return rows

        for batch in batches:
            for text, y, p in zip(text_bytes(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                for word in set(tokens(text)):
                    for key in ((word_key(word), True), *((k, False) for k in stem_keys(word))):
                        seen.setdefault(key, [0] * 2 * FOLDS)[2 * p + y] += 1
            if len(seen) > MEMO_WORDS:
                yield out()
        if seen:
            yield out()

    schema = "key long, word boolean, " + ", ".join(f"{s} long" for s in slots)
    counts = sample.mapInArrow(count, schema).groupBy("key").agg(F.max("word").alias("word"), *(F.sum(s).cast("int").alias(s) for s in slots)).toArrow()
    y = np.array([r.label for r in sample.select("label").collect()], np.int64)
    keys = np.asarray(counts["key"]).view(np.uint64)
    order = np.argsort(keys)
    keys, words = keys[order], np.asarray(counts["word"]).astype(bool)[order]
    table = np.array([np.asarray(counts[s]) for s in slots], np.int64).reshape(FOLDS, 2, -1)[:, :, order]
    totals = table[:, :, words].sum(2)  # by part and label

    def without(parts: int | None) -> Lexicon | None:
        keep = [k for k in range(FOLDS) if k != parts]
        (clean, toxic), (clean_total, toxic_total) = table[keep].sum(0), totals[keep].sum(0)
        return lexicon_of(keys, toxic, clean, words, float(toxic_total), float(clean_total)) if toxic_total and clean_total else None

    lexicon = without(None)
    if lexicon is None:
        mean = float(y.mean()) if len(y) else 0.0
        return Lexicon(np.empty(0, np.uint64), np.empty(0, np.float32), base=math.log((mean + 1e-3) / (1 - mean + 1e-3)), slope=0.0)
    others = docs.sparkSession.sparkContext.broadcast([without(k) or lexicon for k in range(FOLDS)])

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, p in zip(text_bytes(batch.column(0)), batch.column(2).to_pylist(), strict=True):
                n, found = others.value[p].raw(text)
                rows.append((n, [s for s, _, _ in found]))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([n for n, _ in rows], pa.int64()), pa.array([s for _, s in rows], pa.list_(pa.float64()))], names=["label", "part", "n", "scores"])

    rows = sample.mapInArrow(tried, "label int, part int, n long, scores array<double>").collect()
    removed(sample)
    y = np.array([r.label for r in rows])
    # K from the largest passages of clean texts: their mean is (log(K n) + Euler's constant) / lambda
    largest = [(others.value[r.part].rate * max(r.scores), r.n) for r in rows if not r.label and r.scores]
    scale = math.exp(np.mean([s - math.log(n) for s, n in largest]) - np.euler_gamma) if largest else 0.1
    lexicon = replace(lexicon, scale=scale)
    parts = [replace(x, scale=scale) for x in others.value]
    others.unpersist()
    return calibrated(lexicon, np.array([parts[r.part].total(r.n, np.array(r.scores)) for r in rows]), y)


PASSAGES = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("evidence", T.DoubleType())]))
FOUND = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("passages", PASSAGES)])
_LEXICONS: dict[str, Lexicon] = {}


def scored(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", cut: float = 0.7) -> DataFrame:
    """Adds passages (the significant ones in text order: first token, end, evidence), score (0 to 1) and predicted (1 from
    the cut on) to every row; columns of these names are replaced, others stay.

    A passage's evidence is minus the log of the number of passages as good that chance would put into a text of this
    length; the score is the calibrated curve over the evidence of all maximal segments. Null text is scored as empty
    text, repeated rows alike, and an empty table stays empty. The lexicon is broadcast: its size is bounded by the
    labelled texts that it was learnt from."""
    kind = pa.struct([("score", pa.float64()), ("passages", pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("evidence", pa.float64())])))])
    shared, name = docs.sparkSession.sparkContext.broadcast(lexicon), uuid.uuid4().hex

    @F.arrow_udf(FOUND)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if name not in _LEXICONS:  # one memo in a worker
            _LEXICONS.clear()
            _LEXICONS[name] = shared.value
        own = _LEXICONS[name]
        for texts in batches:
            yield pa.array([{"score": s, "passages": p} for s, p in map(own.judged, text_bytes(texts))], kind)

    bounded_batches(docs.sparkSession)
    held = "found"
    while held in docs.columns:
        held += "_"
    rows = docs.withColumn(held, find(whole_text(text_col)))
    return rows.withColumn("passages", F.col(held)["passages"]).withColumn("score", F.col(held)["score"]).withColumn("predicted", (F.col("score") >= cut).cast("int")).drop(held)
