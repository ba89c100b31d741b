"""Document quality by Bradley-Terry pairwise ranking."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirespark.llm.columns import whole_text
from quirespark.llm.shared import bounded_batches
from quirespark.llm.tokenization import text_bytes

#: Labelled rows that are learnt from at most, chosen by a hash of the id; and pairs drawn from them.
LABELLED, PAIRS = 20_000, 60_000

_UPPER, _LOWER, _DIGIT = (bytes(range(a, b)) for a, b in ((65, 91), (97, 123), (48, 58)))
_HIGH = bytes(range(128, 256))
_MARKS = {"stop": b".", "comma": b",", "shout": b"!?", "pipe": b"|", "symbol": b"#$%&*+/<=>@\\^_~", "bracket": b"()[]{}", "quote": b"\"'`", "join": b"-:;"}
_WHITE = b" \t\n\r\x0b\x0c"


def features(text: bytes) -> list[float]:
    """Shape of a text: lengths, shares of kinds of characters, and how much of it repeats. All are 0 to about 3."""
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    n, w, k = max(1, len(text)), max(1, len(words)), max(1, len(lines))
    share = lambda chars: 1 - len(text.translate(None, chars)) / n if text else 0.0
    counts: dict[bytes, int] = {}
    for x in words:
        counts[x] = counts.get(x, 0) + 1
    top = max(counts.values(), default=0)
    pairs = len(set(zip(words, words[1:], strict=False)))
    tails = sum(x[-1] in b"!#$%&*?" for x in words)
    letters = share(_LOWER) + share(_UPPER) + share(_HIGH)
    return [
        math.log1p(len(words)) / 4,
        math.log1p(len(words) / k) / 3,
        (len(text) - len(text.translate(None, _WHITE))) / n,
        sum(map(len, words)) / w / 8,
        len(counts) / w,
        len(counts) / math.sqrt(w) / 10,
        pairs / max(1, len(words) - 1),
        len(set(lines)) / k,
        top / w,
        math.log1p(max((len(x) for x in words), default=0)) / 4,
        tails / w,
        share(_UPPER),
        share(_UPPER) / max(letters, 0.01),
        share(_DIGIT),
        letters,
        *(math.sqrt(share(chars)) for chars in _MARKS.values()),
    ]


N_FEATURES = len(features(b""))


def widened(x: np.ndarray) -> np.ndarray:
    """Features and their squares, so that a score can prefer a middle value."""
    return np.concatenate([x, x * x], axis=1)


@dataclass(frozen=True)
class Ranking:
    """score = sigmoid(slope * (w . x - threshold) + logit(cut)): the threshold is the value that gets the score `cut`."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float
    cut: float

    def utility(self, x: np.ndarray) -> np.ndarray:
        return ((widened(x) - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.utility(x) - self.threshold) + math.log(self.cut / (1 - self.cut))
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(x: np.ndarray, y: np.ndarray, cut: float = 0.7, pairs: int = PAIRS, ridge: float = 1.0, seed: int = 7) -> Ranking:
    """Bradley-Terry: a document of label 1 beats one of label 0 with probability sigmoid(difference of utilities).

    The logistic loss on feature differences is minimised by Newton steps. The threshold is the quantile of the utilities
    at the share of label 0. With one label only, every document gets that label's side of the cut."""
    y = np.asarray(y)
    wide = widened(x) if len(x) else np.zeros((0, 2 * N_FEATURES))
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    mean, scale = (wide.mean(0), wide.std(0) + 1e-3) if len(x) else (np.zeros(wide.shape[1]), np.ones(wide.shape[1]))
    w = np.zeros(wide.shape[1])
    if not len(good) or not len(bad):
        return Ranking(mean, scale, w, 1.0 if len(bad) else -1.0, 2.0, cut)
    draw = np.random.default_rng(seed)
    wide = (wide - mean) / scale
    d = wide[draw.choice(good, pairs)] - wide[draw.choice(bad, pairs)]
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -35, 35)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + ridge * np.eye(len(w)), d.T @ (1 - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    u = wide @ w
    # the border lies between the two values at the quantile
    at = np.sort(u)
    k = len(bad)
    threshold = float((at[k - 1] + at[min(k, len(at) - 1)]) / 2)
    slope = 1.0
    base = math.log(cut / (1 - cut))
    for _ in range(50):  # the slope alone, by Newton steps kept positive
        p = 1 / (1 + np.exp(-np.clip(slope * (u - threshold) + base, -35, 35)))
        g, h = ((y - p) * (u - threshold)).sum() - 0.1 * slope, (p * (1 - p) * (u - threshold) ** 2).sum() + 0.1
        slope = float(np.clip(slope + g / h, slope / 2, slope * 2))
    return Ranking(mean, scale, w, threshold, slope, cut)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def feature_column(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield pa.array([features(x) for x in text_bytes(texts)], pa.list_(pa.float64()))


def sampled_labels(labels: DataFrame, label: str, id_col: str = "doc_id", bound: int = LABELLED) -> DataFrame:
    """Labelled ids, about `bound` at most, chosen by a hash of the id; rows without an id or a label are left out, and
    an id with several labels keeps the largest."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(id_col).alias("label_id")).agg(F.max(label).alias("label"))
    share = min(1.0, bound / max(1, known.count()))
    return known if share == 1 else known.filter(F.pmod(F.xxhash64("label_id", F.lit("labelled")), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))


def learn(docs: DataFrame, labels: DataFrame, label: str, usable: Column, id_col: str = "doc_id", text_col: str = "text", bound: int = LABELLED, pairs: int = PAIRS) -> Ranking:
    """Fits the ranking to the labelled rows of `docs` for which `usable` holds: the features of a sample of about `bound`
    labelled ids at most come to the driver, and `pairs` preference pairs are drawn from them.

    Null text is empty text; rows without an id or a label are not learnt from; an id with both labels counts as 1; rows that
    repeat a labelled id are each learnt from. The draw is the same for any order of rows. Without labelled rows, or with
    one label only, every document gets that label's side of the cut."""
    bounded_batches(docs.sparkSession)
    sample = docs.filter(usable).select(F.col(id_col).alias("label_id"), whole_text(text_col).alias("text")).join(F.broadcast(sampled_labels(labels, label, id_col, bound)), "label_id")
    rows = sample.select(feature_column("text").alias("x"), "label").collect()
    rows.sort(key=lambda r: (r.label, r.x))  # the same draw for any order of rows
    return fit(np.array([r.x for r in rows]).reshape(-1, N_FEATURES), np.array([r.label for r in rows]), pairs=pairs)


def scored(docs: DataFrame, ranking: Ranking, text_col: str = "text", score: str = "score", predicted: str = "predicted") -> DataFrame:
    """Adds the score (0 to 1) and predicted (1 from the cut on) to every row; other columns stay as they are, except
    that a column of these names is replaced. Null text is scored as empty text; repeated rows each get the same score;
    an empty table stays empty."""

    @F.arrow_udf("double")
    def value(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            x = np.array([features(t) for t in text_bytes(texts)]).reshape(-1, N_FEATURES)
            yield pa.array(ranking.score(x))

    bounded_batches(docs.sparkSession)
    return docs.withColumn(score, value(whole_text(text_col))).withColumn(predicted, (F.col(score) >= ranking.cut).cast("int"))
