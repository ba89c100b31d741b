import math
import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from quirespark.llm import lm_score

ROWS, HOT = 6000, 4000


def test_weight_is_of_all_rows(spark):
    """Two thirds of the rows are copies of a text that favours a small weight and that no sample of 2,000 rows by its
    hash holds; the others are words at random, which favour a large one. Brute force uses exact counts."""
    rng = random.Random(7)
    texts = spark.createDataFrame([(" ".join(f"hot{k}x{i}" for i in range(30)),) for k in range(20)], "text string")
    hot = texts.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) >= (1 << 29)).first().text
    rows = [(k, hot if k < HOT else " ".join(f"w{rng.randrange(1500)}" for _ in range(30))) for k in range(ROWS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    training = docs.filter(~held)
    model = lm_score.train(training)
    kept = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    assert model.documents == len(kept)
    tokens = [[*t.split(), "\n"] for _, t in kept]
    words, pairs = Counter(w for ws in tokens for w in ws), Counter(p for ws in tokens for p in zip(["", *ws], ws))
    n, v = sum(words.values()), len(words)
    words[""] = len(kept)
    likely = {x: sum(c * math.log10((c - 1 + x * words[b] / (n + v + 1)) / (words[a] - 1 + x)) for (a, b), c in pairs.items()) for x in lm_score.WEIGHTS}
    best = lm_score.weighed(model, training)
    assert best.weight == max(likely, key=likely.get)
    one = {r.doc_id: r.score for r in lm_score.scored(docs, best, held).collect()}
    other = {r.doc_id: r.score for r in lm_score.scored(docs, model, held, weights=lm_score.WEIGHTS).collect()}
    assert one.keys() == other.keys() and all(abs(one[k] - other[k]) < 1e-6 for k in one)
