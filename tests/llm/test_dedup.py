import hashlib
import re

from pyspark.sql import functions as F

from quirespark.llm import ngram_join
from quirespark.llm.components import components
from quirespark.llm.exact_dedup import exact_groups
from quirespark.llm.ngram_join import near_duplicates


def test_exact(docs, texts):
    groups = {}
    for i, t in texts:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    expected = []
    for i, t in texts:
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        keep = min((x for x in groups[norm] if x is not None), default=None)
        expected.append((i, keep, len(groups[norm]), i == keep, hashlib.sha256(norm.encode()).hexdigest()))
    for heavy in (1, 256):
        found = exact_groups(docs, heavy=heavy, counters=512)
        assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(map(str, expected))
    assert exact_groups(docs.limit(0)).count() == 0


def brute(texts):
    sets = []
    for _, t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                up[find(i)] = find(j)
    named = {}
    for k, (i, _) in enumerate(texts):
        if i is not None:
            named[find(k)] = min(named.get(find(k), i), i)
    return sorted(str((i, len(s), named.get(find(k)))) for k, ((i, _), s) in enumerate(zip(texts, sets, strict=True)))


def test_near(docs, texts):
    assert sorted(str(tuple(r)) for r in near_duplicates(docs).collect()) == brute(texts)
    assert near_duplicates(docs.limit(0)).count() == 0


def test_near_large_group(spark, monkeypatch):
    """A chain of edits, copies, and a passage in many texts; n-grams are dealt to several salts."""
    monkeypatch.setattr(ngram_join, "LEAST", 2)
    import random

    rng = random.Random(2)
    passage = " ".join(f"p{i}" for i in range(30))
    words = [f"b{i}" for i in range(80)]
    rows = []
    for k in range(60):
        words[rng.randrange(80)] = f"e{k}"
        rows.append((k, " ".join(words)))
        rows.append((1000 + k, " ".join(words)))
        rows.append((2000 + k, passage + " " + " ".join(f"u{k}x{i}" for i in range(12))))
        rows.append((3000 + k, passage if k % 2 else passage + f" t{k}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(str(tuple(r)) for r in near_duplicates(docs, group=16).collect()) == brute(rows)


def test_pairs_of_a_large_group(spark, monkeypatch):
    """In a group of edited copies dealt to many salts, few pairs are counted for a text, and its hub's are dealt too."""
    import random

    monkeypatch.setattr(ngram_join, "LEAST", 2)
    counted, spread, written = [], [], ngram_join.written

    def seen(rows, name):
        out = written(rows, name)
        if name == "candidate-pairs":
            counted.append(out.count())
        if name == "spread-pairs":
            spread.append(out.groupBy("far", "salt").count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(ngram_join, "written", seen)
    rng = random.Random(3)
    rows = []
    for k in range(300):
        words = [f"b{i}" for i in range(120)]
        for j in range(k % 4):
            words[rng.randrange(120)] = f"e{k}x{j}"
        rows.append((k, " ".join(words)))
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), group=8)
    assert sorted(str(tuple(r)) for r in found.collect()) == brute(rows)
    assert sum(counted) < 4 * len(rows) and max(s for s in spread if s is not None) < 40


def test_components(spark):
    edges = [(k, k + 1) for k in range(200, 260)] + [(1, 1), (5, 900), (900, 7), (None, 3), (260, 200)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({found[k] for k in range(200, 261)}) == 1 and len({found[5], found[900], found[7]}) == 1 and found[1] == 1
    assert found[5] != found[200] and 3 not in found
    assert components(spark.createDataFrame([], "a long, b long").select(F.col("a"), F.col("b"))).count() == 0
