import random
import re
from collections import Counter, defaultdict

import pandas as pd
import pytest

from quirespark.llm import divergence

WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, top=200):
    """The audit of (text, lang, source) rows, a term at a time."""
    rows = [tuple(x or "" for x in r) for r in rows]
    held, used, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        words = [w.translate(SMALL) for w in WORD.findall(text)]
        held[lang].update(set(words))
        used[lang, source].update(words)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in held[lang].items() if n >= 3]
        share = {}
        for name, n in (*((s, used[lang, s]) for s in sources), (None, sum((used[lang, s] for s in sources), Counter()))):
            total = sum(n[t] for t in kept)
            share[name] = {t: 1 + 10**9 * (n[t] + 1) // (total + len(kept)) for t in kept}
        for s in sources:
            found = [((share[s][t] - share[None][t]) ** 2 // share[None][t], t) for t in kept if used[lang, s][t] and share[s][t] > share[None][t]]
            others = [(sum((share[s][t] - share[o][t]) ** 2 // share[o][t] for t in kept), o) for o in sources if o != s]
            for part, values, most in (("term", found, top), ("pair", others, None)):
                ranked = sorted(values, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ranked)]
    return sorted(out)


def made(seed, n, langs, sources, words):
    rng = random.Random(seed)
    weights = [1 / (k + 1) for k in range(len(words))]
    rows = []
    for _ in range(n):
        source = rng.choice(sources)
        own = words if rng.random() < 0.5 else rng.sample(words, max(1, len(words) // 3))
        rows.append((" ".join(rng.choices(own, weights[: len(own)], k=rng.randrange(30))), rng.choice(langs), source))
    return rows


WORDS = [f"Wörd{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(120)] + ["the", "The", "don't", "x1y", "中文", "É", "é", "a\x00b", "Z[z", "—", "x z"]
ODD = [(None, None, None), ("", "", ""), (None, "en", "quiet"), ("the the the", "xx", "a"), ("the", "xx", "a"), ("the", "xx", "b"), ("one two", "yy", "a"), (" \n 123 !", "yy", "b"), ("lang alone", "zz", None), ("tie tie", "tt", "a"), ("tie", "tt", "b"), ("tie", "tt", "c")]


@pytest.mark.parametrize("seed, top", [(1, 200), (2, 7), (3, 1)])
def test_like_a_plain_reading(spark, seed, top):
    rows = made(seed, 150, ["en", "de", "", None], ["s1", "s2", "É", "", None, "s10"], WORDS) + ODD + [("big " * 40000 + "tail", "en", "s1")]
    docs = spark.createDataFrame([(*r, 5, "y") for r in rows], "text string, lang string, source string, n int, term string").repartition(4)
    assert sorted(tuple(r) for r in divergence.audit(docs, top).collect()) == plain(rows, top)


def test_small_blocks(spark, monkeypatch):
    rows = made(4, 60, ["en"], [f"s{k}" for k in range(12)], WORDS[:20])
    posts = divergence.postings(divergence.term_counts(spark.createDataFrame(rows, "text string, lang string, source string")))[1]
    batches = posts.select("lang", "term", "group_id", "p", "zero").orderBy("lang", "term").toArrow()

    def summed(size, pairs):
        monkeypatch.setattr(divergence, "BLOCK_PAIRS", pairs)
        found = Counter()
        for b in divergence._met(iter(batches.to_batches(max_chunksize=size))):
            for a, o, v in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                found[a, o] += v
        return found

    whole = summed(10_000, 1 << 22)
    assert whole and all(summed(size, pairs) == whole for size, pairs in ((1, 1 << 22), (7, 30), (10_000, 5)))


def test_no_rows(spark):
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).collect() == []


def test_oracle_says_the_same(spark):
    import duckdb

    rows = made(6, 120, ["en", "fr", None], ["a", "B", None], WORDS) + ODD
    documents = pd.DataFrame(rows, columns=["text", "lang", "source"]).astype("string")  # noqa: F841 (DuckDB reads it)
    assert sorted(duckdb.sql(divergence.SQL).fetchall()) == plain(rows)
