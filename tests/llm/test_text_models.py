import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quirespark.llm import decontam, licences, lm_score, quality, toxicity
from quirespark.llm.columns import fold
from tests.llm.conftest import prose

SPACE = r"[^\x20\x09-\x0D]+"


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def test_lm_counts(spark, docs, texts):
    held = F.coalesce(F.col("doc_id") % 5 == 0, F.lit(False))
    training = docs.filter(~held)
    tokens = [(i, [*re.findall(SPACE, low(t)), "\n"]) for i, t in texts]
    counts = Counter(w for i, ws in tokens if i is None or i % 5 for w in ws)
    n, v = sum(counts.values()), len(counts)
    expected = sorted((str(i), bool(i is not None and i % 5 == 0), len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in tokens)
    for head in (0, 50, 1 << 18):
        model = lm_score.weighed(lm_score.train(training, head_words=head), training)
        rows = lm_score.scored(docs, model, held).collect()
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == expected
        assert all(r.score < 0 for r in rows) and sum(r.score for r in rows) > sum(r.base_score for r in rows)
    assert lm_score.scored(docs.limit(0), model, held).count() == 0
    empty = lm_score.scored(docs, lm_score.train(docs.limit(0)), held).collect()
    assert all(math.isfinite(r.score) and r.n_known == 0 for r in empty) and len(empty) == len(texts)


def test_filter_counts():
    rng = np.random.default_rng(1)
    h = np.unique(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64) * np.uint64(2))
    counts = np.minimum(rng.zipf(1.6, len(h)), 100_000)
    segment, identity = lm_score.split_hash(h)
    bits = {int(s): lm_score.segment_bits(identity[segment == s], counts[segment == s].astype(float)) for s in np.unique(segment)}
    import tempfile

    f = lm_score.Filter.of(bits, f"{tempfile.mkdtemp()}/bits")
    found = f.counts(h)
    level = lm_score.quantised(counts.astype(float))
    assert (found >= lm_score.LEVELS[level]).all() and (found == lm_score.LEVELS[level]).mean() > 0.97
    assert (f.counts(np.sort(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64))) == 0).mean() > 0.97


def test_decontamination(spark, docs, texts):
    rng = random.Random(9)
    own = texts[0][1].split()
    items = [(1, " ".join(own[5:20])), (2, " ".join(own[30:38]).upper()), (3, " ".join(own[40:44])), (10, own[0]), (4, None), (5, ""), (6, "!!! ..."), (7, prose(rng, 30)), (None, own[1]), (8, texts[3][1]), (2, "another text")]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))

    windows = {}
    for i, t in items:
        w = words(t)
        if i is not None and w:
            windows.setdefault(str(i), set()).update(tuple(w[k : k + 8]) for k in range(max(1, len(w) - 7)))
    expected = []
    for i, t in texts:
        w, hit, names = words(t), set(), set()
        for name, ws in windows.items():
            for x in ws:
                for k in range(len(w) - len(x) + 1):
                    if tuple(w[k : k + len(x)]) == x:
                        hit |= set(range(k, k + len(x)))
                        names.add(name)
        expected.append((str(i), len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()))
    for block in (1, 1 << 20):
        index = decontam.build_index(docs, bench, block_bytes=block)
        rows = decontam.marked(docs, index).select("doc_id", "hits.*", "score").collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest()) for r in rows) == sorted(expected)
        assert all(r.score == 0.5 for r in rows)
    assert decontam.build_index(docs, bench.limit(0)) == []
    assert decontam.marked(docs, []).filter("hits.n_hit > 0").count() == 0


def labelled(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(600):
        bad, toxic = k % 4 == 0, k % 5 == 0
        words = prose(rng, rng.randrange(30, 120)).split()
        if toxic:
            at = rng.randrange(len(words))
            words[at:at] = [rng.choice(["vileone", "viletwo", "nasty"]) for _ in range(3)]
        rows.append((k, " ".join(w + ("%%%" if bad else "") for w in words) if bad else " ".join(words) + ".", "x"))
        labels.append((k, int(not bad), int(toxic)))
    rows += [(1000, None, "x"), (1001, "", "x"), (None, "some text", None), (3, rows[3][1], "x")]
    labels += [(None, 1, 1), (7, None, None), (3, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, predicted string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: (q, t) for i, q, t in labels if i is not None and q is not None}


def test_quality(spark):
    docs, labels, truth = labelled(spark)
    ranking = quality.learn(docs, labels, "quality", fold("doc_id", 4) != 2)
    rows = quality.scored(docs, ranking).collect()
    assert len(rows) == 604 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert np.mean([r.predicted == truth[r.doc_id][0] for r in rows if r.doc_id in truth]) > 0.97
    for y in (0, 1):  # one label only
        lone = quality.fit(np.random.default_rng(0).random((20, quality.N_FEATURES)), np.full(20, y))
        assert (lone.score(np.zeros((2, quality.N_FEATURES))) >= 0.7).all() == bool(y)
    assert quality.scored(docs.limit(0), quality.learn(docs.limit(0), labels, "quality", F.lit(True))).count() == 0


def test_toxicity(spark):
    docs, labels, truth = labelled(spark)
    lexicon = toxicity.learn(docs, labels, "toxic", fold("doc_id", 3) != 1)
    rows = toxicity.scored(docs, lexicon).collect()
    assert len(rows) == 604 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert np.mean([r.predicted == truth[r.doc_id][1] for r in rows if r.doc_id in truth]) > 0.97
    assert not any(r.passages for r in rows if r.doc_id in (1000, 1001))
    none = toxicity.learn(docs, labels.limit(0), "toxic", F.lit(True))
    assert toxicity.scored(docs, none).filter("predicted = 1").count() == 0


def test_segments_are_the_maximal_ones():
    """Against the definition: split at the best segment, again and again."""

    def by_definition(s, lo, hi):
        best = max(((sum(s[a:b]), -(b - a), -a) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0, 0, 0))
        if best[0] <= 0:
            return []
        a, b = -best[2], -best[2] - best[1]
        return by_definition(s, lo, a) + [(round(best[0], 9), a, b)] + by_definition(s, b, hi)

    rng = random.Random(1)
    for _ in range(300):
        s = [rng.choice([-1.0, -1.0, -1.0, -0.2, 0.0, 1.37, 2.71, 0.61]) for _ in range(rng.randrange(0, 18))]
        found = toxicity.segments(np.array(s))
        assert sorted(round(x, 9) for x, _, _ in found) == sorted(x for x, _, _ in by_definition(s, 0, len(s)))
        assert all(round(sum(s[a:b]), 9) == round(x, 9) for x, a, b in found)


def test_segments_take_linear_time():
    falling = np.where(np.arange(400_000) % 2 == 0, 1.0, -1.01)  # no segment merges with another
    start = time.process_time()
    assert len(toxicity.segments(falling)) == 200_000
    assert len(toxicity.segments(np.where(np.arange(400_000) % 2 == 0, 1.0, -0.01))) == 1
    assert time.process_time() - start < 4


def test_toxicity_score_by_definition(spark):
    """Scores of a learnt lexicon against plain loops over words, passages and chances."""
    docs, labels, truth = labelled(spark)
    usable = fold("doc_id", 3) != 1
    lexicon = toxicity.learn(docs, labels, "toxic", usable)
    known = {r.doc_id for r in docs.filter(usable).collect()}
    counts, totals = {}, [0, 0]
    for r in docs.collect():
        if r.doc_id in known and r.doc_id in truth:
            y = truth[r.doc_id][1] if r.doc_id != 3 else 1 if truth[3][1] or 3 % 5 == 0 else 0
            for word in set(re.findall(r"[a-z0-9\x80-\U0010ffff]+", (r.text or "").lower())):
                totals[y] += 1
                for key in [word] + [(k, word[:k]) for k in (6, 5, 4) if len(word) > k]:
                    counts.setdefault(key, [0, 0])[y] += 1

    def odds(key):
        c, t = counts[key]
        share = totals[1] / sum(totals)
        a, b = t + 2 * share, c + 2 * (1 - share)
        ratio = math.log(a / share) - math.log(b / (1 - share))
        return math.copysign(max(0.0, abs(ratio) - 2 * math.sqrt(1 / a + 1 / b)), ratio)

    def value(word):
        return next((odds(k) for k in [word] + [(k, word[:k]) for k in (6, 5, 4) if len(word) > k] if k in counts), 0.0) - 0.05

    def best(s, lo, hi):
        """Maximal segments by definition, with the sums from the left."""
        left = [0.0]
        for x in s:
            left.append(left[-1] + x)
        a, b, top, least = lo, lo, 0.0, lo
        for k in range(lo + 1, hi + 1):
            if left[k] - left[least] > top + 1e-12:
                a, b, top = least, k, left[k] - left[least]
            if left[k] <= left[least]:
                least = k
        return [] if top <= 0 else best(s, lo, a) + [(top, a, b)] + best(s, b, hi)

    rows = {r.doc_id: r for r in toxicity.scored(docs, lexicon).collect() if r.doc_id is not None and r.doc_id % 40 in (0, 1, 3)}
    assert len(rows) > 30
    for r in rows.values():
        words = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (r.text or "").lower())
        found = best([value(w) for w in words], 0, len(words))
        evidence = [lexicon.rate * s - math.log(lexicon.scale * max(1, len(words))) for s, _, _ in found]
        total = sum(math.log1p(math.exp(e)) if e < 500 else e for e in evidence)
        assert abs(r.score - 1 / (1 + math.exp(-lexicon.base - lexicon.slope * math.log1p(total)))) < 1e-4
        assert [(p["first"], p["end"]) for p in r.passages] == [(a, b) for (_, a, b), e in zip(found, evidence, strict=True) if e >= -math.log(0.05)]


def test_toxicity_of_very_long_texts_and_empty_tables(spark):
    docs, labels, _ = labelled(spark)
    lexicon = toxicity.learn(docs, labels, "toxic", F.lit(True))
    long = "w10 " * 200_000
    rows = spark.createDataFrame([(1, long, "own"), (2, long + "vileone viletwo nasty vileone viletwo nasty", "own")], "doc_id long, text string, found string")
    plain, toxic = sorted(toxicity.scored(rows, lexicon).collect())
    assert plain.score < 0.5 < toxic.score and plain.found == "own" and toxic.passages[-1]["end"] == 200_006
    assert toxicity.scored(rows.limit(0), lexicon).count() == 0
    assert toxicity.scored(rows, toxicity.learn(docs.limit(0), labels, "toxic", F.lit(True))).filter("predicted = 1").count() == 0


def test_licences(spark, docs):
    notice = dict(licences.TEMPLATES)
    rows = [(1, "x y\nReleased under the MIT License.\nz"), (2, notice["GPL-3.0"]), (2, notice["GPL-3.0"] + "\n" + notice["GPL-3.0"]), (3, "this was released under the licence of a mit"), (4, None), (5, ""), (None, notice["MPL-2.0"].upper())]
    found = {(r.doc_id, r.licence): (r.n_units, round(r.dice, 3)) for r in licences.licence_matches(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {(1, "MIT"): (1, 1.0), (2, "GPL-3.0"): (4, 1.0), (None, "MPL-2.0"): (1, 1.0)}
    assert licences.licence_matches(docs).count() == 0 and licences.licence_matches(docs, templates=[]).count() == 0
