import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirespark.llm import lm_score
from quirespark.llm.shared import base_dir, local_path


def test_false_positives_at_any_size():
    rng = np.random.default_rng(3)
    for n in (1_000, 30_000, 400_000):
        identity = rng.choice(1 << 32, n, replace=False).astype(np.uint32)
        data = np.frombuffer(lm_score.segment_bits(identity, np.ones(n)), "u1")
        unseen = np.setdiff1d(rng.integers(0, 1 << 32, 50_000).astype(np.uint32), identity)
        first, bits = np.zeros(len(unseen), np.int64), np.full(len(unseen), 8 * len(data), np.uint64)
        assert 0.008 < (lm_score.probed(data, unseen, first, bits) > 0).mean() < 0.017
        assert (lm_score.probed(data, identity, first[:1].repeat(n), bits[:1].repeat(n)) > 0).all()


def test_filter_that_is_not_mapped(spark, docs):
    held = F.coalesce(F.col("doc_id") % 5 == 0, F.lit(False))
    training = docs.filter(~held)
    found = []
    for size in (lm_score.MAPPED_BYTES, 0):
        model = lm_score.weighed(lm_score.train(training, head_words=50, mapped_bytes=size), training)
        assert (model.filter is None) == (size == 0)
        rows = lm_score.scored(docs, model, held).collect()
        found.append((model.weight, sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in rows)))
    assert found[0] == found[1]


def test_short_texts_ask_together(spark, monkeypatch):
    """Texts of many Arrow batches ask a filter that is not mapped as one block: a row for each segment at most. What is
    written meanwhile is less than the texts."""
    rng = random.Random(11)
    rows = [(k, " ".join(f"word{int(rng.paretovariate(0.6)) % 20000}" for _ in range(40))) for k in range(8000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    held = F.col("doc_id") % 7 == 2
    top, answered, asks = local_path(base_dir(spark)), lm_score._answered, []

    def counted(model, asked, *rest):
        asks.append(asked.filter("segment is not null").count())
        return answered(model, asked, *rest)

    monkeypatch.setattr(lm_score, "_answered", counted)
    found, files = [], set()
    for size in (lm_score.MAPPED_BYTES, 0):
        model = lm_score.train(docs.filter(~held), mapped_bytes=size)
        files = {f"{d}/{f}" for d, _, names in os.walk(top) for f in names}
        found.append({r.doc_id: (r.n_known, r.base_score, r.score) for r in lm_score.scored(docs, model, held).collect()})
    assert all(found[1][k] == pytest.approx(x) for k, x in found[0].items()) and len(found[1]) == len(rows)
    assert len(asks) == 1 and asks[0] <= lm_score.SEGMENTS
    new = {f"{d}/{f}" for d, _, names in os.walk(top) for f in names} - files
    assert 0 < sum(map(os.path.getsize, new)) < sum(len(t) for _, t in rows)


def test_plan_keeps_tokens():
    h = np.random.default_rng(5).zipf(1.3, 100_000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    words, where = lm_score._unplanned(lm_score._planned(h))
    assert (words[where] == h).all() and len(words) == len(np.unique(h))
