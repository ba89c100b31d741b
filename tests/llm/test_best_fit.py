import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quirespark.llm import best_fit

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def plain_best_fit(sizes, limit):
    """Sequences that the best fit of one loop over descending sizes takes."""
    gaps = []
    for size in sorted(sizes, reverse=True):
        fits = [g for g in gaps if g >= size]
        if fits:
            gap = min(fits)
            gaps.remove(gap)
            gaps.append(gap - size)
        else:
            gaps.append(limit - size)
    return len(gaps)


def placed(spark, sizes, limit, parts):
    pieces = spark.createDataFrame([(7 * k, n, "x") for k, n in enumerate(sizes)], "piece_id long, length int, size string")
    rows = best_fit.best_fit(pieces, limit, parts).join(pieces, "piece_id").select("piece_id", "sequence_id", "offset", "length").collect()
    assert sorted(r.piece_id for r in rows) == [7 * k for k in range(len(sizes))]
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert ends.get(r.sequence_id, 0) == r.offset
        ends[r.sequence_id] = r.offset + r.length
    assert all(end <= limit for end in ends.values())
    return len(ends)


@pytest.mark.parametrize("kind", ["spread", "one size", "halves", "skewed"])
def test_few_sequences(spark, kind, monkeypatch):
    monkeypatch.setattr(best_fit, "PART_ROWS", 40)
    rng = random.Random(kind)
    sizes = {
        "spread": [rng.randrange(1, 257) for _ in range(900)],
        "one size": [100] * 600 + [rng.randrange(1, 257) for _ in range(300)],
        "halves": [128] * 101 + [129] * 50 + [127] * 50 + [256] * 9,
        "skewed": [min(256, int(rng.lognormvariate(4, 1)) + 1) for _ in range(900)],
    }[kind]
    n, least = placed(spark, sizes, 256, 8), plain_best_fit(sizes, 256)
    assert n <= 1.03 * least + 2


def test_one_partition_is_plain_best_fit(spark):
    rng = random.Random(1)
    sizes = [rng.randrange(1, 101) for _ in range(400)]
    assert placed(spark, sizes, 100, 1) <= plain_best_fit(sizes, 100) + 1


@pytest.mark.parametrize("sizes", [[], [5], [10], [1, 9], [10, 10, 1], [1] * 25])
def test_small_tables(spark, sizes):
    assert placed(spark, sizes, 10, 4) == -(-sum(sizes) // 10)


def test_sweep_takes_successors():
    places, waits, gaps = best_fit.sweep([(9, 0, -1, 1), (7, 0, -2, 3), (7, 1, 1, None), (5, 1, 2, None), (4, 1, 3, None), (3, 1, 4, None)])
    assert places == [(1, 7, -2, 3), (2, 5, -1, 1), (3, 4, -1, 6)]
    assert waits == [(4, 3)] and gaps == []


def test_matches_by_counts():
    spans, taken, spent = best_fit.matches([(0, 1, 90, 2, 50), (1, 0, None, 1, 40), (2, 3, 20, 0, None), (3, 9, 10, 0, None)])
    assert spans == [(2, 0, 2, 1, 0, 2), (2, 2, 3, 0, 0, 2), (3, 0, 5, 0, 1, 5)]
    assert taken == {0: 0, 1: 0, 2: 3, 3: 5} and spent == {1: 1, 0: 2}


def test_pieces_of_documents(spark, docs, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    pieces = best_fit.cut_pieces(docs, VOCABULARY, end_id=0, limit=64)
    found = best_fit.packed(pieces.select("piece_id", "doc_id", "piece", "start", "length", F.crc32("ids").alias("crc")), best_fit.best_fit(pieces, 64))
    expected = []
    for name, text in texts:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        expected += [(name, k, at, len(ids[at : at + 64]), zlib.crc32(np.array(ids[at : at + 64], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 64))]
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is not None, r))
    assert order(tuple(r)[:5] for r in found.collect()) == order(expected)


def test_no_documents(spark, docs):
    pieces = best_fit.cut_pieces(docs.limit(0), VOCABULARY, end_id=0, limit=64)
    assert best_fit.packed(pieces, best_fit.best_fit(pieces, 64)).collect() == []
