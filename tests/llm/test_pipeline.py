"""The pipeline's stages against a plain model of each, on the smallest driver tables."""

import hashlib
import re

import corpus_pipeline
from pyspark.sql import functions as F
from quirespark.llm import decontam
from tests.llm.test_dedup import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(7, "a text of its own that shares an id with another row", "en", "x", 1), (None, None, None, None, None)], docs.schema)
    docs = docs.unionByName(extra)
    columns = docs.columns
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "packing"]
    quality, exact, near, leaks, pack = (f for _, f in corpus_pipeline.STAGES)

    kept = quality(spark, docs, SF).cache()
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    known = [truth[r.doc_id] for r in kept.collect() if r.doc_id in truth]
    assert kept.columns == columns and sum(known) >= 0.95 * sum(truth.values()) and known.count(0) <= 2

    found = exact(spark, kept, SF).cache()
    norm = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()
    least = {}
    for r in kept.collect():
        least.setdefault(norm(r.text), set()).add(r.doc_id)
    expected = sorted(str((min((i for i in ids if i is not None), default=None), h)) for h, ids in least.items())
    assert found.columns == columns and sorted(str((r.doc_id, norm(r.text))) for r in found.collect()) == expected

    apart = near(spark, found, SF).cache()
    texts = [(r.doc_id, r.text) for r in found.collect()]
    rows = [eval(x) for x in brute(texts)]  # (id, size, component)
    stay = {i for i, n, c in rows if not n or i == c}
    assert apart.columns == columns and sorted(str(r.doc_id) for r in apart.collect()) == sorted(str(i) for i, _ in texts if i in stay)

    clean = leaks(spark, apart, SF).cache()
    items = [(str(r.item_id), r.text.encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {i: decontam.windows(t) for i, t in items}

    def leaked(t):
        w = decontam.words((t or "").encode())
        own = {tuple(w[k : k + 8]) for k in range(len(w) - 7)}
        return sum(bool(own & x) for x in windows.values())

    assert clean.columns == columns and sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(r.doc_id) for r in apart.collect() if not leaked(r.text))

    pieces = pack(spark, clean, SF).collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in clean.collect()}
    assert all(p.offset + p.length <= 4096 for p in pieces)


def test_a_single_passage_is_enough(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    planted = [(10_000 + k, f"words before it {' '.join(r.text.split()[2:11])} and after it", "en", "x", 1) for k, r in enumerate(bench)]
    both = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    kept = {r.doc_id for r in corpus_pipeline.drop_leaks(spark, both, SF).collect()}
    clean = {r.doc_id for r in corpus_pipeline.drop_leaks(spark, docs, SF).collect()}
    assert kept == clean and clean


def test_stages_keep_columns_of_any_name_and_empty_tables(spark):
    plain = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    docs = plain
    for name in ("score", "predicted", "digest", "hits", "_text", "_id", "kept id"):
        docs = docs.withColumn(name, F.concat(F.lit("own of "), F.col("doc_id").cast("string")))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, SF)
        rows = found.collect()
        assert found.columns == docs.columns and all(r[c] == f"own of {r.doc_id}" for r in rows for c in docs.columns[5:])
        assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in stage(spark, plain, SF).collect())
        assert stage(spark, docs.limit(0), SF).collect() == []
    assert corpus_pipeline.pack_sequences(spark, docs.limit(0), SF).collect() == []


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and rows.count() > 100
