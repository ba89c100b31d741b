from pyspark.sql import functions as F

from quirespark.functions import names
from quirespark.plans import catalogue


def test_whole_titles_and_single_paths(spark, tmp_path):
    long = "a long first line of many words " * 12
    texts = ["Same", "Same", "same 1", "Same 1\nbody", "x" * 60 + " one", "x" * 60 + " two", long, long, "", "a/b: c?", "E\u0301t\u00e9"]
    rows = [(k, t, "s") for k, t in enumerate(texts)] + [(100, "Same", "r")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    expected, taken = {}, set()
    for k, t, source in rows:
        base, n = names.file_name(t.split("\n")[0]), 0
        while (source, (name := base + (f" {n}" if n else "") + ".md").lower()) in taken:
            n += 1
        taken.add((source, name.lower()))
        expected[k] = f"{source}/{name}"
    found = {r.doc_id: r.path for r in catalogue.QUERIES["titled_notes"](spark, str(tmp_path)).collect()}
    assert found == expected and len({p.lower() for p in found.values()}) == len(rows)


def test_entry_has_whole_titles(spark):
    import __spark_entry__

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.regexp_extract("text", r"\A[^\n]*", 0).alias("head"))
    rows = __spark_entry__.entry(spark).join(docs, "doc_id").collect()
    stems = {r.doc_id: (r.path.split("/", 1)[1].removesuffix(".md"), names.file_name(r.head)) for r in rows}
    assert len(stems) == 200 and all(own.startswith(title) for own, title in stems.values())
