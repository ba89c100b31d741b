import random

from pyspark.sql import functions as F

from quirespark import scratch
from quirespark.functions import names, text
from quirespark.operators import ink, layout, relational


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_names():
    assert names.file_name("a/b: c? [x]..  ") == "a-b c x" and names.file_name("CON.txt") == "Untitled" and names.file_name(None) == "Untitled"
    assert names.file_name("..") == "Untitled" and names.file_name("é") == "é"
    assert names.file_name("é" * 300) == "é" * 120 and len(names.file_name(("word " * 100)).encode()) <= 240
    assert names.latex("x²⁻¹ + y₁⁡") == "x^{2-1} + y_{1}" and names.uri("a b/ü?#") == "a%20b/%C3%BC?#"


def test_text(spark):
    assert value(spark, text.trim_space(F.lit("﻿\xa0 a b　\n"))) == "a b"
    assert value(spark, text.escape_lines(F.lit("# a\n#b\n---\n--\n1. x\n 2) y\n＃"))) == "\\# a\n#b\n\\---\n--\n\\1. x\n \\2) y\n＃"
    assert value(spark, text.highlight_marker(F.lit("#fe0101"))) == "🔴" and value(spark, text.highlight_marker(F.lit("red"))) == ""
    assert value(spark, text.gfm_table(F.array(F.array(F.lit("a|b"), F.lit(" c \n d ")), F.array(F.lit("x"))))) == "| a\\|b | c d |\n| --- | --- |\n| x |  |"
    assert value(spark, text.extension_of(F.lit("a.b.PNG"))) == "PNG" and value(spark, text.extension_of(F.lit("a."))) is None


def test_claims_are_first_come_first_served(spark):
    rng = random.Random(3)
    pool = ["A.md", "a.md", "A 1.md", "A 1 1.md", "b", "b 1", "B", ".x", "c.tar.gz", "C.TAR.gz", "A 2.md"]
    rows = [(k, f"f{rng.randrange(2)}", rng.choice(pool)) for k in range(200)]
    taken, expected = {}, {}
    for k, folder, name in rows:
        dot = name.rfind(".")
        base, tail = (name[:dot], name[dot:]) if dot > 0 else (name, "")
        i, found = 0, name
        while found.lower() in taken.setdefault(folder, set()):
            i += 1
            found = f"{base} {i}{tail}"
        taken[folder].add(found.lower())
        expected[k] = found
    got = layout.claimed(spark.createDataFrame(rows, "k long, folder string, name string"), "folder", "name", "k")
    assert {r.k: r.claimed for r in got.collect()} == expected


def test_depth_is_the_stack_rule(spark):
    rng = random.Random(1)
    rows, expected = [], {}
    for s in range(50):
        before = -1
        for i in range(rng.randrange(1, 30)):
            level = rng.randrange(5)
            before = min(level, before + 1)
            rows.append((s, i, level))
            expected[s, i] = before
    got = layout.with_depth(spark.createDataFrame(rows, "s long, i long, level long"), ["s"], ["i"], "level")
    assert {(r.s, r.i): r.depth for r in got.collect()} == expected


def test_chain_and_cycle(spark):
    rows = [(k, k - 1 if k else None) for k in range(150)] + [(500, 501), (501, 500), (600, 9999)]
    got = {r.node: (r.root, r.depth) for r in relational.chain_depth(spark.createDataFrame(rows, "n long, up long"), "n", "up").collect()}
    assert got == {**{k: (0, k) for k in range(150)}, 600: (600, 0)}


def test_ended_chains_do_not_meet_in_one_task(spark, monkeypatch):
    """Without broadcasts, no task of a round writes most of the rows, though most chains have ended."""
    largest = []

    def counted(rows, name):
        if name == "chains":
            sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("task")).count().collect()]
            largest.append(max(sizes, default=0))
        return scratch.written(rows, name)

    monkeypatch.setattr(relational, "written", counted)
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    links = spark.range(4000).select("id", F.when(F.col("id") % 4 != 0, F.col("id") - 1).alias("up"))
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = relational.chain_depth(links, "id", "up").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {(r.node, r.root, r.depth) for r in got} == {(k, k - k % 4, k % 4) for k in range(4000)} and len(got) == 4000
    assert max(largest) < 1500


def test_ink(spark):
    numbers = [0, -1, 1, 63, -64, 5000, -(1 << 40)]
    assert ink.signed_varints(ink.encoded_varints(numbers)) == numbers
    assert value(spark, ink.varint_column(F.lit(b"\x80"))) is None
    assert [ink.number_text(x) for x in (1.0, 0.5, -2.25, 1e-7, 1.5e-6, 1e21, 123456.0)] == ["1", "0.5", "-2.25", "1e-7", "0.0000015", "1e+21", "123456"]
    assert ink.drawing([]) is None and 'cx="10" cy="10" r="1"' in ink.drawing([{"points": [{"x": 3, "y": 4}], "color": "#000", "width": 2, "opacity": 1}])
