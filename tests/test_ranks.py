"""Ranks, claims and nested places, against loops."""

import random

import pytest
from pyspark.sql import functions as F

from quirespark.operators import layout, ranks


def loop_claims(rows):
    """rows: (key, folder, name) in order."""
    taken, found = {}, {}
    for k, folder, name in rows:
        if name is None:
            found[k] = None
            continue
        dot = name.rfind(".")
        base, tail = (name[:dot], name[dot:]) if dot > 0 else (name, "")
        i, own = 0, name
        while own.lower() in taken.setdefault(folder, set()):
            i += 1
            own = f"{base} {i}{tail}"
        taken[folder].add(own.lower())
        found[k] = own
    return found


POOLS = {
    "mixed": ["A.md", "a.md", "A 1.md", "A 1 1.md", "b", "b 1", "B", ".x", "c.tar.gz", "C.TAR.gz", "A 2.md", "A 01.md", "A 0.md", "A  1.md", " 1", "", "A 99999999999999999999.md"],
    "numbers": ["x", "x 1", "x 2", "x 3", "x 4", "x 5", "x 1 1", "x 1 2", "x 2 1", "x 1 1 1", "x 1 1 2", "X 3 1"],
    "one name": ["Untitled.md"] * 30 + ["untitled 7.md", "Untitled 20.md", "Untitled 41.md", "Untitled 41 1.md", "untitled 500.md"],
}


@pytest.mark.parametrize(("pool", "most"), [*((pool, 8) for pool in POOLS), ("mixed", layout.GROUP_ROWS)])
def test_claims_like_a_loop(spark, pool, most):
    rng = random.Random(pool)
    rows = [(k, rng.choice(["f", "F", None]), rng.choice(POOLS[pool]), k) for k in range(300)] + [(300, "f", None, 300)]
    shuffled = rng.sample(rows, len(rows))
    docs = spark.createDataFrame(shuffled, "k long, folder string, name string, _low long").repartition(3)
    found = layout.claimed(docs, "folder", "name", "k", most=most)
    assert found.columns == ["k", "folder", "name", "_low", "claimed"]
    assert {r.k: r.claimed for r in found.collect()} == loop_claims([r[:3] for r in rows])
    assert all(r._low == r.k for r in found.collect())


def test_claims_of_no_rows_and_two_orders(spark):
    none = spark.createDataFrame([], "folder string, name string, a long, b long")
    assert layout.claimed(none, "folder", "name", ["a", "b"]).collect() == []
    rows = [("f", "x", a, b) for a in range(3) for b in range(3)]
    found = layout.claimed(spark.createDataFrame(rows, none.schema), "folder", "name", ["a", "b"], to="name").orderBy("a", "b").collect()
    assert [r.name for r in found] == ["x"] + [f"x {k}" for k in range(1, 9)]


def test_ranks_over_many_tasks(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), rng.random(), k) for k in range(2000)]
    expected, counts = {}, {}
    for g, _, k in sorted(rows, key=lambda r: r[1]):
        expected[k] = counts[g] = counts.get(g, -1) + 1
    table = spark.createDataFrame(rows, "g string, x double, _at long").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for most in (5, 10_000):
            found = ranks.group_rank(table, ["g"], ["x"], "rank", most)
            assert {r._at: r["rank"] for r in found.collect()} == expected
        order = ranks.overall_rank(table, ["x"], "rank").orderBy("rank").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r["rank"] for r in order] == list(range(2000)) and [r.x for r in order] == sorted(r[1] for r in rows)


def test_name_order(spark):
    paths = ["b.one", "B.one", "a.one", "É.one", "e.one", "f.one", "a/z.one", "a/B.one", "A/c.one", "a b.one", "a-b.one", "_x.one", "10.one", "9.one", "z/a.one", "ｚ.one", "\U0001f600.one"]
    table = spark.createDataFrame([(p,) for p in paths], "path string")
    found = [r.path for r in ranks.overall_rank(table, [ranks.name_key(F.col("path"))], "rank").orderBy("rank").collect()]
    assert sorted(found) == sorted(paths)
    at = {p: k for k, p in enumerate(found)}
    assert at["a.one"] < at["b.one"] < at["B.one"] < at["e.one"] < at["É.one"] < at["f.one"]  # words first, then small before capital letters
    assert at["a/B.one"] < at["a/z.one"] and at["10.one"] < at["9.one"] < at["a.one"] and at["_x.one"] < at["10.one"]
    folders = [p.split("/")[0] for p in found if "/" in p]
    assert folders == sorted(folders, key=folders.index) and at["a/z.one"] < at["A/c.one"]  # a folder's files stay together
