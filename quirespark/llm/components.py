"""Connected components by contraction, in rounds of joins; nothing of the graph comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirespark.llm.shared import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (a, b: numbers of one type); the component is one of its nodes.

    Each round every node goes to the smallest of itself and its neighbours, the edges are drawn anew between those, and
    the rounds end when no edge joins two nodes; the number of nodes at least halves, so there are few. The smallest
    neighbour is found with map-side combine, and tables are written between rounds. Loops and repeated edges do no harm;
    rows with a null end are left out; no edges give no nodes.
    """
    left = written(edges.filter("a is not null and b is not null").select("a", "b").distinct(), "edges")
    steps = []
    while True:
        both = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to")), "contraction")
        steps.append(to)
        ends = left.join(to.toDF("a", "x"), "a").join(to.toDF("b", "y"), "b")
        left = written(ends.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        if left.isEmpty():
            break
    # joined nodes of a round's edges share what they come to in the later rounds
    found = steps[0]
    for to in steps[1:]:
        onward = to.select(F.col("node").alias("at"), F.col("to").alias("next"))
        found = found.join(onward, F.col("to") == F.col("at"), "left").select("node", F.coalesce("next", "to").alias("to"))
    return written(found.withColumnRenamed("to", "component"), "components")
