"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewright.llm._common import cut


def _cut(df: DataFrame) -> DataFrame:
    """cut(df) as a frame of its own, without the planner's estimates of the plan behind it.

    A checkpoint keeps its plan's size estimate and inferred constraints.  A join multiplies
    the former, so in a loop the number's digits would double with every round.
    """
    spark, kept = df.sparkSession, cut(df)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(kept.queryExecution().toRdd(), kept.schema(), False), spark)


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (a, b) with a != b; a label is one node of its component.

    The graph is contracted: each round every node hooks to its first neighbour in an order
    of all nodes, if that comes before the node itself, then to what that one hooked to;
    edges between joined nodes vanish and equal ones become one.  The first two rounds take
    nodes in their own order, which folds a star round its least node at once; later ones
    take an order drawn anew, so that no graph, long chains included, needs more than a
    number of rounds that grows with the logarithm of its nodes.  Each round drops at least
    every node that is not first among its neighbours and hooked to by none, so it ends.

    A hub's edges are summed up with map-side combine.  They meet only in joins of two
    plainly dealt sides, of which adaptive execution splits large keys.  Lineage is cut each
    round.  Null ends are left out; without edges the result is empty.
    """
    rest = edges.where("a is not null and b is not null and a != b")
    rest = _cut(rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    steps: list[DataFrame] = []
    while not rest.isEmpty():
        k = len(steps)
        place = (lambda c: F.struct(F.xxhash64(c, F.lit(k)).alias("r"), F.col(c).alias("n"))) if k > 1 else F.col
        both = rest.select("a", "b").union(rest.select("b", "a")).select(F.col("a").alias("node"), place("a").alias("own"), place("b").alias("near"))
        hooked = both.groupBy("node").agg(F.min("own").alias("own"), F.min("near").alias("near"))
        first = F.least("own", "near")
        hooked = _cut(hooked.select("node", (first["n"] if k > 1 else first).alias("to")))
        onward = hooked.where("node != to").select(F.col("node").alias("via"), F.col("to").alias("beyond"))
        step = _cut(hooked.join(onward, F.col("to") == F.col("via"), "left").select("node", F.coalesce("beyond", "to").alias("label")))
        steps.append(step)
        of_a, of_b = (step.select(F.col("node").alias(f"node_{c}"), F.col("label").alias(f"label_{c}")) for c in "ab")
        rest = rest.join(of_a, F.col("a") == F.col("node_a")).join(of_b, F.col("b") == F.col("node_b")).where("label_a != label_b")
        rest = _cut(rest.select(F.least("label_a", "label_b").alias("a"), F.greatest("label_a", "label_b").alias("b")).distinct())
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).where(F.lit(False))
    labels = steps.pop()
    while steps:
        # Every name of a round was a node before it; those without edges left keep their names.
        after = labels.select(F.col("node").alias("then"), F.col("label").alias("last"))
        labels = _cut(steps.pop().join(after, F.col("label") == F.col("then"), "left").select("node", F.coalesce("last", "label").alias("label")))
    return labels
