"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import dropped, written

#: Far more rounds than random contraction needs; reaching it is an error, not a result.
MOST_ROUNDS = 60
#: First rounds, in which the vertices' own order is their rank.
OWN_ORDER = 2


def components(edges: DataFrame) -> DataFrame:
    """(v, component) for each end of the edges (a, b); component is the smallest v of its component (of any type that has an order).

    Each round sends every vertex to the neighbour, or itself, of least rank and keeps the
    edges between what is left. In the first rounds the rank is the vertex itself, which
    contracts stars around their smallest vertex at once; afterwards ranks are drawn anew each
    round, so a component shrinks by a constant factor whatever its shape. Neighbourhoods are
    only ever reduced by a minimum, which is combined before it is shuffled, so a hub is no hot
    task. Each round's table is written: kept frames would carry the plans of all rounds before
    them, and the driver holds the plan of every query. The tables go once nothing reads them.
    """
    left = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges", compact=True)
    steps = []
    while not left.isEmpty():
        k = len(steps)
        if k == MOST_ROUNDS:
            raise RuntimeError("contraction did not end")
        ranked = lambda c: F.struct((F.xxhash64(F.col(c), F.lit(k)) if k >= OWN_ORDER else F.lit(0)).alias("rank"), F.col(c).alias("id"))  # noqa: B023, E731
        both = left.select("a", ranked("b").alias("to")).unionByName(left.select(F.col("b").alias("a"), ranked("a").alias("to")))
        step = both.groupBy("a").agg(F.min("to").alias("to")).select(F.col("a").alias("v"), F.least(F.col("to"), ranked("a"))["id"].alias("to"))
        step = written(step, "steps")
        steps.append(step)
        a, b = (step.select(F.col("v").alias(x), F.col("to").alias(f"to_{x}")) for x in "ab")
        moved = left.join(a, "a").join(b, "b").where("to_a <> to_b")
        moved = moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct()
        before, left = left, written(moved, "edges", compact=True)
        dropped(before)
    if not steps:
        return left.select(F.col("a").alias("v"), F.col("b").alias("component"))
    at = steps[0]
    for step in steps[1:]:
        at = at.join(step.select(F.col("v").alias("to"), F.col("to").alias("next")), "to", "left").select("v", F.coalesce("next", "to").alias("to"))
    if len(steps) > 1:
        at = written(at, "components")
        for step in steps:
            dropped(step)
    least = at.groupBy("to").agg(F.min("v").alias("component"))
    return at.join(least, "to").select("v", F.least("component", "v").alias("component"))
