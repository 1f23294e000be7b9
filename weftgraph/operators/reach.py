"""Breadth-first expansion as a loop of joins.

Each level joins the distinct (root, node) pairs of the one before with the
edges; levels are unions of small distinct frontiers, not of walks, whose number
grows exponentially.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut, forget, shares

#: Levels after which a frontier is kept in the checkpoint folder, to keep the plan
#: short.
CUT_EVERY = 4


def steps(edges: DataFrame, direction: str = "out") -> DataFrame:
    """src, dst in the direction of travel; any: both ways, a loop once each way."""
    out = edges.select("src", "dst")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return {"out": out, "in": back}.get(direction) if direction != "any" else out.union(back)


def expand(roots: DataFrame, edges: DataFrame, low: int = 1, high: int | None = None, direction: str = "out") -> DataFrame:
    """root, node, hop: the nodes that walks of low to high edges lead to, once for each
    number of edges. roots: one column of ids. The root itself counts at hop 0 only
    where low is 0, and later where a cycle leads back to it.

    Without an upper bound a node counts once, at its least number of edges from low on,
    since cycles would bring it again for ever; the loop ends with the first level that
    brings nothing new."""
    travel = steps(edges, direction)
    front = roots.select(F.col(roots.columns[0]).alias("root")).distinct().withColumn("node", F.col("root"))
    found = [front.withColumn("hop", F.lit(0))] if low == 0 else []
    for hop in range(1, (low if high is None else high) + 1):
        front = front.join(travel, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct()
        if hop % CUT_EVERY == 0 and hop != high:
            front = cut(front)
        if hop >= low:
            found.append(front.withColumn("hop", F.lit(hop)))
    if not found:
        return front.withColumn("hop", F.lit(0)).where(F.lit(False))
    if high is None:
        return _onward(found[0], travel, low)
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def _onward(seen: DataFrame, travel: DataFrame, hop: int, high: int | None = None) -> DataFrame:
    """seen (root, node, hop), and what is first reached from it level by level."""
    front = seen
    while high is None or hop < high:
        hop += 1
        reached = front.join(travel, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct()
        front = cut(reached.join(seen, ["root", "node"], "left_anti").withColumn("hop", F.lit(hop)))
        if front.isEmpty():
            break
        seen = seen.union(front)
        if hop % CUT_EVERY == 0:
            seen = cut(seen)
    return seen


def shortest(roots: DataFrame, edges: DataFrame, high: int | None = None, direction: str = "out") -> DataFrame:
    """root, node, hop with the least number of edges; the root has 0. Each level is
    computed at once, and the loop ends with the first that brings nothing new, or
    after high levels where such a bound is given."""
    seen = roots.select(F.col(roots.columns[0]).alias("root")).distinct().withColumns({"node": F.col("root"), "hop": F.lit(0)})
    travel = steps(edges, direction).distinct()
    kept = cut(travel.repartition(shares(edges), "src").sortWithinPartitions("src"))  # computed and dealt once for all levels
    found = _onward(cut(seen), kept, 0, high)
    forget(kept)
    return found
