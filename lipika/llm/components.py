"""Connected components by randomised contraction.

Each round every node points to the neighbour (or itself) with the smallest hash under the round's seed, and edges are
re-drawn between the nodes pointed to; the expected number of nodes falls by a constant factor, so rounds grow with the
logarithm of the longest chain. Once at most TASK_EDGES edges are left, a bound that does not depend on the input, one
task joins them. The maps of all rounds are then composed from the last to the first. Minima are pre-aggregated before
the exchange, so a hub costs one row per task; every round is written to the shared folder.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lipika.llm.common import stored, tidied

TASK_EDGES = 500_000


def joined(part: pa.Table) -> pa.Table:
    """(node, to) of edges (a, b): union-find, the smallest node of a component stands for it."""
    up: dict = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in zip(part["a"].to_pylist(), part["b"].to_pylist(), strict=True):
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    nodes = list(up)
    kind = part.schema.field("a").type
    return pa.table({"node": pa.array(nodes, kind), "to": pa.array([root(x) for x in nodes], kind)})


@tidied
def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): every node of an edge and the smallest node of its component.

    Nulls in either column and loops are ignored; repeated edges change nothing; no edges give no rows.
    """
    kind = edges.schema[a].dataType
    e = edges.select(F.col(a).alias("a"), F.col(b).cast(kind).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    e = stored(e.distinct(), "cc-edges")
    maps: list[DataFrame] = []
    while n := e.count():
        if n <= TASK_EDGES:
            one = e.groupBy(F.lit(0).alias("all")).applyInArrow(joined, f"node {kind.simpleString()}, to {kind.simpleString()}")
            maps.append(stored(one, "cc-map"))
            break
        seed = F.lit(len(maps))
        order = lambda c: F.struct(F.xxhash64(seed, F.col(c)).alias("h"), F.col(c).alias("n"))
        both = e.union(e.select("b", "a"))
        best = both.groupBy("a").agg(F.min(order("b")).alias("m"))
        m = stored(best.select(F.col("a").alias("node"), F.least(order("a"), "m")["n"].alias("to")), "cc-map")
        maps.append(m)
        left = m.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        right = m.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        e = e.join(left, "a").join(right, "b").filter("ta <> tb")
        e = stored(e.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "cc-edges")
    if not maps:
        return edges.select(F.col(a).alias("node"), F.col(a).alias("component")).limit(0)
    root = maps[-1]
    for m in reversed(maps[:-1]):
        up = root.select(F.col("node").alias("to"), F.col("to").alias("root"))
        root = stored(m.join(up, "to", "left").select("node", F.coalesce("root", "to").alias("to")), "cc-root")
    least = root.groupBy("to").agg(F.min("node").alias("component"))
    return root.join(least, "to").select("node", "component")
