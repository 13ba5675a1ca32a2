"""Connected components of a distributed edge list: union-find within partitions, then star contraction.

Nothing about the graph goes to the driver but two counts a round.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import forget, hot_join, release, settle

#: Edges that one union-find holds at a time.
FOREST_EDGES = 500_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the edges of a partition, FOREST_EDGES at a time, by edges to the smallest member of each tree."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent[top] != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def stars() -> pa.RecordBatch:
        pairs = [(x, r) for x in parent if (r := root(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["u", "v"])

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            parent.setdefault(u, u)
            parent.setdefault(v, v)
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
            if len(parent) >= FOREST_EDGES:
                yield stars()
                parent.clear()
    yield stars()


def _told(stars: DataFrame) -> tuple[int, int]:
    """How many edges there are, and how many nodes keep them from being stars: with two edges, or with one to a node that has one itself."""
    ends = stars.select(F.col("u").alias("node"), F.lit(1).alias("leaves"), F.lit(0).alias("enters")).union(stars.select("v", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("leaves").alias("leaves"), F.max("enters").alias("enters"))
    n, loose = nodes.agg(F.sum("leaves"), F.count_if(F.expr("leaves > 1 or (leaves = 1 and enters = 1)"))).first()
    return n or 0, loose


def components(edges: DataFrame) -> DataFrame:
    """(u, v) edges of longs -> (u, v): each node that is not the smallest of its component, and that smallest node.

    Every round is two star operations as joins; the neighbours of a node with very many are
    never gathered in one task (common.hot_join). Rounds go on until all edges are stars: as an
    edge goes from the larger node to the smaller, each then leads to the smallest of its component.
    """
    edges = edges.select(F.col("u").cast("bigint"), F.col("v").cast("bigint")).where("u <> v")
    stars = settle(edges.mapInArrow(_forest, "u bigint, v bigint").distinct(), "edges")
    while True:
        total, loose = _told(stars)
        if not loose:
            return stars
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        least = settle(least, "least")
        large = hot_join(both, least, ["u"], 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = settle(large, "edges")
        low = settle(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
        small = hot_join(large, low, ["u"], 2 * total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        last, stars = stars, settle(small.distinct(), "edges")
        forget(last, least, large, low)
        release(edges.sparkSession)
