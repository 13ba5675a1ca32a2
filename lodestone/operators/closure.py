"""Fix-points over edge lists: semi-naive frontier loops, with every level settled.

A level joins the frontier with the edges, removes what was reached before and goes on
until nothing is new. Only a count a level comes to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources.settled import forget, settle


def closure(edges: DataFrame, seeds: DataFrame, keys: Sequence[str] = (), max_depth: int | None = None, carried: Sequence[str] = ()) -> DataFrame:
    """(keys..., carried..., node, depth): what each seed reaches over edges (keys..., src, dst), seeds at depth 0.

    keys are shared by seeds and edges: one closure for each of their values. carried are
    columns of the seeds alone, such as a start: one closure for each of their values too,
    over the same edges, which are never repeated for it. Cycles end because a node is kept
    at its least depth only; max_depth bounds the levels.
    """
    keys, own = list(keys), [*keys, *carried]
    edges = settle(edges.select(*keys, "src", "dst").distinct(), "edges")
    frontier = settle(seeds.select(*own, F.col("node")).distinct().withColumn("depth", F.lit(0)), "level")
    levels = [frontier]
    depth = 0
    while (max_depth is None or depth < max_depth) and not frontier.isEmpty():
        depth += 1
        steps = frontier.select(*own, F.col("node").alias("src")).join(edges, [*keys, "src"]).select(*own, F.col("dst").alias("node")).distinct()
        frontier = settle(steps.join(_all(levels), [*own, "node"], "left_anti").withColumn("depth", F.lit(depth)), "level")
        levels.append(frontier)
        if len(levels) > 8:  # a long chain of levels is read as one
            whole = settle(_all(levels), "levels")
            forget(*levels[:-1])
            levels = [whole]
    forget(edges)
    return _all(levels)


def _all(levels: list[DataFrame]) -> DataFrame:
    out = levels[0]
    for level in levels[1:]:
        out = out.union(level)
    return out


def hops(edges: DataFrame, seeds: DataFrame, most: int) -> DataFrame:
    """(seed, node, depth): every length up to most at which a seed reaches a node, each once.

    Unlike closure a node is kept at every depth, as in queries that return distinct lengths.
    """
    edges = settle(edges.select("src", "dst").distinct(), "edges")
    frontier = seeds.select(F.col("node").alias("seed"), "node").distinct()
    out = None
    for depth in range(1, most + 1):
        steps = frontier.select("seed", F.col("node").alias("src")).join(edges, "src").select("seed", F.col("dst").alias("node")).distinct()
        frontier = settle(steps, "hop")
        level = frontier.withColumn("depth", F.lit(depth))
        out = level if out is None else out.union(level)
    return out


def cycles(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., node, component): nodes on a cycle, self-loops included, by strongly connected component, named by its least node.

    What no edge enters or leaves is on no cycle and is taken off until nothing more goes; only
    what is left, the cycles and what lies between them, is closed over from each node.
    """
    keys = list(keys)
    core = settle(edges.select(*keys, "src", "dst").distinct(), "core")
    n, before = core.count(), None
    while n and n != before:
        entered, left = core.select(*keys, F.col("dst").alias("src")).distinct(), core.select(*keys, F.col("src").alias("dst")).distinct()
        last, core = core, settle(core.join(entered, [*keys, "src"], "left_semi").join(left, [*keys, "dst"], "left_semi").select(*keys, "src", "dst"), "core")
        before, n = n, core.count()
        forget(last)
    seeds = core.select(*keys, F.col("src").alias("start"), F.col("src").alias("node"))
    reach = closure(core, seeds, keys, carried=["start"]).where("depth > 0").select(*keys, "start", "node")
    there = reach.select(*keys, F.col("node").alias("start"), F.col("start").alias("node"))
    mutual = reach.join(there, [*keys, "start", "node"])
    alone = core.where("src = dst").select(*keys, F.col("src").alias("start"), F.col("src").alias("node"))
    return mutual.union(alone).groupBy(*keys, F.col("start").alias("node")).agg(F.least(F.min("node"), F.first("start")).alias("component"))


def reaches_itself(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., node): nodes on a cycle, self-loops included."""
    return cycles(edges, keys).select(*keys, "node")
