"""Bounded traversals.

A walk goes level by level: the next frontier is the distinct targets of the present one, so a node of a cycle comes
again at later levels up to the bound, as rows of (node, depth) do under set semantics.  The edges are stored once;
every ``every`` levels what was found is stored, which cuts the plan; an empty frontier ends the walk.  Frontiers stay
distributed.  They are stored as Parquet, whose size the planner knows: it sends a small frontier to the edges, and a
small result to the nodes, instead of shuffling all of these; large ones are shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, kept

EVERY = 4


def back(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("target").alias("source"), F.col("source").alias("target"))


def _pairs(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source").alias("id"), F.col("target").alias("next"))


def _steps(edges: DataFrame) -> DataFrame:
    """Distinct (id, next), made once: every level reads it."""
    return kept(_pairs(edges).distinct())


def _hops(step: DataFrame, level: DataFrame, keys: tuple[str, ...], first: int, last: int) -> list[DataFrame]:
    """The levels ``first`` to ``last`` after a level, each (*keys, id, depth), as plans."""
    out = []
    for d in range(first, last + 1):
        level = level.join(step, "id").select(*keys, F.col("next").alias("id")).distinct()
        out.append(level.withColumn("depth", F.lit(d).cast("long")))
    return out


def walk(edges: DataFrame, seeds: DataFrame, depth: int, keys: tuple[str, ...] = (), every: int = 1) -> DataFrame:
    """(*keys, id, depth) of every level from 0; ``seeds``: (*keys, id).  Keys are carried along, as for many sources."""
    step = kept(_pairs(edges))  # an edge may come twice: levels are distinct
    level = kept(seeds.select(*keys, "id").distinct().withColumn("depth", F.lit(0).cast("long")))
    levels = [level]
    for d in range(0, depth, every):
        more = kept(reduce(DataFrame.union, _hops(step, level.select(*keys, "id"), keys, d + 1, min(d + every, depth))))
        levels.append(more)
        level = more.where(F.col("depth") == min(d + every, depth))
        if level.isEmpty():
            break
    return reduce(DataFrame.union, levels)


def nearest(edges: DataFrame, seeds: DataFrame, depth: int, keys: tuple[str, ...] = (), every: int = 1) -> DataFrame:
    """(*keys, id, depth) with the least depth of each node.

    ``every`` levels are walked and stored together; then nodes met before leave, so what goes on shrinks to what is new.
    """
    step = kept(_pairs(edges))  # an edge may come twice: levels are distinct
    met = level = kept(seeds.select(*keys, "id").distinct().withColumn("depth", F.lit(0).cast("long")))
    for d in range(0, depth, every):
        last = min(d + every, depth)
        found = reduce(DataFrame.union, _hops(step, level.select(*keys, "id"), keys, d + 1, last))
        found = found.groupBy(*keys, "id").agg(F.min("depth").alias("depth")).join(met.select(*keys, "id"), [*keys, "id"], "left_anti")
        found = kept(found)
        # a node met at an earlier level of these has been walked on from already
        level = found.where(F.col("depth") == last)
        met = met.union(found)
        if level.isEmpty():
            break
    return met


def closure(edges: DataFrame, seeds: DataFrame, most: int = 60) -> DataFrame:
    """id of everything reachable, seeds included, whatever the distance.

    Jumps double: round k takes what is met within 2**k steps by all jumps of exactly 2**k, so a chain of n nodes takes
    log n rounds.  In a tree, as scopes are, there are never more jumps than edges.
    """
    jump = _steps(edges)
    met = checkpointed(seeds.select("id").distinct())
    size = met.count()
    for _ in range(most):
        met = checkpointed(met.union(met.join(jump, "id").select(F.col("next").alias("id"))).distinct())
        now = met.count()
        if now == size:  # a node farther off would have one before it in this round
            return met
        size = now
        jump = checkpointed(jump.join(jump.select(F.col("id").alias("next"), F.col("next").alias("far")), "next").select("id", F.col("far").alias("next")).distinct())
    raise RuntimeError(f"more than 2**{most} steps")


def simple_paths(edges: DataFrame, seeds: DataFrame, depth: int, every: int = EVERY) -> DataFrame:
    """(id, depth, path) of every path without a repeated node; ``path`` is an array of ids.  One row for each path."""
    step = _steps(edges)
    level = seeds.select("id").distinct().withColumn("path", F.array("id"))
    levels = [level.withColumn("depth", F.lit(0).cast("long"))]
    for d in range(1, depth + 1):
        level = level.join(step, "id").where(~F.array_contains("path", F.col("next"))).select(F.col("next").alias("id"), F.concat("path", F.array("next")).alias("path"))
        if d % every == 0:
            level = checkpointed(level)
            if level.isEmpty():
                break
        levels.append(level.withColumn("depth", F.lit(d).cast("long")))
    return reduce(DataFrame.union, levels).select("id", "depth", "path")


def paths_between(edges: DataFrame, start: DataFrame, end: DataFrame, hops: int) -> DataFrame:
    """(path, depth) of every path without a repeated node from one node to another.

    A path only goes on to nodes from which the end can be reached in the hops that are left.
    """
    step = _steps(edges)
    e = step.select(F.col("id").alias("source"), F.col("next").alias("target"))
    left = nearest(back(e), end, hops).select(F.col("id").alias("next"), F.col("depth").alias("left"))
    step = checkpointed(step.join(left, "next"))
    stop = end.select(F.col("id").alias("stop"))
    level = start.select("id").distinct().withColumn("path", F.array("id"))
    out = []
    for d in range(1, hops + 1):
        fits = (F.col("left") + d <= hops) & ~F.array_contains("path", F.col("next"))
        level = level.join(step, "id").where(fits).select(F.col("next").alias("id"), F.concat("path", F.array("next")).alias("path"))
        out.append(level.join(F.broadcast(stop), F.col("id") == F.col("stop"), "left_semi").select("path", F.lit(d).cast("long").alias("depth")))  # one row
    return reduce(DataFrame.union, out)


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges whose two ends are among the ids."""
    i = ids.select("id").distinct()
    return edges.join(i, F.col("source") == F.col("id"), "left_semi").join(i, F.col("target") == F.col("id"), "left_semi")
