"""Simple paths without a row for each.

A path doesn't come to a node twice.  Of what lies behind it only the nodes of the cycle that it is on can come again: once a path
has left a strong component, no edge leads back.  So paths of one length that end at the same node, having met the same nodes of
its component, go on in the same ways, and are one row from there on: with their number (:func:`ends`), or with the
least few of them (:func:`shortest`).  Off cycles that is a row for each node and length, however many paths there are;
on a cycle it is a row for each set of its nodes that can be met in the length asked for, whatever their order.

All states stay distributed; every level is stored in the shared folder.

Nulls: edges with a null end are left out.  Repeated edges and seeds count once; an edge from a node to itself is on no simple path.
Without seeds there are no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from . import callgraph, traverse

NUMBER = "decimal(38,0)"
PART = 1 << 16


def _steps(plain: DataFrame, near: DataFrame) -> DataFrame:
    """(id, next, inside): the steps among nodes with their least depth, and whether both ends are of one strong component.

    Every cycle has a step that comes no deeper; where there is none, components needn't be looked for.
    """
    a, b = near.select(F.col("id").alias("source"), F.col("depth").alias("a")), near.select(F.col("id").alias("target"), F.col("depth").alias("b"))
    e = checkpointed(plain.join(a, "source").join(b, "target"))
    d = e.select(F.col("source").alias("id"), F.col("target").alias("next"))
    if e.where("b <= a").isEmpty():
        return d.withColumn("inside", F.lit(False))
    cycle = checkpointed(callgraph.strong_components(e))
    here, there = cycle.select("id", F.col("component").alias("a")), cycle.select(F.col("id").alias("next"), F.col("component").alias("b"))
    d = d.join(here, "id", "left").join(there, "next", "left")
    return checkpointed(d.select("id", "next", F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("inside")))


def _plain(edges: DataFrame) -> DataFrame:
    return checkpointed(edges.where("source <> target").select("source", "target").distinct())


def _met(last: bool) -> Column:
    """The state's nodes after a step; none at the last level, from which nothing goes on."""
    alone = F.array("next")
    return alone if last else F.when(F.col("inside"), F.array_sort(F.concat("met", alone))).otherwise(alone)


def _open(level: DataFrame, step: DataFrame) -> DataFrame:
    return level.join(step, "id").where(~F.col("inside") | ~F.array_contains("met", F.col("next")))


def _total(n: str) -> Column:
    """A sum that is null where it, or a part of it, has more than 38 digits."""
    return F.when(F.count(F.lit(1)) == F.count(n), F.try_sum(n)).cast(NUMBER).alias(n)


def ends(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(id, depth, paths): the ends of all simple paths of up to ``depth`` steps from the seeds, with the number of paths.

    ``paths`` is decimal(38,0), null where the number has more digits.
    """
    plain = _plain(edges)
    step = _steps(plain, traverse.nearest(plain, seeds.where("id IS NOT NULL"), depth))
    level = seeds.where("id IS NOT NULL").select("id").distinct().select("id", F.array("id").alias("met"), F.lit(1).cast(NUMBER).alias("paths"))
    levels = [level.withColumn("depth", F.lit(0).cast("long"))]
    for d in range(1, depth + 1):
        level = _open(level, step).select(F.col("next").alias("id"), _met(d == depth).alias("met"), "paths").groupBy("id", "met").agg(_total("paths"))
        level = checkpointed(level)
        if level.isEmpty():
            break
        levels.append(level.withColumn("depth", F.lit(d).cast("long")))
    return reduce(DataFrame.union, levels).groupBy("id", "depth").agg(_total("paths"))


def repeated(df: DataFrame, number: str) -> DataFrame:
    """``df`` with each row as often as its ``number`` says, without that column; arrays on the way have at most 65,536 items."""
    full = F.floor((F.col(number) - 1) / PART).cast("long")
    d = df.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), full))).withColumn("_size", F.least(F.col(number) - F.col("_part") * PART, F.lit(PART)).cast("int"))
    return d.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("_size")))).drop("_part", "_size", "_row", number)


def shortest(edges: DataFrame, start: DataFrame, end: DataFrame, hops: int, n: int, arrow: str) -> DataFrame:
    """(path, depth): the first ``n`` simple paths from one node to another of up to ``hops`` steps, by length and then by text.

    ``start`` and ``end``: id, one row each.  ``path`` is the ids' text, joined by ``arrow``, which no id holds.  Of the paths that share a
    state the ``n`` least go on: what one more would become comes after what these become.  A level that completes ``n`` ends the search.
    """
    plain = _plain(edges)
    left = traverse.nearest(traverse.back(plain), end, hops).select(F.col("id").alias("next"), F.col("depth").alias("left"))
    near = traverse.nearest(plain, start, hops).join(left.withColumnsRenamed({"next": "id"}), "id").where(F.col("depth") + F.col("left") <= hops)
    step = checkpointed(_steps(plain, near).join(left, "next"))
    stop = F.broadcast(end.select("id").distinct())  # one row
    level = start.select("id").distinct().select("id", F.array("id").alias("met"), F.col("id").alias("path"))
    least = Window.partitionBy("id", "met").orderBy("path")
    found, have = [], 0
    for d in range(1, hops + 1):
        go = _open(level.join(stop, "id", "left_anti"), step).where(F.col("left") + d <= hops)
        go = go.select(F.col("next").alias("id"), _met(d == hops).alias("met"), F.concat("path", F.lit(arrow), "next").alias("path"))
        level = checkpointed(go.withColumn("_k", F.row_number().over(least)).where(F.col("_k") <= n).drop("_k"))
        at = level.join(stop, "id", "left_semi").select("path", F.lit(d).cast("long").alias("depth"))
        found.append(at)
        have += at.limit(n).count()
        if have >= n or level.isEmpty():
            break
    return reduce(DataFrame.union, found).orderBy("depth", "path").limit(n)
