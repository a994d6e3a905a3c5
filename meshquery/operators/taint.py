"""Taint: roles of calls, bounded reach of sources, containers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sqlcompat import counted_as, like, listed, zero
from ..graph import Graph
from ..plans import specs
from ..schema import TAINTED
from ..session import kept
from . import traverse

HOPS = 8


def _annotated(g: Graph, value: str) -> DataFrame:
    """node_id and one column of the specs of every call to a function that they name."""
    fn = g.functions.select(F.col("id").alias("target"), "package", F.col("name").alias("func_name"))
    call = g.of("call").select(F.col("id").alias("source"))
    d = g.step("call_site").join(fn, "target").join(F.broadcast(specs.taints(g.spark)), ["package", "func_name"]).join(call, "source", "left_semi")
    return d.select(F.col("source").alias("node_id"), F.col(value).alias("value")).distinct()


def annotations(g: Graph) -> DataFrame:
    """node_id, key, value as rows of the property table."""
    mark = lambda key, value: _annotated(g, value).select("node_id", F.lit(key).alias("key"), "value")
    return mark("taint_role", "role").unionByName(mark("taint_category", "category"))


def roles(g: Graph, role: str | None = None) -> DataFrame:
    """node_id and role."""
    d = _annotated(g, "role").withColumnRenamed("value", "role")
    return d if role is None else d.where(F.col("role") == role)


def categories(g: Graph) -> DataFrame:
    """node_id and category; a call can have several."""
    return _annotated(g, "category").withColumnRenamed("value", "category")


def meeting(g: Graph) -> DataFrame:
    """Functions with both a source and a sink call, and the categories of either."""
    where = g.of("call").select(F.col("id").alias("node_id"), "parent_function").where("parent_function is not null")
    met = lambda role, name: roles(g, role).join(categories(g), "node_id").join(where, "node_id").groupBy(F.col("parent_function").alias("id")).agg(listed("category").alias(name))
    d = met("source", "source_categories").join(met("sink", "sink_categories"), "id")
    return g.functions.select("id", "name", "package", "file", "line").join(d, "id")


def flow_state(g: Graph, hops: int = HOPS, edges: DataFrame | None = None, marks: DataFrame | None = None) -> DataFrame:
    """node_id, label, source_id, source_category, min_hops.

    From every source along dfg edges.  A node met before by the same source leaves the frontier, which keeps the least
    hops and drops nothing.  The label is that of the node's roles in the order source, barrier, sink; barriers are
    labelled but do not stop a walk.  A source of several categories has the least; ``marks``: node_id, role, category.
    """
    if marks is None:
        marks = kept(roles(g).join(categories(g), "node_id"))
    source = marks.where("role = 'source'").groupBy(F.col("node_id").alias("source_id")).agg(F.coalesce(F.min("category"), F.lit("unknown")).alias("source_category"))
    seeds = source.select("source_id", F.col("source_id").alias("id"))
    reached = traverse.nearest(g.step("dfg") if edges is None else edges, seeds, hops, ("source_id",))
    flags = marks.groupBy(F.col("node_id").alias("id")).agg(*[F.max((F.col("role") == r).cast("int")).alias(r) for r in ("source", "barrier", "sink")])
    d = reached.join(flags, "id", "left").join(source, "source_id")
    label = F.when(F.col("source") == 1, "source").when(F.col("barrier") == 1, "sanitized").when(F.col("sink") == 1, "sink_reached").otherwise("propagated")
    return d.select(F.col("id").alias("node_id"), label.alias("label"), "source_id", "source_category", F.col("depth").alias("min_hops"))


def clean_hops(g: Graph, hops: int = HOPS) -> DataFrame:
    """node_id, source_id, hops: what a source reaches on a way that no barrier cuts, by the least such way.

    A walk may end at a barrier but doesn't go on from it; a source that is a barrier too is where its walk ends.
    """
    marks = kept(roles(g))
    barrier = marks.where("role = 'barrier'").select(F.col("node_id").alias("source"))
    seeds = marks.where("role = 'source'").select(F.col("node_id").alias("source_id"), F.col("node_id").alias("id")).distinct()
    reached = traverse.nearest(g.step("dfg").join(barrier, "source", "left_anti"), seeds, hops, ("source_id",))
    return reached.select(F.col("id").alias("node_id"), "source_id", F.col("depth").alias("hops"))


def unsanitized(g: Graph) -> DataFrame:
    """Q51 as it says: sinks that a source reaches at all, with the hops of the least way and of the least that no barrier cuts (null: all are cut)."""
    d = sinks_reached(g).join(clean_hops(g).select(F.col("node_id").alias("sink_id"), "source_id", F.col("hops").alias("clean_hops")), ["sink_id", "source_id"], "left")
    return d.select("source_id", "source_category", "sink_id", "min_hops", "clean_hops")


def state(g: Graph) -> DataFrame:
    """T30 of a graph."""
    return g.made("taint", TAINTED, lambda: flow_state(g))


def summary(g: Graph) -> DataFrame:
    """V17."""
    return state(g).groupBy("label", "source_category").agg(counted_as("node_count"))


def sinks_reached(g: Graph) -> DataFrame:
    """Sinks with the sources that reach them."""
    d = state(g).where("label = 'sink_reached'").withColumnRenamed("node_id", "sink_id")
    sink = g.of("call").select(F.col("id").alias("sink_id"), F.col("name").alias("sink_name"), "file", "line")
    source = g.of("call").select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    return d.join(sink, "sink_id").join(source, "source_id").select("source_id", "source_name", "source_category", "sink_id", "sink_name", "file", "line", "min_hops")


def index_sensitivity(g: Graph) -> DataFrame:
    """Nodes typed as maps or slices, and whether taint reaches them."""
    d = g.of("identifier", "local", "parameter", "field", "assign").where(like("type_info", "map[%", "[]%", "*map[%", "*[]%") & F.col("file").isNotNull())
    kind = F.when(like("type_info", "map[%", "*map[%"), "map").otherwise("slice")
    hit = state(g).select("node_id").distinct().withColumn("has_taint", F.lit(1).cast("long"))
    d = d.select(F.col("id").alias("node_id"), "kind", kind.alias("container_kind"), "type_info", "file", "line", F.col("parent_function").alias("function_id"))
    return d.join(hit, "node_id", "left").withColumn("has_taint", zero("has_taint").cast("long"))


def container_summary(g: Graph) -> DataFrame:
    """V18."""
    return index_sensitivity(g).groupBy("container_kind", "has_taint").agg(counted_as("count"))
