"""Dashboard tables T9-T21."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sqlcompat import at_least, cc, counted_as, like, listed, rounded, tally, zero
from ..graph import Graph
from ..plans import catalogue
from . import findings as rules
from . import views

# Complexity buckets: label, least and most as shown, most as met
BUCKETS = (
    ("1 (trivial)", 0, 1, 1),
    ("2-5 (simple)", 2, 5, 5),
    ("6-10 (moderate)", 6, 10, 10),
    ("11-20 (complex)", 11, 20, 20),
    ("21-50 (very complex)", 21, 50, 50),
    ("51+ (extreme)", 51, 999, None),
)
TOP = 50
HOTSPOTS = 200


def complexity_distribution(g: Graph) -> DataFrame:
    """Functions by complexity bucket."""
    struct = lambda b: F.struct(F.lit(b[0]).alias("bucket"), F.lit(b[1]).cast("long").alias("bucket_min"), F.lit(b[2]).cast("long").alias("bucket_max"))
    at = struct(BUCKETS[-1])
    for b in reversed(BUCKETS[:-1]):
        at = F.when(cc() <= b[3], struct(b)).otherwise(at)
    return g.metrics.where(cc() > 0).select(at.alias("b")).select("b.*").groupBy("bucket", "bucket_min", "bucket_max").agg(counted_as("function_count"))


def package_treemap(g: Graph) -> DataFrame:
    """functions' sizes by package with type and interface counts."""
    kinds = g.of("type_decl").join(g.having("type_kind", name="type_kind"), F.col("id") == F.col("node_id"), "left").where("package is not null")
    kinds = kinds.groupBy("package").agg(counted_as("type_count"), tally(F.col("type_kind") == "interface").alias("interface_count"))
    c = zero("cyclomatic_complexity")
    d = g.weighed.where("package is not null").groupBy("package")
    d = d.agg(F.count_distinct("file").alias("file_count"), F.count_distinct("id").alias("function_count"), F.sum(zero("loc")).alias("total_loc"), F.sum(c).alias("total_complexity"), rounded(F.avg(c), 1).alias("avg_complexity"), F.max(c).alias("max_complexity"))
    return d.join(kinds, "package", "left").withColumns({c: zero(c) for c in ("type_count", "interface_count")})


def _distribution(df: DataFrame, kind: str) -> DataFrame:
    d = df.groupBy(F.col("kind").alias(kind)).agg(counted_as("count"))
    total = d.agg(at_least(F.sum("count")).alias("total"))  # one row
    return d.crossJoin(F.broadcast(total)).select(kind, "count", rounded(100.0 * F.col("count") / F.col("total"), 2).alias("percentage"))


def edge_distribution(g: Graph) -> DataFrame:
    return _distribution(g.edges, "edge_kind")


def node_distribution(g: Graph) -> DataFrame:
    return _distribution(g.nodes, "node_kind")


def complexity_vs_loc(g: Graph) -> DataFrame:
    """T13."""
    return g.measured.where((cc() > 0) & (F.col("loc") > 0)).select("function_id", "name", "package", cc().alias("complexity"), "loc", "fan_in", "fan_out")


def totals(g: Graph) -> DataFrame:
    """Key and value (as text) of twenty totals, with the findings of the first stage."""
    k = F.col("kind")
    n = g.nodes.agg(
        F.count_distinct("package").alias("total_packages"), F.count_distinct("file").alias("total_files"), counted_as("total_nodes"),
        *[tally(k == kind).alias(name) for kind, name in (("function", "total_functions"), ("type_decl", "total_types"), ("go", "total_goroutine_launches"), ("defer", "total_defers"))],
    )
    e = g.edges.agg(counted_as("total_edges"), *[tally(k == kind).alias(f"total_{kind}_edges") for kind in ("call", "dfg", "cfg")])
    true = F.col("value").isin("1", "true")
    p = g.node_properties.where("key in ('type_kind', 'inlineable', 'heap_escapes')").agg(
        tally((F.col("key") == "type_kind") & (F.col("value") == "interface")).alias("total_interfaces"),
        tally((F.col("key") == "inlineable") & true).alias("inlineable_functions"), tally((F.col("key") == "heap_escapes") & true).alias("heap_escaping"),
    )
    m = g.metrics.agg(F.sum("loc").alias("total_loc"), rounded(F.avg(F.when(cc() > 0, cc())), 1).alias("avg_complexity"), F.max(cc()).alias("max_complexity"))
    f = rules.stage(g, 1).agg(counted_as("total_findings"))
    one = n.crossJoin(e).crossJoin(p).crossJoin(m).crossJoin(f)  # one row each
    one = one.withColumns({"total_queries": F.lit(catalogue.queries_by(1)), "total_views": F.lit(catalogue.views_by(1))})
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in one.columns])))


def top_functions(g: Graph, n: int = TOP) -> DataFrame:
    """The first ``n`` functions by each of four metrics.  Only they are ranked."""
    out = []
    for metric in ("complexity", "loc", "fan_in", "fan_out"):
        value = cc() if metric == "complexity" else F.col(metric)
        d = g.measured.where(value > 0).select("function_id", "name", "package", "file", value.cast("double").alias("value")).orderBy(F.desc("value"), "function_id").limit(n)
        rank = F.row_number().over(Window.orderBy(F.desc("value"), "function_id")).cast("long")  # over n rows
        out.append(d.select(F.lit(metric).alias("metric"), rank.alias("rank"), "function_id", "name", "package", "file", "value"))
    return reduce(DataFrame.unionByName, out)


def _maxima(d: DataFrame, **of: str) -> DataFrame:
    """One row: each maximum, 1 at least."""
    return F.broadcast(d.agg(*[at_least(F.max(c)).alias(n) for n, c in of.items()]))


def _by_node(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings by node, and the most of one node, findings without a node counted as one node's (1 at least)."""
    f = findings.groupBy(F.col("node_id").alias("id")).agg(counted_as("finding_count"))
    return f.where("id is not null"), F.broadcast(f.agg(F.greatest(F.coalesce(F.max("finding_count"), F.lit(1)), F.lit(1)).alias("max_findings")))


def hotspots(g: Graph, n: int = HOTSPOTS, findings: DataFrame | None = None) -> DataFrame:
    """Complexity 30, loc 20, fan-in 25, findings 25."""
    f, most = _by_node(rules.stage(g, 1) if findings is None else findings)
    d = g.measured.where(cc() > 0).join(f, "id", "left").withColumn("finding_count", zero("finding_count"))
    d = d.crossJoin(_maxima(g.metrics, max_cc="cyclomatic_complexity", max_loc="loc", max_in="fan_in")).crossJoin(most)  # one row each
    score = cc() / F.col("max_cc") * 30 + F.col("loc") / F.col("max_loc") * 20 + F.col("fan_in") / F.col("max_in") * 25 + F.col("finding_count") / F.col("max_findings") * 25
    d = d.select("function_id", "name", "package", "file", cc().alias("complexity"), "loc", "fan_in", "fan_out", "finding_count", rounded(score, 2).alias("hotspot_score"))
    return d.orderBy(F.desc("hotspot_score"), "function_id").limit(n)


def package_coupling(g: Graph) -> DataFrame:
    """T17."""
    return views.package_deps(g).select("source_package", "target_package", "call_count")


def error_chains(g: Graph) -> DataFrame:
    """Functions with wrapped errors; wraps and returns."""
    inside = g.nodes.where("parent_function is not null").select(F.col("id").alias("source"), F.col("parent_function").alias("function_id"))
    wraps = g.step("error_wrap").join(inside, "source").groupBy("function_id").agg(counted_as("error_wraps"))
    returns = g.of("return").groupBy(F.col("parent_function").alias("function_id")).agg(counted_as("error_returns"))
    d = g.functions.select(F.col("id").alias("function_id"), "name", "package").join(wraps, "function_id").join(returns, "function_id", "left")
    return d.select("function_id", "name", "package", "error_wraps", zero("error_returns").alias("error_returns"), F.lit(0).cast("long").alias("chain_depth"))


def file_heatmap(g: Graph, findings: DataFrame | None = None) -> DataFrame:
    """Complexity 40, loc 30, findings 30 by file; totals over function maxima, so a score can pass 100.

    Findings count for the file of their node, whatever its kind.
    """
    f, most = _by_node(rules.stage(g, 2) if findings is None else findings)
    by_file = g.nodes.where("file is not null").select("id", "file").join(f, "id").groupBy("file").agg(F.sum("finding_count").alias("finding_count"))
    d = views.complexity_by_file(g, "package").join(by_file, "file", "left").withColumn("finding_count", zero("finding_count"))
    d = d.crossJoin(_maxima(g.metrics, max_cc="cyclomatic_complexity", max_loc="loc")).crossJoin(most)  # one row each
    score = F.col("total_complexity") / F.col("max_cc") * 40 + F.col("total_loc") / F.col("max_loc") * 30 + F.col("finding_count") / F.col("max_findings") * 30
    return d.select("file", "package", "function_count", "total_loc", "total_complexity", "max_complexity", "avg_complexity", "finding_count", rounded(score, 2).alias("hotspot_score"))


def package_graph(g: Graph) -> DataFrame:
    """Package calls, two at least, without third-party packages."""
    d = package_coupling(g).where((F.col("call_count") >= 2) & ~like("source_package", "github.com/%", "golang.org/%") & ~like("target_package", "github.com/%", "golang.org/%"))
    return d.select(F.col("source_package").alias("source"), F.col("target_package").alias("target"), F.col("call_count").alias("weight"))


BRANCHES = ("if", "for", "switch", "select")
INSIDE = {"num_locals": ("local",), "num_calls": ("call",), "num_branches": BRANCHES, "num_returns": ("return",)}


def function_detail(g: Graph, findings: DataFrame | None = None, only: DataFrame | None = None) -> DataFrame:
    """A function's place, size, insides, findings, callers and callees; of all functions, or of those in ``only`` (id)."""
    of_these = lambda df, c: df if only is None else df.join(only.select(F.col("id").alias(c)), c, "left_semi")
    inside = of_these(g.of("local", "call", "return", *BRANCHES).where("parent_function is not null"), "parent_function").groupBy(F.col("parent_function").alias("id"))
    inside = inside.agg(*[tally(F.col("kind").isin(*kinds)).alias(c) for c, kinds in INSIDE.items()])
    f, _ = _by_node(of_these(rules.stage(g, 2) if findings is None else findings, "node_id"))
    names = lambda end: g.ends(of_these(g.step("call"), end), {"name": "caller"}, {"name": "callee"}, "function")
    callers = names("target").groupBy(F.col("target").alias("id")).agg(listed("caller").alias("callers"))
    callees = names("source").groupBy(F.col("source").alias("id")).agg(listed("callee").alias("callees"))
    d = of_these(g.weighed, "id")
    for more in (inside, f, callers, callees):
        d = d.join(more, "id", "left")
    of = {"complexity": "cyclomatic_complexity", **{c: c for c in ("loc", "fan_in", "fan_out", "num_params", *INSIDE, "finding_count")}}
    return d.select(F.col("id").alias("function_id"), "name", "package", "file", "line", "end_line", F.col("type_info").alias("signature"), *[zero(c).alias(n) for n, c in of.items()], "callers", "callees")
