"""Views over a graph: V1-V16, the statistics tables and derived edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sqlcompat import at_least, counted_as, exported, number, rounded, tally, zero
from ..graph import Graph
from ..plans import specs
from . import traverse

def _as(prefix: str, *columns: str) -> dict[str, str]:
    return {c: f"{prefix}_{c}" for c in columns}


def call_graph(g: Graph) -> DataFrame:
    """V1: call edges with both ends' names; is_dynamic is 1 where the edge has that property."""
    flag = g.edge_properties.where("edge_kind = 'call' and key = 'dynamic'").select("source", "target", F.lit(1).alias("dynamic")).distinct()
    d = g.calls(_as("caller", "name", "package"), _as("callee", "name", "package")).join(flag, ["source", "target"], "left")
    return d.select(F.col("source").alias("caller_id"), "caller_name", "caller_package", F.col("target").alias("callee_id"), "callee_name", "callee_package", zero("dynamic").cast("long").alias("is_dynamic"))


def data_flow(g: Graph) -> DataFrame:
    """V2: dfg edges, definition and use."""
    place = ("name", "kind", "file", "line")
    d = g.ends(g.step("dfg"), _as("def", *place), _as("use", *place))
    return d.select(F.col("source").alias("def_id"), *_as("def", *place).values(), F.col("target").alias("use_id"), *_as("use", *place).values())


def function_summary(g: Graph) -> DataFrame:
    """V3: functions with metrics; loc falls back to the line span; calls in and out are counted."""
    calls = g.step("call")
    came = calls.groupBy(F.col("target").alias("id")).agg(counted_as("calls_in"))
    went = calls.groupBy(F.col("source").alias("id")).agg(counted_as("calls_out"))
    d = g.weighed.join(came, "id", "left").join(went, "id", "left")
    span = F.col("end_line") - F.col("line") + 1
    return d.select("id", "name", "package", "file", "line", "end_line", zero("cyclomatic_complexity").alias("complexity"), zero("fan_in").alias("fan_in"), zero("fan_out").alias("fan_out"), F.coalesce("loc", span).alias("loc"), zero("num_params").alias("num_params"), zero("calls_out").alias("calls_out"), zero("calls_in").alias("calls_in"))


def type_relations(g: Graph) -> DataFrame:
    """V4: implements, embeds and alias_of with names and packages."""
    d = g.ends(g.along("implements", "embeds", "alias_of"), _as("type", "name", "package"), _as("target", "name", "package"), "type_decl")
    return d.select(F.col("source").alias("type_id"), "type_name", "type_package", F.col("kind").alias("relationship"), F.col("target").alias("target_id"), "target_name", "target_package")


def package_deps(g: Graph) -> DataFrame:
    """V5: calls between packages."""
    d = g.calls({"package": "source_package"}, {"package": "target_package"}).where("source_package <> target_package")
    return d.groupBy("source_package", "target_package").agg(counted_as("call_count"), F.count_distinct("source").alias("distinct_callers"), F.count_distinct("target").alias("distinct_callees"))


def file_deps(g: Graph) -> DataFrame:
    """V6: calls between files."""
    d = g.calls({"file": "source_file"}, {"file": "target_file"}).where("source_file <> target_file")
    return d.groupBy("source_file", "target_file").agg(counted_as("call_count"))


def _flag(key: str) -> Column:
    """A JSON true as 1, false as 0, null where there is none."""
    value = F.get_json_object("properties", f"$.{key}")
    return F.when(value == "true", 1).when(value == "false", 0).cast("long")


def function_io(g: Graph) -> DataFrame:
    """V7: parameters and results that are children of a function."""
    io = g.of("parameter", "result").select(F.col("id").alias("target"), F.col("name").alias("io_name"), F.col("kind").alias("io_kind"), F.col("type_info").alias("io_type"), _flag("mutable").alias("is_mutable"), _flag("nullable").alias("is_nullable"))
    fn = g.functions.select(F.col("id").alias("source"), F.col("name").alias("function_name"), "package")
    d = g.step("ast").join(io, "target").join(fn, "source")
    return d.select(F.col("source").alias("function_id"), "function_name", "package", F.col("target").alias("io_node_id"), "io_name", "io_kind", "io_type", "is_mutable", "is_nullable")


def api_surface(g: Graph) -> DataFrame:
    """V8: exported functions and types of packages."""
    return g.of("function", "type_decl").where(exported("name") & F.col("package").isNotNull()).select("package", "kind", "id", "name", "type_info", "file", "line")


def method_sets(g: Graph) -> DataFrame:
    """V9: methods by receiver."""
    d = g.weighed.join(g.having("receiver", name="receiver_type"), F.col("id") == F.col("node_id"))
    return d.select("receiver_type", "package", "id", "name", "type_info", "file", "line", zero("cyclomatic_complexity").alias("complexity"), zero("loc").alias("loc"))


def error_handling(g: Graph) -> DataFrame:
    """Functions that return an error, with their callers and callees counted."""
    d = g.weighed.join(g.having("returns_error", "1"), F.col("id") == F.col("node_id"))
    return d.select("id", "name", "package", "file", "line", zero("fan_in").alias("callers"), zero("fan_out").alias("callees"), zero("cyclomatic_complexity").alias("complexity"))


def package_stability(g: Graph) -> DataFrame:
    """Afferent and efferent coupling, instability (0.5 if isolated), abstractness."""
    deps = package_deps(g)
    ca = deps.groupBy(F.col("target_package").alias("package")).agg(F.count_distinct("source_package").alias("afferent_coupling"))
    ce = deps.groupBy(F.col("source_package").alias("package")).agg(F.count_distinct("target_package").alias("efferent_coupling"))
    face = g.having("type_kind", name="type_kind")
    types = g.of("type_decl").join(face, F.col("id") == F.col("node_id"), "left").where("package is not null").groupBy("package").agg(counted_as("total_types"), tally(F.col("type_kind") == "interface").alias("interface_count"))
    d = types.join(ca, "package", "full").join(ce, "package", "full")
    counts = ("afferent_coupling", "efferent_coupling", "total_types", "interface_count")
    d = d.select("package", *[zero(c).alias(c) for c in counts])
    ca_, ce_, n = F.col("afferent_coupling"), F.col("efferent_coupling"), F.col("total_types")
    instability = F.when(ca_ + ce_ == 0, 0.5).otherwise(rounded(ce_ / (ca_ + ce_), 3))
    abstractness = F.when(n == 0, 0.0).otherwise(rounded(F.col("interface_count") / n, 3))
    return d.select("package", "afferent_coupling", "efferent_coupling", instability.alias("instability"), "total_types", "interface_count", abstractness.alias("abstractness"))


PROFILE = ("if", "for", "switch", "select", "return", "defer", "go")


def control_flow_profile(g: Graph) -> DataFrame:
    """Statements by kind in each function."""
    inside = g.of(*PROFILE, "assign", "call", "send", "branch").where("parent_function is not null")
    n = inside.groupBy(F.col("parent_function").alias("function_id")).agg(*[tally(F.col("kind") == k).alias(f"{k}_count") for k in PROFILE], counted_as("total_statements"))
    fn = g.functions.select(F.col("id").alias("function_id"), F.col("name").alias("function_name"), "package")
    return fn.join(n, "function_id")


def package_cohesion(g: Graph) -> DataFrame:
    """Calls inside the package over all its calls between packages that are known."""
    d = g.calls({"package": "package"}, {"package": "other"}).where("package is not null and other is not null").groupBy("package")
    same = F.col("package") == F.col("other")
    d = d.agg(counted_as("total_calls"), tally(same).alias("internal_calls"), tally(~same).alias("external_calls"))
    fns = g.functions.where("package is not null").groupBy("package").agg(counted_as("func_count"))
    ratio = rounded(F.col("internal_calls") / at_least("total_calls"), 3).alias("cohesion_ratio")
    return d.join(fns, "package").select("package", "func_count", "total_calls", "internal_calls", "external_calls", ratio)


def concurrency_profile(g: Graph) -> DataFrame:
    """Go, send, select and defer statements and synchronising nodes of packages with one of the first three."""
    sync = g.nodes.where("package is not null").join(g.having("sync_kind"), F.col("id") == F.col("node_id")).groupBy("package").agg(counted_as("sync_primitives"))
    count = {"goroutine_launches": "go", "channel_sends": "send", "select_stmts": "select", "defer_stmts": "defer"}
    d = g.of(*count.values()).where("package is not null").groupBy("package").agg(*[tally(F.col("kind") == k).alias(c) for c, k in count.items()])
    d = d.where("goroutine_launches > 0 or channel_sends > 0 or select_stmts > 0").join(sync, "package", "left")
    return d.select("package", "goroutine_launches", "channel_sends", "select_stmts", zero("sync_primitives").alias("sync_primitives"), "defer_stmts")


def package_reach(g: Graph, depth: int = 10) -> DataFrame:
    """How many packages depend on each, directly or through others (the documented intent)."""
    deps = package_deps(g).select(F.col("source_package").alias("source"), F.col("target_package").alias("target"))
    seeds = deps.select(F.col("target").alias("package"), F.col("target").alias("id")).distinct()
    d = traverse.nearest(traverse.back(deps), seeds, depth, ("package",)).where("id <> package")
    return d.groupBy("package").agg(counted_as("packages_affected"), F.max("depth").alias("max_impact_depth"))


def complexity_by_file(g: Graph, *by: str) -> DataFrame:
    """Functions of each file (and ``by``), their sizes; the average is rounded as dashboards show it."""
    cc = zero("cyclomatic_complexity")
    d = g.weighed.where("file is not null").groupBy("file", *by)
    return d.agg(F.count_distinct("id").alias("function_count"), F.sum(zero("loc")).alias("total_loc"), F.sum(cc).alias("total_complexity"), F.max(cc).alias("max_complexity"), rounded(F.avg(cc), 1).alias("avg_complexity"))


def file_risk(g: Graph) -> DataFrame:
    """Complexity by file beside its history; each null counts as 1 in the score.  node_count: all nodes of the file."""
    every = g.nodes.where("file is not null").groupBy("file").agg(counted_as("node_count"))
    d = complexity_by_file(g).join(every, "file").join(g.history, "file", "left")
    one = lambda c: F.coalesce(c, F.lit(1))
    score = 0.3 * one("avg_complexity") + 0.2 * one("max_complexity") + 0.3 * one("commit_count") + 0.2 * one("author_count")
    return d.select("file", "node_count", "function_count", "avg_complexity", "max_complexity", "commit_count", "author_count", "churn", "last_author", "last_date", rounded(score, 2).alias("change_risk_score"))


# --- statistics ----------------------------------------------------------------------------------------------


def node_kinds(g: Graph) -> DataFrame:
    return g.nodes.groupBy("kind").agg(counted_as("count"))


def edge_kinds(g: Graph) -> DataFrame:
    return g.edges.groupBy("kind").agg(counted_as("count"))


def package_stats(g: Graph) -> DataFrame:
    """Files, functions, types and lines of functions by package; a package without any of them has zeros."""
    k = F.col("kind")
    of = {"files": "file", "functions": "function", "types": "type_decl"}
    span = F.when(k == "function", F.col("end_line") - F.col("line") + 1).otherwise(0)
    return g.nodes.where("package is not null").groupBy("package").agg(*[F.count_distinct(F.when(k == kind, F.col("id"))).alias(c) for c, kind in of.items()], F.sum(span).alias("loc"))


def overview(g: Graph) -> DataFrame:
    """Seven totals in one row."""
    k = F.col("kind")
    n = g.nodes.agg(counted_as("total_nodes"), F.count_distinct("package").alias("total_packages"), tally(k == "function").alias("total_functions"), tally(k == "type_decl").alias("total_types"))
    for name, d in (("total_edges", g.edges), ("total_files", g.sources), ("total_metrics", g.metrics)):
        n = n.crossJoin(d.agg(counted_as(name)))  # one row each
    return n.select("total_nodes", "total_edges", "total_files", "total_packages", "total_functions", "total_types", "total_metrics")


# --- derived edges -------------------------------------------------------------------------------------------

# Properties of edges that are guessed from what is known about a callee
HEURISTIC = '{"heuristic":true}'
SIDE_EFFECT = '{"heuristic":true,"side_effect":true}'


def _sites(g: Graph) -> tuple[DataFrame, DataFrame]:
    """(call, arg, index of every argument; call, package and name of every callee outside)."""
    index = g.edge_properties.where("edge_kind = 'argument' and key = 'index'")
    args = index.select(F.col("source").alias("call"), F.col("target").alias("arg"), number("value").alias("index"))
    callee = g.functions.where("id like 'ext::%'").select(F.col("id").alias("target"), F.col("package"), F.col("name").alias("func_name"))
    return args, g.step("call_site").join(callee, "target").select(F.col("source").alias("call"), "package", "func_name")


def flows_to_result(g: Graph) -> DataFrame:
    """Argument to call where the callee's outside and its result depends on that argument; each with its properties, as D2 and D3."""
    args, outside = _sites(g)
    spec = F.broadcast(specs.flows(g.spark).drop("description").where("flow_to like 'return:%'"))
    d = outside.join(spec, ["package", "func_name"]).join(args, "call")
    hit = (F.col("flow_from") == "arg:*") | (F.col("flow_from") == F.concat(F.lit("arg:"), "index"))
    return d.where(hit).select(F.col("arg").alias("source"), F.col("call").alias("target"), F.lit(HEURISTIC).alias("properties")).distinct()


def flows_to_argument(g: Graph) -> DataFrame:
    """Argument to argument where the callee writes one from the other, or from all."""
    args, outside = _sites(g)
    spec = F.broadcast(specs.flows(g.spark).drop("description").where("flow_from like 'arg:%' and flow_to like 'arg:%'"))
    d = outside.join(spec, ["package", "func_name"])
    from_ = args.select("call", F.col("arg").alias("source"), F.explode(F.array(F.concat(F.lit("arg:"), "index"), F.lit("arg:*"))).alias("flow_from"))
    to = args.select("call", F.col("arg").alias("target"), F.concat(F.lit("arg:"), "index").alias("flow_to"))
    return d.join(from_, ["call", "flow_from"]).join(to, ["call", "flow_to"]).select("source", "target", F.lit(SIDE_EFFECT).alias("properties")).distinct()


def flows_by_default(g: Graph) -> DataFrame:
    """D3: every argument to the call where nothing is known about the callee."""
    args, outside = _sites(g)
    known = F.broadcast(specs.flows(g.spark).select("package", "func_name").distinct())
    return outside.join(known, ["package", "func_name"], "left_anti").join(args, "call").select(F.col("arg").alias("source"), F.col("call").alias("target"), F.lit(HEURISTIC).alias("properties")).distinct()


def argument_order(g: Graph) -> DataFrame:
    """Each argument to the next of its call."""
    args, _ = _sites(g)
    after = args.select("call", (F.col("index") - 1).alias("index"), F.col("arg").alias("target"))
    return args.join(after, ["call", "index"]).select(F.col("arg").alias("source"), "target", F.lit(None).cast("string").alias("properties")).distinct()


def last_arguments(g: Graph) -> DataFrame:
    """A call's last argument to the call."""
    args, _ = _sites(g)
    last = args.groupBy("call").agg(F.max("index").alias("index"))
    return args.join(last, ["call", "index"]).select(F.col("arg").alias("source"), F.col("call").alias("target"), F.lit('{"final":true}').alias("properties")).distinct()


def evaluation_order(g: Graph) -> DataFrame:
    """The eog edges."""
    return argument_order(g).unionByName(last_arguments(g)).withColumn("kind", F.lit("eog"))


def flows(g: Graph) -> DataFrame:
    """The derived dfg edges."""
    return flows_to_result(g).unionByName(flows_to_argument(g)).unionByName(flows_by_default(g)).withColumn("kind", F.lit("dfg"))


def with_flows(g: Graph) -> Graph:
    """The graph with the derived dfg edges."""
    return g.but(edges=g.edges.unionByName(flows(g)))
