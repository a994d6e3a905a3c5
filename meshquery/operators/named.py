"""Named queries Q1-Q63, each a function of a graph and its parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sqlcompat import counted_as, like, listed, rounded
from ..graph import Graph
from ..session import checkpointed
from . import dashboards, navigation, paths, protocols, taint, traverse, views
from .traverse import back, walk

CALLS = ("call",)
ARROW = " -> "


def seed(g: Graph, *ids: str) -> DataFrame:
    return g.spark.createDataFrame([(i,) for i in ids], "id string").coalesce(1)


def _described(g: Graph, d: DataFrame, *cols: str) -> DataFrame:
    return d.join(g.nodes.select("id", *cols), "id")


# --- traversals ----------------------------------------------------------------------------------------------


def backward_slice(g: Graph, node_id: str, depth: int = 20) -> DataFrame:
    """Q1, RG1: nodes that may have influenced a node, with all their columns."""
    d = traverse.nearest(back(g.step("dfg", "param_in")), seed(g, node_id), depth)
    return g.nodes.join(d.select("id"), "id", "left_semi").orderBy("file", "line", "id")


def forward_slice(g: Graph, node_id: str, depth: int = 20) -> DataFrame:
    """Q2, RG2: nodes that a node may influence, with all their columns."""
    d = traverse.nearest(g.step("dfg", "param_out"), seed(g, node_id), depth)
    return g.nodes.join(d.select("id"), "id", "left_semi").orderBy("file", "line", "id")


def call_chain(g: Graph, function_id: str, depth: int = 10) -> DataFrame:
    """Q3, RG3: functions on call paths without repeats, at each depth."""
    d = paths.ends(g.step(*CALLS), seed(g, function_id), depth)
    d = d.join(g.functions.select("id", "name", "package"), "id")
    return d.select("id", "name", "package", "depth").orderBy("depth", "name", "id")


def callers_of(g: Graph, function_id: str, depth: int = 5) -> DataFrame:
    """Q4, RG4."""
    d = walk(back(g.step(*CALLS)), seed(g, function_id), depth)
    return d.join(g.functions.select("id", "name", "package"), "id").select("id", "name", "package", "depth").orderBy("depth", "name", "id")


def scope_variables(g: Graph, block_id: str) -> DataFrame:
    """Q5, RG5: variables visible in a block: those of the block and of all scopes around it, with all their columns."""
    around = traverse.closure(g.step("scope"), seed(g, block_id))
    child = g.step("ast").join(around, F.col("source") == F.col("id"), "left_semi").select(F.col("target").alias("id"))
    return g.of("local", "parameter", "result").join(child, "id").orderBy("file", "line", "id")


def error_chain(g: Graph, function_id: str, depth: int = 10) -> DataFrame:
    """Q17, RG6: callees that return errors, level by level."""
    can = g.having("returns_error", "1").select("node_id")
    edges = g.step(*CALLS).join(can, F.col("target") == F.col("node_id"), "left_semi")
    d = walk(edges, seed(g, function_id), depth).join(g.functions.select("id", "name", F.col("package").alias("pkg")), "id")
    return d.select("id", "name", "pkg", "depth").orderBy("depth", "name", "id")


def data_flow_ends(g: Graph, source_id: str, depth: int = 15) -> DataFrame:
    """RG7: the ends of dfg paths without repeats by length, and how many paths lead there."""
    d = _described(g, paths.ends(g.step("dfg"), seed(g, source_id), depth), "name", "kind", "file", "line")
    return d.select("id", "name", "kind", "file", "line", "depth", "paths").orderBy("depth", "file", "line")


def data_flow_path(g: Graph, source_id: str, depth: int = 15) -> DataFrame:
    """Q18, RG7: the end of every dfg path without repeats; one row for each path.

    Paths are counted first, so only the result has a row for each; :func:`data_flow_ends` has one for each end and length.
    """
    d = _described(g, paths.repeated(paths.ends(g.step("dfg"), seed(g, source_id), depth), "paths"), "name", "kind", "file", "line")
    return d.select("id", "name", "kind", "file", "line", "depth").orderBy("depth", "file", "line")


def impact_analysis(g: Graph, function_id: str, depth: int = 8) -> DataFrame:
    """Q20, RG8."""
    d = walk(back(g.step(*CALLS)), seed(g, function_id), depth).join(g.functions.select("id", "name", "package", "file", "line"), "id")
    return d.select("id", "name", "package", "file", "line", "depth").orderBy("depth", "package", "name", "id")


def dependency_depth(g: Graph, depth: int = 20) -> DataFrame:
    """Q22, RG9: the greatest level at which each package is met, from packages nobody depends on."""
    deps = views.package_deps(g).select(F.col("source_package").alias("source"), F.col("target_package").alias("target"))
    deps = checkpointed(deps)  # read at every level
    roots = deps.select(F.col("source").alias("id")).distinct().join(deps, F.col("id") == F.col("target"), "left_anti")
    return walk(deps, roots, depth).groupBy(F.col("id").alias("package")).agg(F.max("depth").alias("max_depth")).orderBy(F.desc("max_depth"), "package")


def pathfinder(g: Graph, start: str, end: str, hops: int = 6, n: int = 10) -> DataFrame:
    """Q38, RG11: call paths without repeats from one function to another, the shortest ``n``."""
    return paths.shortest(g.step(*CALLS), seed(g, start), seed(g, end), hops, n, ARROW)


# --- lookups -------------------------------------------------------------------------------------------------


def interface_implementors(g: Graph, interface_id: str) -> DataFrame:
    """Q6."""
    d = g.step("implements").where(F.col("target") == interface_id).select(F.col("source").alias("id"))
    return g.of("type_decl").select("id", "name", "package", "file", "line").join(d, "id").orderBy("package", "name", "id")


def function_cfg(g: Graph, function_id: str) -> DataFrame:
    """Q7: a function's blocks with their successors and the labels of branches.

    A function's blocks are its ast children and those that name it as parent (the documented intent: producers give no
    ast edges to blocks).
    """
    child = g.step("ast").where(F.col("source") == function_id).select(F.col("target").alias("id"))
    blocks = g.of("basic_block")
    own = blocks.join(child, "id", "left_semi").unionByName(blocks.where(F.col("parent_function") == function_id)).distinct()
    own = own.select(F.col("id").alias("block_id"), F.col("name").alias("block_name"), F.col("line").alias("block_line"))
    to = blocks.select(F.col("id").alias("successor_id"), F.col("name").alias("successor_name"))
    label = g.edge_properties.where("edge_kind = 'cfg' and key = 'label'").select(F.col("source").alias("block_id"), F.col("target").alias("successor_id"), F.col("value").alias("branch_label"))
    e = g.step("cfg").select(F.col("source").alias("block_id"), F.col("target").alias("successor_id"))
    d = own.join(e, "block_id", "left").join(to, "successor_id", "left").join(label, ["block_id", "successor_id"], "left")
    return d.select("block_id", "block_name", "block_line", "successor_id", "successor_name", "branch_label").orderBy("block_line", "block_id")


def cross_package_calls(g: Graph) -> DataFrame:
    """Q8."""
    d = g.calls({"name": "caller", "package": "caller_pkg"}, {"name": "callee", "package": "callee_pkg"}).where("caller_pkg <> callee_pkg")
    return d.select("caller_pkg", "caller", "callee_pkg", "callee").orderBy("caller_pkg", "callee_pkg")


def context_propagation(g: Graph) -> DataFrame:
    """Q9: calls by functions that take a context, and whether the callee takes one too."""
    has = g.having("has_context", "1").select("node_id").distinct()
    given = has.select(F.col("node_id").alias("target"), F.lit("propagated").alias("status"))
    of = lambda side: {"name": f"{side}_name", "package": f"{side}_pkg"}
    d = g.calls(of("caller"), of("callee")).join(has, F.col("source") == F.col("node_id"), "left_semi").join(given, "target", "left")
    status = F.coalesce("status", F.lit("MISSING")).alias("ctx_status")
    d = d.select(F.col("source").alias("caller_id"), "caller_name", "caller_pkg", F.col("target").alias("callee_id"), "callee_name", "callee_pkg", status)
    return d.orderBy(F.desc("ctx_status"), "caller_pkg", "caller_name")


def reaching_definitions(g: Graph, node_id: str) -> DataFrame:
    """Q10: definitions one step before."""
    d = g.step("dfg").where(F.col("target") == node_id).select(F.col("source").alias("id"))
    return _described(g, d, "name", "kind", "file", "line", "type_info").orderBy("file", "line", "id")


def package_dependencies(g: Graph) -> DataFrame:
    """Q11: V5 with the heaviest first."""
    return views.package_deps(g).orderBy(F.desc("call_count"), "source_package", "target_package")


def goroutine_analysis(g: Graph) -> DataFrame:
    """Q12: go statements, how their function synchronises, and how many it has."""
    gos = g.of("go").where("parent_function is not null")
    count = gos.groupBy(F.col("parent_function").alias("fid")).agg(counted_as("goroutine_count"))
    inside = g.nodes.select(F.col("id").alias("node_id"), F.col("parent_function").alias("fid"))
    sync = g.having("sync_kind").join(inside, "node_id").groupBy("fid").agg(listed("value").alias("sync_primitives"))
    fn = g.functions.select(F.col("id").alias("fid"), F.col("name").alias("fn"))
    d = gos.select(F.col("id").alias("go_id"), "file", "line", F.col("parent_function").alias("fid")).join(fn, "fid").join(count, "fid").join(sync, "fid", "left")
    return d.select("go_id", "file", "line", F.col("fn").alias("parent_function"), "sync_primitives", "goroutine_count").orderBy(F.desc("goroutine_count"), "parent_function", "go_id")


def taint_analysis(g: Graph) -> DataFrame:
    """Q13: calls with a role, a row for each of their categories."""
    call = g.of("call").select(F.col("id").alias("node_id"), "name", "file", "line", "parent_function")
    fn = g.functions.select(F.col("id").alias("parent_function"), F.col("name").alias("function_name"))
    d = taint.roles(g).join(call, "node_id").join(taint.categories(g), "node_id", "left").join(fn, "parent_function", "left")
    return d.select(F.col("node_id").alias("id"), "name", "file", "line", "parent_function", F.col("role").alias("taint_role"), F.coalesce("category", F.lit("")).alias("taint_category"), "function_name").orderBy("taint_role", "file", "line", "id")


def taint_path(g: Graph) -> DataFrame:
    """Q14: functions with both a source and a sink, and their categories."""
    return taint.meeting(g).orderBy("package", "name", "id")


def function_io(g: Graph, function_id: str) -> DataFrame:
    """Q15."""
    return views.function_io(g).where(F.col("function_id") == function_id).orderBy(F.desc("io_kind"), "io_name")


def type_methods(g: Graph, receiver_type: str) -> DataFrame:
    """Q16."""
    return views.method_sets(g).where(F.col("receiver_type") == receiver_type).select("id", "name", "file", "line", "type_info", "complexity", "loc").orderBy("name", "id")


def _both(g: Graph, near: str, far: str, a: str, b: str) -> DataFrame:
    of = lambda x: g.step(*CALLS).where(F.col(far) == x).select(F.col(near).alias("id"))
    d = g.functions.select("id", "name", "package", "file", "line").join(of(a), "id", "left_semi").join(of(b), "id", "left_semi")
    return d.orderBy("package", "name", "id")


def shared_callers(g: Graph, function_a: str, function_b: str) -> DataFrame:
    """Q19."""
    return _both(g, "source", "target", function_a, function_b)


def common_callee(g: Graph, function_a: str, function_b: str) -> DataFrame:
    """Q21."""
    return _both(g, "target", "source", function_a, function_b)


def risk_ranking(g: Graph, n: int = 50) -> DataFrame:
    """Q23: the first of F16's findings, their details as columns."""
    from . import findings

    fields = "risk_score double, complexity long, loc long, fan_in long, fan_out long, package string"
    d = findings.stage(g, 1).where("category = 'risk_score'").withColumn("d", F.from_json("details", fields))
    return d.select("node_id", "file", "line", "message", "d.*").orderBy(F.desc("risk_score"), "node_id").limit(n)


def package_stability(g: Graph) -> DataFrame:
    """Q24: with the distance from the main sequence."""
    distance = rounded(F.abs(F.col("instability") + F.col("abstractness") - 1.0), 3).alias("distance_from_main_seq")
    return views.package_stability(g).select("package", "afferent_coupling", "efferent_coupling", "instability", "total_types", "interface_count", "abstractness", distance).orderBy(F.desc("distance_from_main_seq"), "package")


def control_profile(g: Graph, function_id: str) -> DataFrame:
    """Q25."""
    return views.control_flow_profile(g).where(F.col("function_id") == function_id)


def similar_functions(g: Graph, function_id: str, within: int = 5) -> DataFrame:
    """Q26: of equal complexity and parameters, lines within five."""
    d = g.measured.select("id", "name", "package", "file", "line", F.col("cyclomatic_complexity").alias("complexity"), "loc", "num_params")
    one = F.broadcast(d.where(F.col("id") == function_id).select(F.col("complexity").alias("c"), F.col("num_params").alias("p"), F.col("loc").alias("l")))  # one row
    d = d.join(one, (F.col("complexity") == F.col("c")) & (F.col("num_params") == F.col("p"))).withColumn("apart", F.abs(F.col("loc") - F.col("l")))
    d = d.where((F.col("apart") <= within) & (F.col("id") != function_id)).orderBy("apart", "package", "name", "id")
    return d.select("id", "name", "package", "file", "line", "complexity", "loc", "num_params")


def cohesion(g: Graph) -> DataFrame:
    """Q27: V13, the least cohesive first."""
    return views.package_cohesion(g).orderBy("cohesion_ratio", "package")


def concurrency(g: Graph) -> DataFrame:
    """Q28: V14, the most goroutines first."""
    return views.concurrency_profile(g).orderBy(F.desc("goroutine_launches"), "package")


def package_impact(g: Graph) -> DataFrame:
    """Q29: V15, the farthest reaching first."""
    return views.package_reach(g).orderBy(F.desc("packages_affected"), "package")


def neighborhood(g: Graph, function_id: str) -> DataFrame:
    """Q30: callers and callees."""
    e = g.step(*CALLS)
    came = e.where(F.col("target") == function_id).select(F.lit("caller").alias("direction"), F.col("source").alias("id"))
    went = e.where(F.col("source") == function_id).select(F.lit("callee").alias("direction"), F.col("target").alias("id"))
    d = g.functions.select("id", "name", "package", "file", "line").join(came.unionByName(went), "id")
    return d.select("direction", "id", "name", "package", "file", "line").orderBy("direction", "name", "id")


def file_complexity(g: Graph) -> DataFrame:
    """Q31."""
    d = views.complexity_by_file(g).select("file", "function_count", "total_complexity", "max_complexity", "avg_complexity", "total_loc")
    return d.orderBy(F.desc("total_complexity"), "file")


def type_usage(g: Graph, type_name: str) -> DataFrame:
    """Q32: functions whose signature or parameters and results name a type.  A union of ids, not a disjunction."""
    pattern = f"%{type_name}%"
    io = g.of("parameter", "result").where(like("type_info", pattern)).select(F.col("id").alias("target"))
    inside = g.step("ast").join(io, "target", "left_semi").select(F.col("source").alias("id"))
    hit = g.functions.where(like("type_info", pattern)).select("id").union(inside).distinct()
    return g.functions.select("id", "name", "package", "file", "line", "type_info").join(hit, "id", "left_semi").orderBy("package", "name", "id")


def hotspot_analysis(g: Graph, n: int = 20) -> DataFrame:
    """Q33."""
    return dashboards.hotspots(g, n).select("function_id", "name", "package", "complexity", "fan_in", "finding_count", "hotspot_score")


def coupling_matrix(g: Graph, n: int = 50) -> DataFrame:
    """Q34."""
    return dashboards.package_coupling(g).orderBy(F.desc("call_count"), "source_package", "target_package").limit(n)


def error_propagation(g: Graph, n: int = 30) -> DataFrame:
    """Q35."""
    return dashboards.error_chains(g).drop("chain_depth").orderBy(F.desc("error_wraps"), "function_id").limit(n)


def top_by_metric(g: Graph, metric: str = "complexity") -> DataFrame:
    """Q36."""
    return dashboards.top_functions(g).where(F.col("metric") == metric).select("rank", "function_id", "name", "package", "value").orderBy("rank")


def coupling_degree(g: Graph) -> DataFrame:
    """Q37: packages by how many they call and how often."""
    d = dashboards.package_coupling(g).groupBy("source_package").agg(F.count_distinct("target_package").alias("coupled_to"), F.sum("call_count").alias("total_calls"))
    return d.orderBy(F.desc("coupled_to"), "source_package")


def file_heatmap(g: Graph) -> DataFrame:
    """Q39."""
    d = dashboards.file_heatmap(g).select("file", "package", "total_complexity", "total_loc", "finding_count", "hotspot_score")
    return d.orderBy(F.desc("hotspot_score"), "file", "package")


def package_graph(g: Graph) -> DataFrame:
    """Q40: T20, the heaviest first."""
    return dashboards.package_graph(g).orderBy(F.desc("weight"), "source", "target")


def function_detail(g: Graph, id: str) -> DataFrame:
    """Q41."""
    return dashboards.function_detail(g).where(F.col("function_id") == id)


def interface_map(g: Graph, name: str) -> DataFrame:
    """Q42."""
    return navigation.type_impl_map(g, name).select("concrete_name", "concrete_package", "method_count").orderBy("concrete_package", "concrete_name")


def type_hierarchy_tree(g: Graph, name: str) -> DataFrame:
    """Q43."""
    return navigation.type_hierarchy(g).where(F.col("type_name") == name).select("type_name", "type_package", "embedded_name", "embedded_package")


def method_set(g: Graph, name: str) -> DataFrame:
    """Q44."""
    return navigation.type_method_set(g).where(F.col("type_name") == name).select("method_name", "signature", "complexity", "loc").orderBy("method_name")


def _implemented(g: Graph, count: Column) -> DataFrame:
    d = navigation.type_impl_map(g).groupBy("interface_id", "interface_name", "interface_package").agg(count.alias("impl_count"))
    return d.orderBy(F.desc("impl_count"), "interface_id").select("interface_name", "interface_package", "impl_count")


def largest_interfaces(g: Graph) -> DataFrame:
    """Q45: interfaces by their implementations."""
    return _implemented(g, F.count(F.lit(1)))


def most_implemented(g: Graph, n: int = 20) -> DataFrame:
    """Q46: the first of them by distinct types."""
    return _implemented(g, F.count_distinct("concrete_id")).limit(n)


def symbol_search(g: Graph, pattern: str, n: int = 50) -> DataFrame:
    """Q47: symbols whose name is LIKE a pattern."""
    return navigation.symbol_index(g).where(like("name", pattern)).select("id", "name", "kind", "package", "file", "line").orderBy("kind", "name", "id").limit(n)


def file_outline(g: Graph, file: str) -> DataFrame:
    """Q48."""
    return navigation.file_outline(g).where(F.col("file") == file).select("name", "kind", "line", "end_line", "signature", "depth").orderBy("line", "name")


def xref_lookup(g: Graph, id: str) -> DataFrame:
    """Q49."""
    return navigation.xrefs(g).where(F.col("def_id") == id).select("use_file", "use_line", "use_kind").orderBy("use_file", "use_line")


def go_patterns(g: Graph) -> DataFrame:
    """Q50: T28, the most goroutines first."""
    return navigation.go_patterns(g).orderBy(F.desc("goroutine_count"), "package")


def taint_path_to_sink(g: Graph) -> DataFrame:
    """Q51: sinks reached, with names of both ends."""
    return taint.sinks_reached(g).orderBy("min_hops", "source_id", "sink_id")


def tainted_containers(g: Graph) -> DataFrame:
    """Q52."""
    d = taint.index_sensitivity(g).where("has_taint = 1").join(g.nodes.select(F.col("id").alias("node_id"), "name"), "node_id")
    return d.select("node_id", "container_kind", "type_info", "file", "line", "name").orderBy("file", "line", "node_id")


def scip_lookup(g: Graph, pattern: str) -> DataFrame:
    """Q53: symbols whose display name is LIKE a pattern."""
    d = navigation.scip_symbols(g).where(like("display_name", pattern)).join(g.of("function", "type_decl", "package").select(F.col("id").alias("node_id"), "file", "line"), "node_id")
    return d.select("scip_id", "kind", "display_name", "file", "line").orderBy("kind", "display_name", "scip_id")


def full_topology(g: Graph) -> DataFrame:
    """Q54."""
    flow = F.concat(F.lit(" "), "direction", F.lit(" "), "target_component").alias("flow")
    return protocols.topology(g).select("source_component", flow, "protocol_name", "transport", "encoding", "session_type_client")


def adapter_flow(g: Graph, component: str = "adapter") -> DataFrame:
    """Q55: a component's links with those that lead to it."""
    d = protocols.topology(g)
    out = d.where(F.col("source_component") == component).select("source_component", "target_component", F.col("protocol_name").alias("name"))
    came = d.select(F.col("source_component").alias("upstream"), F.col("target_component").alias("downstream"), F.col("protocol_name").alias("upstream_protocol"))
    return out.join(came, F.col("source_component") == F.col("downstream"))


def protocol_endpoints(g: Graph) -> DataFrame:
    """Q56."""
    location = F.concat("file", F.lit(":"), "line").alias("location")
    return protocols.endpoints(g).select("protocol_id", "component", "role", "function_name", "package", location, "url_path").orderBy("protocol_id", "component", "function_name")


def conformance_report(g: Graph) -> DataFrame:
    """Q57."""
    return protocols.conformance(g).select("protocol_id", "component", "status", "endpoints_found", "details").orderBy(F.desc("status"), "protocol_id", "component")


def deadlock_check(g: Graph, c: DataFrame | None = None) -> DataFrame:
    """Q58: chains of two causal pairs that don't come back."""
    c = protocols.causality(g) if c is None else c
    a = c.select(F.col("kind").alias("first"), F.col("source_endpoint").alias("start"), F.col("target_endpoint").alias("via"), "description")
    b = c.select(F.col("kind").alias("second"), F.col("source_endpoint").alias("via"), F.col("target_endpoint").alias("stop"), F.col("description").alias("next_description"))
    return a.join(b, "via").where("start <> stop").select(F.concat_ws(" → ", "first", "second").alias("causality_chain"), "description", "next_description")


def channel_patterns(g: Graph) -> DataFrame:
    """Q59."""
    return protocols.channel_patterns(g).select("pattern", "channel_type", "sender_package", "receiver_package", "goroutine_count", "description").orderBy("pattern", "sender_package")


def association_report(g: Graph) -> DataFrame:
    """Q60."""
    return protocols.association_summary(g).select("protocol_id", "verdict", "projection_coverage", "subtype_status", "dependency_graph", "s_safe", "s_deadlock_free", "s_live")


def subtype_violations(g: Graph) -> DataFrame:
    """Q61."""
    return protocols.subtype_check(g).where("is_conforming = 0").select("protocol_id", "component", "projected_type", "actual_behavior", "relation", "explanation")


def deadlock_detection(g: Graph, c: DataFrame | None = None) -> DataFrame:
    """Q62: cycles that may block."""
    d = protocols.dependency_cycles(protocols.causality(g) if c is None else c)
    return d.where("severity in ('deadlock', 'deadlock_risk')").drop("involved_protocols")


def errata(g: Graph) -> DataFrame:
    """Q63: protocols whose association holds."""
    return protocols.association(g).where("is_associated = 1").select("protocol_id", "errata_reference", "s_safe", "s_deadlock_free", "s_live")


@dataclass(frozen=True)
class Query:
    """A named query: its function, the names of its parameters and what it answers."""

    run: object
    parameters: tuple[str, ...] = ()
    about: str = ""


def _about(f) -> str:
    return (f.__doc__ or "").split("\n")[0].split(": ", 1)[-1]


_PLAIN = {
    "backward_slice": (backward_slice, "node_id"), "forward_slice": (forward_slice, "node_id"), "call_chain": (call_chain, "function_id"), "callers_of": (callers_of, "function_id"),
    "scope_variables": (scope_variables, "block_id"), "interface_implementors": (interface_implementors, "interface_id"), "function_cfg": (function_cfg, "function_id"), "cross_package_calls": (cross_package_calls,),
    "context_propagation": (context_propagation,), "reaching_definitions": (reaching_definitions, "node_id"), "package_dependency_graph": (package_dependencies,), "goroutine_analysis": (goroutine_analysis,),
    "taint_analysis": (taint_analysis,), "taint_path": (taint_path,), "function_io": (function_io, "function_id"), "type_methods": (type_methods, "receiver_type"), "error_chain": (error_chain, "function_id"),
    "data_flow_path": (data_flow_path, "source_id"), "shared_callers": (shared_callers, "function_a", "function_b"), "impact_analysis": (impact_analysis, "function_id"), "common_callee": (common_callee, "function_a", "function_b"),
    "dependency_depth": (dependency_depth,), "function_risk_ranking": (risk_ranking,), "package_stability": (package_stability,), "function_control_profile": (control_profile, "function_id"),
    "similar_functions": (similar_functions, "function_id"), "package_cohesion": (cohesion,), "concurrency_profile": (concurrency,), "package_impact": (package_impact,),
    "function_neighborhood": (neighborhood, "function_id"), "file_complexity_heatmap": (file_complexity,), "type_usage": (type_usage, "type_name"),
    "hotspot_analysis": (hotspot_analysis,), "package_coupling_matrix": (coupling_matrix,), "error_propagation": (error_propagation,), "top_functions_by_metric": (top_by_metric, "metric"),
    "package_coupling_degree": (coupling_degree,), "call_chain_pathfinder": (pathfinder, "start", "end"), "file_heatmap": (file_heatmap,), "package_graph": (package_graph,),
    "function_detail": (function_detail, "id"), "interface_map": (interface_map, "name"), "type_hierarchy_tree": (type_hierarchy_tree, "name"), "method_set": (method_set, "name"),
    "largest_interfaces": (largest_interfaces,), "most_implemented": (most_implemented,), "symbol_search": (symbol_search, "pattern"), "file_outline_query": (file_outline, "file"), "xref_lookup": (xref_lookup, "id"),
    "go_patterns": (go_patterns,), "taint_path_to_sink": (taint_path_to_sink,), "tainted_containers": (tainted_containers,), "scip_lookup": (scip_lookup, "pattern"),
    "comm_full_topology": (full_topology,), "comm_adapter_flow": (adapter_flow,), "comm_protocol_endpoints": (protocol_endpoints,), "comm_conformance_report": (conformance_report,), "comm_deadlock_check": (deadlock_check,),
    "comm_channel_patterns": (channel_patterns,), "honda_association_report": (association_report,), "honda_subtype_violations": (subtype_violations,), "honda_deadlock_detection": (deadlock_detection,), "honda_errata_summary": (errata,),
}
QUERIES: dict[str, Query] = {name: Query(f, tuple(p), _about(f)) for name, (f, *p) in _PLAIN.items()}


def run(g: Graph, query: str, /, **params: str) -> DataFrame:
    """A named query by its name."""
    q = QUERIES[query]
    missing = [p for p in q.parameters if p not in params and p != "metric"]
    if missing:
        raise ValueError(f"{query} needs {', '.join(missing)}")
    return q.run(g, **params)
