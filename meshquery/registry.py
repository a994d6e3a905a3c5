"""Queries by name: each is an analysis of the order tables' graph, with its SQL in :mod:`meshquery.oracle`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import registry_more
from .functions.sqlcompat import counted_as
from .graph import Graph
from .operators import dashboards, named, navigation, paths, protocols, taint, traverse, views
from .operators import findings as f
from .oracle import findings as findings_sql
from .oracle import more as more_sql
from .oracle import named as named_sql
from .oracle import protocols as protocols_sql
from .oracle import tables as tables_sql
from .oracle import views as views_sql
from .plans import specs
from .plans.carrier import build, stored
from .session import ship

ANALYSES: dict[str, Callable[[Graph], DataFrame]] = {
    "V01_call_graph": views.call_graph,
    "V02_data_flow": views.data_flow,
    "V03_function_summary": views.function_summary,
    "V04_type_relations": views.type_relations,
    "V05_package_deps": views.package_deps,
    "V06_file_deps": views.file_deps,
    "V07_function_io": views.function_io,
    "V08_api_surface": views.api_surface,
    "V09_method_sets": views.method_sets,
    "V10_error_handling": views.error_handling,
    "V11_package_stability": views.package_stability,
    "V12_control_flow_profile": views.control_flow_profile,
    "V13_package_cohesion": views.package_cohesion,
    "V14_concurrency_profile": views.concurrency_profile,
    "V15_package_reach": views.package_reach,
    "V16_file_risk": views.file_risk,
    "T01_node_kinds": views.node_kinds,
    "T01_edge_kinds": views.edge_kinds,
    "T02_package_stats": views.package_stats,
    "T03_overview": views.overview,
    "T04_node_properties": lambda g: g.node_properties,
    "T04_edge_properties": lambda g: g.edge_properties,
    "D01_flows_to_result": views.flows_to_result,
    "D02_flows_to_argument": views.flows_to_argument,
    "D03_flows_by_default": views.flows_by_default,
    "D05_argument_order": views.argument_order,
    "D06_last_argument": views.last_arguments,
    "S21_validate": lambda g: g.validate(),
    "T07_taint_annotations": taint.annotations,
    "T11_findings_summary": f.summary,
    "T30_flow_state": taint.state,
    "T30_unsanitized": taint.unsanitized,
    "T31_index_sensitivity": taint.index_sensitivity,
    "V17_taint_summary": taint.summary,
    "V18_container_summary": taint.container_summary,
    "T09_complexity_distribution": dashboards.complexity_distribution,
    "T10_package_treemap": dashboards.package_treemap,
    "T12_edge_distribution": dashboards.edge_distribution,
    "T12_node_distribution": dashboards.node_distribution,
    "T13_complexity_vs_loc": dashboards.complexity_vs_loc,
    "T14_totals": dashboards.totals,
    "T15_top_functions": dashboards.top_functions,
    "T16_hotspots": dashboards.hotspots,
    "T17_package_coupling": dashboards.package_coupling,
    "T18_error_chains": dashboards.error_chains,
    "T19_file_heatmap": dashboards.file_heatmap,
    "T20_package_graph": dashboards.package_graph,
    "T21_function_detail": dashboards.function_detail,
    "T22_type_impl_map": navigation.type_impl_map,
    "T23_type_hierarchy": navigation.type_hierarchy,
    "T24_type_method_set": navigation.type_method_set,
    "T25_symbol_index": navigation.symbol_index,
    "T26_file_outline": navigation.file_outline,
    "T27_xrefs": navigation.xrefs,
    "T28_go_patterns": navigation.go_patterns,
    "T29_file_history": lambda g: g.history,
    "T32_scip_symbols": navigation.scip_symbols,
    "F01_complexity": f.complexity,
    "F02_size": f.size,
    "F03_nesting": f.nesting,
    "F04_hub": f.hub,
    "F05_dead_store": f.dead_store,
    "F06_unused_param": f.unused_param,
    "F07_circular_dep": f.circular_dep,
    "F08_goroutine_spawner": f.goroutine_spawner,
    "F09_unused_export": f.unused_export,
    "F10_long_param_list": f.long_param_list,
    "F10b_many_params": f.many_params,
    "F11_god_function": f.god_function,
    "F12_interface_coupling": f.interface_coupling,
    "F13_concurrency_risk": f.concurrency_risk,
    "F14_recursive": f.recursive,
    "F15_taint_hotspot": f.taint_hotspot,
    "F16_risk_score": f.risk_score,
    "F17_dead_code": f.dead_code,
    "F18_interface_bloat": f.interface_bloat,
    "F19_similar_function": f.similar_function,
    "F20_missing_context_first": f.missing_context_first,
    "F21_large_return": f.large_return,
    "F22_bool_params": f.bool_params,
    "F23_panic_call": f.panic_call,
    "F24_god_package": f.god_package,
    "F25_high_coupling": f.high_coupling,
    "F26_large_interface": f.large_interface,
    "F27_orphan_type": f.orphan_type,
    "F28_high_churn_complexity": f.high_churn_complexity,
    "F29_unsanitized_sink": f.unsanitized_sink,
    "F30_tainted_container": f.tainted_container,
    "T34_endpoints": protocols.endpoints,
    "T35_channel_patterns": protocols.channel_patterns,
    "T36_causality": protocols.causality,
    "T37_conformance": protocols.conformance,
    "T38_subtype_check": protocols.subtype_check,
    "T39_dependency_cycles": lambda g: protocols.dependency_cycles(protocols.causality(g)),
    "T40_association": protocols.association,
    "V20_protocol_coverage": protocols.coverage,
    "V21_comm_endpoint_detail": protocols.endpoint_detail,
    "V23_causality_summary": protocols.causality_summary,
    "V24_association_summary": protocols.association_summary,
    "V25_subtype_detail": protocols.subtype_detail,
    "V26_dependency_cycles": protocols.cycles,
}


# --- seeds of the named queries, chosen from the data ----------------------------------------------------------


def _value(d: DataFrame) -> str:
    return d.first()[0]


def _most(edges: DataFrame, end: str) -> str:
    """The node with the most of some edges at one end."""
    return _value(edges.groupBy(end).count().orderBy(F.desc("count"), end).select(end).limit(1))


def _caller(g: Graph) -> str:
    return _value(g.step("call").agg(F.min("source")))


def _busiest(g: Graph) -> str:
    return _most(g.step("call"), "source")


def _called(g: Graph) -> str:
    return _most(g.step("call"), "target")


def _beside(g: Graph, near: str, far: str, node: str) -> tuple[str, str]:
    """The least and the greatest neighbour of a node by calls."""
    row = g.step("call").where(F.col(far) == node).agg(F.min(near), F.max(near)).first()
    return row[0], row[1]


def _end(g: Graph) -> str:
    first = _caller(g)
    via = g.step("call").where(F.col("source") == first).select(F.col("target").alias("via"))
    return _value(g.step("call").join(via, F.col("source") == F.col("via")).where(F.col("target") != first).agg(F.min("target")))


def _first(g: Graph, kind: str, end: str = "source", last: bool = False) -> str:
    return _value(g.step(kind).agg((F.max if last else F.min)(end)))


def _formal(g: Graph) -> str:
    return _most(g.step("param_in"), "target")


def _returning(g: Graph) -> str:
    return _most(g.step("param_out"), "source")


def _failing(g: Graph) -> str:
    can = g.having("returns_error", "1")
    return _most(g.step("call").join(can, F.col("target") == F.col("node_id"), "left_semi"), "source")


def _face(g: Graph) -> str:
    """The name of the least interface that is implemented."""
    return _value(g.of("type_decl").where(F.col("id") == _first(g, "implements", "target")).select("name"))


def _with_blocks(g: Graph) -> str:
    return _value(g.of("basic_block").join(g.step("cfg"), F.col("id") == F.col("source"), "left_semi").agg(F.min("parent_function")))


NAMED: dict[str, tuple[str, Callable[[Graph], dict[str, str]]]] = {
    "Q01_backward_slice": ("backward_slice", lambda g: {"node_id": _formal(g)}),
    "Q02_forward_slice": ("forward_slice", lambda g: {"node_id": _returning(g)}),
    "Q03_call_chain": ("call_chain", lambda g: {"function_id": _caller(g)}),
    "Q04_callers_of": ("callers_of", lambda g: {"function_id": _called(g)}),
    "Q05_scope_variables": ("scope_variables", lambda g: {"block_id": _first(g, "scope", last=True)}),
    "Q06_interface_implementors": ("interface_implementors", lambda g: {"interface_id": _first(g, "implements", "target")}),
    "Q07_function_cfg": ("function_cfg", lambda g: {"function_id": _with_blocks(g)}),
    "Q08_cross_package_calls": ("cross_package_calls", lambda g: {}),
    "Q09_context_propagation": ("context_propagation", lambda g: {}),
    "Q10_reaching_definitions": ("reaching_definitions", lambda g: {"node_id": _first(g, "dfg", "target", last=True)}),
    "Q11_package_dependency_graph": ("package_dependency_graph", lambda g: {}),
    "Q12_goroutine_analysis": ("goroutine_analysis", lambda g: {}),
    "Q13_taint_analysis": ("taint_analysis", lambda g: {}),
    "Q14_taint_path": ("taint_path", lambda g: {}),
    "Q15_function_io": ("function_io", lambda g: {"function_id": _value(g.of("parameter", "result").agg(F.min("parent_function")))}),
    "Q16_type_methods": ("type_methods", lambda g: {"receiver_type": _value(g.having("receiver").agg(F.min("value")))}),
    "Q17_error_chain": ("error_chain", lambda g: {"function_id": _failing(g)}),
    "Q18_data_flow_path": ("data_flow_path", lambda g: {"source_id": _first(g, "dfg")}),
    "Q19_shared_callers": ("shared_callers", lambda g: dict(zip(("function_a", "function_b"), _beside(g, "target", "source", _busiest(g))))),
    "Q20_impact_analysis": ("impact_analysis", lambda g: {"function_id": _called(g)}),
    "Q21_common_callee": ("common_callee", lambda g: dict(zip(("function_a", "function_b"), _beside(g, "source", "target", _called(g))))),
    "Q22_dependency_depth": ("dependency_depth", lambda g: {}),
    "Q23_function_risk_ranking": ("function_risk_ranking", lambda g: {}),
    "Q24_package_stability": ("package_stability", lambda g: {}),
    "Q25_function_control_profile": ("function_control_profile", lambda g: {"function_id": _caller(g)}),
    "Q26_similar_functions": ("similar_functions", lambda g: {"function_id": _value(f.twins(g, 5).agg(F.min("id")))}),
    "Q27_package_cohesion": ("package_cohesion", lambda g: {}),
    "Q28_concurrency_profile": ("concurrency_profile", lambda g: {}),
    "Q29_package_impact": ("package_impact", lambda g: {}),
    "Q30_function_neighborhood": ("function_neighborhood", lambda g: {"function_id": _busiest(g)}),
    "Q31_file_complexity": ("file_complexity_heatmap", lambda g: {}),
    "Q32_type_usage": ("type_usage", lambda g: {"type_name": "map["}),
    "Q33_hotspot_analysis": ("hotspot_analysis", lambda g: {}),
    "Q34_package_coupling_matrix": ("package_coupling_matrix", lambda g: {}),
    "Q35_error_propagation": ("error_propagation", lambda g: {}),
    "Q36_top_by_metric": ("top_functions_by_metric", lambda g: {"metric": "fan_in"}),
    "Q37_coupling_degree": ("package_coupling_degree", lambda g: {}),
    "Q38_pathfinder": ("call_chain_pathfinder", lambda g: {"start": _caller(g), "end": _end(g)}),
    "Q39_file_heatmap": ("file_heatmap", lambda g: {}),
    "Q40_package_graph": ("package_graph", lambda g: {}),
    "Q41_function_detail": ("function_detail", lambda g: {"id": _busiest(g)}),
    "Q42_interface_map": ("interface_map", lambda g: {"name": _face(g)}),
    "Q43_type_hierarchy_tree": ("type_hierarchy_tree", lambda g: {"name": _value(navigation.type_hierarchy(g).where("depth = 1").agg(F.max("type_name")))}),
    "Q44_method_set": ("method_set", lambda g: {"name": _face(g)}),
    "Q45_largest_interfaces": ("largest_interfaces", lambda g: {}),
    "Q46_most_implemented": ("most_implemented", lambda g: {}),
    "Q47_symbol_search": ("symbol_search", lambda g: {"pattern": "%get1%"}),
    "Q48_file_outline": ("file_outline_query", lambda g: {"file": _value(navigation.file_outline(g).agg(F.min("file")))}),
    "Q49_xref_lookup": ("xref_lookup", lambda g: {"id": _value(navigation.xrefs(g).agg(F.min("def_id")))}),
    "Q50_go_patterns": ("go_patterns", lambda g: {}),
    "Q51_taint_path_to_sink": ("taint_path_to_sink", lambda g: {}),
    "Q52_tainted_containers": ("tainted_containers", lambda g: {}),
    "Q53_scip_lookup": ("scip_lookup", lambda g: {"pattern": "%serve1%"}),
    "Q56_protocol_endpoints": ("comm_protocol_endpoints", lambda g: {}),
    "Q57_conformance_report": ("comm_conformance_report", lambda g: {}),
    "Q58_deadlock_check": ("comm_deadlock_check", lambda g: {}),
    "Q59_channel_patterns": ("comm_channel_patterns", lambda g: {}),
    "Q60_association_report": ("honda_association_report", lambda g: {}),
    "Q61_subtype_violations": ("honda_subtype_violations", lambda g: {}),
    "Q62_deadlock_detection": ("honda_deadlock_detection", lambda g: {}),
    "Q63_errata_summary": ("honda_errata_summary", lambda g: {}),
}
ANALYSES |= {key: (lambda g, name=name, seeds=seeds: named.run(g, name, **seeds(g))) for key, (name, seeds) in NAMED.items()}


# --- the walks beneath them ------------------------------------------------------------------------------------


def _levels(walked: DataFrame) -> DataFrame:
    return walked.groupBy("depth").agg(counted_as("functions"))


def _path_counts(g: Graph) -> DataFrame:
    d = paths.ends(g.step("call"), named.seed(g, _caller(g)), 10)
    return d.groupBy("depth").agg(F.sum("paths").cast("long").alias("paths"), counted_as("ends"))


def _errors(g: Graph) -> DataFrame:
    can = g.having("returns_error", "1").select("node_id")
    return traverse.walk(g.step("call").join(can, F.col("target") == F.col("node_id"), "left_semi"), named.seed(g, _failing(g)), 10)


def _text(walked: DataFrame) -> DataFrame:
    return walked.select(F.array_join("path", named.ARROW).alias("path"), "depth")


def _packages(g: Graph) -> DataFrame:
    return views.package_deps(g).select(F.col("source_package").alias("source"), F.col("target_package").alias("target"))


def _layers(g: Graph) -> DataFrame:
    deps = _packages(g)
    roots = deps.select(F.col("source").alias("id")).distinct().join(deps, F.col("id") == F.col("target"), "left_anti")
    return traverse.walk(deps, roots, 20).select(F.col("id").alias("package"), "depth")


def _reach(g: Graph) -> DataFrame:
    deps = _packages(g)
    return traverse.nearest(traverse.back(deps), deps.select(F.col("target").alias("package"), F.col("target").alias("id")).distinct(), 10, ("package",))


ANALYSES |= {
    "RG01_backward_depths": lambda g: traverse.nearest(traverse.back(g.step("dfg", "param_in")), named.seed(g, _formal(g)), 20),
    "RG02_forward_depths": lambda g: traverse.nearest(g.step("dfg", "param_out"), named.seed(g, _returning(g)), 20),
    "RG03_call_paths": _path_counts,
    "RG04_caller_levels": lambda g: _levels(traverse.walk(traverse.back(g.step("call")), named.seed(g, _called(g)), 5)),
    "RG05_scope_chain": lambda g: traverse.closure(g.step("scope"), named.seed(g, _first(g, "scope", last=True))),
    "RG06_error_levels": lambda g: _levels(_errors(g)),
    "RG07_flow_paths": lambda g: _text(traverse.simple_paths(g.step("dfg"), named.seed(g, _first(g, "dfg")), 15)),
    "RG07_flow_ends": lambda g: named.data_flow_ends(g, _first(g, "dfg")).withColumn("paths", F.col("paths").cast("long")),
    "RG08_impact_levels": lambda g: _levels(traverse.walk(traverse.back(g.step("call")), named.seed(g, _called(g)), 8)),
    "RG09_dependency_layers": _layers,
    "RG10_package_reach": _reach,
    "RG11_all_routes": lambda g: _text(traverse.paths_between(g.step("call"), named.seed(g, _caller(g)), named.seed(g, _end(g)), 6)),
    "RG12_taint_reach": lambda g: taint.state(g).select("source_id", "node_id", "min_hops"),
    "RG13_cycles": protocols.mutual_cycles,
}

ORACLES: list[dict[str, str]] = [views_sql.ORACLE, findings_sql.ORACLE, tables_sql.ORACLE, protocols_sql.ORACLE, named_sql.ORACLE, more_sql.ORACLE]


def _query(analysis: Callable[[Graph], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: analysis(stored(ship(spark), sf_dir))


def _without_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edges of the graph, to which two orphans of each kind have been added before."""
    g = build(ship(spark), sf_dir)
    kinds = g.edges.groupBy("kind").agg(F.min("source").alias("source"), F.min("target").alias("target"))
    lost = F.lit("nowhere")
    orphans = kinds.select("source", lost.alias("target"), "kind").union(kinds.select(lost, "target", "kind"))
    return g.but(edges=g.edges.unionByName(orphans, allowMissingColumns=True)).without_orphans().edges.select("source", "target", "kind")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: _query(analysis) for name, analysis in ANALYSES.items()}
    found["D04_without_orphans"] = _without_orphans
    return found | registry_more.queries()


def oracle_sql() -> dict[str, str]:
    return {name: text for part in ORACLES for name, text in part.items()}
