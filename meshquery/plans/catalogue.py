"""The views and named queries there are, by the stage of the pipeline that makes them (fixed values)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Stage 1 ends where dashboards count what there is, stage 2 with all others.
VIEWS = {
    1: [
        "v_call_graph", "v_data_flow", "v_function_summary", "v_type_hierarchy", "v_package_deps", "v_file_deps", "v_function_io", "v_api_surface",
        "v_method_sets", "v_error_handling", "v_package_stability", "v_control_flow_profile", "v_package_cohesion", "v_concurrency_profile", "v_package_impact",
    ],
    2: [
        "v_file_risk", "v_taint_summary", "v_container_taint_summary", "v_comm_topology", "v_protocol_coverage", "v_comm_endpoint_detail",
        "v_session_duality", "v_causality_summary", "v_association_summary", "v_subtype_detail", "v_dependency_cycles",
    ],
}
QUERIES = {
    1: [
        "backward_slice", "forward_slice", "call_chain", "callers_of", "scope_variables", "interface_implementors", "function_cfg", "cross_package_calls",
        "context_propagation", "reaching_definitions", "package_dependency_graph", "goroutine_analysis", "taint_analysis", "taint_path", "function_io",
        "type_methods", "error_chain", "data_flow_path", "shared_callers", "impact_analysis", "common_callee", "dependency_depth", "function_risk_ranking",
        "package_stability", "function_control_profile", "similar_functions", "package_cohesion", "concurrency_profile", "package_impact",
        "function_neighborhood", "file_complexity_heatmap", "type_usage",
    ],
    2: [
        "hotspot_analysis", "package_coupling_matrix", "error_propagation", "top_functions_by_metric", "package_coupling_degree", "call_chain_pathfinder",
        "file_heatmap", "package_graph", "function_detail", "interface_map", "type_hierarchy_tree", "method_set", "largest_interfaces", "most_implemented",
        "symbol_search", "file_outline_query", "xref_lookup", "go_patterns", "taint_path_to_sink", "tainted_containers", "scip_lookup", "comm_full_topology",
        "comm_adapter_flow", "comm_protocol_endpoints", "comm_conformance_report", "comm_deadlock_check", "comm_channel_patterns",
        "honda_association_report", "honda_subtype_violations", "honda_deadlock_detection", "honda_errata_summary",
    ],
}


def views_by(stage: int) -> int:
    return sum(len(names) for s, names in VIEWS.items() if s <= stage)


def queries_by(stage: int) -> int:
    return sum(len(names) for s, names in QUERIES.items() if s <= stage)


def listing(spark: SparkSession) -> DataFrame:
    """type, name and stage of every view and query."""
    rows = [(kind, name, stage) for kind, of in (("view", VIEWS), ("query", QUERIES)) for stage, names in of.items() for name in names]
    return spark.createDataFrame(rows, "type string, name string, stage long").coalesce(1)
