"""DuckDB SQL of the views, statistics and derived edges."""

from __future__ import annotations

from .carrier import EDGES, rounded, sql

DEPS = """deps AS (SELECT s.package AS source_package, t.package AS target_package, count(*) AS call_count, count(DISTINCT c.source) AS distinct_callers, count(DISTINCT c.target) AS distinct_callees
  FROM e_call c JOIN functions s ON s.id = c.source JOIN functions t ON t.id = c.target WHERE s.package <> t.package GROUP BY ALL)"""
STABILITY = f"""stability AS (SELECT package, coalesce(ca, 0) AS afferent_coupling, coalesce(ce, 0) AS efferent_coupling, CASE WHEN coalesce(ca, 0) + coalesce(ce, 0) = 0 THEN 0.5 ELSE {rounded("coalesce(ce, 0) / (coalesce(ca, 0) + coalesce(ce, 0))", 3)} END::DOUBLE AS instability,
    coalesce(n, 0) AS total_types, coalesce(i, 0) AS interface_count, CASE WHEN coalesce(n, 0) = 0 THEN 0.0 ELSE {rounded("i / n", 3)} END::DOUBLE AS abstractness
  FROM (SELECT package, count(*) AS n, count(*) FILTER (value = 'interface') AS i FROM types LEFT JOIN p_type ON node_id = id GROUP BY package)
  FULL JOIN (SELECT target_package AS package, count(*) AS ca FROM deps GROUP BY 1) USING (package) FULL JOIN (SELECT source_package AS package, count(*) AS ce FROM deps GROUP BY 1) USING (package))"""
PROFILE = f"""profile AS (SELECT s.parent_function AS function_id, f.name AS function_name, f.package, {", ".join(f"count(*) FILTER (s.kind = '{k}') AS {k}_count" for k in "if for switch select return defer go".split())}, count(*) AS total_statements
  FROM statements s JOIN functions f ON f.id = s.parent_function WHERE s.kind IN ('if', 'for', 'switch', 'select', 'return', 'defer', 'go', 'assign', 'call', 'send', 'branch') GROUP BY ALL)"""
COHESION = f"""cohesion AS (SELECT package, func_count, total_calls, internal_calls, external_calls, {rounded("internal_calls / greatest(total_calls, 1)", 3)} AS cohesion_ratio FROM (SELECT s.package, count(*) AS total_calls, count(*) FILTER (s.package = t.package) AS internal_calls,
    count(*) FILTER (s.package <> t.package) AS external_calls FROM e_call c JOIN functions s ON s.id = c.source JOIN functions t ON t.id = c.target GROUP BY s.package) JOIN (SELECT package, count(*) AS func_count FROM functions GROUP BY package) USING (package))"""
CONCURRENCY = """concurrency AS (SELECT package, gos AS goroutine_launches, sends AS channel_sends, selects AS select_stmts, coalesce(n, 0) AS sync_primitives, defers AS defer_stmts
  FROM (SELECT package, count(*) FILTER (kind = 'go') AS gos, count(*) FILTER (kind = 'send') AS sends, count(*) FILTER (kind = 'select') AS selects, count(*) FILTER (kind = 'defer') AS defers FROM stmt GROUP BY package)
  LEFT JOIN (SELECT package, count(*) AS n FROM p_sync GROUP BY package) USING (package) WHERE gos + sends + selects > 0)"""
REACH = """reach(package, id, depth) AS (SELECT DISTINCT target_package, target_package, 0 FROM deps UNION SELECT r.package, d.source_package, r.depth + 1 FROM reach r JOIN deps d ON d.target_package = r.id WHERE r.depth < 10)"""
AFFECTED = "SELECT package, count(*) AS packages_affected, max(d) AS max_impact_depth FROM (SELECT package, id, min(depth)::BIGINT AS d FROM reach WHERE id <> package GROUP BY package, id) GROUP BY package"
SIZES = f"""file_sizes AS (SELECT file, count(*) AS function_count, sum(loc)::BIGINT AS total_loc, sum(cc)::BIGINT AS total_complexity, max(cc) AS max_complexity, {rounded("avg(cc)", 1)} AS avg_complexity FROM measured WHERE file IS NOT NULL GROUP BY file)"""
RISK = f"""file_risk AS (SELECT s.file, n.n AS node_count, function_count, total_complexity, avg_complexity, max_complexity, commit_count, author_count, churn, last_author, last_date,
    {rounded("0.3::DOUBLE * avg_complexity + 0.2::DOUBLE * max_complexity + 0.3::DOUBLE * coalesce(commit_count, 1) + 0.2::DOUBLE * coalesce(author_count, 1)", 2)} AS change_risk_score
  FROM file_sizes s JOIN (SELECT file, count(*) AS n FROM nodes WHERE file IS NOT NULL GROUP BY file) n ON n.file = s.file LEFT JOIN history h ON h.file = s.file)"""

ORACLE = {
    "V01_call_graph": sql("""SELECT c.source AS caller_id, s.name AS caller_name, s.package AS caller_package, c.target AS callee_id, t.name AS callee_name, t.package AS callee_package, CASE WHEN d.source IS NULL THEN 0 ELSE 1 END::BIGINT AS is_dynamic
      FROM e_call c JOIN functions s ON s.id = c.source JOIN functions t ON t.id = c.target LEFT JOIN dynamic_calls d ON d.source = c.source AND d.target = c.target"""),
    "V02_data_flow": sql("""SELECT e.source AS def_id, s.name AS def_name, s.kind AS def_kind, s.file AS def_file, s.line AS def_line, e.target AS use_id, t.name AS use_name, t.kind AS use_kind, t.file AS use_file, t.line AS use_line
      FROM e_dfg e JOIN statements s ON s.id = e.source JOIN statements t ON t.id = e.target"""),
    "V03_function_summary": sql("""SELECT id, name, package, file, line, end_line, cc AS complexity, fan_in, fan_out, loc, num_params, coalesce(o.n, 0) AS calls_out, coalesce(i.n, 0) AS calls_in FROM measured
      LEFT JOIN (SELECT source, count(*) AS n FROM e_call GROUP BY source) o ON o.source = id LEFT JOIN (SELECT target, count(*) AS n FROM e_call GROUP BY target) i ON i.target = id"""),
    "V04_type_relations": sql("""SELECT e.source AS type_id, s.name AS type_name, s.package AS type_package, e.relationship, e.target AS target_id, t.name AS target_name, t.package AS target_package
      FROM (SELECT *, 'implements' AS relationship FROM e_implements UNION ALL SELECT *, 'embeds' FROM e_embeds) e JOIN types s ON s.id = e.source JOIN types t ON t.id = e.target"""),
    "V05_package_deps": sql("SELECT * FROM deps", DEPS),
    "V06_file_deps": sql("SELECT s.file AS source_file, t.file AS target_file, count(*) AS call_count FROM e_call c JOIN functions s ON s.id = c.source JOIN functions t ON t.id = c.target WHERE s.file <> t.file GROUP BY ALL"),
    "V07_function_io": sql("""SELECT f.id AS function_id, f.name AS function_name, f.package, x.id AS io_node_id, x.name AS io_name, x.kind AS io_kind, x.type_info AS io_type,
      CASE json_extract_string(x.properties, 'mutable') WHEN 'true' THEN 1 WHEN 'false' THEN 0 END::BIGINT AS is_mutable, CASE json_extract_string(x.properties, 'nullable') WHEN 'true' THEN 1 WHEN 'false' THEN 0 END::BIGINT AS is_nullable
      FROM e_ast e JOIN functions f ON f.id = e.source JOIN (SELECT * FROM statements WHERE kind = 'parameter' UNION ALL SELECT * FROM results) x ON x.id = e.target"""),
    "V08_api_surface": sql("SELECT package, kind, id, name, type_info, file, line FROM (SELECT * FROM functions UNION ALL SELECT * FROM types) WHERE name GLOB '[A-Z]*' AND package IS NOT NULL"),
    "V09_method_sets": sql("SELECT value AS receiver_type, package, id, name, type_info, file, line, cc AS complexity, loc FROM measured JOIN p_function ON node_id = id AND key = 'receiver' WHERE value IS NOT NULL"),
    "V10_error_handling": sql("SELECT id, name, package, file, line, fan_in AS callers, fan_out AS callees, cc AS complexity FROM measured JOIN p_function ON node_id = id AND key = 'returns_error' AND value = '1'"),
    "V11_package_stability": sql("SELECT * FROM stability", DEPS, STABILITY),
    "V12_control_flow_profile": sql("SELECT * FROM profile", PROFILE),
    "V13_package_cohesion": sql("SELECT * FROM cohesion", COHESION),
    "V14_concurrency_profile": sql("SELECT * FROM concurrency", CONCURRENCY),
    "V15_package_reach": sql(AFFECTED, DEPS, REACH),
    "V16_file_risk": sql("SELECT * EXCLUDE (total_complexity) FROM file_risk", SIZES, RISK),
    "T01_node_kinds": sql("SELECT kind, count(*) AS count FROM nodes GROUP BY kind"),
    "T01_edge_kinds": sql(" UNION ALL ".join(f"SELECT '{k}' AS kind, count(*) AS count FROM e_{k}" for k in EDGES)),
    "T02_package_stats": sql("""SELECT package, count(*) FILTER (kind = 'file') AS files, count(*) FILTER (kind = 'function') AS functions, count(*) FILTER (kind = 'type_decl') AS types,
      sum(CASE WHEN kind = 'function' THEN end_line - line + 1 ELSE 0 END)::BIGINT AS loc FROM nodes WHERE package IS NOT NULL GROUP BY package"""),
    "T03_overview": sql("""SELECT count(*) AS total_nodes, (SELECT count(*) FROM edges) AS total_edges, (SELECT count(*) FROM documents) AS total_files, count(DISTINCT package) AS total_packages, count(*) FILTER (kind = 'function') AS total_functions,
      count(*) FILTER (kind = 'type_decl') AS total_types, (SELECT count(*) FROM metrics) AS total_metrics FROM nodes"""),
    "T04_edge_properties": sql("SELECT * FROM edge_props"),
    "D01_flows_to_result": sql("SELECT * FROM d1"),
    "D02_flows_to_argument": sql("SELECT * FROM d2"),
    "D03_flows_by_default": sql("SELECT * FROM d3"),
    "D04_without_orphans": sql("SELECT source, target, kind FROM raw_edges"),
    "D05_argument_order": sql("SELECT * FROM d5"),
    "D06_last_argument": sql("SELECT * FROM d6"),
    "S21_validate": sql("SELECT 'orphan_edges' AS \"check\", NULL::VARCHAR AS kind, 0::BIGINT AS n UNION ALL SELECT 'nodes', kind, count(*) FROM nodes GROUP BY kind" + "".join(f" UNION ALL SELECT 'edges', '{k}', count(*) FROM e_{k}" for k in EDGES)),
}
