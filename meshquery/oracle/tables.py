"""DuckDB SQL of dashboards and navigation tables."""

from __future__ import annotations

from .carrier import EDGES, rounded, sql
from .findings import STAGES
from .views import DEPS, SIZES

_TOP = "SELECT '{0}' AS metric, row_number() OVER (ORDER BY {1} DESC, id) AS rank, id AS function_id, name, package, file, {1}::DOUBLE AS value FROM measured WHERE {1} > 0 QUALIFY rank <= 50"
TOP = "leaders AS (" + "\nUNION ALL ".join(f"({_TOP.format(n, c)})" for n, c in (("complexity", "cc"), ("loc", "loc"), ("fan_in", "fan_in"), ("fan_out", "fan_out"))) + ")"
HOT = f"""hot AS (SELECT m.id AS function_id, m.name, m.package, m.file, m.cc AS complexity, m.loc, m.fan_in, m.fan_out, coalesce(f.n, 0) AS finding_count,
    {rounded("m.cc::DOUBLE / greatest(x.a, 1) * 30 + m.loc::DOUBLE / greatest(x.b, 1) * 20 + m.fan_in::DOUBLE / greatest(x.c, 1) * 25 + coalesce(f.n, 0)::DOUBLE / greatest(y.n, 1) * 25", 2)} AS hotspot_score
  FROM measured m LEFT JOIN (SELECT node_id, count(*) AS n FROM stage1 GROUP BY node_id) f ON f.node_id = m.id, (SELECT max(cc) AS a, max(loc) AS b, max(fan_in) AS c FROM measured) x, (SELECT max(n) AS n FROM (SELECT count(*) AS n FROM stage1 GROUP BY node_id)) y
  WHERE m.cc > 0 ORDER BY hotspot_score DESC, function_id LIMIT 200)"""
HEAT = f"""heat AS (SELECT s.*, coalesce(f.n, 0)::BIGINT AS finding_count, {rounded("s.total_complexity::DOUBLE / greatest(x.a, 1) * 40 + s.total_loc::DOUBLE / greatest(x.b, 1) * 30 + coalesce(f.n, 0)::DOUBLE / greatest(y.n, 1) * 30", 2)} AS hotspot_score
  FROM (SELECT file, package, count(*) AS function_count, sum(loc)::BIGINT AS total_loc, sum(cc)::BIGINT AS total_complexity, max(cc) AS max_complexity, {rounded("avg(cc)", 1)} AS avg_complexity FROM measured WHERE file IS NOT NULL GROUP BY file, package) s
  LEFT JOIN (SELECT n.file, count(*) AS n FROM stage2 f JOIN nodes n ON n.id = f.node_id GROUP BY n.file) f ON f.file = s.file, (SELECT max(cc) AS a, max(loc) AS b FROM measured) x, (SELECT max(n) AS n FROM (SELECT count(*) AS n FROM stage2 GROUP BY node_id)) y)"""
DETAIL = """detail AS (SELECT m.id AS function_id, m.name, m.package, m.file, m.line, m.end_line, m.type_info AS signature, m.cc AS complexity, m.loc, m.fan_in, m.fan_out, m.num_params,
    coalesce(i.l, 0) AS num_locals, coalesce(i.c, 0) AS num_calls, coalesce(i.b, 0) AS num_branches, coalesce(i.r, 0) AS num_returns, coalesce(f.n, 0) AS finding_count, a.s AS callers, b.s AS callees
  FROM measured m LEFT JOIN (SELECT fid, count(*) FILTER (kind = 'local') AS l, count(*) FILTER (kind = 'call') AS c, count(*) FILTER (kind = 'return') AS r, count(*) FILTER (kind IN ('if', 'for', 'switch', 'select')) AS b FROM stmt GROUP BY fid) i ON i.fid = m.id
  LEFT JOIN (SELECT node_id, count(*) AS n FROM stage2 GROUP BY node_id) f ON f.node_id = m.id
  LEFT JOIN (SELECT target, string_agg(DISTINCT name, ',' ORDER BY name) AS s FROM e_call JOIN functions ON id = source GROUP BY target) a ON a.target = m.id
  LEFT JOIN (SELECT source, string_agg(DISTINCT name, ',' ORDER BY name) AS s FROM e_call JOIN functions ON id = target GROUP BY source) b ON b.source = m.id)"""
TREEMAP = f"""treemap AS (SELECT s.*, coalesce(t.n, 0) AS type_count, coalesce(t.i, 0) AS interface_count FROM (SELECT package, count(DISTINCT file) AS file_count, count(*) AS function_count, sum(loc)::BIGINT AS total_loc, sum(cc)::BIGINT AS total_complexity, {rounded("avg(cc)", 1)} AS avg_complexity,
    max(cc) AS max_complexity FROM measured GROUP BY package) s LEFT JOIN (SELECT package, count(*) AS n, count(*) FILTER (value = 'interface') AS i FROM types JOIN p_type ON node_id = id GROUP BY package) t ON t.package = s.package)"""
CHAINS = """chains AS (SELECT f.id AS function_id, f.name, f.package, w.n AS error_wraps, coalesce(r.n, 0) AS error_returns, 0::BIGINT AS chain_depth
  FROM functions f JOIN (SELECT s.fid, count(*) AS n FROM e_error_wrap e JOIN stmt s ON s.id = e.source GROUP BY 1) w ON w.fid = f.id LEFT JOIN (SELECT fid, count(*) AS n FROM stmt WHERE kind = 'return' GROUP BY 1) r ON r.fid = f.id)"""
IMPL = """satisfied AS (SELECT i.source AS t, i.target AS i, count(*) AS n FROM e_implements i JOIN e_has_method a ON a.source = i.source JOIN e_satisfies_method s ON s.source = a.target JOIN e_has_method b ON b.source = i.target AND b.target = s.target GROUP BY ALL),
impl AS (SELECT e.target AS interface_id, i.name AS interface_name, i.package AS interface_package, e.source AS concrete_id, c.name AS concrete_name, c.package AS concrete_package, coalesce(s.n, 0) AS method_count
  FROM e_implements e JOIN types i ON i.id = e.target JOIN types c ON c.id = e.source LEFT JOIN satisfied s ON s.t = e.source AND s.i = e.target)"""
HIERARCHY = """hierarchy AS (SELECT p.id AS type_id, p.name AS type_name, p.package AS type_package, c.id AS embedded_id, c.name AS embedded_name, c.package AS embedded_package, 1::BIGINT AS depth FROM e_embeds e JOIN types p ON p.id = e.source JOIN types c ON c.id = e.target
  UNION ALL SELECT id, name, package, NULL, NULL, NULL, 0 FROM types WHERE id NOT IN (SELECT source FROM e_embeds))"""
METHODS = """methods AS (SELECT t.id AS type_id, t.name AS type_name, m.id AS method_id, m.name AS method_name, m.type_info AS signature, m.cc AS complexity, m.loc FROM e_has_method e JOIN types t ON t.id = e.source JOIN measured m ON m.id = e.target)"""
_SCIP = "'scip-go gomod github.com/prometheus/prometheus v0 ' || replace(package, '/', '.') || '/'"
SCIP = f"""scip AS (SELECT id AS node_id, {_SCIP} || CASE WHEN name LIKE '%.%' THEN replace(replace(split_part(name, '.', 1), '(*', ''), ')', '') || '#' || substr(name, strpos(name, '.') + 1) ELSE name END || '().' AS scip_id,
    CASE WHEN name LIKE '%.%' THEN 'method' ELSE 'function' END AS kind, package, name AS display_name, file, line FROM functions WHERE package IS NOT NULL AND name <> ''
  UNION ALL SELECT id, {_SCIP} || name || '#', 'type', package, name, file, line FROM types UNION ALL SELECT id, {_SCIP}, 'package', package, name, NULL, NULL FROM packages WHERE package IS NOT NULL)"""
SYMBOLS = """symbols AS (SELECT id, name, kind, package, file, line, type_info AS signature, parent_function AS parent FROM (SELECT * FROM functions UNION ALL SELECT * FROM types UNION ALL SELECT * FROM statements WHERE kind IN ('local', 'parameter')) WHERE name NOT IN ('', '_') AND file IS NOT NULL)"""
OUTLINE = "outline AS (SELECT file, id, name, kind, line, end_line, type_info AS signature, parent_function AS parent_id, 0::BIGINT AS depth FROM (SELECT * FROM functions UNION ALL SELECT * FROM types) WHERE name <> '' AND file IS NOT NULL)"
XREFS = "xrefs AS (SELECT d.id AS def_id, d.name AS def_name, d.file AS def_file, d.line AS def_line, u.id AS use_id, u.file AS use_file, u.line AS use_line, u.kind AS use_kind FROM e_ref e JOIN statements u ON u.id = e.source JOIN statements d ON d.id = e.target WHERE d.file IS NOT NULL AND u.file IS NOT NULL)"
PATTERNS = """patterns AS (SELECT s.package, g AS goroutine_count, d AS defer_count, c AS channel_send_count, l AS select_count, panics AS panic_count, coalesce(i.n, 0) AS interface_count, 0::BIGINT AS type_assert_count, coalesce(w.n, 0) AS error_wrap_count, contexts AS context_param_count
  FROM (SELECT package, count(*) FILTER (kind = 'go') AS g, count(*) FILTER (kind = 'defer') AS d, count(*) FILTER (kind = 'send') AS c, count(*) FILTER (kind = 'select') AS l, count(*) FILTER (kind = 'call' AND name = 'panic') AS panics,
    count(*) FILTER (kind = 'parameter' AND type_info = 'context.Context') AS contexts FROM statements WHERE package IS NOT NULL GROUP BY package) s
  LEFT JOIN (SELECT package, count(*) AS n FROM types JOIN p_type ON node_id = id AND value = 'interface' GROUP BY package) i ON i.package = s.package
  LEFT JOIN (SELECT s.package, count(*) AS n FROM e_error_wrap e JOIN stmt s ON s.id = e.source GROUP BY s.package) w ON w.package = s.package WHERE g + d + c + l > 0)"""

_COUNT = lambda table, where="true": f"(SELECT count(*) FROM {table} WHERE {where})"
TOTALS = {
    "total_packages": "(SELECT count(DISTINCT package) FROM nodes)", "total_files": "(SELECT count(DISTINCT file) FROM nodes)", "total_functions": _COUNT("functions"), "total_types": _COUNT("types"),
    "total_interfaces": _COUNT("p_type", "value = 'interface'"), "total_nodes": _COUNT("nodes"), "total_edges": "(SELECT " + " + ".join(f"(SELECT count(*) FROM e_{k})" for k in EDGES) + ")", "total_loc": "(SELECT sum(loc) FROM metrics)",
    "avg_complexity": f"(SELECT {rounded('avg(cyclomatic_complexity)', 1)} FROM metrics WHERE cyclomatic_complexity > 0)", "max_complexity": "(SELECT max(cyclomatic_complexity) FROM metrics)", "total_findings": _COUNT("stage1"),
    "total_call_edges": _COUNT("e_call"), "total_dfg_edges": _COUNT("e_dfg"), "total_cfg_edges": _COUNT("e_cfg"), "inlineable_functions": _COUNT("p_function", "key = 'inlineable' AND value = '1'"),
    "heap_escaping": _COUNT("stmt", "kind = 'local' AND pk % 6 = 1"), "total_goroutine_launches": _COUNT("stmt", "kind = 'go'"), "total_defers": _COUNT("stmt", "kind = 'defer'"), "total_queries": "32", "total_views": "15",
}

ORACLE = {
    "T09_complexity_distribution": sql("""SELECT bucket, low AS bucket_min, high AS bucket_max, count(*) AS function_count FROM metrics JOIN (VALUES ('1 (trivial)', 0::BIGINT, 1::BIGINT, 1), ('2-5 (simple)', 2, 5, 5), ('6-10 (moderate)', 6, 10, 10),
      ('11-20 (complex)', 11, 20, 20), ('21-50 (very complex)', 21, 50, 50), ('51+ (extreme)', 51, 999, 1000000)) b(bucket, low, high, top) ON cyclomatic_complexity BETWEEN low AND top WHERE cyclomatic_complexity > 0 GROUP BY ALL"""),
    "T10_package_treemap": sql("SELECT * FROM treemap", TREEMAP),
    "T12_edge_distribution": sql(f"SELECT kind AS edge_kind, n AS count, {rounded('100.0::DOUBLE * n / (sum(n) OVER ())', 2)} AS percentage FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, count(*) AS n FROM e_{k}" for k in EDGES) + ")"),
    "T12_node_distribution": sql(f"SELECT kind AS node_kind, n AS count, {rounded('100.0::DOUBLE * n / (sum(n) OVER ())', 2)} AS percentage FROM (SELECT kind, count(*) AS n FROM nodes GROUP BY kind)"),
    "T13_complexity_vs_loc": sql("SELECT id AS function_id, name, package, cc AS complexity, loc, fan_in, fan_out FROM measured WHERE cc > 0 AND loc > 0"),
    "T14_totals": sql("\nUNION ALL ".join(f"SELECT '{k}' AS key, {v}::VARCHAR AS value" for k, v in TOTALS.items()), *STAGES),
    "T15_top_functions": sql("SELECT * FROM leaders", TOP),
    "T16_hotspots": sql("SELECT * FROM hot", *STAGES, HOT),
    "T17_package_coupling": sql("SELECT source_package, target_package, call_count FROM deps", DEPS),
    "T18_error_chains": sql("SELECT * FROM chains", CHAINS),
    "T19_file_heatmap": sql("SELECT * FROM heat", *STAGES, HEAT),
    "T20_package_graph": sql("SELECT source_package AS source, target_package AS target, call_count AS weight FROM deps WHERE call_count >= 2 AND NOT regexp_matches(source_package || ' ' || target_package, '(^| )(github.com|golang.org)/')", DEPS),
    "T21_function_detail": sql("SELECT * FROM detail", *STAGES, DETAIL),
    "T22_type_impl_map": sql("SELECT * FROM impl", IMPL),
    "T23_type_hierarchy": sql("SELECT * FROM hierarchy", HIERARCHY),
    "T24_type_method_set": sql("SELECT * FROM methods", METHODS),
    "T25_symbol_index": sql("SELECT * FROM symbols", SYMBOLS),
    "T26_file_outline": sql("SELECT * FROM outline", OUTLINE),
    "T27_xrefs": sql("SELECT * FROM xrefs", XREFS),
    "T28_go_patterns": sql("SELECT * FROM patterns", PATTERNS),
    "T29_file_history": sql("SELECT * FROM history"),
    "T32_scip_symbols": sql("SELECT node_id, scip_id, kind, package, display_name FROM scip", SCIP),
}
__all__ = ["CHAINS", "DETAIL", "HEAT", "HIERARCHY", "HOT", "IMPL", "METHODS", "ORACLE", "OUTLINE", "PATTERNS", "SCIP", "SIZES", "SYMBOLS", "TOP", "TREEMAP", "XREFS"]
