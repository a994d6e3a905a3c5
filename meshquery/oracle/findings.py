"""DuckDB SQL of the finding rules: category, severity, node_id, file, line, message, details."""

from __future__ import annotations

from .carrier import rounded, sql
from .views import DEPS, RISK, SIZES

ROLES = """call_specs AS (SELECT DISTINCT e.source AS node_id, s.role, s.category FROM e_call_site e JOIN functions f ON f.id = e.target JOIN taint_specs s ON s.package = f.package AND s.func_name = f.name),
roles AS (SELECT DISTINCT node_id, role FROM call_specs),
categories AS (SELECT DISTINCT node_id, category FROM call_specs)"""
TAINT = """starts AS (SELECT r.node_id AS source_id, min(c.category) AS source_category FROM roles r JOIN categories c ON c.node_id = r.node_id WHERE r.role = 'source' GROUP BY r.node_id),
flags AS (SELECT node_id, bool_or(role = 'source') AS s, bool_or(role = 'barrier') AS b, bool_or(role = 'sink') AS k FROM roles GROUP BY node_id),
reached(source_id, id, hop) AS (SELECT source_id, source_id, 0 FROM starts UNION SELECT r.source_id, e.target, r.hop + 1 FROM reached r JOIN e_dfg e ON e.source = r.id WHERE r.hop < 8),
flow_state AS (SELECT x.id AS node_id, CASE WHEN f.s THEN 'source' WHEN f.b THEN 'sanitized' WHEN f.k THEN 'sink_reached' ELSE 'propagated' END AS label, x.source_id, s.source_category, x.hop AS min_hops
  FROM (SELECT source_id, id, min(hop)::BIGINT AS hop FROM reached GROUP BY source_id, id) x JOIN starts s ON s.source_id = x.source_id LEFT JOIN flags f ON f.node_id = x.id)"""
SINKS = """sinks AS (SELECT t.source_id, s.name AS source_name, t.source_category, t.node_id AS sink_id, n.name AS sink_name, n.file, n.line, t.min_hops FROM flow_state t JOIN statements n ON n.id = t.node_id JOIN statements s ON s.id = t.source_id WHERE t.label = 'sink_reached')"""
CONTAINERS = """containers AS (SELECT id AS node_id, kind, CASE WHEN type_info ILIKE '%map[%' THEN 'map' ELSE 'slice' END AS container_kind, type_info, file, line, parent_function AS function_id, CASE WHEN id IN (SELECT node_id FROM flow_state) THEN 1 ELSE 0 END::BIGINT AS has_taint
  FROM statements WHERE kind IN ('local', 'parameter', 'assign') AND (type_info ILIKE 'map[%' OR type_info ILIKE '[]%' OR type_info ILIKE '*map[%' OR type_info ILIKE '*[]%') AND file IS NOT NULL)"""
MEETING = """meeting AS (SELECT f.id, f.name, f.package, f.file, f.line, a.c AS source_categories, b.c AS sink_categories FROM functions f
  JOIN (SELECT fid, string_agg(DISTINCT category, ',' ORDER BY category) AS c FROM stmt JOIN roles r ON r.node_id = stmt.id AND r.role = 'source' JOIN categories k ON k.node_id = stmt.id GROUP BY fid) a ON a.fid = f.id
  JOIN (SELECT fid, string_agg(DISTINCT category, ',' ORDER BY category) AS c FROM stmt JOIN roles r ON r.node_id = stmt.id AND r.role = 'sink' JOIN categories k ON k.node_id = stmt.id GROUP BY fid) b ON b.fid = f.id)"""
RISKS = f"""risks AS (SELECT *, {rounded("risk", 2)} AS risk_score FROM (SELECT m.*, 3.0::DOUBLE * cc / greatest(x.a, 1) + 2.0::DOUBLE * loc / greatest(x.b, 1) + 1.0::DOUBLE * fan_in / greatest(x.c, 1) + 1.0::DOUBLE * fan_out / greatest(x.d, 1) AS risk
  FROM measured m, (SELECT max(cc) AS a, max(loc) AS b, max(fan_in) AS c, max(fan_out) AS d FROM measured WHERE cc > 0) x WHERE cc >= 5 OR loc >= 30) ORDER BY CAST(risk AS DECIMAL(38,9)) DESC, id LIMIT 200)"""
TWINS = "twins AS (SELECT a.*, b.id AS id_b, b.name AS name_b, b.loc AS loc_b, b.package AS package_b FROM measured a JOIN measured b ON b.cc = a.cc AND b.num_params = a.num_params AND abs(a.loc - b.loc) <= 3 AND a.id < b.id)"


def _f(category: str, severity: str, message: str, rest: str, details: str = "", node: str = "id", at: str = "file, line") -> str:
    """``details``: names, each a column or ``name=expression``."""
    fields = [d.strip().partition("=")[::2] for d in details.split(",") if d.strip()]
    json = "json_object(" + ", ".join(f"'{k}', {v or k}" for k, v in fields) + ")::VARCHAR" if fields else "NULL::VARCHAR"
    return f"SELECT '{category}' AS category, '{severity}' AS severity, {node} AS node_id, {at}, {message} AS message, {json} AS details FROM {rest}"


_NOWHERE = "NULL::VARCHAR AS file, NULL::BIGINT AS line"
_IN = "(SELECT parent_function AS pf, count(*) AS n FROM statements WHERE {} GROUP BY parent_function) x JOIN functions f ON f.id = x.pf"
_CHILD = "(SELECT e.source AS pf, count(*) AS n FROM e_ast e JOIN {} c ON c.id = e.target WHERE {} GROUP BY e.source) x JOIN functions f ON f.id = x.pf"
_IFACE = "id IN (SELECT node_id FROM p_type WHERE value = 'interface')"

RULES = {
    "F01_complexity": _f("complexity", "warning", "name || ' has cyclomatic complexity ' || cc", "measured WHERE cc >= 15", "complexity=cc, package"),
    "F02_size": _f("size", "info", "name || ' is ' || loc || ' lines long'", "measured WHERE loc >= 100", "loc, package"),
    "F03_nesting": _f("nesting", "warning", "kind || ' at depth ' || depth || ' in ' || parent_function", "statements JOIN p_nesting ON node_id = id WHERE depth >= 8", "depth, kind"),
    "F04_hub": _f("hub", "info", "name || ': fan_in=' || fan_in || ' fan_out=' || fan_out", "measured WHERE fan_in >= 10 AND fan_out >= 10", "fan_in, fan_out, package"),
    "F05_dead_store": _f("dead_store", "warning", "'unused variable ''' || name || ''' in ' || parent_function", "statements WHERE kind = 'local' AND name <> '_' AND id NOT IN (SELECT source FROM e_dfg)", "variable=name, package"),
    "F06_unused_param": _f("unused_param", "info", "'unused parameter ''' || name || ''' in ' || parent_function", "statements WHERE kind = 'parameter' AND name <> '_' AND id NOT IN (SELECT source FROM e_dfg)", "parameter=name, function=parent_function"),
    "F07_circular_dep": _f("circular_dep", "warning", "a.source_package || ' <-> ' || a.target_package || ' (' || a.call_count || '/' || b.call_count || ' calls)'", """deps a JOIN deps b ON b.source_package = a.target_package AND b.target_package = a.source_package WHERE a.source_package < a.target_package
        AND a.source_package NOT ILIKE 'cmd/%' AND a.target_package NOT ILIKE 'cmd/%' AND a.source_package NOT ILIKE 'ext::%' AND a.target_package NOT ILIKE 'ext::%' AND a.source_package NOT LIKE '%.%/%'""",
        "package_a=a.source_package, package_b=a.target_package, a_to_b_calls=a.call_count, b_to_a_calls=b.call_count", "NULL::VARCHAR", _NOWHERE),
    "F08_goroutine_spawner": _f("goroutine_spawner", "info", "name || ' launches ' || n || ' goroutine(s)'", _IN.format("kind = 'go'") + " WHERE n >= 2", "goroutine_count=n, package"),
    "F09_unused_export": _f("unused_export", "info", "'exported ' || name || ' has no callers from other packages'", """functions WHERE name GLOB '[A-Z]*' AND package IS NOT NULL AND package NOT ILIKE 'cmd/%'
        AND id NOT IN (SELECT c.target FROM e_call c JOIN functions s ON s.id = c.source JOIN functions t ON t.id = c.target WHERE s.package <> t.package)""", "name, package"),
    "F10_long_param_list": _f("long_param_list", "info", "name || ' has ' || num_params || ' parameters'", "measured WHERE num_params > 5", "num_params, package"),
    "F10b_many_params": _f("long_param_list", "info", "name || ' has ' || num_params || ' parameters (threshold: 5)'", "measured WHERE num_params > 5", "", "id", _NOWHERE),
    "F11_god_function": _f("god_function", "warning", "name || ' (complexity=' || cc || ', loc=' || loc || ', fan_out=' || fan_out || ')'", "measured WHERE cc >= 10 AND loc >= 50 AND fan_out >= 10", "complexity=cc, loc, fan_in, fan_out, package"),
    "F12_interface_coupling": _f("interface_coupling", "info", "name || ' implements ' || n || ' interfaces'", "(SELECT source, count(*) AS n FROM e_implements GROUP BY source) x JOIN types ON id = source WHERE n >= 3", "interface_count=n, package"),
    "F13_concurrency_risk": _f("concurrency_risk", "warning", "name || ' uses mutex locks and spawns goroutines'", "functions WHERE id IN (SELECT fid FROM stmt WHERE kind = 'go') AND id IN (SELECT fid FROM p_sync WHERE value LIKE 'mutex_%')", "package"),
    "F14_recursive": _f("recursive", "info", "name || ' calls itself directly'", "functions WHERE id IN (SELECT source FROM e_call WHERE source = target)", "package"),
    "F15_taint_hotspot": _f("taint_hotspot", "warning", "name || ' has taint source (' || source_categories || ') and sink (' || sink_categories || ')'", "meeting", "function=name, package, source_categories, sink_categories"),
    "F16_risk_score": _f("risk_score", "info", "name || ' risk=' || risk_score", "risks", "risk_score, complexity=cc, loc, fan_in, fan_out, package"),
    "F17_dead_code": _f("dead_code", "warning", "'unreachable function ' || name || ' (zero callers)'", """measured WHERE fan_in = 0 AND name NOT GLOB '[A-Z]*' AND name NOT IN ('main', 'init') AND name NOT ILIKE '%test%' AND name NOT ILIKE '%benchmark%' AND name NOT ILIKE '%example%'
        AND package IS NOT NULL AND package NOT ILIKE 'cmd/%' AND id NOT LIKE 'ext::%'""", "name, package"),
    "F18_interface_bloat": _f("interface_bloat", "info", "name || ' has ' || n || ' methods (consider splitting)'", f"(SELECT e.source, count(*) AS n FROM e_ast e JOIN fields c ON c.id = e.target GROUP BY e.source) x JOIN types ON id = source WHERE n >= 5 AND {_IFACE}", "method_count=n, package"),
    "F19_similar_function": _f("similar_function", "info", "name || ' is structurally similar to ' || name_b || ' (cc=' || cc || ', loc≈' || loc || '/' || loc_b || ')'", "twins WHERE package <> package_b AND cc >= 5 AND loc >= 15", "twin_id=id_b, twin_name=name_b, complexity=cc, loc_a=loc, loc_b, package_a=package, package_b"),
    "F20_missing_context_first": _f("missing_context_first", "info", "name || ' has ' || num_params || ' params but context.Context is not first'", """measured WHERE num_params >= 2 AND id IN (SELECT node_id FROM p_function WHERE key = 'has_context' AND value = '1')
        AND id NOT IN (SELECT fid FROM stmt JOIN statements p ON p.id = stmt.id WHERE p.kind = 'parameter' AND p.type_info ILIKE '%context.Context%' AND stmt.place = 0)""", "num_params, package"),
    "F21_large_return": _f("large_return", "info", "name || ' returns ' || n || ' values'", _CHILD.format("results", "true") + " WHERE n >= 4", "result_count=n, package"),
    "F22_bool_params": _f("bool_params", "info", "name || ' has ' || n || ' bool parameters (consider options struct)'", _CHILD.format("statements", "c.kind = 'parameter' AND c.type_info = 'bool'") + " WHERE n >= 2", "bool_count=n, package"),
    "F23_panic_call": _f("panic_call", "warning", "name || ' calls panic() directly'", "functions WHERE id IN (SELECT parent_function FROM statements WHERE kind = 'call' AND name = 'panic')", "package"),
    "F24_god_package": _f("god_package", "warning", "package || ' has ' || n || ' functions (threshold: 50)'", "(SELECT package, min(id) AS id, count(*) AS n FROM functions GROUP BY package) WHERE n > 50", "", "id", _NOWHERE),
    "F25_high_coupling": _f("high_coupling", "warning", "p || ' depends on ' || n || ' packages (threshold: 10)'", "(SELECT source_package AS p, count(*) AS n FROM deps GROUP BY 1) d LEFT JOIN (SELECT package, min(id) AS id FROM functions GROUP BY package) f ON f.package = p WHERE n > 10", "", "id", _NOWHERE),
    "F26_large_interface": _f("large_interface", "info", "name || ' in ' || package || ' has ' || n || ' methods (threshold: 10)'", f"(SELECT source, count(*) AS n FROM e_has_method GROUP BY source) x JOIN types ON id = source WHERE n > 10 AND {_IFACE}", "", "id", _NOWHERE),
    "F27_orphan_type": _f("orphan_type", "info", "name || ' in ' || package || ' has no implements/embeds/method edges'", "types WHERE id NOT IN (SELECT unnest([source, target]) FROM (SELECT * FROM e_implements UNION ALL SELECT * FROM e_embeds UNION ALL SELECT * FROM e_has_method))", "", "id", _NOWHERE),
    "F28_high_churn_complexity": _f("high_churn_complexity", "warning", "r.file || ': ' || commit_count || ' commits, ' || author_count || ' authors, avg complexity ' || trunc(avg_complexity)::BIGINT", "file_risk r LEFT JOIN files f ON f.file = r.file WHERE commit_count >= 10 AND avg_complexity >= 5",
        "file=r.file, commits=commit_count, authors=author_count, churn, avg_complexity, max_complexity", "f.id", "r.file, 1::BIGINT AS line"),
    "F29_unsanitized_sink": _f("unsanitized_sink", "error", "'Taint from ' || source_name || ' (' || source_category || ') reaches sink ' || sink_name || ' in ' || min_hops || ' hops'", "sinks", "source=source_id, sink=sink_id, category=source_category, hops=min_hops, source_name, sink_name", "sink_id"),
    "F30_tainted_container": _f("tainted_container", "info", "container_kind || ' container with tainted data: ' || type_info", "containers WHERE has_taint = 1", "container_kind, type=type_info, function=function_id", "node_id"),
}
NEEDS = (DEPS, ROLES, TAINT, SINKS, CONTAINERS, MEETING, RISKS, TWINS, SIZES, RISK)
ORACLE = {name: sql(text, *NEEDS) for name, text in RULES.items()}


def union(names: list[str]) -> str:
    return "\nUNION ALL ".join(f"({RULES[n]})" for n in names)


STAGE1 = "stage1 AS (" + union([k for k in RULES if k != "F10b_many_params" and int(k[1:3]) <= 23]) + ")"
STAGE2 = "stage2 AS (SELECT * FROM stage1 UNION ALL " + union(["F10b_many_params", "F24_god_package", "F25_high_coupling"]) + ")"
STAGE3 = "stage3 AS (SELECT * FROM stage2 UNION ALL " + union(["F26_large_interface", "F27_orphan_type", "F28_high_churn_complexity", "F29_unsanitized_sink", "F30_tainted_container"]) + ")"
STAGES = (*NEEDS, STAGE1, STAGE2)
ORACLE |= {
    "T04_node_properties": sql("SELECT node_id, key, value FROM props UNION ALL SELECT node_id, 'taint_role', role FROM roles UNION ALL SELECT node_id, 'taint_category', category FROM categories", ROLES),
    "T07_taint_annotations": sql("SELECT node_id, 'taint_role' AS key, role AS value FROM roles UNION ALL SELECT node_id, 'taint_category', category FROM categories", ROLES),
    "T11_findings_summary": sql("SELECT category, max(severity) AS severity, count(*) AS count FROM stage1 GROUP BY category", *STAGES),
    "T30_flow_state": sql("SELECT * FROM flow_state", ROLES, TAINT),
    "T30_unsanitized": sql("SELECT s.source_id, s.source_category, s.sink_id, s.min_hops, c.hops AS clean_hops FROM sinks s LEFT JOIN (SELECT source_id, id, min(hop)::BIGINT AS hops FROM clean GROUP BY ALL) c ON c.source_id = s.source_id AND c.id = s.sink_id", ROLES, TAINT, SINKS,
      "clean(source_id, id, hop) AS (SELECT source_id, source_id, 0 FROM starts UNION SELECT r.source_id, e.target, r.hop + 1 FROM clean r JOIN e_dfg e ON e.source = r.id WHERE r.hop < 8 AND r.id NOT IN (SELECT node_id FROM roles WHERE role = 'barrier'))"),
    "T31_index_sensitivity": sql("SELECT * FROM containers", ROLES, TAINT, CONTAINERS),
    "V17_taint_summary": sql("SELECT label, source_category, count(*) AS node_count FROM flow_state GROUP BY ALL", ROLES, TAINT),
    "V18_container_summary": sql("SELECT container_kind, has_taint, count(*) AS count FROM containers GROUP BY ALL", ROLES, TAINT, CONTAINERS),
}
