"""DuckDB SQL of the named queries; seeds are chosen from the data."""

from __future__ import annotations

from .carrier import rounded, sql
from .findings import CONTAINERS, MEETING, ROLES, SINKS, STAGES, TAINT
from .protocols import CHANNELS, COMM, LOOPS
from .tables import CHAINS, DETAIL, HEAT, HIERARCHY, HOT, IMPL, METHODS, OUTLINE, PATTERNS, SCIP, SYMBOLS, TOP, XREFS
from .views import AFFECTED, COHESION, CONCURRENCY, DEPS, PROFILE, REACH, SIZES, STABILITY

FN = "(SELECT min(source) FROM e_call)"
END = "(SELECT min(b.target) FROM e_call a JOIN e_call b ON b.source = a.target WHERE a.source = (SELECT min(source) FROM e_call) AND b.target <> a.source)"
FLOW = "(SELECT min(source) FROM e_dfg)"
FLOW_END = "(SELECT max(target) FROM e_dfg)"
BLOCK = "(SELECT max(source) FROM e_scope)"
FACE = "(SELECT min(target) FROM e_implements)"
FACE_NAME = f"(SELECT name FROM types WHERE id = {FACE})"
BUSY = "(SELECT source FROM e_call GROUP BY source ORDER BY count(*) DESC, source LIMIT 1)"
CALLED = "(SELECT target FROM e_call GROUP BY target ORDER BY count(*) DESC, target LIMIT 1)"
FORMAL = "(SELECT target FROM e_param_in GROUP BY target ORDER BY count(*) DESC, target LIMIT 1)"
OUT = "(SELECT source FROM e_param_out GROUP BY source ORDER BY count(*) DESC, source LIMIT 1)"
FAILS = "(SELECT source FROM e_call JOIN p_function ON node_id = target AND key = 'returns_error' AND value = '1' GROUP BY source ORDER BY count(*) DESC, source LIMIT 1)"
BB_FN = "(SELECT min(fid) FROM ways)"


def walk(edges: str, start: str, depth: int) -> str:
    return f"r(id, depth) AS (SELECT {start}, 0::BIGINT UNION SELECT e.b, r.depth + 1 FROM r JOIN ({edges}) e ON e.a = r.id WHERE r.depth < {depth})"


def paths(edges: str, start: str, depth: int) -> str:
    return f"r(id, depth, path) AS (SELECT {start}, 0::BIGINT, [{start}] UNION ALL SELECT e.b, r.depth + 1, list_append(r.path, e.b) FROM r JOIN (SELECT DISTINCT a, b FROM ({edges})) e ON e.a = r.id WHERE r.depth < {depth} AND NOT list_contains(r.path, e.b))"


def along(*kinds: str, back: bool = False) -> str:
    a, b = ("target", "source") if back else ("source", "target")
    return " UNION ALL ".join(f"SELECT {a} AS a, {b} AS b FROM e_{k}" for k in kinds)


BACKWARD = walk(along("dfg", "param_in", back=True), FORMAL, 20)
FORWARD = walk(along("dfg", "param_out"), OUT, 20)
CHAIN = paths(along("call"), FN, 10)
CALLERS = walk(along("call", back=True), CALLED, 5)
IMPACT = walk(along("call", back=True), CALLED, 8)
SCOPES = f"r(id) AS (SELECT {BLOCK} UNION SELECT e.target FROM r JOIN e_scope e ON e.source = r.id)"
ERRORS = walk("SELECT source AS a, target AS b FROM e_call WHERE target IN (SELECT node_id FROM p_function WHERE key = 'returns_error' AND value = '1')", FAILS, 10)
FLOWS = paths(along("dfg"), FLOW, 15)
LAYERS = "r(id, depth) AS (SELECT DISTINCT source_package, 0 FROM deps WHERE source_package NOT IN (SELECT target_package FROM deps) UNION SELECT d.target_package, r.depth + 1 FROM r JOIN deps d ON d.source_package = r.id WHERE r.depth < 20)"
ROUTES = paths(along("call"), FN, 6)
_HAS = "(SELECT node_id FROM p_function WHERE key = 'has_context' AND value = '1')"
_PAIR = "SELECT id, name, package, file, line FROM functions WHERE id IN (SELECT {0} FROM e_call WHERE {1} = {2}) AND id IN (SELECT {0} FROM e_call WHERE {1} = {3})"
_SEEN = "SELECT {0} FROM e_call WHERE {1} = {2}"

ORACLE = {
    "Q01_backward_slice": sql("SELECT * FROM nodes WHERE id IN (SELECT id FROM r)", BACKWARD),
    "Q02_forward_slice": sql("SELECT * FROM nodes WHERE id IN (SELECT id FROM r)", FORWARD),
    "Q03_call_chain": sql("SELECT DISTINCT r.id, n.name, n.package, r.depth FROM r JOIN functions n ON n.id = r.id", CHAIN),
    "Q04_callers_of": sql("SELECT r.id, n.name, n.package, r.depth FROM r JOIN functions n ON n.id = r.id", CALLERS),
    "Q05_scope_variables": sql("SELECT n.* FROM e_ast e JOIN statements n ON n.id = e.target AND n.kind IN ('local', 'parameter') WHERE e.source IN (SELECT id FROM r)", SCOPES),
    "Q06_interface_implementors": sql(f"SELECT n.id, n.name, n.package, n.file, n.line FROM e_implements e JOIN types n ON n.id = e.source WHERE e.target = {FACE}"),
    "Q07_function_cfg": sql(f"""SELECT b.id AS block_id, b.name AS block_name, b.line AS block_line, f.bb2 AS successor_id, t.name AS successor_name, f.label AS branch_label
      FROM bbs b LEFT JOIN ways f ON b.id = f.bb LEFT JOIN bbs t ON t.id = f.bb2 WHERE b.parent_function = {BB_FN}"""),
    "Q08_cross_package_calls": sql("SELECT s.package AS caller_pkg, s.name AS caller, t.package AS callee_pkg, t.name AS callee FROM e_call c JOIN functions s ON s.id = c.source JOIN functions t ON t.id = c.target WHERE s.package <> t.package"),
    "Q09_context_propagation": sql(f"""SELECT s.id AS caller_id, s.name AS caller_name, s.package AS caller_pkg, t.id AS callee_id, t.name AS callee_name, t.package AS callee_pkg, CASE WHEN t.id IN {_HAS} THEN 'propagated' ELSE 'MISSING' END AS ctx_status
      FROM e_call c JOIN functions s ON s.id = c.source JOIN functions t ON t.id = c.target WHERE s.id IN {_HAS}"""),
    "Q10_reaching_definitions": sql(f"SELECT n.id, n.name, n.kind, n.file, n.line, n.type_info FROM e_dfg e JOIN statements n ON n.id = e.source WHERE e.target = {FLOW_END}"),
    "Q11_package_dependency_graph": sql("SELECT * FROM deps", DEPS),
    "Q12_goroutine_analysis": sql("""SELECT g.id AS go_id, g.file, g.ok * 10 + g.rn AS line, f.name AS parent_function, s.v AS sync_primitives, count(*) OVER (PARTITION BY g.fid) AS goroutine_count
      FROM stmt g JOIN functions f ON f.id = g.fid LEFT JOIN (SELECT fid, string_agg(DISTINCT value, ',' ORDER BY value) AS v FROM p_sync GROUP BY fid) s ON s.fid = g.fid WHERE g.kind = 'go'"""),
    "Q13_taint_analysis": sql("""SELECT n.id, n.name, n.file, n.line, n.parent_function, r.role AS taint_role, c.category AS taint_category, f.name AS function_name FROM roles r JOIN statements n ON n.id = r.node_id JOIN categories c ON c.node_id = r.node_id LEFT JOIN functions f ON f.id = n.parent_function""", ROLES),
    "Q14_taint_path": sql("SELECT * FROM meeting", ROLES, MEETING),
    "Q15_function_io": sql("""SELECT f.id AS function_id, f.name AS function_name, f.package, x.id AS io_node_id, x.name AS io_name, x.kind AS io_kind, x.type_info AS io_type, CASE WHEN x.properties LIKE '%"mutable":true%' THEN 1 END::BIGINT AS is_mutable, CASE WHEN x.properties LIKE '%"nullable":true%' THEN 1 END::BIGINT AS is_nullable
      FROM functions f JOIN (SELECT * FROM statements WHERE kind = 'parameter' UNION ALL SELECT * FROM results) x ON x.parent_function = f.id WHERE f.id = (SELECT min(fid) FROM stmt WHERE kind IN ('parameter', 'return'))"""),
    "Q16_type_methods": sql("SELECT id, name, file, line, type_info, cc AS complexity, loc FROM measured JOIN p_function ON node_id = id AND key = 'receiver' WHERE value = (SELECT min(value) FROM p_function WHERE key = 'receiver')"),
    "Q17_error_chain": sql("SELECT r.id, n.name, n.package AS pkg, r.depth FROM r JOIN functions n ON n.id = r.id", ERRORS),
    "Q18_data_flow_path": sql("SELECT r.id, n.name, n.kind, n.file, n.line, r.depth FROM r JOIN statements n ON n.id = r.id", FLOWS),
    "Q19_shared_callers": sql(_PAIR.format("source", "target", f"(SELECT min(target) FROM ({_SEEN.format('target', 'source', BUSY)}))", f"(SELECT max(target) FROM ({_SEEN.format('target', 'source', BUSY)}))")),
    "Q20_impact_analysis": sql("SELECT r.id, n.name, n.package, n.file, n.line, r.depth FROM r JOIN functions n ON n.id = r.id", IMPACT),
    "Q21_common_callee": sql(_PAIR.format("target", "source", f"(SELECT min(source) FROM ({_SEEN.format('source', 'target', CALLED)}))", f"(SELECT max(source) FROM ({_SEEN.format('source', 'target', CALLED)}))")),
    "Q22_dependency_depth": sql("SELECT id AS package, max(depth)::BIGINT AS max_depth FROM r GROUP BY id", DEPS, LAYERS),
    "Q23_function_risk_ranking": sql("SELECT id AS node_id, file, line, name || ' risk=' || risk_score AS message, risk_score, cc AS complexity, loc, fan_in, fan_out, package FROM risks ORDER BY risk_score DESC, id LIMIT 50", *STAGES),
    "Q24_package_stability": sql(f"SELECT *, {rounded('abs(instability + abstractness - 1.0::DOUBLE)', 3)} AS distance_from_main_seq FROM stability", DEPS, STABILITY),
    "Q25_function_control_profile": sql(f"SELECT * FROM profile WHERE function_id = {FN}", PROFILE),
    "Q26_similar_functions": sql("""SELECT b.id, b.name, b.package, b.file, b.line, b.cc AS complexity, b.loc, b.num_params FROM measured a JOIN measured b ON a.cc = b.cc AND a.num_params = b.num_params AND abs(a.loc - b.loc) <= 5 AND a.id <> b.id
      WHERE a.id = (SELECT min(a.id) FROM measured a JOIN measured b ON a.cc = b.cc AND a.num_params = b.num_params AND abs(a.loc - b.loc) <= 5 AND a.id < b.id)"""),
    "Q27_package_cohesion": sql("SELECT * FROM cohesion", COHESION),
    "Q28_concurrency_profile": sql("SELECT * FROM concurrency", CONCURRENCY),
    "Q29_package_impact": sql(AFFECTED, DEPS, REACH),
    "Q30_function_neighborhood": sql(f"""SELECT 'caller' AS direction, n.id, n.name, n.package, n.file, n.line FROM e_call c JOIN functions n ON n.id = c.source WHERE c.target = {BUSY}
      UNION ALL SELECT 'callee', n.id, n.name, n.package, n.file, n.line FROM e_call c JOIN functions n ON n.id = c.target WHERE c.source = {BUSY}"""),
    "Q31_file_complexity": sql("SELECT file, function_count, total_complexity, max_complexity, avg_complexity, total_loc FROM file_sizes", SIZES),
    "Q32_type_usage": sql("SELECT id, name, package, file, line, type_info FROM functions WHERE type_info ILIKE '%map[%' OR id IN (SELECT e.source FROM e_ast e JOIN (SELECT id, type_info FROM statements WHERE kind = 'parameter' UNION ALL SELECT id, type_info FROM results) x ON x.id = e.target WHERE x.type_info ILIKE '%map[%')"),
    "Q33_hotspot_analysis": sql("SELECT function_id, name, package, complexity, fan_in, finding_count, hotspot_score FROM hot ORDER BY hotspot_score DESC, function_id LIMIT 20", *STAGES, HOT),
    "Q34_package_coupling_matrix": sql("SELECT source_package, target_package, call_count FROM deps ORDER BY call_count DESC, source_package, target_package LIMIT 50", DEPS),
    "Q35_error_propagation": sql("SELECT * EXCLUDE (chain_depth) FROM chains ORDER BY error_wraps DESC, function_id LIMIT 30", CHAINS),
    "Q36_top_by_metric": sql("SELECT rank, function_id, name, package, value FROM leaders WHERE metric = 'fan_in'", TOP),
    "Q37_coupling_degree": sql("SELECT source_package, count(*) AS coupled_to, sum(call_count)::BIGINT AS total_calls FROM deps GROUP BY source_package", DEPS),
    "Q38_pathfinder": sql(f"SELECT array_to_string(path, ' -> ') AS path, depth FROM r WHERE id = {END} AND depth > 0 ORDER BY depth, path LIMIT 10", ROUTES),
    "Q39_file_heatmap": sql("SELECT file, package, total_complexity, total_loc, finding_count, hotspot_score FROM heat", *STAGES, HEAT),
    "Q40_package_graph": sql("SELECT source_package AS source, target_package AS target, call_count AS weight FROM deps WHERE call_count >= 2 AND NOT regexp_matches(source_package || ' ' || target_package, '(^| )(github.com|golang.org)/')", DEPS),
    "Q41_function_detail": sql(f"SELECT * FROM detail WHERE function_id = {BUSY}", *STAGES, DETAIL),
    "Q42_interface_map": sql(f"SELECT concrete_name, concrete_package, method_count FROM impl WHERE interface_name = {FACE_NAME}", IMPL),
    "Q43_type_hierarchy_tree": sql("SELECT type_name, type_package, embedded_name, embedded_package FROM hierarchy WHERE type_name = (SELECT max(type_name) FROM hierarchy WHERE depth = 1)", HIERARCHY),
    "Q44_method_set": sql(f"SELECT method_name, signature, complexity, loc FROM methods WHERE type_name = {FACE_NAME}", METHODS),
    "Q45_largest_interfaces": sql("SELECT interface_name, interface_package, count(*) AS impl_count FROM impl GROUP BY interface_id, interface_name, interface_package", IMPL),
    "Q46_most_implemented": sql("SELECT interface_name, interface_package, count(*) AS impl_count FROM impl GROUP BY interface_id, interface_name, interface_package ORDER BY impl_count DESC, interface_id LIMIT 20", IMPL),
    "Q47_symbol_search": sql("SELECT id, name, kind, package, file, line FROM symbols WHERE name ILIKE '%get1%' ORDER BY kind, name, id LIMIT 50", SYMBOLS),
    "Q48_file_outline": sql("SELECT name, kind, line, end_line, signature, depth FROM outline WHERE file = (SELECT min(file) FROM outline)", OUTLINE),
    "Q49_xref_lookup": sql("SELECT use_file, use_line, use_kind FROM xrefs WHERE def_id = (SELECT min(def_id) FROM xrefs)", XREFS),
    "Q50_go_patterns": sql("SELECT * FROM patterns", PATTERNS),
    "Q51_taint_path_to_sink": sql("SELECT * FROM sinks", ROLES, TAINT, SINKS),
    "Q52_tainted_containers": sql("SELECT c.node_id, c.container_kind, c.type_info, c.file, c.line, n.name FROM containers c JOIN statements n ON n.id = c.node_id WHERE has_taint = 1", ROLES, TAINT, CONTAINERS),
    "Q53_scip_lookup": sql("SELECT scip_id, kind, display_name, file, line FROM scip WHERE display_name ILIKE '%serve1%'", SCIP),
    "Q56_protocol_endpoints": sql("SELECT protocol_id, component, role, function_name, package, file || ':' || line AS location, url_path FROM endpoints", COMM),
    "Q57_conformance_report": sql("SELECT protocol_id, component, status, endpoints_found, details FROM conformance", COMM),
    "Q58_deadlock_check": sql("SELECT a.kind || ' → ' || b.kind AS causality_chain, a.description, b.description AS next_description FROM causality a JOIN causality b ON b.source_endpoint = a.target_endpoint WHERE a.source_endpoint <> b.target_endpoint", COMM),
    "Q59_channel_patterns": sql("SELECT pattern, channel_type, sender_package, receiver_package, goroutine_count, description FROM channels", CHANNELS),
    "Q60_association_report": sql("SELECT * EXCLUDE (protocol_name, errata_reference) FROM verdicts", COMM),
    "Q61_subtype_violations": sql("SELECT protocol_id, component, projected_type, actual_behavior, relation, explanation FROM subtype WHERE is_conforming = 0", COMM),
    "Q62_deadlock_detection": sql("SELECT cycle_path, cycle_length, severity, scalas_yoshida_class, description FROM loops WHERE severity <> 'benign'", COMM, LOOPS),
    "Q63_errata_summary": sql("SELECT protocol_id, errata_reference, s_safe, s_deadlock_free, s_live FROM assoc WHERE is_associated = 1", COMM),
    # the walks beneath, with what the queries leave out
    "RG01_backward_depths": sql("SELECT id, min(depth) AS depth FROM r GROUP BY id", BACKWARD),
    "RG02_forward_depths": sql("SELECT id, min(depth) AS depth FROM r GROUP BY id", FORWARD),
    "RG03_call_paths": sql("SELECT depth, count(*) AS paths, count(DISTINCT id) AS ends FROM r GROUP BY depth", CHAIN),
    "RG04_caller_levels": sql("SELECT depth, count(*) AS functions FROM r GROUP BY depth", CALLERS),
    "RG05_scope_chain": sql("SELECT id FROM r", SCOPES),
    "RG06_error_levels": sql("SELECT depth, count(*) AS functions FROM r GROUP BY depth", ERRORS),
    "RG07_flow_paths": sql("SELECT array_to_string(path, ' -> ') AS path, depth FROM r", FLOWS),
    "RG07_flow_ends": sql("SELECT r.id, n.name, n.kind, n.file, n.line, r.depth, count(*) AS paths FROM r JOIN statements n ON n.id = r.id GROUP BY ALL", FLOWS),
    "RG08_impact_levels": sql("SELECT depth, count(*) AS functions FROM r GROUP BY depth", IMPACT),
    "RG09_dependency_layers": sql("SELECT id AS package, depth::BIGINT AS depth FROM r", DEPS, LAYERS),
    "RG10_package_reach": sql("SELECT package, id, min(depth)::BIGINT AS depth FROM reach GROUP BY package, id", DEPS, REACH),
    "RG11_all_routes": sql(f"SELECT array_to_string(path, ' -> ') AS path, depth FROM r WHERE id = {END} AND depth > 0", ROUTES),
    "RG12_taint_reach": sql("SELECT source_id, node_id, min_hops FROM flow_state", ROLES, TAINT),
}
