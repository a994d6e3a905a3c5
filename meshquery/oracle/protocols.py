"""DuckDB SQL of the communication tables."""

from __future__ import annotations

from ..plans import specs
from .carrier import sql, values


def _rules() -> str:
    rows = []
    for nr, (proto, comp, role, kind, key, value, names, url, sure) in enumerate(specs.ENDPOINTS):
        rows += [(f"{nr:02d}", proto, comp, role, kind, key, value, name, url, sure) for name in names]
    return values(rows)


def _urls(kind: str) -> str:
    return "CASE " + " ".join(f"WHEN name ILIKE '{pattern}' THEN '{url}'" for pattern, url in specs.URLS[kind]) + f" ELSE '{specs.OTHER_URL}' END"


_OUT = ", ".join(f"'{x}'" for x in specs.EXTERNAL)
_OK = "min(is_conforming) = 1"

COMM = f"""
protocols(id, name, description, session_type_client, session_type_server, transport, encoding, pattern) AS (VALUES {values(specs.PROTOCOLS)}),
participants(protocol_id, component, role, description) AS (VALUES {values(specs.PARTICIPANTS)}),
comm_graph(source_component, target_component, protocol_id, direction, label) AS (VALUES {values(specs.LINKS)}),
rules(nr, protocol_id, component, role, endpoint_type, place, place_value, pattern, url, confidence) AS (VALUES {_rules()}),
endpoints AS (SELECT DISTINCT r.nr || ':' || f.id AS id, r.protocol_id, r.component, r.role, r.endpoint_type, f.id AS function_id, f.name AS function_name, f.package, f.file, f.line,
    CASE r.url WHEN 'server' THEN {_urls("server")} WHEN 'contract' THEN {_urls("contract")} ELSE r.url END AS url_path, NULL::VARCHAR AS http_method, r.confidence::DOUBLE AS confidence
  FROM rules r JOIN (SELECT f.*, p.value AS project FROM functions f LEFT JOIN p_function p ON p.node_id = f.id AND p.key = 'project') f
    ON CASE r.place WHEN 'package' THEN f.package ILIKE r.place_value ELSE f.project = r.place_value END AND CASE WHEN r.pattern LIKE '%\\%%' ESCAPE '\\' THEN f.name ILIKE r.pattern ELSE f.name = r.pattern END
  WHERE r.url IS DISTINCT FROM 'contract' OR f.name NOT ILIKE '%marshalJSON%'),
found AS (SELECT protocol_id, component, count(*) AS n, string_agg(DISTINCT package, ',' ORDER BY package) AS packages FROM endpoints GROUP BY ALL),
covered AS (SELECT p.protocol_id, p.component, p.role, coalesce(f.n, 0) AS cnt, f.packages, p.component IN ({_OUT}) AS away FROM participants p LEFT JOIN found f ON f.protocol_id = p.protocol_id AND f.component = p.component),
conformance AS (SELECT protocol_id, component, CASE WHEN cnt >= 1 THEN 'conforming' ELSE 'missing' END AS status, cnt AS endpoints_found, 1::BIGINT AS endpoints_expected,
    CASE WHEN cnt >= 1 THEN 'Endpoints detected in CPG' WHEN away THEN 'External component — not in analyzed codebase' ELSE 'No implementing endpoints found' END AS details FROM covered),
subtype AS (SELECT c.protocol_id, component, CASE role WHEN 'client' THEN session_type_client WHEN 'server' THEN session_type_server END AS projected_type,
    CASE WHEN cnt = 0 THEN '(no implementation detected)' ELSE 'Detected ' || cnt || ' endpoint(s) in ' || coalesce(packages, 'unknown') END AS actual_behavior,
    CASE WHEN away THEN 'assumed_subtype' WHEN cnt >= 2 THEN 'subtype' WHEN cnt = 1 THEN 'equal' ELSE 'incompatible' END AS relation, CASE WHEN away OR cnt >= 1 THEN 1 ELSE 0 END::BIGINT AS is_conforming,
    CASE WHEN away THEN 'external (assumed conforming)' WHEN cnt >= 2 AND role = 'server' THEN 'branching contravariance: server handles ≥ required message types' WHEN cnt >= 2 AND role = 'client' THEN 'selection covariance: client sends ≤ allowed message types'
      WHEN cnt = 1 THEN 'direct conformance (single endpoint)' ELSE 'no implementation found' END AS subtype_direction,
    CASE WHEN away THEN 'External component not in analyzed codebase. Per Honda corrected theory, assumed to satisfy G|>p ≤ Γ(s[p]) (subtype conformance).'
      WHEN cnt >= 1 THEN 'Implementation detected. Per Yoshida & Hou 2024 corrected projection theorem (T-4.7): G|>p ≤ Γ(s[p]) holds via ' || CASE role WHEN 'server' THEN 'branching contravariance (handles all required message types).' WHEN 'client' THEN 'selection covariance (sends only allowed message types).' END
      ELSE 'WARNING: No implementing endpoints found. Cannot verify G|>p ≤ Γ(s[p]). This may indicate dead protocol code or incomplete analysis.' END AS explanation FROM covered c JOIN protocols p ON p.id = c.protocol_id),
io_s AS (SELECT id AS s FROM endpoints WHERE protocol_id = 'adapter_series' AND component = 'adapter' ORDER BY 1 LIMIT 3), io_t AS (SELECT id AS t FROM endpoints WHERE protocol_id IN ('adapter_query', 'adapter_query_range') AND component = 'adapter' ORDER BY 1 LIMIT 3),
oo_s AS (SELECT id AS s FROM endpoints WHERE protocol_id = 'alertmanager_notify' AND function_name ILIKE '%sendAll%' ORDER BY 1 LIMIT 1), oo_t AS (SELECT id AS t FROM endpoints WHERE protocol_id = 'alertmanager_notify' AND function_name ILIKE '%sendOne%' ORDER BY 1 LIMIT 1),
ii_s AS (SELECT id AS s FROM endpoints WHERE protocol_id = 'discovery' AND role = 'client' ORDER BY 1 LIMIT 3), ii_t AS (SELECT id AS t FROM endpoints WHERE protocol_id = 'scrape' AND role = 'client' ORDER BY 1 LIMIT 3),
causality AS ((SELECT s AS source_endpoint, t AS target_endpoint, 'IO' AS kind, 'adapter_series' AS protocol_id, 'Adapter receives series metadata (input), uses it to construct PromQL queries (output)' AS description FROM io_s, io_t ORDER BY 1, 2 LIMIT 3)
  UNION ALL (SELECT s, t, 'OO', 'alertmanager_notify', 'Alert batches sent to same Alertmanager preserve FIFO ordering' FROM oo_s, oo_t) UNION ALL (SELECT s, t, 'II', 'discovery', 'Discovery updates from same provider must be processed sequentially' FROM ii_s, ii_t ORDER BY 1, 2 LIMIT 3)),
assoc AS (SELECT protocol_id, 1::BIGINT AS all_projectable, count(*) AS projectable_count, count(*) AS total_participants, CASE WHEN {_OK} THEN 1 ELSE 0 END::BIGINT AS all_subtype_conforming, sum(is_conforming)::BIGINT AS conforming_count,
    1::BIGINT AS acyclic_dependencies, 0::BIGINT AS cycle_count, CASE WHEN {_OK} THEN 1 ELSE 0 END::BIGINT AS is_associated,
    CASE WHEN {_OK} THEN 'VERIFIED: no protocol violations possible (Yoshida & Hou 2024, Thm 3)' ELSE 'UNVERIFIED: association relation does not hold' END AS s_safe,
    CASE WHEN {_OK} THEN 'VERIFIED: no circular wait (acyclic causality graph, correcting Honda 2008 Thm 5.1)' ELSE 'UNVERIFIED: subtype conformance incomplete' END AS s_deadlock_free,
    CASE WHEN {_OK} THEN 'VERIFIED: all branches reachable under fair scheduling (Yoshida & Hou 2024, Thm 3)' ELSE 'UNVERIFIED: association relation does not hold' END AS s_live,
    'Honda 2008 corrected by: Scalas & Yoshida "Less is More" (ECOOP 2019), Yoshida & Hou "Revisiting Subtyping for Session Types" (2024). Original Thms 4.6, 4.7, 5.1, 5.2 require association relation (subtyping + acyclicity) instead of simple coherence.' AS errata_reference
  FROM subtype GROUP BY protocol_id),
verdicts AS (SELECT protocol_id, p.name AS protocol_name, CASE is_associated WHEN 1 THEN '✓ ASSOCIATED' ELSE '✗ NOT ASSOCIATED' END AS verdict, projectable_count || '/' || total_participants AS projection_coverage, conforming_count || ' conforming' AS subtype_status,
    'acyclic' AS dependency_graph, s_safe, s_deadlock_free, s_live, errata_reference FROM assoc JOIN protocols p ON p.id = protocol_id)"""
CHANNELS = f"""channels AS (SELECT 'prometheus' AS component, 'fan_out' AS pattern, NULL::VARCHAR AS session_type, 'chan TargetGroup[]' AS channel_type, 'discovery' AS sender_package, package AS receiver_package, count(*) AS goroutine_count,
    'Discovery manager fans out target groups to ' || package || ' consumers' AS description FROM stmt WHERE kind = 'select' AND package IN ('scrape', 'notifier', 'rules') GROUP BY package
  UNION ALL SELECT DISTINCT 'prometheus', 'signal', NULL, 'chan struct{{}}', package, NULL, 0, 'Shutdown/cancellation signal in ' || package FROM stmt WHERE kind = 'send' AND package NOT ILIKE 'github.com%'
  UNION ALL SELECT 'prometheus', p, t, NULL, NULL, NULL, 0, d FROM (VALUES {values(specs.CHANNELS)}) x(p, t, d))"""
CYCLES = """c AS (SELECT source, target FROM e_call WHERE source <> target),
cyc AS (SELECT a.source || ' → ' || a.target || ' → ' || a.source AS cycle_path, 2::BIGINT AS cycle_length FROM c a JOIN c b ON b.source = a.target AND b.target = a.source WHERE a.source < b.source
  UNION ALL SELECT concat_ws(' → ', x.source, y.source, z.source, x.source), 3 FROM c x JOIN c y ON y.source = x.target JOIN c z ON z.source = y.target AND z.target = x.source WHERE x.source < y.source AND x.source < z.source AND y.source <> z.source)"""
LOOPS = """loops AS (SELECT a.source_endpoint || ' → ' || a.target_endpoint || ' → ' || a.source_endpoint AS cycle_path, 2::BIGINT AS cycle_length, a.protocol_id || ', ' || b.protocol_id AS involved_protocols, CASE WHEN a.kind = b.kind AND a.kind <> 'OO' THEN 'deadlock_risk' ELSE 'benign' END AS severity,
    '' AS scalas_yoshida_class, '' AS description FROM causality a JOIN causality b ON a.target_endpoint = b.source_endpoint AND a.source_endpoint = b.target_endpoint AND (a.source_endpoint, a.kind) < (b.source_endpoint, b.kind))"""

ORACLE = {
    "T34_endpoints": sql("SELECT * FROM endpoints", COMM),
    "T35_channel_patterns": sql("SELECT * FROM channels", CHANNELS),
    "T36_causality": sql("SELECT * FROM causality", COMM),
    "T37_conformance": sql("SELECT * FROM conformance", COMM),
    "T38_subtype_check": sql("SELECT * FROM subtype", COMM),
    "T39_dependency_cycles": sql("SELECT * FROM loops", COMM, LOOPS),
    "RG13_cycles": sql("SELECT * FROM cyc", CYCLES),
    "T40_association": sql("SELECT * FROM assoc", COMM),
    "V20_protocol_coverage": sql("""SELECT p.id AS protocol_id, p.name, p.transport, s.participants, s.conforming_count, s.missing_count, coalesce(e.n, 0) AS total_endpoints, CASE WHEN missing_count = 0 THEN 'fully_covered' WHEN conforming_count > 0 THEN 'partially_covered' ELSE 'no_coverage' END AS coverage_status
      FROM protocols p JOIN (SELECT protocol_id, string_agg(component || '(' || role || ')', ',' ORDER BY component || '(' || role || ')') AS participants, count(*) FILTER (cnt >= 1) AS conforming_count, count(*) FILTER (cnt = 0) AS missing_count FROM covered GROUP BY protocol_id) s ON s.protocol_id = p.id
      LEFT JOIN (SELECT protocol_id, count(*) AS n FROM endpoints GROUP BY protocol_id) e ON e.protocol_id = p.id""", COMM),
    "V21_comm_endpoint_detail": sql("SELECT e.id, e.protocol_id, p.name AS protocol_name, component, role, endpoint_type, function_name, package, file, line, url_path, confidence FROM endpoints e JOIN protocols p ON p.id = e.protocol_id", COMM),
    "V23_causality_summary": sql("SELECT c.kind, c.protocol_id, c.description, s.function_name AS source_function, t.function_name AS target_function FROM causality c JOIN endpoints s ON s.id = c.source_endpoint JOIN endpoints t ON t.id = c.target_endpoint", COMM),
    "V24_association_summary": sql("SELECT * FROM verdicts", COMM),
    "V25_subtype_detail": sql("SELECT protocol_id, p.name AS protocol_name, component, projected_type, actual_behavior, relation, CASE is_conforming WHEN 1 THEN '≤ (subtype holds)' ELSE '⊄ (not a subtype)' END AS conformance, subtype_direction, explanation FROM subtype JOIN protocols p ON p.id = protocol_id", COMM),
    "V26_dependency_cycles": sql("SELECT cycle_path, cycle_length, severity, scalas_yoshida_class, description FROM loops", COMM, LOOPS),
}
