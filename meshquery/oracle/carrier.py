"""The order tables' graph in DuckDB SQL, written apart from the DataFrame code it is held against.

Each kind of edge is a table of its own, ``e_<kind>``, and a query carries only the tables that it names, directly or
through others.
"""

from __future__ import annotations

import re

from ..plans import specs

# The carrier's names, stated again: a wrong constant on the other side would show.
NAMES = [
    ("prometheus", "scrape", "*scrapeLoop.run"), ("prometheus", "scrape", "*scrapeLoop.scrapeAndReport"), ("prometheus", "storage/remote", "*QueueManager.sendBatch"),
    ("prometheus", "storage/remote", "*Client.Store"), ("prometheus", "storage/remote", "*writeHandler.ServeHTTP"), ("prometheus", "storage/remote", "*Client.Read"),
    ("prometheus", "storage/remote", "*readHandler.ServeHTTP"), ("prometheus", "notifier", "*sendLoop.sendAll"), ("prometheus", "notifier", "*sendLoop.sendOne"),
    ("prometheus", "storage/remote", "*otlpWriteHandler.ServeHTTP"), ("prometheus", "web/api/v1", "*API.query"), ("prometheus", "web/api/v1", "*API.queryRange"),
    ("prometheus", "web/api/v1", "*API.series"), ("prometheus", "web/api/v1", "*API.targets"), ("prometheus", "web/api/v1", "*API.alerts"), ("prometheus", "web", "*Handler.federation"),
    ("prometheus", "discovery/dns", "*Discovery.refresh"), ("adapter", "pkg/client", "*queryClient.Query"), ("adapter", "pkg/client", "*queryClient.Series"),
    ("adapter", "pkg/client", "*httpAPIClient.Do"), ("adapter", "cmd/adapter", "makeProvider"), ("client_golang", "api/v1", "*httpAPI.Query"), ("client_golang", "api/v1", "*httpAPI.Series"),
    ("client_golang", "api/v1", "*httpAPI.Targets"), ("client_golang", "api/v1", "*httpClient.Do"),
]
OUTER = list(dict.fromkeys([(p, f) for p, f, *_ in specs.TAINTS] + [(p, f) for p, f, *_ in specs.FLOWS])) + [("encoding/json", "Unmarshal"), ("io", "Copy")] * 10


def values(rows: list[tuple]) -> str:
    def lit(v) -> str:
        return "NULL" if v is None else str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"

    return ",\n  ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


def tables(text: str) -> dict[str, str]:
    """Named tables of a WITH clause: name to definition."""
    found: dict[str, str] = {}
    at = 0
    head = re.compile(r"[\s,]*(\w+)\s*(\([^)]*\))?\s+AS\s+\(", re.S)
    while m := head.match(text, at):
        depth, end, quoted = 1, m.end(), False
        while depth:
            c = text[end]
            quoted ^= c == "'"
            depth += 0 if quoted else (c == "(") - (c == ")")
            end += 1
        found[m.group(1)] = text[m.start(1) : end]
        at = end
    if text[at:].strip(" \n,"):
        raise ValueError(text[at : at + 80])
    return found


def _props(*pairs: tuple[str, str]) -> str:
    """A JSON object of the pairs whose value isn't null."""
    return "'{' || concat_ws(',', " + ", ".join(f"""'"{k}":' || ({v})""" for k, v in pairs) + ") || '}'"


_FUNCTION = _props(
    ("full_name", "'\"' || package || '.' || name || '\"'"), ("exported", "CASE WHEN regexp_matches(name, '^[A-Z]') THEN 'true' ELSE 'false' END"), ("has_context", "CASE WHEN pk % 4 = 0 THEN 'true' END"),
    ("returns_error", "CASE WHEN pk % 8 <= 2 THEN 'true' END"), ("receiver", "CASE WHEN pk % 6 = 1 THEN '\"T' || pk % 50 || '\"' END"), ("external", "CASE WHEN outside THEN 'true' END"),
    ("project", "'\"' || project || '\"'"), ("inlineable", "CASE WHEN NOT outside AND pk % 10 = 3 THEN 'true' END"),
)
_SYNC = "CASE WHEN kind = 'call' AND pk % 9 = 0 THEN 'mutex_lock' WHEN kind = 'call' AND pk % 9 = 1 THEN 'rwmutex_lock' WHEN kind = 'go' AND pk % 5 = 0 THEN 'mutex_lock' END"
_STATEMENT = _props(
    ("nesting_depth", "CASE WHEN kind IN ('if', 'for', 'switch', 'select') THEN pk % 12 END"), ("sync_kind", f"'\"' || {_SYNC} || '\"'"),
    ("dispatch_type", "CASE WHEN kind = 'call' THEN '\"' || ['static', 'interface', 'closure'][1 + pk % 3] || '\"' END"), ("context_derivation", "CASE WHEN kind = 'call' AND pk % 6 = 2 THEN '\"with_cancel\"' END"),
    ("index", "CASE WHEN kind = 'parameter' THEN place END"), ("mutable", "CASE WHEN kind = 'parameter' AND pk % 5 IN (1, 2) THEN 'true' END"), ("nullable", "CASE WHEN kind = 'parameter' AND pk % 5 <> 0 THEN 'true' END"),
    ("heap_escapes", "CASE WHEN kind = 'local' AND pk % 6 = 1 THEN 'true' WHEN kind = 'local' AND pk % 6 = 2 THEN 'false' END"),
)
_TYPE = "['bool', 'map[string]int', '[]string', 'context.Context', 'error'][1 + pk % 5]"
_CALLED = "(kind = 'call' OR pk % 421 = 199 OR pk2 % 421 = 199) AND pk2 % 89 <> 7"

EDGES = {
    "call": "SELECT DISTINCT fid AS source, fid2 AS target FROM pair WHERE " + _CALLED,
    "dfg": "SELECT id AS source, id2 AS target FROM pair UNION ALL SELECT source, target FROM d1 UNION ALL SELECT source, target FROM d2 UNION ALL SELECT source, target FROM d3",
    "eog": "SELECT source, target FROM d5 UNION ALL SELECT source, target FROM d6",
    "call_site": "SELECT id AS source, fid2 AS target FROM pair WHERE kind = 'call'",
    "param_out": "SELECT fid2 AS source, id AS target FROM pair WHERE kind = 'call'",
    "argument": "SELECT call AS source, arg AS target FROM args",
    "param_in": "SELECT arg AS source, formal AS target FROM args JOIN (SELECT fid, min(id) AS formal FROM stmt WHERE kind = 'parameter' GROUP BY fid) f ON f.fid = args.fid2",
    "ref": "SELECT id AS source, id2 AS target FROM pair WHERE kind2 = 'local'",
    "error_wrap": "SELECT id AS source, id2 AS target FROM pair WHERE kind = 'call' AND pk % 4 = 1",
    "condition": "SELECT id AS source, id2 AS target FROM pair WHERE kind IN ('if', 'for', 'switch')",
    "ast": """SELECT 'b' || ok AS source, id AS target FROM stmt UNION ALL SELECT 'i' || sk, 'fld' || ok || '_' || rn FROM stmt
      UNION ALL SELECT fid, id FROM stmt WHERE kind IN ('local', 'parameter') UNION ALL SELECT fid, 'res' || ok || '_' || rn FROM stmt WHERE kind = 'return'""",
    "scope": "SELECT DISTINCT 'b' || ok AS source, 'b' || ok // 2 AS target FROM item WHERE ok // 2 IN (SELECT ok FROM item)",
    "cfg": "SELECT bb AS source, bb2 AS target FROM ways",
    "satisfies_method": "SELECT DISTINCT fid AS source, fid2 AS target FROM pair WHERE flag = 'R'",
    "implements": "SELECT DISTINCT 't' || ck AS source, 'i' || sk AS target FROM made",
    "has_method": "SELECT DISTINCT 't' || ck AS source, fid AS target FROM made UNION ALL SELECT DISTINCT 'i' || sk, fid FROM stmt",
    "embeds": "SELECT DISTINCT 't' || ck AS source, 't' || ck // 2 AS target FROM owners WHERE ck > 1 AND ck // 2 IN (SELECT ck FROM owners)",
}
_LABEL = "CASE WHEN rn % 3 = 0 THEN 'true' WHEN rn % 3 = 1 THEN 'false' END"

CARRIER = tables(
    f"""
flow_specs(package, func_name, flow_from, flow_to, description) AS (VALUES {values(specs.FLOWS)}),
taint_specs(package, func_name, role, category, description) AS (VALUES {values(specs.TAINTS)}),
ext_names(pos, package, name) AS (VALUES {values([(k, p, f) for k, (p, f) in enumerate(OUTER)])}),
named(pos, project, package, name) AS (VALUES {values([(k, *x) for k, x in enumerate(NAMES)])}),
item AS (SELECT l_orderkey AS ok, l_partkey AS pk, l_suppkey AS sk, l_quantity AS qty, l_linenumber AS num, l_returnflag AS flag,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_returnflag) AS rn FROM lineitem),
owners AS (SELECT i.*, o_custkey AS ck, o_orderdate AS day FROM item i JOIN orders ON o_orderkey = ok),
fn AS (SELECT p_partkey AS pk, p_partkey % 3 = 0 AS outside, p_size,
    CASE WHEN p_partkey % 3 = 0 THEN 'ext::f' ELSE 'f' END || p_partkey AS id,
    CASE WHEN p_partkey % 3 = 0 THEN e.name WHEN p_partkey % 13 = 5 THEN n.name WHEN p_partkey % 37 = 9 THEN 'init'
         WHEN p_partkey % 5 = 4 THEN 'main' ELSE ['Get', 'load', 'TestRun', '*T.Serve'][1 + p_partkey % 5] || p_partkey END AS name,
    CASE WHEN p_partkey % 3 = 0 THEN e.package WHEN p_partkey % 13 = 5 THEN n.package WHEN p_partkey % 89 = 7 THEN 'cmd/tool' || p_partkey % 3 ELSE lower(p_brand) END AS package,
    CASE WHEN p_partkey % 3 <> 0 THEN 'src/' || replace(p_type, ' ', '_') || '.go' END AS file,
    CASE WHEN p_partkey % 3 <> 0 THEN p_partkey END AS line, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey + 9 + p_partkey % 140 END AS end_line,
    CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 13 = 5 THEN n.project END AS project
  FROM part LEFT JOIN ext_names e ON e.pos = (p_partkey // 3) % {len(OUTER)} LEFT JOIN named n ON n.pos = (p_partkey // 13) % {len(NAMES)}),
stmt AS (SELECT s.*, row_number() OVER (PARTITION BY fid, kind ORDER BY ok, rn) - 1 AS place FROM (SELECT i.ok, i.rn, i.pk, i.sk, i.flag, fn.id AS fid, fn.package, fn.file, 's' || ok || '_' || rn AS id,
    ['if','for','switch','select','return','defer','go','assign','call','send','local','parameter','call','label'][1 + (ok + rn * (1 + ok % 7)) % 14] AS kind
  FROM item i JOIN fn ON fn.pk = i.pk) s),
functions AS (SELECT id, 'function' AS kind, name, file, line, CASE WHEN NOT outside THEN 1 END::BIGINT AS col, end_line, package, NULL::VARCHAR AS parent_function,
    CASE WHEN pk % 2 = 0 THEN 'func(Type' || pk % 20 || ') error' END AS type_info, {_FUNCTION} AS properties FROM fn),
statements AS (SELECT id, kind, CASE WHEN kind = 'local' THEN CASE WHEN rn % 7 = 0 THEN '_' ELSE 'v' || rn END WHEN kind = 'parameter' THEN 'p' || rn
      WHEN kind = 'call' AND pk % 17 = 0 THEN 'panic' WHEN kind = 'call' AND pk % 17 = 1 THEN 'recover' WHEN kind = 'call' AND pk % 17 = 2 THEN CASE WHEN rn % 2 = 0 THEN 'panic' ELSE 'recover' END ELSE kind END AS name, file, ok * 10 + rn AS line, rn AS col, NULL::BIGINT AS end_line, package, fid AS parent_function,
    CASE WHEN kind IN ('local', 'parameter') THEN {_TYPE} END AS type_info, {_STATEMENT} AS properties FROM stmt),
bbs AS (SELECT 'bb' || ok || '_' || rn AS id, 'basic_block' AS kind, 'bb' || rn AS name, file, ok * 10 + rn AS line, NULL::BIGINT AS col, NULL::BIGINT AS end_line, package, fid AS parent_function, NULL::VARCHAR AS type_info, NULL::VARCHAR AS properties FROM stmt),
results AS (SELECT 'res' || ok || '_' || rn AS id, 'result' AS kind, 'r' AS name, file, NULL::BIGINT AS line, NULL::BIGINT AS col, NULL::BIGINT AS end_line, package, fid AS parent_function, {_TYPE} AS type_info, NULL::VARCHAR AS properties FROM stmt WHERE kind = 'return'),
fields AS (SELECT 'fld' || ok || '_' || rn AS id, 'field' AS kind, 'M' || pk AS name, file, ok * 10 + rn AS line, NULL::BIGINT AS col, NULL::BIGINT AS end_line, package, NULL::VARCHAR AS parent_function, NULL::VARCHAR AS type_info, NULL::VARCHAR AS properties FROM stmt),
blocks AS (SELECT DISTINCT 'b' || ok AS id, 'block' AS kind, 'block' AS name, NULL::VARCHAR AS file, NULL::BIGINT AS line, NULL::BIGINT AS col, NULL::BIGINT AS end_line, NULL::VARCHAR AS package, NULL::VARCHAR AS parent_function, NULL::VARCHAR AS type_info, NULL::VARCHAR AS properties FROM item),
types AS (SELECT id, 'type_decl' AS kind, name, file, line, NULL::BIGINT AS col, NULL::BIGINT AS end_line, package, NULL::VARCHAR AS parent_function, NULL::VARCHAR AS type_info, '{{"type_kind":"' || t || '"}}' AS properties FROM (
    SELECT DISTINCT 't' || ck AS id, 'Type' || ck AS name, 'types' || ck % 7 || '.go' AS file, ck::BIGINT AS line, 'types/p' || ck % 20 AS package, 'struct' AS t FROM owners
    UNION ALL SELECT DISTINCT 'i' || sk, 'Iface' || sk, 'ifaces' || sk % 5 || '.go', sk::BIGINT, 'types/p' || sk % 20, 'interface' FROM item
    UNION ALL SELECT 'n' || n_nationkey, 'Nation' || n_nationkey, 'nations.go', (n_nationkey + 1)::BIGINT, 'types/nations', 'struct' FROM nation)),
packages AS (SELECT DISTINCT 'pkg::' || package AS id, 'package' AS kind, package AS name, NULL::VARCHAR AS file, NULL::BIGINT AS line, NULL::BIGINT AS col, NULL::BIGINT AS end_line, package, NULL::VARCHAR AS parent_function, NULL::VARCHAR AS type_info, NULL::VARCHAR AS properties FROM fn),
files AS (SELECT 'file::' || file AS id, 'file' AS kind, file AS name, file, NULL::BIGINT AS line, NULL::BIGINT AS col, NULL::BIGINT AS end_line, min(package) AS package, NULL::VARCHAR AS parent_function, NULL::VARCHAR AS type_info, NULL::VARCHAR AS properties FROM fn WHERE file IS NOT NULL GROUP BY file),
nodes AS (SELECT * FROM functions UNION ALL SELECT * FROM statements UNION ALL SELECT * FROM bbs UNION ALL SELECT * FROM results UNION ALL SELECT * FROM fields UNION ALL SELECT * FROM blocks UNION ALL SELECT * FROM types UNION ALL SELECT * FROM packages UNION ALL SELECT * FROM files),
p_function AS (SELECT id AS node_id, unnest(['full_name', 'exported', 'has_context', 'returns_error', 'receiver', 'external', 'project', 'inlineable']) AS key,
    unnest([package || '.' || name, CASE WHEN regexp_matches(name, '^[A-Z]') THEN '1' ELSE '0' END, CASE WHEN pk % 4 = 0 THEN '1' END, CASE WHEN pk % 8 <= 2 THEN '1' END, CASE WHEN pk % 6 = 1 THEN 'T' || pk % 50 END, CASE WHEN outside THEN '1' END, project, CASE WHEN NOT outside AND pk % 10 = 3 THEN '1' END]) AS value FROM fn),
p_sync AS (SELECT * FROM (SELECT id AS node_id, fid, package, {_SYNC} AS value FROM stmt) WHERE value IS NOT NULL),
p_nesting AS (SELECT id AS node_id, pk % 12 AS depth FROM stmt WHERE kind IN ('if', 'for', 'switch', 'select')),
p_type AS (SELECT id AS node_id, CASE WHEN id LIKE 'i%' THEN 'interface' ELSE 'struct' END AS value FROM types),
props AS (SELECT * FROM p_function WHERE value IS NOT NULL UNION ALL SELECT node_id, 'nesting_depth', depth::VARCHAR FROM p_nesting UNION ALL SELECT node_id, 'sync_kind', value FROM p_sync
  UNION ALL SELECT id, 'dispatch_type', ['static', 'interface', 'closure'][1 + pk % 3] FROM stmt WHERE kind = 'call' UNION ALL SELECT id, 'context_derivation', 'with_cancel' FROM stmt WHERE kind = 'call' AND pk % 6 = 2
  UNION ALL SELECT id, 'index', place::VARCHAR FROM stmt WHERE kind = 'parameter' UNION ALL SELECT id, 'mutable', '1' FROM stmt WHERE kind = 'parameter' AND pk % 5 IN (1, 2)
  UNION ALL SELECT id, 'nullable', '1' FROM stmt WHERE kind = 'parameter' AND pk % 5 <> 0 UNION ALL SELECT id, 'heap_escapes', CASE pk % 6 WHEN 1 THEN '1' ELSE '0' END FROM stmt WHERE kind = 'local' AND pk % 6 IN (1, 2)
  UNION ALL SELECT node_id, 'type_kind', value FROM p_type),
pair AS (SELECT * FROM (SELECT *, lead(fid) OVER w AS fid2, lead(pk) OVER w AS pk2, lead(kind) OVER w AS kind2, lead(id) OVER w AS id2 FROM stmt WINDOW w AS (PARTITION BY ok ORDER BY rn)) WHERE id2 IS NOT NULL),
args AS (SELECT c.id AS call, c.fid2, s.id AS arg, s.rn - c.rn - 1 AS index FROM pair c JOIN stmt s ON s.ok = c.ok AND s.rn > c.rn AND s.rn <= c.rn + 3 WHERE c.kind = 'call'),
flow AS (SELECT fid, pk % 11 = 4 AS endless, kind, rn, 'bb' || ok || '_' || rn AS bb, row_number() OVER (PARTITION BY fid ORDER BY ok, rn) AS pos, count(*) OVER (PARTITION BY fid) AS n FROM stmt),
ways AS (SELECT f.fid, f.bb, t.bb AS bb2, f.label FROM (SELECT fid, bb, pos + 1 AS to_pos, {_LABEL} AS label FROM flow WHERE pos < n AND (kind <> 'return' OR endless) UNION ALL SELECT fid, bb, pos + 3, 'false' FROM flow WHERE kind IN ('if', 'switch') AND pos + 3 <= n
    UNION ALL SELECT fid, bb, pos - 2, NULL FROM flow WHERE kind = 'for' AND pos > 3 UNION ALL SELECT fid, bb, 2, NULL FROM flow WHERE endless AND pos = n AND n >= 3 AND kind <> 'for') f JOIN flow t ON t.fid = f.fid AND t.pos = f.to_pos),
made AS (SELECT o.ck, o.sk, fn.id AS fid FROM owners o JOIN fn ON fn.pk = o.pk WHERE flag = 'R'),
outer_calls AS (SELECT c.id AS call, f.package, f.name AS func_name FROM pair c JOIN functions f ON f.id = c.fid2 WHERE c.kind = 'call' AND f.id LIKE 'ext::%'),
d1 AS (SELECT DISTINCT a.arg AS source, a.call AS target, '{{"heuristic":true}}' AS properties FROM args a JOIN outer_calls o ON o.call = a.call JOIN flow_specs s ON s.package = o.package AND s.func_name = o.func_name
  WHERE s.flow_to LIKE 'return:%' AND s.flow_from IN ('arg:*', 'arg:' || a.index)),
d2 AS (SELECT DISTINCT a.arg AS source, b.arg AS target, '{{"heuristic":true,"side_effect":true}}' AS properties FROM outer_calls o JOIN flow_specs s ON s.package = o.package AND s.func_name = o.func_name AND s.flow_to LIKE 'arg:%'
  JOIN args a ON a.call = o.call AND s.flow_from IN ('arg:*', 'arg:' || a.index) JOIN args b ON b.call = o.call AND s.flow_to = 'arg:' || b.index),
d3 AS (SELECT DISTINCT a.arg AS source, a.call AS target, '{{"heuristic":true}}' AS properties FROM args a JOIN outer_calls o ON o.call = a.call WHERE (o.package, o.func_name) NOT IN (SELECT (s.package, s.func_name) FROM flow_specs s)),
d5 AS (SELECT DISTINCT a.arg AS source, b.arg AS target, NULL::VARCHAR AS properties FROM args a JOIN args b ON b.call = a.call AND b.index = a.index + 1),
d6 AS (SELECT DISTINCT arg AS source, call AS target, '{{"final":true}}' AS properties FROM args QUALIFY index = max(index) OVER (PARTITION BY call)),
{", ".join(f"e_{kind} AS ({text})" for kind, text in EDGES.items())},
raw_edges AS (SELECT id AS source, id2 AS target, 'dfg' AS kind FROM pair UNION ALL {" UNION ALL ".join(f"SELECT source, target, '{kind}' AS kind FROM e_{kind}" for kind in EDGES if kind not in ("dfg", "eog"))}),
edges AS ({" UNION ALL ".join(f"SELECT source, target, '{kind}' AS kind FROM e_{kind}" for kind in EDGES)}),
dynamic_calls AS (SELECT fid AS source, fid2 AS target FROM pair WHERE {_CALLED} GROUP BY fid, fid2 HAVING max(pk + pk2) % 5 = 0),
edge_props AS (SELECT call AS source, arg AS target, 'argument' AS edge_kind, 'index' AS key, index::VARCHAR AS value FROM args UNION ALL SELECT source, target, 'call', 'dynamic', '1' FROM dynamic_calls
  UNION ALL SELECT id, id2, 'dfg', 'var_name', 'v' || rn FROM pair UNION ALL SELECT bb, bb2, 'cfg', 'label', label FROM ways WHERE label IS NOT NULL
  UNION ALL SELECT source, target, 'dfg', unnest(['heuristic', 'side_effect']), '1' FROM d2 UNION ALL SELECT source, target, 'dfg', 'heuristic', '1' FROM d1 UNION ALL SELECT source, target, 'dfg', 'heuristic', '1' FROM d3
  UNION ALL SELECT source, target, 'eog', 'final', '1' FROM d6),
metrics AS (SELECT fn.id AS function_id, CASE WHEN outside THEN 0 ELSE 1 + p_size % 25 END::BIGINT AS cyclomatic_complexity, coalesce(i.n, 0) AS fan_in, coalesce(o.n, 0) AS fan_out,
    CASE WHEN outside THEN 0 ELSE 10 + pk % 140 END::BIGINT AS loc, (pk % 8)::BIGINT AS num_params
  FROM fn LEFT JOIN (SELECT target, count(*) AS n FROM e_call GROUP BY target) i ON i.target = fn.id LEFT JOIN (SELECT source, count(*) AS n FROM e_call GROUP BY source) o ON o.source = fn.id),
measured AS (SELECT f.*, m.cyclomatic_complexity AS cc, m.fan_in, m.fan_out, m.loc, m.num_params FROM functions f JOIN metrics m ON m.function_id = f.id),
sources AS (SELECT 'doc' || doc_id || '.go' AS file, text AS content, source AS package FROM documents),
history AS (SELECT file, count(DISTINCT ok) AS commit_count, count(DISTINCT ck) AS author_count, 'author' || max(ck) AS last_author, strftime(max(day), '%Y-%m-%d') AS last_date, sum(qty::BIGINT)::BIGINT AS insertions, sum(num::BIGINT)::BIGINT AS deletions,
    (sum(qty::BIGINT) + sum(num::BIGINT))::BIGINT AS churn FROM owners o JOIN fn ON fn.pk = o.pk WHERE NOT outside GROUP BY file)
"""
)


def rounded(x: str, digits: int) -> str:
    """Halves away from zero, the value taken to twelve places before."""
    return f"round(CAST({x} AS DECIMAL(38,12)), {digits})::DOUBLE"


def sql(body: str, *more: str | dict[str, str]) -> str:
    """A query over the carrier's tables and ``more``, with those tables that it needs."""
    known = dict(CARRIER)
    for m in more:
        known |= m if isinstance(m, dict) else tables(m)
    word = re.compile(r"\b[a-z_]\w*\b")
    need, todo = set(), [body]
    while todo:
        for name in set(word.findall(todo.pop())) & known.keys() - need:
            need.add(name)
            todo.append(known[name])
    kept = [(name, text) for name, text in known.items() if name in need]
    recursive = any(re.search(rf"\b{name}\b", text[len(name) :]) for name, text in kept)
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(text for _, text in kept) + "\n" + body.strip() if kept else body.strip()
