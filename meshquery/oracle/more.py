"""DuckDB SQL of sources, producers' algorithms, search and the client's lookups."""

from __future__ import annotations

from ..operators.extract import SYNC
from ..schema import TABLES
from .carrier import sql, values
from .findings import STAGES
from .named import BACKWARD, BUSY
from .tables import DETAIL, SYMBOLS, TREEMAP
from .views import DEPS

_SLICE = "hit AS (SELECT id, kind, name, file, line, end_line, package, parent_function, type_info FROM nodes WHERE id IN (SELECT id FROM r))"
_NODES = f"{_SLICE[:-1]} ORDER BY file NULLS FIRST, line NULLS FIRST, id LIMIT 200)"
_NEAR = f"""near AS (SELECT * FROM (SELECT n.id, 'function' AS kind, n.name, n.package, n.file, n.line, 'caller' AS direction FROM e_call c JOIN functions n ON n.id = c.source WHERE c.target = {BUSY}
  UNION ALL SELECT n.id, 'function', n.name, n.package, n.file, n.line, 'callee' FROM e_call c JOIN functions n ON n.id = c.target WHERE c.source = {BUSY}) ORDER BY direction, name, id LIMIT 200),
around AS (SELECT id, kind, name, package, file, line, NULL::VARCHAR AS direction FROM functions WHERE id = {BUSY} UNION ALL SELECT * FROM near)"""
_TREE = """heavy AS (SELECT source_package AS source, target_package AS target, call_count AS weight FROM deps WHERE call_count >= 2 AND NOT regexp_matches(source_package || ' ' || target_package, '(^| )(github.com|golang.org)/') ORDER BY weight DESC, source, target LIMIT 500),
tree AS (SELECT * FROM treemap ORDER BY package LIMIT 200)"""
_DOCS = [("table", name, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)) for name, schema in TABLES.items()]
_SYNC = [tuple(p.strip() for p in line.split(";")) for line in SYNC.strip().split("\n")]
_ESCAPED = "escaped AS (SELECT id, kind, ['leaking_param', 'moved_to_heap', 'inlineable', 'does_not_escape'][1 + line % 4] AS said FROM (SELECT id, kind, line, file FROM functions UNION ALL SELECT id, kind, line, file FROM statements WHERE kind IN ('local', 'parameter')) WHERE file IS NOT NULL)"
_SAME = "same AS (SELECT DISTINCT n.id, n.kind, e.said FROM escaped e JOIN (SELECT id, kind, file, line FROM functions UNION ALL SELECT id, kind, file, line FROM statements WHERE kind IN ('local', 'parameter')) x ON x.id = e.id JOIN (SELECT id, kind, file, line FROM functions UNION ALL SELECT id, kind, file, line FROM statements WHERE kind IN ('local', 'parameter')) n ON n.file = x.file AND n.line = x.line)"

_WORDS = r"""WITH f AS (SELECT 'doc' || doc_id || '.go' AS file, unnest(['file', 'content', 'package']) AS field, unnest(['doc' || doc_id || '.go', coalesce(text, ''), coalesce(source, '')]) AS body FROM documents),
  w AS (SELECT file, field, list_filter(regexp_split_to_array(lower(body), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM f), p AS (SELECT file, field, unnest(ws) AS term, unnest(range(len(ws))) AS at FROM w) """


_VALUES = """passes AS (SELECT source, target FROM e_dfg UNION SELECT source, target FROM e_param_in),
made_with AS (SELECT s.id AS value, 't' || o_custkey AS type FROM stmt s JOIN orders ON o_orderkey = s.ok WHERE s.kind = 'local' UNION SELECT id, 'func:' || fid FROM stmt WHERE kind = 'defer'),
typed(value, type) AS (SELECT * FROM made_with UNION SELECT e.target, t.type FROM typed t JOIN passes e ON e.source = t.value)"""

_CHANNELS = """carries(channel, value) AS (SELECT id, id FROM stmt WHERE kind = 'go' UNION SELECT c.channel, e.target FROM carries c JOIN passes e ON e.source = c.value),
chan AS (SELECT c.channel, s.id, CASE s.kind WHEN 'send' THEN 'send' ELSE 'receive' END AS kind FROM carries c JOIN stmt s ON s.id = c.value WHERE s.kind IN ('send', 'select'))"""


def _dominance(name: str, near: str, far: str) -> str:
    """Dominators by definition: whoever can't be reached any more when one block is taken away is dominated by it."""
    return f"""{name}_roots AS (SELECT id, parent_function AS fid FROM bbs WHERE id NOT IN (SELECT {far} FROM e_cfg)),
      {name}_met(id) AS (SELECT id FROM {name}_roots UNION SELECT e.{far} FROM {name}_met m JOIN e_cfg e ON e.{near} = m.id),
      {name}_without(gone, id) AS (SELECT b.id, r.id FROM bbs b JOIN {name}_roots r ON r.fid = b.parent_function AND r.id <> b.id UNION SELECT w.gone, e.{far} FROM {name}_without w JOIN e_cfg e ON e.{near} = w.id WHERE e.{far} <> w.gone),
      {name}_over AS (SELECT x.id AS a, y.id AS b FROM bbs x JOIN bbs y ON y.parent_function = x.parent_function AND y.id <> x.id WHERE x.id IN (SELECT id FROM {name}_met) AND y.id IN (SELECT id FROM {name}_met)
        AND NOT EXISTS (SELECT 1 FROM {name}_without w WHERE w.gone = x.id AND w.id = y.id)),
      {name}_tree AS (SELECT arg_max(o.a, coalesce(n.n, 0)) AS source, o.b AS target FROM {name}_over o LEFT JOIN (SELECT b, count(*) AS n FROM {name}_over GROUP BY b) n ON n.b = o.a GROUP BY o.b)"""


ORACLE = {
    "S02_nodes": sql("SELECT * FROM nodes"),
    "S04_sources": sql("SELECT file, content, package FROM sources"),
    "S05_metrics": sql("SELECT * FROM metrics"),
    "S06_null_binding": "SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 3 <> 0 THEN source END AS file, CASE WHEN doc_id % 5 <> 0 THEN doc_id % 5 END AS line FROM documents",
    "S07_properties": sql("SELECT node_id, '{' || string_agg('\"' || key || '\":\"' || value || '\"', ',' ORDER BY key) || '}' AS properties FROM props GROUP BY node_id"),
    "S09_escape_log": """SELECT 'src/f' || l_suppkey || '.go' AS file, l_linenumber::BIGINT AS line, l_partkey % 80 AS col, ['leaking_param', 'moved_to_heap', 'escapes_to_heap', 'does_not_escape', 'inlineable'][1 + l_partkey % 6] AS kind,
      ['p', 'v', 'new(T', 'p', 'f'][1 + l_partkey % 6] || l_partkey || CASE WHEN l_partkey % 6 = 2 THEN ')' ELSE '' END AS detail FROM lineitem WHERE l_partkey % 6 < 5 AND l_partkey % 11 <> 0""",
    "S10_change_log": """SELECT 'src/f' || l_suppkey || '.go' AS file, count(DISTINCT l_orderkey) AS commit_count, count(DISTINCT o_custkey) AS author_count, 'Author ' || arg_min(o_custkey, l_orderkey) AS last_author, '2024-01-01T00:00:00Z' AS last_date, sum(l_quantity::BIGINT)::BIGINT AS insertions,
      sum(l_linenumber)::BIGINT AS deletions, (sum(l_quantity::BIGINT) + sum(l_linenumber))::BIGINT AS churn FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_partkey % 9 <> 0 AND l_partkey % 10 <> 0 GROUP BY l_suppkey""",
    "S11_blame": "SELECT o_custkey::VARCHAR AS log, o_orderkey AS line, 'Author ' || o_orderpriority AS author, (o_orderkey + 5)::VARCHAR AS date, lpad(o_orderkey::VARCHAR, 12, '0') AS \"commit\" FROM orders",
    "S12_scan_by_kind": sql("SELECT id, name, package FROM statements WHERE kind = 'send'"),
    "S13_full_text": r"""WITH t AS (SELECT 'doc' || doc_id || '.go' AS file, unnest(list_concat(['doc' || doc_id, 'go'], regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), regexp_split_to_array(lower(source), '[^\p{L}\p{N}]+'))) AS token FROM documents)
      SELECT file, count(*) AS hits FROM t WHERE token IN ('the', 'and') GROUP BY file HAVING count(DISTINCT token) = 2""",
    "S13_phrase": _WORDS + "SELECT a.file, count(*) AS hits FROM p a JOIN p b ON b.file = a.file AND b.field = a.field AND b.at = a.at + 1 WHERE a.term = 'of' AND b.term = 'the' GROUP BY a.file",
    "S13_prefix": _WORDS + "SELECT file, count(*) AS hits FROM p WHERE term LIKE 'thb%' GROUP BY file",
    "S13_boolean": _WORDS + """SELECT file, count(*) FILTER (term IN ('the', 'of', 'idiot', 'moron', 'worthless')) AS hits FROM p GROUP BY file
      HAVING bool_or(term = 'the') AND bool_or(term = 'of') AND bool_or(term IN ('idiot', 'moron', 'worthless')) AND NOT bool_or(term IN ('you', 'za'))""",
    "S13_ranked": _WORDS + """, n AS (SELECT count(*) AS n, avg(k) AS mean FROM (SELECT file, count(*) AS k FROM p GROUP BY file)),
      tf AS (SELECT term, file, count(*) AS tf FROM p WHERE term IN ('worthless', 'moron', 'of', 'the') GROUP BY term, file),
      idf AS (SELECT term, greatest(ln((max(n.n) - count(*) + 0.5) / (count(*) + 0.5)), 0.000001) AS idf FROM tf, n GROUP BY term)
      SELECT tf.file, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len.k / n.mean))), 6) AS score FROM tf JOIN idf ON idf.term = tf.term JOIN (SELECT file, count(*) AS k FROM p GROUP BY file) len ON len.file = tf.file, n
      GROUP BY tf.file ORDER BY score DESC, tf.file LIMIT 50""",
    "S18_subgraph_json": sql("SELECT id, '{\"id\":\"' || id || '\",\"kind\":\"' || kind || '\",\"name\":\"' || name || '\",\"file\":' || coalesce('\"' || file || '\"', 'null') || ',\"line\":' || coalesce(line::VARCHAR, 'null') || ',\"package\":' || coalesce('\"' || package || '\"', 'null') || '}' AS json FROM functions"),
    "G02_scopes": """WITH i AS (SELECT l_orderkey AS ok, l_partkey AS pk, 'f' || l_orderkey // 64 AS file, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_returnflag) AS rn FROM lineitem),
      s AS (SELECT DISTINCT 'g' || ok // 8 AS id, file, ok // 8 * 80000 AS a, ok // 8 * 80000 + 80000 AS b FROM i UNION ALL SELECT DISTINCT 'o' || ok, file, ok * 10000, ok * 10000 + 9000 FROM i UNION ALL SELECT 'l' || ok || '_' || rn, file, ok * 10000 + rn * 100, ok * 10000 + rn * 100 + pk % 3 * 40 FROM i),
      p AS (SELECT id, file, a, b FROM s UNION ALL SELECT 'n' || ok || '_' || rn, file, ok * 10000 + pk * 7 % 10000, NULL FROM i)
      SELECT p.id AS source, arg_min(s.id, s.b - s.a) AS target FROM p JOIN s ON s.file = p.file AND s.a <= p.a AND p.a < s.b AND s.id <> p.id AND (p.b IS NULL OR p.b <= s.b AND s.b - s.a > p.b - p.a) GROUP BY p.id""",
    "G03_siblings": sql("SELECT id AS source, lead(id) OVER (PARTITION BY ok ORDER BY rn) AS target, row_number() OVER (PARTITION BY ok ORDER BY rn) AS rank FROM stmt QUALIFY target IS NOT NULL"),
    "G04_defer_order": sql("SELECT id AS source, lead(id) OVER w AS target, row_number() OVER w AS rank FROM stmt WHERE kind = 'defer' WINDOW w AS (PARTITION BY fid ORDER BY ok * 10 + rn DESC, rn DESC, id DESC) QUALIFY target IS NOT NULL"),
    "G05_init_order": sql("SELECT id AS source, lead(id) OVER w AS target, row_number() OVER w AS rank FROM functions WHERE name = 'init' WINDOW w AS (PARTITION BY package ORDER BY file, line, id) QUALIFY target IS NOT NULL"),
    "G06_error_wraps": """SELECT l_orderkey * 10 + l_linenumber AS id, u.unnest AS argument FROM (SELECT *, CASE l_partkey % 5 WHEN 0 THEN [1] WHEN 1 THEN [2] WHEN 2 THEN [1, 2] WHEN 3 THEN [] ELSE [0, 1, 2] END AS hits FROM lineitem) x, unnest(hits) u""",
    "G07_sync_kind": f"""WITH s(package, type, method, sync_kind) AS (VALUES {values(_SYNC)}),
      c AS (SELECT p_partkey AS id, ['sync', 'context', 'os'][1 + p_partkey % 3] AS package, ['Mutex', 'RWMutex', 'WaitGroup', 'Once'][1 + (p_partkey // 3) % 4] AS type, ['Lock', 'Unlock', 'RLock', 'Add', 'Wait', 'Do', 'Cancel'][1 + (p_partkey // 12) % 7] AS method FROM part)
      SELECT c.*, s.sync_kind FROM c LEFT JOIN s ON s.package = c.package AND s.method = c.method AND s.type IN (c.type, '*')""",
    "G08_complexity": sql("""SELECT f.id AS function_id, 1 + coalesce(n.d, 0) AS complexity, coalesce(f.end_line - f.line + 1, 0) AS loc, coalesce(n.p, 0) AS num_params FROM functions f
      LEFT JOIN (SELECT fid, count(*) FILTER (kind IN ('if', 'for')) AS d, count(*) FILTER (kind = 'parameter') AS p FROM stmt GROUP BY fid) n ON n.fid = f.id"""),
    "G09_fans": sql("SELECT * FROM metrics"),
    "G10_recursion": sql("SELECT source AS function_id FROM e_call WHERE source = target"),
    "G11_value_cycles": sql("SELECT id, min(other) AS component FROM (SELECT a.id, b.id AS other FROM near a JOIN near b ON b.id = a.other AND b.other = a.id) GROUP BY id HAVING count(DISTINCT other) > 1", _VALUES, "near(id, other) AS (SELECT source, target FROM passes UNION SELECT n.id, e.target FROM near n JOIN passes e ON e.source = n.other)"),
    "G11_type_reach": sql("SELECT type, count(*) AS reached FROM typed JOIN statements s ON s.id = typed.value WHERE s.kind IN ('call', 'local', 'parameter', 'go', 'defer') GROUP BY type", _VALUES),
    "G11_call_graph": sql("""SELECT caller AS source, callee AS target, 'call' AS kind, bool_or(dynamic) AS dynamic FROM resolved GROUP BY ALL
      UNION ALL SELECT site, callee, CASE WHEN callee LIKE 'ext::%' THEN 'stub' ELSE 'call_site' END, bool_or(dynamic) FROM resolved GROUP BY ALL UNION ALL SELECT caller, site, 'call_to_return', bool_or(dynamic) FROM resolved GROUP BY ALL""", _VALUES,
      """sites AS (SELECT p.id AS site, p.fid AS caller, p.fid2 AS fn, p.pk % 3 AS how, p.id2 AS receiver, regexp_extract(f.name, '^[^0-9]*') AS method FROM pair p JOIN functions f ON f.id = p.fid2 WHERE p.kind = 'call'),
      able AS (SELECT DISTINCT h.source AS type, regexp_extract(f.name, '^[^0-9]*') AS method, f.id AS fn FROM e_has_method h JOIN functions f ON f.id = h.target),
      every AS (SELECT site, caller, fn AS callee, false AS dynamic FROM sites WHERE how = 0 UNION ALL SELECT s.site, s.caller, a.fn, true FROM sites s JOIN typed t ON t.value = s.receiver JOIN able a ON a.type = t.type AND a.method = s.method WHERE how = 1
        UNION ALL SELECT s.site, s.caller, substr(t.type, 6), true FROM sites s JOIN typed t ON t.value = s.receiver WHERE how = 2 AND t.type LIKE 'func:%'),
      resolved AS (SELECT * FROM every WHERE caller NOT LIKE 'ext::%' OR callee NOT LIKE 'ext::%')"""),
    "G12_param_in": sql("SELECT a.arg AS source, p.id AS target, a.index FROM args a JOIN stmt c ON c.id = a.call JOIN stmt p ON p.kind = 'parameter' AND p.fid = a.fid2 AND p.place = a.index + CASE WHEN c.pk % 3 = 1 THEN 1 ELSE 0 END"),
    "G13_cfg_ends": sql("SELECT parent_function AS source, id AS target, 'entry' AS label FROM bbs WHERE id NOT IN (SELECT target FROM e_cfg) UNION ALL SELECT id, parent_function, 'exit' FROM bbs WHERE id NOT IN (SELECT source FROM e_cfg)"),
    "G13_branches": sql("SELECT 's' || ok || '_' || rn AS source, 's' || ok || '_' || rn + k AS target, CASE k WHEN 1 THEN 'true' ELSE 'false' END AS label FROM pair, (VALUES (1), (2)) v(k) WHERE kind = 'if' AND (k = 1 OR (ok, rn + 2) IN (SELECT (ok, rn) FROM stmt))"),
    "G14_uses": sql("SELECT DISTINCT source, target FROM e_dfg WHERE source <> target"),
    "G15_channel_ends": sql("SELECT channel, id, kind FROM chan", _VALUES, _CHANNELS),
    "G15_channel_flow": sql("SELECT DISTINCT s.id AS source, r.id AS target FROM chan s JOIN chan r ON r.channel = s.channel AND s.kind = 'send' AND r.kind = 'receive'", _VALUES, _CHANNELS),
    "G16_panic_recover": sql("SELECT a.id AS source, b.id AS target FROM statements a JOIN statements b ON b.parent_function = a.parent_function WHERE a.name = 'panic' AND b.name = 'recover'"),
    "G17_dominance": sql("""SELECT source, target, 'dom' AS kind FROM dom_tree UNION ALL SELECT source, target, 'pdom' FROM pdom_tree
      UNION ALL SELECT DISTINCT u, w, 'cdg' FROM (SELECT f.u, f.v AS w, f.stop FROM forks f UNION ALL SELECT f.u, s.a, f.stop FROM forks f JOIN pdom_over s ON s.b = f.v) x
        WHERE w IS DISTINCT FROM stop AND NOT EXISTS (SELECT 1 FROM pdom_over s WHERE s.b = x.stop AND s.a = x.w)""", _dominance("dom", "source", "target"), _dominance("pdom", "target", "source"),
      "forks AS (SELECT e.source AS u, e.target AS v, p.source AS stop FROM e_cfg e LEFT JOIN pdom_tree p ON p.target = e.source WHERE e.source IN (SELECT source FROM e_cfg GROUP BY source HAVING count(*) > 1))"),
    "G20_implementations": sql("""SELECT t.owner AS type, i.owner AS interface FROM havers t JOIN asked i ON i.method = t.method JOIN (SELECT owner, count(*) AS n FROM asked GROUP BY owner) c ON c.owner = i.owner GROUP BY 1, 2 HAVING count(*) = max(c.n)""",
      "has AS (SELECT DISTINCT e.source AS owner, f.name AS method FROM e_has_method e JOIN functions f ON f.id = e.target WHERE f.name IS NOT NULL)", "asked AS (SELECT * FROM has WHERE owner LIKE 'i%')",
      """havers AS (SELECT * FROM has WHERE owner LIKE 't%' UNION ALL SELECT 'all:' || owner, method FROM asked
      UNION ALL SELECT 'few:' || owner, method FROM (SELECT *, max(method) OVER (PARTITION BY owner) AS last FROM asked) WHERE method < last)"""),
    "G21_satisfied": sql("SELECT DISTINCT m.fid AS source, 'fld' || s.ok || '_' || s.rn AS target FROM e_implements i JOIN e_has_method h ON h.source = i.source JOIN (SELECT DISTINCT fid, pk FROM stmt) m ON m.fid = h.target JOIN stmt s ON 'i' || s.sk = i.target AND s.pk = m.pk"),
    "G22_embeds_alias": "SELECT 't' || c_custkey AS source, CASE WHEN c_custkey % 7 = 0 THEN 'n' || c_nationkey ELSE 't' || c_custkey // 2 END AS target, CASE WHEN c_custkey % 7 = 0 THEN 'alias_of' ELSE 'embeds' END AS kind FROM customer WHERE c_custkey % 7 = 0 OR c_custkey % 3 = 0 AND c_custkey // 2 > 0",
    "G23_has_method": sql("SELECT t.id AS source, f.id AS target FROM (SELECT 'T' || k AS receiver, 'r' || k AS id FROM range(50) r(k)) t JOIN p_function p ON p.key = 'receiver' AND p.value = t.receiver JOIN functions f ON f.id = p.node_id"),
    "G24_relative_paths": sql("""SELECT DISTINCT 'corp.io/' || package AS path, CASE WHEN package = 'web' THEN 'main' WHEN package = 'web/api' THEN 'api' WHEN package LIKE 'web/api/%' THEN 'api/' || substr(package, 9) WHEN package LIKE 'web/%' THEN substr(package, 5)
      WHEN package = 'storage' THEN 'store' WHEN package LIKE 'storage/%' THEN 'store/' || substr(package, 9) ELSE 'base/' || package END AS relative FROM functions"""),
    "G25_escapes": sql("""SELECT DISTINCT id AS node_id, 'inlineable' AS key, 'true' AS value FROM same WHERE said = 'inlineable' AND kind = 'function' UNION ALL SELECT DISTINCT id, 'heap_escapes', 'true' FROM same WHERE said IN ('leaking_param', 'moved_to_heap')
      UNION ALL SELECT DISTINCT id, 'heap_escapes', 'false' FROM same WHERE said = 'does_not_escape' AND kind <> 'function' AND id NOT IN (SELECT id FROM same WHERE said IN ('leaking_param', 'moved_to_heap'))""", _ESCAPED, _SAME),
    "R30_first_of_id": "SELECT p_brand AS id, p_type AS kind, p_name AS name FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_type, p_name) = 1",
    "R31_gate": sql("""SELECT 'nodes.missing' AS "check", count(*) AS n FROM fn WHERE pk % 7 = 1 UNION ALL SELECT 'nodes.repeated', count(*) FROM fn WHERE pk % 3 = 1 UNION ALL SELECT 'nodes.stored', count(*) FROM fn WHERE pk % 2 = 0
      UNION ALL SELECT 'added ' || package, count(*) FROM fn WHERE pk % 2 = 1 GROUP BY package"""),
    "R31_violations": sql("SELECT 'participants.role' AS \"check\", 0::BIGINT AS n UNION ALL SELECT 'nodes.id', 0 UNION ALL SELECT 'nodes.name', 0 UNION ALL SELECT 'metrics.function_id', 0 UNION ALL SELECT 'broken.id', (SELECT count(*) FROM (SELECT id FROM (SELECT id FROM functions UNION ALL SELECT id FROM functions WHERE name = 'init') GROUP BY id HAVING count(*) > 1))"),
    "A1_search": sql("SELECT id, name, kind, package, file, line FROM symbols WHERE name ILIKE '%serve1%' ORDER BY kind, name, id LIMIT 20", SYMBOLS),
    "A2_subgraph_nodes": sql("SELECT * FROM around", _NEAR),
    "A2_subgraph_edges": sql("SELECT source, target, 'call' AS kind FROM e_call WHERE source IN (SELECT id FROM around) AND target IN (SELECT id FROM around) ORDER BY 1, 2 LIMIT 500", _NEAR),
    "A3_package_graph_nodes": sql("SELECT package AS id, * FROM tree", TREEMAP, DEPS, _TREE),
    "A3_package_graph_edges": sql("SELECT * FROM heavy WHERE source IN (SELECT package FROM tree) AND target IN (SELECT package FROM tree)", TREEMAP, DEPS, _TREE),
    "A4_package_functions": sql("SELECT * REPLACE (coalesce(line, 0) AS line, coalesce(end_line, 0) AS end_line) FROM detail WHERE package ILIKE '%brand#1%' ORDER BY name, function_id LIMIT 200", *STAGES, DETAIL),
    "A5_source": sql("SELECT file, content, package FROM sources WHERE file = (SELECT min(file) FROM sources)"),
    "A6_slice_nodes": sql("SELECT * FROM hit", BACKWARD, _NODES),
    "A6_slice_edges": sql("SELECT source, target, kind FROM (SELECT *, 'dfg' AS kind FROM e_dfg UNION ALL SELECT *, 'param_in' FROM e_param_in UNION ALL SELECT *, 'param_out' FROM e_param_out) WHERE source IN (SELECT id FROM hit) AND target IN (SELECT id FROM hit) ORDER BY 1, 2, 3 LIMIT 1000", BACKWARD, _NODES),
    "A8_slice_lines": sql("SELECT file, string_agg(line, ',' ORDER BY line) AS lines FROM (SELECT DISTINCT file, line FROM hit WHERE file IS NOT NULL AND line IS NOT NULL) GROUP BY file", BACKWARD, _SLICE),
    "R20_row_number": sql("SELECT id, row_number() OVER (ORDER BY loc DESC, id) AS rank FROM measured QUALIFY rank <= 50"),
    "T08_schema": sql(f"SELECT * FROM (VALUES {values(_DOCS)}) t(category, name, description) UNION ALL SELECT 'node_kind', kind, count(*) || ' rows' FROM nodes GROUP BY kind UNION ALL SELECT 'edge_kind', kind, count(*) || ' rows' FROM edges GROUP BY kind"),
}
