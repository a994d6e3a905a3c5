"""Hand-made graphs with answers known by construction."""

import random

import pytest

from meshquery import session
from meshquery.graph import Graph
from meshquery.operators import callgraph, extract, findings, named, navigation, protocols, traverse, views
from meshquery.plans.carrier import build
from meshquery.schema import EDGES, NODES, violations
from meshquery.session import kept


def graph(spark, nodes, edges, **tables):
    rows = [{"id": n[0], "kind": n[1], "name": n[2], **(n[3] if len(n) > 3 else {})} for n in nodes]
    n = spark.createDataFrame([[r.get(c) for c in NODES.names] for r in rows], NODES)
    e = spark.createDataFrame([[*x, None][:4] for x in edges], EDGES)
    return Graph.ingest(n, e, **tables)


def functions(spark, calls, names="abcd"):
    return graph(spark, [(x, "function", x, {"package": f"p{x}"}) for x in names], [(a, b, "call") for a, b in calls])


def pairs(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_chain_and_diamond(spark):
    g = functions(spark, ["ab", "bc", "cd"])
    assert pairs(named.callers_of(g, "d"), "id", "depth") == [("a", 3), ("b", 2), ("c", 1), ("d", 0)]
    assert pairs(named.callers_of(g, "d", 1), "id", "depth") == [("c", 1), ("d", 0)]
    g = functions(spark, ["ab", "ac", "bd", "cd"])
    assert pairs(traverse.walk(g.step("call"), named.seed(g, "a"), 5), "id", "depth") == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    assert pairs(named.pathfinder(g, "a", "d"), "path") == [("a -> b -> d",), ("a -> c -> d",)]


def test_cycle_comes_again_at_each_level(spark):
    g = functions(spark, ["ab", "bc", "ca", "cd"])
    got = pairs(traverse.walk(g.step("call"), named.seed(g, "a"), 4, every=2), "id", "depth")
    assert got == [("a", 0), ("a", 3), ("b", 1), ("b", 4), ("c", 2), ("d", 3)]
    assert pairs(traverse.nearest(g.step("call"), named.seed(g, "a"), 9), "id", "depth") == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    assert pairs(traverse.closure(g.step("call"), named.seed(g, "b")), "id") == [("a",), ("b",), ("c",), ("d",)]
    assert pairs(named.call_chain(g, "a"), "id", "depth") == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]


def test_a_small_slice_shuffles_no_nodes(spark):
    g = graph(spark, [(x, "local", x) for x in "abcd"], [(a, b, "dfg") for a, b in ("ab", "ab", "bc", "ca", "cd")])
    d = named.forward_slice(g, "b")
    assert [r.id for r in d.collect()] == ["a", "b", "c", "d"]
    plan = d._jdf.queryExecution().sparkPlan().toString()  # as planned, before anything of it has run
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_ids_inside_ids_do_not_block_paths(spark):
    g = functions(spark, [("f1", "f10"), ("f10", "f100"), ("f100", "f1")], ["f1", "f10", "f100"])
    assert pairs(traverse.simple_paths(g.step("call"), named.seed(g, "f1"), 5), "id", "depth") == [("f1", 0), ("f10", 1), ("f100", 2)]


def test_self_call_is_recursive(spark):
    g = functions(spark, ["aa", "ab"])
    assert pairs(findings.recursive(g), "node_id") == [("a",)]
    assert pairs(extract.recursion(g), "function_id") == [("a",)]
    assert named.call_chain(g, "a").count() == 2


def test_ingestion_and_orphans(spark):
    g = graph(spark, [("a", "function", "a", {"file": "", "line": 0}), ("a", "function", "zz", {"file": "x"}), ("b", "function", "b", {"package": ""})], [("a", "b", "call"), ("a", "b", "call"), ("a", "gone", "call")])
    assert g.nodes.count() == 2 and g.nodes.where("id = 'a'").first().line is None
    assert g.edges.count() == 3 and g.without_orphans().edges.count() == 2
    assert g.validate().where("check = 'orphan_edges'").first().n == 1
    assert views.function_summary(g).where("id = 'b'").first().calls_in == 2
    for f in findings.STAGES[1]:
        assert f(g).where("message is null").count() == 0


def test_properties_and_saving(spark, tmp_path):
    g = graph(spark, [("a", "function", "a", {"properties": '{"exported":true,"n":5,"s":"true","z":null}'})], [])
    assert pairs(g.node_properties, "key", "value") == [("exported", "1"), ("n", "5"), ("s", "true")]
    again = g.save(str(tmp_path / "g"))
    assert pairs(again.nodes, "id", "kind") == [("a", "function")]
    assert Graph.load(spark, str(tmp_path / "nothing")).nodes.count() == 0


def args_graph(spark, callee):
    nodes = [("c", "call", "c", {"parent_function": "f"}), ("x", "local", "x"), ("y", "local", "y"), ("f", "function", "f"), ("ext::u", "function", callee[1], {"package": callee[0]})]
    return graph(spark, nodes, [("c", "x", "argument", '{"index":0}'), ("c", "y", "argument", '{"index":1}'), ("c", "ext::u", "call_site")])


def test_flows_of_outside_calls(spark):
    g = args_graph(spark, ("encoding/json", "Unmarshal"))
    assert pairs(views.flows_to_argument(g), "source", "target") == [("x", "y")]
    assert views.flows_to_result(g).count() == 0 and views.flows_by_default(g).count() == 0
    assert pairs(views.flows_to_result(args_graph(spark, ("fmt", "Sprintf"))), "source", "target") == [("x", "c"), ("y", "c")]
    assert pairs(views.flows_by_default(args_graph(spark, ("who", "Knows"))), "source", "target") == [("x", "c"), ("y", "c")]
    assert pairs(views.argument_order(g), "source", "target") == [("x", "y")]
    assert pairs(views.last_arguments(g), "source", "target", "properties") == [("y", "c", '{"final":true}')]
    assert views.evaluation_order(g).count() == 2
    assert views.with_flows(g).step("dfg").count() == 1


def test_scopes_see_the_scopes_around(spark):
    nodes = [(b, "block", b) for b in ("in", "mid", "out", "else")] + [("p", "parameter", "p"), ("v", "local", "v"), ("w", "local", "w")]
    g = graph(spark, nodes, [("in", "mid", "scope"), ("mid", "out", "scope"), ("else", "out", "scope"), ("out", "p", "ast"), ("in", "v", "ast"), ("else", "w", "ast")])
    assert pairs(named.scope_variables(g, "in"), "id") == [("p",), ("v",)]


def blocks(spark, edges, names):
    return graph(spark, [("f", "function", "f"), *[(b, "basic_block", b, {"parent_function": "f"}) for b in names]], [(a, b, "cfg") for a, b in edges])


def test_dominators_and_control_dependence(spark):
    d = extract.dominance(blocks(spark, ["ab", "ac", "bd", "cd"], "abcd"))
    assert pairs(d.where("kind = 'dom'"), "source", "target") == [("a", "b"), ("a", "c"), ("a", "d")]
    assert pairs(d.where("kind = 'pdom'"), "source", "target") == [("d", "a"), ("d", "b"), ("d", "c")]
    assert pairs(d.where("kind = 'cdg'"), "source", "target") == [("a", "b"), ("a", "c")]
    loop = extract.dominance(blocks(spark, ["ab", "bc", "cb", "bd"], "abcd"))
    assert pairs(loop.where("kind = 'cdg'"), "source", "target") == [("b", "b"), ("b", "c")]
    endless = extract.dominance(blocks(spark, ["ab", "ba"], "ab"))
    assert endless.where("kind <> 'dom'").count() == 0
    ring = extract.dominance(blocks(spark, ["ab", "ac", "ba", "ca"], "abc"))
    assert pairs(ring.where("kind = 'cdg'"), "source", "target") == [("a", "b"), ("a", "c")] and ring.where("kind = 'pdom'").count() == 0
    trap = extract.dominance(blocks(spark, ["ab", "ac", "bb", "cd", "ce", "df", "ef"], "abcdef"))  # b is never left
    assert pairs(trap.where("kind = 'cdg'"), "source", "target") == [("a", "b"), ("c", "d"), ("c", "e")]
    assert pairs(trap.where("kind = 'pdom'"), "source", "target") == [("c", "a"), ("f", "c"), ("f", "d"), ("f", "e")]
    assert pairs(extract.cfg_ends(blocks(spark, ["ab"], "ab")), "source", "target", "label") == [("b", "f", "exit"), ("f", "a", "entry")]


def causes(spark, rows):
    return spark.createDataFrame([(*r, "why") for r in rows], "source_endpoint string, target_endpoint string, kind string, protocol_id string, description string")


def test_causal_cycles(spark):
    two = protocols.dependency_cycles(causes(spark, [("a", "b", "IO", "p"), ("b", "a", "IO", "q"), ("b", "c", "II", "p"), ("c", "b", "IO", "p")]))
    assert pairs(two, "cycle_length", "severity") == [(2, "benign"), (2, "deadlock_risk")]
    three = causes(spark, [("a", "b", "IO", "p"), ("b", "c", "OO", "q"), ("c", "a", "II", "r")])
    assert pairs(protocols.dependency_cycles(three), "cycle_path", "severity") == [("a → b → c → a", "deadlock_risk")]
    g = functions(spark, [])
    assert named.deadlock_detection(g, three).first().scalas_yoshida_class == protocols.TRIANGLE
    assert pairs(named.deadlock_check(g, three), "causality_chain") == [("II → IO",), ("IO → OO",), ("OO → II",)]
    a = {r.protocol_id: r for r in protocols.association(g, protocols.dependency_cycles(three)).collect()}
    assert a["scrape"].is_associated == 0 and a["scrape"].errata_reference == protocols.ERRATA
    risky = spark.createDataFrame([("x", 2, "adapter_query_range, scrape", "deadlock_risk")], "cycle_path string, cycle_length long, involved_protocols string, severity string")
    got = {r.protocol_id: r.cycle_count for r in protocols.association(g, risky).collect()}
    assert got["adapter_query_range"] == 1 and got["scrape"] == 1 and got["adapter_query"] == 0


def test_cycles_of_calls_either_way_round(spark):
    g = functions(spark, ["ab", "bc", "ca", "ac", "cb", "ba", "da", "ad"])
    got = pairs(protocols.mutual_cycles(g), "cycle_path", "cycle_length")
    assert got == [("a → b → a", 2), ("a → b → c → a", 3), ("a → c → a", 2), ("a → c → b → a", 3), ("a → d → a", 2), ("b → c → b", 2)]


def test_endpoints_and_causes_of_a_small_project(spark):
    of = lambda package, **more: {"package": package, "file": "f.go", "line": 3, **more}
    adapter = {"properties": '{"project":"adapter"}'}
    nodes = [
        ("s", "function", "*queryClient.Series", of("c", **adapter)), ("q", "function", "*queryClient.Query", of("c", **adapter)), ("d", "function", "*httpAPIClient.Do", of("c", **adapter)),
        ("r", "function", "*scrapeLoop.run", of("scrape")), ("x", "function", "*API.query", of("web/api/v1")), ("y", "function", "*API.queryRange", of("web/api/v1")), ("z", "function", "*API.other", of("web/api/v1")),
    ]
    g = graph(spark, nodes, [])
    e = {(r.protocol_id, r.function_id): r.url_path for r in protocols.endpoints(g).collect()}
    assert e[("scrape", "r")] is None and e[("promql_api", "y")] == "/api/v1/query_range" and e[("adapter_query", "x")] == "/api/v1/query"
    assert ("promql_api", "z") not in e and e[("adapter_series", "s")] == "/api/v1/series"
    assert pairs(protocols.causality_summary(g), "kind", "source_function", "target_function") == [("IO", "*queryClient.Series", "*httpAPIClient.Do"), ("IO", "*queryClient.Series", "*queryClient.Query")]
    checked = {(r.protocol_id, r.component): r for r in protocols.subtype_check(g).collect()}
    assert checked[("adapter_query", "adapter")].relation == "subtype" and checked[("adapter_series", "adapter")].relation == "equal"
    assert checked[("scrape", "target")].relation == "assumed_subtype" and checked[("federation", "prometheus")].explanation == protocols.UNSEEN


def test_findings_say_what_clients_read(spark):
    m = spark.createDataFrame([("a", 20, 12, 11, 120, 6), ("b", 20, 0, 0, 119, 6)], "function_id string, cyclomatic_complexity long, fan_in long, fan_out long, loc long, num_params long")
    g = graph(spark, [("a", "function", "A", {"package": "p", "file": "f", "line": 7}), ("b", "function", "b", {"package": "q"}), ("v", "local", "v", {"parent_function": "a"})], [("a", "b", "call")], metrics=m)
    got = {r.category: r for r in findings.stage(g, 1).where("node_id in ('a', 'v')").collect()}
    assert got["complexity"].message == "A has cyclomatic complexity 20" and got["complexity"].details == '{"complexity":20,"package":"p"}'
    assert got["god_function"].message == "A (complexity=20, loc=120, fan_out=11)"
    assert got["similar_function"].message == "A is structurally similar to b (cc=20, loc≈120/119)"
    assert got["risk_score"].message == "A risk=7.0" and got["dead_store"].message == "unused variable 'v' in a"
    assert got["hub"].details == '{"fan_in":12,"fan_out":11,"package":"p"}'
    dead = findings.dead_code(g).first()
    assert dead.message == "unreachable function b (zero callers)" and dead.line is None


def test_chains_of_scopes_of_any_length(spark):
    n = 300
    g = graph(spark, [(f"s{i}", "block", "x") for i in range(n)], [(f"s{i}", f"s{i + 1}", "scope") for i in range(n - 1)])
    assert traverse.closure(g.step("scope"), named.seed(g, "s0")).count() == n
    assert traverse.closure(g.step("scope"), named.seed(g, "s299")).count() == 1
    far = traverse.nearest(g.step("scope"), named.seed(g, "s0"), 20)
    assert pairs(far, "depth")[-1] == (20,) and far.count() == 21


def test_errors_wrapped_by_calls(spark):
    rows = [(1, "fmt.Errorf", "x %w", 2), (2, "fmt.Errorf", "%d: %+5.2w 100%% %w", 4), (3, "fmt.Errorf", "%%w", 2), (4, "errors.Join", None, 2), (5, "fmt.Errorf", "%w %w", 2), (6, "other", "%w", 2), (7, "fmt.Errorf", None, 1), (8, "errors.Join", None, 0)]
    calls = spark.createDataFrame(rows, "id int, callee string, format string, args int")
    assert pairs(extract.error_wraps(calls), "id", "argument") == [(1, 1), (2, 2), (2, 3), (4, 0), (4, 1), (5, 1)]


def test_declared_types_and_their_methods(spark):
    d = spark.createDataFrame([("a", None, ["b", None]), ("c", "a", ["b"]), ("e", None, None)], "id string, alias_of string, embedded array<string>")
    assert pairs(extract.type_edges(d), "source", "target", "kind") == [("a", "b", "embeds"), ("c", "a", "alias_of")]
    t = spark.createDataFrame([("t1", "T", "p"), ("t2", "T", "q")], "id string, name string, package string")
    m = spark.createDataFrame([("m", "*T", "p"), ("n", "T", "q"), ("o", "U", "p")], "id string, receiver string, package string")
    assert pairs(extract.has_method(t, m), "source", "target") == [("t1", "m"), ("t2", "n")]


def test_constraints(spark):
    d = spark.createDataFrame([("a", "x"), ("a", ""), ("b", None)], "id string, role string")
    of = lambda **k: violations("t", d, **k).first()
    assert of(unique="id") == ("t.id", 1) and of(required="role") == ("t.role", 2) and of(allowed=("role", ["x"])) == ("t.role", 2)


def test_derived_tables_are_stored_once(spark, tmp_path):
    g = functions(spark, ["ab", "ba"]).save(str(tmp_path / "g"))
    assert findings.stage(g, 2).count() == findings.stage(g, 2).count()
    assert (tmp_path / "g/derived-findings-1/_SUCCESS").exists() and (tmp_path / "g/derived-findings-2/_SUCCESS").exists()
    assert g.but(nodes=g.nodes).path is None


def test_implementations_need_every_method(spark):
    m = spark.createDataFrame([("t", "a"), ("t", "b"), ("u", "a")], "type string, method string")
    i = spark.createDataFrame([("i", "a"), ("i", "b"), ("j", "a")], "interface string, method string")
    assert pairs(extract.implementations(m, i), "type", "interface") == [("t", "i"), ("t", "j"), ("u", "j")]


def test_channels_and_modules(spark):
    e = lambda rows, s: spark.createDataFrame(rows, s)
    flows = e([("m", "x"), ("x", "s"), ("m", "r"), ("n", "q")], "source string, target string")
    got = extract.channel_flow(flows, e([("m",), ("n",)], "id string"), e([("s", "send"), ("r", "receive"), ("q", "receive")], "id string, kind string"))
    assert pairs(got, "source", "target") == [("s", "r")]
    paths = e([("m.io/a",), ("m.io/a/b",), ("m.io/c/d",), ("zz",)], "path string")
    assert pairs(extract.relative(paths, [("m.io/a", ""), ("m.io", "base")]), "relative") == [("b",), ("base/c/d",), ("main",), ("zz",)]


@pytest.mark.parametrize("name", sorted(named.QUERIES))
def test_every_query_runs_on_a_small_graph(spark, name):
    g = functions(spark, ["ab", "bc", "ca", "cd"])
    q = named.QUERIES[name]
    out = named.run(g, name, **{p: "a" for p in q.parameters})
    assert out.columns
    with pytest.raises(ValueError) if [p for p in q.parameters if p != "metric"] else _nothing():
        named.run(g, name)


class _nothing:
    def __enter__(self):
        return self

    def __exit__(self, *a):
        return False


def edge_list(spark, *edges):
    return spark.createDataFrame([tuple(e) for e in edges], "source string, target string")


def test_interfaces_of_a_name_leave_the_rest_alone(spark, monkeypatch):
    nodes = [(f"{k}{n}", "type_decl", f"{k}{n}") for k in "ti" for n in range(3)] + [(f"f{n}", "function", f"f{n}") for n in range(4)]
    edges = [(f"t{n}", f"i{m}", "implements") for n in range(3) for m in range(3) if n != m] + [("t0", "i1", "implements")]
    edges += [("t0", "f0", "has_method"), ("t0", "f0", "has_method"), ("t1", "f1", "has_method"), ("i1", "f2", "has_method"), ("i1", "f3", "has_method"), ("i2", "f3", "has_method")]
    g = graph(spark, nodes, edges + [("f0", "f2", "satisfies_method"), ("f0", "f3", "satisfies_method"), ("f0", "f3", "satisfies_method"), ("f1", "f3", "satisfies_method")])
    stored = []
    monkeypatch.setattr(navigation, "kept", lambda df: stored.append(kept(df)) or stored[-1], raising=False)
    before = spark.conf.get(navigation.PART_OF_KEYS, None)
    got = pairs(navigation.type_impl_map(g), "interface_id", "concrete_id", "method_count")
    assert got == [("i0", "t1", 0), ("i0", "t2", 0), ("i1", "t0", 3), ("i1", "t0", 3), ("i1", "t2", 0), ("i2", "t0", 2), ("i2", "t1", 1)]
    assert pairs(named.interface_map(g, "i2"), "concrete_name", "method_count") == [("t0", 2), ("t1", 1)]
    assert [d.count() for d in stored[1::2]] == [3, 2] and spark.conf.get(navigation.PART_OF_KEYS, None) == before


def test_long_flows_take_few_rounds(spark, monkeypatch):
    n, stored = 120, []
    for module in (callgraph, traverse):
        for name in ("kept", "checkpointed"):
            monkeypatch.setattr(module, name, lambda df, f=getattr(session, name): stored.append(1) or f(df), raising=False)
    flows = spark.createDataFrame([(f"a{k:03}", f"a{k + 1:03}") for k in range(n)] + [(f"a{n}", f"a{n - 2}")], "source string, target string")
    types = callgraph.Types(flows, spark.createDataFrame([("a000", "T"), ("a060", "U")], "value string, type string"))
    assert pairs(types.component, "id", "component") == [(f"a{k}", f"a{n - 2}") for k in range(n - 2, n + 1)]
    ends = spark.createDataFrame([("a001",), ("a120",), ("b",)], "value string")
    assert pairs(types.at(ends), "value", "type") == [("a001", "T"), ("a120", "T"), ("a120", "U")]
    assert pairs(types.reached(ends), "type", "reached") == [("T", 2), ("U", 1)]
    assert len(stored) < n / 2


def test_large_pieces_have_the_same_components(spark):
    rnd = random.Random(5)
    e = spark.createDataFrame([(f"n{rnd.randrange(60)}", f"n{rnd.randrange(60)}") for _ in range(70)], "source string, target string")
    small, large = (pairs(callgraph.strong_components(e, most), "id", "component") for most in (1000, 1))
    assert small == large and len({c for _, c in small}) > 0


def test_strong_components(spark):
    e = edge_list(spark, "ab", "bc", "ca", "cd", "de", "ed", "ef", "fg", "hh", "xa", *[("hub", f"n{i}") for i in range(30)], *[(f"n{i}", "hub") for i in range(0, 30, 2)])
    e = e.union(edge_list(spark, "ab", (None, "a"), ("a", None)))
    got = pairs(callgraph.strong_components(e), "id", "component")
    hub = [("hub", "hub"), *[(f"n{i}", "hub") for i in range(0, 30, 2)]]
    assert got == sorted([("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d"), *hub])
    assert callgraph.strong_components(edge_list(spark, "ab", "bc")).count() == 0 and callgraph.strong_components(e.limit(0)).count() == 0
    nested = edge_list(spark, "ba", "ac", "cb", "cd", "da", "xy", "yz", "zx", "ax")  # two cycles through a, and one further on
    assert {r.component for r in callgraph.strong_components(nested).where("id in ('x', 'y', 'z')").collect()} == {"x"}


def test_types_flow_to_receivers(spark):
    flows = edge_list(spark, "ab", "bc", "ca", "cr", "dr", "re")
    made = spark.createDataFrame([("a", "T"), ("d", "U"), ("d", "func:g"), ("d", None), ("d", "U")], "value string, type string")
    types = callgraph.Types(flows, made)
    at = types.at(spark.createDataFrame([("b",), ("e",), ("nowhere",)], "value string"))
    assert pairs(at, "value", "type") == [("b", "T"), ("e", "T"), ("e", "U"), ("e", "func:g")]
    sites = spark.createDataFrame(
        [("1", "f", None, "e", "Run"), ("2", "f", None, "b", "Run"), ("3", "f", None, "e", None), ("4", "f", "ext::p", None, None), ("5", "h", "ext::p", None, None), ("6", "f", None, "nowhere", "Run"), ("7", "f", "g", "e", "Run"), ("8", "f", None, None, "Run")],
        "site string, caller string, callee string, receiver string, method string",
    )
    methods = spark.createDataFrame([("T", "Run", "T.Run"), ("U", "Run", "U.Run"), ("U", "Stop", "U.Stop")], "type string, method string, function string")
    calls = callgraph.resolve(types, sites, methods)
    assert pairs(calls, "site", "callee", "dynamic") == [("1", "T.Run", True), ("1", "U.Run", True), ("2", "T.Run", True), ("3", "g", True), ("4", "ext::p", False), ("5", "ext::p", False), ("7", "g", False)]
    known = spark.createDataFrame([(x,) for x in ("f", "g", "T.Run")], "id string")
    edges = callgraph.call_graph(calls, known)
    assert pairs(edges.where("kind = 'call'"), "source", "target", "dynamic") == [("f", "T.Run", True), ("f", "U.Run", True), ("f", "ext::p", False), ("f", "g", True)]
    assert pairs(edges.where("kind = 'stub'"), "source", "target") == [("1", "U.Run"), ("4", "ext::p")]
    assert edges.where("source = 'h' or target = '5'").count() == 0 and edges.where("kind = 'call_to_return'").count() == 5


def test_rows_that_break_constraints_stay_out(spark, tmp_path):
    g = graph(spark, [("a", "function", "A"), ("b", "local", "B")], [("a", "b", "ast")]).save(str(tmp_path))
    rows = [("b", "local", "other"), ("c", "local", "C2"), ("c", "local", "C1"), (None, "local", "x"), ("d", "local", ""), ("e", "call", "E")]
    new = spark.createDataFrame([(*r, *[None] * (len(NODES) - 3)) for r in rows], NODES)
    with pytest.raises(ValueError, match="missing': 2.*repeated': 1.*stored': 1"):
        g.add("nodes", new)
    assert Graph.load(spark, str(tmp_path)).nodes.count() == 2
    for _ in range(2):
        g = g.add("nodes", new, ignore=True)
        assert pairs(g.nodes, "id", "name") == [("a", "A"), ("b", "B"), ("c", "C1"), ("e", "E")]
    g = g.add("edges", graph(spark, [], [("a", "c", "ast")]).edges)
    assert pairs(g.edges, "source", "target", "kind") == [("a", "b", "ast"), ("a", "c", "ast")]
    with pytest.raises(ValueError, match="missing"):
        g.add("edges", spark.createDataFrame([("a", None, "ast", None)], EDGES))
    assert g.add("sources", g.sources).sources.count() == 0


def test_build_shuffles_items_a_few_times(spark):
    """Statements, blocks and their edges had a shuffle of the items for nearly each kind."""
    from meshquery import session
    from meshquery.plans import carrier

    def shuffles(df):
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")

    g = carrier.build(spark, "/root/testdata/sf0.001")
    assert shuffles(g.of("if", "call", "basic_block", "field")) == 0
    assert shuffles(g.along("dfg", "argument", "param_in", "cfg", "ast")) == 0
    before = spark.conf.get(session.WRITERS, None)
    with session.open_writers(spark, 3):
        assert spark.conf.get(session.WRITERS) == "3"
    assert spark.conf.get(session.WRITERS, None) == before


def test_orphans_are_found_from_ids_alone(spark, monkeypatch):
    edges = [("a", "b", "k", "x"), ("a", "c", "k", None), ("c", "a", "k", None), (None, "a", "k", None), ("a", None, "k", None), ("b", "b", "k", None), ("a", "b", "k", "x")]
    g = Graph(spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "id string"), spark.createDataFrame(edges, "source string, target string, kind string, properties string"))
    stored = []
    monkeypatch.setattr("meshquery.graph.kept", lambda df: stored.append(df) or df)
    kept = sorted((r.source, r.target) for r in g.without_orphans().edges.collect())
    assert kept == [("a", "b"), ("a", "b"), ("b", "b")]
    assert [(d.columns, [r.id for r in d.collect()]) for d in stored] == [(["id"], ["c"])]


def test_methods_that_all_types_share_make_no_pairs(spark, monkeypatch):
    """60 methods that 200 types and 50 interfaces share would be 600,000 pairs; each interface has one more that a type has."""
    shared = spark.range(60).selectExpr("concat('s', id) AS method")
    t, i = spark.range(200).selectExpr("concat('t', id) AS type"), spark.range(50).selectExpr("concat('i', id) AS interface")
    own = t.selectExpr("type", "replace(type, 't', 'own') AS method")
    m = t.crossJoin(shared).union(own).union(own).union(spark.createDataFrame([(None, "s1"), ("t1", None)], "type string, method string"))
    faces = i.crossJoin(shared).union(i.selectExpr("interface", "replace(interface, 'i', 'own')")).union(spark.createDataFrame([("none", "s1"), ("none", "unknown")], "interface string, method string"))
    sizes, kept = [], extract.kept
    monkeypatch.setattr(extract, "kept", lambda df: sizes.append((df.columns, df.count())) or kept(df))
    found = {(r.type, r.interface) for r in extract.implementations(m, faces).collect()}
    assert found == {(f"t{k}", f"i{k}") for k in range(50)}
    assert [n for columns, n in sizes if columns == ["interface", "type"]] == [50, 50]


def test_build_shuffles_only_keys_to_functions(spark, monkeypatch):
    """What items came with, and names of functions, are not sent along when statements are dealt by function."""
    plans = []
    monkeypatch.setattr("meshquery.plans.carrier.kept", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df))
    build(spark, "/root/testdata/sf0.001")
    items, statements, _ = plans
    assert items.count("Exchange hashpartitioning(ok") == 2  # items and their orders, each once
    assert statements.count("Exchange") - statements.count("BroadcastExchange") == 1
    below = statements.split("Exchange hashpartitioning(pk")[1]
    assert "fpkg" not in below.split("BroadcastExchange")[0] and "buyers" not in below


def test_build_leaves_only_the_graph(spark, monkeypatch):
    """What the build keeps on its way is removed; the stored graph, and folders of other work, stay."""
    from pathlib import Path

    from meshquery.plans import carrier
    from meshquery.session import shared_folder

    monkeypatch.setattr(carrier, "_stored", {})
    folders = lambda: {p.name for p in Path(shared_folder(spark).removeprefix("file:")).glob("kept-*")}
    other = kept(spark.range(3).toDF("id"))
    before = folders()
    g = carrier.stored(spark, "/root/testdata/sf0.001")
    assert before and folders() == before and other.count() == 3
    assert all(getattr(g, t).count() for t in ("nodes", "edges", "sources", "metrics", "history", "node_properties"))
