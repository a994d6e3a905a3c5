"""Sources, search, the client's lookups and streams."""

import pytest

from meshquery import api, registry_more
from meshquery.operators import dashboards, findings
from meshquery.schema import NODES
from meshquery.sources import ingest, search
from meshquery.streaming import live
from tests.test_graphs import functions, graph, pairs


def lines(spark, text):
    return spark.createDataFrame([("log", i, x) for i, x in enumerate(text.split("\n"))], "log string, at int, line string")


def test_escape_log(spark):
    text = "# pkg\n./a/b.go:10:2: moved to heap: x\na/b.go:11:3: leaking param: p to result\n/abs.go:1:1: can inline f\na/b.go:12:1: can inline F\na/b.go:13:5: new(T) escapes to heap\na/b.go:14:6: q does not escape\nnoise\na/b.go:1:1: other"
    got = pairs(ingest.escapes(lines(spark, text), "mod"), "file", "line", "kind", "detail")
    assert got == [("mod/a/b.go", 10, "moved_to_heap", "x"), ("mod/a/b.go", 11, "leaking_param", "p to result"), ("mod/a/b.go", 12, "inlineable", "F"), ("mod/a/b.go", 13, "escapes_to_heap", "new(T)"), ("mod/a/b.go", 14, "does_not_escape", "q")]
    g = graph(spark, [("x", "local", "x", {"file": "f", "line": 10}), ("F", "function", "F", {"file": "f", "line": 12}), ("q", "parameter", "q", {"file": "f", "line": 10})], [])
    e = spark.createDataFrame([("f", 10, 1, "moved_to_heap", ""), ("f", 10, 1, "does_not_escape", ""), ("f", 12, 1, "inlineable", "")], "file string, line long, col long, kind string, detail string")
    assert pairs(ingest.escape_properties(g, e), "node_id", "key", "value") == [("F", "inlineable", "true"), ("q", "heap_escapes", "true"), ("x", "heap_escapes", "true")]


def test_change_log(spark):
    h = "a" * 40
    text = f"{h} 2024-02-02 Ann B\n\n3\t1\tx.go\n-\t-\timg.go\n5\t5\tx.md\n{'b' * 40} 2024-01-01 Bob\n\n2\t0\tx.go\n7\t7\ty.go"
    got = ingest.file_history(lines(spark, text)).orderBy("file").collect()
    assert [tuple(r) for r in got] == [("x.go", 2, 2, "Ann B", "2024-02-02", 5, 1, 6), ("y.go", 1, 1, "Bob", "2024-01-01", 7, 7, 14)]


def test_blame(spark):
    text = f"{'a' * 40} 1 7 1\nauthor Ann\nauthor-time 99\n\tcode\n{'b' * 40} 2 8\nauthor Bob\nauthor-time 98\n\tmore"
    assert pairs(ingest.blame(lines(spark, text)), "line", "author", "date", "commit") == [(7, "Ann", "99", "a" * 12), (8, "Bob", "98", "b" * 12)]


def test_source_texts(spark, tmp_path):
    (tmp_path / "root/pkg").mkdir(parents=True)
    (tmp_path / "root/main.go").write_text("package main\n")
    (tmp_path / "root/pkg/a.go").write_text("package a\nfunc A()")
    (tmp_path / "root/pkg/a_test.go").write_text("x")
    got = pairs(ingest.source_texts(spark, str(tmp_path / "root"), "root/"), "file", "package", "content")
    assert got == [("main.go", "main", "package main\n"), ("pkg/a.go", "pkg", "package a\nfunc A()")]


def test_search(spark):
    src = spark.createDataFrame([("a.go", "func Café(x)", "p"), ("b.go", "cafe and func", "q"), ("c.go", None, None)], "file string, content string, package string")
    i = search.inverted_index(graph(spark, [], [], sources=src))
    assert pairs(search.match(i, "CAFÉ func"), "file") == [("a.go",), ("b.go",)]
    assert search.match(i, "cafe missing").count() == 0 and search.match(i, "..").count() == 0


def test_a_stored_graph_is_indexed_once(spark, tmp_path, monkeypatch):
    written = []
    monkeypatch.setattr(search, "write_batch", lambda *a, f=search.write_batch: written.append(a) or f(*a))
    src = spark.createDataFrame([("a.go", "func", "p")], "file string, content string, package string")
    g = graph(spark, [("x", "local", "x")], [], sources=src).save(str(tmp_path / "g"))
    assert all(pairs(search.Index.of(g).every("func"), "file") == [("a.go",)] for _ in range(2)) and len(written) == 1


def test_searches_build_no_graph(spark, monkeypatch):
    def built(*_):
        raise AssertionError("a graph was built")

    monkeypatch.setattr(registry_more, "stored", built)
    found = registry_more.queries()
    hits = {k: found[k](spark, "/root/testdata/sf0.001").count() for k in found if k.startswith("S13_")}
    assert len(hits) == 5 and hits["S13_ranked"] == 50


@pytest.fixture
def served(spark):
    metrics = spark.createDataFrame([("H", 5, 1, 0, 10, 1), ("R", 2, 0, 1, 4, 0)], "function_id string, cyclomatic_complexity long, fan_in long, fan_out long, loc long, num_params long")
    src = spark.createDataFrame([("main.go", "package main", None)], "file string, content string, package string")
    nodes = [("H", "function", "Handler", {"package": "main", "file": "main.go", "line": 10, "end_line": 20}), ("R", "function", "Run", {"package": "main", "file": "main.go", "line": 5, "end_line": 8})]
    return graph(spark, nodes, [("R", "H", "call"), ("R", "H", "dfg"), ("H", "R", "param_out")], metrics=metrics, sources=src)


def test_lookups(served):
    for call in (lambda: api.search(served, ""), lambda: api.subgraph(served, None), lambda: api.slice_(served, ""), lambda: api.package_functions(served, None), lambda: api.source(served, None)):
        with pytest.raises(api.BadRequest):
            call()
    assert api.search(served, "handler").first().name == "Handler"
    s = api.subgraph(served, "H")
    assert pairs(s.nodes, "id") == [("H",), ("R",)] and pairs(s.edges, "source", "target") == [("R", "H")]
    assert '"nodes": [{"id": "H"' in s.to_json()
    assert api.package_functions(served, "main").first().name == "Handler"
    assert api.source(served, "main.go") == "package main"
    with pytest.raises(api.NotFound):
        api.source(served, "other.go")
    assert pairs(api.slice_(served, "H", "sideways").nodes, "id") == [("H",), ("R",)]
    assert pairs(api.slice_(served, "R", "forward").nodes, "id") == [("H",), ("R",)]
    assert api.search(served, "n", limit="junk").count() == 2 and api.search(served, "n", limit=1).count() == 1
    assert pairs(api.slice_lines(api.slice_(served, "H")), "file") == [("main.go",)]


def test_slice_lines_are_those_of_the_whole_slice(spark):
    n = api.MOST_NODES + 50
    nodes = [("H", "parameter", "H", {"file": "main.go", "line": n})] + [(f"n{k}", "local", "x", {"file": "main.go", "line": k}) for k in range(1, n)]
    g = graph(spark, nodes, [(f"n{k}", "H", "param_in") for k in range(1, n)])
    assert registry_more.GRAPH["A8_slice_lines"](g).first().lines == ",".join(map(str, range(1, n + 1)))
    assert api.slice_(g, "H").nodes.count() == api.MOST_NODES and api.whole_slice(g, "H").edges.count() == n - 1


def test_package_functions_ask_for_those_shown(spark, monkeypatch):
    n = api.MOST_NODES + 20
    nodes = [(f"f{k:03}", "function", f"F{k:03}", {"package": "main", "file": "m.go", "line": k + 1}) for k in range(n)] + [("x", "function", "X", {"package": "other"})]
    nodes += [(f"l{k}", "local", "v", {"parent_function": f"f{k:03}"}) for k in range(n)]
    g = graph(spark, nodes, [("x", "f001", "call"), ("f001", "x", "call"), ("f001", "f002", "call")])
    asked, every = [], dashboards.function_detail(g)
    monkeypatch.setattr(api.dashboards, "function_detail", lambda *a, f=api.dashboards.function_detail, **k: asked.append(k["only"].count()) or f(*a, **k))
    got = api.package_functions(g, "main")
    assert asked == [api.MOST_NODES]
    assert got.collect() == api.package_functions(g, "main", every).collect()
    assert [(r.callers, r.callees, r.num_locals) for r in got.where("function_id = 'f001'").collect()] == [("X", "F002,X", 1)]


def test_streams(spark, tmp_path):
    g = functions(spark, ["aa"])
    spark.createDataFrame([("n1", "function", "bad") + (None,) * 8], NODES).write.parquet(str(tmp_path / "in/one"))
    src = str(tmp_path / "in/*")
    q = live.kinds(spark, src).writeStream.outputMode("complete").format("memory").queryName("kinds").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [tuple(r) for r in spark.sql("select * from kinds").collect()] == [("function", 1)]
    base = g.but(edges=spark.createDataFrame([("n1", "n1", "call", None)], g.edges.schema))
    live.watch(spark, src, findings.recursive, str(tmp_path / "out"), str(tmp_path / "cp"), base).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
