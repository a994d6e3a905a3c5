"""The two jobs: growing input, reruns, command lines; the index and the stages they stand on."""

import json
import os
import subprocess
import sys
from pathlib import Path

import pytest

from jobs import index_sources, review_graph
from meshquery.graph import Graph
from meshquery.operators import stages
from meshquery.plans import carrier
from meshquery.sources import search
from tests.test_graphs import graph, pairs

DIR = "/root/testdata/sf0.001"
CONFIG = json.loads(index_sources.CONFIG.read_text())
TEXTS = "doc_id long, text string, source string"


def put(spark, path, rows):
    spark.createDataFrame(rows, TEXTS).coalesce(1).write.mode("append").parquet(path)


def listing(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def hits(df):
    return sorted((r.file, r.hits) for r in df.collect())


def test_index_takes_only_what_is_new(spark, tmp_path):
    at, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    put(spark, at, [(1, "alpha beta alpha", "p"), (2, None, None), (None, "lost", "p")])
    first = index_sources.run(spark, at, out, mark, CONFIG)
    assert pairs(first.where("field = 'content'"), "term", "file", "positions") == [("alpha", "doc1.go", [0, 2]), ("beta", "doc1.go", [1])]
    old = listing(out)
    index_sources.run(spark, at, out, mark, CONFIG)
    assert listing(out) == old  # nothing new, nothing written
    put(spark, at, [(3, "beta gamma", "q"), (1, "delta", "p")])
    again = index_sources.run(spark, at, out, mark, CONFIG)
    new = listing(out)
    assert old.items() <= new.items() and all("batch=1" in f for f in new.keys() - old.keys())
    assert pairs(again.select("batch").distinct(), "batch") == [(0,), (1,)]
    i = search.Index.load(spark, out)
    assert hits(i.every("beta")) == [("doc3.go", 1)] and hits(i.every("DELTA")) == [("doc1.go", 1)] and hits(i.every("alpha")) == []
    assert i.files.count() == 3
    assert index_sources.run(spark, at, out, mark, CONFIG).count() == again.count()


def test_a_batch_written_again_takes_its_own_place(spark, tmp_path):
    texts = lambda *rows: spark.createDataFrame(list(rows), "file string, content string, package string")
    out = str(tmp_path)
    search.write_batch(texts(("a", "x y", "p"), ("b", "x", "p")), out, 0)
    search.write_batch(texts(("c", "x", "p")), out, 1)
    before = pairs(search.Index.load(spark, out).postings, "term", "field", "file", "positions", "batch")
    search.write_batch(texts(("c", "x", "p")), out, 1)
    assert pairs(search.Index.load(spark, out).postings, "term", "field", "file", "positions", "batch") == before


def test_index_of_nothing(spark, tmp_path):
    at = str(tmp_path / "in")
    put(spark, at, [])
    assert index_sources.run(spark, at, str(tmp_path / "out"), str(tmp_path / "mark"), CONFIG).count() == 0


def test_searches(spark):
    rows = [("a.go", "the cat and the dog the cat", "pets"), ("b.go", "cat the; Dog THE cat", None), ("the.go", "cat", "the cat"), ("c.go", None, "catalogue"), ("c.go", "dog", "catalogue")]
    g = graph(spark, [], []).but(sources=spark.createDataFrame(rows, "file string, content string, package string"))
    i = search.Index.of(g)
    assert hits(i.phrase("the cat")) == [("a.go", 2), ("b.go", 1), ("the.go", 1)]
    assert hits(i.phrase("the dog the cat")) == [("a.go", 1), ("b.go", 1)] and hits(i.phrase("the the")) == [] and hits(i.phrase("")) == []
    assert hits(i.phrase("Cat")) == [("a.go", 2), ("b.go", 2), ("the.go", 2)]
    assert hits(i.every("dog cat the")) == [("a.go", 6), ("b.go", 5)] and hits(i.every("")) == []
    assert hits(i.prefix("cat")) == [("a.go", 2), ("b.go", 2), ("c.go", 1), ("the.go", 2)] and hits(i.prefix("")) == []
    assert hits(i.some(every="cat", none="dog")) == [("the.go", 2)] and hits(i.some(some="dog pets")) == [("a.go", 2), ("b.go", 1), ("c.go", 1)]
    assert hits(i.some(none="dog")) == []
    best = i.ranked("dog pets", 2).collect()
    assert best[0].file == "a.go" and len(best) == 2 and best[0].score > best[1].score > 0
    assert i.ranked("nowhere").count() == 0 and i.ranked("").count() == 0


def test_a_search_opens_its_own_shards_only(spark, tmp_path):
    out = str(tmp_path)
    search.write_batch(spark.read.parquet(f"{DIR}/documents.parquet").selectExpr("concat('d', doc_id) AS file", "text AS content", "source AS package"), out)
    i = search.Index.load(spark, out)
    every, few = len(i.postings.inputFiles()), i.rows(["worthless"])
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan and "In(" not in plan.split("PushedFilters")[0].split("DataFilters")[0] and "term" in plan.split("PushedFilters")[1]
    few.count()
    assert {r.shard for r in few.select("shard").distinct().collect()} == {search.hashlib.md5(b"worthless").hexdigest()[0]} and every >= 16


def small(spark, path):
    nodes = [("f", "function", "F", {"package": "p", "file": "a.go", "line": 1}), ("v", "local", "v", {"parent_function": "f", "package": "p", "file": "a.go", "line": 2}), ("w", "local", "w", {"parent_function": "f", "package": "q"})]
    history = spark.createDataFrame([("a.go", 4)], "file string, commit_count long")
    return graph(spark, nodes, [("f", "v", "ast")]).but(history=history).save(path)


def test_review_runs_again_safely(spark, tmp_path):
    at, out = str(tmp_path / "graph"), str(tmp_path / "out")
    small(spark, at)
    before = listing(at)
    config = json.loads(review_graph.CONFIG.read_text())
    got = review_graph.run(spark, at, out, config)
    rows = pairs(got, *got.columns)
    dead = [r for r in got.collect() if r.category == "dead_store"]
    assert sorted((r.node_id, r.package, r.commits, r.weight) for r in dead) == [("v", "p", 4, 15), ("w", "q", 0, 3)]
    again = review_graph.run(spark, at, out, config)
    assert pairs(again, *again.columns) == rows and listing(at) == before
    only = review_graph.run(spark, at, out, config | {"categories": ["dead_store"], "severities": ["warning"]})
    assert only.count() == 2 and [p.name for p in (Path(out) / "findings/severity=warning").iterdir()] == ["category=dead_store"]
    totals = spark.read.parquet(f"{out}/packages")
    assert pairs(totals, "package", "severity", "findings", "weight") == [("p", "warning", 1, 15), ("q", "warning", 1, 3)]


def test_stages_add_to_a_stored_graph(spark, tmp_path):
    nodes = [("c", "call", "c", {"properties": '{"k":1}'}), ("x", "local", "x"), ("y", "local", "y"), ("ext::j", "function", "Unmarshal", {"package": "encoding/json"})]
    edges = [("c", "ext::j", "call_site"), ("c", "x", "argument", '{"index":0}'), ("c", "y", "argument", '{"index":1}')]
    raw = graph(spark, nodes, edges).save(str(tmp_path))
    g = stages.complete(raw)
    assert pairs(g.edges.where("kind in ('dfg', 'eog')"), "source", "target", "kind", "properties") == [
        ("x", "y", "dfg", '{"heuristic":true,"side_effect":true}'), ("x", "y", "eog", None), ("y", "c", "eog", '{"final":true}'),
    ]
    assert pairs(g.node_properties.where("key = 'k'"), "node_id", "value") == [("c", "1")]
    n = g.edges.count()
    assert stages.complete(g, "flows", "order").edges.count() == n and Graph.load(spark, str(tmp_path)).edges.count() == n
    g = g.put("flows", edges=raw.edges.limit(0))
    assert g.edges.count() == n - 1 and g.step("eog").count() == 2
    plan = g.having("k")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(key" in plan
    with pytest.raises(ValueError):
        graph(spark, nodes, edges).put("flows")


def test_the_stored_carrier_has_all_stages(spark):
    g = carrier.stored(spark, DIR)
    kinds = {r.kind for r in g.edges.select("kind").distinct().collect()}
    assert "eog" in kinds and not g.edges.where("kind = 'dfg' AND properties LIKE '%side_effect%'").isEmpty() and not g.having("taint_role", "sink").isEmpty()


@pytest.mark.parametrize("job", ["index_sources", "review_graph"])
def test_command_lines(spark, tmp_path, job):
    at, out = str(tmp_path / "in"), str(tmp_path / "out")
    if job == "index_sources":
        put(spark, at, [(1, "alpha beta", "p")])
        more = ["--checkpoint", str(tmp_path / "mark")]
    else:
        small(spark, at)
        more = []
    root = Path(__file__).resolve().parent.parent
    done = subprocess.run([sys.executable, "-m", f"jobs.{job}", "--input", at, "--output", out, *more], cwd=root, env=os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --driver-memory 1g pyspark-shell"}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "read" in done.stderr and "wrote" in done.stderr
    assert list(Path(out).rglob("*.parquet"))


def test_postings_are_shuffled_once(spark):
    d = spark.createDataFrame([("a.go", "one two one", "p"), ("b.go", "two", None)], "file string, content string, package string")
    rows = search.ordered(search.postings(d))
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert {(r.term, tuple(r.positions)) for r in rows.where("file = 'a.go' AND field = 'content'").collect()} == {("one", (0, 2)), ("two", (1,))}
