"""Running values over long orders, and what stands on them: scopes, logs; channels and taint past barriers."""

import random
import re

import pytest
from pyspark.sql import functions as F

from meshquery import session
from meshquery.operators import extract, sweep, taint
from meshquery.sources import ingest
from tests.test_graphs import edge_list, graph, pairs


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_pieces_give_what_one_window_gives(spark, width):
    rng = random.Random(width)
    rows = [(rng.choice("aab"), rng.randrange(-20, 60), i, rng.randrange(9) if rng.random() < 0.3 else None) for i in range(300)]
    d = spark.createDataFrame(rows, "k string, at long, tie long, v long")
    got = sweep.latest(sweep.running_total(d, ["k"], "at", F.col("tie"), "total", ("tie",), width), ["k"], "at", {"last": F.col("v")}, ("tie",), width)
    total, last, want = {}, {}, []
    for k, at, tie, v in sorted(rows, key=lambda r: r[:3]):
        total[k] = total.get(k, 0) + tie
        last[k] = v if v is not None else last.get(k)
        want.append((k, at, tie, total[k], last[k]))
    assert sorted(tuple(r) for r in got.select("k", "at", "tie", "total", "last").collect()) == want if all(x[4] is not None for x in want) else {tuple(r) for r in got.select("k", "at", "tie", "total", "last").collect()} == set(want)


def test_rows_are_stored_once_and_dealt_by_their_number(spark, monkeypatch):
    """What makes the rows ran once for the totals and again for the sweep, and a task's rows grew with the table."""
    monkeypatch.setattr(sweep, "ROWS", 20)
    runs = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda v: (runs.add(1), v)[1], "long").asNondeterministic()
    d = spark.range(200).select(F.lit("a").alias("k"), F.col("id").alias("at"), seen("id").alias("v"))
    got = sweep.running_total(d, ["k"], "at", F.col("v"), "total", (), 5)
    assert "hashpartitioning(k, _piece, 10)" in re.sub(r"#\d+L?", "", got._jdf.queryExecution().executedPlan().toString())
    assert [r.total for r in got.orderBy("at").collect()] == [k * (k + 1) // 2 for k in range(200)]
    assert runs.value == 200


def nested(rng, lo, hi, depth, out):
    """Random scopes inside [lo, hi), nested or apart."""
    while lo < hi and depth:
        start = rng.randrange(lo, hi)
        end = rng.randrange(start, hi) + 1
        out.append((start, end))
        nested(rng, start, end, depth - 1, out)
        lo = end


@pytest.mark.parametrize("seed", range(3))
def test_scopes_are_the_nearest_around(spark, seed):
    rng = random.Random(seed)
    spans = []
    nested(rng, 0, 400, 5, spans)
    spans += [(50, 50), (10, 10)]
    scopes = [(f"s{i:03}", "hot", a, b) for i, (a, b) in enumerate(spans)] + [("other", "cold", 0, 10), (None, "hot", 0, 400), ("lost", None, 0, 3)]
    places = [(f"n{i}", "hot", i) for i in range(-3, 420, 3)] + [("c", "cold", 5), ("d", "cold", 10), ("e", "none", 1), ("f", "hot", None)]
    want = set()
    real = [s for s in scopes if s[0] and s[1] and s[2] < s[3]]
    for id_, file, a, b in [(*s,) for s in scopes if s[0] and s[1]] + [(*p, None) for p in places if p[2] is not None]:
        # around a scope are those that hold it; of equal ones the lesser id is outside
        hold = [s for s in real if s[1] == file and s[0] != id_ and s[2] <= a < s[3] and (b is None or a >= b or (s[3] >= b and ((s[2], s[3]) != (a, b) or s[0] < id_)))]
        if hold:
            want.add((id_, min(hold, key=lambda s: (s[3] - s[2], [-ord(c) for c in s[0]]))[0]))
    s = spark.createDataFrame(scopes, "id string, file string, start long, end long")
    n = spark.createDataFrame(places, "id string, file string, at long")
    for width in (13, 100_000):
        assert set(pairs(extract.enclosing_scopes(s, n, width), "source", "target")) == want
    assert extract.enclosing_scopes(s.limit(0), n).count() == 0 and extract.enclosing_scopes(s, n.limit(0)).count() > 0


def test_a_log_in_many_splits_reads_alike(spark, tmp_path):
    rng = random.Random(5)
    lines = []
    for c in range(300):
        lines += [f"{c:040x} 2024-01-01T00:00:00Z Author {c % 7}", ""] + [f"{rng.randrange(50)}\t{rng.randrange(9)}\tsrc/f{rng.randrange(20)}.go" for _ in range(rng.randrange(6))]
    (tmp_path / "log.txt").write_text("\n".join(lines))
    whole = pairs(ingest.file_history(ingest.numbered(spark, str(tmp_path))), "file", "commit_count", "author_count", "last_author", "insertions", "deletions")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        d = ingest.numbered(spark, str(tmp_path))
        assert d.rdd.getNumPartitions() > 1 and [r.line for r in d.orderBy("at").collect()] == lines
        assert pairs(ingest.file_history(d, width=500), "file", "commit_count", "author_count", "last_author", "insertions", "deletions") == whole and len(whole) == 20
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_channels_reach_their_uses_however_far(spark):
    chain = [(f"v{i}", f"v{i + 1}") for i in range(12)]
    flows = edge_list(spark, *chain, ("m", "v0"), ("v12", "s"), ("v12", "v9"), ("v9", "r"), ("k", "r"))
    makes = spark.createDataFrame([("m",), ("k",)], "id string")
    ends = spark.createDataFrame([("s", "send"), ("r", "receive"), ("x", "send")], "id string, kind string")
    assert pairs(extract.channel_ends(flows, makes, ends), "channel", "id", "kind") == [("k", "r", "receive"), ("m", "r", "receive"), ("m", "s", "send")]
    assert pairs(extract.channel_flow(flows, makes, ends), "source", "target") == [("s", "r")]


def test_panics_meet_recovers_of_deferred_functions(spark):
    nodes = [(i, "call", name, {"parent_function": f}) for i, name, f in (("p", "panic", "f"), ("q", "panic", "g"), ("r", "recover", "lit"), ("s", "recover", "g"))]
    g = graph(spark, nodes, [])
    assert pairs(extract.panic_recover(g), "source", "target") == [("q", "s")]
    assert pairs(extract.panic_recover(g, spark.createDataFrame([("f", "lit")], "function string, literal string")), "source", "target") == [("p", "r"), ("q", "s")]


def test_barriers_cut_walks(spark):
    ext = [("ext::src", "function", "ReadFile", {"package": "os"})]
    g = graph(spark, [*ext, *[(x, "call", x) for x in "abcde"]], [("a", "b", "dfg"), ("b", "c", "dfg"), ("c", "d", "dfg"), ("a", "e", "dfg"), ("e", "f", "dfg")])
    roles = spark.createDataFrame([("a", "source"), ("b", "barrier"), ("f", "sink"), ("d", "sink")], "node_id string, role string")
    real, taint.roles = taint.roles, lambda _: roles
    try:
        assert pairs(taint.clean_hops(g), "node_id", "source_id", "hops") == [("a", "a", 0), ("b", "a", 1), ("e", "a", 1), ("f", "a", 2)]
    finally:
        taint.roles = real


def test_a_cluster_needs_a_shared_folder():
    class Unset:
        master = "spark://somewhere:7077"
        conf = property(lambda self: self)
        sparkContext = property(lambda self: self)
        get = staticmethod(lambda key, default: default)
        getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Unset())
