"""Simple paths by states, against paths made one by one."""

import random
from collections import Counter

from meshquery.operators import paths


def made(spark, edges):
    return spark.createDataFrame(edges, "source string, target string")


def ids(spark, *names):
    return spark.createDataFrame([(x,) for x in names], "id string")


def plain(edges, starts, depth):
    """All simple paths, as tuples."""
    after = {}
    for a, b in {e for e in edges if None not in e}:
        after.setdefault(a, []).append(b)
    level = [(s,) for s in sorted(set(starts))]
    out = list(level)
    for _ in range(depth):
        level = [(*p, n) for p in level for n in after.get(p[-1], ()) if n not in p]
        out += level
    return out


def counted(df):
    return {(r.id, r.depth): int(r.paths) for r in df.collect()}


def test_ends_on_cycles_equal_enumeration(spark):
    rng = random.Random(3)
    names = [f"n{i}" for i in range(7)]
    edges = [(rng.choice(names), rng.choice(names)) for _ in range(16)]
    edges += edges[:3] + [(None, "n1"), ("n1", None)]
    want = Counter((p[-1], len(p) - 1) for p in plain(edges, ["n0", "n1"], 6))
    assert counted(paths.ends(made(spark, edges), ids(spark, "n0", "n1", "n0", None), 6)) == want


def test_shortest_on_cycles_equals_enumeration(spark):
    rng = random.Random(5)
    names = ["a", "ab", "b", "b!", "c", "d.e", "f"]
    edges = [(x, y) for x in names for y in names if rng.random() < 0.55]
    for n, hops in ((4, 5), (1000, 4)):
        want = sorted((len(p) - 1, " -> ".join(p)) for p in plain(edges, ["a"], hops) if p[-1] == "f" and len(p) > 1)[:n]
        got = [(r.depth, r.path) for r in paths.shortest(made(spark, edges), ids(spark, "a"), ids(spark, "f"), hops, n, " -> ").collect()]
        assert got == want and got


def test_many_paths_are_few_rows(spark):
    """Nine full layers of 30 nodes and a hub between them: 30 ** 9 paths, which nothing could list."""
    edges = [(f"{k}-{i}", f"{k + 1}-{j}") for k in range(9) for i in range(30) for j in range(30)]
    edges += [("start", f"0-{i}") for i in range(30)] + [(f"9-{i}", "end") for i in range(30)]
    e = made(spark, edges)
    got = counted(paths.ends(e, ids(spark, "start"), 11))
    assert len(got) == 1 + 10 * 30 + 1 and got["end", 11] == 30**10 and got["9-4", 10] == 30**9
    first = [r.path for r in paths.shortest(e, ids(spark, "start"), ids(spark, "end"), 11, 2, " ").collect()]
    head = "start " + " ".join(f"{k}-0" for k in range(9))
    assert first == [f"{head} 9-0 end", f"{head} 9-1 end"]


def test_a_number_of_more_digits_is_null(spark):
    d = spark.sql("SELECT * FROM VALUES (1, 5E37BD), (1, 4E37BD), (2, 6E37BD), (2, 5E37BD), (3, 1BD), (3, NULL) AS t(id, n)").withColumn("n", paths.F.col("n").cast(paths.NUMBER))
    assert {r.id: r.n for r in d.groupBy("id").agg(paths._total("n")).collect()} == {1: 9 * 10**37, 2: None, 3: None}


def test_nothing_to_walk(spark):
    e = made(spark, [("a", "a"), ("a", "b")])
    assert counted(paths.ends(e, ids(spark, "a"), 3)) == {("a", 0): 1, ("b", 1): 1}
    assert counted(paths.ends(e, ids(spark), 3)) == {}
    assert counted(paths.ends(made(spark, []), ids(spark, "x"), 3)) == {("x", 0): 1}
    for start, end in (("a", "a"), ("b", "a"), ("a", "nowhere")):
        assert paths.shortest(e, ids(spark, start), ids(spark, end), 3, 5, " ").count() == 0


def test_rows_come_as_often_as_their_number(spark):
    d = spark.createDataFrame([("a", 1), ("b", 65536), ("c", 65537)], "id string, n long").withColumn("n", paths.F.col("n").cast(paths.NUMBER))
    assert {r.id: r["count"] for r in paths.repeated(d, "n").groupBy("id").count().collect()} == {"a": 1, "b": 65536, "c": 65537}
