"""The filter audit against a plain version."""

import itertools
import re

import pytest
from pyspark.sql import functions as F

from meshquery.llm import audit

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, mask string, part string, words string, blocks string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
GOOD = " ".join(f"word{k}" for k in range(60))
LONG = " ".join(f"w{k}" for k in range(9000))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 1, "k", "m", "p", "w", "b") for i, t, s in rows], DOCS)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, part string, mask string")


def plain(rows, said):
    fails = []
    for i, t, s in rows:
        t = t or ""
        ws = WORD.findall(t)
        f = set()
        if len(ws) < 50:
            f.add("A")
        if 100 * len(set(ws)) < 65 * len(ws):
            f.add("B")
        if 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t):
            f.add("C")
        if set(t) & set("#$%&*|"):
            f.add("D")
        if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows):
            f.add("E")
        good = any(j is not None and j == i and q == 1 for j, q, *_ in said)
        toxic = any(j is not None and j == i and x == 1 for j, _, x, *_ in said)
        fails.append((s or "", f, good, toxic))
    out = {}
    for part in {p for p, *_ in fails}:
        mine = [x for x in fails if x[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            live = mine
            for k, name in enumerate(order):
                gone = [x for x in live if name in x[1]]
                live = [x for x in live if name not in x[1]]
                total[name] += len(gone)
                out[part, "".join(order), k + 1] = [
                    len(live), len(gone), sum(name in x[1] for x in mine) - len(gone), sum(x[1] == {name} for x in mine), sum(x[2] for x in gone), sum(x[3] for x in gone), name,
                ]
        for key, row in out.items():
            if key[0] == part and isinstance(row[-1], str):
                row[-1] = total[row[-1]]
    return out


def found(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


ROWS = [
    (1, GOOD, "a"), (2, GOOD, "b"), (3, GOOD.upper(), "a"), (4, GOOD + " #", "a"), (5, GOOD + " $", "a"), (6, None, None), (7, "", "b"), (8, " \n", "b"), (9, "x " * 70, "a"), (10, "X| " * 9, None),
    (None, GOOD, "a"), (None, GOOD, "a"), (11, GOOD, "a"), (11, GOOD, "a"), (12, LONG, "b"), (13, LONG[:-1] + "x", "b"), (14, LONG, "a"), (15, "é漢\U0001f600 " * 30, "a"), (16, "é漢\U0001f600 " * 30, ""), (-3, "Ab", "c"), (17, "Ab", "c"),
    (18, "a" * 64 + "b" * 64, "c"), (19, "a" * 64 + "c" * 64, "c"), (20, "a" * 64 + "b" * 64, "c"),
]
SAID = [(1, 1, 0, "p", "m"), (1, 0, 1, "p", "m"), (2, 1, None, "p", "m"), (9, None, 1, "p", "m"), (14, 1, 1, "p", "m"), (None, 1, 1, "p", "m"), (99, 1, 1, "p", "m")]


def test_audit_is_that_of_a_plain_version(spark):
    assert found(audit.audit(docs(spark, ROWS), labels(spark, SAID))) == plain(ROWS, SAID)


@pytest.mark.parametrize("hot", [1, 1000])
def test_texts_that_share_their_hashes_are_told_apart(spark, monkeypatch, hot):
    monkeypatch.setattr(audit, "_block_hashes", lambda text, size: F.array(F.lit(5).cast("long")))
    monkeypatch.setattr(audit, "HOT", hot)
    assert found(audit.audit(docs(spark, ROWS), labels(spark, SAID))) == plain(ROWS, SAID)


def test_all_rows_may_be_copies(spark):
    rows = [(i, GOOD, "a") for i in range(400)]
    got = found(audit.audit(docs(spark, rows), labels(spark, [])))
    assert got["a", "ABCDE", 5] == [1, 399, 0, 399, 0, 0, 399 * 120] and got["a", "EDCBA", 5][:2] == [1, 0]


def test_empty_tables(spark):
    assert audit.audit(docs(spark, []), labels(spark, SAID)).count() == 0
    assert len(found(audit.audit(docs(spark, ROWS[:3]), labels(spark, [])))) == 2 * 600


def test_other_filters(spark):
    own = {"S": F.col("n_words") < 2, "L": F.col("n_words") > 100}
    got = audit.audit(docs(spark, ROWS), labels(spark, SAID), own, part="lang")
    assert {(r.filter_order, r.step, r.kept) for r in got.collect()} == {("SL", 1, 16), ("SL", 2, 13), ("LS", 1, 21), ("LS", 2, 13)}
    with pytest.raises(ValueError):
        audit.audit(docs(spark, ROWS), labels(spark, SAID), {"E": None, "F": None})


def test_blocks_cover_a_text_once(spark):
    size = 5000
    d = spark.createDataFrame([(("ab漢" * size)[:size],)], "text string").select("text", F.char_length("text").alias("n"))
    starts = [s for s in audit.STARTS if s <= size]
    assert starts[0] == 1 and all(b == a + (a - 1) * 7 + 64 for a, b in zip(starts, starts[1:]))
    assert d.select(F.size(audit._block_hashes(F.col("text"), F.col("n")))).first()[0] == len(starts)
