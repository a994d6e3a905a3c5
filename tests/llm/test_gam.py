"""The quality classifier: its features against plain ones, its trees against all cuts, its held-out accuracy."""

import itertools
import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meshquery.llm import gam
from meshquery.llm.common import column_bytes
from meshquery.llm.queries import op12_quality_classifier

DOCS = "doc_id long, text string, lang string, source string, n_chars long, label int, score double, x string"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
TEXTS = ["", " \n", "word", "Two words\nTwo words\n\n12 | a## !", "x x x x x x x y", "Ünï çödé 漢字 end. END? extraordinarily", "a b c d e a b c d e a b c d e", "LOUD!! TEXT!!\nLOUD!! TEXT!!"]


def plain(text):
    raw = text.encode()
    ws = [w.lower() if w.isascii() else bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in WORD.findall(raw)]
    over = lambda a, b: a / max(b, 1)
    tally = lambda chars: sum(raw.count(c.encode()) for c in chars)
    up, low = sum(65 <= c <= 90 for c in raw), sum(97 <= c <= 122 for c in raw)
    runs = {k: [tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)] for k in (2, 5)}
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        math.log1p(len(ws)), math.log1p(len(raw)), over(sum(map(len, ws)), len(ws)), over(tally("#*$%&|<>"), len(raw)), over(up, up + low), over(tally("!"), len(raw)), over(tally("0123456789"), len(raw)), over(tally(".?!;:"), len(ws)),
        over(sum(c >= 128 for c in raw), len(raw)), over(sum(w[-1:] in b"#*$%&|<>!" for w in ws), len(ws)), over(sum(not re.search(rb"[A-Za-z0-9\x80-\xff]", w) for w in ws), len(ws)), over(sum(len(w) <= 3 for w in ws), len(ws)),
        over(sum(len(w) > 12 for w in ws), len(ws)), math.log1p(len(set(ws))) / math.log1p(max(len(ws), 1)), over(sum(a == b for a, b in itertools.pairwise(ws)), len(ws)), over(max([ws.count(w) for w in ws], default=0), len(ws)),
        over(len(set(runs[2])), len(runs[2])), over(len(set(runs[5])), len(runs[5])), over(len(lines) - len(set(lines)), len(lines)), math.log1p(over(len(ws), len(lines))),
    ]


def test_features_are_plain_ones():
    got = gam.features(*column_bytes(pa.array(TEXTS)))
    assert got.shape == (len(TEXTS), len(gam.FEATURES))
    np.testing.assert_allclose(got, [plain(t) for t in TEXTS], atol=1e-12)
    assert gam.features(*column_bytes(pa.array([], pa.string()))).shape[0] == 0
    np.testing.assert_allclose(gam.features(*column_bytes(pa.array(TEXTS[3:4] * 3)))[1], got[3])


@pytest.mark.parametrize("seed", range(5))
def test_a_cut_is_the_best_one(seed):
    rng = np.random.default_rng(seed)
    g, h = rng.normal(size=9), rng.random(9)
    of = lambda a, b: a.sum() ** 2 / (b.sum() + gam.RIDGE)
    gain, at = gam._cut(g, h)
    assert gain == pytest.approx(max(of(g[:k], h[:k]) + of(g[k:], h[k:]) - of(g, h) for k in range(1, 9)))
    tree = gam._tree(g, h)
    assert len(np.unique(tree)) <= 4 and tree.shape == g.shape
    cells = gam._tree(rng.normal(size=(4, 5)), rng.random((4, 5)))
    assert cells.shape == (4, 5) and len(np.unique(cells)) <= 4


def test_pairs_learn_what_single_features_cannot():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) != (x[:, 1] > 0.5)).astype(float)
    model = gam.Model(x, y, np.ones(len(y)))
    assert (1, 0) in model.pairs
    assert ((model.score(x) >= 0.5) == y).mean() > 0.95
    z = model.bias + sum(t[np.searchsorted(c, x[:, f], "right")] for f, (t, c) in enumerate(zip(model.tables, model.cuts)))
    z = z + sum(m[np.searchsorted(model.coarse[i], x[:, i], "right"), np.searchsorted(model.coarse[j], x[:, j], "right")] for (i, j), m in zip(model.pairs, model.cells))
    np.testing.assert_allclose(model.score(x), 1 / (1 + np.exp(-z)))


def rows(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 1, 7, 0.1, "x") for i, t in texts], DOCS)


def test_held_out_documents_are_told_apart(spark):
    sf = "/root/testdata/sf0.01"
    got = op12_quality_classifier(spark, sf)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = got.where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    right = held.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.count("*")).first()
    assert right[1] > 50 and right[0] > 0.97


def test_awkward_tables(spark):
    good, bad = "plain words that make a sentence here.", "LOUD!! WORDS## AGAIN!!"
    docs = rows(spark, [(k, good if k % 2 else bad) for k in range(60)] + [(1, bad), (1, good), (None, good), (None, None), (100, ""), (101, None), (102, "long " * 200_000)])
    labels = spark.createDataFrame([(k, k % 2, 0, "x") for k in range(60)] + [(1, None, 0, "x"), (1, 0, 0, "x"), (None, 1, 0, "x"), (500, 0, 0, "x")], "doc_id long, quality int, toxic int, text string")
    model = gam.train(docs, labels, F.lit(True))
    got = gam.score(docs, model)
    assert got.count() == docs.count() and got.where("score IS NULL OR score NOT BETWEEN 0 AND 1").isEmpty()
    assert {r.score >= 0.5 for r in got.where("doc_id % 2 = 1 AND doc_id BETWEEN 2 AND 59").collect()} == {True}
    assert got.where("doc_id = 1").count() == 3
    assert gam.score(rows(spark, []), model).count() == 0
    none = labels.where("false")
    assert gam.train(docs, none, F.lit(True)) is None and gam.train(rows(spark, []), labels, F.lit(True)) is None
    assert {r.score for r in gam.score(docs, None).collect()} == {0.5}
    assert gam.score(docs, gam.train(docs, labels.where("quality = 1"), F.lit(True))).where("score < 0.9").isEmpty()


def test_the_sample_is_bounded_and_keeps_shares(spark):
    labels = spark.range(5000).selectExpr("id AS doc_id", "cast(id % 10 > 0 AS int) AS quality")
    picked, n = gam.sampled(labels, F.col("doc_id") >= 0, each=100)
    assert n == {0: 500, 1: 4500} and {r.label: r["count"] for r in picked.groupBy("label").count().collect()} == {0: 100, 1: 100}
