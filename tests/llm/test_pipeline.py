"""The pipeline's stages in turn against plain versions of them."""

import random
import re

import corpus_pipeline
from meshquery.llm import decontam, packing, quality, secrets
from tests.llm.test_corpus_operators import plain_components, plain_hits, prose

COLS = "doc_id long, text string, lang string, source string, n_chars long"


def test_run_against_plain_stages(spark, tmp_path):
    rng = random.Random(1)
    the = lambda n: " ".join(f"{w} {rng.choice(['the', 'of', 'and', 'to', 'in', 'is', 'for'])}" for w in prose(rng, n).split()) + "."
    rows = [(i + 1, the(rng.randint(15, 60))) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(5)] + [(110, "$$$ " * 60), (111, "few words"), (112, None), (113, rows[9][1] + " password=hunter2222")]
    item = prose(rng, 25)
    rows += [(120, f"{the(30)} {item} {the(20)}")]
    folder = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    got = corpus_pipeline.run(spark, folder).collect()

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    left = [(i, t) for i, t in rows if i in kept]
    left = [(i, t) for (i, t), (j, _, c) in zip(sorted(left), plain_components(sorted(left))) if i == c]
    hits = {i: n for i, _, n, _ in plain_hits(left, [(1, item)])}
    left = [(i, secrets.masked(t)) for i, t in left if not hits[i]]
    assert 110 not in kept and 111 not in kept and 120 in kept and 120 not in dict(left)
    assert {r.doc_id for r in got} == set(dict(left))
    size = {i: len(packing.token_ids(t, packing.default_ranks())) + 1 for i, t in left}
    total = {}
    for r in got:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == size
    assert not re.search("hunter2222", " ".join(t for _, t in left))
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES][-1] == "best_fit_packing"
    assert decontam.WIDTH == 10
