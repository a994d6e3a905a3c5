"""Operators that look at all rows together, each against a plain version."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from meshquery.llm import common, decontam, jaccard, langid, lm, spandedup

DOCS = "doc_id long, text string, lang string, key string, token string, a string"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
VOCAB = [f"{a}{b}" for a in "ka lo mi ne su ta".split() for b in "r s t n l".split()]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "k", "t", "a") for i, t in rows], DOCS)


def fold(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def prose(rng, n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def shingles(t):
    w = SPACE.findall(fold(t))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def plain_components(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, y in itertools.combinations(range(len(rows)), 2):
        both = len(sets[x] & sets[y])
        if both and 100 * both >= 80 * len(sets[x] | sets[y]):
            up[top(x)] = top(y)
    least = {}
    for x, (i, _) in enumerate(rows):
        least[top(x)] = min(i, least.get(top(x), i))
    return sorted((i, len(sets[x]), least[top(x)] if sets[x] else i) for x, (i, _) in enumerate(rows))


AWKWARD = [(1, None), (2, ""), (3, " \n "), (4, "one two"), (5, "ONE two"), (6, "one"), (7, "x " * 3000), (8, "X " * 3000), (9, "é à"), (10, "É à")]


def mutated(rng, words, share):
    return " ".join(rng.choice(VOCAB) if rng.random() < share else w for w in words)


@pytest.mark.parametrize("seed", range(3))
def test_components_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    rows = list(AWKWARD)
    for k in range(6):  # clusters whose members are near and just not near, larger than a small tile
        base = prose(rng, rng.choice([12, 60, 150])).split()
        rows += [(100 + 40 * k + i, mutated(rng, base, rng.choice([0, 0.01, 0.02, 0.03, 0.045]))) for i in range(30)]
    passage = prose(rng, 40)
    rows += [(500 + i, f"{prose(rng, rng.choice([5, 30, 80]))} {passage} {prose(rng, 20)}") for i in range(40)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs(spark, rows).repartition(5)).collect())
    assert got == plain_components(rows)


@pytest.mark.parametrize("hot", [3, 20, 1 << 17])
def test_large_tiles_in_blocks_and_parts(spark, monkeypatch, hot):
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    monkeypatch.setattr(jaccard, "HOT_TILE", hot)
    rng = random.Random(9)
    base = prose(rng, 100).split()
    rows = [(i, mutated(rng, base, 0.03)) for i in range(70)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs(spark, rows)).collect())
    assert got == plain_components(rows)


def test_texts_are_shuffled_only_beside_each_other(spark, monkeypatch):
    """One row is chosen for a set by keys and row numbers, also where rows share a doc_id and a set."""
    plans, stash = {}, jaccard.stash
    monkeypatch.setattr(jaccard, "stash", lambda df, what: plans.update({what: df._jdf.queryExecution().executedPlan().toString()}) or stash(df, what))
    rng = random.Random(11)
    base = prose(rng, 100).split()
    rows = [(i % 9, mutated(rng, base, 0.01)) for i in range(30)]
    rows += rows[:12] + [(50 + i, rows[0][1]) for i in range(5)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs(spark, rows).repartition(5)).collect())
    assert got == plain_components(rows)
    assert "MapInArrow" in plans["texts-first"] and "hashpartitioning(key" not in plans["texts-first"]


@pytest.mark.parametrize("block", [7, 4096])
def test_all_links_of_large_groups(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(10)
    base = prose(rng, 120).split()
    rows = [*AWKWARD, *((100 + i, mutated(rng, base, rng.choice([0, 0.005, 0.01, 0.03]))) for i in range(40))]
    sets = {i: shingles(t) for i, t in rows}
    near = [(i, j) for i, j in itertools.combinations(sets, 2) if (both := len(sets[i] & sets[j])) and 100 * both >= 80 * len(sets[i] | sets[j])]
    many = Counter(i for pair in near for i in pair)
    assert max(many.values()) > 9
    got = {r.doc_id: r.n_links for r in jaccard.count_links(docs(spark, rows).repartition(3)).collect()}
    assert got == {i: many[i] for i in sets}
    found, links = jaccard.jaccard_links(docs(spark, rows))
    key = {r.doc_id: r.key for r in found.collect()}
    pairs = sorted(map(tuple, links.collect()))
    assert pairs == sorted({tuple(sorted((key[i], key[j]))) for i, j in near if key[i] != key[j]})


def test_sets_of_one_digest_are_told_apart(spark, monkeypatch):
    plain = jaccard.digest
    monkeypatch.setattr(jaccard, "digest", lambda s: (plain(s)[0] % 3, plain(s)[1]))  # first digests clash all the time
    rng = random.Random(21)
    rows = [*AWKWARD, *((100 + i, prose(rng, 30)) for i in range(12))]
    rows += [(200 + i, rows[-1 - i][1] + " ka") for i in range(5)] + [(300, rows[12][1])]
    # functions that go to workers by name are looked up there, so all rows are described here
    def local(self, f, schema):
        import pyarrow as pa

        table = self.toArrow()
        out = list(f(iter(table.to_batches())))
        names = [c.split()[0] for c in schema.split(", ")] if isinstance(schema, str) else schema.names
        rows = pa.Table.from_batches(out).to_pylist() if out else []
        return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)

    from pyspark.sql.classic.dataframe import DataFrame

    monkeypatch.setattr(DataFrame, "mapInArrow", local)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs(spark, rows)).collect())
    assert got == plain_components(rows)


def test_long_texts_are_read_in_segments(monkeypatch):
    texts = ["", "one", "a b  c\nd" * 40, "x" * 300, " " * 100, "é à " * 90, "end"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.r_[0, np.cumsum([len(t.encode()) for t in texts])]
    whole = common.word_hashes(raw, offsets)
    for size in (7, 50, 299, 1000):
        monkeypatch.setattr(common, "SEGMENT", size)
        assert all((a == b).all() for a, b in zip(whole, common.word_hashes(raw, offsets)))


def test_term_counts_without_a_broadcast(spark):
    d = docs(spark, [(1, "the cat the dog"), (2, "The end"), (3, None)])
    v = spark.createDataFrame([("the",), ("cat",), ("none",)], "term string")
    for most in (1 << 20, 1):
        assert sorted(map(tuple, decontam.count_terms(d, v, most).collect())) == [("cat", 1), ("the", 3)]


def test_keep_one_keeps_columns(spark):
    d = docs(spark, [*AWKWARD, (11, "x " * 3000)])
    out = jaccard.keep_one(d)
    assert out.columns == d.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 2, 3, 4, 6, 7, 9, 10]
    assert jaccard.jaccard_components(docs(spark, [])).count() == 0


def test_keep_one_keeps_one_row_of_repeated_ids(spark):
    rng = random.Random(14)
    a, b, c = (prose(rng, 60) for _ in range(3))
    rows = [(1, a), (1, a), (1, b), (2, b + " ka"), (2, c), (3, c + " ka"), (4, None), (4, ""), (None, a), (None, prose(rng, 30))]
    out = jaccard.keep_one(docs(spark, rows).repartition(3))
    assert out.columns == docs(spark, []).columns
    got = sorted((r.doc_id or 0, r.text or "") for r in out.collect())
    assert got == sorted([(1, a), (1, b), (2, c), (4, ""), (4, ""), (0, rows[-1][1])])


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    got = dict(map(tuple, common.components(spark.createDataFrame(edges, "a long, b long")).distinct().collect()))
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in (100, 101, 102)}


def test_few_edges_are_written_by_few_tasks(spark, monkeypatch):
    files, stash = [], common.stash
    monkeypatch.setattr(common, "stash", lambda df, what: files.append(len((out := stash(df, what)).inputFiles())) or out)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        edges = spark.createDataFrame([(i, i + 1) for i in range(500)], "a long, b long")
        got = common.components(edges).select("component").distinct().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [r.component for r in got] == [0]
    assert len(files) > 2 and max(files[1:]) <= spark.sparkContext.defaultParallelism


# --- decontamination -----------------------------------------------------------------------------------------


def items_of(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(text)) if w]


def plain_hits(rows, items):
    windows = {}
    for i, t in items:
        w = items_of(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    out = []
    for i, t in rows:
        w, hit, ids = items_of(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    ids |= windows[g]
        out.append((i or -1, len(w), len(hit), sorted(map(str, ids))))
    return sorted(out)


@pytest.mark.parametrize("seed", range(2))
def test_contamination_against_a_scan(spark, seed):
    rng = random.Random(seed)
    items = [(i, prose(rng, rng.choice([3, 9, 10, 14, 30]))) for i in range(25)] + [(90, None), (91, ""), (92, "the the the the the the the the the the the the"), (93, "Solo")]
    rows = [*AWKWARD, (None, items[4][1]), (50, "the " * 30), (51, "say solo, SOLO!"), (51, "again " + (items[0][1] or ""))]
    for i in range(60):
        t = prose(rng, rng.choice([0, 5, 60]))
        if rng.random() < 0.6:
            w = rng.choice(items[:25])[1].split()
            t += ". " + ", ".join(w[rng.randrange(len(w)) :] if rng.random() < 0.5 else w).upper() + " " + prose(rng, 4)
        rows.append((200 + i, t))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id or -1, r.n_words, r.n_hit, list(r["items"])) for r in decontam.contamination(docs(spark, rows), bench).collect())
    assert got == plain_hits(rows, items)
    kept = decontam.keep_clean(docs(spark, rows), bench)
    assert kept.columns == docs(spark, []).columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(i for i, _, n, _ in got if not n)


def test_phrases_proximity_and_empty_tables(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    d = docs(spark, [(1, "x alpha beta gamma delta y"), (2, "gamma x alpha y beta z delta"), (3, "alpha beta")])
    assert [tuple(r) for r in decontam.phrases(d, bench).collect()] == [(1, 1, 1, 4)]
    assert {r.doc_id for r in decontam.proximity(d, bench, 4, 4).collect()} == {1, 2}
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination(d, empty).where("n_hit > 0").count() == 0
    assert decontam.contamination(docs(spark, []), bench).count() == 0


# --- spans ---------------------------------------------------------------------------------------------------


def test_later_copies_of_a_passage_go(spark):
    rng = random.Random(3)
    sentence = lambda n: prose(rng, n).capitalize() + "."
    passage = " ".join(sentence(11) for _ in range(6))
    rows = [*AWKWARD[:3], (20, f"{sentence(9)} {passage} {sentence(8)}"), (21, f"{sentence(7)}\n{passage}\n{sentence(12)}"), (22, f"{passage}"), (23, " ".join(sentence(10) for _ in range(5))), (24, "No. " * 40)]
    table = " | ".join(prose(rng, 90).split())
    rows += [(30, f"{prose(rng, 20)} {table} {prose(rng, 9)}"), (31, f"{prose(rng, 33)} {table} {prose(rng, 5)}")]
    out = {r.doc_id: r for r in spandedup.remove_repeats(docs(spark, rows)).collect()}
    text = dict(rows)
    assert out[20].n_removed == 0 and out[20].text == text[20]
    assert passage[60:-60] not in out[21].text and out[21].n_removed >= 5 and out[21].text.startswith(text[21][:20])
    assert out[22].text == "" and out[23].n_removed == 0
    assert 0 < len(out[24].text) < len(text[24])
    assert out[30].n_removed == 0 and out[31].n_removed > 0 and len(out[31].text) < len(text[31]) / 2
    assert out[1].text == "" and out[1].n_sentences == 0


def left(spark, rows):
    return {r.doc_id: r.text for r in spandedup.remove_repeats(docs(spark, rows).repartition(3)).collect()}


def test_copies_with_short_last_sentences_and_short_copies_go(spark):
    rng = random.Random(4)
    sentence = lambda n: prose(rng, n).capitalize() + "."
    whole = " ".join(sentence(n) for n in (20, 10, 4))
    one, few = sentence(22), f"{sentence(3)} {sentence(5)}"
    out = left(spark, [(1, whole), (2, whole), (3, one), (4, one), (5, few), (6, few), (7, sentence(22)), (8, sentence(6)), (9, "Yes."), (10, "Yes.")])
    assert [out[i] for i in (2, 4, 6, 10)] == [""] * 4
    assert all(out[i] for i in (1, 3, 5, 7, 8, 9))


def test_passages_in_foreign_sentences_go_to_their_edges(spark):
    rng = random.Random(6)
    words = lambda n: [f"{rng.choice(VOCAB)}{rng.randrange(10**6)}" for _ in range(n)]
    passage = [*words(11), "stop.", *words(13), "stop.", *words(9), "stop.", *words(3), "end."]
    rows = [(1, " ".join([*words(30), *passage, *words(30)])), (2, " ".join(["So.", *passage, *words(5)])), (3, " ".join([*words(3), *passage]))]
    out = left(spark, rows)
    assert out[1] == rows[0][1]
    for i, foreign in ((2, {*rows[1][1].split()} - {*passage}), (3, {*rows[2][1].split()} - {*passage})):
        stay = [w for w in out[i].split() if w in passage]
        assert foreign <= {*out[i].split()} and len(stay) <= 11 and "end." not in stay


def test_spans_against_all_places(spark, monkeypatch):
    monkeypatch.setattr(spandedup, "SPAN_BLOCK", 50)
    rng = random.Random(12)
    lines = [prose(rng, rng.choice([2, 6, 9, 16])) + "." for _ in range(40)]
    rows = [(None, " ".join(lines[:6])), *((i // 2, " ".join(rng.choices(lines, k=rng.randrange(9)))) for i in range(60, 160))]
    seen, cuts = {}, []
    for i, t in rows:
        words = [w.lower() for w in t.split()]
        s = spandedup.Sentences(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))
        edge, n, found = s.word.tolist() if words else [0], len(s.begin), set()
        for a in range(n):
            found |= {(a, next((b for b in range(a + 2, n + 1) if edge[b] - edge[a] >= 15), None))}
            found |= {(next((b for b in range(a - 1, -1, -1) if edge[a + 1] - edge[b] >= 15), None), a + 1)}
        if n and (0, None) in found:
            found |= {(0, n)}
        found = {x for x in found if None not in x}
        cuts.append(found)
        for a, b in found:
            seen.setdefault(tuple(words[edge[a] : edge[b]]), []).append(((i is not None, i or 0, a), b - a))
    gone = {}
    for places in seen.values():
        for (known, i, a), n in places:
            if (known, i, a) != min(p for p, _ in places):
                gone.setdefault(i if known else None, set()).update(range(a, a + n))
    got = spandedup.remove_repeats(docs(spark, rows).repartition(3)).collect()
    assert len(got) == len(rows) and any(r.n_removed for r in got)
    for r in got:
        assert set(r.removed) == {k for k in gone.get(r.doc_id, ()) if k < r.n_sentences}


# --- language model and language -----------------------------------------------------------------------------


def test_scores_against_plain_counts(spark):
    rng = random.Random(5)
    pattern = ["the", "cat", "sat.", "on", "a", "mat,"]
    rows = [*AWKWARD] + [(100 + i, " ".join(pattern[(k + i) % 6] if rng.random() < 0.9 else rng.choice(VOCAB) for k in range(60))) for i in range(150)]
    out = {r.doc_id: r for r in lm.score(docs(spark, rows)).collect()}
    words = {i: [*SPACE.findall(fold(t)), None] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    c = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in words.items():
        assert out[i].held_out == held[i] and out[i].n_tokens == len(ws) and out[i].train_tokens == n
        assert out[i].n_known == sum(w in c for w in ws)
        assert out[i].base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
        assert out[i].score <= 0
    test = [r for i, r in out.items() if held[i] and i >= 100]
    assert sum(r.score for r in test) > sum(r.base_score for r in test) * 0.6
    assert lm.score(docs(spark, [])).count() == 0


def test_model_probabilities_sum_to_one():
    hot = [(100 + i, i % 5, 90 - i) for i in range(40)] + [(7, -1, 30)]
    lex = lm.Lexicon(hot, {-1: (30, 1), **{s: (500, 20) for s in range(5)}}, most_words=30, bins=6)
    assert lex.words == 30 and lex.bins > 1 and lex.start[-1] == 30
    m, rng = lm.LogBilinear(lex, 4), np.random.default_rng(1)
    word = lex.word[lex.word >= 0]
    for _ in range(20):
        w = rng.choice(word, 50)
        m.step(rng.integers(0, lex.outside + 1, 50), rng.integers(0, lex.outside + 1, 50), 1 + lm.SHAPES + np.searchsorted(lex.start, w, "right") - 1, w, rng)
    m.ready()
    for two, one in ((0, 3), (lex.outside, lex.outside), (31, 2)):
        cls = np.r_[np.arange(1 + lm.SHAPES), 1 + lm.SHAPES + np.searchsorted(lex.start, np.arange(30), "right") - 1]
        w = np.r_[np.full(1 + lm.SHAPES, -1), np.arange(30)]
        p = 10 ** m.log10(np.full(len(cls), two), np.full(len(cls), one), cls, w)
        assert p.sum() == pytest.approx(1.0, abs=1e-4)


def test_every_training_token_is_learned_from(monkeypatch):
    lex = lm.Lexicon([(5, 0, 9)], {-1: (30, 1), 0: (9, 1)})
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(997))) for i in range(60)]
    learned = [i for i, _ in rows if not lm.held_out(i, 7, 2)]
    seen = []
    monkeypatch.setattr(lm, "STEPS", (0, 0), raising=False)
    monkeypatch.setattr(lm.LogBilinear, "step", lambda self, two, one, cls, word, rng: seen.append(len(cls)))
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], ["doc_id", "text"])
    (out,) = lm._train(lex, 7, 2)([batch])
    assert sum(seen) == 998 * len(learned) == out.column("worth")[0].as_py()



def test_words_are_told_apart_by_their_contexts(spark):
    rng = random.Random(18)
    pairs = [("red", "apple"), ("big", "house"), ("old", "table"), ("new", "music")]  # words of one shape and count
    text = lambda: " ".join(f"{a} {b}" for a, b in rng.choices(pairs, k=40))
    rows = [(i, text()) for i in range(300)] + [(1000, "red apple big house " * 10), (1001, "red house big apple " * 10)]
    out = {r.doc_id: r for r in lm.score(docs(spark, rows).repartition(3)).collect()}
    assert out[1000].base_score == pytest.approx(out[1001].base_score)
    assert out[1000].score > out[1001].score + 10


def test_every_language_is_learned(spark):
    rng = random.Random(15)
    word = lambda k: "".join(chr(0x4E00 + 40 * k + rng.randrange(20)) for _ in range(3))
    rows = [(i, " ".join(word(i % 210) for _ in range(20)), f"l{i % 210:03}") for i in range(630)]
    rows += [(5000 + i, " ".join(word(300) for _ in range(20)), "k") for i in range(4)] + [(6000, " ".join(word(301) for _ in range(30)), "kk")]
    rows += [(7000, " ".join(word(302) for _ in range(5)), "many")] * 300
    from pyspark.sql import functions as F

    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(d, F.lit(True), sample=50, each=3)
    assert model.languages == sorted({k for _, _, k in rows})
    few = [("a", [1, 2], [1, 1])] * 79 + [("b", [3, 4], [1, 1])] * 80 + [("c", [5, 6], [1, 1])]
    model = langid.Model(["a", "b", "c"], few)
    assert (model.scores[5] + model.scores[6]).argmax() == 2 and (model.scores[5] + model.scores[6])[2] > 0.5  # the one text of c was learned


def test_language_of_held_out_texts(spark):
    rng = random.Random(8)
    parts = {"xx": ["sha", "the", "ing", "tion", "wh"], "yy": ["ção", "ñe", "lla", "dor", "ci"], "zz": ["sch", "ü", "ung", "ein", "ß"]}
    word = lambda k: "".join(rng.choice(parts[k]) for _ in range(rng.randint(1, 3)))
    rows = [(i, " ".join(word(k) for _ in range(rng.randint(4, 40))), k) for i, k in enumerate(rng.choices(list(parts), k=300))]
    rows += [(1000, None, "xx"), (1001, "", None), (1002, "123 !!", "yy"), (1003, "é", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    from pyspark.sql import functions as F

    out = {r.doc_id: r for r in langid.identify(d, langid.train(d, F.col("doc_id") % 3 != 1)).collect()}
    test = [(i, k) for i, _, k in rows[:300] if i % 3 == 1]
    assert sum(out[i].lang_pred == k for i, k in test) >= 0.97 * len(test)
    assert [out[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and out[1003].lang_pred in parts
    assert all(0 <= r.score <= 1 for r in out.values())
    assert langid.identify(d, langid.train(d, F.lit(False))).where("lang_pred <> 'und'").count() == 0
