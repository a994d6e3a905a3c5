"""Operators that judge rows one by one, each against a plain version."""

import html as H
import re
import zlib

import numpy as np
import pytest

from meshquery.llm import htmltext, packing, quality, secrets, urlfilter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, words string, bucket string"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, None, len(t or ""), "r", "w", "b") for i, t in rows], DOCS)


AWKWARD = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "x " * 9000), (6, "same text here."), (6, "same text here."), (None, "no id"), (7, "Ünï çödé 漢字 \U0001f600 end"), (8, "a\x00b <|endoftext|> c")]


# --- packing -------------------------------------------------------------------------------------------------


def test_ids_are_those_of_the_tokenizers_file():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [x or "" for _, x in AWKWARD] + ["it's  a\n\n test\t1234 don't", "ﬁ a" + " " * 300 + "b", "é" * 50, "a<|endoftext|><|endoftext|> b", "\r\n\r\n x"]
    for x in texts:
        assert packing.token_ids(x, packing.default_ranks()).tolist() == t.encode(x, add_special_tokens=False).ids


def test_pack_places_every_token_once(spark):
    out = packing.pack(docs(spark, AWKWARD)).collect()
    by_seq = {}
    for r in out:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    long = sorted((r.piece, r.start, r.length) for r in out if r.doc_id == 5)
    ids = np.append(packing.token_ids("x " * 9000, packing.default_ranks()), 0).astype("<u4")
    assert sum(n for _, _, n in long) == len(ids) and all(n == 2048 for _, _, n in long[1:])
    for r in out:
        if r.doc_id == 5:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert [r.length for r in out if r.doc_id == 1] == [1]
    assert len([r for r in out if r.doc_id == 6]) == 2
    assert packing.pack(docs(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_close_to_the_least(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 60, 400) if seed % 2 else rng.choice([50, 34, 26, 17, 9], 300)
    counts = dict(zip(*np.unique(sizes, return_counts=True)))
    p = packing.Plan({int(k): int(v) for k, v in counts.items()}, 100)
    fill, used = {}, {}
    for size, rank, n, seq, offset in p.rows:
        used.setdefault(size, []).extend(range(rank, rank + n))
        for k in range(n):
            fill.setdefault(seq + k, []).append((offset, size))
    assert {k: len(v) for k, v in used.items()} == {int(k): int(v) for k, v in counts.items()}
    assert all(sorted(v) == list(range(len(v))) for v in used.values())
    for places in fill.values():
        at = 0
        for offset, size in sorted(places):
            assert offset == at
            at += size
        assert at <= 100
    assert p.sequences <= np.ceil(sizes.sum() / 100 * 1.06) + 1 and p.fixed > 0


# --- url filters ---------------------------------------------------------------------------------------------

RULES = [("com/en/", False), ("example.com/en/7", True), ("net/de/", True), ("example.net/de/8", False), ("org/es/", False)]
URLS = ["http://a.Example.COM/en/77?x", "https://com/en/", "http://xcom/en/1", "http://example.com/en/7#t", "http://b.example.net/de/81", "http://example.net/de/9", "x.org/es/1", None, "", "http://", "http://h?q", "ftp://org/es", "http://a.org/es/é/1", "a://b://com/en/"]


def plain_judge(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for rule, ok in RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = rule, ok
    return host, path, best and best[0], ("allow" if best[1] else "block") if best else "allow"


@pytest.mark.parametrize("most_bytes", [1 << 20, 60])
def test_urls_against_all_rules(spark, most_bytes):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").selectExpr("*", "'x' as host", "'y' as rule")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge_urls(pages, RULES, most_bytes=most_bytes).collect()}
    assert got == {i: plain_judge(u) for i, u in enumerate(URLS)}


def test_rules_of_two_queries_are_not_mixed_up(spark):
    pages = spark.createDataFrame([(1, "http://a/x"), (1, "http://a/x"), (None, "http://a/" + "x" * 100_000)], "page_id long, url string")
    for rules, want in (([("a/x", False)], "block"), ([("a/x", True)], "allow"), ([("a/x", False)], "block"), ([], "allow")):
        assert [r.verdict for r in urlfilter.judge_urls(pages, rules).collect()] == [want] * 3
    assert urlfilter.judge_urls(spark.createDataFrame([], pages.schema), RULES).count() == 0
    assert [r.verdict for r in urlfilter.judge_urls(pages, [("a/x", False), ("a/x", True)]).collect()] == ["allow"] * 3


def test_colliding_keys_are_told_apart(monkeypatch):
    monkeypatch.setattr(urlfilter.xxhash, "xxh64_intdigest", lambda b: 5)
    found = urlfilter.DigestArray(urlfilter.image([("a/x", True), ("b/x", False)]))
    assert found.judge([("b", "/x"), ("a", "/x"), ("c", "/x")]) == [("b/x", False), ("a/x", True), (None, None)]


# --- html ----------------------------------------------------------------------------------------------------


def test_article_without_its_surroundings():
    page = """<html><head><title>T</title><script>var a="</p>";</script><style>p{}</style></head><body><nav><ul><li><a href=/>Home</a></ul></nav>
    <div class="cookie-notice">We use cookies to give you the best of the web and this is long enough to look like text.</div><article><h1>Big &amp; small</h1>
    <p>First <b>para</b>graph of the text that is here for you and for me to read in the morning.<p>Short.</p><!-- x --><aside>Related: the things that you may want to read of this and that in the week</aside>
    <form><input value=x>Sign up for the letter</form><p>Last one&hellip;</p></article><div id="comments"><p>I was the first to comment on this and it is the best of all the comments.</p></div><footer>&copy; all</footer></body></html>"""
    assert htmltext.main_text(page) == "Big & small First paragraph of the text that is here for you and for me to read in the morning. Short. Last one…"


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<!--", "plain", "<p>\x00</p>", "</div></div>", "<script>never closed", "<a href='x"])
def test_broken_pages_do_not_crash(page):
    assert isinstance(htmltext.main_text(page), str)


def test_neighbours_decide_short_blocks_outside_an_article():
    long = "This is a long block of text that has the words which are of use to us and it is here for the test."
    links = '<div><a href="/">one</a> <a href="/">two</a></div>'
    assert htmltext.main_text(f"<p>{long}</p><p>Short.</p><p>More.</p>{links}<p>Tiny</p>{links}") == f"{long} Short."


LONG = "This is a long block of text that has the words which are of use to us and it is here for the test."


@pytest.mark.parametrize("name", ["content has-sidebar", "post no-comments", "entry with-share", "td-main related-layout", "widget", "page-sidebar wide"])
def test_named_containers_do_not_overrule_their_article(name):
    assert htmltext.main_text(f'<div class="{name}"><article><p>{LONG}</p><div class="share"><p>{LONG}</p></div></article></div>') == LONG
    assert htmltext.main_text(f'<div class="{name}"><main><p>Short.</p></main></div>') == "Short."


def test_comments_and_adverts_stay_out():
    assert htmltext.main_text(f'<article><p>One.</p></article><div id="comments"><article><p>{LONG}</p></article></div>') == "One."
    assert htmltext.main_text(f'<article><p>One.</p><article class="comment"><p>{LONG}</p></article></article>') == "One."
    assert htmltext.main_text(f'<p>{LONG} <span class="advert">Buy <b>now</b></span> more <span class="name">text</span></p>') == f"{LONG} more text"
    assert htmltext.main_text(f'<div class="sidebar"><p>{LONG}</p></div><div class="no-comments"><p>{LONG}</p></div>') == LONG


def test_text_that_looks_like_tags_is_kept():
    assert htmltext.main_text(f"<3 {LONG}") == f"<3 {LONG}" and htmltext.main_text(f"<article>1 < 2 and <{LONG}") == "1 < 2 and"
    assert htmltext.main_text(f'<article><p title="a>b">{LONG}</p><p title=">x</p><p>y</p></article>') == f"{LONG} x y"


RUSSIAN = "Вода в реке была холодной, и мы долго стояли на берегу. Потом он сказал, что пора идти домой."


def test_articles_in_forms_and_beside_names_of_other_meaning():
    assert htmltext.main_text(f"<form><label>Search the site</label><article><p>{LONG}</p><p>Short.</p></article></form>") == f"{LONG} Short."
    assert htmltext.main_text(f"<article><p>{LONG}</p><form><p>{LONG}</p></form></article><form><p>{LONG}</p></form>") == LONG
    for name in ("market-share", "legal-news", "header-story", "notice-2-everyone"):
        assert htmltext.main_text(f'<div class="{name}"><p>{LONG}</p></div>') == LONG
    for name in ("share", "share-buttons", "site-header", "legal-notice", "related-posts", "cookie-story", "social-share-2"):
        assert htmltext.main_text(f'<div class="{name}"><p>{LONG}</p></div><p>{LONG}!</p>') == f"{LONG}!"


def test_linked_paragraphs_and_headings_of_an_article():
    assert htmltext.main_text(f'<article><h1><a href="/x">Title</a></h1><p><a href="/">{LONG}</a></p><p>Short.</p><p><a href="/">More</a></p></article>') == f"Title {LONG} Short."
    assert htmltext.main_text(f'<h2><a href="/x">Title</a></h2><p><a href="/">{LONG}</a></p><p>{LONG}!</p>') == f"{LONG}!"


def test_languages_without_listed_stop_words():
    assert htmltext.main_text(f'<div><a href="/">Домой</a></div><p>{RUSSIAN}</p><div class="sidebar"><p>{RUSSIAN}</p></div><p><a href="/">{RUSSIAN}</a></p>') == RUSSIAN
    chinese = "我们在河边站了很久。" * 8
    assert htmltext.main_text(f"<p>{chinese}</p>") == chinese
    assert htmltext.main_text(f"<p>{LONG}</p><div><a href='/'>x</a></div><p>{'Item 123, ' * 20}</p><div><a href='/'>x</a></div>") == LONG
    assert htmltext.main_text(f"<p>{'Item 123, ' * 20}</p>") == ""


@pytest.mark.parametrize("page", ['<div class="comments">' * 30_000 + "<article></article>" * 30_000, "<a " * 300_000 + '"', '<p class="' * 90_000, "<div><b class=x>" * 30_000 + "</i></u>" * 60_000, "<!--" * 200_000, "<script>" * 120_000, '<div class="ad">' * 30_000 + "<article>" * 50_000, "<" * 900_000])
def test_hostile_pages_take_linear_time(page):
    import time

    begin = time.process_time()
    htmltext.main_text(page)
    assert time.process_time() - begin < 2


def test_generated_pages_give_the_article_that_was_put_in(spark):
    rng = np.random.default_rng(5)
    words = "the of and to in is that for it was with house river stone light paper music garden winter".split()
    prose = lambda n: " ".join(rng.choice(words, n)).capitalize() + "."
    rows, want = [], {}
    for i in range(120):
        paragraphs = [prose(int(n)) for n in rng.integers(2, 60, int(rng.integers(1, 7)))]
        body = "".join(rng.choice(["<p>{}</p>", "<p>{}", "<div><p>{}</p></div>", "<h2>{}</h2>"]).format(p.replace(" of ", " <i>of</i> ").replace(" and ", "\n\t &#97;nd ")) for p in paragraphs)
        junk = [
            f"<nav><ul><li><a href=/>{prose(3)}</a><li>{prose(30)}</ul></nav>", f"<aside>{prose(40)}</aside>", f'<div class="cookie-notice"><p>{prose(40)}</p></div>', f"<script>var a = '<p>{prose(20)}</p>';</script>",
            f"<form>{prose(30)}</form>", f"<!-- {prose(20)} -->", f'<section id="comments"><p>{prose(50)}</p></section>', f"<footer><p>{prose(30)}</p></footer>", f'<div class="ads">{prose(30)}</div>',
        ]
        some = [junk[k] for k in rng.permutation(len(junk))]
        k, m = sorted(rng.integers(0, len(junk) + 1, 2).tolist())
        tag = rng.choice(["article", "main"])
        rows.append((i, f"http://x/{i}", f"<html><head><title>{prose(8)}</title></head><body>{''.join(some[:k])}<{tag}>{body}{some[k] if k < m else ''}</{tag}>{''.join(some[m:])}"))
        want[i] = " ".join(paragraphs)
    got = {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want
    assert htmltext.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_extract_keeps_every_page(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "u", "<article><p>hi</p></article>"), (2, "u", "<article><p>hi</p></article>")], "page_id long, url string, html string").selectExpr("*", "1 as text")
    rows = sorted(map(tuple, htmltext.extract(pages).collect()), key=str)
    assert rows == [(1, None, "", 0), (2, "u", "hi", 2), (2, "u", "hi", 2)]
    assert H.unescape("&amp;") == "&"


# --- secrets -------------------------------------------------------------------------------------------------


def test_base_spans_and_novel_ones(spark):
    hexes = "0123456789abcdef" * 2
    text = f"Secret='abc' PASSWORD = \"longer-value\" AKIA{'Q' * 16} {hexes} the private_key is Zx93kQmPq0LrT7vBn2Ws8Yd1 ok"
    base, every = secrets.spans_of(text)
    assert [k for _, _, k in base] == ["assign", "access", "hex"]
    assert [k for _, _, k in every] == ["assign", "access", "hex", "novel"]
    assert all(text[a:b].strip() for a, b, _ in every)
    masked = secrets.masked(text)
    assert "longer-value" not in masked and hexes not in masked and "Zx93" not in masked and masked.endswith(" ok")
    out = {r.doc_id: r for r in secrets.scan(docs(spark, [*AWKWARD, (9, "é" + text)])).collect()}
    assert out[9].n_assign == 1 and out[9].spans.startswith("assign:")
    assert out[9].spans.split(",")[0] == f"assign:{base[0][0] + 1}:{base[0][1] + 1}"
    assert out[1].spans == "" and len(out) == len({i for i, _ in AWKWARD}) + 1


def plain_base(text):
    """Each pattern tried at each place, the first that fits taken whole."""
    out = []
    for kind, pattern, least in (("assign", secrets.ASSIGN, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 20), ("hex", re.compile("[0-9a-f]+"), 24)):
        at = 0
        while at < len(text):
            m = pattern.match(text, at)
            if m and len(m[2] if kind == "assign" else m[0]) >= least:
                out.append((m.start(), m.end(), kind))
            at = m.end() if m else at + 1
    return sorted(out, key=lambda s: (s[0], ["assign", "access", "hex"].index(s[2])))


def test_base_spans_against_every_place():
    rng = np.random.default_rng(4)
    bits = ["password", "PASSWD", "secret", "token", "api_key", "apikey", '"', "'", " ", "  ", ":", "=", "abc", "abcdef012", "AKIA", "Q" * 16, "0123456789abcdef" * 2, "é", "\n", ".", "K"]
    for _ in range(400):
        text = "".join(rng.choice(bits, int(rng.integers(1, 25))))
        assert secrets.base_spans(text) == plain_base(text), text


def test_keys_of_any_kind_are_found_on_both_sides_and_words_are_not():
    rng = np.random.default_rng(6)
    prose = "this is how the service is called by all who have it and the others wait for the answer of the server"
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"]
    hit = total = 0
    for alphabet in alphabets:
        for size in (16, 24, 40, 88):
            for _ in range(20):
                key = "".join(rng.choice(list(alphabet), size))
                for text in (f"{prose} the api key is {key} {prose}", f"{prose} use {key} as your secret {prose}"):
                    base, every = secrets.spans_of(text)
                    total += 1
                    hit += any(text[a:b] == key for a, b, _ in every)
    assert hit >= 0.95 * total, hit / total
    for t in ("the secret is in abcdefghijklmnopqrstuvwxyz here", "password rules: configurationimplementation twice", "token " + "ab1" * 20, f"secret {prose.replace(' ', '_')} {prose}", "token aaaaaaaaaaaaaaaaaaaaaaaa"):
        assert not [s for s in secrets.spans_of(t)[1] if s[2] == "novel"], t


def test_identifiers_are_learned_but_not_copied_keys(spark):
    key, name = "kJ8sQz0pLm3xVt7RwYb2", "zorkelblattifier_factory"
    rows = [(i, f"word{i} {name} the token is here {key} in all the copies") for i in range(30)]
    learned = secrets.learn(docs(spark, [*AWKWARD, *rows])).decode().split()
    assert name in learned and key not in learned
    assert secrets.learn(docs(spark, [])) == b"" and len(secrets.learn(docs(spark, rows), most_bytes=30)) <= 30
    text = f"the secret {name} is {key} now"
    assert [text[a:b] for a, b, k in secrets.spans_of(text, name.encode())[1] if k == "novel"] == [key]


def test_long_texts_are_scanned_in_linear_time(spark):
    import time

    for text in ("token" * 60_000, "secret " + "Zk3" * 100_000, "password = " * 30_000, "a token " * 40_000, ("x" * 15 + " ") * 20_000 + "token"):
        begin = time.process_time()
        secrets.spans_of(text)
        assert time.process_time() - begin < 5, text[:20]
    rows = [(1, "the secret is Zx93kQmPq0LrT7vBn2Ws8Yd1 ok")] * 2
    assert len({r.spans for r in secrets.scan(docs(spark, rows)).collect()}) == 1
    assert secrets.scan(docs(spark, [])).count() == 0 and secrets.redact(docs(spark, [])).count() == 0


def test_redact_keeps_columns(spark):
    d = docs(spark, [*AWKWARD, (9, "x password=hunter22 y")])
    out = secrets.redact(d)
    assert out.columns == d.columns and out.count() == d.count()
    row = out.where("doc_id = 9").first()
    assert row.text == "x [assign] y" and row.n_chars == len(row.text)


# --- quality -------------------------------------------------------------------------------------------------


def plain_counts(text):
    s = text or ""
    w = SPACE.findall(s)
    win = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    cov = {j for i, k in enumerate(win) if win.count(k) > 1 for j in range(i, i + 8)}
    lines = [x for x in s.split("\n") if SPACE.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", s)), len(lines) - len(set(lines)), len(cov)


def test_counts_against_plain_ones(spark):
    rows = [*AWKWARD[:4], *AWKWARD[5:], (20, "a b c d e f g h i " * 3 + "z"), (21, "l one\nl one\n\n x\nl one"), (22, "a b c d e f g h"), (23, "# $ % | & < > *"), (24, "w " * 40)]
    got = sorted((r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.judge(docs(spark, rows)).collect())
    assert got == sorted((i or 0, *plain_counts(t)) for i, t in rows)


def test_keep_good_drops_junk_and_keeps_columns(spark):
    good = [(i, " ".join(f"the w{i}x{k} of and to in is y{k * i % 97}" for k in range(12)) + ".") for i in range(60)]
    junk = [(100 + i, " ".join(f"w{k}{i}$$$" for k in range(80))) for i in range(12)] + [(200, "short text")]
    d = docs(spark, good + junk)
    out = quality.keep_good(d)
    assert out.columns == d.columns
    assert {r.doc_id for r in out.collect()} == {i for i, _ in good}
    assert quality.keep_good(docs(spark, [])).count() == 0


def plain_em(patterns, rules):
    """The same model with arrays: share of good, and each rule's chance to say good of good and bad texts."""
    votes, n = np.array(list(patterns)), np.array(list(patterns.values()), float)
    good, a = 0.8, np.array([[0.7] * rules, [0.975] * rules])
    for _ in range(2000):
        log = np.log([1 - good, good])[:, None] + np.array([((votes == 1) * np.log(a[k]) + (votes == -1) * np.log(1 - a[k])).sum(axis=1) for k in (0, 1)])
        post = 1 / (1 + np.exp(log[0] - log[1]))
        good = ((n * post).sum() + 1) / (n.sum() + 2)
        a = np.array([(((n * w)[:, None] * (votes == 1)).sum(axis=0) + 1) / (((n * w)[:, None] * (votes != 0)).sum(axis=0) + 2) for w in (1 - post, post)])
    return dict(zip(patterns, post))


def test_em_learns_from_agreement():
    patterns = {(1, 1, 1): 900, (-1, -1, 1): 60, (-1, -1, -1): 30, (1, 1, -1): 10, (0, 1, 1): 40, (0, -1, 0): 9, (0, 0, 0): 5}
    votes = quality.Votes(["a", "b", "c"]).fit(patterns)
    assert votes.posterior((1, 1, 1)) > 0.9 and votes.posterior((-1, -1, 1)) < 0.1
    assert abs(votes.weight("a", -1)) > abs(votes.weight("c", -1))
    assert all(y >= x - 1e-9 * abs(x) for x, y in zip(votes.trace, votes.trace[1:])) and len(votes.trace) > 3
    for p, want in plain_em(patterns, 3).items():
        assert votes.posterior(p) == pytest.approx(want, abs=1e-3)
    assert votes.posterior((0, 0, 0)) == pytest.approx(votes.good)


def test_verdicts_are_the_posteriors_of_a_plain_version(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["the", "of", "w1", "w2", "x9", "$$", "UP"], size=int(rng.integers(5, 120)))) for _ in range(150)]
    d = docs(spark, [*AWKWARD, *((100 + i, t) for i, t in enumerate(texts))])
    counts = quality.counted(d.selectExpr("doc_id as row", "text"))
    rows = counts.select("row", "n_words", "n_repeat_words", *[v.alias(k) for k, v in quality.rules().items()]).collect()
    patterns = {}
    for r in rows:
        patterns[tuple(r)[3:]] = patterns.get(tuple(r)[3:], 0) + 1
    post = plain_em(patterns, len(quality.rules()))
    got = sorted((r.doc_id or 0, r.kept, round(r.p_good, 2)) for r in quality.judge(d).collect())
    assert got == sorted((r.row or 0, bool(not (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and post[tuple(r)[3:]] >= 0.5), round(float(post[tuple(r)[3:]]), 2)) for r in rows)
    assert quality.judge(docs(spark, [])).count() == 0


def test_a_key_that_stands_everywhere_is_still_reported(spark):
    key, parts = "q7Zp2Wk9Xv4Rt8Lm3Bn6", "q7Zp2Wk9/Xv4Rt8Lm+3Bn6Ys5D"
    texts = [f"{word} {k} is the credential of {word}" for word in ("alpha", "beta", "gamma", "delta", "omega") for k in (key, parts, "configuration_environment_value")]
    learned = secrets.learn(docs(spark, list(enumerate(texts)))).decode().split()
    assert not {key, parts, "q7Zp2Wk9", "Xv4Rt8Lm"} & set(learned) and "credential" in learned
    spans = {r.doc_id: r.spans for r in secrets.scan(docs(spark, list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        assert ("novel:" in spans[i]) == (key in text or parts in text)
    edge = "x" * 195 + " secret " + "y" * 185 + " " + key  # cut where the surroundings end
    assert not any(key.startswith(w) for w in secrets.learn(docs(spark, [(i, f"{w}{edge}") for i, w in enumerate("abcdef")])).decode().split())
