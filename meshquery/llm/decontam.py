"""Benchmark decontamination over a distributed positional inverted index, with DataFrame functions only.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased.  The index holds postings: a term,
a document and a position.  Only terms of the test items are stored, and of these only what a search needs:

1. Every window of ``width`` consecutive item words (a shorter item is one window) ranks its terms by how often the
   training texts have them.
2. The rarest term's postings, moved back by its offset, give possible starts; those of the second rarest (a different
   term) are intersected with them.  Frequent terms' postings are used only by windows that have no rarer ones.
3. Each start left is confirmed against the document's own words, all of them.

:func:`phrases` returns exact matches (item, document, start, length) and :func:`proximity` near ones: all terms of a
window within ``slack`` more words, in any order.  :func:`contamination` gives every document's hit words.

Skew: the test side's terms and windows are counted first; up to a size they are broadcast, so the texts' words stay
where they are and only partial counts by term move.  Beyond it words are counted by term before they are joined, and
postings are joined by term, where adaptive execution splits frequent ones; starts always spread by document, window
and place.  Of equally rare terms the one that is less as text goes first.

Nulls: null texts have no words; a null doc_id or item_id is an id of its own.  Rows that repeat a doc_id are each
confirmed by their own words.  Texts of any length are searched whole.  Extra columns are ignored or (``keep_clean``)
kept.  Empty tables give empty or clean results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked, stash

WIDTH = 10
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """A text's words in order.  Only A-Z are folded, so the breaks are looked for after that."""
    return F.array_remove(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), BREAKS), "")


def windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """item_id, terms: every distinct window of every item."""
    d = items.select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (width - 1), F.lit(1)))
    return d.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i, F.lit(width)))).alias("terms")).distinct()


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, term, pos (from 0) of the given distinct terms: the index's lists."""
    d = docs.select("doc_id", F.posexplode(words(F.col("text"))).alias("pos", "term"))
    return d.join(checked(terms.select("term"), "term"), "term", "left_semi")


def count_terms(docs: DataFrame, vocabulary: DataFrame, most_bytes: int = 32 << 20) -> DataFrame:
    """term, n: how often the texts have each of the given distinct terms that they have."""
    every = docs.select(F.explode(words(F.col("text"))).alias("term"))
    wanted = checked(vocabulary, "term", most_bytes=most_bytes)
    n = F.count(F.lit(1)).alias("n")
    if wanted is vocabulary:  # too many to send: words are counted before they meet them
        return every.groupBy("term").agg(n).join(vocabulary, "term", "left_semi")
    return every.join(wanted, "term", "left_semi").groupBy("term").agg(n)


def _ranked(docs: DataFrame, items: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(windows: wid, terms, the two rarest terms and their offsets; items of each window: wid, item_id)."""
    of = stash(windows(items, width).withColumn("wid", F.xxhash64("terms")), "windows")
    once = of.select("wid", "terms").distinct()
    vocabulary = stash(of.select(F.explode("terms").alias("term")).distinct(), "vocabulary")
    counts = stash(count_terms(docs, vocabulary), "terms")
    each = once.select("wid", F.posexplode("terms").alias("offset", "term")).join(counts, "term")  # a window with an unseen term can't occur
    best = each.groupBy("wid").agg(F.sort_array(F.collect_list(F.struct("n", "term", "offset"))).alias("by"))
    best = once.join(best, "wid").where(F.size("by") == F.size("terms"))
    first = F.col("by")[0]
    other = F.filter("by", lambda x: x["term"] != first["term"])
    second = F.when(F.size(other) > 0, F.try_element_at(other, F.lit(1)))
    best = best.select("wid", "terms", first["term"].alias("a"), first["offset"].alias("a_at"), second["term"].alias("b"), second["offset"].alias("b_at"))
    return stash(best, "rarest"), of.select("wid", "item_id").distinct()


def _starts(docs: DataFrame, rarest: DataFrame) -> DataFrame:
    """doc_id, wid, start: where the two rarest terms stand as they should."""
    terms = rarest.select(F.col("a").alias("term")).union(rarest.where("b is not null").select(F.col("b").alias("term"))).distinct()
    index = stash(postings(docs, terms), "postings")
    def moved(side: str) -> DataFrame:
        of = rarest.where(F.col(side).isNotNull()).select(F.col(side).alias("term"), "wid", F.col(f"{side}_at").alias("at"))
        return index.join(checked(of, "term"), "term").select("doc_id", "wid", (F.col("pos") - F.col("at")).alias("start")).where("start >= 0")

    a, b = moved("a"), moved("b")
    sole = rarest.where("b is null").select("wid")
    alike = a.doc_id.eqNullSafe(b.doc_id) & (a.wid == b.wid) & (a.start == b.start)
    return a.join(b, alike, "left_semi").union(a.join(sole, "wid", "left_semi").select("doc_id", "wid", "start")).distinct()


def located(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """(docs with ``found``: the confirmed (start, n, wid) in each, and ``words``; items of each window)."""
    rarest, of = _ranked(docs, items, width)
    starts = _starts(docs, rarest).join(rarest.select("wid", "terms"), "wid")
    by_doc = starts.groupBy(F.col("doc_id").alias("id")).agg(F.collect_list(F.struct("start", "wid", "terms")).alias("maybe"))
    whole = docs.select(F.struct("*").alias("row"), "doc_id", F.col("text").alias("text"))
    d = whole.join(by_doc, whole.doc_id.eqNullSafe(by_doc.id), "left").select("row", "doc_id", "maybe", words(F.col("text")).alias("words"))
    own = F.col("words")
    sure = F.filter("maybe", lambda m: F.slice(own, m["start"] + 1, F.size(m["terms"])) == m["terms"])
    sure = F.transform(sure, lambda m: F.struct(m["start"].alias("start"), F.size(m["terms"]).alias("n"), m["wid"].alias("wid")))
    return d.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), F.sort_array(F.coalesce(sure, F.array().cast("array<struct<start:int,n:int,wid:bigint>>"))).alias("found")), of


def _hit() -> Column:
    """Words inside any match: a sweep over the sorted matches."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def step(a, m):
        stop = m["start"] + m["n"]
        return F.struct(F.greatest(a["end"], stop).alias("end"), (a["n"] + F.greatest(F.lit(0), stop - F.greatest(a["end"], m["start"]))).alias("n"))

    return F.aggregate("found", zero, step, lambda a: a["n"].cast("long"))


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted ids as strings) of every document."""
    d, of = located(docs.select("doc_id", "text"), items, width)
    d = stash(d.select("doc_id", "n_words", _hit().alias("n_hit"), F.array_distinct(F.transform("found", lambda m: m["wid"])).alias("wids")), "hits")
    hit = d.where(F.size("wids") > 0).withColumn("wids", F.sort_array("wids"))
    named = hit.select("wids").distinct().select("wids", F.explode("wids").alias("wid")).join(of, "wid")
    named = named.groupBy("wids").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    none = F.array().cast("array<string>").alias("items")
    cols = ("doc_id", "n_words", "n_hit")
    # documents without any match, most of them, join nothing
    found = d.where(F.size("wids") == 0).select(*cols, none).unionByName(hit.join(named, "wids").select(*cols, "items"))
    return found.select(*cols, F.size("items").cast("long").alias("n_items"), "items")


def phrases(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, item_id, start, n: every occurrence of every window."""
    d, of = located(docs.select("doc_id", "text"), items, width)
    return d.select("doc_id", F.explode("found").alias("m")).select("doc_id", "m.start", "m.n", "m.wid").join(of, "wid").select("doc_id", "item_id", "start", "n")


def proximity(docs: DataFrame, items: DataFrame, width: int = WIDTH, slack: int = 5) -> DataFrame:
    """doc_id, item_id, start: windows whose distinct terms all stand within ``width + slack`` words of a rarest one."""
    rarest, of = _ranked(docs, items, width)
    index = postings(docs, rarest.select(F.col("a").alias("term")).distinct())
    near = index.join(rarest.select(F.col("a").alias("term"), "wid", "terms"), "term").groupBy(F.col("doc_id").alias("id")).agg(F.collect_list(F.struct("pos", "wid", "terms")).alias("maybe"))
    d = docs.select("doc_id", words(F.col("text")).alias("words")).join(near, F.col("doc_id").eqNullSafe(F.col("id"))).withColumn("m", F.explode("maybe"))
    low = F.greatest(F.col("m.pos") - (width + slack - 1), F.lit(0))
    low = d.withColumn("start", F.explode(F.sequence(low, F.col("m.pos"))))
    held = low.where(F.size(F.array_except("m.terms", F.slice("words", F.col("start") + 1, F.lit(width + slack)))) == 0)
    held = held.groupBy("doc_id", F.col("m.wid").alias("wid"), F.col("m.pos").alias("pos")).agg(F.min("start").alias("start"))
    return held.join(of, "wid").select("doc_id", "item_id", "start").distinct()


def keep_clean(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` without any window of an item, with all their columns."""
    d, _ = located(docs, items, width)
    return d.where(F.size("found") == 0).select("row.*")
