"""Filter interaction audit: what each of several filters removes, in every order in which they could be applied.

Every document gets a mask with a bit for each filter that it fails.  All figures for all orders follow from the number
of documents with each mask, so texts are read once for the filters, whatever the number of orders.

The duplicate filter (identical to the text of a smaller doc_id) is found by partition refinement.  Documents are first
split by their length in code points, then class by class by the hash of their first block, their second and so on;
whoever is alone in its class drops out before the next split.  Blocks grow eightfold (64, 512, 4096 ... code points),
so a text of any length is split a few times only, over rows that hold hashes and no text.  The full texts of those that
are left are compared (a grouping by class and text, which copies leave as one row of each task), so that a hash that
two texts share only costs a comparison.  In a class all but the smallest id are marked.

Scale: a class of copies can hold a third of all rows.  Classes are counted with partial sums.  Rows find their class
through the few classes that have a thousandth of all rows or more (at most a thousand, so they are broadcast) and through
a join by key for all others, broadcast if it is small.

Nulls: a null text is empty; a null part counts as the part ``''``; a row without doc_id is counted, but is no one's
smaller id, is never a duplicate and has no labels.  Empty texts are equal texts like any other.  Repeated rows of one
doc_id are no duplicates of each other, as neither id is smaller; each is counted.  A document has a label if any of its
rows in ``labels`` has it; null labels don't count.  Ties don't arise.  Extra columns are ignored.  Without documents
there are no parts and no rows.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked, discard, stash

SPACE = r"[\x20\x09-\x0D]+"
FIRST_BLOCK, GROWTH = 64, 8
STARTS = [1 + FIRST_BLOCK * (GROWTH**k - 1) // (GROWTH - 1) for k in range(10)]  # up to 2 ** 31 code points, more than a text can have
HOT = 1000  # a class with this share of all rows is joined by broadcast; there are no more such classes than this

#: A filter's name and when a document fails it; None: it repeats the text of a smaller doc_id
Filters = dict[str, Column | None]


def standard_filters() -> Filters:
    """Few words, few different words, many capitals, markup characters, duplicates."""
    return {
        "A": F.col("n_words") < 50,
        "B": 100 * F.col("n_distinct") < 65 * F.col("n_words"),
        "C": 100 * F.col("n_upper") > 5 * F.col("n_chars"),
        "D": F.col("text").rlike(r"[#$%&*|]"),
        "E": None,
    }


def _block_hashes(text: Column, size: Column) -> Column:
    """Hashes of a text's blocks in order, the last one short."""
    starts = F.filter(F.array(*[F.lit(s) for s in STARTS]), lambda s: s <= size)
    return F.transform(starts, lambda s: F.xxhash64(F.substring(text, s, (s - 1) * (GROWTH - 1) + FIRST_BLOCK)))


def measured(docs: DataFrame, part: str) -> DataFrame:
    """doc_id, part, text, what the filters look at, and ``blocks``, the hashes of the text's blocks."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words = F.array_remove(F.split("text", SPACE), "")
    d = d.withColumn("words", words).withColumn("n_chars", F.char_length("text"))
    return d.select(
        "doc_id", "part", "text", "n_chars",
        F.size("words").alias("n_words"), F.size(F.array_distinct("words")).alias("n_distinct"),
        F.char_length(F.regexp_replace("text", "[^A-Z]+", "")).alias("n_upper"),
        _block_hashes(F.col("text"), F.col("n_chars")).alias("blocks"),
    )


def _in_classes(rows: DataFrame, classes: DataFrame, total: int, how: str) -> DataFrame:
    """``rows`` joined with ``classes`` (key, n and more) by key; no task gets a large class whole."""
    hot = classes.where(F.col("n") * HOT > total)
    cold = classes.where(F.col("n") * HOT <= total)
    few = F.broadcast(hot)
    rest = rows.join(F.broadcast(hot.select("key")), "key", "left_anti")
    return rows.join(few, "key", how).unionByName(rest.join(checked(cold), "key", how))


def _finest(size: Column, blocks: Column) -> Column:
    """The key of a text's class after its last split."""
    return F.aggregate(blocks, F.xxhash64(size), lambda key, b: F.xxhash64(key, b))


def survivors(rows: DataFrame, total: int) -> DataFrame:
    """doc_id, key of those that share their length and all block hashes with another row.  ``rows``: doc_id, n_chars, blocks; stashed."""
    alive = rows.where("doc_id IS NOT NULL").withColumn("key", F.xxhash64("n_chars"))
    splits = rows.agg(F.max(F.size("blocks"))).first()[0] or 0
    made: DataFrame | None = None
    for k in range(splits + 1):
        classes = stash(alive.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "classes")
        left = _in_classes(alive, classes, total, "inner").drop("n")
        if k < splits:  # texts without a further block keep their class; their length tells them apart from all others
            left = left.withColumn("key", F.when(F.size("blocks") > k, F.xxhash64("key", F.get("blocks", F.lit(k)))).otherwise(F.col("key")))
        left = stash(left, "alive")
        discard(classes, *([made] if made else []))
        alive = made = left
        if alive.isEmpty():
            break
    out = stash(alive.select("doc_id", "key").distinct(), "survivors")
    if made:
        discard(made)
    return out


def repeats(docs: DataFrame, rows: DataFrame, total: int) -> DataFrame:
    """doc_id, key of every row whose text is that of a smaller doc_id.

    ``docs``: doc_id, text; ``rows``: doc_id, n_chars and blocks of the same rows, stashed.
    """
    left = survivors(rows, total)
    size = F.char_length("text")
    texts = docs.select("doc_id", "text").withColumn("key", _finest(size, _block_hashes(F.col("text"), size)))
    texts = texts.join(checked(left), ["doc_id", "key"], "left_semi")
    groups = texts.groupBy("key", "text").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    unlike = groups.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.min("least").alias("least"))
    unlike = stash(unlike.where("n > 1"), "groups")
    mark = _in_classes(left, unlike.where("k = 1").drop("k"), total, "inner").where("doc_id > least").select("doc_id", "key")
    mixed = unlike.where("k > 1").select("key")
    if not mixed.isEmpty():  # hashes shared by unlike texts: the texts themselves decide
        groups = groups.join(checked(mixed), "key", "left_semi").select("key", "text", "least")
        mark = mark.unionByName(texts.join(groups, ["key", "text"]).where("doc_id > least").select("doc_id", "key"))
    out = stash(mark.distinct(), "repeats")
    discard(left, unlike)
    return out


def masks(docs: DataFrame, filters: Filters | None = None, part: str = "source") -> DataFrame:
    """doc_id, part and mask of every row; bit k is set where it fails the k-th filter.  Stashed."""
    named = filters or standard_filters()
    bits = [F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(named.values()) if fails is not None]
    plain = sum((F.coalesce(b, F.lit(0)) for b in bits), F.lit(0))
    rows = stash(measured(docs, part).select("doc_id", "part", "n_chars", "blocks", plain.alias("mask")), "measured")
    twice = [k for k, fails in enumerate(named.values()) if fails is None]
    if len(twice) > 1:
        raise ValueError("one duplicate filter at most")
    if not twice:
        return rows.select("doc_id", "part", "mask")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    marked = repeats(texts, rows, rows.count())
    keyed = rows.withColumn("key", _finest(F.col("n_chars"), F.col("blocks"))).join(checked(marked.withColumn("again", F.lit(1 << twice[0]))), ["doc_id", "key"], "left")
    out = stash(keyed.select("doc_id", "part", (F.col("mask") + F.coalesce("again", F.lit(0))).alias("mask")), "masks")
    discard(rows, marked)
    return out


def counts(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask and how many documents have it: n, and good and toxic ones of ``labels`` (doc_id, quality, toxic)."""
    said = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    said = said.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    d = masked.join(checked(said), "doc_id", "left")
    return d.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")])


def audit(docs: DataFrame, labels: DataFrame, filters: Filters | None = None, part: str = "source") -> DataFrame:
    """part, filter_order, step and the counts of each step of every order of the filters.

    ``filters``: at most six, each named by one letter; one of them may be None, the duplicate filter.
    """
    names = list(filters or standard_filters())
    if len(names) > 6 or any(len(n) != 1 for n in names):
        raise ValueError("at most six filters, named by one letter each")
    found = counts(masks(docs, filters, part), labels)
    # what a step counts depends on its filter and on the set of those before it, not on their order
    places = [(own, before) for own in range(len(names)) for before in range(1 << len(names)) if not before >> own & 1]
    own, before = F.col("at.own"), F.col("at.before")
    d = found.select("*", F.explode(F.array(*[F.struct(F.lit(o).alias("own"), F.lit(b).alias("before")) for o, b in places])).alias("at"))
    bit = F.expr("shiftright(mask, at.own) & 1") == 1
    passed = F.expr("mask & at.before") == 0
    first = F.expr("bit_count(mask)")

    def total(what: Column, n: str = "n") -> Column:
        return F.sum(F.when(what, F.col(n)).otherwise(0)).cast("long")

    d = d.groupBy("part", own.alias("own"), before.alias("before")).agg(
        total(passed & ~bit).alias("kept"), total(passed & bit).alias("removed"), total(~passed & bit).alias("redundant"), total(bit & (first == 1)).alias("unique_fails"),
        total(passed & bit, "good").alias("good_lost"), total(passed & bit, "toxic").alias("toxic_lost"),
        # of all orders, a document's failed filters each come first among themselves equally often
        F.sum(F.when(bit, F.col("n") * (F.lit(factorial(len(names))) / F.greatest(first, F.lit(1))).cast("long")).otherwise(0)).cast("long").alias("shapley"),
    )
    bits = {n: k for k, n in enumerate(names)}
    steps = [("".join(o), k + 1, bits[o[k]], sum(1 << bits[x] for x in o[:k])) for o in permutations(names) for k in range(len(names))]
    orders = d.sparkSession.createDataFrame(steps, "filter_order string, step int, own int, before int")  # 5 x 120 rows, or 6 x 720
    return d.join(F.broadcast(orders), ["own", "before"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
