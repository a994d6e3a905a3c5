"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures.

Every text's set is its distinct shingles of ``width`` words.  Two texts link when 100 * |A & B| >= percent * |A | B|.

1. Texts of one set form a class (their copies are never compared); a class is named by a 64-bit digest of its set, and
   where a second 64-bit digest tells sets of one name apart, by both.
2. Shingles are put in one global order, those met most often last.  The order comes from counts of shingles that
   are frequent within partitions; any order gives the same links, a good one gives few candidates.
3. Linked sets share a shingle among the first of each (the larger set's first n - ceil(t n) + 1, the smaller's first
   n - ceil(2 t n / (1 + t)) + 1), so classes meet only in the tiles of those shingles.  A tile is sorted by set size
   and cut into bands in which sizes differ by 1 / t at most.  Small tiles give all their admissible pairs; in large
   ones each member meets its band's first member and its predecessor: as many pairs as members, not their square.
   A tile of over ``HOT_TILE`` members is dealt out in parts, whose bands' first members then meet in a tile of theirs.
4. A pair's bitmaps (``bits`` bits, each the parity of the set's shingles hashed to it) differ in no more bits than
   the sets in shingles, which bounds the overlap from above; what passes is held against bitmaps of ``FINE`` bits,
   made for the classes still in question only, and what passes that is intersected exactly as sorted arrays.
5. Links give components.  In large tiles which still hold several components, the members outside the tile's largest
   component are held against all members of other components by bitmaps, in blocks of ``BLOCK``; what passes goes on as
   in 4.  So no pair is left out which could join components, and a tile costs its members times those outside its
   largest component.  Of the large tiles two classes share, the least among the first few of each compares them, so a
   pair comes out once.
6. The links so found suffice for the components but are not all.  Where all are asked for (``every``, as in
   ``jaccard_links`` and ``count_links``), step 5 holds all members of every large tile against each other, those of
   one component too.

Nulls: a null text is empty; an empty set links with nothing; a null doc_id is an id after all others.  Rows that repeat
a doc_id are one document each and share a class if their sets are equal.  Texts of any length are read whole, one text's
set at a time.  Extra columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import chunks, column_bytes, components, discard, mix, runs_of_rows, shingle_hashes, signed, stash, text_or_empty, word_hashes

FREQUENT_MOST = 200_000  # entries of the order's head: 1.6 MB in each task
FREQUENT_LOCAL = 6  # a partition reports shingles that so many of its sets have
FREQUENT_BLOCK = 1 << 20  # shingles counted at once
SMALL_TILE = 8
TOKEN_PARTS = 4
BITS = 1024
FINE = 8192
LEAST_TILES = 4
BLOCK = 4096
HOT_TILE = 1 << 17
TOKENS_A_TASK = 1 << 20  # tiles' members a task holds, on average at most
BLOOM_WORDS = 1 << 17  # 1 MB, and more for more candidates, up to
BLOOM_MOST = 1 << 23  # 64 MB: beyond it more rows pass, which the join that follows drops


def each_set(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes; texts are read in chunks, so few sets are held at once."""
    raw, offsets = column_bytes(texts)
    for lo, hi in chunks(offsets):
        part = offsets[lo : hi + 1] - offsets[lo]
        rows, _, _, words = word_hashes(raw[offsets[lo] : offsets[hi]], part)
        cut = runs_of_rows(rows, hi - lo)
        for k in range(hi - lo):
            yield np.unique(shingle_hashes(words[cut[k] : cut[k + 1]], width))


def sets_of(texts: pa.Array, width: int) -> list[np.ndarray]:
    return list(each_set(texts, width))


def digest(s: np.ndarray) -> tuple[int, int]:
    """Twice 64 bits for a set: from sums of two mixes of its members and its size."""
    a, b = mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)
    with np.errstate(over="ignore"):
        key = mix(a * np.uint64(0x2545F4914F6CDD1D) ^ mix(b) ^ np.uint64(len(s)))
        return int(key), int(mix(b * np.uint64(0x9E3779B97F4A7C15) + mix(a) + np.uint64(len(s))))


def name(s: np.ndarray, clashing: frozenset[int] = frozenset()) -> int:
    """A set's name: its first digest, or both where that stands for several sets."""
    return named_by(*digest(s), clashing)


def named_by(key: int, check: int, clashing: frozenset[int]) -> int:
    return int(mix(np.array([key ^ check], np.uint64))[0]) if key in clashing else key


_NO_TILE = np.iinfo(np.int64).min


def bitmap(s: np.ndarray, bits: int) -> np.ndarray:
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def probe_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def index_length(n: int, percent: int) -> int:
    return n - -(-2 * percent * n // (100 + percent)) + 1


def in_order(s: np.ndarray, known: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The set by the global order: unknown shingles by hash, then the frequent ones, the most frequent last."""
    if not len(known):
        return s
    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
    place = np.where(known[at] == s, rank[at] + 1, 0)
    return s[np.lexsort((s, place))]


def _frequent(width: int):
    def run(batches):
        seen: set[tuple[int, int]] = set()
        parts, size, done = [], 0, []

        def count():
            h, n = np.unique(np.concatenate(parts), return_counts=True)
            done.append((h[n > 1], n[n > 1]))

        for batch in batches:
            for s in each_set(batch.column("text"), width):
                if len(s) and (d := digest(s)) not in seen:
                    seen.add(d)
                    parts.append(s)
                    size += len(s)
                if size > FREQUENT_BLOCK:
                    count()
                    parts, size = [], 0
        if parts:
            count()
        h, own = np.unique(np.concatenate([h for h, _ in done] or [np.zeros(0, np.uint64)]), return_inverse=True)
        c = np.bincount(own, weights=np.concatenate([n for _, n in done] or [np.zeros(0)]), minlength=len(h))
        keep = c >= FREQUENT_LOCAL
        yield pa.RecordBatch.from_arrays([pa.array(signed(h[keep])), pa.array(c[keep].astype(np.int64))], ["shingle", "n"])

    return run


def _describe(width: int, percent: int, bits: int, known: np.ndarray, rank: np.ndarray, clashing: frozenset[int]):
    def run(batches):
        seen: set[int] = set()  # a partition's copies beyond the first need no signatures
        for batch in batches:
            keys, checks, sizes, maps, heads = [], [], [], [], []
            for s in each_set(batch.column("text"), width):
                key, check = digest(s)
                d = named_by(key, check, clashing)
                new = len(s) > 0 and d not in seen
                seen.add(d)
                keys.append(d)
                checks.append(check)
                sizes.append(len(s))
                maps.append(bitmap(s, bits) if new else None)
                heads.append(signed(in_order(s, known, rank)[: probe_length(len(s), percent)]) if new else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.array(keys, np.uint64).view(np.int64)),
                    pa.array(np.array(checks, np.uint64).view(np.int64)),
                    pa.array(sizes, pa.int64()),
                    pa.array(maps, pa.list_(pa.int64())),
                    pa.array(heads, pa.list_(pa.int64())),
                ],
                ["doc_id", "key", "check", "n", "bitmap", "head"],
            )

    return run


def _gather(batches, names: list[str]) -> list[np.ndarray]:
    parts = [[b.column(c).to_numpy(zero_copy_only=False) for c in names] for b in batches if b.num_rows]
    return [np.concatenate(x) for x in zip(*parts)] if parts else []


PAIR, MEMBER, LEADER = 0, 1, 2  # kinds of rows that tiles give


def _tiles(percent: int):
    """Of a partition's tiles: candidate pairs (a, b), members of large tiles and leaders of a hot tile's parts (tile, key)."""

    def run(batches):
        cols = _gather(batches, ["token", "part", "key", "n", "place"])
        if not cols:
            return
        token, part, key, n, place = cols
        o = np.lexsort((key, n, part, token))
        token, part, key, n, place = token[o], part[o], key[o], n[o], place[o]
        alike = (token[1:] == token[:-1]) & (part[1:] == part[:-1])
        same = np.r_[False, alike & (key[1:] == key[:-1])]  # one class from several partitions
        token, part, key, n, place = token[~same], part[~same], key[~same], n[~same], place[~same]
        begin = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (part[1:] != part[:-1])])
        size = np.diff(np.r_[begin, len(token)])
        of, tile = np.repeat(size, size), np.repeat(np.arange(len(size)), size)
        hot = part >= 0  # a part of a tile counts as large however few members it has
        small = place < n - -(-2 * percent * n // (100 + percent)) + 1  # may stand on the smaller side
        a, b, led = [], [], []

        def fits(i, j):
            return small[i] & (100 * n[i] >= percent * n[j])

        for step in range(1, SMALL_TILE):
            i = np.flatnonzero((of[:-step] <= SMALL_TILE) & (tile[step:] == tile[:-step])) if len(token) > step else np.zeros(0, int)
            i = i[fits(i, i + step)]
            a.append(key[i])
            b.append(key[i + step])
        i = np.flatnonzero((of[:-1] > SMALL_TILE) & (tile[1:] == tile[:-1]))
        i = i[fits(i, i + 1)]
        a.append(key[i])
        b.append(key[i + 1])
        for k in np.flatnonzero((size > SMALL_TILE) | hot[begin]):
            lo, hi = begin[k], begin[k] + size[k]
            while lo < hi:  # one band after another
                first = lo + int(np.argmax(small[lo:hi])) if small[lo:hi].any() else hi
                if first >= hi:
                    break
                end = first + int(np.searchsorted(percent * n[first:hi], 100 * n[first], "right"))
                a.append(np.full(end - first - 1, key[first]))
                b.append(key[first + 1 : end])
                if hot[lo]:
                    led.append(first)
                lo = max(end, first + 1)
        a, b = np.concatenate(a), np.concatenate(b)
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        o = np.lexsort((hi, lo))
        lo, hi = lo[o], hi[o]
        new = np.r_[True, (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])] if len(lo) else np.zeros(0, bool)
        large, led = np.flatnonzero((of > SMALL_TILE) | hot), np.array(led, np.int64)
        zero = np.zeros(new.sum() + len(large), np.int64)
        rows = [
            np.r_[lo[new], token[large], token[led]], np.r_[hi[new], key[large], key[led]], np.repeat(np.int32([PAIR, MEMBER, LEADER]), [new.sum(), len(large), len(led)]),
            np.r_[zero, n[led]], np.r_[zero, place[led]],
        ]
        for s in range(0, len(rows[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[s : s + 100_000]) for x in rows], ["a", "b", "kind", "n", "place"])

    return run


TILED = "a long, b long, kind int, n long, place long"


def _across(percent: int, bits: int, every: bool = False):
    """Pairs in one tile (or two blocks of one) that bitmaps don't rule out, from different components or ``every`` one."""
    step = 256

    def pairs(key, comp, n, maps, side, least, token):
        for s in range(0, len(key), step):
            t = slice(s, s + step)
            ok = ((comp[t, None] != comp[None, :]) | every) & (key[t, None] < key[None, :]) & ((side[t, None] | side[None, :]) == 3)
            ok &= 100 * np.minimum(n[t, None], n[None, :]) >= percent * np.maximum(n[t, None], n[None, :])
            i, j = np.nonzero(ok)
            for q in range(0, len(i), 1 << 16):
                ii, jj = i[q : q + (1 << 16)] + s, j[q : q + (1 << 16)]
                differ = np.bitwise_count(maps[ii] ^ maps[jj]).sum(axis=1).astype(np.int64)
                good = (100 + percent) * differ <= (100 - percent) * (n[ii] + n[jj])
                ii, jj = ii[good], jj[good]
                shared = (least[ii][:, :, None] == least[jj][:, None, :]).any(axis=2) & (least[ii] != _NO_TILE)
                first = np.where(shared, least[ii], np.iinfo(np.int64).max).min(axis=1)
                here = ~shared.any(axis=1) | (first == token[ii])
                if here.any():
                    yield key[ii[here]], key[jj[here]]

    def run(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        tile, token, key, comp, n, side = (table.column(c).to_numpy() for c in ("tile", "token", "key", "component", "n", "side"))
        maps = table.column("bitmap").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(key), bits // 64)  # numpy counts the bits of a signed number's absolute value
        least = table.column("least").combine_chunks().flatten().to_numpy().reshape(len(key), LEAST_TILES)
        o = np.lexsort((key, tile))
        tile, token, key, comp, n, side, maps, least = (x[o] for x in (tile, token, key, comp, n, side, maps, least))
        begin = np.r_[np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]]), len(tile)]
        for lo, hi in zip(begin[:-1], begin[1:]):
            for a, b in pairs(*(x[lo:hi] for x in (key, comp, n, maps, side, least, token))):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def _close(percent: int):
    """Pairs that the fine bitmaps don't rule out."""

    def run(batches):
        for batch in batches:
            a, b = (column_bytes(batch.column(c).cast(pa.binary()).view(pa.string()))[0].reshape(batch.num_rows, -1) for c in ("fine_a", "fine_b"))
            n = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            differ = np.bitwise_count(a ^ b).sum(axis=1).astype(np.int64)
            yield batch.select(["a", "b", "row_a", "row_b"]).filter(pa.array((100 + percent) * differ <= (100 - percent) * n))

    return run


def _confirm(percent: int, width: int):
    """Exact intersections; a class stands in many pairs, so a batch makes its set once."""

    def run(batches):
        for batch in batches:
            sets: dict[int, np.ndarray] = {}
            for k in ("a", "b"):
                keys = batch.column(k).to_pylist()
                new = {key: i for i, key in enumerate(keys) if key not in sets}
                sets |= zip(new, sets_of(batch.column(f"text_{k}").take(pa.array(list(new.values()), pa.int64())), width))
            good = []
            for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                x, y = sets[x], sets[y]
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _classes(docs: DataFrame, width: int, percent: int, bits: int, every: bool) -> tuple[DataFrame, DataFrame, frozenset[int]]:
    """(membership, links, names that stand for several sets)."""
    spark = docs.sparkSession
    texts = text_or_empty(docs)
    made: list[DataFrame] = []  # tables that nothing reads once the result is stored

    def kept(df: DataFrame, what: str) -> DataFrame:
        made.append(stash(df, what))
        return made[-1]

    def done_with(*tables: DataFrame) -> None:
        for t in tables:
            discard(t)
            made[:] = [m for m in made if m is not t]

    order = texts.mapInArrow(_frequent(width), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    order = order.orderBy(F.desc("n"), "shingle").limit(FREQUENT_MOST).collect()  # at most FREQUENT_MOST rows
    known = np.array([r.shingle for r in order], np.int64).view(np.uint64)
    rank = np.arange(len(order), 0, -1)
    o = np.argsort(known)
    known, rank = known[o], rank[o]

    def describe(clashing: frozenset[int]) -> tuple[DataFrame, DataFrame]:
        schema = "doc_id long, key long, check long, n long, bitmap array<long>, head array<long>"
        d = kept(texts.mapInArrow(_describe(width, percent, bits, known, rank, clashing), schema), "sets")
        c = d.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bitmap", ignorenulls=True).alias("bitmap"), F.min("check").alias("low"), F.max("check").alias("high"))
        return d, kept(c, "classes")

    clashing: frozenset[int] = frozenset()
    described, whole = describe(clashing)
    classes = whole
    clashes = [r.key for r in classes.where("low <> high").select("key").collect()]  # one pair of sets in 2**64
    if clashes:
        clashing = frozenset(np.array(clashes, np.int64).view(np.uint64).tolist())
        done_with(described, whole)
        described, whole = describe(clashing)
    classes = whole.drop("low", "high")

    tokens = described.where("head is not null").select("key", "n", F.posexplode("head").alias("place", "token"))
    total = described.agg(F.sum(F.size("head")).alias("n")).first().n or 0
    parts = max(TOKEN_PARTS * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TOKENS_A_TASK))
    hot = spark.createDataFrame([(r.shingle, -(-r.n // HOT_TILE)) for r in order if r.n > HOT_TILE], "token long, parts long")  # at most FREQUENT_MOST rows
    part = F.coalesce(F.pmod(F.xxhash64("key"), F.col("parts")), F.lit(-1)).alias("part")
    dealt = tokens.join(F.broadcast(hot), "token", "left").select("token", part, "key", "n", "place")
    tiles = kept(dealt.repartition(parts, "token", "part").mapInArrow(_tiles(percent), TILED), "tiles")
    slim = kept(described.select("doc_id", "key", "n"), "rows")
    done_with(described)
    described = slim
    leaders = tiles.where(F.col("kind") == LEADER).select(F.col("a").alias("token"), F.lit(-1).cast("long").alias("part"), F.col("b").alias("key"), "n", "place")
    led = leaders.repartition("token").mapInArrow(_tiles(percent), TILED).where(F.col("kind") == PAIR)

    def verified(pairs: DataFrame, what: str) -> DataFrame:
        side = lambda k: classes.select(F.col("key").alias(k), F.col("n").alias(f"n_{k}"), F.col("bitmap").alias(f"bitmap_{k}"), F.col("rep").alias(f"rep_{k}"))
        held = pairs.join(side("a"), "a").join(side("b"), "b")
        differ = sum((F.bit_count(F.col("bitmap_a")[k].bitwiseXOR(F.col("bitmap_b")[k])) for k in range(bits // 64)), F.lit(0))
        near = (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & ((100 + percent) * differ <= (100 - percent) * (F.col("n_a") + F.col("n_b")))
        held = near_pairs = kept(held.where(near).select("a", "b", "rep_a", "rep_b", "n_a", "n_b"), f"near-{what}")
        sieve = bloom(held.select(F.col("rep_a").alias("id")).union(held.select(F.col("rep_b").alias("id"))), 2 * held.count())
        # rows that share a doc_id all pass; those whose set is the class's are found by its key, and one of them stands for it:
        # it is chosen by keys and row numbers alone, so texts are shuffled only to stand beside each other
        of = kept(texts.mapInArrow(_keyed(width, sieve, clashing), "key long, text string, fine binary").withColumn("row", F.monotonically_increasing_id()), f"texts-{what}")
        one = of.groupBy("key").agg(F.min("row").alias("row"))

        def beside(pairs: DataFrame, column: str, by: str, rows: DataFrame) -> DataFrame:
            for k in ("a", "b"):
                at = f"row_{k}" if by == "row" else k
                pairs = pairs.join(rows.select(F.col(by).alias(at), F.col(column).alias(f"{column}_{k}")), at)
            return pairs

        held = beside(held.select("a", "b", "n_a", "n_b"), "row", "key", one)
        held = beside(held, "fine", "row", of).mapInArrow(_close(percent), "a long, b long, row_a long, row_b long")
        held = beside(held, "text", "row", of).select("a", "b", "text_a", "text_b").mapInArrow(_confirm(percent, width), "a long, b long")
        found = stash(held, f"links-{what}")
        done_with(near_pairs, of)
        return found

    pairs = tiles.where(F.col("kind") == PAIR).union(led) if any(r.n > HOT_TILE for r in order) else tiles.where(F.col("kind") == PAIR)
    links = verified(pairs.select("a", "b").distinct(), "first")
    named = kept(components(links), "components")
    large = tiles.where(F.col("kind") == MEMBER).select(F.col("a").alias("tile"), F.col("b").alias("key"))
    least = F.slice(F.sort_array(F.collect_list("tile")), 1, LEAST_TILES)  # a class has no more tiles than shingles
    least = large.groupBy("key").agg(F.slice(F.concat(least, F.array_repeat(F.lit(int(_NO_TILE)), LEAST_TILES)), 1, LEAST_TILES).alias("least"))
    of = least.join(named.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    members = large.join(of, "key")
    sizes = members.groupBy("tile", "component").agg(F.count(F.lit(1)).alias("size"))
    mixed = sizes.groupBy("tile").agg(F.max(F.struct("size", "component")).alias("most"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("several"))
    if every:  # all members stand outside
        mixed = mixed.select("tile", F.lit(None).cast("long").alias("most"), F.lit(0).alias("k_in"), F.ceil(F.col("size") / BLOCK).cast("int").alias("k_out"))
    else:
        outside = F.col("size") - F.col("most.size")
        mixed = mixed.where("several > 1").select("tile", F.col("most.component").alias("most"), F.ceil(F.col("most.size") / BLOCK).cast("int").alias("k_in"), F.ceil(outside / BLOCK).cast("int").alias("k_out"))
    rest = members.join(mixed, "tile").join(classes.select("key", "n", "bitmap"), "key").withColumn("inside", F.coalesce(F.col("component") == F.col("most"), F.lit(False)))
    own = F.pmod(F.xxhash64("key"), F.when(F.col("inside"), F.col("k_in")).otherwise(F.col("k_out"))).cast("int")
    # a task holds two blocks from outside the largest component, or one of them and one from inside (numbered below 0)
    at = lambda low, high, side: F.struct(low.alias("low"), high.alias("high"), side.alias("side"))
    upto = lambda k: F.when(k > 0, F.sequence(F.lit(0), k - 1)).otherwise(F.array().cast("array<int>"))
    mine = F.col("own")
    beside = F.transform(upto(F.col("k_out")), lambda j: at(F.least(mine, j), F.greatest(mine, j), F.when(mine == j, 3).when(mine < j, 1).otherwise(2)))
    within = F.transform(upto(F.col("k_in")), lambda p: at(mine, -1 - p, F.lit(1)))
    across = F.transform(upto(F.col("k_out")), lambda j: at(j, -1 - mine, F.lit(2)))
    # with one block each, one task holds both: members of the largest component aren't compared with each other, being of one
    both = F.when((F.col("k_in") == 1) & (F.col("k_out") == 1), F.array(at(F.lit(0), F.lit(0), F.lit(3))))
    rest = rest.withColumn("own", own).withColumn("t", F.explode(F.coalesce(both, F.when(F.col("inside"), across).otherwise(F.concat(beside, within)))))
    rest = rest.select(F.xxhash64("tile", "t.low", "t.high").alias("tile"), F.col("tile").alias("token"), "key", "component", "n", "bitmap", "least", "t.side")
    more = kept(rest.repartition("tile").mapInArrow(_across(percent, bits, every), "a long, b long").distinct(), "across")
    if not more.isEmpty():
        links = links.union(verified(more, "second"))
        named = kept(components(links), "components")
    grouped = classes.select("key", "rep").join(named.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = grouped.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_key = grouped.join(least, "component").select("key", "component_id", "component")
    found = described.select("doc_id", "key", "n").join(by_key, "key", "left")
    found = found.select("doc_id", "key", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "component")
    found = stash(found, "found")
    discard(*made)
    return found, links, clashing


def jaccard_classes(docs: DataFrame, width: int = 5, percent: int = 80, bits: int = BITS, every: bool = False) -> tuple[DataFrame, DataFrame]:
    """(membership: doc_id, key, n_shingles, component_id, component; links between classes by key: a, b).

    The links are ``every`` one, or as many as suffice for the components.  ``component`` is null for an empty set; it
    tells groups apart where rows repeat a doc_id and so a component_id.
    """
    found, links, _ = _classes(docs, width, percent, bits, every)
    return found, links


def _bits(ids: np.ndarray, words: int) -> list[tuple[np.ndarray, np.ndarray]]:
    h = mix(ids.astype(np.int64).view(np.uint64))
    return [((x >> np.uint64(6)) % np.uint64(words), np.uint64(1) << (x & np.uint64(63))) for x in (h, mix(h + np.uint64(1)))]


def _bloom(words: int):
    def run(batches):
        whole = np.zeros(words, np.uint64)
        for batch in batches:
            for word, bit in _bits(batch.column("id").to_numpy(zero_copy_only=False), words):
                np.bitwise_or.at(whole, word.astype(np.int64), bit)
        at = np.flatnonzero(whole)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(signed(whole[at]))], ["word", "bits"])

    return run


def bloom(ids: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter for ``n`` ids, of 16 bits each within its bounds; what it lets through besides, a join drops."""
    words = BLOOM_WORDS
    while words < min(n // 4, BLOOM_MOST):
        words *= 2
    rows = ids.select(F.coalesce("id", F.lit(0)).alias("id")).mapInArrow(_bloom(words), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    got = rows.toArrow()  # ``words`` rows at most
    whole = np.zeros(words, np.uint64)
    whole[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return whole


def _keyed(width: int, sieve: np.ndarray, clashing: frozenset[int]):
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").fill_null(0).to_numpy()
            batch = batch.filter(pa.array(np.logical_and.reduce([(sieve[word.astype(np.int64)] & bit) > 0 for word, bit in _bits(ids, len(sieve))])))
            found = sets_of(batch.column("text"), width)
            keys = np.array([name(s, clashing) for s in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column("text"), pa.array([bitmap(s, FINE).tobytes() for s in found], pa.binary())], ["key", "text", "fine"])

    return run


def _with_key(width: int, clashing: frozenset[int]):
    def run(batches):
        for batch in batches:
            text = batch.column("text")
            keys = np.array([name(s, clashing) for s in each_set(text.fill_null(""), width)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys)], [*batch.schema.names, "_key"])

    return run


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``."""
    return jaccard_classes(docs, width, percent)[0].select("doc_id", "n_shingles", "component_id")


def jaccard_links(docs: DataFrame, width: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key of every row of ``docs``; a, b: all links between different sets by key, a < b, each once)."""
    found, links = jaccard_classes(docs, width, percent, every=True)
    return found.select("doc_id", "key"), links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def count_links(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_links of every row of ``docs``: the other rows it links with, those of an equal set included."""
    found, links = jaccard_classes(docs, width, percent, every=True)
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rows = found.where("n_shingles > 0").groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
    both = links.union(links.select("b", "a")).toDF("key", "other")
    near = both.join(rows.withColumnRenamed("key", "other"), "other").groupBy("key").agg(F.sum("rows").alias("near"))
    n = rows.join(near, "key", "left").select("key", (F.col("rows") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))
    return found.join(n, "key", "left").select("doc_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of linked documents; all columns stay.

    It is the row of the smallest doc_id, then of the least set key, text hash and text.  An empty set is a group of its
    own, so its rows all stay.
    """
    found, _, clashing = _classes(docs, width, percent, BITS, False)
    first = found.where("n_shingles > 0").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "key")).alias("x"))
    first = first.select(F.col("x.doc_id").alias("_id"), F.col("x.key").alias("_own"), F.lit(False).alias("_empty"))
    first = stash(first.union(found.where("n_shingles = 0").select("doc_id", "key", F.lit(True)).distinct()), "first")
    if found.groupBy("doc_id").count().where("count > 1").isEmpty():
        return docs.join(first, docs.doc_id.eqNullSafe(first["_id"]), "left_semi")
    keyed = docs.mapInArrow(_with_key(width, clashing), StructType([*docs.schema.fields, StructField("_key", LongType())]))
    kept = keyed.join(first, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_own")))
    place = F.row_number().over(Window.partitionBy("_id", "_key").orderBy(F.xxhash64("text"), "text"))
    return kept.withColumn("_place", place).where("_empty or _place = 1").select(*docs.columns)
