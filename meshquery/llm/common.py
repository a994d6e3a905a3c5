"""What several operators share: the shared folder, Arrow columns as numpy arrays, word hashes, components.

Words here are maximal runs of bytes other than ASCII white space (0x09-0x0D, 0x20); A-Z are lower-cased.  As
white space is ASCII, UTF-8 texts can be cut at the byte level without decoding them.  A word and a shingle are each
stood for by 64 bits; two different ones of one comparison are taken for equal with probability 2**-64.  What is told
apart over a whole corpus has more bits, or is confirmed (see the operators).
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
EDGES_A_TASK = 10_000


# --- tables in the shared folder -------------------------------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is configured (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        named = tempfile.mkdtemp(prefix="meshquery-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and a lost executor costs nothing done."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/meshquery-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_stash"] = path
    return out


def discard(*stashed: DataFrame) -> None:
    """Delete tables that :func:`stash` made, once nothing reads them any more."""
    for df in stashed:
        sc = df.sparkSession.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(df.__dict__["_stash"])
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def checked(df: DataFrame, *texts: str, most_bytes: int = 32 << 20) -> DataFrame:
    """``df``, to be broadcast if its rows and the texts in it take no more than ``most_bytes``; else joined by key."""
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in texts), F.lit(64))
    total = df.agg(F.sum(size).alias("n")).first().n or 0
    return F.broadcast(df) if total <= most_bytes else df


def text_or_empty(df: DataFrame) -> DataFrame:
    """doc_id and text, null texts as empty."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


# --- Arrow strings as bytes ------------------------------------------------------------------------------------


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; nulls must be filled before."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.types.is_large_string(col.type)
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if len(offsets) == 0:
        offsets = np.zeros(1, np.int64)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes; a longer row is a range of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


# --- hashes of words -------------------------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n + 1:
        size = max(n + 1, 2 * len(_powers[0]))
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, np.uint64(base))
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every input bit reaches every output bit."""
    h = np.asarray(h, np.uint64)
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


SEGMENT = 1 << 22


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of some rows' bytes: each word's row, start, end (bytes) and 64-bit hash, in order.

    A very long text is read in segments that end at white space, so memory for work hangs on a segment, not on the text
    (a word of many megabytes is one segment).
    """
    if len(raw) <= SEGMENT:
        return _segment_hashes(raw, offsets)
    parts, at = [], 0
    while at < len(raw):
        stop = min(at + SEGMENT, len(raw))
        while stop < len(raw) and not _SPACE[raw[stop - 1]]:
            space = np.flatnonzero(_SPACE[raw[stop : stop + SEGMENT]])
            stop = stop + int(space[0]) + 1 if len(space) else min(stop + SEGMENT, len(raw))
        low, high = np.searchsorted(offsets, at, "right") - 1, np.searchsorted(offsets, stop)
        own = np.clip(offsets[low : high + 1], at, stop) - at
        rows, starts, stops, hashes = _segment_hashes(raw[at:stop], own)
        parts.append((rows + low, starts + at, stops + at, hashes))
        at = stop
    return tuple(np.concatenate(x) for x in zip(*parts))


def _segment_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A word's hash is a polynomial over its bytes, got for all words at once from one running sum."""
    size = len(raw)
    if not size:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    space = _SPACE[raw]
    first = np.zeros(size + 1, bool)
    first[offsets[:-1]] = True
    first[size] = True
    word = ~space
    begins = word.copy()
    begins[1:] &= space[:-1] | first[1:size]
    ends = word.copy()
    ends[:-1] &= space[1:] | first[1:size]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _power_tables(size)
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum(_BYTE[_FOLD[raw]] * up[:size], out=sums[1:])
    hashes = mix((sums[stops] - sums[starts]) * down[starts])
    rows = np.searchsorted(offsets, starts, "right") - 1
    return rows, starts, stops, hashes


def shingle_hashes(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Hashes of all runs of ``width`` words of one text; of the whole text if it has fewer words, but some."""
    n = min(width, len(words))
    if n == 0:
        return words
    h = np.full(len(words) - n + 1, np.uint64(n))
    for k in range(n):
        h = mix(h * np.uint64(0x9FB21C651E98DF25) + words[k : len(words) - n + 1 + k])
    return h


def runs_of_rows(rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Where each row's words begin: n_rows + 1 positions."""
    return np.searchsorted(rows, np.arange(n_rows + 1))


def signed(h: np.ndarray) -> np.ndarray:
    return h.astype(np.uint64).view(np.int64)


# --- connected components --------------------------------------------------------------------------------------


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edges (a, b): component is the smallest node reachable.

    Large-star and small-star steps in turn: each hangs every node's neighbours on the smallest one.  The number
    of rounds grows with the logarithm of the longest path.  Edges stay in the shared folder between rounds, one round's
    at a time, and only their number and checksum come to the driver.  A hub's neighbours are one key of a join, which
    adaptive execution splits where they are many.  Few edges are written by few tasks, whatever the shuffle partitions.
    """
    least_tasks = edges.sparkSession.sparkContext.defaultParallelism

    def sign(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = stash(e, "edges")
    was = sign(e)
    for _ in range(most_rounds):
        if not was[0]:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = small.union(least.select("u", F.col("m").alias("v"))).distinct()  # no more than there were
        before, e = e, stash(after.coalesce(max(least_tasks, was[0] // EDGES_A_TASK)), "edges")
        discard(before)
        now = sign(e)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
