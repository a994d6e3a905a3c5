"""Best-fit packing of token sequences with Martello and Toth's dominance reduction.

Texts become token ids with one end id each; what is longer than ``capacity`` is cut into full pieces, the first of
which may be shorter.  Packing needs only how many pieces have each length, a table of at most ``capacity`` counts
whatever the input's size, so the plan is made on the driver and is as small:

* Reduction: for the longest piece j with room R beside it, a set that holds j dominates every other such set if
  (a) nothing fits beside j, (b) one piece fills R, (c) no two pieces fit beside j and k is the longest that does, or
  (d) no three do and {k} or {k, b} outweighs each feasible pair.  Dominating sets are fixed for all pieces of these
  lengths at once; what is left is reduced again until nothing changes.
* Best fit, longest first, packs the remainder: each piece goes to the fullest sequence that has room for it.

A plan row says that pieces ``rank`` .. ``rank + count - 1`` of a length go to sequences ``sequence`` and on, at
``offset``.  Ranks are given within hash buckets of documents, with offsets from the buckets' counts, so pieces of one
frequent length are spread over all tasks.

Nulls: a null text is empty and packs as its end id alone.  Repeated rows are packed as often as they come.  Extra
columns are ignored by :func:`pack`.  An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stash, text_or_empty

CAPACITY = 2048
BUCKETS = 512
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

_encoders: dict[str, object] = {}


def default_ranks() -> str:
    """The byte-level BPE of 50,257 ids as ranks: ids are equal to those of its tokenizers file, at five times the speed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(path: str):
    """An encoder from a file of ranks; as in the tokenizers file, the end-of-text string in a text is one id."""
    if path not in _encoders:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        special = {"<|endoftext|>": len(ranks)}
        _encoders[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _encoders[path]


def token_ids(text: str, path: str) -> np.ndarray:
    return np.array(encoder(path).encode(text, allowed_special="all"), np.uint32)


def cut(length: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``length`` ids."""
    start = length % capacity if length > capacity else 0
    if start:
        yield 0, start
    while start < length:
        yield start, min(capacity, length - start)
        start += capacity


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.append(token_ids(text, path), np.uint32(end_id)).astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    for col, v in zip(out, (doc, k, start, length, zlib.crc32(ids[start : start + length].tobytes()))):
                        col.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


class Plan:
    """Where the pieces of each length go, made from their counts."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, np.int64)
        for size, n in counts.items():
            self.left[size] += n
        self.used = np.zeros(capacity + 1, np.int64)
        self.rows: list[tuple[int, int, int, int, int]] = []  # length, rank, count, sequence, offset
        self.sequences = 0
        self.fixed = 0
        while self._reduce():
            pass
        self._best_fit()

    def _put(self, size: int, count: int, sequence: int, offset: int) -> None:
        self.rows.append((size, int(self.used[size]), count, sequence, offset))
        self.used[size] += count
        self.left[size] -= count

    def _fix(self, sizes: tuple[int, ...]) -> None:
        """As many sequences of these lengths as there are pieces for."""
        need = {s: sizes.count(s) for s in sizes}
        n = int(min(self.left[s] // k for s, k in need.items()))
        offset = 0
        for s in sizes:
            self._put(s, n, self.sequences, offset)
            offset += s
        self.sequences += n
        self.fixed += n

    def _smallest(self, without: int, n: int) -> list[int]:
        """The n shortest pieces, one of length ``without`` set aside."""
        out: list[int] = []
        for s in np.flatnonzero(self.left[: self.capacity + 1]):
            out += [int(s)] * int(min(n - len(out), self.left[s] - (s == without)))
            if len(out) == n:
                break
        return out

    def _longest(self, room: int, *without: int) -> int:
        """The longest piece of at most ``room``, or 0."""
        for s in np.flatnonzero(self.left[: room + 1])[::-1]:
            if self.left[s] > without.count(int(s)):
                return int(s)
        return 0

    def _dominating(self, j: int) -> tuple[int, ...] | None:
        room = self.capacity - j
        k = self._longest(room, j)
        if not k:
            return (j,)
        if k == room:
            return (j, k)
        low = self._smallest(j, 3)
        if len(low) < 2 or low[0] + low[1] > room:
            return (j, k)
        if len(low) < 3 or sum(low) > room:
            best, second = 0, 0  # the largest sum of a feasible pair, the longest shorter member of one
            for a in np.flatnonzero(self.left[: room + 1]):
                b = self._longest(min(room - int(a), int(a)), j, int(a))
                if b:
                    best, second = max(best, int(a) + b), max(second, b)
            if k >= best:
                return (j, k)
            b = self._longest(min(room - k, k), j, k)
            if b and b >= second:
                return (j, k, b)
        return None

    def _reduce(self) -> bool:
        before = self.fixed
        for j in range(self.capacity, 0, -1):
            while self.left[j] and (found := self._dominating(j)):
                self._fix(found)
        return self.fixed > before

    def _best_fit(self) -> None:
        open_: dict[int, list[tuple[int, int]]] = {}  # room -> runs of (first sequence, how many)
        for s in range(self.capacity, 0, -1):
            while self.left[s]:
                room = min((r for r in open_ if r >= s), default=self.capacity)
                if room in open_:
                    first, many = open_[room].pop()
                    if not open_[room]:
                        del open_[room]
                else:
                    first, many = self.sequences, int(-(-self.left[s] // (self.capacity // s)))
                    self.sequences += many
                fill = room // s  # such pieces go on into the sequence that just got one: it is the fullest with room
                full = int(min(many, self.left[s] // fill))
                for k in range(fill if full else 0):
                    self._put(s, full, first, self.capacity - room + k * s)
                if full and room - fill * s:
                    open_.setdefault(room - fill * s, []).append((first, full))
                if full < many:
                    some = int(self.left[s])
                    for k in range(some):
                        self._put(s, 1, first + full, self.capacity - room + k * s)
                    if some and room - some * s:
                        open_.setdefault(room - some * s, []).append((first + full, 1))
                    rest = many - full - (some > 0)
                    if rest:
                        open_.setdefault(room, []).append((first + full + (some > 0), rest))

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows sorted by length and rank, and the key to search them by."""
        rows = np.array(sorted(self.rows), np.int64).reshape(-1, 5)
        return rows, rows[:, 0] * (1 << 48) + rows[:, 1]


def _place(rows: np.ndarray, key: np.ndarray):
    def run(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(key, length * (1 << 48) + rank, "right") - 1
            sequence = rows[at, 3] + rank - rows[at, 1] if len(rank) else rank
            offset = rows[at, 4] if len(rank) else rank
            cols = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pieces(docs: DataFrame, ranks: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Token pieces of every text: doc_id, piece, start, length and the crc32 of their ids."""
    return text_or_empty(docs).mapInArrow(_pieces(ranks or default_ranks(), capacity, end_id), PIECES)


def place(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Sequence and offset for pieces (of a stored table: it is read twice)."""
    order = Window.partitionBy("bucket", "length").orderBy("doc_id", "piece", "start", "ids_crc32")
    dealt = found.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(BUCKETS)).cast("int"))
    counts = stash(dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")), "lengths")  # at most capacity * BUCKETS rows
    plan = Plan({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = dealt.withColumn("rank", F.row_number().over(order).cast("long") - 1).join(before, ["bucket", "length"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(_place(*plan.arrays()), f"{PIECES}, sequence_id long, offset long")


def pack(docs: DataFrame, ranks: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every text."""
    return place(stash(pieces(docs, ranks, capacity, end_id), "pieces"), capacity)
