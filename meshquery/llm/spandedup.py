"""Substring dedup by sliding sentence spans.

A text is cut into sentences after words that end in ``.``, ``!`` or ``?`` and at line ends, and after words whose hash
says so (one in ``CUT_ONE_IN``).  Whether a text is cut after a word hangs on that word and the line end alone, so a
passage falls apart at the same words wherever it stands.  A span has ``SENTENCES`` sentences and ``LEAST_WORDS`` words
at least: from every sentence the shortest run that begins there and the shortest that ends there are taken, so runs
reach both edges of a repeated passage.  A text with less than one span is taken whole.  Spans are hashed (80 bits, over
folded words: among 10**12 spans less than one pair is taken for equal wrongly) and brought together over all texts.  The first place of a span, by doc_id and position, stays; sentences
covered by any later place go.

Spans go to ``BUCKETS`` buckets by hash as packed records, sorted and met once; a bucket is held in memory, one at a time.
Of a span that a task meets in several places all but the first are later places at once, so a span in very many texts
sends one record a block of ``SPAN_BLOCK`` spans to its bucket.  A text's marks are twice its sentences at most.

Nulls: a null text is empty and stays null; a null doc_id is an id of its own that comes first.  Rows that repeat a
doc_id are taken for one document at the same place: neither is a later place of the other, both are cut alike.  A text
may lose everything, then it is empty.  Texts of any length are read whole.  Places are never tied, as those of one
document differ in position.  Extra columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, column_bytes, mix, runs_of_rows, text_or_empty, word_hashes

SENTENCES = 2
LEAST_WORDS = 15
CUT_ONE_IN = 5
BUCKETS = 4096
SPAN_BLOCK = 1 << 19  # spans a task holds before it passes them on

_STEPS = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)
_steps: list[np.ndarray] = []


def _step_tables(n: int) -> list[np.ndarray]:
    """Powers of each step and of its inverse."""
    if not _steps or len(_steps[0]) < n + 1:
        size = 2 * n + 2
        _steps[:] = []
        for step in _STEPS:
            for base in (step, pow(step, -1, 1 << 64)):
                powers = np.full(size, np.uint64(base))
                powers[0] = 1
                _steps.append(np.cumprod(powers, dtype=np.uint64))
    return _steps


class Sentences:
    """The sentences of some rows: ``first`` (rows + 1 places), and each one's byte range and words."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        rows, starts, stops, hashes = word_hashes(raw, offsets)
        self.hashes, n = hashes, len(rows)
        n_rows = len(offsets) - 1
        if not n:
            self.word = np.zeros(1, np.int64)
            self.first = np.zeros(n_rows + 1, np.int64)
            self.begin = np.zeros(0, np.int64)
            return
        breaks = np.flatnonzero(raw == 10)
        last = np.r_[rows[1:] != rows[:-1], True]
        newline = np.r_[np.searchsorted(breaks, starts[1:]) > np.searchsorted(breaks, stops[:-1]), False]
        ends = last | newline | np.isin(raw[stops - 1], np.frombuffer(b".!?", np.uint8))
        ends |= mix(hashes) % np.uint64(CUT_ONE_IN) == 0
        self.word = np.r_[0, np.flatnonzero(ends) + 1]  # sentence k has words word[k] .. word[k + 1] - 1
        self.first = runs_of_rows(rows[self.word[:-1]], n_rows)
        self.begin = starts[self.word[:-1]]

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first sentence, sentences, hash, 16 more bits) of every span, within rows."""
        n = len(self.word) - 1
        row_begin, row_end = (np.repeat(x, np.diff(self.first)) for x in (self.first[:-1], self.first[1:]))
        k = np.arange(n)
        stop = np.maximum(np.searchsorted(self.word, self.word[:-1] + LEAST_WORDS), k + SENTENCES)  # runs that begin at k
        fits = stop <= row_end
        back = np.minimum(np.searchsorted(self.word, self.word[1:] - LEAST_WORDS, "right") - 1, k + 1 - SENTENCES)  # that end with k
        ends = back >= row_begin
        ends[ends] = stop[back[ends]] != k[ends] + 1  # else met from its beginning
        short = (k == row_begin) & ~fits
        k, stop = np.r_[k[fits], back[ends], k[short]], np.r_[stop[fits], k[ends] + 1, row_end[short]]
        tables, out = _step_tables(len(self.hashes)), []
        for up, down in (tables[:2], tables[2:]):
            sums = np.r_[np.uint64(0), np.cumsum(self.hashes * up[: len(self.hashes)], dtype=np.uint64)]
            out.append(mix((sums[self.word[stop]] - sums[self.word[k]]) * down[self.word[k]] + (self.word[stop] - self.word[k]).astype(np.uint64)))
        return k, stop - k, out[0], (out[1] >> np.uint64(48)).astype(np.uint16)


_FIELDS = (np.uint64, np.uint16, np.int64, np.int32, np.int32)  # span, more of it, doc_id (0 for null), at, sentences (negative for a null doc_id)


def _pack(columns: list[np.ndarray]) -> bytes:
    """Records as one compressed string, equal bytes of all records together."""
    planes = b"".join(c.view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns)
    return pa.compress(planes, codec="zstd", asbytes=True)


def _unpack(packed: bytes, rows: int) -> list[np.ndarray]:
    planes = np.frombuffer(pa.decompress(packed, rows * sum(np.dtype(t).itemsize for t in _FIELDS), codec="zstd", asbytes=True), np.uint8)
    out, at = [], 0
    for t in _FIELDS:
        size = rows * np.dtype(t).itemsize
        out.append(np.ascontiguousarray(planes[at : at + size].reshape(-1, rows).T).view(t).ravel())
        at += size
    return out


def _first_places(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct records by span and place, and which of them stand at a later place than their span's first."""
    span, more, doc, at, n = columns
    o = np.lexsort((n, at, doc, n > 0, more, span))
    span, more, doc, at, n = (x[o] for x in (span, more, doc, at, n))
    new = np.r_[True, (span[1:] != span[:-1]) | (more[1:] != more[:-1])]
    moved = np.r_[True, (doc[1:] != doc[:-1]) | (at[1:] != at[:-1]) | ((n[1:] > 0) != (n[:-1] > 0))]
    place = np.cumsum(new | moved)
    later = place != place[np.flatnonzero(new)[np.cumsum(new) - 1]]
    once = new | moved | np.r_[True, n[1:] != n[:-1]]
    return [x[once] for x in (span, more, doc, at, n)], later[once]


def _spans(batches):
    """Packed records by bucket; ``sure`` ones are later places whatever other tasks meet."""

    def passed(parts):
        columns, later = _first_places([np.concatenate(x) for x in zip(*parts)])
        rest = [c[~later] for c in columns]
        edge = np.searchsorted((rest[0] >> np.uint64(52)).astype(np.int64), np.arange(BUCKETS + 1))
        out = [(b, edge[b + 1] - edge[b], False, _pack([c[edge[b] : edge[b + 1]] for c in rest])) for b in np.flatnonzero(np.diff(edge)).tolist()]
        at = np.flatnonzero(later)
        for s in range(0, len(at), 4096):
            some = [c[at[s : s + 4096]] for c in columns]
            out.append((int(some[0][0] >> np.uint64(52)), len(some[0]), True, _pack(some)))
        kinds = (pa.int32(), pa.int32(), pa.bool_(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], ["bucket", "n", "sure", "packed"])

    parts, size = [], 0
    for batch in batches:
        raw, offsets = column_bytes(batch.column("text"))
        null = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
        ids = batch.column("doc_id").fill_null(0).to_numpy()
        for lo, hi in chunks(offsets):
            found = Sentences(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            k, n, h, more = found.spans()
            row = np.searchsorted(found.first, k, "right") - 1
            parts.append((h, more, ids[row + lo], (k - found.first[row]).astype(np.int32), np.where(null[row + lo], -n, n).astype(np.int32)))
            size += len(k)
            if size > SPAN_BLOCK:
                yield passed(parts)
                parts, size = [], 0
    if size:
        yield passed(parts)


def _later(batches):
    """doc_id, mark (first sentence << 32 | sentences) of the later places of a partition's buckets, sorted by bucket."""

    def marks(columns):
        _, _, doc, at, n = columns
        return pa.RecordBatch.from_arrays([pa.array(doc, mask=n < 0), pa.array(at.astype(np.int64) << 32 | np.abs(n))], ["doc_id", "mark"])

    def settled(parts):
        columns, later = _first_places([np.concatenate(x) for x in zip(*parts)])
        return marks([c[later] for c in columns])

    now, parts = -1, []
    for batch in batches:
        for bucket, n, sure, packed in zip(*(batch.column(c).to_pylist() for c in ("bucket", "n", "sure", "packed"))):
            if bucket != now and parts:
                yield settled(parts)
                parts = []
            now = bucket
            if sure:
                yield marks(_unpack(packed, n))
            else:
                parts.append(_unpack(packed, n))
    if parts:
        yield settled(parts)


def _rebuild(batches):
    for batch in batches:
        raw, offsets = column_bytes(batch.column("text"))
        marks = batch.column("marks")
        texts, total, gone = [], [], []
        for lo, hi in chunks(offsets):
            part = raw[offsets[lo] : offsets[hi]]
            found = Sentences(part, offsets[lo : hi + 1] - offsets[lo])
            for r in range(lo, hi):
                a, b = found.first[r - lo], found.first[r - lo + 1]
                begin, end = offsets[r] - offsets[lo], offsets[r + 1] - offsets[lo]
                drop = np.zeros(b - a, bool)
                if marks[r].is_valid:
                    m = marks[r].values.to_numpy()
                    at = np.minimum(m >> 32, b - a)
                    upto = np.minimum(at + (m & 0xFFFFFFFF), b - a)
                    drop = np.cumsum(np.bincount(at, minlength=b - a + 1) - np.bincount(upto, minlength=b - a + 1))[:-1] > 0
                if drop.any():
                    edges = np.r_[begin, found.begin[a + 1 : b], end]
                    turns = np.flatnonzero(np.diff(np.r_[True, drop, True]))  # where what stays begins and ends
                    text = b"".join(part[edges[x] : edges[y]].tobytes() for x, y in turns.reshape(-1, 2)).decode("utf-8", "replace")
                else:
                    text = part[begin:end].tobytes().decode("utf-8", "replace")
                texts.append(text)
                total.append(int(b - a))
                gone.append(np.flatnonzero(drop))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array([len(g) for g in gone], pa.int64()), pa.array(gone, pa.list_(pa.int64())), pa.array(texts, pa.string())],
            ["doc_id", "n_sentences", "n_removed", "removed", "text"],
        )


def later_places(docs: DataFrame) -> DataFrame:
    """doc_id, mark: the spans that another place has before, as first sentence << 32 | sentences."""
    spans = text_or_empty(docs).mapInArrow(_spans, "bucket int, n int, sure boolean, packed binary")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return spans.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_later, "doc_id long, mark long")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, n_removed, removed (their places) and the text left of every document."""
    marks = later_places(docs).groupBy(F.col("doc_id").alias("id")).agg(F.collect_set("mark").alias("marks"))
    return text_or_empty(docs).join(marks, F.col("doc_id").eqNullSafe(F.col("id")), "left").drop("id").mapInArrow(_rebuild, "doc_id long, n_sentences long, n_removed long, removed array<long>, text string")
