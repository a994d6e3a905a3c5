"""Quality classifier: a generalised additive model with pairwise interactions, boosted by turns.

A text's features (:data:`FEATURES`, all from its whole bytes) are cut into bins at quantiles.  The model's log odds are
the sum of one number for each feature's bin and one for each chosen pair's cell.  Boosting goes round the features: each in
turn gets a tree of at most four leaves over its bins, fitted to the gradient of the log loss, and the tree's leaf values
are added to the feature's table.  Then those pairs are chosen whose cells explain most of what is left, and boosted by
turns alike, with trees that cut either axis.  One in five of the sample is held back: boosting stops where its loss is least.
The result is nothing but lookup tables, so scoring is finding bins and adding numbers, for a batch of texts at once.

The sample is bounded: of each label the ``each`` documents first by a hash of their ids, weighted so that the labels keep
their shares.  Only its features, not its texts, come to the driver.  Everything else runs over all rows, without shuffles.

Nulls and empty texts have features of zero and are scored like all others.  Rows without doc_id are scored and never
learned from, nor are labels that are null.  A document with several labels counts as good if one of them is 1; repeated rows
of one doc_id count once in the sample and are scored one by one, alike.  Texts of any length are measured whole, in
segments.  Extra columns are ignored.  An empty table gives an empty result; with no label to learn from the score is 0.5
for every text, and with one label only it is near that label for every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, column_bytes, mix, text_or_empty, word_hashes

EACH = 10_000  # documents of each label to learn from
BINS, COARSE = 32, 8  # of a feature, and of each side of a pair
ROUNDS, PAIR_ROUNDS, PAIRS = 150, 60, 8
RATE, RIDGE = 0.2, 1.0

FEATURES = (
    "log_words", "log_bytes", "word_bytes", "symbols", "capitals", "exclamations", "digits", "stops", "not_ascii", "marked_words", "bare_words", "short_words", "long_words",
    "variety", "stutter", "most_frequent", "pair_variety", "run_variety", "repeated_lines", "line_words",
)

_CLASSES = {"symbols": b"#*$%&|<>", "exclamations": b"!", "digits": b"0123456789", "stops": b".?!;:", "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123))}
_IN = {k: np.isin(np.arange(256), list(v)) for k, v in _CLASSES.items()}
_BARE = ~(_IN["digits"] | _IN["upper"] | _IN["lower"] | (np.arange(256) >= 128))
_MARK = _IN["symbols"] | _IN["exclamations"]


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.r_[0, np.cumsum(flags, dtype=np.int64)]
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _variety(rows: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many different hashes each row has, and how often its most frequent one stands there."""
    different, most = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if len(rows):
        order = np.lexsort((hashes, rows))
        r, h = rows[order], hashes[order]
        at = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (h[1:] != h[:-1])])
        different = np.bincount(r[at], minlength=n)
        np.maximum.at(most, r[at], np.diff(np.r_[at, len(r)]))
    return different, most


def _measure(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of features for every text; ratios of nothing are 0."""
    n = len(offsets) - 1
    rows, starts, stops, hashes = word_hashes(raw, offsets)
    size, words = np.diff(offsets), np.bincount(rows, minlength=n)
    of = {k: _per_row(flags[raw], offsets) for k, flags in _IN.items()}
    length = stops - starts
    bare = np.r_[0, np.cumsum(_BARE[raw], dtype=np.int64)]

    def share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
        return part / np.maximum(whole, 1)

    def count(flags: np.ndarray) -> np.ndarray:
        return np.bincount(rows[flags], minlength=n)

    def runs(width: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and hashes of all runs of so many words."""
        k = max(len(rows) - width + 1, 0)
        whole = rows[:k] == rows[len(rows) - k :]
        h = np.zeros(k, np.uint64)
        for j in range(width):
            h = mix(h * np.uint64(0x9FB21C651E98DF25) + hashes[j : j + k])
        return rows[:k][whole], h[whole]

    different, most = _variety(rows, hashes, n)
    varied = {}
    for width in (2, 5):
        r, h = runs(width)
        varied[width] = share(_variety(r, h, n)[0], np.bincount(r, minlength=n))
    same = np.zeros(len(rows), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    lines = [[x for x in raw[a:b].tobytes().split(b"\n") if x.strip()] for a, b in zip(offsets[:-1], offsets[1:])]
    n_lines = np.array([len(x) for x in lines], np.int64)
    again = np.array([len(x) - len(set(x)) for x in lines], np.int64)
    found = {
        "log_words": np.log1p(words), "log_bytes": np.log1p(size), "word_bytes": share(np.bincount(rows, length, n), words), "symbols": share(of["symbols"], size),
        "capitals": share(of["upper"], of["upper"] + of["lower"]), "exclamations": share(of["exclamations"], size), "digits": share(of["digits"], size), "stops": share(of["stops"], words),
        "not_ascii": share(_per_row(raw >= 128, offsets), size), "marked_words": share(count(_MARK[raw[stops - 1]]), words), "bare_words": share(count(bare[stops] - bare[starts] == length), words),
        "short_words": share(count(length <= 3), words), "long_words": share(count(length > 12), words), "variety": np.log1p(different) / np.log1p(np.maximum(words, 1)), "stutter": share(count(same), words),
        "most_frequent": share(most, words), "pair_variety": varied[2], "run_variety": varied[5], "repeated_lines": share(again, n_lines), "line_words": np.log1p(share(words, n_lines)),
    }
    return np.stack([found[k] for k in FEATURES], axis=1)


def features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Features of a batch of texts, measured about a megabyte at a time."""
    parts = [_measure(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in chunks(offsets)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


# --- the model -------------------------------------------------------------------------------------------------


def _cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The best place to cut a row of bins in two by their summed gradients and curvatures, and its gain."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gain = left_g**2 / (left_h + RIDGE) + right_g**2 / (right_h + RIDGE) - g.sum() ** 2 / (h.sum() + RIDGE)
    k = int(gain.argmax())
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Values of a tree over a feature's bins (one axis) or a pair's cells (two axes), constant in each of its leaves."""
    if depth:
        cuts = [_cut(g.sum(axis=tuple(a for a in range(g.ndim) if a != axis)), h.sum(axis=tuple(a for a in range(g.ndim) if a != axis))) for axis in range(g.ndim)]
        axis = int(np.argmax([c[0] for c in cuts]))
        gain, at = cuts[axis]
        if gain > 1e-9:
            sides = [(g.take(r, axis), h.take(r, axis)) for r in (range(at), range(at, g.shape[axis]))]
            return np.concatenate([_tree(*s, depth - 1) for s in sides], axis=axis)
    return np.full(g.shape, g.sum() / (h.sum() + RIDGE))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Model:
    """``tables``: a number for each bin of each feature; ``pairs`` and ``cells``: the same for pairs of features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray):
        held = np.arange(len(y)) % 5 == 4  # the rows come in an order by hash
        w = weight / weight.mean()
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        self.coarse = [np.unique(np.quantile(c, np.linspace(0, 1, COARSE + 1)[1:-1])) for c in x.T]
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        self.pairs: list[tuple[int, int]] = []
        self.cells: list[np.ndarray] = []
        self.bias = float(np.log(((w * y).sum() + 1) / ((w * (1 - y)).sum() + 1)))
        if len(np.unique(y)) < 2:
            return
        bins, coarse = self._bins(x)
        self.tables = self._boost([bins[:, f] for f in range(x.shape[1])], [t.shape for t in self.tables], np.full(len(y), self.bias), y, w, held, ROUNDS)
        z = self.bias + sum(t[bins[:, f]] for f, t in enumerate(self.tables))
        sides = [len(c) + 1 for c in self.coarse]
        g, h = self._slopes(z, y, w * ~held)
        gains = []
        for i in range(x.shape[1]):
            for j in range(i):
                cell = coarse[:, i] * sides[j] + coarse[:, j]
                gg, hh = (np.bincount(cell, v, sides[i] * sides[j]).reshape(sides[i], sides[j]) for v in (g, h))
                value = _tree(gg, hh)
                gains.append((float((value * gg).sum()), i, j))
        self.pairs = [(i, j) for gain, i, j in sorted(gains, reverse=True)[:PAIRS] if gain > 1e-9]
        places = [coarse[:, i] * sides[j] + coarse[:, j] for i, j in self.pairs]
        self.cells = self._boost(places, [(sides[i], sides[j]) for i, j in self.pairs], z, y, w, held, PAIR_ROUNDS)

    @staticmethod
    def _slopes(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = _sigmoid(z)
        return w * (y - p), w * p * (1 - p)

    def _boost(self, places: list[np.ndarray], shapes: list[tuple[int, ...]], z: np.ndarray, y: np.ndarray, w: np.ndarray, held: np.ndarray, rounds: int) -> list[np.ndarray]:
        """Tables after the round that leaves the held-back rows the least loss."""

        def loss() -> float:
            p = np.clip(_sigmoid(z), 1e-9, 1 - 1e-9)
            return float(-(w * held * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum())

        z, now = z.copy(), [np.zeros(s) for s in shapes]
        best, least = [t.copy() for t in now], loss()
        for _ in range(rounds):
            for k, (at, shape) in enumerate(zip(places, shapes)):
                g, h = (np.bincount(at, v, int(np.prod(shape))).reshape(shape) for v in self._slopes(z, y, w * ~held))
                step = RATE * _tree(g, h)
                now[k] += step
                z += step.ravel()[at]
            if (new := loss()) < least:
                best, least = [t.copy() for t in now], new
        return best

    def _bins(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fine, wide = (np.stack([np.searchsorted(c, x[:, f], "right") for f, c in enumerate(cuts)], axis=1) for cuts in (self.cuts, self.coarse))
        return fine, wide

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for every row of features."""
        fine, wide = self._bins(x)
        z = np.full(len(x), self.bias)
        for f, table in enumerate(self.tables):
            z += table[fine[:, f]]
        for (i, j), cell in zip(self.pairs, self.cells):
            z += cell[wide[:, i], wide[:, j]]
        return _sigmoid(z)


# --- on Spark --------------------------------------------------------------------------------------------------


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = features(*column_bytes(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "label", "x"])


def sampled(labels: DataFrame, learn: Column, each: int = EACH) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, label of at most ``each`` documents of each label, and how many each has.  ``labels``: doc_id, quality.

    A share of the hash range that holds about ``each`` is taken before anything is sorted.
    """
    known = labels.where(learn & F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.max((F.col("quality") == 1).cast("int")).alias("label")).withColumn("at", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)))
    n = {r.label: r.n for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    parts = [known.where((F.col("label") == k) & (F.col("at") <= int((1 << 30) * min(1.0, 1.2 * each / c)))).orderBy("at", "doc_id").limit(each) for k, c in n.items()]
    picked = parts[0] if parts else known
    for p in parts[1:]:
        picked = picked.unionByName(p)
    return picked.select("doc_id", "label"), n


def train(docs: DataFrame, labels: DataFrame, learn: Column, each: int = EACH) -> Model | None:
    """A model from a bounded sample of the labelled documents where ``learn``, an expression of doc_id, holds."""
    picked, n = sampled(labels, learn, each)
    rows = text_or_empty(docs).join(F.broadcast(picked), "doc_id")  # 2 x each ids
    rows = rows.mapInArrow(_features, "doc_id long, label int, x array<double>").groupBy("doc_id").agg(F.min(F.struct("label", "x")).alias("row"))  # ids may repeat
    got = rows.select("doc_id", "row.label", "row.x").orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()
    if not got.num_rows:
        return None
    y = np.asarray(got.column("label"), float)
    x = np.array(got.column("x").to_pylist(), float)
    share = {k: n.get(k, 0) / max(1, int((y == k).sum())) for k in (0, 1)}
    return Model(x, y, np.where(y == 1, share[1], share[0]))


def _score(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.score(features(*column_bytes(batch.column("text")))) if model else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p, pa.float64())], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score, the probability of label 1, of every text."""
    return text_or_empty(docs).mapInArrow(_score(model), "doc_id long, score double")
