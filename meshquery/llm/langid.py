"""Language ID: averaged hashed subword embeddings with a linear softmax.

A text's subwords are the byte pairs and triples of its folded text; each is hashed to one of ``buckets`` embeddings, the
text is the mean of its subwords' embeddings, and a linear layer with softmax gives a probability to every language.
Embeddings and layer are trained by stochastic gradient descent in numpy on a sample of labelled texts: the
``sample`` documents first by a hash of their ids, and of every language the first ``each``, a text of a document and
language.  So the sample grows with the number of languages only.  One in five of a language is held back: it sets the
temperature of the softmax and the probability below which a prediction is not ``accepted``.

As the mean goes through linear layers only, a prediction needs one row of ``buckets x languages`` scores a subword.

Nulls and texts without a letter are ``und`` with score 0.  Rows without lang or id are not learned from but predicted.
Repeated rows are predicted alike.  Extra columns are ignored.  With nothing to learn from, every text is ``und``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import _FOLD, chunks, column_bytes, text_or_empty

BUCKETS = 1 << 13
WIDTH = 16
SAMPLE = 4000
EACH = 1000  # documents of every language; Spark drops later ones before the shuffle up to this number
EPOCHS = 12


def subwords(raw: np.ndarray) -> np.ndarray:
    """Buckets at every byte: of the pair, then of the triple that begins there (shorter at the end)."""
    b = _FOLD[raw].astype(np.uint32)
    b = np.r_[b, np.uint32(32), np.uint32(32)]
    pair = b[:-2] * np.uint32(257) + b[1:-1]
    triple = pair * np.uint32(263) + b[2:]
    both = np.stack([pair * np.uint32(0x9E3779B1), triple * np.uint32(0x85EBCA77)], axis=1)
    return (both >> np.uint32(32 - 13)).astype(np.int64)


def _histograms(batches):
    for batch in batches:
        raw, offsets = column_bytes(batch.column("text"))
        found = [np.unique(subwords(raw[a:b]).ravel(), return_counts=True) for a, b in zip(offsets[:-1], offsets[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array([h.astype(np.int32) for h, _ in found], pa.list_(pa.int32())), pa.array([c.astype(np.int32) for _, c in found], pa.list_(pa.int32()))], ["lang", "bucket", "n"])


class Model:
    """``scores``: a row of logits for each bucket; ``bias``; ``temperature``; ``accept``."""

    def __init__(self, languages: list[str], rows: list[tuple[str, list[int], list[int]]], seed: int = 7):
        self.languages = languages
        rng = np.random.default_rng(seed)
        c = len(languages)
        table = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
        layer = rng.normal(0, 0.1, (WIDTH, c)).astype(np.float32)
        bias = np.zeros(c, np.float32)
        label = np.array([languages.index(lang) for lang, _, _ in rows], np.int64)
        held = (np.arange(len(rows)) - np.searchsorted(label, label)) % 5 == 4  # by place in the language, rows being sorted
        train = np.flatnonzero(~held)
        for epoch in range(EPOCHS):
            rate = 2.0 * (1 - epoch / EPOCHS)
            order = rng.permutation(train)
            for k in range(0, len(order), 64):
                some = order[k : k + 64]
                x = self._dense(rows, some)
                hidden = x @ table
                p = self._softmax(hidden @ layer + bias)
                p[np.arange(len(some)), label[some]] -= 1
                p /= len(some)
                back = p @ layer.T
                layer -= rate * (hidden.T @ p)
                bias -= rate * p.sum(axis=0)
                table -= (rate * 20) * (x.T @ back)  # a text touches a bucket with a small share of its weight
        self.scores = (table @ layer).astype(np.float32)
        self.bias = bias
        self.temperature, self.accept = 1.0, 0.0
        check = np.flatnonzero(held)
        if len(check):
            logits = self._dense(rows, check) @ self.scores + bias
            right = (np.arange(len(check)), label[check])
            self.temperature = float(min(np.geomspace(0.02, 5, 60), key=lambda t: -np.log(self._softmax(logits / t)[right] + 1e-12).mean()))
            p = self._softmax(logits / self.temperature)
            good = p.argmax(axis=1) == label[check]
            self.accept = float(np.quantile(p.max(axis=1)[good], 0.01)) if good.any() else 1.0

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    @staticmethod
    def _dense(rows: list, some: np.ndarray) -> np.ndarray:
        x = np.zeros((len(some), BUCKETS), np.float32)
        for k, i in enumerate(some):
            n = np.array(rows[i][2], np.float32)
            x[k, np.array(rows[i][1], np.int64)] = n / max(1.0, n.sum())
        return x

    def predict(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probabilities for texts that are not empty."""
        sums = np.empty((len(offsets) - 1, len(self.languages)))
        for k, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
            at = subwords(raw[a:b]).ravel()
            sums[k] = np.bincount(at, minlength=BUCKETS) @ self.scores / len(at) if len(at) > BUCKETS // 4 else self.scores[at].mean(axis=0)
        return self._softmax((sums + self.bias) / self.temperature)


def _has_letter(text: str) -> bool:
    return any(ch.isalpha() for ch in text)


def _predict(model: Model | None):
    letters = np.zeros(256, bool)
    letters[65:91] = letters[97:123] = True

    def run(batches):
        for batch in batches:
            raw, offsets = column_bytes(batch.column("text"))
            n = batch.num_rows
            lang, score, ok = ["und"] * n, [0.0] * n, [False] * n
            known = np.r_[0, np.cumsum(letters[raw])]
            plain = known[offsets[1:]] > known[offsets[:-1]]
            live = [i for i in range(n) if offsets[i + 1] > offsets[i] and (plain[i] or _has_letter(raw[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")))]
            for i in live if model else ():
                p = model.predict(raw, offsets[i : i + 2])[0]
                k = int(p.argmax())
                lang[i], score[i], ok[i] = model.languages[k], float(p[k]), bool(p[k] >= model.accept)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(ok, pa.bool_())], ["doc_id", "lang_pred", "score", "accepted"])

    return run


def train(docs: DataFrame, learn: Column, sample: int = SAMPLE, each: int = EACH) -> Model | None:
    """A model from ``sample`` documents and ``each`` of every language, with text and lang and where ``learn`` holds."""
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang", "text")
    ids = rows.select("lang", "doc_id").distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    picked = ids.orderBy(F.xxhash64("doc_id"), "doc_id", "lang").limit(sample)
    picked = picked.union(ids.withColumn("place", place).where(F.col("place") <= each).drop("place")).distinct()
    rows = rows.join(F.broadcast(picked), ["lang", "doc_id"], "left_semi").groupBy("lang", "doc_id").agg(F.min("text").alias("text"))  # ids may repeat
    got = rows.select("lang", "text").mapInArrow(_histograms, "lang string, bucket array<int>, n array<int>").toArrow()
    data = sorted(zip(*(got.column(c).to_pylist() for c in ("lang", "bucket", "n"))))
    languages = sorted({r[0] for r in data})
    return Model(languages, data) if data else None


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, accepted of every text."""
    return text_or_empty(docs).mapInArrow(_predict(model), "doc_id long, lang_pred string, score double, accepted boolean")
