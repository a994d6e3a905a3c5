"""LM scoring: a log-bilinear neural model trained with noise-contrastive estimation in numpy.

A token is the end of a text, a word of the vocabulary (those met ``LEAST_COUNT`` times or more, the ``MOST_WORDS`` most
frequent), or another word, of which the model knows the shape only (how it ends, non-ASCII letters, length).  Vocabulary
words are cut by frequency into bins of equal share.  Ends, shapes and bins are the classes.  The probability of a token
is that of its class after the two tokens before it, times: nothing for an end; for a vocabulary word its probability
among its bin's words, after the same two tokens; for another word (c + 1) / (N_k + V_k + 1) with its count c, where its
shape's training words are N_k tokens of V_k kinds, so words never met have a share too.  All sums are 1.

Every vocabulary word and shape has an embedding as context.  The model predicts an embedding by a linear map of each
of the two contexts; its product with the embedding of a class, or of a word, plus a bias is that one's score.  Every
token of every training text is learned from, where the texts are: documents are dealt to ``ROUNDS`` by a hash of their
ids, and in each round every task goes through all tokens of its texts of the round once, in mixed order, tells them
from noise, and sends on its model; the mean of all, weighed by tokens, is what the next round begins with.  Tasks of
few tokens draw theirs again (``STEPS``).  So counts and steps grow with the input, and the model's size is
bounded by ``MOST_WORDS`` (1.6 MB with what sets the pace).  Batched products then give normalised log-probabilities.

Word counts stay distributed.  The ``hot`` most frequent words' counts go to every task (12 bytes each); other words of
a text are joined with their counts by hash.  Words are told apart by 64-bit hashes.

Nulls: a null text is empty and is one end token.  A null doc_id is learned from and not held out.  Repeated rows are
counted as often as they come and scored one by one.  Texts of any length are learned and scored whole.  Of equally
frequent words the one of the smaller hash comes first.  Extra columns are ignored.  Without training texts every word
is unknown; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, column_bytes, runs_of_rows, signed, stash, text_or_empty, word_hashes

END = 0x5EED_0F_7E57_E4D5  # stands for the end token among the words' hashes
SHAPES = 24
BINS = 64
MOST_WORDS = 4096
LEAST_COUNT = 5
HOT = 100_000
WIDTH = 24
NOISE = 32  # noise classes a step
NOISE_WORDS = 16  # noise words of a bin a step
COUNT_BLOCK = 1 << 21  # counts a task holds before it passes their sums on
BATCH = 2048
ROUNDS = 1, 2, 5  # of eight parts of the documents those that each round learns from; the first end while models are alike
STEPS = 100, 500  # least steps of a task in a round: few tokens are drawn more often
FEW_TOKENS = 4_000_000  # up to so many tokens in all the larger of these counts, beyond fewer in proportion
PARTS = 64  # a model travels in so many rows
AT_ONCE = 1 << 16


def held_out(doc_id: int | None, of: int, which: int) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % of == which


def shapes(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A shape from 0 to SHAPES - 1 for every word."""
    last = raw[stops - 1]
    letter = (last >= 128) | ((last >= 48) & (last <= 57)) | ((last >= 65) & (last <= 90)) | ((last >= 97) & (last <= 122))
    ending = np.where(letter, 0, np.where((last == 46) | (last == 33) | (last == 63), 1, np.where(last == 44, 2, 3)))
    wide = np.r_[0, np.cumsum(raw >= 128)]
    size = np.digitize(stops - starts, (6, 10))
    return (ending * 2 + (wide[stops] > wide[starts])) * 3 + size


class Tokens:
    """The tokens of some rows, an end after each row's words: hash, class, row and whether the row begins there."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        rows, starts, stops, words = word_hashes(raw, offsets)
        n_rows = len(offsets) - 1
        first = runs_of_rows(rows, n_rows)
        total = len(rows) + n_rows
        at = np.arange(len(rows)) + rows
        self.hash = np.full(total, np.uint64(END))
        self.hash[at] = words
        self.shape = np.full(total, -1)
        if len(rows):
            self.shape[at] = shapes(raw, starts, stops)
        self.row = np.full(total, 0)
        self.row[at] = rows
        self.begin = first[:-1] + np.arange(n_rows)  # first token of each row
        self.row[first[1:] + np.arange(n_rows)] = np.arange(n_rows)


def _counts(of: int, which: int):
    def summed(parts):
        h, kind, n = (np.concatenate(x) for x in zip(*parts))
        h, at, own = np.unique(h, return_index=True, return_inverse=True)
        n = np.bincount(own, weights=n, minlength=len(h)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(kind[at].astype(np.int32)), pa.array(n)], ["word", "shape", "n"])

    def run(batches):
        parts, size = [], 0
        for batch in batches:
            raw, offsets = column_bytes(batch.column("text"))
            learn = ~np.array([held_out(d, of, which) for d in batch.column("doc_id").to_pylist()], bool)
            for lo, hi in chunks(offsets):
                t = Tokens(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                keep = learn[lo:hi][t.row]
                h, at, n = np.unique(t.hash[keep], return_index=True, return_counts=True)
                parts.append((h, t.shape[keep][at].astype(np.int8), n.astype(np.int32)))
                size += len(h)
                if size > COUNT_BLOCK:
                    yield summed(parts)
                    parts, size = [], 0
        if parts:
            yield summed(parts)

    return run


class Lexicon:
    """The hot words' hashes (sorted), counts, classes and places in the vocabulary; the bins; each shape's denominator."""

    def __init__(self, hot: list[tuple[int, int, int]], by_shape: dict[int, tuple[int, int]], most_words: int = MOST_WORDS, bins: int = BINS, least: int = LEAST_COUNT):
        self.tokens = sum(n for n, _ in by_shape.values())
        self.kinds = sum(v for _, v in by_shape.values())
        known = [(w, s, n) for w, s, n in hot if s >= 0 and n >= least][:most_words]  # most frequent first
        counts = np.array([n for _, _, n in known], float)
        share = np.cumsum(counts) - counts / 2
        cut = np.unique((share / counts.sum() * bins).astype(np.int64), return_inverse=True)[1] if known else np.zeros(0, np.int64)
        self.words = len(known)
        self.bins = int(cut[-1]) + 1 if known else 0
        self.classes = 1 + SHAPES + self.bins
        self.start = np.searchsorted(cut, np.arange(self.bins + 1))  # bin b has words start[b] .. start[b + 1] - 1
        self.outside = self.words + SHAPES  # the context before a text
        at = {w: i for i, (w, _, _) in enumerate(known)}
        left = {k: list(x) for k, x in by_shape.items()}
        for _, s, n in known:
            left[s][0] -= n
            left[s][1] -= 1
        h = np.array([w for w, _, _ in hot], np.int64).view(np.uint64)
        o = np.argsort(h)
        self.hash = h[o]
        self.count = np.array([n for _, _, n in hot], np.int64)[o]
        self.word = np.array([at.get(w, -1) for w, _, _ in hot], np.int64)[o]
        bin_of = np.r_[cut, 0]
        self.own = np.where(self.word >= 0, 1 + SHAPES + bin_of[self.word], np.array([1 + s for _, s, _ in hot], np.int64)[o])
        self.log_share = np.zeros(self.classes)  # log10 of the shapes' denominators
        self.unigram = np.full(self.classes, 0.5)
        self.unigram[0] += by_shape.get(-1, (0, 0))[0]
        for s in range(SHAPES):
            n, v = left.get(s, (0, 0))
            self.log_share[1 + s] = np.log10(n + v + 1)
            self.unigram[1 + s] += n
        if known:
            self.unigram[1 + SHAPES :] += np.bincount(cut, weights=counts, minlength=self.bins)
        self.unigram /= self.unigram.sum()

    def look_up(self, t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(class, place in the vocabulary or -1, count or -1 where the word isn't hot) of every token."""
        cls, word, count = t.shape + 1, np.full(len(t.hash), -1), np.full(len(t.hash), -1)
        if len(self.hash):
            at = np.minimum(np.searchsorted(self.hash, t.hash), len(self.hash) - 1)
            hit = self.hash[at] == t.hash
            cls, word, count = np.where(hit, self.own[at], cls), np.where(hit, self.word[at], word), np.where(hit, self.count[at], count)
        return cls, word, count

    def contexts(self, t: Tokens, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What stands two before and one before every token."""
        own = np.where(word >= 0, word, self.words + np.maximum(t.shape, 0))
        one, two = np.r_[self.outside, own[:-1]], np.r_[self.outside, self.outside, own[:-2]][: len(own)]
        one[t.begin] = two[t.begin] = self.outside
        second = t.begin + 1
        second = second[(second < len(own)) & ~np.isin(second, t.begin)]
        two[second] = self.outside
        return two, one


def _add_rows(into: np.ndarray, past: np.ndarray, at: np.ndarray, grads: np.ndarray, rate: float) -> None:
    """One AdaGrad step for the rows at some places; a place may come several times."""
    if not len(at):
        return
    o = np.argsort(at.astype(np.min_scalar_type(len(into))), kind="stable")  # numbers of 16 bits are sorted by radix
    begin = np.flatnonzero(np.r_[True, at[o][1:] != at[o][:-1]])
    g, rows = np.add.reduceat(grads[o], begin), at[o][begin]
    past[rows] += g * g
    into[rows] += rate * g / np.sqrt(past[rows])


class LogBilinear:
    """Embeddings of contexts, classes and words, a map for each context place, biases."""

    NAMES = ("context", "near", "far", "target", "bias", "word", "word_bias")

    def __init__(self, lexicon: Lexicon, width: int = WIDTH, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.lexicon = lexicon
        random = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        self.context, self.target, self.word = random(lexicon.outside + 1, width), random(lexicon.classes, width), random(lexicon.words, width)
        self.far, self.near = (np.eye(width, dtype=np.float32) * s for s in (0.3, 0.7))
        self.bias = np.log(lexicon.unigram).astype(np.float32)
        self.word_bias = np.zeros(lexicon.words, np.float32)
        self.past = {k: np.ones_like(getattr(self, k)) for k in self.NAMES}
        self.steps = 0

    def flat(self) -> np.ndarray:
        """All values, their past and the number of steps: what another task needs to go on."""
        return np.concatenate([*(getattr(self, k).ravel() for k in self.NAMES), *(self.past[k].ravel() for k in self.NAMES), [np.float32(self.steps)]])

    def set(self, flat: np.ndarray) -> LogBilinear:
        at = 0
        for into in (self.__dict__, self.past):
            for k in self.NAMES:
                was = into[k]
                into[k] = flat[at : at + was.size].reshape(was.shape).astype(np.float32)
                at += was.size
        self.steps = int(flat[at])
        return self

    def step(self, two: np.ndarray, one: np.ndarray, cls: np.ndarray, word: np.ndarray, rng: np.random.Generator, rate: float = 0.15) -> None:
        """Noise-contrastive estimation on some tokens: classes against noise classes, words against others of their bin.

        The noise is drawn anew at every step, for all of the step's tokens, and for all of a bin.
        """
        lex = self.lexicon
        pace = rate / (1 + self.steps / 400) ** 0.5  # a plain number, so that values stay of 32 bits
        self.steps += 1
        order = np.argsort(cls.astype(np.uint16), kind="stable")
        two, one, cls, word = two[order], one[order], cls[order], word[order]
        q = self.context[two] @ self.far + self.context[one] @ self.near
        edge = np.flatnonzero(np.r_[True, cls[1:] != cls[:-1]])
        met = cls[edge]
        drawn = np.searchsorted(np.cumsum(lex.unigram), rng.random(NOISE)).clip(max=lex.classes - 1)
        log_noise = np.log(NOISE * lex.unigram).astype(np.float32)
        # the share of belief that a data class is noise, and a noise class data
        d_data = 1 / (1 + np.exp((q * self.target[cls]).sum(axis=1) + self.bias[cls] - log_noise[cls]))
        d_noise = -1 / (1 + np.exp(-(q @ self.target[drawn].T + self.bias[drawn] - log_noise[drawn])))
        g_q = d_data[:, None] * self.target[cls] + d_noise @ self.target[drawn]
        grads = {"target": np.zeros_like(self.target), "bias": np.zeros_like(self.bias)}
        grads["target"][met] = np.add.reduceat(d_data[:, None] * q, edge)
        grads["bias"][met] = np.add.reduceat(d_data, edge)
        np.add.at(grads["target"], drawn, d_noise.T @ q)
        np.add.at(grads["bias"], drawn, d_noise.sum(axis=0))
        at = np.searchsorted(cls, 1 + SHAPES)  # words of the vocabulary stand last, by bin
        if at < len(cls):
            bins, first = met[met > SHAPES] - 1 - SHAPES, edge[met > SHAPES]
            runs = list(zip(first.tolist(), [*first[1:].tolist(), len(cls)]))
            size = lex.start[bins + 1] - lex.start[bins]
            other = lex.start[bins][:, None] + (rng.random((len(bins), NOISE_WORDS)) * size[:, None]).astype(np.int64)
            noise = self.word[other]
            log_noise = np.log(NOISE_WORDS / size).astype(np.float32)
            each = np.repeat(np.arange(len(bins)), np.diff(np.r_[first, len(cls)]))
            w, mine, own = word[at:], q[at:], self.word[word[at:]]
            d = 1 / (1 + np.exp((mine * own).sum(axis=1) + self.word_bias[w] - log_noise[each]))
            n = np.empty((len(w), NOISE_WORDS), np.float32)
            for (s, e), x in zip(runs, noise):
                np.matmul(q[s:e], x.T, out=n[s - at : e - at])
            n += (self.word_bias[other] - log_noise[:, None])[each]
            n = -1 / (1 + np.exp(-n))
            g_q[at:] += d[:, None] * own
            moves = np.empty((len(bins), NOISE_WORDS, q.shape[1]), np.float32)
            for (s, e), x, into in zip(runs, noise, moves):
                g_q[s:e] += n[s - at : e - at] @ x
                np.matmul(n[s - at : e - at].T, q[s:e], out=into)
            places = np.concatenate([w, other.ravel()])
            _add_rows(self.word_bias, self.past["word_bias"], places, np.concatenate([d, np.add.reduceat(n, first - at).ravel()]), pace)
            _add_rows(self.word, self.past["word"], places, np.concatenate([d[:, None] * mine, moves.reshape(-1, q.shape[1])]), pace)
        back = np.concatenate([g_q @ self.far.T, g_q @ self.near.T])
        grads["far"], grads["near"] = self.context[two].T @ g_q, self.context[one].T @ g_q
        _add_rows(self.context, self.past["context"], np.concatenate([two, one]), back, pace)
        for k, g in grads.items():
            self.past[k] += g * g
            p = getattr(self, k)
            p += (pace * (0.1 if k in ("far", "near") else 1)) * g / np.sqrt(self.past[k])

    def ready(self) -> LogBilinear:
        """With the contexts' products made once."""
        self.a, self.b = self.context @ self.far, self.context @ self.near
        return self

    def log10(self, two: np.ndarray, one: np.ndarray, cls: np.ndarray, word: np.ndarray) -> np.ndarray:
        """log10 of each token's probability, for a word outside the vocabulary of its class only."""
        out, lex = np.empty(len(cls)), self.lexicon
        for s in range(0, len(cls), AT_ONCE):
            some = slice(s, s + AT_ONCE)
            q = self.a[two[some]] + self.b[one[some]]
            z = q @ self.target.T
            z += self.bias
            np.minimum(z, 80, out=z)
            log = z[np.arange(len(z)), cls[some]].astype(float)
            np.exp(z, out=z)
            log -= np.log(z.sum(axis=1, dtype=np.float64))
            w = word[some]
            own = np.flatnonzero(w >= 0)
            own = own[np.argsort(w[own], kind="stable")]
            edge = np.searchsorted(w[own], lex.start)
            for k in np.flatnonzero((np.diff(edge) > 0) & (np.diff(lex.start) > 1)):
                rows, low, high = own[edge[k] : edge[k + 1]], lex.start[k], lex.start[k + 1]
                y = q[rows] @ self.word[low:high].T
                y += self.word_bias[low:high]
                np.minimum(y, 80, out=y)
                log[rows] += y[np.arange(len(rows)), w[rows] - low]
                np.exp(y, out=y)
                log[rows] -= np.log(y.sum(axis=1, dtype=np.float64))
            out[some] = log / np.log(10)
        return out


def _train(lexicon: Lexicon, of: int, which: int, begun: np.ndarray | None = None):
    """A model of all training tokens of a task, in ``PARTS`` rows, and the number of these tokens."""

    def run(batches):
        model = LogBilinear(lexicon)
        if begun is not None:
            model.set(begun)
        least = max(STEPS[0], min(STEPS[1], STEPS[1] * FEW_TOKENS // max(lexicon.tokens, 1)))
        rng, worth, last, goal = np.random.default_rng(12), 0, [], model.steps + least
        for batch in batches:
            raw, offsets = column_bytes(batch.column("text"))
            learn = ~np.array([held_out(d, of, which) for d in batch.column("doc_id").to_pylist()], bool)
            for lo, hi in chunks(offsets):
                t = Tokens(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                cls, word, _ = lexicon.look_up(t)
                known = np.flatnonzero(learn[lo:hi][t.row])
                if not len(known):
                    continue
                some = [x[known] for x in (*lexicon.contexts(t, word), cls, word)]
                worth += len(known)
                last = (last + [some])[-4:]
                for i in np.array_split(rng.permutation(len(known)), -(-len(known) // BATCH)):
                    model.step(*(x[i] for x in some), rng)
        if not worth:
            return
        while model.steps < goal:
            some = last[int(rng.integers(len(last)))]
            i = rng.integers(0, len(some[0]), min(BATCH, len(some[0])))
            model.step(*(x[i] for x in some), rng)
        parts = np.array_split(model.flat(), PARTS)
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([worth] * PARTS, pa.int64()), pa.array(parts, pa.list_(pa.float32()))], ["part", "worth", "values"])

    return run


def _mean(batches):
    """The mean of each part's values, weighed by worth."""
    sums: dict[int, np.ndarray] = {}
    total: dict[int, int] = {}
    for batch in batches:
        values = batch.column("values")
        for i, (part, worth) in enumerate(zip(batch.column("part").to_pylist(), batch.column("worth").to_pylist())):
            x = values[i].values.to_numpy().astype(float) * worth
            sums[part] = sums[part] + x if part in sums else x
            total[part] = total.get(part, 0) + worth
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([(x / total[k]).astype(np.float32) for k, x in sums.items()], pa.list_(pa.float32()))], ["part", "values"])


_SCORED = "doc_id long, held_out boolean, n_tokens long, hot_known long, hot_logs double, model double, rare array<long>, times array<int>"


def _score(shared, of: int, which: int):
    def run(batches):
        model = shared.value
        lexicon = model.lexicon
        for batch in batches:
            raw, offsets = column_bytes(batch.column("text"))
            docs = batch.column("doc_id").to_pylist()
            out: list[list] = [[] for _ in range(6)]
            for lo, hi in chunks(offsets):
                t = Tokens(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                cls, word, count = lexicon.look_up(t)
                hot = count >= 0
                n = hi - lo
                other = (cls > 0) & (word < 0)
                logs = np.where(hot, np.log10(np.maximum(count, 0) + 1.0), 0.0)
                tokens = model.log10(*lexicon.contexts(t, word), cls, word) + np.where(other, logs - lexicon.log_share[cls], 0.0)
                cut = np.r_[t.begin, len(t.row)]
                out[0] += np.diff(cut).tolist()
                out[1] += np.bincount(t.row, weights=hot, minlength=n).astype(np.int64).tolist()
                out[2] += np.bincount(t.row, weights=logs, minlength=n).tolist()
                out[3] += np.bincount(t.row, weights=tokens, minlength=n).tolist()
                for r in range(n):
                    h, times = np.unique(t.hash[cut[r] : cut[r + 1]][~hot[cut[r] : cut[r + 1]]], return_counts=True)
                    out[4].append(signed(h))
                    out[5].append(times.astype(np.int32))
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int32()))
            cols = [batch.column("doc_id"), pa.array([held_out(d, of, which) for d in docs], pa.bool_()), *(pa.array(v, k) for v, k in zip(out, kinds))]
            yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in _SCORED.split(", ")])

    return run


def _flat(parts: DataFrame) -> np.ndarray | None:
    """The values of one model's parts in order."""
    got = parts.select("part", "values").toArrow()
    rows = dict(zip(got.column("part").to_pylist(), got.column("values").to_pylist()))
    return np.concatenate([np.array(rows[k], np.float32) for k in range(PARTS)]) if rows else None


def train(texts: DataFrame, lexicon: Lexicon, of: int, which: int) -> LogBilinear:
    """Round after round, the mean of what all tasks make of the model before; untrained without any text."""
    model, begun, first = LogBilinear(lexicon), None, 0
    turn = F.pmod(F.xxhash64("doc_id"), F.lit(sum(ROUNDS)))
    for size in ROUNDS:
        some = texts.where((turn >= first) & (turn < first + size))
        first += size
        parts = some.mapInArrow(_train(lexicon, of, which, begun), "part int, worth long, values array<float>")
        now = _flat(parts.repartition(PARTS, "part").mapInArrow(_mean, "part int, values array<float>"))
        begun = begun if now is None else now  # no text may be of a round
    return model if begun is None else model.set(begun)


def score(docs: DataFrame, of: int = 7, which: int = 2, hot: int = HOT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every text.

    Learns from the texts whose crc32(doc_id as text) mod ``of`` is not ``which``.
    """
    texts = text_or_empty(docs)
    words = texts.mapInArrow(_counts(of, which), "word long, shape int, n long").groupBy("word").agg(F.min("shape").alias("shape"), F.sum("n").alias("n"))
    words = stash(words, "words")
    by_shape = {r["shape"]: (r.n, r.v) for r in words.groupBy("shape").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    top = words.orderBy(F.desc("n"), "word").limit(hot).toArrow()  # hot rows at most
    lexicon = Lexicon(list(zip(*(top.column(c).to_pylist() for c in ("word", "shape", "n")))), by_shape)
    model = train(texts, lexicon, of, which)
    model.past.clear()
    shared = docs.sparkSession.sparkContext.broadcast(model.ready())  # of a bounded size: MOST_WORDS words, HOT counts

    scored = stash(texts.mapInArrow(_score(shared, of, which), _SCORED).withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = scored.where(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    n = F.coalesce("n", F.lit(0))
    rare = rare.join(words.select("word", "n"), "word", "left")
    rare = rare.groupBy("row").agg(F.sum(F.col("times") * F.log10(n + 1)).alias("logs"), F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("known"))

    def sure(c: str | Column) -> Column:
        return F.coalesce(c, F.lit(0))

    d = scored.drop("rare", "times").join(rare, "row", "left")
    base = F.col("hot_logs") + sure("logs") - F.col("n_tokens") * F.lit(float(np.log10(lexicon.tokens + lexicon.kinds + 1)))
    return d.select(
        "doc_id", "held_out", "n_tokens", (F.col("hot_known") + sure("known")).cast("long").alias("n_known"), F.lit(lexicon.tokens).cast("long").alias("train_tokens"),
        base.cast("double").alias("base_score"), (F.col("model") + sure("logs")).cast("double").alias("score"),
    )
