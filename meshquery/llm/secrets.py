"""Secret scans: fixed patterns, and dictionary-primed zstandard novelty.

The patterns (an assignment to a name such as password, an access key, a long run of hex digits) give the base spans.

Novelty adds strings which no pattern knows.  A candidate is an unbroken run of at least ``least`` token characters
(letters, digits or both) that ends or begins within ``near`` characters of a sensitive word, on either side.  Its
marginal size is what zstandard needs for the surroundings (``around`` characters a side) with it less what it needs
without it, primed with a dictionary of identifiers.  Literals are stored as they are, so words, names, paths and
repeated strings cost little, and a key costs a byte a character.  Candidates whose marginal bytes reach ``ratio`` of
their length are reported, if no base span overlaps them.

The dictionary is learned from all texts (:func:`learn`): identifiers in the surroundings of sensitive words, by the
number of different words that stand before them, so that a key in thousands of copies of one text is none.  What could be
a candidate itself (a run of ``least`` characters or more) only enters if the shorter ones make it small by the same measure or
if it reads like words (:func:`like_words`), and no part of it is taken for a shorter one, so a key doesn't hide itself,
however often and wherever it stands.  The ``DICTIONARY_BYTES`` of
those met in most contexts follow a few common ones.

Offsets are code points, ends exclusive.  Nulls: a null text is empty, a null doc_id is carried along.  Texts of any
length are scanned whole, in time linear in them.  Repeated rows are scanned one by one and give the same spans.  Spans
that begin at one place go by kind.  Extra columns are ignored by :func:`scan` and kept by :func:`redact`.  An empty table
gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from functools import reduce

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so short ones need no match of their own
SENSITIVE = re.compile(r"(?:passw(?:or)?d|secret|token|api[ _-]?key|credential|private[ _-]?key|auth|bearer|access[ _-]?key)", re.I | re.A)
#: every span has one of these in it or before it, in either case, or is a run of hex digits
SIGNS = ("passw", "secret", "token", "api", "credential", "private", "auth", "bearer", "access", "akia")
RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
IDENTIFIER = re.compile(r"[A-Za-z][A-Za-z0-9_]{3,40}")

COMMON = (
    "the and that with from this have which password secret token key value config environment variable access private public "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 https http www example com org github "
    "authentication authorization application client server service account user username get_ set_ is_ has_ to_string "
    "getElementById addEventListener configuration implementation initialize parameters arguments connection database "
    "import export function return class const static void string integer boolean default undefined null true false"
)

LEAST = 16  # shorter runs are as often words that no dictionary has: of sf0.1's 8 from 12 to 15 characters none was a key
NEAR = 40
AROUND = 200
RATIO = 0.8
CONTEXTS = 3  # different words before an identifier
DICTIONARY_BYTES = 1 << 15
MOST_IDENTIFIERS = 1 << 13


class Novelty:
    """A compressor primed with a dictionary."""

    def __init__(self, identifiers: bytes = b""):
        # the fast strategy with a target length stores literals as they are; matches nearest to the end are cheapest
        params = zstandard.ZstdCompressionParameters(window_log=17, chain_log=14, hash_log=15, search_log=1, min_match=4, target_length=1, strategy=zstandard.STRATEGY_FAST, write_checksum=False, write_content_size=False, write_dict_id=False)
        primed = zstandard.ZstdCompressionDict(COMMON.encode() + b" " + identifiers, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self._packer = zstandard.ZstdCompressor(compression_params=params, dict_data=primed)

    def size(self, data: bytes) -> int:
        return len(self._packer.compress(data))

    def of(self, text: str, start: int, end: int, around: int = AROUND) -> float:
        """Marginal compressed bytes a character of text[start:end], given what stands around it."""
        beside = (text[max(0, start - around) : start] + " " + text[end : end + around]).encode("utf-8", "replace")
        both = beside + b" " + text[start:end].encode("utf-8", "replace")
        return (self.size(both) - self.size(beside)) / max(1, end - start)


_primed: dict[bytes, Novelty] = {}


def novelty(identifiers: bytes = b"") -> Novelty:
    """The compressor of a dictionary; a worker keeps one."""
    if identifiers not in _primed:
        _primed.clear()
        _primed[identifiers] = Novelty(identifiers)
    return _primed[identifiers]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def novel_spans(text: str, base: list[tuple[int, int, str]], primed: Novelty | None = None, least: int = LEAST, near: int = NEAR, ratio: float = RATIO, around: int = AROUND) -> list[tuple[int, int, str]]:
    """Candidates beside sensitive words that are new; words, runs and base spans are walked through side by side."""
    words = [m.span() for m in SENSITIVE.finditer(text)]
    if not words:
        return []
    primed = primed or novelty()
    begins, ends = [a for a, _ in words], [b for _, b in words]  # both ascending
    covered: list[list[int]] = []  # base spans, overlapping ones as one
    for a, b, _ in base:
        if covered and a < covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], b)
        else:
            covered.append([a, b])
    out, at = [], 0
    for m in RUN.finditer(text):
        start, end = m.span()
        if end - start < least:
            continue
        while at < len(covered) and covered[at][1] <= start:
            at += 1
        before = bisect_right(ends, start) - 1  # the last word that ends before the run
        after = bisect_left(begins, end)  # the first that begins after it
        beside = before >= 0 and start - ends[before] <= near or after < len(begins) and begins[after] - end <= near
        inside = bisect_left(begins, start) < bisect_left(begins, end)  # the word is a part of the run
        if not (beside or inside) or at < len(covered) and covered[at][0] < end:
            continue
        if primed.of(text, start, end, around) >= ratio:
            out.append((start, end, "novel"))
    return out


def spans_of(text: str, identifiers: bytes = b"") -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans), each by start, then kind."""
    base = base_spans(text)
    every = sorted(base + novel_spans(text, base, novelty(identifiers)), key=lambda s: (s[0], KINDS.index(s[2])))
    return base, every


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def _may_hold(text: Column) -> Column:
    """Texts with any sign of a span; most have none."""
    low = F.lower(text)
    return F.coalesce(reduce(Column.__or__, [low.contains(sign) for sign in SIGNS], text.rlike("[0-9a-f]{24}")), F.lit(False))


def like_words(run: str) -> bool:
    """Letters only, joined by signs; a quarter of them vowels, never six consonants in a row, and few changes of case."""
    letters = re.sub(r"[/_=+-]", "", run)
    return (
        letters.isalpha() and 4 * len(re.findall("[aeiouy]", letters, re.I)) >= len(letters) and not re.search("[b-df-hj-np-tv-xz]{6}", letters, re.I)
        and 5 * len(re.findall("(?=[a-z][A-Z])", run)) <= len(letters)
    )


def _identifiers(batches):
    """Distinct (identifier, hash of the word before it) in the surroundings of sensitive words; long runs stand whole."""
    for batch in batches:
        found: set[tuple[str, int]] = set()
        for text in batch.column("text").to_pylist():
            upto = 0
            for m in SENSITIVE.finditer(text):
                low, high = max(upto, m.start() - AROUND), m.end() + AROUND
                last = ""
                for run in RUN.finditer(text, low, high):
                    start, end = run.span()
                    if start == low > 0 and RUN.match(text[low - 1]) or end == high < len(text) and RUN.match(text[high]):
                        continue  # a part of a run that goes on outside could be one of a key
                    for word in (run[0],) if end - start >= LEAST else IDENTIFIER.findall(run[0]):
                        found.add((word, zlib.crc32(last.encode())))
                        last = word
                upto = max(upto, high)
        rows = sorted(found)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), pa.array([c for _, c in rows], pa.int64())], ["identifier", "before"])


def learn(docs: DataFrame, contexts: int = CONTEXTS, most_bytes: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary of identifiers that stand near sensitive words after ``contexts`` different words at least.

    All texts count; those met in most contexts are taken up to a fixed size and stand last, where matches cost least.
    """
    texts = docs.where(_may_hold(F.col("text"))).select("text")
    met = texts.mapInArrow(_identifiers, "identifier string, before long").distinct()
    met = met.groupBy("identifier").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= contexts)
    short, long = (met.where(c).orderBy(F.desc("n"), "identifier").limit(MOST_IDENTIFIERS).collect() for c in (F.length("identifier") < LEAST, F.length("identifier").between(LEAST, AROUND)))  # at most so many rows each

    def fitting(rows: list) -> list:
        out, size = [], 0
        for r in rows:
            size += len(r.identifier) + 1
            if size > most_bytes:
                break
            out.append(r)
        return out

    short = fitting(short)
    primed = Novelty(" ".join(r.identifier for r in reversed(short)).encode())
    known = [r for r in long if like_words(r.identifier) or primed.of(r.identifier, 0, len(r.identifier)) < RATIO]
    out = fitting(sorted(short + known, key=lambda r: (-r.n, r.identifier)))
    return " ".join(r.identifier for r in reversed(out)).encode()


_SPANS = "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_spans string, spans string"


def _scan(identifiers: bytes):
    def run(batches):
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                base, every = spans_of(text, identifiers)
                rows.append((doc, *(sum(k == kind for _, _, k in every) for kind in KINDS), joined(base), joined(every)))
            cols = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [c.split()[0] for c in _SPANS.split(", ")])

    return run


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base_spans and spans (``kind:start:end``, comma-joined) of every text."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return texts.mapInArrow(_scan(learn(docs)), _SPANS)


def masked(text: str | None, identifiers: bytes = b"") -> str | None:
    """The text with every span replaced by ``[kind]``; overlapping spans by one mark."""
    if not text:
        return text
    every = spans_of(text, identifiers)[1]
    if not every:
        return text
    out, at = [], 0
    for start, end, kind in every:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with the secrets in ``text`` replaced by marks, and ``n_chars`` (if there) set to match."""
    identifiers = learn(docs)

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array([masked(t, identifiers) for t in batch.column(at).to_pylist()], batch.schema.field(at).type))

    may = _may_hold(F.col("text"))
    out = docs.where(may).mapInArrow(run, docs.schema)  # most texts have no sign of a secret and stay as they are
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(kind)).select(*docs.columns)
    return out.unionAll(docs.where(~may))
