"""Quality rules under weak supervision, with DataFrame functions only.

Rules vote good (1) or bad (-1) or abstain (0).  The model: a text is good with some probability; a rule that votes says
"good" with one probability of good texts and with another of bad ones, independently of the other rules; whether it
votes says nothing.  Expectation maximisation estimates these accuracies from the agreement of the rules alone, each
with a weak prior (one vote of either kind), and the posterior probability of being good replaces the demand that all
rules pass.  Which of the two groups is the good one is settled by the starting values only.  EM needs only how many
texts have each pattern of votes: at most 3 ** (number of rules) counts, got by one aggregation over all texts.

Words are runs of characters other than ASCII white space.  ``n_repeat_words`` counts the words inside 8-word windows
that a text holds twice or more; windows are told apart by 64-bit hashes.

Nulls: a null text has no words and fails the base rule; a null doc_id is carried along.  Repeated rows are judged one
by one.  Texts of any length are judged whole; a task holds one text's windows at a time.  A posterior of exactly the
bound is kept.  :func:`keep_good` keeps every column of its input whatever the names.  An empty table gives an empty
result (the starting estimates stand).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8

# Frequent function words of the languages expected.
FUNCTION_WORDS = tuple(
    """the of and to in is that for with on as by it at are this was be from or an de la le les et des en un une que pour dans qui sur par au du
    der die und das den zu mit von ist nicht ein eine für auf sich el los las y por con para una se del""".split()
)


def counted(rows: DataFrame) -> DataFrame:
    """``rows`` (row, text) with the counts the rules look at; ``row`` is carried along untouched."""
    d = rows.select("row", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = d.select("row", "text", F.array_remove(F.split("text", SPACE), "").alias("words"))
    starts = F.sequence(F.lit(1), F.size("words") - (WINDOW - 1))
    windows = F.when(F.size("words") > WINDOW, F.transform(starts, lambda i: F.xxhash64(F.slice("words", i, F.lit(WINDOW)))))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    stops = F.array(*[F.lit(w) for w in FUNCTION_WORDS])
    unlike = F.array_distinct("words")
    d = d.select(
        "row", F.size("words").cast("long").alias("n_words"), windows.alias("windows"), lines.alias("lines"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.char_length(F.regexp_replace("text", r"\P{Lu}+", "")).alias("n_upper"),
        F.char_length(F.regexp_replace("text", r"\P{Ll}+", "")).alias("n_lower"),
        F.size(unlike).alias("n_distinct"),
        F.size(F.array_intersect(unlike, stops)).alias("n_function"),
    )
    again = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.when(again, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    n_lines = F.size("lines")
    d = d.select("*", (n_lines - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), n_lines.alias("n_lines"), placed.alias("placed")).drop("windows", "lines")
    placed = F.col("placed")
    twice = F.filter(placed, lambda x, k: ((k > 0) & (placed[F.greatest(k - 1, F.lit(0))]["h"] == x["h"])) | ((k < F.size(placed) - 1) & (placed[F.least(k + 1, F.size(placed) - 1)]["h"] == x["h"])))
    d = d.select("*", F.sort_array(F.transform(twice, lambda x: x["i"])).alias("at")).drop("placed")
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    covered = F.aggregate("at", zero, lambda a, p: F.struct((p + WINDOW).alias("end"), (a["n"] + p + WINDOW - F.greatest(a["end"], p)).alias("n")), lambda a: a["n"])
    return d.select("*", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words")).drop("at")


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Each rule's vote from the counts; a rule abstains where a text is too short to tell."""
    n, c = F.col("n_words"), F.col
    letters = c("n_upper") + c("n_lower")
    return {
        "length": _vote(n >= 40, n < 20),
        "repeats": _vote((n >= 20) & (20 * c("n_repeat_words") <= n), 10 * c("n_repeat_words") > 3 * n),
        "symbols": _vote(50 * c("n_symbols") <= n, 10 * c("n_symbols") > n),
        "symbol_share": _vote(200 * c("n_symbols") <= c("word_chars"), 30 * c("n_symbols") > c("word_chars")),
        "lines": _vote((c("n_lines") > 1) & (c("n_dup_lines") == 0), 4 * c("n_dup_lines") > c("n_lines")),
        "word_length": _vote((c("word_chars") >= 3 * n) & (c("word_chars") <= 9 * n), (c("word_chars") < 2 * n) | (c("word_chars") > 15 * n)),
        "variety": _vote((n >= 30) & (3 * c("n_distinct") >= n), ((n >= 30) & (n <= 300) & (5 * c("n_distinct") < 2 * n)) | ((n >= 30) & (n <= 2000) & (5 * c("n_distinct") < n))),
        "case": _vote((letters > 0) & (5 * c("n_upper") <= letters), (letters > 20) & (2 * c("n_upper") > letters)),
        "function_words": _vote(c("n_function") >= 6, ((n >= 40) & (c("n_function") < 2)) | ((n >= 80) & (c("n_function") < 4))),
    }


class Votes:
    """What EM has found: the share of good texts and how often each rule that votes says good of good and of bad ones."""

    def __init__(self, names: list[str]):
        self.names = names
        self.good = 0.8
        # most bad texts break few rules, so to start with a good vote says little and a bad one much
        self.says_good = {k: {1: 0.975, 0: 0.7} for k in names}
        self.trace: list[float] = []  # log likelihood and prior before each step; it never falls

    def _logs(self, pattern: tuple[int, ...]) -> tuple[float, float]:
        """Log probability of a pattern's votes together with being good, and with being bad."""
        out = []
        for label, share in ((1, self.good), (0, 1 - self.good)):
            log = math.log(share)
            for name, vote in zip(self.names, pattern):
                if vote:
                    p = self.says_good[name][label]
                    log += math.log(p if vote == 1 else 1 - p)
            out.append(log)
        return out[0], out[1]

    def posterior(self, pattern: tuple[int, ...]) -> float:
        good, bad = self._logs(pattern)
        return 1 / (1 + math.exp(max(-700.0, min(700.0, bad - good))))

    def _objective(self, patterns: dict[tuple[int, ...], int]) -> float:
        total = sum(math.log(p) + math.log(1 - p) for of in self.says_good.values() for p in of.values())
        total += math.log(self.good) + math.log(1 - self.good)
        for pattern, n in patterns.items():
            good, bad = self._logs(pattern)
            high = max(good, bad)
            total += n * (high + math.log(math.exp(good - high) + math.exp(bad - high)))
        return total

    def fit(self, patterns: dict[tuple[int, ...], int], most: int = 500, close: float = 1e-9) -> Votes:
        total = sum(patterns.values())
        for _ in range(most if total else 0):
            self.trace.append(self._objective(patterns))
            if len(self.trace) > 1 and self.trace[-1] - self.trace[-2] <= close * abs(self.trace[-1]):
                break
            post = {p: self.posterior(p) for p in patterns}
            mass = sum(n * post[p] for p, n in patterns.items())
            self.good = (mass + 1) / (total + 2)
            for k, name in enumerate(self.names):
                for label in (1, 0):
                    of = {v: sum(n * (post[p] if label else 1 - post[p]) for p, n in patterns.items() if p[k] == v) for v in (1, -1)}
                    self.says_good[name][label] = (of[1] + 1) / (of[1] + of[-1] + 2)
        return self

    def weight(self, name: str, vote: int) -> float:
        """Log odds that an answer adds."""
        good, bad = self.says_good[name][1], self.says_good[name][0]
        return math.log(good / bad) if vote == 1 else math.log((1 - good) / (1 - bad)) if vote == -1 else 0.0

    def column(self) -> Column:
        odds = F.lit(math.log(self.good / (1 - self.good)))
        for name, vote in rules().items():
            odds = odds + F.when(vote == 1, self.weight(name, 1)).when(vote == -1, self.weight(name, -1)).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


def fit(counts: DataFrame) -> Votes:
    """EM over the patterns of votes of all texts."""
    named = rules()
    rows = counts.groupBy(*[v.alias(k) for k, v in named.items()]).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 3 ** rules
    return Votes(list(named)).fit({tuple(r)[:-1]: r.n for r in rows})


def judged(counts: DataFrame, votes: Votes, least: float = 0.5) -> DataFrame:
    """The counts with ``base_failed``, ``p_good`` and ``kept``."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    d = counts.withColumn("base_failed", failed).withColumn("p_good", votes.column())
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= least))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, p_good and kept for every text."""
    counts = stash(counted(docs.select(F.col("doc_id").cast("long").alias("row"), "text")), "quality")
    return judged(counts, fit(counts)).withColumnRenamed("row", "doc_id")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns.

    Rows are written once with their counts, so that texts are counted once; they are never shuffled.
    """
    counts = stash(counted(docs.select(F.struct("*").alias("row"), "text")), "quality")
    return judged(counts, fit(counts)).where("kept").select("row.*")
