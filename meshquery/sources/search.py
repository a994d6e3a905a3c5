"""Full-text search over source texts (S13): a stored index of words and their positions, and searches that read it.

The index has a row for each word, field and file: ``term``, ``field`` (file, content or package), ``file``, and the
word's ``positions`` in that field, counted from 0.  Words are runs of letters and digits in lower case.  Stored, it is
partitioned by ``shard``, the first digits of the word's MD5, and sorted by word, so a search opens the shards of its
words and skips the row groups of others.  Batches of files can be added one after the other (``batch``): the files table
says what each batch held, and of a file that came again the latest batch counts.

Words of a search are folded like those of the texts, so searches take texts; no search has a syntax of its own.
A null field has no words.  A file met twice in one batch is read as one file with the words of both.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import Graph, exists

FIELDS = ("file", "content", "package")
POSTINGS = "term string, field string, file string, positions array<int>, batch long, shard string"
FILES = "file string, package string, n_tokens long, batch long"
SHARD_DIGITS = 1
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6  # of the ranking; fixed values that clients' ranks depend on


def folded(text: Column) -> Column:
    """Lower case, without diacritics of the Latin letters most often met."""
    return F.translate(F.lower(text), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def tokens(text: Column) -> Column:
    """Runs of letters and digits."""
    return F.array_remove(F.split(folded(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def words(spark: SparkSession, text: str) -> list[str]:
    """The words of a search text, in order."""
    return spark.range(1).select(tokens(F.lit(text)).alias("t")).first().t


def postings(sources: DataFrame, batch: int = 0, digits: int = SHARD_DIGITS) -> DataFrame:
    """The index of ``sources`` (file, content, package).  A file's words meet in its own task before anything is shuffled."""
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), tokens(F.col(f)).alias("words")) for f in FIELDS]))
    at = sources.select("file", fields.alias("x")).select("file", "x.field", F.posexplode("x.words").alias("position", "term"))
    rows = at.groupBy("term", "field", "file").agg(F.array_sort(F.collect_set("position")).alias("positions"))
    return rows.select("term", "field", "file", "positions", F.lit(batch).cast("long").alias("batch"), F.substring(F.md5(F.col("term").cast("binary")), 1, digits).alias("shard"))


def listed_files(sources: DataFrame, batch: int = 0) -> DataFrame:
    """The files of a batch and how many words they have in all fields."""
    n = sum((F.size(tokens(F.col(f))) for f in FIELDS), F.lit(0)).cast("long")
    return sources.groupBy("file").agg(F.max("package").alias("package"), F.sum(n).alias("n_tokens")).select("file", "package", "n_tokens", F.lit(batch).cast("long").alias("batch"))


def ordered(rows: DataFrame) -> DataFrame:
    """Postings by shard and word in the tasks that grouped them: they aren't shuffled by shard again, and each task writes its part of a shard."""
    return rows.sortWithinPartitions("batch", "shard", "term")


def write_batch(sources: DataFrame, path: str, batch: int = 0, digits: int = SHARD_DIGITS) -> None:
    """Add a batch to the index in ``path``; written again, it takes the place of its own partitions only."""

    def put(df: DataFrame, name: str, *by: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*by).parquet(f"{path}/{name}")

    put(ordered(postings(sources, batch, digits)), "postings", "batch", "shard")
    put(listed_files(sources, batch), "files", "batch")


@dataclass
class Index:
    """postings and files; ``digits``: of the shard, 0 where the postings aren't stored by shard."""

    postings: DataFrame
    files: DataFrame
    digits: int = SHARD_DIGITS

    @classmethod
    def load(cls, spark: SparkSession, path: str, digits: int = SHARD_DIGITS) -> Index:
        """Of files that came more than once the latest batch; where there is one batch nothing has to be looked up."""
        rows = spark.read.schema(POSTINGS).parquet(f"{path}/postings")
        files = spark.read.schema(FILES).parquet(f"{path}/files")
        if len(files.select("batch").distinct().take(2)) > 1:
            latest = Window.partitionBy("file").orderBy(F.desc("batch"))
            files = files.withColumn("_k", F.row_number().over(latest)).where("_k = 1").drop("_k")
            rows = rows.join(files.select("file", "batch"), ["file", "batch"], "left_semi")
        return cls(rows, files, digits)

    @classmethod
    def of(cls, g: Graph) -> Index:
        """The index of a graph's sources; for a stored graph it is stored beside it and made once."""
        if g.path is None:
            return cls(postings(g.sources), listed_files(g.sources))
        path = f"{g.path}/derived-search"
        if not exists(g.spark, f"{path}/files/batch=0"):  # written last; partitions that are replaced one by one leave no _SUCCESS
            write_batch(g.sources, path)
        return cls.load(g.spark, path)

    def rows(self, wanted: list[str]) -> DataFrame:
        """The rows of some words; only their shards are read."""
        shards = sorted({hashlib.md5(w.encode()).hexdigest()[: self.digits] for w in wanted})
        d = self.postings.where(F.col("term").isin(*wanted)) if wanted else self.postings.limit(0)
        return d.where(F.col("shard").isin(*shards)) if self.digits and wanted else d

    # --- searches: file and hits ---------------------------------------------------------------------------

    def every(self, text: str) -> DataFrame:
        """Files that hold all words of a text; hits: how often any of them stands there."""
        wanted = sorted(set(words(self.postings.sparkSession, text)))
        d = self.rows(wanted).groupBy("file").agg(F.count_distinct("term").alias("found"), F.sum(F.size("positions")).cast("long").alias("hits"))
        return d.where(F.col("found") == len(wanted)).select("file", "hits")

    def phrase(self, text: str) -> DataFrame:
        """Files in one field of which the words stand one after the other; hits: how often.

        Each word's positions are moved back by its place in the phrase; where all words agree the phrase begins.
        """
        spark = self.postings.sparkSession
        wanted = words(spark, text)
        places = spark.createDataFrame(list(enumerate(wanted)), "place int, term string")
        at = self.rows(sorted(set(wanted))).join(F.broadcast(places), "term")
        starts = at.select("file", "field", F.transform("positions", lambda p: p - F.col("place")).alias("starts"))
        met = starts.groupBy("file", "field").agg(F.collect_list("starts").alias("all")).where(F.size("all") == len(wanted))
        common = F.aggregate(F.slice("all", 2, max(1, len(wanted))), F.get("all", F.lit(0)), lambda a, b: F.array_intersect(a, b))
        return met.select("file", F.size(common).cast("long").alias("n")).where("n > 0").groupBy("file").agg(F.sum("n").alias("hits"))

    def prefix(self, text: str) -> DataFrame:
        """Files with a word that begins as the text does; hits: how often such words stand there."""
        start = "".join(words(self.postings.sparkSession, text)[:1])
        d = self.postings.where(F.col("term").startswith(start)) if start else self.postings.limit(0)
        return d.groupBy("file").agg(F.sum(F.size("positions")).cast("long").alias("hits"))

    def some(self, every: str = "", some: str = "", none: str = "") -> DataFrame:
        """Files with all words of ``every``, one of ``some`` at least (if there are any) and none of ``none``; hits of the first two."""
        spark = self.postings.sparkSession
        must, may, ban = (sorted(set(words(spark, t))) for t in (every, some, none))
        term = F.col("term")
        d = self.rows(sorted({*must, *may, *ban})).groupBy("file").agg(
            F.count_distinct(F.when(term.isin(*must), term)).alias("must"), F.max(term.isin(*may).cast("int")).alias("may"), F.max(term.isin(*ban).cast("int")).alias("ban"),
            F.sum(F.when(term.isin(*must, *may), F.size("positions")).otherwise(0)).cast("long").alias("hits"),
        )
        d = d.where((F.col("must") == len(must)) & (F.col("ban") == 0))
        return (d.where("may = 1") if may else d.where("must > 0")).select("file", "hits")

    def ranked(self, text: str, n: int = 50) -> DataFrame:
        """file and score of the ``n`` files that fit the words best: BM25 over all fields, higher is better.

        Only the words' own figures come to the driver: the number of files that hold each, of all files, and their mean length.
        """
        wanted = sorted(set(words(self.postings.sparkSession, text)))
        tf = self.rows(wanted).groupBy("term", "file").agg(F.sum(F.size("positions")).alias("tf"))
        held = {r.term: r.n for r in tf.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
        total = self.files.agg(F.count(F.lit(1)).alias("n"), F.avg("n_tokens").alias("mean")).first()
        weight = F.lit(0.0)
        for term, k in held.items():
            weight = F.when(F.col("term") == term, max(math.log((total.n - k + 0.5) / (k + 0.5)), LEAST_IDF)).otherwise(weight)
        d = tf.join(self.files.select("file", "n_tokens"), "file")
        part = weight * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n_tokens") / (total.mean or 1.0)))
        return d.groupBy("file").agg(F.round(F.sum(part), 6).alias("score")).orderBy(F.desc("score"), "file").limit(n)


def inverted_index(g: Graph) -> DataFrame:
    """token, file, tf over file names, contents and packages."""
    return Index.of(g).postings.groupBy(F.col("term").alias("token"), "file").agg(F.sum(F.size("positions")).cast("long").alias("tf"))


def match(index: DataFrame, query: str) -> DataFrame:
    """file and hits of the files that hold all tokens of a query, by a table of token, file, tf."""
    wanted = sorted(set(words(index.sparkSession, query)))
    if not wanted:
        return index.select("file", F.col("tf").alias("hits")).limit(0)
    d = index.where(F.col("token").isin(*wanted)).groupBy("file").agg(F.count_distinct("token").alias("found"), F.sum("tf").alias("hits"))
    return d.where(F.col("found") == len(wanted)).select("file", "hits")
