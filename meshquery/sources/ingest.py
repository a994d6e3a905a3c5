"""Text sources: program texts (S4), escape-analysis logs (S9), version-control logs (S10) and blame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators import sweep


def directory(file: Column) -> Column:
    """The folder of a path, or ``main``."""
    found = F.regexp_extract(file, r"^(.*)/[^/]*$", 1)
    return F.when(found == "", "main").otherwise(found)


def source_texts(spark: SparkSession, path: str, root: str = "", skip: str = r"(_test|\.pb)\.go$") -> DataFrame:
    """File, content, package of every file under a path, each read whole; tests and generated files are skipped."""
    d = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("value").alias("content"), F.input_file_name().alias("full"))
    file = F.regexp_replace("full", f"^.*{root.strip('/')}/" if root else r"^.*/", "")
    return d.select(file.alias("file"), "content").where(~F.col("file").rlike(skip)).withColumn("package", directory(F.col("file")))


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """log, at, line: the lines of text files with their file and a place that grows through it.

    Long files are read in splits.  A split's lines come in order and are fewer than its bytes, so where the split begins
    and how many lines of it went before make places in the order of the text.
    """
    d = spark.read.text(path).select(F.col("_metadata.file_path").alias("log"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("k"), F.col("value").alias("line"))
    first = d.groupBy("log", "block").agg(F.min("k").alias("first"))
    return d.join(first, ["log", "block"]).select("log", (F.col("block") + F.col("k") - F.col("first")).alias("at"), "line")


_ESCAPE = r"^(?:\./)?([^:]+):(\d+):(\d+): (.+)$"


def escapes(lines: DataFrame, prefix: str = "") -> DataFrame:
    """File, line, col, kind, detail from the lines (column ``line``) that a compiler wrote; others are skipped."""
    part = lambda k: F.regexp_extract("line", _ESCAPE, k)
    d = lines.where(~F.col("line").startswith("#") & ~F.col("line").startswith("/") & F.col("line").rlike(_ESCAPE))
    d = d.select(part(1).alias("file"), part(2).cast("long").alias("at"), part(3).cast("long").alias("col"), part(4).alias("msg"))
    msg = F.col("msg")
    after = lambda mark: F.trim(F.regexp_extract("msg", mark + r"(.*)$", 1))
    before = lambda mark: F.regexp_replace(F.trim(msg), mark + "$", "")
    classes = [
        (msg.contains("leaking param:"), "leaking_param", after("leaking param:")),
        (msg.contains("moved to heap:"), "moved_to_heap", after("moved to heap:")),
        (msg.contains("escapes to heap"), "escapes_to_heap", before(" escapes to heap")),
        (msg.contains("does not escape"), "does_not_escape", before(" does not escape")),
        (msg.startswith("can inline "), "inlineable", F.substring("msg", 12, 1 << 30)),
    ]
    kind = detail = F.lit(None).cast("string")
    for hit, k, v in reversed(classes):
        kind, detail = F.when(hit, k).otherwise(kind), F.when(hit, v).otherwise(detail)
    file = F.concat(F.lit(f"{prefix}/"), "file") if prefix else F.col("file")
    return d.select(file.alias("file"), F.col("at").alias("line"), "col", kind.alias("kind"), detail.alias("detail")).where("kind is not null")


def escape_properties(g: Graph, found: DataFrame) -> DataFrame:
    """node_id, key, value for functions, parameters and locals at the places of a log.

    A node marked as escaping isn't marked as not escaping too.
    """
    at = g.of("function", "parameter", "local").select("id", F.col("kind").alias("node_kind"), "file", "line")
    d = found.join(at, ["file", "line"])

    def mark(where: str, key: str, value: str) -> DataFrame:
        return d.where(where).select(F.col("id").alias("node_id"), F.lit(key).alias("key"), F.lit(value).alias("value")).distinct()

    inline = mark("kind = 'inlineable' and node_kind = 'function'", "inlineable", "true")
    heap = mark("kind in ('leaking_param', 'moved_to_heap', 'escapes_to_heap')", "heap_escapes", "true")
    stay = mark("kind = 'does_not_escape' and node_kind <> 'function'", "heap_escapes", "false").join(heap, "node_id", "left_anti")
    return inline.unionByName(heap).unionByName(stay)


def file_history(lines: DataFrame, prefix: str = "", suffix: str = ".go", width: int = sweep.WIDTH) -> DataFrame:
    """Per file: commits, authors, the latest author and date, insertions, deletions, churn.

    ``lines``: log, at, line of a log in which a header (hash, date, author) stands over tab-separated counts, newest
    first.  The header is carried down each log, ``width`` lines at a time; binary files and other suffixes are skipped.
    """
    line = F.trim("line")
    d = lines.select("log", "at", line.alias("line")).where("line <> ''")
    head = (F.length("line") > 40) & (F.substring("line", 41, 1) == " ")
    parts = F.split("line", " ", 3)
    d = sweep.latest(d, ["log"], "at", {"header": F.when(head & (F.size(parts) == 3), parts)}, width=width).where(~head)
    cols = F.split("line", "\t", 3)
    d = d.where(F.size(cols) == 3).select(
        cols[2].alias("file"), cols[0].try_cast("long").alias("ins"), cols[1].try_cast("long").alias("del"), "log", "at",
        F.substring(F.col("header")[0], 1, 12).alias("commit"), F.col("header")[1].alias("date"), F.col("header")[2].alias("author"),
    ).where(F.col("ins").isNotNull() & F.col("del").isNotNull() & F.col("file").endswith(suffix))
    file = F.concat(F.lit(f"{prefix}/"), "file") if prefix else F.col("file")
    first = F.struct("log", "at")
    d = d.groupBy(file.alias("file")).agg(F.count_distinct("commit").alias("commit_count"), F.count_distinct("author").alias("author_count"), F.min_by("author", first).alias("last_author"), F.min_by("date", first).alias("last_date"), F.sum("ins").alias("insertions"), F.sum("del").alias("deletions"))
    return d.withColumn("churn", F.col("insertions") + F.col("deletions"))


def blame(lines: DataFrame, width: int = sweep.WIDTH) -> DataFrame:
    """Log, line, author, date, commit for every content line of porcelain output (log, at, line), ``width`` lines at a time."""
    header = F.col("line").rlike(r"^[0-9a-f^]{40} [0-9]+ [0-9]+")
    word = F.split("line", r"\s+")
    value = lambda key: F.when(F.col("line").startswith(f"{key} "), F.substring("line", len(key) + 2, 1 << 30))
    carried = {"commit": F.when(header, word[0]), "nr": F.when(header, word[2].try_cast("long")), "author": value("author"), "date": value("author-time")}
    d = sweep.latest(lines.select("log", "at", "line"), ["log"], "at", carried, width=width).where(F.col("line").startswith("\t"))
    return d.select("log", F.col("nr").alias("line"), "author", "date", F.substring("commit", 1, 12).alias("commit"))
