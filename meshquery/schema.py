"""Schemas of the graph's tables, and ingestion rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _struct(text: str) -> T.StructType:
    return T.StructType([T.StructField(n, {"s": T.StringType(), "l": T.LongType(), "d": T.DoubleType()}[k]) for n, k in (f.split(":") for f in text.split())])


NODES = _struct("id:s kind:s name:s file:s line:l col:l end_line:l package:s parent_function:s type_info:s properties:s")
EDGES = _struct("source:s target:s kind:s properties:s")
SOURCES = _struct("file:s content:s package:s")
METRICS = _struct("function_id:s cyclomatic_complexity:l fan_in:l fan_out:l loc:l num_params:l")
HISTORY = _struct("file:s commit_count:l author_count:l last_author:s last_date:s insertions:l deletions:l churn:l")
ESCAPES = _struct("file:s line:l col:l kind:s detail:s")
FINDINGS = _struct("category:s severity:s node_id:s file:s line:l message:s details:s")
TAINTED = _struct("node_id:s label:s source_id:s source_category:s min_hops:l")
ENDPOINTS = _struct("id:s protocol_id:s component:s role:s endpoint_type:s function_id:s function_name:s package:s file:s line:l url_path:s http_method:s confidence:d")
PROPERTIES = _struct("node_id:s key:s value:s")
TABLES = {"nodes": NODES, "edges": EDGES, "sources": SOURCES, "metrics": METRICS, "history": HISTORY}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in order, missing ones as null."""
    return df.select(*[(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


def null_defaults(df: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """Empty texts and zeros become null, but in the required columns."""
    out = []
    for name, kind in df.dtypes:
        if name in required or kind not in ("string", "bigint", "int"):
            out.append(F.col(name))
        else:
            out.append(F.nullif(F.col(name), F.lit("" if kind == "string" else 0)).alias(name))
    return df.select(*out)


#: Of each table: its key, if it has one, and the columns that must have a value
CONSTRAINTS: dict[str, tuple[str | None, tuple[str, ...]]] = {
    "nodes": ("id", ("id", "kind", "name")),
    "edges": (None, ("source", "target", "kind")),
    "sources": ("file", ("file", "content")),
    "metrics": ("function_id", ("function_id",)),
    "history": ("file", ("file",)),
}


def gate(name: str, rows: DataFrame, stored: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows that can be added to a table, and check and n of what keeps the others out.

    Rows without a required value (null, or an empty text) are out; of the others with one key the least row by its columns in order
    stays, nulls first, and none whose key is ``stored``.  Keys are counted with partial sums, so one key can have any
    number of rows.  A check that nothing breaks has n 0.
    """
    key, required = CONSTRAINTS[name]
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() | (F.col(c).cast("string") == "") for c in required])
    count = lambda check, n: n.select(F.lit(f"{name}.{check}").alias("check"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    broken = count("missing", rows.where(missing).agg(F.count(F.lit(1)).alias("n")))
    good = rows.where(~missing)
    if key is None:
        return good, broken
    first = good.groupBy(F.col(key).alias("_key")).agg(F.min(F.struct(*rows.columns)).alias("_row"), F.count(F.lit(1)).alias("_n"))
    broken = broken.union(count("repeated", first.agg(F.sum(F.col("_n") - 1).alias("n"))))
    if stored is not None:
        keys = stored.select(F.col(key).alias("_key"))
        broken = broken.union(count("stored", first.join(keys, "_key", "left_semi").agg(F.count(F.lit(1)).alias("n"))))
        first = first.join(keys, "_key", "left_anti")
    return first.select("_row.*"), broken


def violations(name: str, df: DataFrame, unique: str | None = None, required: str | None = None, allowed: tuple[str, list[str]] | None = None) -> DataFrame:
    """Check and n, how many values break a constraint: repeated keys, missing values, values that aren't allowed."""
    if unique:
        column, bad = unique, df.groupBy(unique).count().where("count > 1")
    elif required:
        column, bad = required, df.where(F.col(required).isNull() | (F.col(required) == ""))
    else:
        column, bad = allowed[0], df.where(~F.coalesce(F.col(allowed[0]).isin(*allowed[1]), F.lit(False)))
    return bad.agg(F.count(F.lit(1)).alias("n")).select(F.lit(f"{name}.{column}").alias("check"), "n")
