"""Running sums and last values along long orders, in pieces.

A window over one key runs in one task, however many rows the key has.  Here a key's rows are cut into pieces by their
place (``width`` places each); every piece is swept by itself, the pieces' totals (one row each) are swept by key,
and each piece starts from what the pieces before it have left.  Places are integers; a piece has as many rows as stand at its places.

Rows are stored once before they are swept (:func:`session.kept`), as both the totals and the sweep read them: what makes them
runs once, and the totals read only the columns they need and send on a row for each piece of a task.  Their number is known then,
and where the session's shuffle partitions would hold more than ``ROWS`` each there are more partitions, so that a task's memory
doesn't grow with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept

WIDTH = 100_000
ROWS = 1 << 20  # rows that a task sweeps, as far as pieces can be told apart; more tasks are taken for more rows


def _pieces(df: DataFrame, at: str, width: int) -> DataFrame:
    return df.withColumn("_piece", F.floor(F.col(at) / width))


def _stored(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """``df`` stored, and the same dealt by key and piece for the sweep."""
    d = kept(df)
    tasks = -(-d.count() // ROWS)
    few = tasks <= int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return d, d if few else d.repartition(tasks, *keys, "_piece")


def _upto(keys: list[str], at: str, ties: tuple[str, ...]):
    return Window.partitionBy(*keys, "_piece").orderBy(at, *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def running_total(df: DataFrame, keys: list[str], at: str, value: Column, name: str, ties: tuple[str, ...] = (), width: int = WIDTH) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the key's rows up to this one, by ``at`` and ``ties``."""
    d, dealt = _stored(_pieces(df, at, width).withColumn("_v", value), keys)
    totals = d.groupBy(*keys, "_piece").agg(F.sum("_v").alias("_t"))
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_piece", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_before"))
    d = dealt.withColumn("_own", F.sum("_v").over(_upto(keys, at, ties)))
    return d.join(totals, [*keys, "_piece"]).withColumn(name, F.col("_own") + F.col("_before")).drop("_piece", "_v", "_own", "_before")


def latest(df: DataFrame, keys: list[str], at: str, values: dict[str, Column], ties: tuple[str, ...] = (), width: int = WIDTH) -> DataFrame:
    """``df`` with columns of the last value that isn't null at or before each row, each by itself."""
    d, dealt = _stored(_pieces(df, at, width).withColumns({f"_v_{k}": v for k, v in values.items()}), keys)
    order = F.struct(F.col(at), *[F.col(t) for t in ties])
    last = [F.max_by(f"_v_{k}", F.when(F.col(f"_v_{k}").isNotNull(), order)).alias(f"_t_{k}") for k in values]
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    totals = d.groupBy(*keys, "_piece").agg(*last).select(*keys, "_piece", *[F.last(f"_t_{k}", ignorenulls=True).over(before).alias(f"_b_{k}") for k in values])
    d = dealt.withColumns({f"_o_{k}": F.last(f"_v_{k}", ignorenulls=True).over(_upto(keys, at, ties)) for k in values})
    d = d.join(totals, [*keys, "_piece"]).withColumns({k: F.coalesce(f"_o_{k}", f"_b_{k}") for k in values})
    return d.drop("_piece", *[f"_{x}_{k}" for x in "vob" for k in values])
