"""A graph that grows: counts by kind and new findings as node and edge files arrive (Structured Streaming)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.sqlcompat import counted_as
from ..graph import Graph
from ..schema import EDGES, NODES


def kinds(spark: SparkSession, path: str, edges: bool = False) -> DataFrame:
    """A stream of counts by kind over the Parquet files that arrive in a folder."""
    return spark.readStream.schema(EDGES if edges else NODES).parquet(path).groupBy("kind").agg(counted_as("count"))


def watch(spark: SparkSession, path: str, rule: Callable[[Graph], DataFrame], sink: str, checkpoint: str, base: Graph) -> StreamingQuery:
    """Run a rule over each batch of new nodes with the graph's edges and metrics; findings are appended to ``sink``.

    A batch writes its own folder, so one that runs again after a failure replaces what it had written.
    """

    def each(batch: DataFrame, epoch: int) -> None:
        rule(base.but(nodes=batch)).withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{sink}/batch={epoch}")

    return spark.readStream.schema(NODES).parquet(path).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
