"""A property graph: lazy DataFrames of nodes, edges, source texts, function metrics and file history."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schema import EDGES, NODES, PROPERTIES, TABLES, conform, gate, null_defaults
from .session import kept, open_writers

MAP = "map<string,variant>"


def _spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each property; JSON true and false become 1 and 0 as the rules expect them, texts stay as they are."""
    df = df.where("properties is not null").select(*keys, F.explode(F.from_json("properties", MAP)).alias("key", "v"))
    flag = F.when(F.col("v").cast("string") == "true", "1").otherwise("0")
    value = F.when(F.schema_of_variant("v") == "BOOLEAN", flag).otherwise(F.col("v").cast("string"))
    return df.withColumn("value", value).drop("v").where("value is not null")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


class Graph:
    """Tables are plans until an action needs them; :meth:`save` stores them with edges and nodes partitioned by kind.

    A stored graph grows by stages (:meth:`put`): the edges and node properties of each stand in partitions of their own
    beside those loaded, so that a stage which runs again takes the place of what it had made and of nothing else.
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame, sources: DataFrame | None = None, metrics: DataFrame | None = None, history: DataFrame | None = None, properties: DataFrame | None = None):
        spark = nodes.sparkSession
        self.spark = spark
        self.nodes = nodes
        self.edges = edges
        empty = lambda name: spark.createDataFrame([], TABLES[name])
        self.sources = sources if sources is not None else empty("sources")
        self.metrics = metrics if metrics is not None else empty("metrics")
        self.history = history if history is not None else empty("history")
        self._extra = properties
        self._kept: DataFrame | None = None  # all node properties, if they are stored
        self.path: str | None = None  # where the tables are stored, if they are

    # --- construction and storage --------------------------------------------------------------------------

    @classmethod
    def ingest(cls, nodes: DataFrame, edges: DataFrame, sources: DataFrame | None = None, metrics: DataFrame | None = None, history: DataFrame | None = None) -> Graph:
        """From raw rows: empty values become null, the first row of a node id stays, edges all stay."""
        n = null_defaults(conform(nodes, NODES), ("id", "kind", "name"))
        first = Window.partitionBy("id").orderBy(*[F.col(c).asc_nulls_last() for c in n.columns if c != "id"])
        n = n.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")
        e = null_defaults(conform(edges, TABLES["edges"]), ("source", "target", "kind"))
        m = metrics.dropDuplicates(["function_id"]) if metrics is not None else None
        return cls(n, e, sources, m, history)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Graph:
        """From a saved folder; a table that isn't there is empty."""
        found = {}
        for name, schema in TABLES.items():
            if exists(spark, f"{path}/{name}"):
                found[name] = conform(spark.read.schema(schema).parquet(f"{path}/{name}"), schema)
            else:
                found[name] = spark.createDataFrame([], schema)
        g = cls(**found)
        g.path = path
        if exists(spark, f"{path}/properties"):
            g._kept = conform(spark.read.schema(PROPERTIES).parquet(f"{path}/properties"), PROPERTIES)
        return g

    def save(self, path: str, *tables: str, deal: bool = True) -> Graph:
        """Write all tables, or those named; a scan of some kinds then reads those folders only.

        Rows are dealt by kind first, so that a task doesn't write every kind; adaptive execution splits large kinds.  Where a
        task's rows are of a few kinds already (``deal=False``) that shuffle of the whole graph is left out.
        """
        for name, schema in TABLES.items():
            if tables and name not in tables:
                continue
            d = conform(getattr(self, name), schema)
            by = {"nodes": ["kind"], "edges": ["stage", "kind"]}.get(name)
            d = d.withColumn("stage", F.lit("loaded")) if name == "edges" else d
            w = (d.hint("rebalance", F.col("kind")) if by and deal else d).write.mode("overwrite").option("compression", "zstd")
            with open_writers(self.spark):
                (w.partitionBy(*by) if by else w).parquet(f"{path}/{name}")
        return Graph.load(self.spark, path)

    def add(self, name: str, rows: DataFrame, ignore: bool = False) -> Graph:
        """Add rows to a table of a stored graph.

        If any breaks a constraint (:func:`schema.gate`) nothing is written and ValueError says what; with ``ignore`` such rows are
        left out, so the same rows can be added again.  Edges have no key and are added as often as they are given.
        """
        if self.path is None:
            raise ValueError("only a stored graph takes rows")
        fit, broken = gate(name, conform(rows, TABLES[name]), getattr(self, name))
        if not ignore and (found := {r["check"]: r.n for r in broken.where("n > 0").collect()}):  # a row for each check
            raise ValueError(f"rows that break constraints: {found}")
        fit = fit.withColumn("stage", F.lit("loaded")) if name == "edges" else fit
        by = {"nodes": ["kind"], "edges": ["stage", "kind"]}.get(name)
        w = (fit.hint("rebalance", F.col("kind")) if by else fit).write.mode("append")
        (w.partitionBy(*by) if by else w).parquet(f"{self.path}/{name}")
        return Graph.load(self.spark, self.path)

    def put(self, stage: str, edges: DataFrame | None = None, properties: DataFrame | None = None) -> Graph:
        """Add a stage's edges and node properties to a stored graph, in place of those that it made before.

        Only the stage's own folder is written; one that finds nothing leaves it empty.  Derived tables (:meth:`made`) are those of the stages before them.
        Stored rows stand by kind already, so a task's rows have few kinds or keys and aren't dealt again.
        """
        if self.path is None:
            raise ValueError("only a stored graph has stages")
        for name, df, schema, by in (("edges", edges, EDGES, "kind"), ("properties", properties, PROPERTIES, "key")):
            if df is not None:
                with open_writers(self.spark):
                    conform(df, schema).write.mode("overwrite").option("compression", "zstd").partitionBy(by).parquet(f"{self.path}/{name}/stage={stage}")
        return Graph.load(self.spark, self.path)

    def made(self, name: str, schema: T.StructType, make: Callable[[], DataFrame]) -> DataFrame:
        """A derived table that several analyses read: for a stored graph it is stored beside it and made once."""
        if self.path is None:
            return make()
        path = f"{self.path}/derived-{name}"
        if not exists(self.spark, f"{path}/_SUCCESS"):
            conform(make(), schema).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    # --- scans ---------------------------------------------------------------------------------------------

    def of(self, *kinds: str) -> DataFrame:
        """Nodes of some kinds."""
        return self.nodes.where(F.col("kind").isin(*kinds))

    def along(self, *kinds: str) -> DataFrame:
        """source, target, kind of edges of some kinds."""
        return self.edges.where(F.col("kind").isin(*kinds)).select("source", "target", "kind")

    def step(self, *kinds: str) -> DataFrame:
        """source and target only."""
        return self.along(*kinds).drop("kind")

    @cached_property
    def own_properties(self) -> DataFrame:
        """node_id, key, value of what the nodes came with."""
        return _spread(self.nodes, [F.col("id").alias("node_id")])

    @cached_property
    def node_properties(self) -> DataFrame:
        """node_id, key, value of all; where they are stored, those of one key are one folder."""
        if self._kept is not None:
            return self._kept
        return self.own_properties if self._extra is None else self.own_properties.unionByName(self._extra)

    @cached_property
    def edge_properties(self) -> DataFrame:
        return _spread(self.edges, ["source", "target", F.col("kind").alias("edge_kind")])

    def having(self, key: str, value: str | None = None, name: str = "value") -> DataFrame:
        """node_id and value of a property (of one value)."""
        rows = self.node_properties.where(F.col("key") == key)
        rows = rows if value is None else rows.where(F.col("value") == value)
        return rows.select("node_id", F.col("value").alias(name))

    def property(self, key: str) -> Column:
        """A property of the node at hand, by its JSON text."""
        return F.get_json_object("properties", f"$.{key}")

    @cached_property
    def functions(self) -> DataFrame:
        return self.of("function")

    @cached_property
    def measured(self) -> DataFrame:
        """Functions with their metrics."""
        return self.functions.join(self.metrics, F.col("id") == F.col("function_id"))

    @cached_property
    def weighed(self) -> DataFrame:
        """All functions; those without metrics have nulls."""
        return self.functions.join(self.metrics, F.col("id") == F.col("function_id"), "left")

    def ends(self, edges: DataFrame, left: dict[str, str], right: dict[str, str], *kinds: str) -> DataFrame:
        """Edges with columns of both ends: {node column: new name} for source and target.

        Where edges only join nodes of some kinds, naming them spares the scan of all others.
        """
        nodes = self.of(*kinds) if kinds else self.nodes
        s = nodes.select(F.col("id").alias("source"), *[F.col(c).alias(n) for c, n in left.items()])
        t = nodes.select(F.col("id").alias("target"), *[F.col(c).alias(n) for c, n in right.items()])
        return edges.join(s, "source").join(t, "target")

    def calls(self, left: dict[str, str], right: dict[str, str]) -> DataFrame:
        """Call edges with columns of caller and callee; both are functions."""
        return self.ends(self.step("call"), left, right, "function")

    # --- checks --------------------------------------------------------------------------------------------

    def without_orphans(self) -> Graph:
        """Edges whose two ends exist.

        The ends that no node has are found first, from ids alone, and stored; edges are then held against these few, which
        are broadcast if they are small.  So the edges themselves are shuffled only where very many ends are lost.
        """
        e = self.edges.where("source IS NOT NULL AND target IS NOT NULL")
        ends = e.select(F.explode(F.array("source", "target")).alias("id"), F.lit(0).alias("there"))
        known = self.nodes.where("id IS NOT NULL").select("id", F.lit(1).alias("there"))
        lost = kept(ends.union(known).groupBy("id").agg(F.max("there").alias("there")).where("there = 0").select("id"))
        e = e.join(lost, F.col("source") == F.col("id"), "left_anti").join(lost, F.col("target") == F.col("id"), "left_anti")
        return self.but(edges=e)

    def but(self, **tables: DataFrame) -> Graph:
        """The same graph with other tables."""
        now = {"nodes": self.nodes, "edges": self.edges, "sources": self.sources, "metrics": self.metrics, "history": self.history, "properties": self._extra}
        g = Graph(**(now | tables))
        if not {"nodes", "properties"} & tables.keys():
            g._kept = self._kept
        return g

    def validate(self) -> DataFrame:
        """check, kind, n: orphan edges, and nodes and edges by kind."""
        ids = self.nodes.select("id")
        orphans = self.edges.join(ids, F.col("source") == F.col("id"), "left_anti").unionByName(self.edges.join(ids, F.col("source") == F.col("id"), "left_semi").join(ids, F.col("target") == F.col("id"), "left_anti"))
        n = F.count(F.lit(1)).alias("n")
        out = orphans.agg(n).select(F.lit("orphan_edges").alias("check"), F.lit(None).cast("string").alias("kind"), "n")
        for name in ("nodes", "edges"):
            out = out.union(getattr(self, name).groupBy("kind").agg(n).select(F.lit(name), "kind", "n"))
        return out
