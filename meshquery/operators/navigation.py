"""Types and navigation: T22-T28, T32."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sqlcompat import counted_as, like, tally, zero
from ..graph import Graph
from ..session import kept, setting

PART_OF_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"  # false: rows dealt by some of a join's keys are joined where they are
SCHEME = "scip-go gomod github.com/prometheus/prometheus v0 "  # fixed value


def _types(g: Graph, prefix: str) -> DataFrame:
    return g.of("type_decl").select(F.col("id").alias(f"{prefix}_id"), F.col("name").alias(f"{prefix}_name"), F.col("package").alias(f"{prefix}_package"))


def type_impl_map(g: Graph, name: str | None = None) -> DataFrame:
    """Interface, concrete type, and how many satisfies_method edges lead from methods of the type to the interface's; of all interfaces, or of those of a name."""
    faces = _types(g, "interface") if name is None else _types(g, "interface").where(F.col("interface_name") == name)
    impl = g.step("implements").select(F.col("source").alias("concrete_id"), F.col("target").alias("interface_id")).join(faces.select("interface_id"), "interface_id", "left_semi")
    d = impl.join(faces, "interface_id").join(_types(g, "concrete"), "concrete_id").join(_met_methods(g, impl.distinct()), ["interface_id", "concrete_id"], "left")
    return d.select("interface_id", "interface_name", "interface_package", "concrete_id", "concrete_name", "concrete_package", zero("method_count").alias("method_count"))


def _met_methods(g: Graph, impl: DataFrame) -> DataFrame:
    """interface_id, concrete_id, method_count of the pairs in ``impl`` with such edges.

    Both sides meet at the type's method.  They are sent there with their interfaces as one array: a row for each method of a type, and one for
    each edge.  Only there are they spelled out, and joined where they stand.
    """
    impl, has = kept(impl), g.step("has_method")  # few pairs are sent to the methods
    own = has.select(F.col("source").alias("concrete_id"), F.col("target").alias("method")).join(impl.select("concrete_id").distinct(), "concrete_id", "left_semi").distinct()
    own = own.join(impl.groupBy("concrete_id").agg(F.collect_set("interface_id").alias("of")), "concrete_id").repartition("method")
    asked = has.join(impl.select(F.col("interface_id").alias("source")).distinct(), "source", "left_semi").groupBy(F.col("target").alias("wanted")).agg(F.collect_set("source").alias("by"))
    met = g.step("satisfies_method").select(F.col("source").alias("method"), F.col("target").alias("wanted")).join(asked, "wanted").select("method", "by").repartition("method")
    met = met.select("method", F.explode("by").alias("interface_id")).groupBy("method", "interface_id").agg(counted_as("n"))
    n = own.select("concrete_id", "method", F.explode("of").alias("interface_id")).join(met, ["method", "interface_id"])
    with setting(g.spark, PART_OF_KEYS, "false"):
        return kept(n.groupBy("interface_id", "concrete_id").agg(F.sum("n").alias("method_count")))


def type_hierarchy(g: Graph) -> DataFrame:
    """Types with those they embed at depth 1, and at depth 0 the types that embed nothing."""
    e = g.step("embeds")
    embedded = _types(g, "embedded")
    one = e.join(_types(g, "type"), F.col("source") == F.col("type_id")).join(embedded, F.col("target") == F.col("embedded_id"))
    one = one.select("type_id", "type_name", "type_package", "embedded_id", "embedded_name", "embedded_package", F.lit(1).cast("long").alias("depth"))
    none = _types(g, "type").join(e, F.col("type_id") == F.col("source"), "left_anti")
    missing = [F.lit(None).cast("string").alias(c) for c in embedded.columns]
    return one.unionByName(none.select("type_id", "type_name", "type_package", *missing, F.lit(0).cast("long").alias("depth")))


def type_method_set(g: Graph) -> DataFrame:
    """Methods of each type with their metrics."""
    m = g.weighed.select(F.col("id").alias("method_id"), F.col("name").alias("method_name"), F.col("type_info").alias("signature"), zero("cyclomatic_complexity").alias("complexity"), zero("loc").alias("loc"))
    d = g.step("has_method").join(_types(g, "type"), F.col("source") == F.col("type_id")).join(m, F.col("target") == F.col("method_id"))
    return d.select("type_id", "type_name", "method_id", "method_name", "signature", "complexity", "loc")


def symbol_index(g: Graph) -> DataFrame:
    """Named declarations that stand in a file."""
    d = g.of("function", "type_decl", "local", "parameter").where("name <> '' and name <> '_' and file is not null")
    return d.select("id", "name", "kind", "package", "file", "line", F.col("type_info").alias("signature"), F.col("parent_function").alias("parent"))


def file_outline(g: Graph) -> DataFrame:
    """Functions and types by file; depth 1 inside a function."""
    depth = F.when(F.col("parent_function").isNull(), 0).otherwise(1).cast("long")
    d = g.of("function", "type_decl").where("name <> '' and file is not null")
    return d.select("file", "id", "name", "kind", "line", "end_line", F.col("type_info").alias("signature"), F.col("parent_function").alias("parent_id"), depth.alias("depth"))


def xrefs(g: Graph) -> DataFrame:
    """Definition and use of every reference between nodes that stand in files."""
    n = g.nodes.where("file is not null")
    of = lambda p, *more: n.select(F.col("id").alias(f"{p}_id"), *[F.col(c).alias(f"{p}_{c}") for c in ("file", "line", *more)])
    d = g.step("ref").select(F.col("target").alias("def_id"), F.col("source").alias("use_id"))
    d = d.join(of("def", "name"), "def_id").join(of("use", "kind"), "use_id")
    return d.select("def_id", "def_name", "def_file", "def_line", "use_id", "use_file", "use_line", "use_kind")


def go_patterns(g: Graph) -> DataFrame:
    """Concurrency constructs by package, and interfaces, wrapped errors and context parameters of those packages.

    Panics and type assertions are counted too (the documented intent of their columns).
    """
    k = F.col("kind")
    base = {"goroutine_count": "go", "defer_count": "defer", "channel_send_count": "send", "select_count": "select"}
    d = g.of(*base.values()).where("package is not null").groupBy("package").agg(*[tally(k == kind).alias(c) for c, kind in base.items()])
    faces = g.of("type_decl").join(g.having("type_kind", "interface"), F.col("id") == F.col("node_id"), "left_semi")
    wraps = g.step("error_wrap").join(g.nodes.where("package is not null").select(F.col("id").alias("source"), "package"), "source")
    more = {
        "panic_count": g.of("call").where("name = 'panic'"), "interface_count": faces, "type_assert_count": g.of("type_assert_expr"),
        "error_wrap_count": wraps, "context_param_count": g.of("parameter").where(like("type_info", "%context.Context%")),
    }
    for name, rows in more.items():
        d = d.join(rows.groupBy("package").agg(counted_as(name)), "package", "left")
    return d.select("package", *base, *[zero(c).alias(c) for c in more])


def scip_symbols(g: Graph) -> DataFrame:
    """A symbol string for every function, method, type and package."""
    path = F.replace("package", F.lit("/"), F.lit("."))
    dot = F.instr("name", ".")
    method = (F.col("kind") == "function") & (dot > 0)
    owner = F.replace(F.replace(F.substring("name", F.lit(1), dot - 1), F.lit("(*"), F.lit("")), F.lit(")"), F.lit(""))
    tail = F.when(method, F.concat(owner, F.lit("#"), F.substring("name", dot + 1, F.length("name")), F.lit("()."))).when(F.col("kind") == "function", F.concat("name", F.lit("()."))).when(F.col("kind") == "type_decl", F.concat("name", F.lit("#"))).otherwise("")
    kind = F.when(method, "method").when(F.col("kind") == "type_decl", "type").otherwise(F.col("kind"))
    d = g.of("function", "type_decl", "package").where("package is not null and (name <> '' or kind = 'package')")
    return d.select(F.col("id").alias("node_id"), F.concat(F.lit(SCHEME), path, F.lit("/"), tail).alias("scip_id"), kind.alias("kind"), "package", F.col("name").alias("display_name"))


def schema_docs(g: Graph) -> DataFrame:
    """Category, name and column types of the graph's tables, and the kinds of nodes and edges met in it."""
    from ..schema import TABLES

    rows = [("table", name, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)) for name, schema in TABLES.items()]
    d = g.spark.createDataFrame(rows, "category string, name string, description string")
    for category, df in (("node_kind", g.nodes), ("edge_kind", g.edges)):
        d = d.unionByName(df.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.lit(category).alias("category"), F.col("kind").alias("name"), F.concat("n", F.lit(" rows")).alias("description")))
    return d
