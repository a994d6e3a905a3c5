"""More queries of the order tables' graph: sources, producers' algorithms, search and the client's lookups."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import api
from .functions.sqlcompat import counted_as, encoded
from .graph import Graph
from .operators import callgraph, extract, navigation
from .plans import specs
from .plans.carrier import sources, stored
from .schema import EDGES, gate, null_defaults, violations
from .session import kept, shared_folder, ship
from .sources import ingest, search


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/lineitem.parquet")


def escape_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A compiler's log made from items, parsed."""
    d = _lineitem(spark, sf_dir)
    k = F.col("l_partkey")
    said = F.when(k % 6 == 0, F.concat(F.lit("leaking param: p"), k)).when(k % 6 == 1, F.concat(F.lit("moved to heap: v"), k)).when(k % 6 == 2, F.concat(F.lit("new(T"), k, F.lit(") escapes to heap"))).when(k % 6 == 3, F.concat(F.lit("p"), k, F.lit(" does not escape"))).when(k % 6 == 4, F.concat(F.lit("can inline f"), k)).otherwise("something else")
    line = F.concat(F.when(k % 2 == 0, "./").otherwise(""), F.lit("src/f"), "l_suppkey", F.lit(".go:"), "l_linenumber", F.lit(":"), (k % 80).cast("string"), F.lit(": "), said)
    lines = d.select(F.when(k % 11 == 0, F.concat(F.lit("# pkg"), "l_suppkey")).otherwise(line).alias("line"))
    return ingest.escapes(lines)


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A version-control log made from orders (a commit each), parsed."""
    items = _lineitem(spark, sf_dir)
    orders = ship(spark).read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    name = F.concat(F.lit("src/f"), F.col("l_suppkey"), F.when(F.col("l_partkey") % 9 == 0, ".md").otherwise(".go"))
    added = F.when(F.col("l_partkey") % 10 == 0, "-").otherwise(F.col("l_quantity").cast("long").cast("string"))
    row = F.concat(added, F.lit("\t"), "l_linenumber", F.lit("\t"), name)
    d = items.groupBy("l_orderkey").agg(F.collect_list(row).alias("rows")).join(orders, "l_orderkey")
    head = F.concat(F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), F.lit("0" * 28), F.lit(" 2024-01-01T00:00:00Z Author "), "o_custkey")
    lines = d.select(F.col("l_orderkey").alias("log"), F.posexplode(F.concat(F.array(head), F.array(F.lit("")), "rows")).alias("at", "line"))
    return ingest.file_history(lines)


def blame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Porcelain output made from orders (a file for each customer, a line for each order), parsed."""
    k = F.col("o_orderkey").cast("string")
    head = F.concat(F.lpad(k, 12, "0"), F.lit("0" * 28), F.lit(" 1 "), k, F.lit(" 1"))
    lines = F.array(head, F.concat(F.lit("author Author "), "o_orderpriority"), F.concat(F.lit("author-time "), F.col("o_orderkey") + 5), F.concat(F.lit("\tline "), k))
    orders = ship(spark).read.parquet(f"{sf_dir}/orders.parquet")
    d = orders.select(F.col("o_custkey").cast("string").alias("log"), "o_orderkey", F.posexplode(lines).alias("part", "line"))
    return ingest.blame(d.select("log", (F.col("o_orderkey") * 4 + F.col("part")).alias("at"), "line"))


def wraps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls made from items: formats with and without %w, and joins."""
    k = F.col("l_partkey") % 5
    made = F.when(k == 0, "failed: %w").when(k == 1, "%d: %w").when(k == 2, "%w and %+5.2w of 100%%").when(k == 3, "%v and %%w")
    callee = F.when(k == 4, "errors.Join").otherwise("fmt.Errorf")
    calls = _lineitem(spark, sf_dir).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), callee.alias("callee"), made.alias("format"), F.lit(3).alias("args"))
    return extract.error_wraps(calls)


def null_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty texts and zeros of documents become null."""
    d = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    file = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source"))
    return null_defaults(d.select(F.col("doc_id").cast("string").alias("id"), file.alias("file"), (F.col("doc_id") % 5).alias("line")), ("id",))


def first_of_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as nodes named by their brand: the first row of each stays."""
    part = ship(spark).read.parquet(f"{sf_dir}/part.parquet")
    nodes = part.select(F.col("p_brand").alias("id"), F.col("p_type").alias("kind"), F.col("p_name").alias("name"))
    return Graph.ingest(nodes, spark.createDataFrame([], EDGES)).nodes.select("id", "kind", "name")


def declared_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types made from customers: some are aliases of nations, some embed another."""
    k = F.col("c_custkey")
    half = F.floor(k / 2)
    alias = F.when(k % 7 == 0, F.concat(F.lit("n"), "c_nationkey"))
    inner = F.when((k % 3 == 0) & (half > 0), F.array(F.concat(F.lit("t"), half)))
    d = ship(spark).read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("t"), k).alias("id"), alias.alias("alias_of"), inner.alias("embedded"))
    return extract.type_edges(d)


def _sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    names = lambda of, at: F.element_at(F.array(*[F.lit(x) for x in of]), (at % len(of) + 1).cast("int"))
    calls = ship(spark).read.parquet(f"{sf_dir}/part.parquet").select(k.alias("id"), names(["sync", "context", "os"], k).alias("package"), names(["Mutex", "RWMutex", "WaitGroup", "Once"], F.floor(k / 3)).alias("type"), names(["Lock", "Unlock", "RLock", "Add", "Wait", "Do", "Cancel"], F.floor(k / 12)).alias("method"))
    return extract.sync_kind(calls)


def _implementations(g: Graph) -> DataFrame:
    """Types that have all method names of an interface.

    Beside the graph's types each interface gets two: ``all:`` has its methods, ``few:`` all but the last by text.
    """
    m = kept(g.ends(g.step("has_method"), {}, {"name": "method"}, "function", "type_decl").select(F.col("source").alias("owner"), "method").distinct())
    asked = m.where("owner like 'i%'").select(F.col("owner").alias("interface"), "method")
    last = asked.groupBy("interface").agg(F.max("method").alias("last"))
    made = asked.select(F.concat(F.lit("all:"), "interface").alias("type"), "method")
    made = made.union(asked.join(last, "interface").where("method < last").select(F.concat(F.lit("few:"), "interface"), "method"))
    return extract.implementations(m.where("owner like 't%'").select(F.col("owner").alias("type"), "method").union(made), asked)


def _satisfied(g: Graph) -> DataFrame:
    """Functions of types beside the fields of the interfaces that the types implement; one name has one part's key."""
    name = F.concat(F.lit("M"), F.regexp_extract("target", "([0-9]+)$", 1))
    methods = g.step("has_method").where("source like 't%'").select(F.col("source").alias("type"), name.alias("method"), F.col("target").alias("id"))
    fields = g.of("field").select(F.col("id").alias("target"), F.col("name").alias("method"))
    faces = g.step("ast").join(fields, "target").select(F.col("source").alias("interface"), "method", F.col("target").alias("id"))
    impl = g.step("implements").select(F.col("source").alias("type"), F.col("target").alias("interface"))
    return extract.satisfied(impl, methods, faces).distinct()


def _methods(g: Graph) -> DataFrame:
    types = g.spark.range(50).select(F.concat(F.lit("r"), "id").alias("id"), F.concat(F.lit("T"), "id").alias("name"))
    methods = g.functions.join(g.having("receiver", name="receiver"), F.col("id") == F.col("node_id")).select("id", "receiver")
    return extract.has_method(types, methods)


def _ways(g: Graph) -> DataFrame:
    """Statements as blocks: an if goes on to the next or to the one after it."""
    s = g.of("if").select(F.col("id").alias("source"), F.split("id", "_").alias("at")).select("source", F.col("at")[0].alias("block"), F.col("at")[1].cast("int").alias("rn"))
    to = F.explode(F.array(*[F.struct(F.lit(k).alias("place"), F.concat_ws("_", "block", F.col("rn") + k + 1).alias("target")) for k in (0, 1)]))
    d = s.select("source", to.alias("t")).select("source", "t.target", "t.place", F.lit(True).alias("branches"))
    return extract.branches(d.join(g.nodes.select(F.col("id").alias("target")), "target", "left_semi"))


def _channels(g: Graph) -> DataFrame:
    """Go statements as what makes channels: sends and selects that their values reach."""
    ends = g.of("send").select("id", F.lit("send").alias("kind")).union(g.of("select").select("id", F.lit("receive")))
    return extract.channel_ends(_value_flow(g), g.of("go").select("id"), ends, _value_cycles(g))


def scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and their items as scopes, eight orders in a larger one, and places inside them."""
    d = _lineitem(spark, sf_dir)
    ok, item = F.col("l_orderkey"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag"))
    items = kept(d.select(ok.alias("ok"), item.alias("rn"), F.col("l_partkey").alias("pk"))).withColumn("file", F.concat(F.lit("f"), F.floor(F.col("ok") / 64)))
    ok, rn = F.col("ok"), F.col("rn")
    scope = lambda df, id_, start, length: df.select(id_.alias("id"), "file", start.cast("long").alias("start"), (start + length).cast("long").alias("end"))
    orders = items.where("rn = 1")  # each once
    wide = orders.select(F.floor(ok / 8).alias("eight"), "file").distinct()
    all_ = scope(wide, F.concat(F.lit("g"), "eight"), F.col("eight") * 80_000, 80_000)
    all_ = all_.union(scope(orders, F.concat(F.lit("o"), ok), ok * 10_000, 9_000)).union(scope(items, F.concat_ws("_", F.concat(F.lit("l"), ok), rn), ok * 10_000 + rn * 100, F.col("pk") % 3 * 40))
    places = items.select(F.concat_ws("_", F.concat(F.lit("n"), "ok"), "rn").alias("id"), "file", (ok * 10_000 + F.col("pk") * 7 % 10_000).alias("at"))
    return extract.enclosing_scopes(all_, places)


def _escapes(g: Graph) -> DataFrame:
    """A log that says something of every function, local and parameter, held against the nodes at its places."""
    said = F.element_at(F.array(*[F.lit(x) for x in ("leaking_param", "moved_to_heap", "inlineable", "does_not_escape")]), (F.col("line") % 4 + 1).cast("int"))
    found = g.of("function", "local", "parameter").where("file is not null").select("file", "line", said.alias("kind"))
    return ingest.escape_properties(g, found)


def _properties(g: Graph) -> DataFrame:
    entries = F.map_from_entries(F.collect_list(F.struct("key", "value")))
    return g.own_properties.groupBy("node_id").agg(entries.alias("p")).select("node_id", encoded("p").alias("properties"))


def _violations(g: Graph) -> DataFrame:
    """The constraints of stored tables, and one that is broken."""
    who = specs.participants(g.spark)
    twice = g.functions.select("id").union(g.functions.where("name = 'init'").select("id"))
    checks = [
        violations("participants", who, allowed=("role", ["client", "server", "contract"])), violations("nodes", g.nodes, unique="id"), violations("nodes", g.nodes, required="name"),
        violations("metrics", g.metrics, unique="function_id"), violations("broken", twice, unique="id"),
    ]
    return reduce(DataFrame.unionByName, checks)


def _modules(g: Graph) -> DataFrame:
    d = g.functions.where("package is not null").select(F.concat(F.lit("corp.io/"), "package").alias("path")).distinct()
    return extract.relative(d, [("corp.io/web", ""), ("corp.io/web/api", "api"), ("corp.io/storage", "store"), ("corp.io", "base")])


_indexes: dict[tuple[str, str], search.Index] = {}


def _index(spark: SparkSession, sf_dir: str) -> search.Index:
    """The index of the graph's source texts, made once; it takes nothing else of the graph, which so needn't be built."""
    key = (ship(spark).sparkContext.applicationId, sf_dir)
    if key not in _indexes:
        path = f"{shared_folder(spark)}/search-{uuid.uuid4().hex}"
        search.write_batch(sources(spark, sf_dir), path)
        _indexes[key] = search.Index.load(spark, path)
    return _indexes[key]


def _busiest(g: Graph) -> str:
    return g.step("call").groupBy("source").count().orderBy(F.desc("count"), "source").first()[0]


def _flow(g: Graph) -> str:
    return g.step("param_in").groupBy("target").count().orderBy(F.desc("count"), "target").first()[0]


def _first_file(g: Graph) -> str:
    return g.sources.agg(F.min("file")).first()[0]


def _value_flow(g: Graph) -> DataFrame:
    """How values pass types on: data flow, and arguments to parameters."""
    return g.step("dfg", "param_in")


def _value_cycles(g: Graph) -> DataFrame:
    return g.made("value-cycles", T.StructType().add("id", "string").add("component", "string"), lambda: callgraph.strong_components(_value_flow(g)))


def _types(spark: SparkSession, sf_dir: str) -> callgraph.Types:
    """Locals are made with the type of their order's customer, defers are functions as values."""
    g = stored(ship(spark), sf_dir)
    owner = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("ok"), F.concat(F.lit("t"), "o_custkey").alias("type"))
    made = g.of("local").select(F.col("id").alias("value"), F.regexp_extract("id", "^s([0-9]+)_", 1).cast("long").alias("ok")).join(owner, "ok").select("value", "type")
    values = g.of("defer").select(F.col("id").alias("value"), F.concat(F.lit(callgraph.FUNCTION), "parent_function").alias("type"))
    return callgraph.Types(_value_flow(g), made.union(values), _value_cycles(g))


def _called(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls by their dispatch: plain ones as they are, others by what reaches their first argument."""
    g = stored(ship(spark), sf_dir)
    stem = lambda name: F.regexp_extract(name, "^[^0-9]*", 0)
    fn = g.functions.select(F.col("id").alias("function"), stem("name").alias("method"))
    methods = g.step("has_method").join(fn, F.col("target") == F.col("function")).select(F.col("source").alias("type"), "method", "function")
    first = g.edge_properties.where("edge_kind = 'argument' and key = 'index' and value = '0'").select(F.col("source").alias("site"), F.col("target").alias("receiver"))
    calls = g.step("call_site").select(F.col("source").alias("site"), F.col("target").alias("function")).join(fn, "function")
    calls = calls.join(g.of("call").select(F.col("id").alias("site"), F.col("parent_function").alias("caller"), g.property("dispatch_type").alias("how")), "site").join(first, "site", "left")
    sites = calls.select("site", "caller", "receiver", F.when(F.col("how") == "static", F.col("function")).alias("callee"), F.when(F.col("how") == "interface", F.col("method")).alias("method"))
    return callgraph.call_graph(callgraph.resolve(_types(spark, sf_dir), sites, methods), g.functions.where("id NOT LIKE 'ext::%'"))


def _reaching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values each type reaches."""
    types = _types(spark, sf_dir)
    values = stored(spark, sf_dir).of("call", "local", "parameter", "go", "defer").select(F.col("id").alias("value"))
    return types.reached(values)


def _gate(g: Graph) -> DataFrame:
    """Functions added to those whose key is even, some twice and some without an id: what is kept out, and what gets in by package."""
    fn = g.functions
    at = F.regexp_extract("id", "[0-9]+$", 0).cast("long")
    rows = fn.unionByName(fn.where(at % 3 == 1).withColumn("name", F.concat(F.lit("~"), "name"))).unionByName(fn.where(at % 7 == 1).withColumn("id", F.when(at % 2 == 0, "")))
    fit, broken = gate("nodes", rows, fn.where(at % 2 == 0))
    return broken.union(fit.groupBy(F.concat(F.lit("added "), "package")).agg(counted_as("n")))


GRAPH: dict[str, Callable[[Graph], DataFrame]] = {
    "S02_nodes": lambda g: g.nodes,
    "S04_sources": lambda g: g.sources,
    "S05_metrics": lambda g: g.metrics,
    "S07_properties": _properties,
    "S12_scan_by_kind": lambda g: g.of("send").select("id", "name", "package"),
    "S18_subgraph_json": lambda g: api.node_json(g.functions),
    "G03_siblings": extract.siblings,
    "G04_defer_order": extract.defer_order,
    "G05_init_order": extract.init_order,
    "G08_complexity": extract.complexity,
    "G09_fans": extract.fans,
    "G10_recursion": extract.recursion,
    "G11_value_cycles": _value_cycles,
    "G12_param_in": extract.param_in,
    "G13_cfg_ends": extract.cfg_ends,
    "G13_branches": _ways,
    "G14_uses": extract.uses,
    "G15_channel_ends": _channels,
    "G15_channel_flow": lambda g: extract.pairs(_channels(g), "channel", "send", "receive"),
    "G16_panic_recover": extract.panic_recover,
    "G17_dominance": extract.dominance,
    "G20_implementations": _implementations,
    "G21_satisfied": _satisfied,
    "G23_has_method": _methods,
    "G24_relative_paths": _modules,
    "G25_escapes": _escapes,
    "R20_row_number": lambda g: g.measured.select("id", "loc").orderBy(F.desc("loc"), "id").limit(50).select("id", F.row_number().over(Window.orderBy(F.desc("loc"), "id")).cast("long").alias("rank")),
    "R31_violations": _violations,
    "R31_gate": _gate,
    "A1_search": lambda g: api.search(g, "serve1", 20),
    "A2_subgraph_nodes": lambda g: api.subgraph(g, _busiest(g)).nodes,
    "A2_subgraph_edges": lambda g: api.subgraph(g, _busiest(g)).edges,
    "A3_package_graph_nodes": lambda g: api.package_graph(g).nodes,
    "A3_package_graph_edges": lambda g: api.package_graph(g).edges,
    "A4_package_functions": lambda g: api.package_functions(g, "brand#1"),
    "A5_source": lambda g: api.source_row(g, _first_file(g)),
    "A6_slice_nodes": lambda g: api.slice_(g, _flow(g)).nodes,
    "A6_slice_edges": lambda g: api.slice_(g, _flow(g)).edges,
    "A8_slice_lines": lambda g: api.slice_lines(api.whole_slice(g, _flow(g))).withColumn("lines", F.array_join("lines", ",")),
    "T08_schema": navigation.schema_docs,
}
TABLES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "S06_null_binding": null_binding,
    "S09_escape_log": escape_log,
    "S10_change_log": change_log,
    "S11_blame": blame,
    "S13_full_text": lambda spark, sf_dir: _index(spark, sf_dir).every("THE and"),
    "S13_phrase": lambda spark, sf_dir: _index(spark, sf_dir).phrase("of The"),
    "S13_prefix": lambda spark, sf_dir: _index(spark, sf_dir).prefix("thb"),
    "S13_boolean": lambda spark, sf_dir: _index(spark, sf_dir).some(every="the of", some="idiot moron worthless", none="you za"),
    "S13_ranked": lambda spark, sf_dir: _index(spark, sf_dir).ranked("worthless moron of the", 50),
    "G02_scopes": scopes,
    "G06_error_wraps": wraps,
    "G11_call_graph": _called,
    "G11_type_reach": _reaching,
    "G07_sync_kind": _sync,
    "G22_embeds_alias": declared_types,
    "R30_first_of_id": first_of_id,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def over(analysis: Callable[[Graph], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: analysis(stored(ship(spark), sf_dir))

    return {name: over(f) for name, f in GRAPH.items()} | TABLES
