"""Finding rules F1-F30 and the stages in which they are made.

A rule takes a graph and returns category, severity, node_id, file, line, message and details (JSON).  Later tables
read the findings as they stand at their point of the pipeline, so :func:`stage` gives those of a stage and before.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sqlcompat import at_least, cc, counted_as, details, exported, like, number, rounded, text, zero
from ..graph import Graph
from ..schema import FINDINGS
from . import taint, views


def found(df: DataFrame, category: str, severity: str, message: Column, node: Column | str | None = "id", /, *, place: bool = True, **fields: Column | str) -> DataFrame:
    """Findings from rows; ``place``: with the rows' file and line, ``fields``: what details holds."""
    at = F.lit(None).cast("string") if node is None else F.col(node) if isinstance(node, str) else node
    here = lambda c, t: (F.col(c) if place and c in df.columns else F.lit(None)).cast(t).alias(c)
    more = details(**fields) if fields else F.lit(None).cast("string")
    return df.select(F.lit(category).alias("category"), F.lit(severity).alias("severity"), at.alias("node_id"), here("file", "string"), here("line", "long"), message.alias("message"), more.alias("details"))


# Categories, severities, messages and the fields of details, as clients read them.


def complexity(g: Graph) -> DataFrame:
    return found(g.measured.where(cc() >= 15), "complexity", "warning", text(F.col("name"), " has cyclomatic complexity ", cc()), complexity=cc(), package="package")


def size(g: Graph) -> DataFrame:
    return found(g.measured.where("loc >= 100"), "size", "info", text(F.col("name"), " is ", F.col("loc"), " lines long"), loc="loc", package="package")


def nesting(g: Graph) -> DataFrame:
    d = g.of("if", "for", "switch", "select").join(g.having("nesting_depth", name="depth"), F.col("id") == F.col("node_id")).withColumn("depth", number("depth")).where("depth >= 8")
    return found(d, "nesting", "warning", text(F.col("kind"), " at depth ", F.col("depth"), " in ", F.col("parent_function")), depth="depth", kind="kind")


def hub(g: Graph, fan_in: int = 10, fan_out: int = 10) -> DataFrame:
    d = g.measured.where((F.col("fan_in") >= fan_in) & (F.col("fan_out") >= fan_out))
    return found(d, "hub", "info", text(F.col("name"), ": fan_in=", F.col("fan_in"), " fan_out=", F.col("fan_out")), fan_in="fan_in", fan_out="fan_out", package="package")


def _unread(g: Graph, kind: str) -> DataFrame:
    """Named nodes of a kind, inside functions, that no data leave."""
    return g.of(kind).where("parent_function is not null and name <> '_'").join(g.step("dfg"), F.col("id") == F.col("source"), "left_anti")


def dead_store(g: Graph) -> DataFrame:
    return found(_unread(g, "local"), "dead_store", "warning", text("unused variable '", F.col("name"), "' in ", F.col("parent_function")), variable="name", package="package")


def unused_param(g: Graph) -> DataFrame:
    return found(_unread(g, "parameter"), "unused_param", "info", text("unused parameter '", F.col("name"), "' in ", F.col("parent_function")), parameter="name", function="parent_function")


def circular_dep(g: Graph) -> DataFrame:
    """Packages that call each other, neither a command nor outside; the first not below a host name."""
    d = views.package_deps(g).select("source_package", "target_package", "call_count")
    b = d.select(F.col("target_package").alias("source_package"), F.col("source_package").alias("target_package"), F.col("call_count").alias("back"))
    skip = like("source_package", "cmd/%", "ext::%", "%.%/%") | like("target_package", "cmd/%", "ext::%")
    d = d.join(b, ["source_package", "target_package"]).where("source_package < target_package").where(~skip)
    message = text(F.col("source_package"), " <-> ", F.col("target_package"), " (", F.col("call_count"), "/", F.col("back"), " calls)")
    return found(d, "circular_dep", "warning", message, None, package_a="source_package", package_b="target_package", a_to_b_calls="call_count", b_to_a_calls="back")


def _inside(g: Graph, kinds: tuple[str, ...], least: int, where: Column | None = None) -> DataFrame:
    """Functions with at least so many nodes of some kinds inside, as n."""
    n = g.of(*kinds).where(where if where is not None else F.lit(True)).groupBy(F.col("parent_function").alias("id")).agg(counted_as("n")).where(F.col("n") >= least)
    return g.functions.join(n, "id")


def _children(g: Graph, kind: str, least: int, where: Column | None = None) -> DataFrame:
    """Functions with at least so many ast children of a kind, as n."""
    child = g.of(kind).where(where if where is not None else F.lit(True)).select(F.col("id").alias("target"))
    n = g.step("ast").join(child, "target").groupBy(F.col("source").alias("id")).agg(counted_as("n")).where(F.col("n") >= least)
    return g.functions.join(n, "id")


def goroutine_spawner(g: Graph) -> DataFrame:
    return found(_inside(g, ("go",), 2), "goroutine_spawner", "info", text(F.col("name"), " launches ", F.col("n"), " goroutine(s)"), goroutine_count="n", package="package")


def unused_export(g: Graph) -> DataFrame:
    far = g.calls({"package": "a"}, {"package": "b"}).where("a <> b").select(F.col("target").alias("id")).distinct()
    d = g.functions.where(exported("name") & F.col("package").isNotNull() & ~like("package", "cmd/%")).join(far, "id", "left_anti")
    return found(d, "unused_export", "info", text("exported ", F.col("name"), " has no callers from other packages"), name="name", package="package")


def long_param_list(g: Graph) -> DataFrame:
    return found(g.measured.where("num_params > 5"), "long_param_list", "info", text(F.col("name"), " has ", F.col("num_params"), " parameters"), num_params="num_params", package="package")


def many_params(g: Graph) -> DataFrame:
    """The same finding again, as a later stage words it."""
    return found(g.measured.where("num_params > 5"), "long_param_list", "info", text(F.col("name"), " has ", F.col("num_params"), " parameters (threshold: 5)"), place=False)


def god_function(g: Graph, fan_out: int = 10) -> DataFrame:
    d = g.measured.where((cc() >= 10) & (F.col("loc") >= 50) & (F.col("fan_out") >= fan_out))
    message = text(F.col("name"), " (complexity=", cc(), ", loc=", F.col("loc"), ", fan_out=", F.col("fan_out"), ")")
    return found(d, "god_function", "warning", message, complexity=cc(), loc="loc", fan_in="fan_in", fan_out="fan_out", package="package")


def interface_coupling(g: Graph) -> DataFrame:
    n = g.step("implements").groupBy(F.col("source").alias("id")).agg(counted_as("n")).where("n >= 3")
    return found(g.of("type_decl").join(n, "id"), "interface_coupling", "info", text(F.col("name"), " implements ", F.col("n"), " interfaces"), interface_count="n", package="package")


def concurrency_risk(g: Graph) -> DataFrame:
    locks = g.nodes.join(g.having("sync_kind").where(like("value", "mutex_%")), F.col("id") == F.col("node_id"), "left_semi").select(F.col("parent_function").alias("id"))
    d = _inside(g, ("go",), 1).join(locks, "id", "left_semi")
    return found(d, "concurrency_risk", "warning", text(F.col("name"), " uses mutex locks and spawns goroutines"), package="package")


def recursive(g: Graph) -> DataFrame:
    """One finding for each edge from a function to itself."""
    own = g.step("call").where("source = target").select(F.col("source").alias("id"))
    return found(g.functions.join(own, "id"), "recursive", "info", text(F.col("name"), " calls itself directly"), package="package")


def taint_hotspot(g: Graph) -> DataFrame:
    """Functions that hold both a source and a sink call."""
    d = taint.meeting(g)
    message = text(F.col("name"), " has taint source (", F.col("source_categories"), ") and sink (", F.col("sink_categories"), ")")
    return found(d, "taint_hotspot", "warning", message, function="name", package="package", source_categories="source_categories", sink_categories="sink_categories")


RISK_TOP = 200


def risk_score(g: Graph) -> DataFrame:
    """Complexity weighs 3, lines 2, callers and callees 1 each, each by its maximum over functions of some complexity."""
    measures = ("cyclomatic_complexity", "loc", "fan_in", "fan_out")
    top = g.metrics.where(cc() > 0).agg(*[at_least(F.max(c)).alias(f"max_{c}") for c in measures])
    share = [w * F.col(c) / F.col(f"max_{c}") for w, c in zip((3.0, 2.0, 1.0, 1.0), measures)]
    d = g.measured.where((cc() >= 5) | (F.col("loc") >= 30)).crossJoin(F.broadcast(top)).withColumn("risk", share[0] + share[1] + share[2] + share[3])  # top is one row
    d = d.orderBy(F.desc(F.col("risk").cast("decimal(38,9)")), "id").limit(RISK_TOP)
    score = rounded("risk", 2)
    return found(d, "risk_score", "info", text(F.col("name"), " risk=", score), risk_score=score, complexity=cc(), loc="loc", fan_in="fan_in", fan_out="fan_out", package="package")


def dead_code(g: Graph) -> DataFrame:
    plain = ~exported("name") & ~F.col("name").isin("main", "init") & ~like("name", "%Test%", "%Benchmark%", "%Example%") & ~like("package", "cmd/%") & ~like("id", "ext::%")
    d = g.weighed.where((zero("fan_in") == 0) & F.col("package").isNotNull() & plain)
    return found(d, "dead_code", "warning", text("unreachable function ", F.col("name"), " (zero callers)"), name="name", package="package")


def _interfaces(g: Graph) -> DataFrame:
    return g.of("type_decl").join(g.having("type_kind", "interface"), F.col("id") == F.col("node_id"), "left_semi")


def interface_bloat(g: Graph) -> DataFrame:
    n = g.step("ast").join(g.of("field").select(F.col("id").alias("target")), "target").groupBy(F.col("source").alias("id")).agg(counted_as("n")).where("n >= 5")
    return found(_interfaces(g).join(n, "id"), "interface_bloat", "info", text(F.col("name"), " has ", F.col("n"), " methods (consider splitting)"), method_count="n", package="package")


def twins(g: Graph, within: int) -> DataFrame:
    """Ordered pairs of functions of equal complexity and parameters whose lines differ by ``within`` at most.

    A function meets those of its own bucket of ``within + 1`` lines and of the two beside it, so a common (complexity,
    parameters) pair is spread over many keys.
    """
    a = g.measured.select("id", "name", "file", "line", "package", cc().alias("cc"), "num_params", "loc")
    b = a.select(*[F.col(c).alias(f"{c}_b") for c in a.columns])
    width = within + 1
    a = a.withColumn("bucket", F.explode(F.array(*[F.floor(F.col("loc") / width) + k for k in (-1, 0, 1)])))
    same = (F.col("cc") == F.col("cc_b")) & (F.col("num_params") == F.col("num_params_b")) & (F.col("bucket") == F.floor(F.col("loc_b") / width))
    return a.join(b, same).where((F.abs(F.col("loc") - F.col("loc_b")) <= within) & (F.col("id") < F.col("id_b")))


def similar_function(g: Graph) -> DataFrame:
    d = twins(g, 3).where("package <> package_b and cc >= 5 and loc >= 15")
    message = text(F.col("name"), " is structurally similar to ", F.col("name_b"), " (cc=", F.col("cc"), ", loc≈", F.col("loc"), "/", F.col("loc_b"), ")")
    return found(d, "similar_function", "info", message, twin_id="id_b", twin_name="name_b", complexity="cc", loc_a="loc", loc_b="loc_b", package_a="package", package_b="package_b")


def missing_context_first(g: Graph) -> DataFrame:
    """Takes a context, but the parameter of index 0 among its ast children is none."""
    first = g.of("parameter").where(like("type_info", "%context.Context%") & (g.property("index") == "0")).select(F.col("id").alias("target"))
    has = g.step("ast").join(first, "target").select(F.col("source").alias("id"))
    d = g.measured.where("num_params >= 2").join(g.having("has_context", "1"), F.col("id") == F.col("node_id"), "left_semi").join(has, "id", "left_anti")
    return found(d, "missing_context_first", "info", text(F.col("name"), " has ", F.col("num_params"), " params but context.Context is not first"), num_params="num_params", package="package")


def large_return(g: Graph, least: int = 4) -> DataFrame:
    return found(_children(g, "result", least), "large_return", "info", text(F.col("name"), " returns ", F.col("n"), " values"), result_count="n", package="package")


def bool_params(g: Graph) -> DataFrame:
    d = _children(g, "parameter", 2, F.col("type_info") == "bool")
    return found(d, "bool_params", "info", text(F.col("name"), " has ", F.col("n"), " bool parameters (consider options struct)"), bool_count="n", package="package")


def panic_call(g: Graph) -> DataFrame:
    return found(_inside(g, ("call",), 1, F.col("name") == "panic"), "panic_call", "warning", text(F.col("name"), " calls panic() directly"), package="package")


def _first_functions(g: Graph) -> DataFrame:
    """The least function id of each package, and how many functions it has."""
    return g.functions.where("package is not null").groupBy("package").agg(F.min("id").alias("id"), counted_as("n"))


def god_package(g: Graph, most: int = 50) -> DataFrame:
    d = _first_functions(g).where(F.col("n") > most)
    return found(d, "god_package", "warning", text(F.col("package"), " has ", F.col("n"), f" functions (threshold: {most})"), place=False)


def high_coupling(g: Graph, most: int = 10) -> DataFrame:
    d = views.package_deps(g).groupBy(F.col("source_package").alias("package")).agg(F.count_distinct("target_package").alias("targets")).where(F.col("targets") > most)
    return found(d.join(_first_functions(g), "package", "left"), "high_coupling", "warning", text(F.col("package"), " depends on ", F.col("targets"), f" packages (threshold: {most})"), place=False)


def large_interface(g: Graph, most: int = 10) -> DataFrame:
    n = g.step("has_method").join(g.functions.select(F.col("id").alias("target")), "target").groupBy(F.col("source").alias("id")).agg(counted_as("n")).where(F.col("n") > most)
    return found(_interfaces(g).join(n, "id"), "large_interface", "info", text(F.col("name"), " in ", F.col("package"), " has ", F.col("n"), f" methods (threshold: {most})"), place=False)


def orphan_type(g: Graph) -> DataFrame:
    e = g.step("implements", "embeds", "has_method")
    tied = e.select(F.col("source").alias("id")).union(e.select(F.col("target").alias("id"))).distinct()
    return found(g.of("type_decl").join(tied, "id", "left_anti"), "orphan_type", "info", text(F.col("name"), " in ", F.col("package"), " has no implements/embeds/method edges"), place=False)


def high_churn_complexity(g: Graph) -> DataFrame:
    """Files of many commits and much complexity; the node is that of the file (the least id if there are several)."""
    d = views.file_risk(g).where("commit_count >= 10 and avg_complexity >= 5").withColumn("line", F.lit(1))
    files = g.of("file").groupBy("file").agg(F.min("id").alias("id"))
    message = text(F.col("file"), ": ", F.col("commit_count"), " commits, ", F.col("author_count"), " authors, avg complexity ", F.col("avg_complexity").cast("long"))
    return found(d.join(files, "file", "left"), "high_churn_complexity", "warning", message, file="file", commits="commit_count", authors="author_count", churn="churn", avg_complexity="avg_complexity", max_complexity="max_complexity")


def unsanitized_sink(g: Graph) -> DataFrame:
    d = taint.sinks_reached(g)
    message = text("Taint from ", F.col("source_name"), " (", F.col("source_category"), ") reaches sink ", F.col("sink_name"), " in ", F.col("min_hops"), " hops")
    return found(d, "unsanitized_sink", "error", message, "sink_id", source="source_id", sink="sink_id", category="source_category", hops="min_hops", source_name="source_name", sink_name="sink_name")


def tainted_container(g: Graph) -> DataFrame:
    d = taint.index_sensitivity(g).where("has_taint = 1")
    return found(d, "tainted_container", "info", text(F.col("container_kind"), " container with tainted data: ", F.col("type_info")), "node_id", container_kind="container_kind", type="type_info", function="function_id")


STAGES: dict[int, tuple[Callable[[Graph], DataFrame], ...]] = {
    1: (complexity, size, nesting, hub, dead_store, unused_param, circular_dep, goroutine_spawner, taint_hotspot, unused_export, long_param_list, god_function, interface_coupling, concurrency_risk, recursive, risk_score, dead_code, interface_bloat, similar_function, missing_context_first, large_return, bool_params, panic_call),
    2: (many_params, god_package, high_coupling),
    3: (large_interface, orphan_type, high_churn_complexity, unsanitized_sink, tainted_container),
}


def _made(g: Graph, stage: int) -> DataFrame:
    """What the rules of one stage find."""
    return g.made(f"findings-{stage}", FINDINGS, lambda: reduce(DataFrame.unionByName, [rule(g) for rule in STAGES[stage]]))


def stage(g: Graph, upto: int = 3) -> DataFrame:
    """All findings made by the end of a stage."""
    return reduce(DataFrame.unionByName, [_made(g, k) for k in range(1, upto + 1)])


def summary(g: Graph, upto: int = 1) -> DataFrame:
    """Findings by category; the severity is the greatest as text."""
    return stage(g, upto).groupBy("category").agg(F.max("severity").alias("severity"), counted_as("count"))
