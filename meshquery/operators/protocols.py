"""Communication between components: endpoints, conformance, causality, cycles, association."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sqlcompat import counted_as, like, listed, tally, zero
from ..graph import Graph
from ..plans import specs
from ..schema import ENDPOINTS


def _named(pattern: str) -> Column:
    return like("name", pattern) if "%" in pattern else F.col("name") == pattern


def _url(rule: str | None) -> Column:
    if rule not in specs.URLS:
        return F.lit(rule).cast("string")
    out = F.lit(specs.OTHER_URL)
    for pattern, url in reversed(specs.URLS[rule]):
        out = F.when(like("name", pattern), url).otherwise(out)
    return out


def endpoints(g: Graph) -> DataFrame:
    """T34."""
    return g.made("endpoints", ENDPOINTS, lambda: detected(g))


def detected(g: Graph) -> DataFrame:
    """Functions that take part in a protocol, by rules on package or project and name.

    One pass: each function explodes to the rules it meets.  An id is the rule's number and the function's id, so that no
    numbering of all rows is needed; ids sort as the rules stand.
    """
    rules = []
    for nr, (proto, comp, role, kind, key, value, names, url, sure) in enumerate(specs.ENDPOINTS):
        place = like(key, value) if "%" in value else F.col(key) == value
        hit = place & reduce(Column.__or__, [_named(n) for n in names])
        if url == specs.CONTRACT:
            hit = hit & ~like("name", *specs.NOT_CONTRACT)
        fields = {"rule": f"{nr:02d}", "protocol_id": proto, "component": comp, "role": role, "endpoint_type": kind}
        rules.append(F.when(hit, F.struct(*[F.lit(v).alias(k) for k, v in fields.items()], _url(url).alias("url_path"), F.lit(sure).alias("confidence"))))
    fn = g.functions.withColumn("project", g.property("project"))
    d = fn.select(F.explode(F.array_compact(F.array(*rules))).alias("r"), F.col("id").alias("function_id"), F.col("name").alias("function_name"), "package", "file", "line")
    d = d.select("r.*", "function_id", "function_name", "package", "file", "line", F.lit(None).cast("string").alias("http_method"))
    return d.withColumn("id", F.concat_ws(":", "rule", "function_id")).select(*ENDPOINTS.names)


CHANNEL = ["component", "pattern", "session_type", "channel_type", "sender_package", "receiver_package", "goroutine_count", "description"]


def channel_patterns(g: Graph) -> DataFrame:
    """Fan-outs at selects of three packages, signals by package of sends, and two constant patterns."""

    def rows(d: DataFrame, pattern: str | Column, **of: str | Column) -> DataFrame:
        of = {"component": "prometheus", "pattern": pattern, **of}
        value = lambda c: of[c] if isinstance(of.get(c), Column) else F.lit(of.get(c))
        return d.select(*[value(c).cast("long" if c == "goroutine_count" else "string").alias(c) for c in CHANNEL])

    fan = g.of("select").where(F.col("package").isin("scrape", "notifier", "rules")).groupBy("package").agg(counted_as("n"))
    to = F.concat(F.lit("Discovery manager fans out target groups to "), "package", F.lit(" consumers"))
    fan = rows(fan, "fan_out", channel_type="chan TargetGroup[]", sender_package="discovery", receiver_package=F.col("package"), goroutine_count=F.col("n"), description=to)
    signal = g.of("send").where(F.col("package").isNotNull() & ~like("package", "github.com%")).select("package").distinct()
    signal = rows(signal, "signal", channel_type="chan struct{}", sender_package=F.col("package"), goroutine_count=F.lit(0), description=F.concat(F.lit("Shutdown/cancellation signal in "), "package"))
    fixed = g.spark.createDataFrame(specs.CHANNELS, "p string, t string, d string").coalesce(1)
    return fan.unionByName(signal).unionByName(rows(fixed, F.col("p"), session_type=F.col("t"), goroutine_count=F.lit(0), description=F.col("d")))


def causality(g: Graph, e: DataFrame | None = None) -> DataFrame:
    """Causal pairs of endpoints: source_endpoint, target_endpoint, kind, protocol_id, description.

    Sides are cut to the least ids before they meet, as many as pairs are asked for.
    """
    e = endpoints(g) if e is None else e
    p, c = F.col("protocol_id"), F.col("component")
    notify = p == "alertmanager_notify"
    ties = [
        ("IO", "adapter_series", (p == "adapter_series") & (c == "adapter"), p.isin("adapter_query", "adapter_query_range") & (c == "adapter"), 3),
        ("OO", "alertmanager_notify", notify & like("function_name", "%sendAll%"), notify & like("function_name", "%sendOne%"), 1),
        ("II", "discovery", (p == "discovery") & (F.col("role") == "client"), (p == "scrape") & (F.col("role") == "client"), 3),
    ]

    def side(where: Column, name: str, n: int) -> DataFrame:
        return e.where(where).select(F.col("id").alias(name)).orderBy(name).limit(n)

    def pairs(kind: str, protocol: str, a: Column, b: Column, n: int) -> DataFrame:
        d = side(a, "source_endpoint", n).crossJoin(F.broadcast(side(b, "target_endpoint", n)))  # n * n rows at most
        d = d.orderBy("source_endpoint", "target_endpoint").limit(n)
        return d.select("source_endpoint", "target_endpoint", F.lit(kind).alias("kind"), F.lit(protocol).alias("protocol_id"), F.lit(specs.CAUSES[kind]).alias("description"))

    return reduce(DataFrame.unionByName, [pairs(*tie) for tie in ties])


def _covered(g: Graph) -> DataFrame:
    """Participants with the number of their endpoints and those's packages."""
    found = endpoints(g).groupBy("protocol_id", "component").agg(counted_as("cnt"), listed("package").alias("packages"))
    outside = F.col("component").isin(*specs.EXTERNAL)
    return specs.participants(g.spark).drop("description").join(found, ["protocol_id", "component"], "left").withColumn("cnt", zero("cnt")).withColumn("outside", outside)


def conformance(g: Graph) -> DataFrame:
    """T37."""
    there = F.col("cnt") >= 1
    why = F.when(there, "Endpoints detected in CPG").when(F.col("outside"), "External component — not in analyzed codebase").otherwise("No implementing endpoints found")
    return _covered(g).select("protocol_id", "component", F.when(there, "conforming").otherwise("missing").alias("status"), F.col("cnt").alias("endpoints_found"), F.lit(1).cast("long").alias("endpoints_expected"), why.alias("details"))


# Explanations of subtype checks
OUTSIDE = "External component not in analyzed codebase. Per Honda corrected theory, assumed to satisfy G|>p ≤ Γ(s[p]) (subtype conformance)."
DETECTED = "Implementation detected. Per Yoshida & Hou 2024 corrected projection theorem (T-4.7): G|>p ≤ Γ(s[p]) holds via "
SERVES = "branching contravariance (handles all required message types)."
ASKS = "selection covariance (sends only allowed message types)."
UNSEEN = "WARNING: No implementing endpoints found. Cannot verify G|>p ≤ Γ(s[p]). This may indicate dead protocol code or incomplete analysis."


def subtype_check(g: Graph) -> DataFrame:
    """Whether each participant's implementation is a subtype of its projected session type.

    A contract has no projected type, and no explanation once it is detected.
    """
    n, out, role = F.col("cnt"), F.col("outside"), F.col("role")
    types = specs.protocols(g.spark).select(F.col("id").alias("protocol_id"), "session_type_client", "session_type_server")
    d = _covered(g).join(F.broadcast(types), "protocol_id")
    projected = F.when(role == "client", F.col("session_type_client")).when(role == "server", F.col("session_type_server"))
    actual = F.when(n == 0, "(no implementation detected)").otherwise(F.concat(F.lit("Detected "), n, F.lit(" endpoint(s) in "), F.coalesce("packages", F.lit("unknown"))))
    relation = F.when(out, "assumed_subtype").when(n >= 2, "subtype").when(n == 1, "equal").otherwise("incompatible")
    direction = (
        F.when(out, "external (assumed conforming)").when((n >= 2) & (role == "server"), "branching contravariance: server handles ≥ required message types")
        .when((n >= 2) & (role == "client"), "selection covariance: client sends ≤ allowed message types").when(n == 1, "direct conformance (single endpoint)").otherwise("no implementation found")
    )
    why = F.when(out, OUTSIDE).when(n >= 1, F.concat(F.lit(DETECTED), F.when(role == "server", SERVES).when(role == "client", ASKS))).otherwise(UNSEEN)
    return d.select("protocol_id", "component", projected.alias("projected_type"), actual.alias("actual_behavior"), relation.alias("relation"), (out | (n >= 1)).cast("long").alias("is_conforming"), direction.alias("subtype_direction"), why.alias("explanation"))


# How cycles are classed
MUTUAL = {
    "IO": "Scalas-Yoshida pattern: mutual IO dependency (data-dependent circular wait)",
    "II": "Scalas-Yoshida pattern: mutual II dependency (input ordering conflict)",
}
MIXED = "Mixed causality — likely benign under FIFO channel assumption"
THEOREM = "Per Scalas & Yoshida 2019, well-typedness alone does NOT guarantee deadlock freedom."
TRIANGLE = "Three-participant cycle — matches Scalas & Yoshida 2019 §3 counterexample structure"
DISPROOF = "Three-step causality cycle detected. This is the EXACT pattern that Scalas & Yoshida 2019 used to disprove Honda 2008 Theorem 5.1 (progress). Well-typed but deadlocking."


def dependency_cycles(c: DataFrame) -> DataFrame:
    """2- and 3-cycles among causal pairs; each once."""
    p = {k: c.select(*[F.col(x).alias(f"{x[0]}{k}") for x in ("source_endpoint", "target_endpoint", "kind", "protocol_id", "description")]) for k in (1, 2, 3)}
    path, both = lambda *x: F.concat_ws(" → ", *x), lambda *x: F.concat_ws(", ", *[F.coalesce(y, F.lit("")) for y in x])
    rows = lambda d, cycle, n, who, severity, kind, why: d.select(cycle.alias("cycle_path"), F.lit(n).cast("long").alias("cycle_length"), who.alias("involved_protocols"), severity.alias("severity"), kind.alias("scalas_yoshida_class"), why.alias("description"))
    two = p[1].join(p[2], (F.col("t1") == F.col("s2")) & (F.col("t2") == F.col("s1"))).where("struct(s1, t1, k1) < struct(s2, t2, k2)")
    alike = F.col("k1") == F.col("k2")
    kind = F.when(alike & (F.col("k1") == "IO"), MUTUAL["IO"]).when(alike & (F.col("k1") == "II"), MUTUAL["II"]).otherwise(MIXED)
    said = lambda k: F.concat(f"k{k}", F.lit("("), F.coalesce(f"d{k}", F.lit("?")), F.lit(")"))
    why = F.concat(F.lit("Cycle detected in Honda 2008 causality graph: "), said(1), F.lit(" ↔ "), said(2), F.lit(f". {THEOREM}"))
    two = rows(two, path("s1", "t1", "t2"), 2, both("p1", "p2"), F.when(alike & F.col("k1").isin("IO", "II"), "deadlock_risk").otherwise("benign"), kind, why)
    three = p[1].join(p[2], F.col("t1") == F.col("s2")).join(p[3], (F.col("t2") == F.col("s3")) & (F.col("t3") == F.col("s1"))).where("s1 < s2 and s2 < s3")
    return two.unionByName(rows(three, path("s1", "s2", "s3", "s1"), 3, both("p1", "p2", "p3"), F.lit("deadlock_risk"), F.lit(TRIANGLE), F.lit(DISPROOF)))


# verdicts
NOT_ASSOCIATED = "UNVERIFIED: association relation does not hold"
SAFE = "VERIFIED: no protocol violations possible (Yoshida & Hou 2024, Thm 3)"
FREE = "VERIFIED: no circular wait (acyclic causality graph, correcting Honda 2008 Thm 5.1)"
RISK = " causality cycle(s) detected — deadlock possible (Scalas & Yoshida 2019)"
INCOMPLETE = "UNVERIFIED: subtype conformance incomplete"
LIVE = "VERIFIED: all branches reachable under fair scheduling (Yoshida & Hou 2024, Thm 3)"
ERRATA = (
    'Honda 2008 corrected by: Scalas & Yoshida "Less is More" (ECOOP 2019), Yoshida & Hou "Revisiting Subtyping for Session Types" (2024). '
    "Original Thms 4.6, 4.7, 5.1, 5.2 require association relation (subtyping + acyclicity) instead of simple coherence."
)


def association(g: Graph, cycles: DataFrame | None = None) -> DataFrame:
    """A protocol is associated if all participants conform and no risky cycle involves it (by whole name)."""
    cycles = dependency_cycles(causality(g)) if cycles is None else cycles
    risky = cycles.where("severity <> 'benign'").select(F.explode(F.array_distinct(F.split("involved_protocols", ", "))).alias("protocol_id")).groupBy("protocol_id").agg(counted_as("cycle_count"))
    d = subtype_check(g).groupBy("protocol_id").agg(F.count_distinct("component").alias("total_participants"), F.sum("is_conforming").alias("conforming_count"), tally(F.col("is_conforming") == 0).alias("failing"))
    d = d.join(risky, "protocol_id", "left").withColumn("cycle_count", zero("cycle_count"))
    conform, acyclic = F.col("failing") == 0, F.col("cycle_count") == 0
    ok = conform & acyclic
    verdict = lambda text, other: F.when(ok, text).otherwise(other)
    free = verdict(FREE, F.when(~acyclic, F.concat(F.lit("WARNING: "), "cycle_count", F.lit(RISK))).otherwise(INCOMPLETE))
    return d.select(
        "protocol_id", F.lit(1).cast("long").alias("all_projectable"), F.col("total_participants").alias("projectable_count"), "total_participants",
        conform.cast("long").alias("all_subtype_conforming"), "conforming_count", acyclic.cast("long").alias("acyclic_dependencies"), "cycle_count", ok.cast("long").alias("is_associated"),
        verdict(SAFE, NOT_ASSOCIATED).alias("s_safe"), free.alias("s_deadlock_free"), verdict(LIVE, NOT_ASSOCIATED).alias("s_live"), F.lit(ERRATA).alias("errata_reference"),
    )


# --- views ---------------------------------------------------------------------------------------------------


def _names(g: Graph) -> DataFrame:
    return F.broadcast(specs.protocols(g.spark).select(F.col("id").alias("protocol_id"), F.col("name").alias("protocol_name")))


def topology(g: Graph) -> DataFrame:
    """V19."""
    p = specs.protocols(g.spark).select(F.col("id").alias("protocol_id"), F.col("name").alias("protocol_name"), "transport", "encoding", "session_type_client", "session_type_server")
    d = specs.links(g.spark).join(F.broadcast(p), "protocol_id")
    return d.select("source_component", "target_component", "protocol_id", "protocol_name", "transport", "encoding", "session_type_client", "session_type_server", "label", "direction")


def coverage(g: Graph) -> DataFrame:
    """Each participant counts once; endpoints are counted beside (the documented intent)."""
    c = conformance(g).join(specs.participants(g.spark).drop("description"), ["protocol_id", "component"])
    c = c.groupBy("protocol_id").agg(listed(F.concat("component", F.lit("("), "role", F.lit(")"))).alias("participants"), tally(F.col("status") == "conforming").alias("conforming_count"), tally(F.col("status") == "missing").alias("missing_count"), counted_as("n"))
    e = endpoints(g).groupBy("protocol_id").agg(counted_as("total_endpoints"))
    p = specs.protocols(g.spark).select(F.col("id").alias("protocol_id"), "name", "transport")
    d = p.join(c, "protocol_id").join(e, "protocol_id", "left")
    status = F.when(F.col("conforming_count") == F.col("n"), "fully_covered").when(F.col("conforming_count") > 0, "partially_covered").otherwise("no_coverage")
    return d.select("protocol_id", "name", "transport", "participants", "conforming_count", "missing_count", zero("total_endpoints").alias("total_endpoints"), status.alias("coverage_status"))


def endpoint_detail(g: Graph) -> DataFrame:
    """V21."""
    return endpoints(g).join(_names(g), "protocol_id").select("id", "protocol_id", "protocol_name", "component", "role", "endpoint_type", "function_name", "package", "file", "line", "url_path", "confidence")


def duality(g: Graph) -> DataFrame:
    """Whether the server's type is the client's with sends and receives swapped; the check is made."""
    dual = F.translate("session_type_client", "!?", "?!") == F.col("session_type_server")
    status = F.when(dual, "VERIFIED: client and server types are proper duals").otherwise("WARNING: session types may not be dual — potential protocol violation")
    theorem = F.lit("Honda 1998 Theorem: dual(dual(S)) = S")
    return specs.protocols(g.spark).select(F.col("id").alias("protocol_id"), "name", "session_type_client", "session_type_server", dual.cast("long").alias("is_dual"), status.alias("duality_status"), theorem.alias("theorem_reference"))


def causality_summary(g: Graph) -> DataFrame:
    """V23."""
    e = endpoints(g)
    of = lambda side: e.select(F.col("id").alias(f"{side}_endpoint"), F.col("function_name").alias(f"{side}_function"))
    d = causality(g, e).join(of("source"), "source_endpoint", "left").join(of("target"), "target_endpoint", "left")
    return d.select("kind", "protocol_id", "description", "source_function", "target_function")


def association_summary(g: Graph) -> DataFrame:
    """V24."""
    a = association(g).join(_names(g), "protocol_id")
    verdict = F.when(F.col("is_associated") == 1, "✓ ASSOCIATED").otherwise("✗ NOT ASSOCIATED")
    shape = F.when(F.col("acyclic_dependencies") == 1, "acyclic").otherwise(F.concat("cycle_count", F.lit(" cycle(s)")))
    return a.select("protocol_id", "protocol_name", verdict.alias("verdict"), F.concat_ws("/", "projectable_count", "total_participants").alias("projection_coverage"), F.concat("conforming_count", F.lit(" conforming")).alias("subtype_status"), shape.alias("dependency_graph"), "s_safe", "s_deadlock_free", "s_live", "errata_reference")


def subtype_detail(g: Graph) -> DataFrame:
    """V25."""
    holds = F.when(F.col("is_conforming") == 1, "≤ (subtype holds)").otherwise("⊄ (not a subtype)")
    return subtype_check(g).join(_names(g), "protocol_id").select("protocol_id", "protocol_name", "component", "projected_type", "actual_behavior", "relation", holds.alias("conformance"), "subtype_direction", "explanation")


def cycles(g: Graph) -> DataFrame:
    """Cycles among the causal pairs."""
    return dependency_cycles(causality(g)).drop("involved_protocols")


def calls_as_pairs(g: Graph) -> DataFrame:
    """Calls in the place of causal pairs: a caller waits for its callee."""
    d = g.step("call").where("source <> target").distinct()
    return d.select(F.col("source").alias("source_endpoint"), F.col("target").alias("target_endpoint"), F.lit("IO").alias("kind"), F.lit("calls").alias("protocol_id"), F.lit("call").alias("description"))


def mutual_cycles(g: Graph) -> DataFrame:
    """RG13: cycles of two and three among calls.

    Three: every call is dealt by the end with fewer neighbours, so a hub's calls don't all meet each other.
    """
    e = g.step("call").where("source <> target").distinct()
    back = e.select(F.col("target").alias("source"), F.col("source").alias("target"))
    two = e.join(back, ["source", "target"], "left_semi").where("source < target")
    two = two.select(F.concat_ws(" → ", "source", "target", "source").alias("cycle_path"), F.lit(2).cast("long").alias("cycle_length"))
    degree = e.select(F.col("source").alias("id")).union(e.select(F.col("target").alias("id"))).groupBy("id").agg(counted_as("n"))
    at = lambda end: degree.select(F.col("id").alias(end), F.struct("n", "id").alias(f"{end}_rank"))
    ranked = e.join(at("source"), "source").join(at("target"), "target")
    low = F.when(F.col("source_rank") < F.col("target_rank"), F.col("source"))
    # of a cycle's three nodes one ranks lowest: its call out and its call in are joined there, the third is looked up
    out = ranked.where(low.isNotNull()).select(F.col("source").alias("a"), F.col("target").alias("b"))
    came = ranked.where(low.isNull()).select(F.col("target").alias("a"), F.col("source").alias("c"))
    three = out.join(came, "a").join(e, (F.col("b") == F.col("source")) & (F.col("c") == F.col("target")), "left_semi")
    least = F.least("a", "b", "c")
    turned = F.when(F.col("a") == least, F.concat_ws(" → ", "a", "b", "c", "a")).when(F.col("b") == least, F.concat_ws(" → ", "b", "c", "a", "b")).otherwise(F.concat_ws(" → ", "c", "a", "b", "c"))
    return two.unionByName(three.select(turned.alias("cycle_path"), F.lit(3).cast("long").alias("cycle_length")))
