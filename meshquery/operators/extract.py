"""Graph algorithms that producers of a graph need (G3-G24): chains, metrics, pairings, dominators, type relations."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sqlcompat import counted_as, tally, zero
from ..graph import Graph
from ..session import kept
from . import callgraph, sweep

# Package; type; method; kind of synchronisation (* stands for any type)
SYNC = """
sync; Mutex; Lock; mutex_lock
sync; Mutex; Unlock; mutex_unlock
sync; RWMutex; Lock; rwmutex_lock
sync; RWMutex; Unlock; rwmutex_unlock
sync; RWMutex; RLock; rwmutex_rlock
sync; RWMutex; RUnlock; rwmutex_runlock
sync; WaitGroup; Add; wg_add
sync; WaitGroup; Done; wg_done
sync; WaitGroup; Wait; wg_wait
sync; Once; Do; once_do
sync; Cond; Wait; cond_wait
sync; Cond; Signal; cond_signal
sync; Cond; Broadcast; cond_broadcast
context; *; Cancel; context_cancel
"""


def chain(df: DataFrame, group: str, *order: str | Column, reverse: bool = False) -> DataFrame:
    """Source, target, rank of neighbours in a group's order: siblings, init functions, or (reversed) defers."""
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    w = Window.partitionBy(group).orderBy(*[k.desc() if reverse else k for k in keys])
    d = df.select(F.col("id").alias("source"), F.lead("id").over(w).alias("target"), F.row_number().over(w).cast("long").alias("rank"))
    return d.where("target is not null")


def enclosing_scopes(scopes: DataFrame, nodes: DataFrame, width: int = sweep.WIDTH) -> DataFrame:
    """Source, target from every scope and node to the nearest scope around it; those without one are left out.

    ``scopes``: id, file, start, end; ``nodes``: id, file, at.  A scope holds the places from start up to before end, and the scopes
    of a file lie in one another or apart; of equal scopes the lesser id is the outer one, and empty scopes hold nothing.  Rows
    with nulls are left out.

    A file is swept once: the depth at a place is what has been opened less what has been closed, and the scope around it is the
    last one that was opened at that depth.  A file of any length is swept in pieces (:mod:`sweep`).
    """
    null = F.lit(None).cast("long")
    event = lambda at, turn, rank, step: F.struct(at.alias("at"), F.lit(turn).alias("turn"), rank.alias("rank"), F.lit(step).alias("step"))
    start, end = F.col("start"), F.col("end")
    holds = F.array(event(end, 0, start, -1), event(start, 1, -end, 1))
    s = scopes.where("id IS NOT NULL AND start IS NOT NULL AND end IS NOT NULL").select("file", "id", F.inline(F.when(start < end, holds).otherwise(F.array(event(start, 2, null, 0)))))
    n = nodes.where("id IS NOT NULL AND at IS NOT NULL").select("file", "id", F.inline(F.array(event(F.col("at"), 2, null, 0))))
    d = s.unionByName(n).where("file IS NOT NULL")
    ties = ("turn", "rank", "id", "step")
    d = sweep.running_total(d, ["file"], "at", F.col("step"), "depth", ties, width).where("turn > 0")
    opened = d.where("turn = 1").withColumn("opened", F.col("id"))
    asked = d.withColumn("depth", F.col("depth") - F.col("step")).withColumn("opened", F.lit(None).cast("string")).where("depth > 0")
    asked = asked.withColumn("step", F.lit(2)).unionByName(opened)  # a scope is asked about at the depth around it, and answers at its own
    d = sweep.latest(asked, ["file", "depth"], "at", {"scope": F.col("opened")}, ties, width)
    return d.where("step = 2").select(F.col("id").alias("source"), F.col("scope").alias("target"))


def siblings(g: Graph) -> DataFrame:
    """Each statement of a block to the next."""
    s = g.step("ast").join(g.of("block").select(F.col("id").alias("source")), "source").join(g.nodes.select(F.col("id").alias("target"), "line", "col"), "target")
    return chain(s.select(F.col("target").alias("id"), "source", "line", "col"), "source", "line", "col", "id")


def defer_order(g: Graph) -> DataFrame:
    """Defers of a function, last first."""
    return chain(g.of("defer").select("id", "parent_function", "line", "col"), "parent_function", "line", "col", "id", reverse=True)


def init_order(g: Graph) -> DataFrame:
    """Init functions of a package in source order."""
    return chain(g.functions.where("name = 'init'").select("id", "package", "file", "line"), "package", "file", "line", "id")


def sync_kind(calls: DataFrame) -> DataFrame:
    """``calls`` (package, type, method) with the kind of synchronisation, or null."""
    rows = [tuple(p.strip() for p in line.split(";")) for line in SYNC.strip().splitlines()]
    spec = F.broadcast(calls.sparkSession.createDataFrame(rows, "p string, t string, m string, sync_kind string"))
    return calls.join(spec, (F.col("package") == F.col("p")) & (F.col("method") == F.col("m")) & ((F.col("type") == F.col("t")) | (F.col("t") == "*")), "left").drop("p", "t", "m")


VERB = r"%%|%[+\-# 0]*[0-9]*(?:\.[0-9]*)?(?s:.)"  # one directive of a format text


def error_wraps(calls: DataFrame) -> DataFrame:
    """Id, argument (from 0) of every error that a call wraps.

    ``calls``: id, callee, format (the first argument if it is a text) and args, the number of arguments.  fmt.Errorf
    wraps what its %w verbs stand for, each verb but %% taking one argument; errors.Join wraps all.
    """
    verbs = F.filter(F.regexp_extract_all("format", F.lit(VERB), F.lit(0)), lambda v: v != "%%")
    places = F.transform(verbs, lambda v, k: F.when(F.right(v, F.lit(1)) == "w", k + 1))
    some = F.filter(F.coalesce(places, F.array()), lambda k: k.isNotNull() & (k < F.col("args")))
    every = F.when(F.col("args") > 0, F.sequence(F.lit(0), F.col("args").cast("int") - 1))
    hit = F.when(F.col("callee") == "errors.Join", every).when(F.col("callee") == "fmt.Errorf", some)
    return calls.select("id", F.explode(hit).alias("argument")).withColumn("argument", F.col("argument").cast("long"))


def complexity(g: Graph, enclosing: DataFrame | None = None) -> DataFrame:
    """function_id, complexity, loc, num_params; decisions of literals count for the functions around them too.

    ``enclosing``: literal and function around it (id, outer), one row for each such pair at any depth.
    """
    k = F.col("kind")
    decides = k.isin("if", "for", "case") | ((k == "binary_expr") & F.col("name").isin("&&", "||"))
    n = g.nodes.where("parent_function is not null").groupBy(F.col("parent_function").alias("id")).agg(tally(decides).alias("own"), tally(k == "parameter").alias("num_params"))
    if enclosing is not None:
        up = n.join(enclosing, "id").groupBy(F.col("outer").alias("id")).agg(F.sum("own").alias("inner"))
        n = n.join(up, "id", "full").withColumn("own", zero("own") + zero("inner"))
    d = g.functions.join(n, "id", "left")
    return d.select(F.col("id").alias("function_id"), (zero("own") + 1).alias("complexity"), F.coalesce(F.col("end_line") - F.col("line") + 1, F.lit(0)).alias("loc"), zero("num_params").alias("num_params"))


def fans(g: Graph) -> DataFrame:
    """Metrics with fan-in and fan-out counted again; functions without metrics get a row of zeros."""
    came = g.step("call").groupBy(F.col("target").alias("function_id")).agg(counted_as("fan_in"))
    went = g.step("call").groupBy(F.col("source").alias("function_id")).agg(counted_as("fan_out"))
    d = g.metrics.drop("fan_in", "fan_out").join(came.join(went, "function_id", "full"), "function_id", "full")
    return d.select("function_id", *[zero(c).alias(c) for c in ("cyclomatic_complexity", "fan_in", "fan_out", "loc", "num_params")])


def recursion(g: Graph) -> DataFrame:
    """Functions that call themselves."""
    return g.step("call").where("source = target").select(F.col("source").alias("function_id")).distinct()


def param_in(g: Graph) -> DataFrame:
    """Argument to formal parameter at the same place; one later where the call goes through an interface."""
    index = g.edge_properties.where("edge_kind = 'argument' and key = 'index'").select(F.col("source").alias("call"), F.col("target").alias("arg"), F.col("value").cast("long").alias("index"))
    order = Window.partitionBy("parent_function").orderBy("line", "col", "id")
    formal = g.of("parameter").select(F.col("parent_function").alias("callee"), F.col("id").alias("formal"), (F.row_number().over(order) - 1).cast("long").alias("place"))
    through = g.having("dispatch_type", "interface").select(F.col("node_id").alias("call"), F.lit(1).alias("shift"))
    site = g.step("call_site").select(F.col("source").alias("call"), F.col("target").alias("callee"))
    d = index.join(site, "call").join(through, "call", "left").withColumn("place", F.col("index") + F.coalesce("shift", F.lit(0)))
    return d.join(formal, ["callee", "place"]).select(F.col("arg").alias("source"), F.col("formal").alias("target"), "index")


def cfg_ends(g: Graph) -> DataFrame:
    """Entry edges to blocks nothing leads to, exit edges from blocks that lead nowhere."""
    b = g.of("basic_block").select("id", "parent_function")
    e = g.step("cfg")
    entry = b.join(e, F.col("id") == F.col("target"), "left_anti").select(F.col("parent_function").alias("source"), F.col("id").alias("target"), F.lit("entry").alias("label"))
    leave = b.join(e, F.col("id") == F.col("source"), "left_anti").select(F.col("id").alias("source"), F.col("parent_function").alias("target"), F.lit("exit").alias("label"))
    return entry.unionByName(leave)


def branches(ends: DataFrame) -> DataFrame:
    """Source, target, label of the ways out of a block: true and false where it branches, none otherwise.

    ``ends``: source, target, branches (whether the block ends in an if) and place, the successor's place from 0.
    """
    label = F.when(F.col("branches") & (F.col("place") == 0), "true").when(F.col("branches") & (F.col("place") == 1), "false")
    return ends.select("source", "target", label.alias("label"))


def uses(g: Graph) -> DataFrame:
    """Definition to use, without loops on one node."""
    return g.step("dfg").where("source <> target").distinct()


def pairs(df: DataFrame, site: str, from_kind: str, to_kind: str) -> DataFrame:
    """Source, target for every node of one kind with every one of another at the same site.

    ``df``: id, kind and the site: the channel a send or receive reaches, or the function of a panic or recover.
    """
    a = df.where(F.col("kind") == from_kind).select(site, F.col("id").alias("source"))
    b = df.where(F.col("kind") == to_kind).select(site, F.col("id").alias("target"))
    return a.join(b, site).select("source", "target").distinct()


def channel_ends(flows: DataFrame, makes: DataFrame, ends: DataFrame, component: DataFrame | None = None) -> DataFrame:
    """Channel, id, kind: the uses that each channel reaches, however far.

    ``makes``: id of channel creations; ``ends``: id, kind of uses; ``flows``: how channels pass on: assignments, merges, stores and
    loads, captures of closures, arguments.  Values that pass a channel round in a cycle are one value.
    """
    types = callgraph.Types(flows, makes.select(F.col("id").alias("value"), F.col("id").alias("type")), component)
    return types.at(ends.withColumnRenamed("id", "value")).select(F.col("type").alias("channel"), F.col("value").alias("id"), "kind").distinct()


def channel_flow(flows: DataFrame, makes: DataFrame, ends: DataFrame) -> DataFrame:
    """Sends to receives of one channel, a row for each pair; :func:`channel_ends` says the same without pairs."""
    return pairs(channel_ends(flows, makes, ends), "channel", "send", "receive")


def panic_recover(g: Graph, deferred: DataFrame | None = None) -> DataFrame:
    """Panics to recovers of one function, and to those of functions that it defers (``deferred``: function, literal)."""
    d = g.of("call").where(F.col("name").isin("panic", "recover")).select("id", F.col("name").alias("kind"), "parent_function")
    if deferred is not None:
        inner = d.where("kind = 'recover'").join(deferred, F.col("parent_function") == F.col("literal")).select("id", "kind", F.col("function").alias("parent_function"))
        d = d.union(inner)
    return pairs(d, "parent_function", "panic", "recover")


# --- dominators ----------------------------------------------------------------------------------------------


def immediate(nodes: list[str], succ: dict[str, list[str]], root: str) -> dict[str, str]:
    """Immediate dominators of what the root reaches: meet of the predecessors' until nothing changes."""
    order, seen, stack = [], {root}, [(root, iter(succ.get(root, ())))]
    while stack:
        node, it = stack[-1]
        for nxt in it:
            if nxt not in seen:
                seen.add(nxt)
                stack.append((nxt, iter(succ.get(nxt, ()))))
                break
        else:
            order.append(node)
            stack.pop()
    number = {n: i for i, n in enumerate(order)}
    pred = defaultdict(list)
    for a in order:
        for b in succ.get(a, ()):
            pred[b].append(a)
    idom = {root: root}
    changed = True
    while changed:
        changed = False
        for n in reversed(order[:-1]):
            best = None
            for p in pred[n]:
                if p not in idom:
                    continue
                if best is None:
                    best = p
                    continue
                a, b = best, p
                while a != b:
                    while number[a] < number[b]:
                        a = idom[a]
                    while number[b] < number[a]:
                        b = idom[b]
                best = a
            if best is not None and idom.get(n) != best:
                idom[n] = best
                changed = True
    return idom


def _trees(pdf: pd.DataFrame) -> pd.DataFrame:
    edges = [(a, b) for a, b in zip(pdf["source"], pdf["target"]) if b is not None]
    nodes = sorted(set(pdf["source"]) | {b for _, b in edges})
    succ, pred = defaultdict(list), defaultdict(list)
    for a, b in edges:
        succ[a].append(b)
        pred[b].append(a)
    entry = [n for n in nodes if not pred[n]] or nodes[:1]
    leave = [n for n in nodes if not succ[n]]
    out = []
    start, stop = "\0entry", "\0exit"
    forward = dict(succ) | {start: entry}
    out += [(a, b, "dom") for b, a in immediate(nodes, forward, start).items() if a != b and a != start]
    # where nothing leaves a region, its blocks have no post-dominator and depend on every branch that leads to them
    post = {b: a for b, a in immediate(nodes, dict(pred) | {stop: leave}, stop).items() if a != stop}
    out += [(a, b, "pdom") for b, a in post.items()]
    for u in nodes:
        for v in set(succ[u]) if len(succ[u]) > 1 else ():
            at = v
            while at is not None and at != post.get(u):
                out.append((u, at, "cdg"))
                at = post.get(at)
    return pd.DataFrame(sorted(set(out)), columns=["source", "target", "kind"])


def dominance(g: Graph) -> DataFrame:
    """Dom, pdom and cdg edges of every function's blocks.

    Functions are independent, and one function's blocks are read by one task.  Blocks that lead nowhere are exits; several
    entries or exits hang on one of no name, which is in no edge.  Blocks that can't reach an exit have no post-dominator, so
    a branch above them decides on them alone.
    """
    b = g.of("basic_block").select(F.col("id").alias("source"), "parent_function")
    d = b.join(g.step("cfg"), "source", "left")
    return d.groupBy("parent_function").applyInPandas(_trees, "source string, target string, kind string")


# --- types ---------------------------------------------------------------------------------------------------


FIRST = 8


def implementations(methods: DataFrame, interfaces: DataFrame) -> DataFrame:
    """Type, interface where the type has all of a non-empty interface's methods: relational division.

    ``methods``: type, method; ``interfaces``: interface, method.

    A type must have the method of the interface that the fewest types have, so only those types are asked for more: first for
    the ``FIRST`` scarcest, then for all.  Methods that nearly all types share make no pairs.  Rows with nulls are left out.
    """
    m = kept(methods.where("type IS NOT NULL AND method IS NOT NULL").select("type", "method").distinct())
    owners = m.groupBy("method").agg(counted_as("owners"))
    i = interfaces.where("interface IS NOT NULL").select("interface", "method").distinct().join(owners, "method", "left")
    scarce = Window.partitionBy("interface").orderBy(F.asc_nulls_first("owners"), "method")
    i = kept(i.select("interface", "method", F.row_number().over(scarce).alias("rank")))

    def having_all(found: DataFrame, asked: DataFrame) -> DataFrame:
        need = asked.groupBy("interface").agg(counted_as("need"))
        got = found.join(asked, "interface").join(m, ["type", "method"], "left_semi").groupBy("interface", "type").agg(counted_as("got"))
        return got.join(need, "interface").where("got = need").select("interface", "type")

    found = kept(i.where("rank = 1").join(m, "method").select("interface", "type"))
    found = kept(having_all(found, i.where(F.col("rank") <= FIRST).drop("rank")))
    return having_all(found, i.drop("rank")).select("type", "interface")


def satisfied(implements: DataFrame, methods: DataFrame, interfaces: DataFrame) -> DataFrame:
    """Method nodes of a type beside those of the interfaces it implements.  Both: owner, method, id."""
    a = methods.select(F.col("type"), "method", F.col("id").alias("source"))
    b = interfaces.select("interface", "method", F.col("id").alias("target"))
    return implements.join(a, "type").join(b, ["interface", "method"]).select("source", "target")


def type_edges(declared: DataFrame) -> DataFrame:
    """alias_of and embeds edges.  ``declared``: id, alias_of (another type, or null) and embedded (types, or null)."""
    alias = declared.where("alias_of is not null").select(F.col("id").alias("source"), F.col("alias_of").alias("target"), F.lit("alias_of").alias("kind"))
    inner = declared.where("alias_of is null").select(F.col("id").alias("source"), F.explode("embedded").alias("target"), F.lit("embeds").alias("kind"))
    return alias.unionByName(inner.where("target is not null"))


def has_method(types: DataFrame, methods: DataFrame) -> DataFrame:
    """Type to each of its methods.  ``types``: id, name; ``methods``: id, receiver; both with package, or neither.

    A receiver may be a pointer.
    """
    by = ["name", "package"] if "package" in types.columns and "package" in methods.columns else ["name"]
    m = methods.withColumn("name", F.regexp_replace("receiver", r"^\*", ""))
    t = types.select(F.col("id").alias("source"), *by)
    return m.select(F.col("id").alias("target"), *by).join(t, by).select("source", "target").distinct()


def relative(paths: DataFrame, modules: list[tuple[str, str]]) -> DataFrame:
    """``path`` below its module, by the longest module that fits; the first module has no prefix, its root is main.

    ``modules``: (module path, prefix), the primary one first with an empty prefix.
    """
    rows = sorted(modules, key=lambda m: -len(m[0]))
    out = F.col("path")
    for module, prefix in reversed(rows):
        below = F.substring("path", len(module) + 2, 1 << 30)
        full = F.concat_ws("/", *([F.lit(prefix)] if prefix else []), F.when(below != "", below))
        out = F.when((F.col("path") == module) | F.col("path").startswith(f"{module}/"), F.when(full == "", "main").otherwise(full)).otherwise(out)
    return paths.withColumn("relative", out)
