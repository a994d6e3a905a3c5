"""Which functions a call can reach, by the types that flow to its receiver.

Values pass types on along flows (assignments, merges, arguments to parameters, results).  A value that is made with a type
gives it to all values that it reaches.  A call through an interface reaches the method of that name of every type that
reaches its receiver; a call of a function value reaches every function that does (functions are types of their own, see
:data:`FUNCTION`); a plain call has its callee.

Values of one cycle share all their types, so cycles are found first (:func:`strong_components`) and every one of them
is one value from then on, however many values, flows and types it has.  A value that is made with no type and takes all it has from one
other shares that one's types, so the two are one value as well (:func:`_shared`).  Types then go level by level over what is left, and a
type that has reached a value is not sent to it again.  All tables stay distributed; each level is stored in the shared folder.
Rounds grow with the number of values on a path at which flows meet or types are made, not with its length or the number of values.

Nulls: rows with a null end, type or site are left out.  Repeated rows count once.  A receiver that nothing reaches has no
callee.  Extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sqlcompat import counted_as
from ..session import checkpointed, kept
from . import traverse

PIECE = 50_000  # edges that one task looks at; connected pieces with more are looked at by all tasks together
WORTH = 0.75  # a pass that leaves more than this share of the edges is the last one
FUNCTION = "func:"  # a type of this name and a function's id is that function as a value


def _both_ways(e: DataFrame) -> DataFrame:
    """Edges (u, v) that could lie on a cycle: something leads to u and something goes on from v."""
    into, on = e.select(F.col("v").alias("u")).distinct(), e.select(F.col("u").alias("v")).distinct()
    return e.join(into, "u", "left_semi").join(on, "v", "left_semi").select("u", "v")


def _trimmed(e: DataFrame) -> DataFrame:
    """``e`` without most of the edges that lie on no cycle for want of an edge before or after; passes go on while they take many.

    Each pass is stored: it reads what the one before has left three times.
    """
    size = e.count()
    while size:
        e = kept(_both_ways(e))
        now = e.count()
        if now > WORTH * size:
            break
        size = now
    return e


def _pieces(e: DataFrame) -> DataFrame:
    """(id, piece): the least id of the nodes that are connected with a node, whatever the edges' direction.

    Each round a node takes the least piece of its neighbours, tells the node that its own piece is named by, and then takes the piece of
    the one it has got: ways halve, so rounds grow with the logarithm of a piece's length.
    """
    both = kept(e.union(e.select("v", "u")).toDF("u", "v"))
    piece = kept(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("id"), F.least("u", "v").alias("piece")))
    while True:
        near = both.join(piece.withColumnRenamed("id", "u"), "u").groupBy(F.col("v").alias("id")).agg(F.min("piece").alias("near"))
        least = piece.join(near, "id").select("id", "piece", F.least("piece", "near").alias("least"))
        told = F.explode(F.array("id", "piece"))
        least = kept(least.select(told.alias("id"), "least").groupBy("id").agg(F.min("least").alias("piece")))
        now = kept(least.join(least.select(F.col("id").alias("piece"), F.col("piece").alias("least")), "piece").select("id", F.col("least").alias("piece")))
        if now.join(piece.withColumnRenamed("piece", "old"), "id").where("piece < old").isEmpty():
            return now
        piece = now


def _cycles(pdf: pd.DataFrame) -> pd.DataFrame:
    """id, component of the strong components of more than one node (Tarjan's algorithm, without recursion)."""
    succ = defaultdict(list)
    for a, b in zip(pdf["u"], pdf["v"]):
        succ[a].append(b)
    number, low, open_, out = {}, {}, [], []
    for root in list(succ):
        todo = [] if root in number else [(root, iter(succ[root]))]
        if todo:
            number[root] = low[root] = len(number)
            open_.append(root)
        while todo:
            node, after = todo[-1]
            for b in after:
                if b not in number:
                    number[b] = low[b] = len(number)
                    open_.append(b)
                    todo.append((b, iter(succ.get(b, ()))))
                    break
                low[node] = min(low[node], low.get(b, low[node]))  # low has the nodes of no component yet
            else:
                todo.pop()
                if todo:
                    low[todo[-1][0]] = min(low[todo[-1][0]], low[node])
                if low[node] == number[node]:
                    done = [open_.pop()]
                    while done[-1] != node:
                        done.append(open_.pop())
                    for x in done:
                        del low[x]
                    if len(done) > 1:
                        least = min(done)
                        out += [(x, least) for x in done]
    return pd.DataFrame(out, columns=["id", "component"])


def _least_before(e: DataFrame) -> DataFrame:
    """(id, color): the least id from which a node can be reached, itself included; some hops are taken at once."""
    color = checkpointed(e.select(F.col("u").alias("id")).union(e.select("v")).distinct().withColumn("color", F.col("id")))
    while True:
        now = color
        for _ in range(traverse.EVERY):
            now = now.union(now.join(e, F.col("id") == F.col("u")).select("v", "color")).groupBy("id").agg(F.min("color").alias("color"))
        now = checkpointed(now)
        if now.join(color.withColumnRenamed("color", "old"), "id").where("color < old").isEmpty():
            return now
        color = now


def _by_colors(e: DataFrame) -> DataFrame:
    """(id, component) of a graph of any size: every node gets the least id that leads to it; where that node can be reached back
    among nodes of the same least id, they are one component.  These go, and what is left is looked at again."""
    found = e.select(F.col("u").alias("id"), F.col("v").alias("component")).limit(0)
    while not e.isEmpty():
        color = _least_before(e)
        of = color.select(F.col("id").alias("u"), F.col("color").alias("cu")), color.select(F.col("id").alias("v"), F.col("color").alias("cv"))
        inside = e.join(of[0], "u").join(of[1], "v").where("cu = cv")  # its edges join nodes of one color, so a walk stays in it
        met = traverse.nearest(inside.select(F.col("v").alias("source"), F.col("u").alias("target")), color.where("id = color").select("id"), 1 << 30)
        met = checkpointed(met.select("id").join(color, "id"))
        found = found.union(met.select("id", F.col("color").alias("component")))
        gone = met.select(F.col("id").alias("u")), met.select(F.col("id").alias("v"))
        e = _trimmed(checkpointed(e.join(gone[0], "u", "left_anti").join(gone[1], "v", "left_anti").select("u", "v")))
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return found.join(sizes, "component", "left_semi").select("id", "component")


def strong_components(edges: DataFrame, most: int = PIECE) -> DataFrame:
    """(id, component) of every node on a cycle with others; component is the least id of the cycle's nodes.

    ``edges``: source, target.  Edges that can't lie on a cycle go first.  Of the rest a cycle lies within one connected piece, and pieces of up
    to ``most`` edges are dealt out whole, many to a task; those of more are left to :func:`_by_colors`.
    """
    e = edges.where("source IS NOT NULL AND target IS NOT NULL AND source <> target").select(F.col("source").alias("u"), F.col("target").alias("v")).distinct()
    e = _trimmed(kept(e))
    e = kept(e.join(_pieces(e).withColumnRenamed("id", "u"), "u"))
    large = kept(e.groupBy("piece").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("piece"))
    deal = F.pmod(F.xxhash64("piece"), F.lit(e.count() // most + 1))
    found = e.join(large, "piece", "left_anti").groupBy(deal.alias("deal")).applyInPandas(_cycles, "id string, component string")
    return found if large.isEmpty() else found.union(_by_colors(checkpointed(e.join(large, "piece", "left_semi").select("u", "v"))))


def _merged(df: DataFrame, component: DataFrame, *columns: str) -> DataFrame:
    """``df`` with values replaced by their components."""
    for c in columns:
        df = df.join(component.select(F.col("id").alias(c), F.col("component").alias("_to")), c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
    return df


def _shared(ends: DataFrame, own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Flows without cycles that say the same of fewer values, and (id, component) of the values that are now part of another.

    ``own``: id of the values that are made with a type.  A value that isn't, and takes what it has from one other, becomes part of that.  What
    comes from values that have nothing goes.  Both leave fewer flows, so it is done again while that takes many.
    """
    e, same = kept(ends.distinct()), None
    size = e.count()
    while size:
        has = own.select(F.col("id").alias("source")).union(e.select("target")).distinct()
        fed = kept(e.join(has, "source", "left_semi"))
        one = fed.groupBy(F.col("target").alias("id")).agg(F.min("source").alias("component"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
        one = kept(one.join(own, "id", "left_anti"))
        rest = fed.join(one.select(F.col("id").alias("target")), "target", "left_anti")
        while not one.join(one.select(F.col("id").alias("component")), "component", "left_semi").isEmpty():
            one = kept(_merged(_merged(one, one, "component"), one, "component"))
        e = kept(_merged(rest, one, "source").distinct())
        same = one if same is None else kept(_merged(same, one, "component").unionByName(one))
        now = e.count()
        if now > WORTH * size:
            break
        size = now
    return e, same if same is not None else e.toDF("id", "component")


class Types:
    """The types that reach every value.

    ``flows``: source, target; ``made``: value, type; ``component``: what :func:`strong_components` has found of the flows, if it's known.
    """

    def __init__(self, flows: DataFrame, made: DataFrame, component: DataFrame | None = None):
        self.component = component if component is not None else kept(strong_components(flows))
        ends = _merged(flows.where("source IS NOT NULL AND target IS NOT NULL").select("source", "target"), self.component, "source", "target").where("source <> target")
        seeds = kept(_merged(made.where("value IS NOT NULL AND type IS NOT NULL").select("value", "type"), self.component, "value").select("type", F.col("value").alias("id")).distinct())
        ends, self.same = _shared(ends, kept(seeds.select("id").distinct()))
        self.reach = traverse.nearest(ends, seeds, 1 << 30, ("type",)).select("type", "id")

    def _placed(self, values: DataFrame) -> DataFrame:
        """``values`` with ``at``: the value that stands for theirs."""
        return _merged(_merged(values.withColumn("at", F.col("value")), self.component, "at"), self.same, "at")

    def reached(self, values: DataFrame) -> DataFrame:
        """type and reached: of how many of the ``values``; those that share their types are counted before they meet them."""
        n = self._placed(values).groupBy("at").agg(counted_as("n"))
        return self.reach.join(n, F.col("id") == F.col("at")).groupBy("type").agg(F.sum("n").alias("reached"))

    def at(self, values: DataFrame) -> DataFrame:
        """``values`` (value and more) with a row for each type that reaches the value."""
        return self._placed(values).join(self.reach.withColumnRenamed("id", "at"), "at").drop("at")


def resolve(types: Types, sites: DataFrame, methods: DataFrame) -> DataFrame:
    """site, caller, callee, dynamic of all calls.

    ``sites``: site, caller and either callee, or receiver and method, or receiver alone for a call of a function value.
    ``methods``: type, method, function.
    """
    plain = sites.where("callee IS NOT NULL").select("site", "caller", "callee", F.lit(False).alias("dynamic"))
    open_ = sites.where("callee IS NULL AND receiver IS NOT NULL").select("site", "caller", "method", F.col("receiver").alias("value"))
    typed = types.at(open_)
    named = typed.where("method IS NOT NULL").join(methods.select("type", "method", F.col("function").alias("callee")), ["type", "method"])
    values = typed.where(F.col("method").isNull() & F.col("type").startswith(FUNCTION)).withColumn("callee", F.substring("type", len(FUNCTION) + 1, 1 << 30))
    dynamic = named.unionByName(values, allowMissingColumns=True).select("site", "caller", "callee", F.lit(True).alias("dynamic"))
    return plain.union(dynamic).where("site IS NOT NULL AND caller IS NOT NULL").distinct()


def call_graph(resolved: DataFrame, known: DataFrame) -> DataFrame:
    """source, target, kind, dynamic: call and call_site edges, and call_to_return edges from a caller to its sites.

    ``known``: id of the functions of the program itself.  Calls between two others are left out; a callee that isn't known is a
    stub, whose edges from its site say so by kind ``stub``.  A call edge is dynamic if one of its sites is.
    """
    own = known.select("id").distinct()
    d = resolved.join(own.withColumnsRenamed({"id": "caller"}).withColumn("in_", F.lit(True)), "caller", "left").join(own.withColumnsRenamed({"id": "callee"}).withColumn("out_", F.lit(True)), "callee", "left")
    d = d.where("in_ OR out_")
    calls = d.groupBy(F.col("caller").alias("source"), F.col("callee").alias("target")).agg(F.max("dynamic").alias("dynamic")).select("source", "target", F.lit("call").alias("kind"), "dynamic")
    kind = F.when(F.col("out_"), "call_site").otherwise("stub")
    sites = d.groupBy(F.col("site").alias("source"), F.col("callee").alias("target"), kind.alias("kind")).agg(F.max("dynamic").alias("dynamic"))
    back = d.groupBy(F.col("caller").alias("source"), F.col("site").alias("target")).agg(F.max("dynamic").alias("dynamic")).select("source", "target", F.lit("call_to_return").alias("kind"), "dynamic")
    return calls.union(sites).union(back)
