"""Declarative tree queries: anchor, path, predicate, limit, projection, order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import Typed, compile_expr, parse, predicate
from ..functions.columns import Compiler, type_of
from .transforms import environment, of_columns
from .tree import Tree


@dataclass(frozen=True)
class InstanceQuery:
    """Stages run in this order: anchor, path (edge kinds), predicate, limit, projection, sort by a field as text."""

    anchor: str
    path: tuple[str, ...] = ()
    predicate: object = None
    limit: int | None = None
    project: tuple[str, ...] | None = None
    group_by: str | None = None


def node_environment(nodes: DataFrame) -> dict[str, Typed]:
    """What a predicate over nodes may name: fields, ``attrs``, and _anchor, _id, _value, _children_count."""
    env = environment(of_columns(nodes.schema["fields"].dataType, "fields")) if "fields" in nodes.columns else {}
    env |= {"_anchor": Typed(F.col("anchor"), "string"), "_id": Typed(F.col("node_id").cast("bigint"), "int")}
    if "value" in nodes.columns:
        env["_value"] = Typed(F.col("value"), type_of(nodes.schema["value"].dataType))
    if "_children_count" in nodes.columns:
        env["_children_count"] = Typed(F.col("_children_count"), "int")
    return env


def with_children_count(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    counts = arcs.groupBy("record_id", F.col("parent").alias("node_id")).agg(F.count("*").alias("_children_count"))
    return nodes.join(counts, ["record_id", "node_id"], "left").withColumn("_children_count", F.coalesce("_children_count", F.lit(0)).cast("bigint"))


def _text(e) -> set:
    from ..functions.syntax import children, free_names

    ops: set = set()

    def walk(x):
        if x[0] == "op":
            ops.add(x[1])
        for c in children(x):
            walk(c)

    walk(e)
    return ops | free_names(e)


def with_graph(nodes: DataFrame, arcs: DataFrame, all_nodes: DataFrame) -> DataFrame:
    """``nodes`` with their children (kind, anchor, id, fields) as one array column ordered by place, for graph operations."""
    kids = all_nodes.select("record_id", F.col("node_id").alias("child"), F.col("anchor").alias("_a"), *[F.col("fields").alias("_f")] if "fields" in all_nodes.columns else [])
    fields = [F.col("_f")] if "fields" in all_nodes.columns else []
    one = F.struct("pos", "kind", F.col("child").alias("_id"), F.col("_a").alias("_anchor"), *fields)
    grouped = arcs.join(kids, ["record_id", "child"]).groupBy("record_id", F.col("parent").alias("node_id")).agg(F.sort_array(F.collect_list(one)).alias("_kids"))
    return nodes.join(grouped, ["record_id", "node_id"], "left")


def graph_operations(nodes: DataFrame):
    """edge, children, has_edge, edge_count and anchor of the node itself ("self")."""
    item = nodes.schema["_kids"].dataType.elementType
    fields = item["_f"].dataType if "_f" in item.names else None
    names = list(fields.names) if fields is not None else []
    t = ("record", (("_id", "int"), ("_anchor", "string"), *((n, type_of(fields[n].dataType)) for n in names)))

    def record(k):
        return F.struct(k["_id"].alias("_id"), k["_anchor"].alias("_anchor"), *[k["_f"][n].alias(n) for n in names])

    kids = F.coalesce(F.col("_kids"), F.array())

    def run(name, args, env, compiler: Compiler) -> Typed:
        if name == "anchor":
            return Typed(F.col("anchor"), "string")
        if name == "edge_count":
            return Typed(F.size(kids).cast("bigint"), "int")
        if name == "children":
            return Typed(F.transform(kids, record), ("list", t))
        kind = compiler.value(args[1], env).value
        of_kind = F.filter(kids, lambda k: k["kind"] == kind)
        if name == "has_edge":
            return Typed(F.size(of_kind) > 0, "bool")
        first = F.get(of_kind, F.lit(0))
        return Typed(F.when(first.isNotNull(), record(first)), t)

    return run


def execute(tree: Tree, q: InstanceQuery) -> DataFrame:
    """record_id, node_id, anchor, value and the fields of the matches (a field the query does not project is gone)."""
    found = tree.nodes.where(F.col("anchor") == q.anchor).select("record_id", "node_id")
    for kind in q.path:
        steps = tree.arcs.where(F.col("kind") == kind).select("record_id", F.col("parent").alias("node_id"), "child")
        found = found.join(steps, ["record_id", "node_id"]).select("record_id", F.col("child").alias("node_id"))
    nodes = found.join(tree.nodes, ["record_id", "node_id"]) if q.path else tree.nodes.where(F.col("anchor") == q.anchor)
    if q.predicate is not None:
        e = parse(q.predicate) if isinstance(q.predicate, str) else q.predicate
        names = _text(e)
        graph = None
        if "_children_count" in names:
            nodes = with_children_count(nodes, tree.arcs)
        if names & {"edge", "children", "has_edge", "edge_count"}:
            nodes = with_graph(nodes, tree.arcs, tree.nodes)
            graph = graph_operations(nodes)
        nodes = nodes.where(predicate(e, node_environment(nodes) | {"self": Typed(F.lit("self"), "string")}, graph=graph))
    if q.limit is not None:
        nodes = nodes.orderBy("record_id", "node_id").limit(q.limit)
    fields = of_columns(nodes.schema["fields"].dataType, "fields") if "fields" in nodes.columns else {}
    if q.project is not None:
        fields = {n: fields[n] for n in q.project if n in fields}
    value = [F.col("value")] if "value" in nodes.columns else []
    out = nodes.select("record_id", "node_id", "anchor", *value, *[t.value.alias(n) for n, t in fields.items()])
    if q.group_by is not None and q.group_by in fields:
        out = out.orderBy(F.col(q.group_by).cast("string").asc_nulls_first(), "record_id", "node_id")
    return out


def group_agg(matches: DataFrame, keys: list[str], **aggs) -> DataFrame:
    """A real grouping of matches, which the query's own ``group_by`` is not."""
    return matches.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])


__all__ = ["InstanceQuery", "compile_expr", "execute", "group_agg", "node_environment"]
