"""Fibers: the nodes over each target anchor, alone, grouped and joined."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import parse, predicate
from ..plans.migration import Compiled
from .query import node_environment
from .tree import KEY, Restricted, Tree, _pairs


def over(nodes: DataFrame, m: Compiled) -> DataFrame:
    """Nodes whose anchor the mapping names, with ``fiber``, its target."""
    table = _pairs(nodes.sparkSession, sorted(m.vertex_map.items()) or [("", "")], "anchor string, fiber string")
    return nodes.join(table, "anchor")


def decomposition(nodes: DataFrame, m: Compiled) -> DataFrame:
    """record_id, fiber, and its node ids in order."""
    return over(nodes, m).groupBy("record_id", "fiber").agg(F.sort_array(F.collect_list("node_id")).alias("node_ids"))


def sizes(nodes: DataFrame, m: Compiled) -> DataFrame:
    """fiber and how many nodes lie over it, for fibers too large to list."""
    return over(nodes, m).groupBy("fiber").agg(F.count("*").alias("n"))


def at_anchor(nodes: DataFrame, m: Compiled, target: str) -> DataFrame:
    return over(nodes, m).where(F.col("fiber") == target).drop("fiber")


def at_node(restricted: Restricted, target_node: int) -> DataFrame:
    """record_id, node_id of what lies over a node: itself, and what was contracted into it."""
    own = restricted.tree.nodes.where(F.col("node_id") == target_node).select(*KEY)
    into = restricted.dropped_nodes.where(F.col("contracted_into") == target_node).select(*KEY)
    return own.unionByName(into)


def with_predicate(nodes: DataFrame, m: Compiled, target: str, condition) -> DataFrame:
    """A fiber's nodes whose predicate is true; one without a value drops."""
    e = parse(condition) if isinstance(condition, str) else condition
    found = at_anchor(nodes, m, target)
    return found.where(predicate(e, node_environment(found)))


def group_by(tree: Tree, m: Compiled) -> tuple[DataFrame, DataFrame]:
    """Nodes with their fiber, and the arcs whose ends share one."""
    nodes = over(tree.nodes, m)
    at = nodes.select(*KEY, "fiber")
    arcs = tree.arcs.join(at.withColumnRenamed("node_id", "parent"), ["record_id", "parent"]).join(at.withColumnRenamed("node_id", "child"), ["record_id", "child", "fiber"])
    return nodes, arcs


def join(left: DataFrame, left_map: Compiled, right: DataFrame, right_map: Compiled, within_record: bool = True) -> DataFrame:
    """Pairs of nodes over the same target anchor, in the same record unless said otherwise."""
    a = over(left, left_map).select("record_id", "fiber", F.col("node_id").alias("left_id"))
    b = over(right, right_map).select("record_id", "fiber", F.col("node_id").alias("right_id"))
    if within_record:
        return a.join(b, ["record_id", "fiber"])
    return a.withColumnRenamed("record_id", "left_record").join(b.withColumnRenamed("record_id", "right_record"), "fiber")
