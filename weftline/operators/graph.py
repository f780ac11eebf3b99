"""Graph instances: vertices (id, anchor, ...) and edges (src, dst, kind, name) along a mapping."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.migration import Compiled
from .tree import _pairs


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame
    edges: DataFrame


def _carry(g: Graph, kept: DataFrame, m: Compiled) -> Graph:
    """Edges with both ends, under their new kinds."""
    ids = kept.select("id", "anchor")
    edges = g.edges.join(ids.select(F.col("id").alias("src"), F.col("anchor").alias("_a")), "src").join(ids.select(F.col("id").alias("dst"), F.col("anchor").alias("_b")), "dst")
    table = _pairs(g.edges.sparkSession, [(m.target(e.src), m.target(e.tgt), e.kind, e.name, t.kind, t.name) for e, t in m.edge_map.items()] or [("", "", "", "", "", "")], "_a string, _b string, kind string, name string, _k string, _n string")
    j = edges.join(table, [edges[c].eqNullSafe(table[c]) for c in ("_a", "_b", "kind", "name")], "left")
    return Graph(kept, j.select("src", "dst", F.coalesce("_k", edges["kind"]).alias("kind"), F.when(F.col("_k").isNotNull(), F.col("_n")).otherwise(edges["name"]).alias("name")))


def restrict(g: Graph, m: Compiled) -> Graph:
    """Only vertices that the map names; identity has to be explicit."""
    table = _pairs(g.vertices.sparkSession, sorted(m.vertex_map.items()) or [("", "")], "anchor string, _to string")
    return _carry(g, g.vertices.join(table, "anchor").withColumn("anchor", F.col("_to")).drop("_to"), m)


def extend(g: Graph, m: Compiled) -> Graph:
    """Vertices mapped or surviving."""
    pairs = {v: v for v in m.survivors} | dict(m.vertex_map)
    table = _pairs(g.vertices.sparkSession, sorted(pairs.items()) or [("", "")], "anchor string, _to string")
    return _carry(g, g.vertices.join(table, "anchor").withColumn("anchor", F.col("_to")).drop("_to"), m)


def reachable(g: Graph, start: DataFrame, rounds: int = 100) -> DataFrame:
    """Ids reachable from ``start`` (id), by frontier: each round joins the new ones only."""
    seen = start.select("id").distinct().checkpoint()
    front = seen
    for _ in range(rounds):
        front = g.edges.join(front.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti").checkpoint()
        if not front.limit(1).count():
            return seen
        seen = seen.unionByName(front).checkpoint()
    raise RecursionError(f"not settled after {rounds} rounds")


def reachable_after(g: Graph, reached: DataFrame, roots: DataFrame, inserted: DataFrame | None = None, deleted: DataFrame | None = None) -> DataFrame:
    """What ``roots`` reach after edges (src, dst) came or went, from what they reached before (``reached``: id).

    ``g`` is the graph with both changes made. Only what an inserted edge leads to, or what a deleted one led to, is walked again.
    """
    now = reached.select("id").distinct().checkpoint()
    if deleted is not None:
        # Whatever lies below a deleted edge may be lost; what is not below any stays.
        below = deleted.join(now.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id")).distinct()
        affected = reachable(g, below).join(now, "id", "left_semi").checkpoint()
        safe = now.join(affected, "id", "left_anti").unionByName(roots.select("id")).distinct().checkpoint()
        again = g.edges.join(safe.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id")).distinct().join(affected, "id", "left_semi")
        now = safe.unionByName(reachable(g, again)).distinct().checkpoint()
    if inserted is not None:
        new = inserted.join(now.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")).distinct().join(now, "id", "left_anti")
        # An inserted edge may begin at what another one has only just reached: the walk goes over all edges.
        now = now.unionByName(reachable(g, new)).distinct().checkpoint()
    return now
