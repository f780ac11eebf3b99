"""Mappings as data, and mappings that other mappings induce.

The hom schema of two schemas has a choice vertex for each source vertex, edges from it to every target vertex of the same kind, and a
vertex for each source edge. An instance of it is a mapping: ``curry`` writes a compiled mapping as such a tree, ``evaluate`` applies a tree to data.
Both sides are bounded by schemas; only ``evaluate`` touches data, by ``tree.restrict``.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import SparkSession

from ..operators.tree import Restricted, Tree, restrict
from ..schema import Edge, Schema, SchemaError
from ..theory import Morphism
from .migration import Compiled, Migration, compile_migration

ROOT = "hom_root"


def _back(e: Edge) -> str:
    return f"backward_{e.src}_{e.label}"


def hom_schema(src: Schema, tgt: Schema) -> Schema:
    """The schema of mappings from ``src`` to ``tgt``."""
    vertices, edges = {ROOT: "hom_root"}, set()
    for v, kind in sorted(src.vertices.items()):
        choice = f"choice_{v}"
        vertices[choice] = "hom_choice"
        edges.add(Edge(ROOT, choice, "has_choice", choice))
        for t, other in sorted(tgt.vertices.items()):
            if other == kind:
                vertices[t] = other
                edges.add(Edge(choice, t, "maps_to", t))
        for e in src.outgoing(v):
            vertices[_back(e)] = "hom_backward"
            edges.add(Edge(choice, _back(e), "backward_for", e.label))
    return Schema("hom", vertices, frozenset(edges))


def curry(m: Compiled, src: Schema, spark: SparkSession) -> Tree:
    """A compiled mapping as an instance of the hom schema (record 0)."""
    nodes, arcs = [(0, 0, ROOT, None)], []

    def add(parent: int, anchor: str, kind: str, name: str, value: str | None = None) -> int:
        nodes.append((0, len(nodes), anchor, value))
        arcs.append((0, parent, len(nodes) - 1, len(arcs), kind, name))
        return len(nodes) - 1

    for a, b in sorted(m.vertex_map.items()):
        choice = add(0, f"choice_{a}", "has_choice", f"choice_{a}")
        add(choice, b, "maps_to", b)
        for e in src.outgoing(a):
            to = m.edge_map.get(e)
            add(choice, _back(e), "backward_for", e.label, None if to is None else "\t".join([to.src, to.tgt, to.kind, to.name or ""]))
    return Tree(spark.createDataFrame(nodes, "record_id long, node_id long, anchor string, value string"), spark.createDataFrame(arcs, "record_id long, parent long, child long, pos long, kind string, name string"))


def uncurry(hom: Tree, src: Schema, tgt: Schema) -> Compiled:
    """The mapping that an instance of the hom schema stands for. A choice without ``maps_to`` drops its vertex."""
    nodes = {r.node_id: r for r in hom.nodes.collect()}  # as many as the two schemas' vertices and edges
    way, edge_map, of = {}, {}, {}
    for a in sorted(hom.arcs.collect(), key=lambda a: (a.parent, a.pos)):
        if a.child not in nodes or a.parent not in nodes:
            raise SchemaError(f"an arc leads to a node that is not there: {a.parent} -> {a.child}")
        anchor = nodes[a.parent].anchor
        if a.kind == "maps_to" and anchor.startswith("choice_"):
            way.setdefault(anchor.removeprefix("choice_"), nodes[a.child].anchor)
        elif a.kind == "backward_for" and nodes[a.child].value:
            of[nodes[a.child].anchor] = nodes[a.child].value.split("\t")
    for e in src.edges:
        if _back(e) in of:
            s, t, kind, name = of[_back(e)]
            edge_map[e] = Edge(s, t, kind, name or None)
    kept = frozenset(way.values())
    return Compiled(kept, frozenset(e for e in tgt.edges if e.src in kept and e.tgt in kept), way, edge_map)


def evaluate(hom: Tree, source: Tree, src: Schema, tgt: Schema) -> Restricted:
    """The mapping that ``hom`` stands for, applied to data."""
    return restrict(source, src, uncurry(hom, src, tgt))


def compose_maps(f: Migration, g: Migration) -> Migration:
    """First ``f``, then ``g``; what ``g`` does not mention stays as ``f`` left it."""
    return Migration({a: g.vertex_map.get(b, b) for a, b in f.vertex_map.items()}, {a: g.edge_map.get(b, b) for a, b in f.edge_map.items()}, {a: g.hyper_edge_map.get(b, b) for a, b in f.hyper_edge_map.items()})


# Cascades: a map of theories gives one of schemas, and that one of data.


def induced_schema(m: Morphism, s: Schema) -> Schema:
    """``s`` with vertex kinds renamed as sorts and edge kinds as operations."""
    edge = lambda e: replace(e, kind=m.ops.get(e.kind, e.kind))
    return replace(s, vertices={v: m.sorts.get(k, k) for v, k in s.vertices.items()}, edges=frozenset(map(edge, s.edges)), required={v: frozenset(map(edge, es)) for v, es in s.required.items()})


def induced_map(m: Morphism, s: Schema) -> Migration:
    """Vertices keep their names; edges change their kinds."""
    return Migration({v: v for v in s.vertices}, {e: replace(e, kind=m.ops.get(e.kind, e.kind)) for e in s.edges}, {h: h for h in s.hyper_edges})


def induced_data(m: Morphism, s: Schema) -> tuple[Schema, Compiled]:
    """The schema that a map of theories leads to, and the compiled mapping of its data."""
    to = induced_schema(m, s)
    return to, compile_migration(s, to, induced_map(m, s))


def coproduct(parts: dict[str, Schema]) -> tuple[Schema, dict[str, dict[str, str]]]:
    """All files' schemas side by side, their vertices prefixed with the path, and each file's own names to the new ones. One file keeps its names."""
    if not parts:
        raise SchemaError("no files")
    if len(parts) == 1:
        (path, s), = parts.items()
        return s, {path: {v: v for v in s.vertices}}
    vertices, edges, constraints, required, ways = {}, set(), {}, {}, {}
    for path, s in sorted(parts.items()):
        at = {v: f"{path}::{v}" for v in s.vertices}
        move = lambda e, at=at: replace(e, src=at[e.src], tgt=at[e.tgt])
        vertices |= {at[v]: k for v, k in s.vertices.items()}
        edges |= set(map(move, s.edges))
        constraints |= {at[v]: c for v, c in s.constraints.items()}
        required |= {at[v]: frozenset(map(move, es)) for v, es in s.required.items()}
        ways[path] = at
    return Schema("project", vertices, frozenset(edges), constraints=constraints, required=required), ways


def tagged(parts: dict[str, Tree], ways: dict[str, dict[str, str]]) -> Tree:
    """The data of a coproduct: every file's records under the new anchors, with their file."""
    from pyspark.sql import functions as F

    from ..operators.relational import union_all

    nodes, arcs = [], []
    for path, t in sorted(parts.items()):
        names = F.create_map(*[F.lit(x) for p in sorted(ways[path].items()) for x in p])
        nodes.append(t.nodes.withColumn("anchor", F.coalesce(names[F.col("anchor")], F.col("anchor"))).withColumn("file", F.lit(path)))
        arcs.append(t.arcs.withColumn("file", F.lit(path)))
    return Tree(union_all(nodes), union_all(arcs))
