"""Lenses: restrict a tree and keep what was lost, so that an edited view can be put back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.migration import Compiled
from ..schema import Schema
from ..storage import written
from .tree import KEY, Restricted, Tree, _pairs, restrict


class LensError(ValueError):
    """A complement that belongs to another schema."""


@dataclass(frozen=True)
class Complement:
    """Dropped nodes and arcs, and the originals of the kept nodes and arcs, as side tables keyed by record and node."""

    dropped_nodes: DataFrame
    originals: DataFrame  # kept nodes as they were
    arcs: DataFrame  # all source arcs
    fans: DataFrame | None
    fingerprint: str

    def write(self, path: str) -> None:
        for name in ("dropped_nodes", "originals", "arcs"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")


@dataclass(frozen=True)
class TreeLens:
    source: Schema
    target: Schema
    compiled: Compiled
    valid: bool = False  # sources fit their schema

    def get(self, tree: Tree) -> tuple[Tree, Complement, DataFrame]:
        """The view, the complement, and the records that failed."""
        r: Restricted = restrict(tree, self.source, self.compiled, self.valid)
        return r.tree, Complement(r.dropped_nodes.drop("contracted_into"), r.kept, tree.arcs, tree.fans, self.source.fingerprint()), r.errors

    def put(self, view: Tree, c: Complement, check: bool = True) -> Tree:
        """The source that the view and the complement make: anchors go back, the snapshot restores fields of kept nodes
        that transforms touched (others take the view's), dropped nodes and old arcs return.

        A node that is new in the view has no place in the source's tree and gets no arc; one gone from the view goes.
        """
        if check and c.fingerprint and c.fingerprint != self.source.fingerprint():
            raise LensError("the complement belongs to another source schema")
        back = {}
        for a, b in sorted(self.compiled.vertex_map.items()):
            back.setdefault(b, a)
        names = _pairs(view.nodes.sparkSession, sorted(back.items()) or [("", "")], "anchor string, _a string")
        snap = c.originals.select(*KEY, F.col("anchor").alias("_old"), *[F.col(x).alias(f"_{x}") for x in c.originals.columns if x in ("value", "fields")])
        nodes = view.nodes.join(snap, KEY, "left").join(names, "anchor", "left")
        anchor = F.coalesce("_old", "_a", "anchor")
        touched = F.col("anchor").isin(sorted(self.compiled.transforms)) if self.compiled.transforms else F.lit(False)
        cols = [*KEY, anchor.alias("anchor")]
        if "value" in view.nodes.columns:
            cols.append(F.when(touched & F.col("_old").isNotNull(), F.col("_value")).otherwise(F.col("value")).alias("value"))
        if "fields" in view.nodes.columns:
            old = c.originals.schema["fields"].dataType
            shared = [f.name for f in old.fields if f.name in view.nodes.schema["fields"].dataType.names]
            own = F.struct(*[(F.col(f"fields.`{f.name}`") if f.name in shared else F.col(f"_fields.`{f.name}`")).cast(f.dataType).alias(f.name) for f in old.fields])
            own = F.when(F.col("fields").isNotNull(), own)
            cols.append(F.when(touched & F.col("_old").isNotNull(), F.col("_fields")).otherwise(own).alias("fields"))
        whole = nodes.select(*cols).unionByName(c.dropped_nodes.select([x for x in c.dropped_nodes.columns if x in {"record_id", "node_id", "anchor", "value", "fields"}]), allowMissingColumns=True)
        ids = whole.select(*KEY)
        arcs = c.arcs.join(ids.withColumnRenamed("node_id", "child"), ["record_id", "child"], "left_semi").join(ids.withColumnRenamed("node_id", "parent"), ["record_id", "parent"], "left_semi")
        return Tree(whole, arcs.select(c.arcs.columns), c.fans)


def settled(t: Tree) -> Tree:
    """A tree on written tables: what follows is planned from there, and reads the columns that it needs."""
    return Tree(written(t.nodes, "nodes"), written(t.arcs, "arcs"), t.fans)


def differences(a: Tree, b: Tree) -> DataFrame:
    """Rows of either tree's nodes and arcs that the other lacks: none if they are equal. For law checks."""
    cols = [c for c in a.nodes.columns if c in b.nodes.columns]

    def lacking(x: DataFrame, y: DataFrame) -> DataFrame:
        """Both ways in one grouping: a row for each time that one side has it more often."""
        both = x.withColumn("_n", F.lit(1)).unionByName(y.withColumn("_n", F.lit(-1)))
        more = both.groupBy(*x.columns).agg(F.sum("_n").alias("_n")).where("_n <> 0")
        return more.select("record_id", F.explode(F.array_repeat(F.lit(0), F.abs("_n").cast("int"))).alias("_"))

    arcs = ["record_id", "parent", "child", "kind", "name"]
    n, x = lacking(a.nodes.select(cols), b.nodes.select(cols)), lacking(a.arcs.select(arcs), b.arcs.select(arcs))
    return n.select("record_id", F.lit("node").alias("what")).unionByName(x.select("record_id", F.lit("arc").alias("what")))


def get_put(lens: TreeLens, tree: Tree) -> DataFrame:
    """What GetPut violates: putting an unchanged view back must change nothing."""
    view, c, errors = lens.get(tree)
    errors, view = written(errors, "errors"), settled(view)
    fine = Tree(tree.nodes.join(errors, "record_id", "left_anti"), tree.arcs.join(errors, "record_id", "left_anti"))
    back = lens.put(view, c)
    bad = errors.select("record_id").distinct()
    return differences(fine, Tree(back.nodes.join(bad, "record_id", "left_anti"), back.arcs.join(bad, "record_id", "left_anti")))


def put_get(lens: TreeLens, view: Tree, c: Complement) -> DataFrame:
    """What PutGet violates: getting from what was put must give the view."""
    return differences(view, lens.get(settled(lens.put(view, c)))[0])


def compose(f: TreeLens, g: TreeLens) -> TreeLens:
    """First ``f``, then ``g``, in the last schema's names."""
    if set(f.target.vertices) != set(g.source.vertices):
        raise LensError("the middle schemas differ")
    a, b = f.compiled, g.compiled
    way = {}
    for v in f.source.vertices:
        mid = a.target(v)
        if a.survives(v) and b.survives(mid):
            way[v] = b.target(mid)
    transforms = dict(b.transforms)
    for v, t in a.transforms.items():
        if b.survives(v):
            to = b.target(v)
            transforms[to] = [*t, *b.transforms.get(to, [])]
    back: dict = {}
    for v in way:
        back.setdefault(a.target(v), []).append(v)
    survival = dict(a.survival)
    for mid, e in b.survival.items():
        for v in back.get(mid, []):
            if v not in survival:
                survival[v] = e
    edge_map = {e: b.edge_map[x] for e, x in a.edge_map.items() if x in b.edge_map}
    return TreeLens(f.source, g.target, Compiled(frozenset(way.values()), b.edges, way, edge_map, dict(b.resolver), {}, {}, transforms, survival), f.valid)


@dataclass(frozen=True)
class SymmetricLens:
    """Two lenses from one middle: a change on either side is put into the middle and got on the other."""

    left: TreeLens
    right: TreeLens

    def to_right(self, view: Tree, c: Complement) -> Tree:
        return self.right.get(self.left.put(view, c))[0]

    def to_left(self, view: Tree, c: Complement) -> Tree:
        return self.left.get(self.right.put(view, c))[0]


def merge_complements(first: Complement, second: Complement) -> Complement:
    """Both; where both know a node, the first wins."""

    def either(a: DataFrame, b: DataFrame) -> DataFrame:
        both = a.withColumn("_p", F.lit(0)).unionByName(b.withColumn("_p", F.lit(1)), allowMissingColumns=True)
        w = Window.partitionBy(*KEY).orderBy("_p")
        return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_p", "_n")

    return Complement(either(first.dropped_nodes, second.dropped_nodes), either(first.originals, second.originals), first.arcs.unionByName(second.arcs).distinct(), first.fans, first.fingerprint)
