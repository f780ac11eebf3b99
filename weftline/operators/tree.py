"""Tree instances as nodes and arcs, and their restriction, extension and repair along a mapping.

``nodes``: record_id, node_id, anchor, optionally value and a struct ``fields``.
``arcs``: record_id, parent, child, pos, kind, name. ``fans``: record_id, hyper_edge, parent, children (map label -> node).
Everything joins on (record_id, node_id), so one partitioning by record serves a whole chain.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import Typed, predicate
from ..functions.syntax import free_names
from ..plans.migration import Compiled
from ..schema import Schema
from ..storage import shared_dir, written
from .transforms import apply, environment, of_columns, tree_of

KEY = ["record_id", "node_id"]


@dataclass(frozen=True)
class Tree:
    nodes: DataFrame
    arcs: DataFrame
    fans: DataFrame | None = None

    def roots(self) -> DataFrame:
        return self.nodes.join(self.arcs.select("record_id", F.col("child").alias("node_id")), KEY, "left_anti")


@dataclass(frozen=True)
class Restricted:
    """A restricted tree, the records that failed (record_id, reason), and what was dropped."""

    tree: Tree
    errors: DataFrame
    dropped_nodes: DataFrame  # as in the source, with contracted_into
    dropped_arcs: DataFrame
    kept: DataFrame  # the surviving nodes as they were


def _pairs(spark, rows: list, schema: str) -> DataFrame:
    """Schema-sized metadata as a table to broadcast."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def survival(nodes: DataFrame, m: Compiled, anchors: list[str]) -> DataFrame:
    """``nodes`` with ``to`` (the mapped anchor) and ``alive``. A predicate without a value lets a node live."""
    env: dict = {}
    if "fields" in nodes.columns:
        kind = nodes.schema["fields"].dataType
        if isinstance(kind, T.MapType):  # open fields are texts by name
            used = set().union(*[free_names(tree_of(e)) for e in m.survival.values()]) if m.survival else set()
            env = environment({n: Typed(F.col("fields")[n].cast("string"), "string") for n in sorted(used)})
        else:
            env = environment(of_columns(kind, "fields"))
    if "value" in nodes.columns:
        from ..functions.columns import type_of

        env |= {"_value": Typed(F.col("value"), type_of(nodes.schema["value"].dataType))}
    env |= {"_anchor": Typed(F.col("anchor"), "string"), "_id": Typed(F.col("node_id").cast("bigint"), "int")}
    alive = F.lit(True)
    for v, e in sorted(m.survival.items()):
        alive = alive & F.when(F.col("anchor") == v, predicate(tree_of(e), env, otherwise=True)).otherwise(True)
    table = _pairs(nodes.sparkSession, [(v, m.target(v), m.survives(v)) for v in anchors], "anchor string, to string, _stays boolean")
    return nodes.join(table, "anchor", "left").withColumn("alive", F.coalesce("_stays", F.lit(False)) & alive).drop("_stays")


def nearest_alive(marked: DataFrame, arcs: DataFrame, rounds: int | None) -> DataFrame:
    """record_id, child, pos, anc of every arc's child: its nearest living ancestor (null above a dead root).

    ``rounds`` bounds how many dead ancestors can follow each other (a schema without cycles knows it); each
    round doubles the reach. Without a bound, rounds go on until nothing changes, on checkpointed tables.
    """
    state = marked.select("record_id", F.col("node_id").alias("parent"), "alive")
    up = arcs.select("record_id", "child", "pos", "parent").join(state, ["record_id", "parent"])

    def jump(cur: DataFrame) -> DataFrame:
        above = cur.select("record_id", F.col("child").alias("parent"), F.col("parent").alias("_p"), F.col("alive").alias("_alive"))
        j = cur.join(above, ["record_id", "parent"], "left")
        move = ~F.col("alive")
        return j.select("record_id", "child", "pos", F.when(move, F.col("_p")).otherwise(F.col("parent")).alias("parent"), F.when(move, F.coalesce("_alive", F.lit(True))).otherwise(True).alias("alive"))

    if rounds is not None:
        reach = 1
        while reach < rounds + 1:
            up, reach = jump(up), reach * 2
    else:
        while up.where(~F.col("alive")).limit(1).count():
            up = jump(up).checkpoint()
    return up.select("record_id", "child", "pos", F.when(F.col("alive"), F.col("parent")).alias("anc"))


def ancestors(marked: DataFrame, hung: DataFrame, run: int) -> DataFrame:
    """record_id, parent, anc, to_parent: for every living node itself, and for a dead one its nearest living ancestor, if there is one.

    Only dead nodes climb; ``hung`` has them with their parents (record_id, node_id, parent). Up to ``run`` of them follow each other.
    """
    at = [F.col("record_id"), F.col("node_id").alias("parent"), F.col("node_id").alias("anc"), F.col("to").alias("to_parent")]
    own = marked.where("alive").select(*at)
    if not run:
        return own
    state = marked.select("record_id", F.col("node_id").alias("anc"), F.col("to").alias("to_parent"), "alive")
    up = hung.where("parent is not null").select(*KEY, F.col("parent").alias("anc")).join(state, ["record_id", "anc"]).select("record_id", F.col("node_id").alias("parent"), "anc", "to_parent", "alive")
    reach = 1
    while reach < run:
        above = up.select("record_id", F.col("parent").alias("anc"), F.col("anc").alias("_anc"), F.col("to_parent").alias("_to"), F.col("alive").alias("_alive"))
        j, stays = up.join(above, ["record_id", "anc"], "left"), F.col("alive")
        up = j.select("record_id", "parent", F.when(stays, F.col("anc")).otherwise(F.col("_anc")).alias("anc"), F.when(stays, F.col("to_parent")).otherwise(F.col("_to")).alias("to_parent"), F.when(stays, True).otherwise(F.coalesce("_alive", F.lit(False))).alias("alive"))
        reach *= 2
    return own.unionByName(up.where("alive").drop("alive"))


def dead_run(src: Schema, m: Compiled) -> int | None:
    """How many vertices that may die can follow each other on a path; None if a cycle has one."""
    mortal = {v for v in src.vertices if not m.survives(v) or v in m.survival}
    run: dict = {}

    def below(v, open_=()):
        if v in open_:
            return None
        if v not in run:
            found = [below(e.tgt, (*open_, v)) for e in src.outgoing(v) if e.tgt in mortal]
            run[v] = None if None in found else 1 + max(found, default=0)
        return run[v]

    runs = [below(v) for v in sorted(mortal)]
    return None if None in runs else max(runs, default=0)


def labels_of(src: Schema) -> dict | None:
    """(kind, name) of an arc to its edge, where they tell edges apart; else None."""
    out = {(e.kind, e.name): e for e in src.edges}
    return out if len(out) == len(src.edges) else None


def climbed(arcs: DataFrame, dead: list[str], run: int) -> DataFrame:
    """``arcs`` (record_id, parent, child, pos, _src, _tgt) moved up to the nearest parent that lives; _src and parent are null above a dead root.

    ``run`` dead vertices may follow each other at most. Up to two are climbed in the plan, each by a join of the arcs that
    need it; longer runs by pointer doubling on checkpointed tables: log2(run) jobs, and a plan of one size.
    """
    needs = F.col("_src").isin(dead)

    def jump(near: DataFrame, steps: DataFrame) -> DataFrame:
        above = steps.where(F.col("_tgt").isin(dead)).select("record_id", F.col("child").alias("parent"), F.col("parent").alias("_p"), F.col("_src").alias("_s"))
        up = near.where(needs).join(above, ["record_id", "parent"], "left").select("record_id", F.col("_p").alias("parent"), "child", "pos", F.col("_s").alias("_src"), "_tgt")
        return near.where(~needs | F.col("_src").isNull()).unionByName(up)

    if run > 2:
        shared_dir(arcs.sparkSession)
        near = arcs.checkpoint()
        reach = 1
        while reach <= run:  # an arc whose parent lives stays, so jumps over jumps reach twice as far
            near, reach = jump(near, near).checkpoint(), reach * 2
        return near
    near = arcs
    for _ in range(run):
        near = jump(near, arcs)
    return near


def restrict_valid(tree: Tree, src: Schema, m: Compiled, run: int, labels: dict) -> Restricted:
    """``restrict`` of data that fit their schema, where nobody's survival depends on values.

    An arc's label then says both anchors, so nodes are only filtered and renamed, and arcs join with arcs alone: those
    whose parent dies climb, as often as dead vertices can follow each other. Errors that the schema rules out are not looked for.
    """
    spark = tree.nodes.sparkSession
    names = _pairs(spark, [(k, n, e.src, e.tgt) for (k, n), e in labels.items()] or [("", "", "", "")], "kind string, name string, _src string, _tgt string")
    arcs = tree.arcs.join(names, [tree.arcs[c].eqNullSafe(names[c]) for c in ("kind", "name")]).select("record_id", "parent", "child", "pos", "_src", "_tgt")
    dead = [v for v in sorted(src.vertices) if not m.survives(v)]
    near = climbed(arcs, dead, run)
    known, ambiguous, pairs = [], [], set()

    def walk(v, anc):
        here = v if m.survives(v) else anc
        for e in src.outgoing(v):
            if here is not None and m.survives(e.tgt) and (here, e.tgt) not in pairs:
                pairs.add((here, e.tgt))
                found = m.edge_between(m.target(here), m.target(e.tgt))
                (ambiguous if isinstance(found, str) else known).append((here, e.tgt, found))
            if not m.survives(e.tgt) or (v, e.tgt) not in seen:
                seen.add((v, e.tgt))
                walk(e.tgt, here)

    seen: set = set()
    for r in src.roots():
        walk(r, None)
    edges = _pairs(spark, [(a, b, e.kind, e.name) for a, b, e in known] or [("", "", "", "")], "_src string, _tgt string, kind string, name string")
    placed = near.where(~F.col("_tgt").isin(dead) & F.col("_src").isNotNull())
    out = placed.join(edges, ["_src", "_tgt"]).select("record_id", "parent", "child", "pos", "kind", "name")
    errors = tree.nodes.where(F.col("anchor").isin([v for v in src.roots() if v in dead])).select("record_id", F.lit("RootPruned").alias("reason"))
    if ambiguous:
        why = _pairs(spark, ambiguous, "_src string, _tgt string, reason string")
        errors = errors.unionByName(placed.join(why, ["_src", "_tgt"]).select("record_id", "reason"))
    errors = errors.distinct()
    to = _pairs(spark, [(v, m.target(v)) for v in sorted(src.vertices)], "anchor string, to string")
    kept = tree.nodes.where(~F.col("anchor").isin(dead))
    nodes = transformed(kept.join(to, "anchor").withColumn("alive", F.lit(True)), m)
    fans = restrict_fans(tree.fans, kept, m, errors.select("record_id").distinct()) if tree.fans is not None else None
    if ambiguous or any(v in dead for v in src.roots()):
        bad = errors.select("record_id").distinct()
        nodes, out = nodes.join(bad, "record_id", "left_anti"), out.join(bad, "record_id", "left_anti")
    gone = tree.nodes.where(F.col("anchor").isin(dead))
    dropped = gone.join(near.where(F.col("_tgt").isin(dead)).select("record_id", F.col("child").alias("node_id"), F.when(F.col("_src").isNotNull(), F.col("parent")).alias("contracted_into")), KEY, "left")
    lost = [(k, n) for (k, n), e in labels.items() if e.src in dead or e.tgt in dead]
    hit = _pairs(spark, lost or [("", "")], "kind string, name string")
    touched = tree.arcs.join(hit, [tree.arcs[c].eqNullSafe(hit[c]) for c in ("kind", "name")], "left_semi")
    return Restricted(Tree(nodes, out, fans), errors, dropped, touched, kept)


def restrict(tree: Tree, src: Schema, m: Compiled, valid: bool = False) -> Restricted:
    """Survivors, re-attached to their nearest surviving ancestor by the target's edge, with transforms applied.

    Records whose root dies, or where no single edge fits, are reported and left out. ``valid`` promises that the data
    fit their schema (``validate`` finds nothing), which saves joins with the nodes where the schema alone decides.
    """
    run, labels = dead_run(src, m), labels_of(src)
    if valid and run is not None and labels is not None and not m.survival and src.depth() is not None:
        return restrict_valid(tree, src, m, run, labels)
    spark = tree.nodes.sparkSession
    marked = survival(tree.nodes, m, sorted(src.vertices))
    near = nearest_alive(marked, tree.arcs, run)
    kept, dying = marked.where("alive"), marked.where(~F.col("alive"))
    hung = None
    if m.survival or any(not m.survives(v) for v in src.vertices) or not dying.isEmpty():
        hung = written(dying.select(*KEY).join(tree.arcs.select("record_id", F.col("child").alias("node_id"), "parent"), KEY, "left"), "dying")
    places = kept.select("record_id", F.col("node_id").alias("child"), F.col("to").alias("to_child"))
    if run is None:
        parents = kept.select("record_id", F.col("node_id").alias("anc"), F.col("to").alias("to_parent"))
        joined = near.join(places, ["record_id", "child"]).join(parents, ["record_id", "anc"])
    else:
        joined = tree.arcs.select("record_id", "parent", "child", "pos").join(places, ["record_id", "child"]).join(ancestors(marked, hung, run if hung is not None else 0), ["record_id", "parent"])
    known = []
    for a, b in sorted({(e.src, e.tgt) for e in m.edges} | set(m.resolver)):
        e = m.edge_between(a, b)
        if not isinstance(e, str):
            known.append((a, b, e.kind, e.name, None))
        elif e == "AmbiguousEdge":
            known.append((a, b, None, None, e))
    table = _pairs(spark, known, "to_parent string, to_child string, kind string, name string, _why string")
    # Written once: the errors and the arcs are both read off it, and then what failed, mostly little, has a size that plans know.
    edged = written(joined.join(table, ["to_parent", "to_child"], "left").select("record_id", F.col("anc").alias("parent"), "child", "pos", "kind", "name", "_why"), "edged")
    errors = edged.where("kind is null").select("record_id", F.coalesce("_why", F.lit("NoEdgeFound")).alias("reason"))
    if hung is not None:
        errors = errors.unionByName(hung.where("parent is null").select("record_id", F.lit("RootPruned").alias("reason")))
    errors = written(errors.distinct(), "errors")
    bad = errors.select("record_id").distinct()
    fine = (lambda df: df) if errors.isEmpty() else (lambda df: df.join(bad, "record_id", "left_anti"))
    nodes = fine(transformed(kept, m))
    arcs = fine(edged.where("kind is not null").drop("_why"))
    dead = marked.where(~F.col("alive"))
    into = near.select("record_id", F.col("child").alias("node_id"), F.col("anc").alias("contracted_into"))
    dropped = dead.join(into, KEY, "left").drop("to", "alive")
    gone = dead.select("record_id", F.col("node_id"))
    touched = tree.arcs.join(gone.withColumnRenamed("node_id", "child"), ["record_id", "child"], "left_semi").unionByName(
        tree.arcs.join(gone.withColumnRenamed("node_id", "parent"), ["record_id", "parent"], "left_semi")
    )
    fans = restrict_fans(tree.fans, kept, m, bad) if tree.fans is not None else None
    return Restricted(Tree(nodes, arcs, fans), errors, dropped, touched.distinct(), kept.drop("to", "alive"))


def transformed(kept: DataFrame, m: Compiled) -> DataFrame:
    """Living nodes under their new anchors, with each anchor's transforms in one struct expression."""
    out = kept.withColumn("anchor", F.col("to")).drop("to", "alive")
    if "fields" not in out.columns or not m.transforms:
        return out
    if isinstance(out.schema["fields"].dataType, T.MapType):
        raise ValueError("transforms need fields as a struct, not a map")
    old = of_columns(out.schema["fields"].dataType, "fields")
    per = {v: apply(old, t, {"__value__": Typed(F.col("value"), "string")} if "value" in out.columns else None) for v, t in sorted(m.transforms.items())}
    names = list(dict.fromkeys([*old, *(n for f in per.values() for n in f)]))
    cols = []
    for n in names:
        c = old[n].value if n in old else F.lit(None)
        kinds = {f[n].type for f in [old, *per.values()] if n in f} - {"null"}
        same = len(kinds) <= 1
        c = c if same else c.cast("string")
        for v, f in per.items():
            new = f[n].value if n in f else F.lit(None)
            c = F.when(F.col("anchor") == v, new if same else new.cast("string")).otherwise(c)
        cols.append(c.alias(n))
    return out.withColumn("fields", F.struct(*cols))


def restrict_fans(fans: DataFrame, kept: DataFrame, m: Compiled, bad: DataFrame) -> DataFrame:
    """Fans whose parent lives and whose hyper-edge is mapped, with the living children."""
    table = _pairs(fans.sparkSession, [(a, b) for a, b in sorted(m.hyper_edge_map.items())] or [("", "")], "hyper_edge string, _to string")
    flat = fans.join(table, "hyper_edge").select("record_id", F.col("_to").alias("hyper_edge"), "parent", F.explode("children").alias("label", "node_id"))
    alive = flat.join(kept.select(*KEY), KEY, "left_semi").join(kept.select("record_id", F.col("node_id").alias("parent")), ["record_id", "parent"], "left_semi")
    again = alive.groupBy("record_id", "hyper_edge", "parent").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "node_id")))).alias("children"))
    return again.join(bad, "record_id", "left_anti")


def extend(tree: Tree, src: Schema, m: Compiled) -> Tree:
    """Nodes mapped or surviving stay; others go without re-attaching their children."""
    marked = survival(tree.nodes, replace(m, survival={}), sorted(src.vertices))
    kept = marked.where("alive")
    at = kept.select(*KEY, "to")
    arcs = tree.arcs.join(at.select("record_id", F.col("node_id").alias("parent"), F.col("to").alias("_a")), ["record_id", "parent"]).join(at.select("record_id", F.col("node_id").alias("child"), F.col("to").alias("_b")), ["record_id", "child"])
    known = [(e.src, e.tgt, e.kind, e.name, t.kind, t.name) for e, t in m.edge_map.items()]
    old_to = [(m.target(a), m.target(b), k, n, k2, n2) for a, b, k, n, k2, n2 in known]
    single = [(a, b, None, None, e.kind, e.name) for a in m.survivors for b in m.survivors if not isinstance(e := m.edge_between(a, b), str)]
    spark = tree.nodes.sparkSession
    mapped = _pairs(spark, old_to or [("", "", "", "", "", "")], "_a string, _b string, kind string, name string, _k string, _n string")
    other = _pairs(spark, [(a, b, k, n) for a, b, _, _, k, n in single] or [("", "", "", "")], "_a string, _b string, _k2 string, _n2 string")
    j = arcs.join(mapped, [arcs[c].eqNullSafe(mapped[c]) for c in ("_a", "_b", "kind", "name")], "left").select(arcs["*"], "_k", "_n").join(other, ["_a", "_b"], "left")
    new = j.select("record_id", "parent", "child", "pos", F.coalesce("_k", "_k2", "kind").alias("kind"), F.when(F.col("_k").isNotNull(), F.col("_n")).when(F.col("_k2").isNotNull(), F.col("_n2")).otherwise(F.col("name")).alias("name"))
    return Tree(transformed(kept, m), new, tree.fans)


def product(tree: Tree, src: Schema, m: Compiled, max_size: int = 1_000_000) -> Tree:
    """As ``extend``, but refused where the sizes of a fiber's anchors multiply beyond the limit in one record: each record is an instance of its own."""
    from .relational import ProductSizeExceeded

    fibers = {v: sorted(a for a, b in m.vertex_map.items() if b == v) for v in sorted(m.survivors)}
    fibers = {v: anchors for v, anchors in fibers.items() if anchors}
    if not fibers:
        return extend(tree, src, m)
    used = sorted({a for anchors in fibers.values() for a in anchors})
    counts = tree.nodes.where(F.col("anchor").isin(used)).groupBy("record_id").agg(*[F.greatest(F.count_if(F.col("anchor") == a), F.lit(1)).alias(f"n{i}") for i, a in enumerate(used)])
    worst = []
    for v, anchors in fibers.items():
        of = [F.col(f"n{used.index(a)}") for a in anchors]
        size = F.lit(1.0)
        for n in of:
            size = size * n
        worst.append(F.max_by(F.array(*of), size).alias(v))
    row = counts.agg(*worst).first()  # for each vertex the counts of its largest record
    for i, v in enumerate(fibers):
        n = math.prod(row[i] or [1])
        if n > max_size:
            raise ProductSizeExceeded(f"{v}: {n}, limit {max_size}")
    return extend(tree, src, m)


def section(base: Tree, m: Compiled, enrich: list[tuple[int, str, str, str]] = ()) -> Tree:
    """The way back along an injective vertex map. ``enrich``: (base node, anchor, edge kind, value) adds a child to that node of every record."""
    back = {}
    for a, b in sorted(m.vertex_map.items()):
        if b in back:
            raise ValueError(f"{b} has several sources: {back[b]}, {a}")
        back[b] = a
    spark = base.nodes.sparkSession
    names = _pairs(spark, sorted(back.items()), "anchor string, _a string")
    nodes = base.nodes.join(names, "anchor", "left").withColumn("anchor", F.coalesce("_a", "anchor")).drop("_a")
    arcs = base.arcs
    if enrich:
        table = _pairs(spark, [(i, n, a, k, v) for i, (n, a, k, v) in enumerate(enrich)], "_i int, node_id long, _anchor string, _kind string, _value string")
        top = nodes.groupBy("record_id").agg(F.max("node_id").alias("_top"))
        new = nodes.select(*KEY).join(table, "node_id").join(top, "record_id").withColumn("_id", F.col("_top") + 1 + F.row_number().over(Window.partitionBy("record_id").orderBy("_i")) - 1)
        extra = new.select("record_id", F.col("_id").alias("node_id"), F.col("_anchor").alias("anchor"), *[F.col("_value").alias("value")] * ("value" in nodes.columns))
        nodes = nodes.unionByName(extra, allowMissingColumns=True)
        arcs = arcs.unionByName(new.select("record_id", F.col("node_id").alias("parent"), F.col("_id").alias("child"), F.lit(1 << 30).alias("pos"), F.col("_kind").alias("kind"), F.lit(None).cast("string").alias("name")))
    return Tree(nodes, arcs, base.fans)


def validate(tree: Tree, schema: Schema) -> DataFrame:
    """record_id, kind, detail of everything wrong with an instance; each check is a join against schema-sized tables."""
    spark = tree.nodes.sparkSession
    vertices = _pairs(spark, [(v,) for v in sorted(schema.vertices)], "anchor string")
    out = tree.nodes.join(vertices, "anchor", "left_anti").select("record_id", F.lit("InvalidAnchor").alias("kind"), F.concat_ws(":", F.col("node_id"), F.col("anchor")).alias("detail"))
    at = tree.nodes.select(*KEY, "anchor")
    tops, tips = (at.select("record_id", F.col("node_id").alias(n), F.col("anchor").alias(a)) for n, a in (("parent", "src"), ("child", "tgt")))
    ends = tree.arcs.select("record_id", "parent", "child", "kind").join(tops, ["record_id", "parent"], "left").join(tips, ["record_id", "child"], "left")
    edges = _pairs(spark, [(e.src, e.tgt, e.kind, True) for e in schema.edges] or [("", "", "", True)], "src string, tgt string, kind string, _known boolean").distinct()
    broken = F.col("src").isNull() | F.col("tgt").isNull()
    wrong = ends.join(F.broadcast(edges), ["src", "tgt", "kind"], "left").where(broken | F.col("_known").isNull())  # both checks in one pass over the arcs
    detail = F.when(broken, F.concat_ws("->", "parent", "child")).otherwise(F.concat_ws("->", "src", "tgt"))
    out = out.unionByName(wrong.select("record_id", F.when(broken, "ParentMapInconsistent").otherwise("InvalidEdge").alias("kind"), detail.alias("detail")))
    # A record's roots come after a row for the record itself, so one look ahead tells that there is none. Beside the first root, what has no parent cannot be reached.
    rows = tree.nodes.select("record_id").distinct().select("record_id", F.lit(None).cast("string").alias("_root"), F.lit(None).cast(at.schema["node_id"].dataType).alias("node_id"), F.lit(0).alias("_o"))
    rows = rows.unionByName(tree.roots().select("record_id", F.col("node_id").cast("string").alias("_root"), "node_id", F.lit(1).alias("_o")))
    w = Window.partitionBy("record_id").orderBy("_o", "node_id")
    rows = rows.withColumn("_n", F.row_number().over(w)).withColumn("_last", F.lead(F.lit(True)).over(w).isNull())
    missing = (F.col("_o") == 0) & F.col("_last")
    found = rows.where((missing & F.col("record_id").isNotNull()) | (F.col("_n") > 2))
    out = out.unionByName(found.select("record_id", F.when(missing, "MissingRoot").otherwise("UnreachableNode").alias("kind"), F.coalesce("_root", F.lit("")).alias("detail")))
    need = [(v, e.kind, e.tgt) for v, es in schema.required.items() for e in es]
    if need:
        table = _pairs(spark, need, "anchor string, kind string, tgt string")
        due = at.join(table, "anchor")
        asked = tree.arcs.where(F.col("kind").isin(sorted({k for _, k, _ in need}))).select("record_id", F.col("parent").alias("node_id"), "child", "kind")
        have = asked.join(tips.where(F.col("tgt").isin(sorted({t for _, _, t in need}))), ["record_id", "child"]).select(*KEY, "kind", "tgt")
        out = out.unionByName(due.join(have, [*KEY, "kind", "tgt"], "left_anti").select("record_id", F.lit("MissingRequiredEdge").alias("kind"), F.concat_ws(":", F.col("node_id"), F.col("tgt")).alias("detail")))
    if tree.fans is not None:
        flat = tree.fans.select("record_id", "hyper_edge", F.explode(F.map_values("children")).alias("node_id")).unionByName(tree.fans.select("record_id", "hyper_edge", F.col("parent").alias("node_id")))
        out = out.unionByName(flat.join(at.select(*KEY), KEY, "left_anti").select("record_id", F.lit("InvalidFan").alias("kind"), F.concat_ws(":", "hyper_edge", F.col("node_id")).alias("detail")))
    return out


def provenance(restricted: Restricted) -> DataFrame:
    """record_id, node_id, source_anchor, target_anchor of each surviving node."""
    before = restricted.kept.select(*KEY, F.col("anchor").alias("source_anchor"))
    return before.join(restricted.tree.nodes.select(*KEY, F.col("anchor").alias("target_anchor")), KEY)


def contractions(restricted: Restricted, arcs: DataFrame) -> DataFrame:
    """record_id, node_id, anchor (and value, fields), contracted_into, and the arc that a dropped node hung by: all that undoes its contraction."""
    own = arcs.select("record_id", F.col("child").alias("node_id"), F.col("parent").alias("original_parent"), "pos", "kind", "name")
    return restricted.dropped_nodes.join(own, KEY, "left")


def expand(view: Tree, record: DataFrame, arcs: DataFrame, which: DataFrame) -> Tree:
    """``view`` with the contracted nodes ``which`` (record_id, node_id) back under their nearest ancestor that is there, and their children under them again.

    ``record`` is what ``contractions`` gave and ``arcs`` are the source's.
    """
    back = written(record.join(which.select(*KEY).distinct(), KEY, "left_semi"), "back")  # read as nodes, as arcs and as ids
    ids = back.select("record_id", F.col("node_id").alias("_back"))
    nodes = view.nodes.unionByName(back.select(*[c for c in view.nodes.columns if c in back.columns]), allowMissingColumns=True)
    there = ids.select("record_id", F.col("_back").alias("original_parent"), F.lit(True).alias("_up"))
    own = back.join(there, ["record_id", "original_parent"], "left").select("record_id", F.when(F.col("_up"), F.col("original_parent")).otherwise(F.col("contracted_into")).alias("parent"), F.col("node_id").alias("child"), "pos", "kind", "name")
    # Arcs of the view whose child hung below an expanded node in the source.
    old = arcs.select("record_id", "child", F.col("parent").alias("_back"), F.col("pos").alias("_pos"), F.col("kind").alias("_kind"), F.col("name").alias("_name")).join(ids, ["record_id", "_back"], "left_semi")
    j = view.arcs.join(old, ["record_id", "child"], "left")
    again = [F.when(F.col("_back").isNotNull(), F.col(f"_{c}" if c != "parent" else "_back")).otherwise(F.col(c)).alias(c) for c in ("parent", "pos", "kind", "name")]
    return Tree(nodes, j.select("record_id", "child", *again).unionByName(own.where("parent is not null")), view.fans)
