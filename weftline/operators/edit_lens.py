"""Edits carried through a lens, both ways, as plans over edit logs.

A log (``edits.EDIT_SCHEMA``) of edits of the source becomes one of the view (``get_edits``), and one of the view becomes one of the source
(``put_edits``), a row for a row. What an edit means depends on the node's anchor, on what the mapping does with it and on the field's
transforms: all of these are schema-sized tables, joined by broadcast; nodes are joined by (record_id, node_id). Nodes that the log itself inserts are known to its later edits.

An edit that the other side does not see becomes ``identity`` and is listed as absorbed (it changes the complement). An edit that cannot be
carried over becomes ``identity`` too and is listed as an error: RefinementViolation (the value breaks a constraint of the target), NoEdgeFound or
AmbiguousEdge (no single edge for a new or moved node), ComputedField (a view's field that the source computes), NoPlace (a
dropped node relabelled into the view). A policy per field may allow a computed field's edit to be dropped silently.

Odd input: an edit of a node that nobody knows passes as it is, and fails where it is applied; null values pass constraints; repeated edits are carried
each; an empty log gives an empty log.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import Typed, compile_expr, parse
from ..functions.columns import Unsupported
from .lens import TreeLens
from .tree import KEY, Restricted, Tree, _pairs, restrict


@dataclass(frozen=True)
class Carried:
    """The other side's log, what was absorbed, and what failed (the edit's columns and a reason). ``judged`` is the other side's log with a reason beside each edit
    ("absorbed", an error, or null): a plan that carries every edit once, for those who want both."""

    log: DataFrame
    absorbed: DataFrame
    errors: DataFrame
    judged: DataFrame


def renames(transforms) -> tuple[dict[str, str | None], set[str], set[str] | None, dict[str, list[tuple[str, str]]]]:
    """What a vertex's transforms do to field names: old to new (None: dropped), computed names, names kept if others go, and
    expressions applied to an old name, each with the name that it has by then."""
    to: dict[str, str | None] = {}
    now: dict[str, str] = {}  # present name -> old name
    computed, kept, applied = set(), None, {}
    for t in transforms:
        if t[0] == "rename":
            old = now.pop(t[1], t[1])
            now[t[2]] = old
            to[old] = t[2]
            if t[1] in computed:
                computed = computed - {t[1]} | {t[2]}
        elif t[0] == "drop":
            to[now.pop(t[1], t[1])] = None
            computed.discard(t[1])
        elif t[0] in ("compute", "add"):
            computed.add(t[1])
        elif t[0] == "keep":
            kept = {now.get(n, n) for n in t[1]} if kept is None else kept & {now.get(n, n) for n in t[1]}
        elif t[0] == "apply":
            applied.setdefault(now.get(t[1], t[1]), []).append((t[1], t[2]))
    return to, computed, kept, applied


@dataclass(frozen=True)
class EditLens:
    lens: TreeLens
    #: (anchor of the view, field) -> "reject" or "ignore" for edits of computed fields.
    policies: dict = field(default_factory=dict)

    def _anchors(self, spark) -> DataFrame:
        m = self.lens.compiled
        names = sorted({*self.lens.source.vertices, *m.vertex_map})
        return _pairs(spark, [(v, m.target(v), m.survives(v)) for v in names], "_v string, _to string, _stays boolean")

    def _edges(self, spark) -> DataFrame:
        m = self.lens.compiled
        rows = []
        for a, b in sorted({(e.src, e.tgt) for e in m.edges} | set(m.resolver)):
            e = m.edge_between(a, b)
            rows.append((a, b, None, None, e) if isinstance(e, str) else (a, b, e.kind, e.name, None))
        return _pairs(spark, rows or [("", "", "", "", "")], "_a string, _b string, _kind string, _name string, _why string")

    @staticmethod
    def _known(nodes: DataFrame, log: DataFrame) -> DataFrame:
        own = nodes.select("record_id", F.col("node_id").alias("_id"), F.col("anchor").alias("_own"))
        new = log.where("op = 'insert_node'").groupBy("record_id", F.col("node").alias("_id")).agg(F.min_by("anchor", "seq").alias("_own"))
        return own.unionByName(new.join(own.select("record_id", "_id"), ["record_id", "_id"], "left_anti"))

    def _fields(self, spark, back: bool) -> DataFrame:
        """(view anchor, field) -> field on the other side, or what stands against it."""
        rows = []
        for v, ts in sorted(self.lens.compiled.transforms.items()):
            to, computed, _, _ = renames(ts)
            if back:
                rows += [(v, new, old, None) for old, new in to.items() if new is not None and new not in computed]
                rows += [(v, n, None, "identity" if self.policies.get((v, n)) == "ignore" else "ComputedField") for n in sorted(computed)]
            else:
                rows += [(v, old, new, None if new is not None else "identity") for old, new in to.items()]
        return _pairs(spark, rows or [("", "", "", "")], "_anchor string, field string, _field string, _stop string")

    def _refined(self, anchor, name, value):
        """Does a value meet the constraints of the view's vertex that the field leads to?"""
        fine = F.lit(True)
        for e in sorted(self.lens.target.edges, key=lambda e: (e.src, e.label)):
            for sort, bound in sorted(self.lens.target.constraints.get(e.tgt, {}).items()):
                number, length = value.try_cast("double"), F.length(value)
                test = {"maxLength": lambda n=length, b=bound: n <= int(b), "minLength": lambda n=length, b=bound: n >= int(b), "maximum": lambda n=number, b=bound: n <= float(b), "minimum": lambda n=number, b=bound: n >= float(b), "pattern": lambda v=value, b=bound: v.rlike(b)}.get(sort)
                if test:
                    fine = fine & F.when((anchor == e.src) & (name == e.label), F.coalesce(test(), value.isNull())).otherwise(True)
        return fine

    def _values(self, anchor, name, value):
        """A text value as the forward expressions of its field change it; where they have no value it stays."""
        for v, ts in sorted(self.lens.compiled.transforms.items()):
            for old, steps in sorted(renames(ts)[3].items()):
                now = value
                for present, text in steps:
                    try:
                        now = F.coalesce(compile_expr(parse(text), {present: Typed(now, "string")}).checked.cast("string"), now)
                    except Unsupported:
                        continue
                value = F.when((anchor == v) & (name == old), now).otherwise(value)
        return value

    def _split(self, j: DataFrame, columns: list[str]) -> Carried:
        """``j`` has the new columns as _n_<column>, and ``_reason``: null, "absorbed" or an error."""
        stays = F.col("_reason").isNull()
        out = [F.when(stays, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) if f"_n_{c}" in j.columns else F.col(c) for c in columns]
        judged = j.select(*[F.when(stays, F.col("op")).otherwise("identity").alias("op") if c == "op" and "_n_op" not in j.columns else F.when(stays, F.col("_n_op")).otherwise("identity").alias("op") if c == "op" else x for c, x in zip(columns, out, strict=True)], F.col("_reason").alias("reason"))
        failed = j.where("_reason is not null and _reason <> 'absorbed'").select(*columns, F.col("_reason").alias("reason"))
        return Carried(judged.drop("reason"), j.where("_reason = 'absorbed'").select(*columns), failed, judged)

    def get_edits(self, source: Tree, log: DataFrame, restricted: Restricted | None = None) -> Carried:
        """The view's edits for the source's ``log``."""
        spark, columns = log.sparkSession, log.columns
        r = restricted or restrict(source, self.lens.source, self.lens.compiled, self.lens.valid)
        of, names = self._anchors(spark), self._known(source.nodes, log)
        # Parents in the view: the nearest survivor.
        up = r.dropped_nodes.select("record_id", F.col("node_id").alias("parent"), F.col("contracted_into").alias("_into"), F.lit(True).alias("_gone"))
        j = log.join(names.withColumnRenamed("_id", "node"), ["record_id", "node"], "left").join(up, ["record_id", "parent"], "left")
        j = j.withColumn("_n_parent", F.when(F.col("_gone"), F.col("_into")).otherwise(F.col("parent")))
        above = names.select("record_id", F.col("_id").alias("_n_parent"), F.col("_own").alias("_above"))
        j = j.join(above, ["record_id", "_n_parent"], "left")
        for c, prefix in (("_own", "_own"), ("anchor", "_new"), ("_above", "_above")):
            j = j.join(of.select(F.col("_v").alias(c), F.col("_to").alias(f"{prefix}_to"), F.col("_stays").alias(f"{prefix}_stays")), c, "left")
        child = F.when(F.col("op") == "insert_node", F.col("_new_to")).otherwise(F.col("_own_to"))
        e = self._edges(spark)
        j = j.withColumn("_child_to", child).join(e, (F.col("_above_to") == e["_a"]) & (F.col("_child_to") == e["_b"]), "left")
        f = self._fields(spark, back=False)
        j = j.join(f.withColumnRenamed("field", "_f"), (F.col("_own_to") == F.col("_anchor")) & (F.col("field") == F.col("_f")), "left")
        op = F.col("op")
        kept = {v: k for v, ts in self.lens.compiled.transforms.items() if (k := renames(ts)[2]) is not None}
        lost = F.lit(False)
        for v, k in sorted(kept.items()):
            lost = lost | ((F.col("_own_to") == v) & ~F.col("field").isin(sorted(k)))
        to_field, value = F.coalesce("_field", "field"), self._values(F.col("_own_to"), F.col("field"), F.col("value"))
        hyper = self.lens.compiled.hyper_edge_map
        fan = op.isin("insert_fan", "delete_fan")
        seen = F.when(op == "insert_node", F.col("_new_stays")).otherwise(F.col("_own_stays"))
        needs_edge = op.isin("insert_node", "move_subtree")
        reason = (
            F.when(op == "identity", None)
            .when(fan, F.when(~F.col("name").isin(sorted(hyper)), "absorbed"))
            .when((op == "relabel_node") & ~F.coalesce("_own_stays", F.lit(True)) & F.coalesce("_new_stays", F.lit(False)), "NoPlace")
            .when(~F.coalesce(seen, F.lit(True)), "absorbed")
            .when(op.isin("set_field", "remove_field") & (lost | (F.col("_stop") == "identity")), "absorbed")
            .when((op == "set_field") & ~self._refined(F.col("_own_to"), to_field, value), "RefinementViolation")
            .when(needs_edge & F.col("_above_to").isNotNull() & F.col("_kind").isNull(), F.coalesce("_why", F.lit("NoEdgeFound")))
        )
        hyper_to = F.create_map(*[F.lit(x) for p in sorted(hyper.items()) for x in p]) if hyper else None
        name = F.when(needs_edge & F.col("_kind").isNotNull(), F.col("_name")).otherwise(F.col("name"))
        j = j.withColumn("_reason", reason)
        # A node relabelled out of the view leaves it, and its children move up.
        leaves = (op == "relabel_node") & F.col("_own_stays") & ~F.coalesce("_new_stays", F.lit(True))
        j = j.withColumn("_n_op", F.when(leaves, "contract_node").otherwise(op)).withColumn("_n_anchor", F.when(leaves, F.lit(None)).otherwise(F.coalesce("_new_to", "anchor")))
        j = j.withColumn("_n_kind", F.when(needs_edge, F.coalesce("_kind", "kind")).otherwise(F.col("kind")))
        j = j.withColumn("_n_name", F.when(fan, F.coalesce(hyper_to[F.col("name")], F.col("name"))).otherwise(name) if hyper_to is not None else name)
        j = j.withColumn("_n_field", F.when(op.isin("set_field", "remove_field"), to_field).otherwise(F.col("field"))).withColumn("_n_value", F.when(op == "set_field", value).otherwise(F.col("value")))
        return self._split(j, columns)

    def put_edits(self, source: Tree, log: DataFrame) -> Carried:
        """The source's edits for the view's ``log``; ``source`` is the tree that the view was got from."""
        spark, columns, m = log.sparkSession, log.columns, self.lens.compiled
        back: dict[str, str] = {}
        for a, b in sorted(m.vertex_map.items()):
            back.setdefault(b, a)
        for v in m.survivors:
            back.setdefault(v, v)
        of = _pairs(spark, sorted(back.items()) or [("", "")], "_view string, _source string")
        names = self._known(source.nodes.select(*KEY, "anchor"), log.join(of, log.anchor == of["_view"], "left").withColumn("anchor", F.coalesce("_source", "anchor")).select(columns))
        j = log.join(names.withColumnRenamed("_id", "node"), ["record_id", "node"], "left")
        j = j.join(names.select("record_id", F.col("_id").alias("parent"), F.col("_own").alias("_above")), ["record_id", "parent"], "left")
        j = j.join(of, j.anchor == of["_view"], "left")
        src = self.lens.source
        rows = []
        for a, b in sorted({(e.src, e.tgt) for e in src.edges}):
            found = src.between(a, b)
            rows.append((a, b, found[0].kind, found[0].name, None) if len(found) == 1 else (a, b, None, None, "AmbiguousEdge"))
        edges = _pairs(spark, rows or [("", "", "", "", "")], "_a string, _b string, _kind string, _name string, _why string")
        op = F.col("op")
        child = F.when(op == "insert_node", F.coalesce("_source", "anchor")).otherwise(F.col("_own"))
        j = j.withColumn("_child", child).join(edges, (F.col("_above") == edges["_a"]) & (F.col("_child") == edges["_b"]), "left")
        # Where several edges join two vertices, the mapped one counts.
        mapped = _pairs(spark, [(e.src, e.tgt, t.kind, t.name, e.kind, e.name) for e, t in sorted(m.edge_map.items(), key=str)] or [("",) * 6], "_ma string, _mb string, _mk string, _mn string, _sk string, _sn string")
        j = j.join(mapped, (F.col("_above") == mapped["_ma"]) & (F.col("_child") == mapped["_mb"]) & F.col("kind").eqNullSafe(mapped["_mk"]) & F.col("name").eqNullSafe(mapped["_mn"]), "left")
        view_anchor = _pairs(spark, sorted({(a, m.target(a)) for a in src.vertices if m.survives(a)}) or [("", "")], "_own string, _own_to string")
        j = j.join(view_anchor, "_own", "left")
        f = self._fields(spark, back=True)
        j = j.join(f.withColumnRenamed("field", "_f"), (F.col("_own_to") == F.col("_anchor")) & (F.col("field") == F.col("_f")), "left")
        needs_edge, of_field = op.isin("insert_node", "move_subtree"), op.isin("set_field", "remove_field")
        hyper = {b: a for a, b in sorted(m.hyper_edge_map.items())}
        kind, name = F.coalesce("_sk", "_kind"), F.when(F.col("_sk").isNotNull(), F.col("_sn")).otherwise(F.col("_name"))
        reason = (
            F.when(of_field & (F.col("_stop") == "identity"), "absorbed")
            .when(of_field & F.col("_stop").isNotNull(), F.col("_stop"))
            .when(needs_edge & F.col("_above").isNotNull() & kind.isNull(), F.coalesce("_why", F.lit("NoEdgeFound")))
        )
        j = j.withColumn("_reason", reason).withColumn("_n_anchor", F.coalesce("_source", "anchor"))
        j = j.withColumn("_n_kind", F.when(needs_edge & kind.isNotNull(), kind).otherwise(F.col("kind")))
        fan_name = F.coalesce(F.create_map(*[F.lit(x) for p in sorted(hyper.items()) for x in p])[F.col("name")], F.col("name")) if hyper else F.col("name")
        j = j.withColumn("_n_name", F.when(needs_edge & kind.isNotNull(), name).when(op.isin("insert_fan", "delete_fan"), fan_name).otherwise(F.col("name")))
        j = j.withColumn("_n_field", F.when(of_field, F.coalesce("_field", "field")).otherwise(F.col("field")))
        return self._split(j, columns)
