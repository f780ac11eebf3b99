"""Edits of tables and trees, applied in bulk.

An edit log is a DataFrame with a column ``seq`` that orders it. Table edits are resolved per
key in one window over the log; the table itself is touched by one join.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


@dataclass(frozen=True)
class TableResult:
    rows: DataFrame
    errors: DataFrame  # seq, op, key, reason


def apply_table_edits(table: DataFrame, key: str, log: DataFrame) -> TableResult:
    """``log``: seq, op (insert, update, delete), the key, and the table's other columns (null in an update: unchanged, unless
    an array column ``set_null`` names the column).

    For tables with one row per key (a null key is a key). A delete or update of a key without a row is an error and changes nothing, as is
    an insert of one that exists; so is an unknown op. Edits with one seq go by op.

    Keys without edits are left alone. Whether a row is there before an edit is the last insert or delete before it, and a column's value is the
    last one given since the row's last insert: running windows and one aggregation, so that a key with very many edits is sorted but never held as a list.
    """
    values = [c for c in table.columns if c != key]
    col = lambda c: F.col(f"`{c}`")
    nulls = F.col("set_null") if "set_null" in log.columns and "set_null" not in values else F.lit(None).cast("array<string>")
    kinds = {f.name: f.dataType for f in table.schema.fields}
    edits = log.select(col(key).cast(kinds[key]).alias("k"), F.lit(1).alias("late"), F.col("seq").cast("long").alias("seq"), F.col("op"), nulls.alias("to_null"), F.struct(*[col(c).cast(kinds[c]).alias(c) for c in values]).alias("row"))
    touched = edits.select("k").distinct()
    rows = table.select(col(key).alias("k"), F.lit(0).alias("late"), F.lit(None).cast("long").alias("seq"), F.lit("row").alias("op"), F.lit(None).cast("array<string>").alias("to_null"), F.struct(*[col(c) for c in values]).alias("row"))
    mine = rows.alias("r").join(touched.alias("t"), F.col("r.k").eqNullSafe(F.col("t.k")), "left_semi")
    w = Window.partitionBy("k").orderBy("late", "seq", "op")
    turn = F.when((F.col("late") == 0) | (F.col("op") == "insert"), True).when(F.col("op") == "delete", False)
    all_ = mine.unionByName(edits).withColumn("turn", turn)
    there = F.coalesce(F.last("turn", True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    seen = all_.withColumn("there", there)
    starts = (F.col("late") == 0) | ((F.col("op") == "insert") & ~F.col("there"))
    seen = seen.withColumn("starts", starts).withColumn("life", F.sum(F.col("starts").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.struct("life", "late", "seq", "op")
    given = {c: F.col("starts") | ((F.col("op") == "update") & F.col("there") & (F.col("row").getField(c).isNotNull() | F.coalesce(F.array_contains("to_null", c), F.lit(False)))) for c in values}
    # A life begins with a row, so the latest place that gives a column lies in the last life.
    last = [F.max_by(F.struct(F.when(F.col("starts") | ~F.coalesce(F.array_contains("to_null", c), F.lit(False)), F.col("row").getField(c)).alias("v")), F.when(given[c], place)).alias(f"v{i}") for i, c in enumerate(values)]
    done = seen.groupBy("k").agg(F.max_by("turn", F.when(F.col("turn").isNotNull(), F.struct("late", "seq", "op"))).alias("stays"), *last)
    folded = done.where("stays").select(F.col("k").alias(key), *[F.col(f"v{i}.v").alias(c) for i, c in enumerate(values)]).select(*[col(c) for c in table.columns])
    same = table.join(touched.withColumnRenamed("k", "_edited_key"), col(key).eqNullSafe(F.col("_edited_key")), "left_anti")
    why = F.when(F.col("op").isin("delete", "update") & ~F.col("there"), "RowNotFound").when((F.col("op") == "insert") & F.col("there"), "DuplicateKey").when(~F.col("op").isin("insert", "update", "delete") | F.col("op").isNull(), "ApplyFailed")
    errors = seen.where("late = 1").withColumn("reason", why).where("reason is not null").select("seq", "op", F.col("k").alias("key"), "reason")
    return TableResult(same.unionByName(folded), errors)


def insert_rows(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows, allowMissingColumns=True)


def delete_rows(table: DataFrame, key: str, values: DataFrame) -> DataFrame:
    """Without all rows that have one of the keys."""
    return table.join(values.select(key), key, "left_anti")


def update_cell(table: DataFrame, key: str, value, column: str, new, order) -> DataFrame:
    """The first row of the key, by ``order`` (then by all columns), gets a new cell; of equal rows one. Only the key's rows are sorted or grouped."""
    hit = F.col(f"`{key}`").eqNullSafe(F.lit(value))
    mine = table.where(hit)
    first = mine.orderBy(order, *[F.col(f"`{c}`") for c in table.columns]).limit(1)
    changed = first.withColumn(column, F.lit(new).cast(table.schema[column].dataType)).select(*[F.col(f"`{c}`") for c in table.columns])
    return table.where(~hit).unionByName(mine.exceptAll(first)).unionByName(changed)


EDIT_SCHEMA = "record_id long, seq long, op string, node long, parent long, kind string, name string, anchor string, field string, value string, joined array<long>"
TREE_SCHEMA = "record_id long, node_id long, anchor string, value string, fields map<string,string>, parent long, pos long, kind string, name string, reason string, seq long"


class TreeState:
    """One record's tree, edited in order."""

    def __init__(self, nodes: list[dict], arcs: list[dict], fans: list[dict] = ()):
        self.nodes = {n["node_id"]: dict(n, fields=dict(n["fields"] or {})) for n in nodes}
        self.arcs = sorted(([a["parent"], a["child"], a["pos"], a["kind"], a["name"]] for a in arcs), key=lambda a: (a[0], a[2], a[1]))
        self.fans = [dict(f) for f in fans]

    def children(self, n) -> list:
        return [a for a in self.arcs if a[0] == n]

    def parent(self, n):
        return next((a[0] for a in self.arcs if a[1] == n), None)

    def apply(self, e: dict) -> str | None:
        """The reason why an edit fails, or None."""
        op, n = e["op"], e["node"]
        if op == "identity":
            return None
        if op == "insert_node":
            if e["parent"] not in self.nodes:
                return "ParentNotFound"
            if n in self.nodes:
                return "DuplicateNodeId"
            self.nodes[n] = {"node_id": n, "anchor": e["anchor"], "value": e["value"], "fields": {}}
            self.arcs.append([e["parent"], n, 1 + max((a[2] for a in self.children(e["parent"])), default=-1), e["kind"], e["name"]])
            return None
        if op == "delete_fan":
            left = [f for f in self.fans if f["hyper_edge"] != e["name"]]
            if len(left) == len(self.fans):
                return "FanNotFound"
            self.fans = left
            return None
        if n not in self.nodes:
            return "NodeNotFound"
        if op == "delete_node":
            if self.children(n):
                return "ApplyFailed"
            self._remove(n)
        elif op == "contract_node":
            up = next((a for a in self.arcs if a[1] == n), None)
            if up is None:
                return "ApplyFailed"
            for a in self.children(n):
                a[0] = up[0]
            self._remove(n)
        elif op == "relabel_node":
            self.nodes[n]["anchor"] = e["anchor"]
        elif op == "set_field":
            self.nodes[n]["fields"][e["field"]] = e["value"]
        elif op == "remove_field":
            self.nodes[n]["fields"].pop(e["field"], None)
        elif op == "move_subtree":
            if e["parent"] not in self.nodes:
                return "ParentNotFound"
            at, seen = e["parent"], set()
            while at is not None and at not in seen:
                if at == n:
                    return "CycleDetected"
                seen.add(at)
                at = self.parent(at)
            self.arcs = [a for a in self.arcs if a[1] != n]
            self.arcs.append([e["parent"], n, 1 + max((a[2] for a in self.children(e["parent"])), default=-1), e["kind"], e["name"]])
        elif op == "insert_fan":
            self.fans.append({"hyper_edge": e["name"], "parent": n, "children": dict(zip((e["field"] or "").split(","), e["joined"] or [], strict=False))})
        elif op == "join_features":
            self.nodes[n]["anchor"], self.nodes[n]["value"] = e["anchor"] or self.nodes[n]["anchor"], e["value"]
            for j in e["joined"] or []:
                if j in self.nodes and j != n:
                    self.arcs = [a for a in self.arcs if j not in a[:2]]
                    self._remove(j)
        else:
            return "ApplyFailed"
        return None

    def _remove(self, n) -> None:
        del self.nodes[n]
        self.arcs = [a for a in self.arcs if a[1] != n and a[0] != n]
        self.fans = [f for f in self.fans if f["parent"] != n and n not in f["children"].values()]


def apply_tree_edits(nodes: DataFrame, arcs: DataFrame, log: DataFrame, fans: DataFrame | None = None) -> tuple[DataFrame, ...]:
    """Nodes, arcs and errors (record_id, seq, reason) after a log (``EDIT_SCHEMA``) of edits, in order within each record; with ``fans``
    (record_id, hyper_edge, parent, children) also the fans, which go where their parent or a child goes.

    Order matters within a record and not between records: one grouped pass, a record's tree at a time.
    ``fields`` is a map of text. Records without edits do not go through Python.
    """
    log = log.select(*[F.col(c).alias(c) for c in log.columns])  # columns of its own, also where it comes from the nodes
    touched = log.select("record_id").distinct()
    place = arcs.select("record_id", F.col("child").alias("node_id"), "parent", "pos", "kind", "name")
    have = nodes.join(touched, "record_id", "left_semi").join(place, ["record_id", "node_id"], "left")
    have = have.select("record_id", F.col("node_id").cast("long").alias("node_id"), "anchor", F.col("value").cast("string").alias("value"), F.col("fields").cast("map<string,string>").alias("fields"), F.col("parent").cast("long").alias("parent"), F.col("pos").cast("long").alias("pos"), "kind", "name")
    if fans is not None:  # a fan travels as a row without node_id, its children as fields
        nothing = F.lit(None)
        flat = fans.join(touched, "record_id", "left_semi").select("record_id", nothing.cast("long").alias("node_id"), nothing.cast("string").alias("anchor"), nothing.cast("string").alias("value"), F.col("children").cast("map<string,string>").alias("fields"), F.col("parent").cast("long").alias("parent"), nothing.cast("long").alias("pos"), nothing.cast("string").alias("kind"), F.col("hyper_edge").alias("name"))
        have = have.unionByName(flat)
    keys = ("node_id", "anchor", "value", "fields", "parent", "pos", "kind", "name")

    def run(key, mine: pa.Table, edits: pa.Table) -> pa.Table:
        rows = [r for r in mine.to_pylist() if r["node_id"] is not None]
        fans_in = [{"hyper_edge": r["name"], "parent": r["parent"], "children": {k: int(v) for k, v in r["fields"] or []}} for r in mine.to_pylist() if r["node_id"] is None]
        state = TreeState([{k: r[k] for k in keys[:4]} | {"fields": dict(r["fields"] or [])} for r in rows], [{"parent": r["parent"], "child": r["node_id"], "pos": r["pos"], "kind": r["kind"], "name": r["name"]} for r in rows if r["parent"] is not None], fans_in)
        bad = [(e["seq"], why) for e in sorted(edits.to_pylist(), key=lambda e: e["seq"]) if (why := state.apply(e))]
        up = {a[1]: a for a in state.arcs}
        rid = key[0].as_py()
        out = []
        for n in sorted(state.nodes):
            x, a = state.nodes[n], up.get(n)
            out.append({"record_id": rid, "node_id": n, "anchor": x["anchor"], "value": x["value"], "fields": list(x["fields"].items()), "parent": a and a[0], "pos": a and a[2], "kind": a and a[3], "name": a and a[4], "reason": None, "seq": None})
        out += [{"record_id": rid, "parent": f["parent"], "name": f["hyper_edge"], "fields": [(k, str(v)) for k, v in f["children"].items()]} for f in state.fans]
        out += [{"record_id": rid, "reason": why, "seq": s} for s, why in bad]
        schema = pa.schema([("record_id", pa.int64()), ("node_id", pa.int64()), ("anchor", pa.string()), ("value", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("parent", pa.int64()), ("pos", pa.int64()), ("kind", pa.string()), ("name", pa.string()), ("reason", pa.string()), ("seq", pa.int64())])
        return pa.Table.from_pylist(out, schema)

    done = have.groupBy("record_id").cogroup(log.groupBy("record_id")).applyInArrow(run, TREE_SCHEMA)
    errors = done.where("reason is not null").select("record_id", "seq", "reason")
    new = done.where("reason is null and node_id is not null")
    same_nodes = nodes.join(touched, "record_id", "left_anti").select("record_id", "node_id", "anchor", "value", "fields")
    same_arcs = arcs.join(touched, "record_id", "left_anti").select("record_id", "parent", "child", "pos", "kind", "name")
    changed = (
        same_nodes.unionByName(new.select("record_id", "node_id", "anchor", "value", "fields")),
        same_arcs.unionByName(new.where("parent is not null").select("record_id", "parent", F.col("node_id").alias("child"), "pos", "kind", "name")),
        errors,
    )
    if fans is None:
        return changed
    of_fans = done.where("reason is null and node_id is null").select("record_id", F.col("name").alias("hyper_edge"), "parent", F.col("fields").cast("map<string,bigint>").alias("children"))
    return (*changed, fans.join(touched, "record_id", "left_anti").select("record_id", "hyper_edge", F.col("parent").cast("long").alias("parent"), F.col("children").cast("map<string,bigint>").alias("children")).unionByName(of_fans))


def translate(log: DataFrame, anchors: DataFrame, m) -> DataFrame:
    """Edits of a source tree as edits of its restriction.

    What touches only dropped nodes is absorbed (identity); inserted and relabelled anchors are mapped.
    ``anchors``: record_id, node_id, anchor of the source's nodes.
    """
    from .tree import _pairs

    names = sorted({*m.vertex_map, *m.survivors})
    table = _pairs(log.sparkSession, [(v, m.target(v), m.survives(v)) for v in names], "anchor string, _to string, _stays boolean")
    of = anchors.select("record_id", F.col("node_id").alias("node"), F.col("anchor").alias("_own")).join(table.withColumnRenamed("anchor", "_own").withColumnRenamed("_to", "_own_to").withColumnRenamed("_stays", "_own_stays"), "_own", "left")
    j = log.join(of, ["record_id", "node"], "left").join(table, "anchor", "left")
    inserts = F.col("op") == "insert_node"
    names_anchor = F.col("anchor").isNotNull()
    lives = F.when(inserts, F.coalesce("_stays", F.lit(False))).otherwise(F.coalesce("_own_stays", F.lit(False)))
    out = j.withColumn("op", F.when(lives, F.col("op")).otherwise("identity")).withColumn("anchor", F.when(names_anchor, F.coalesce("_to", "anchor")).otherwise(F.col("anchor")))
    return out.select(log.columns)
