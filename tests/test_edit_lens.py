"""Edits through lenses: laws, and what stands against an edit."""

from pyspark.sql import functions as F

from weftline.operators import edits, lens, tree
from weftline.operators.edit_lens import EditLens
from weftline.plans.migration import Compiled
from weftline.schema import OPEN, Edge, Schema, SchemaBuilder
from weftline.storage import written

SOURCE = SchemaBuilder(OPEN).vertex("doc", "object").vertex("sec", "object").vertex("par", "object").vertex("note", "object").edge("doc", "sec", "has", "secs").edge("sec", "par", "holds", "pars").edge("par", "note", "says", "notes").build()
VIEW = Compiled(
    frozenset({"book", "line"}), frozenset({Edge("book", "line", "of", "lines")}), {"doc": "book", "par": "line"},
)
TARGET = Schema("open", {"book": "object", "line": "object", "line.t": "string"}, frozenset({*VIEW.edges, Edge("line", "line.t", "prop", "t")}), constraints={"line.t": {"maxLength": "5"}})
LENS = EditLens(lens.TreeLens(SOURCE, TARGET, VIEW))


def source(spark, n=3):
    empty = {}
    nodes, arcs = [], []
    for r in range(n):
        nodes.append((r, 0, "doc", None, empty))
        for s in range(2):
            sid = 10 * (s + 1)
            nodes.append((r, sid, "sec", None, empty))
            arcs.append((r, 0, sid, s, "has", "secs"))
            for p in range(2):
                pid = sid + p + 1
                nodes.append((r, pid, "par", f"p{pid}", {"t": "x"}))
                arcs.append((r, sid, pid, p, "holds", "pars"))
                nodes.append((r, pid + 100, "note", None, empty))
                arcs.append((r, pid, pid + 100, 0, "says", "notes"))
    return tree.Tree(spark.createDataFrame(nodes, "record_id long, node_id long, anchor string, value string, fields map<string,string>"), spark.createDataFrame(arcs, "record_id long, parent long, child long, pos long, kind string, name string"))


def log(spark, *rows):
    names = ("record_id", "seq", "op", "node", "parent", "kind", "name", "anchor", "field", "value", "joined")
    return spark.createDataFrame([tuple({"record_id": 0, "seq": i, **r}.get(n) for n in names) for i, r in enumerate(rows)], edits.EDIT_SCHEMA)


def plain(t):
    nodes = t.nodes.select("record_id", "node_id", "anchor", "value", F.array_sort(F.transform(F.map_entries("fields"), lambda e: F.concat_ws("=", e["key"], e["value"]))).alias("f"))
    return sorted(map(str, nodes.collect())), sorted((r.record_id, r.parent, r.child, r.kind, r.name) for r in t.arcs.collect())


def settled(t):
    return tree.Tree(written(t.nodes, "n"), written(t.arcs, "a"))


def test_batch_equals_incremental(spark):
    """Getting after editing gives what editing the view with the carried edits gives."""
    t = source(spark)
    edits_ = log(
        spark,
        {"op": "set_field", "node": 11, "field": "t", "value": "new"},
        {"op": "insert_node", "node": 500, "parent": 20, "kind": "holds", "name": "pars", "anchor": "par", "value": "fresh"},
        {"op": "set_field", "node": 500, "field": "t", "value": "in"},
        {"op": "insert_node", "node": 501, "parent": 0, "kind": "has", "name": "secs", "anchor": "sec"},
        {"op": "set_field", "node": 10, "field": "t", "value": "hidden"},
        {"op": "delete_node", "node": 112},
        {"op": "delete_node", "node": 12},
        {"op": "remove_field", "node": 21, "field": "t"},
        {"op": "identity", "node": 0},
        {"record_id": 2, "op": "set_field", "node": 21, "field": "t", "value": "other"},
    )
    carried = LENS.get_edits(t, edits_)
    assert carried.errors.count() == 0 and carried.absorbed.count() == 3
    nodes, arcs, bad = edits.apply_tree_edits(t.nodes, t.arcs, edits_)
    assert bad.count() == 0
    after = tree.restrict(settled(tree.Tree(nodes, arcs)), SOURCE, VIEW).tree
    view = settled(tree.restrict(t, SOURCE, VIEW).tree)
    nodes, arcs, bad = edits.apply_tree_edits(view.nodes, view.arcs, written(carried.log, "log"))
    assert bad.count() == 0
    assert plain(tree.Tree(nodes, arcs)) == plain(after)


def test_put_then_get_is_the_view_edit(spark):
    """An edit of the view, put into the source and got again, is the edit."""
    t = source(spark)
    edits_ = log(spark, {"op": "set_field", "node": 11, "field": "t", "value": "v"}, {"op": "remove_field", "node": 12, "field": "t"}, {"op": "delete_node", "node": 77}, {"op": "relabel_node", "node": 0, "anchor": "book"})
    put = LENS.put_edits(t, edits_)
    assert put.errors.count() == 0
    got = LENS.get_edits(t, written(put.log, "log"))
    assert sorted(map(str, got.log.collect())) == sorted(map(str, edits_.collect()))


def test_what_stands_against_an_edit(spark):
    t = source(spark)
    edits_ = log(
        spark,
        {"op": "set_field", "node": 11, "field": "t", "value": "too long"},
        {"op": "relabel_node", "node": 10, "anchor": "par"},
        {"op": "relabel_node", "node": 12, "anchor": "sec"},
        {"op": "insert_node", "node": 600, "parent": 11, "kind": "x", "anchor": "doc"},
        {"op": "set_field", "node": 9999, "field": "t", "value": "who"},
        {"op": "set_field", "node": 11, "field": "t"},
    )
    got = LENS.get_edits(t, edits_)
    assert {r.seq: r.reason for r in got.errors.collect()} == {0: "RefinementViolation", 1: "NoPlace", 3: "NoEdgeFound"}
    ops = {r.seq: (r.op, r.node) for r in got.log.collect()}
    assert ops == {0: ("identity", 11), 1: ("identity", 10), 2: ("contract_node", 12), 3: ("identity", 600), 4: ("set_field", 9999), 5: ("set_field", 11)}
    put = LENS.put_edits(t, log(spark, {"op": "insert_node", "node": 700, "parent": 0, "kind": "of", "name": "lines", "anchor": "line"}))
    assert [r.reason for r in put.errors.collect()] == ["NoEdgeFound"]
    assert LENS.get_edits(t, edits_.limit(0)).log.count() == 0 and LENS.put_edits(t, edits_.limit(0)).log.count() == 0


def test_fields_follow_their_transforms(spark):
    m = Compiled(frozenset(SOURCE.vertices), SOURCE.edges, {v: v for v in SOURCE.vertices}, transforms={"par": [("rename", "t", "title"), ("apply", "title", "upper title", None), ("drop", "u"), ("compute", "n", "1"), ("keep", ("title", "n"))]})
    both = EditLens(lens.TreeLens(SOURCE, SOURCE, m))
    t = source(spark)
    flat = tree.Tree(t.nodes.drop("fields"), t.arcs)
    edits_ = log(spark, *({"op": "set_field", "node": 11, "field": f, "value": "ab"} for f in ("t", "u", "z")))
    got = {r.seq: (r.op, r.field, r.value) for r in both.get_edits(flat, edits_).log.collect()}
    assert got[0] == ("set_field", "title", "AB") and got[1][0] == got[2][0] == "identity"
    put = both.put_edits(flat, log(spark, {"op": "set_field", "node": 11, "field": "title", "value": "x"}, {"op": "set_field", "node": 11, "field": "n", "value": "2"}))
    assert sorted((r.seq, r.op, r.field) for r in put.log.collect()) == [(0, "set_field", "t"), (1, "identity", "n")]
    assert [r.reason for r in put.errors.collect()] == ["ComputedField"]
