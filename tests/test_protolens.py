import pytest

from weftline.operators import tree
from weftline.plans.protolens import Chain, NotApplicable, Rewrite, from_diff, horizontal, vertical
from weftline.schema import OPEN, Edge, SchemaBuilder

S = SchemaBuilder(OPEN).vertex("r", "object").vertex("r.a", "string").vertex("r.b", "integer").edge("r", "r.a", "prop", "a").edge("r", "r.b", "prop", "b").build()


def test_rewrites_and_their_needs():
    c = Chain((Rewrite("rename_sort", ("r.a", "r.x")), Rewrite("drop_sort", ("r.b",)), Rewrite("add_sort", ("r.n", "string", "0")), Rewrite("add_op", ("r", "r.n", "prop", "n")), Rewrite("rename_op", ("r", "a", "x"))))
    t, m = c.instantiate(S)
    assert set(t.vertices) == {"r", "r.x", "r.n"} and {e.label for e in t.edges} == {"x", "n"} and m.vertex_map == {"r": "r", "r.a": "r.x"}
    assert c.needs(S) == [] and c.needs(t) and c.cost() == 1 + 0.5 + 0.5
    assert Chain.from_json(c.to_json()) == c
    done, bad = c.fleet({"one": S, "two": t})
    assert set(done) == {"one"} and set(bad) == {"two"}
    for r in (Rewrite("drop_sort", ("zz",)), Rewrite("add_op", ("r", "zz")), Rewrite("drop_op", ("r", "zz")), Rewrite("add_sort", ("r", "object")), Rewrite("fly", ())):
        with pytest.raises(NotApplicable):
            r.target(S)


def test_fusion_and_composition():
    a, b = Rewrite("rename_sort", ("r.a", "r.x")), Rewrite("rename_sort", ("r.x", "r.a"))
    assert Chain((a, b)).fused() == Chain() and vertical(Chain((a,)), Chain((b,))) == Chain((a, b))
    assert Chain((Rewrite("add_sort", ("q", "string")), Rewrite("drop_sort", ("q",)))).fused() == Chain()
    assert horizontal(Chain((a,)), Chain((Rewrite("drop_sort", ("r.a",)),)), S).target(S).vertices == {"r": "object", "r.b": "integer"}
    assert Rewrite("scoped", ("r", (("drop_sort", ("r.b",)),))).complement() == "dropped"


def test_differences_become_rewrites():
    t = Chain((Rewrite("drop_sort", ("r.b",)), Rewrite("add_sort", ("r.n", "string")), Rewrite("add_op", ("r", "r.n", "prop", "n")), Rewrite("coerce_sort", ("r.a", "integer")))).target(S)
    assert from_diff(S, t).target(S) == t
    assert from_diff(S, S) == Chain()
    assert from_diff(S, Chain((Rewrite("rename_sort", ("r.a", "r.z")),)).target(S), {"r.a": "r.z"}).steps[0].op == "rename_sort"


def test_a_chain_moves_data(spark):
    n = spark.createDataFrame([(1, 0, "r", None), (1, 1, "r.a", "v"), (1, 2, "r.b", "2")], "record_id long, node_id long, anchor string, value string")
    a = spark.createDataFrame([(1, 0, 1, 0, "prop", "a"), (1, 0, 2, 1, "prop", "b")], "record_id long, parent long, child long, pos long, kind string, name string")
    _, m = Chain((Rewrite("rename_sort", ("r.a", "r.x")), Rewrite("drop_sort", ("r.b",)))).instantiate(S)
    r = tree.restrict(tree.Tree(n, a), S, m)
    assert sorted((x.node_id, x.anchor) for x in r.tree.nodes.collect()) == [(0, "r"), (1, "r.x")] and r.tree.arcs.first().name == "a"
    assert Edge("r", "r.x", "prop", "a") in m.edges
