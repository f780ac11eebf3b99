"""One small test for each finding of the third round that was mended; each failed before."""

import os

import pytest
from pyspark.sql import functions as F

from weftline import catalog
from weftline.functions import env_of, failure, parse
from weftline.operators import edit_lens, lens, tree
from weftline.operators.relational import ProductSizeExceeded
from weftline.plans.migration import Compiled
from weftline.schema import OPEN, Edge, SchemaBuilder

FIELDS = "record_id long, node_id long, anchor string"
ARCS = "record_id long, parent long, child long, pos long, kind string, name string"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def with_table(tmp_path, sf_dir, name, df) -> str:
    """A folder like ``sf_dir`` with another table ``name``."""
    for f in os.listdir(sf_dir):
        if f != f"{name}.parquet":
            os.symlink(f"{sf_dir}/{f}", f"{tmp_path}/{f}")
    df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_length_of_a_mapped_range_makes_no_list(spark):
    """the length and the limit of a list are known from its bounds, so nothing of its size is made."""
    df = spark.createDataFrame([(3,), (0,), (None,), (30000,)], "n long")
    text = "length (map [1 .. n] (\\x -> x)) / (if n > 20000 then 0 else n)"
    out = df.select("n", failure(parse(text), env_of(df.schema)).alias("why"))
    assert "sequence(" not in plan(out) and "transform(" not in plan(out)
    assert {r.n: r.why for r in out.collect()} == {3: None, 0: "NoValue", None: "NoValue", 30000: "NoValue"}


def test_products_are_limited_record_by_record(spark):
    """each record is an instance of its own; sizes of different records do not multiply."""
    nodes = spark.createDataFrame([(r, i, "a" if i < 3 else "b") for r in range(4) for i in range(6)], FIELDS)
    t = tree.Tree(nodes, spark.createDataFrame([], ARCS))
    s = SchemaBuilder(OPEN).vertex("a", "object").vertex("b", "object").build()
    m = Compiled(frozenset({"c"}), frozenset(), {"a": "c", "b": "c"})
    assert tree.product(t, s, m, max_size=9).nodes.count() == 24
    with pytest.raises(ProductSizeExceeded):
        tree.product(t, s, m, max_size=8)


def test_negative_zero_is_no_debt(spark, sf_dir, tmp_path):
    """to SQL -0.0 is not below 0."""
    c = catalog.table(spark, sf_dir, "customer").withColumn("c_acctbal", F.when(F.col("c_custkey") % 2 == 0, -0.0).otherwise(F.col("c_acctbal")))
    d = with_table(tmp_path, sf_dir, "customer", c)
    assert {r.band for r in catalog.QUERIES["delta_rename"](spark, d).where("id % 2 = 0").collect()} == {"low"}


def test_a_root_of_negative_zero_lives(spark, sf_dir, tmp_path):
    """to SQL -0.0 is at least 0."""
    d = with_table(tmp_path, sf_dir, "customer", catalog.table(spark, sf_dir, "customer").withColumn("c_acctbal", F.lit(-0.0)))
    assert {r.reason for r in catalog.QUERIES["tree_restrict_errors"](spark, d).collect()} == {"NoEdgeFound"}


def test_interpreted_rows_are_dealt_out(spark, sf_dir):
    """a small file's rows are evaluated on all cores, and not by the task that reads it."""
    out = catalog.QUERIES["fn_interpreted"](spark, sf_dir)
    assert out.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_broken_equations_pass_through_no_single_task(spark, sf_dir):
    """a limit that lets all rows through gathers them in one task; without one they stay where they are."""
    assert "Limit" not in plan(catalog.QUERIES["theory_equation"](spark, sf_dir))


def test_validation_joins_each_table_few_times(spark):
    """F8: everything that can be wrong is still found, with half the joins."""
    nodes = [(1, 0, "a"), (1, 1, "b"), (2, 0, "a"), (2, 5, "b"), (2, 6, "?"), (3, 0, "b"), (3, 1, "b"), (4, 0, "a")]
    arcs = [(1, 0, 1, 0, "e", None), (2, 0, 9, 0, "e", None), (2, 0, 6, 0, "e", None), (3, 0, 1, 0, "e", None), (3, 1, 0, 0, "e", None)]
    t = tree.Tree(spark.createDataFrame(nodes, FIELDS), spark.createDataFrame(arcs, ARCS))
    s = SchemaBuilder(OPEN).vertex("a", "object").vertex("b", "object").edge("a", "b", "e", None).required("a", Edge("a", "b", "e", None)).build()
    out = tree.validate(t, s)
    assert sorted(map(tuple, out.collect())) == [
        (2, "InvalidAnchor", "6:?"), (2, "InvalidEdge", "a->?"), (2, "MissingRequiredEdge", "0:b"), (2, "ParentMapInconsistent", "0->9"), (2, "UnreachableNode", "5"),
        (3, "InvalidEdge", "b->b"), (3, "InvalidEdge", "b->b"), (3, "MissingRoot", ""), (4, "MissingRequiredEdge", "0:b"),
    ]
    assert plan(out).count("Join") <= 8


def test_dead_nodes_climb_alone(spark, sf_dir):
    """what a predicate kills is joined before the arcs are; the arcs themselves are written once and read without a join."""
    assert "Join" not in plan(catalog.QUERIES["tree_restrict_predicate"](spark, sf_dir))


def test_runs_of_dead_nodes_are_climbed_without_a_promise(spark):
    """chains of every length below a bound, in data of which nothing is promised, and a dead root is reported."""
    n = 7
    b = SchemaBuilder(OPEN)
    for i in range(n):
        b = b.vertex(f"v{i}", "object")
    for i in range(n - 1):
        b = b.edge(f"v{i}", f"v{i + 1}", "e", None)
    s = b.build()
    nodes = spark.createDataFrame([(r, i, f"v{i}") for r in (1, 2) for i in range(n)], FIELDS)
    arcs = spark.createDataFrame([(r, i, i + 1, 0, "e", None) for r in (1, 2) for i in range(n - 1)], ARCS)
    for k in range(1, n - 1):
        m = Compiled(frozenset({"v0", f"v{n - 1}"} | {f"v{i}" for i in range(k + 1, n)}), frozenset(Edge(f"v{i}", f"v{j}", "f", None) for i in range(n) for j in range(i + 1, n)), {f"v{i}": f"v{i}" for i in range(n) if i == 0 or i > k})
        r = tree.restrict(tree.Tree(nodes, arcs), s, m)
        assert sorted((a.record_id, a.parent, a.child) for a in r.tree.arcs.collect()) == sorted((x, 0 if i == k + 1 else i - 1, i) for x in (1, 2) for i in range(k + 1, n))
        m = m.with_survival("v0", "_id > 0")
        assert {(e.record_id, e.reason) for e in tree.restrict(tree.Tree(nodes, arcs), s, m).errors.collect()} == {(1, "RootPruned"), (2, "RootPruned")}


def test_nodes_of_a_mapping_without_errors_are_only_filtered(spark, sf_dir):
    """where no record failed, nodes are not joined with records that did."""
    assert "LeftAnti" not in plan(catalog.QUERIES["hom_evaluate"](spark, sf_dir))


def test_arcs_of_a_cascade_are_read_off_one_table(spark, sf_dir):
    """arcs are placed once, and read back without joins or sorts."""
    text = plan(catalog.QUERIES["cascade_data"](spark, sf_dir))
    assert "Join" not in text and "Window" not in text


def test_lines_of_a_tree_read_often_are_numbered_once(spark, sf_dir):
    """F16: the query's plan sorts no lines."""
    text = plan(catalog.QUERIES["tree_transforms"](spark, sf_dir))
    assert "Window" not in text and "LeftAnti" not in text


def test_each_edit_is_carried_once(spark, sf_dir):
    """the carried log and what became of each edit come from one plan, which does not meet itself."""
    assert "judged" in edit_lens.Carried.__dataclass_fields__
    assert plan(catalog.QUERIES["edit_get"](spark, sf_dir)).count("Join") <= 20


def test_expanded_nodes_are_found_once(spark, sf_dir):
    """what comes back is written once; the arcs join with it, and lines are not numbered again."""
    text = plan(catalog.QUERIES["tree_expand"](spark, sf_dir))
    assert "Window" not in text and text.count("Join") <= 9


def test_law_checks_rest_on_compressed_tables(spark):
    """what a law check keeps is written as columns, not as checkpointed rows, and differences group both sides once."""
    t = tree.Tree(spark.createDataFrame([(1, 0, "a"), (1, 1, "a"), (1, 1, "a")], FIELDS), spark.createDataFrame([], ARCS))
    kept = lens.settled(t)
    assert kept.nodes.inputFiles() and all(f.endswith(".parquet") for f in kept.nodes.inputFiles())
    other = tree.Tree(spark.createDataFrame([(1, 1, "a"), (2, 0, "b")], FIELDS), t.arcs)
    out = lens.differences(kept, other)
    assert sorted(map(tuple, out.collect())) == [(1, "node"), (1, "node"), (2, "node")]
    assert plan(out).count("Aggregate") == 2
