"""Nulls, ties, repeats, clashing names, restarts and plan sizes of the core operators."""

import json

import pytest
from pyspark.sql import functions as F

from weftline.operators import edits, merge, relational, tree
from weftline.plans.migration import Compiled
from weftline.schema import OPEN, Edge, SchemaBuilder
from weftline.sources import records
from weftline.storage import NoSharedFolder, shared_dir, written
from weftline.streaming.edits import EditedTable


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_ordinals_keep_every_column(spark):
    df = spark.range(30_000).select((F.col("id") * 7919 % 1000).alias("p"), F.col("id").alias("base"), F.lit("x").alias("_at"), F.lit(5).alias("ordinal"))
    got = relational.ordinals(df, "p", "base")
    assert got.columns == ["p", "base", "_at", "ordinal"]
    found = got.orderBy("p", "base").collect()
    assert [r.ordinal for r in found] == list(range(30_000))
    assert relational.ordinals(df.limit(0), "p").count() == 0


def test_json_rest_keeps_types(spark):
    s = SchemaBuilder(OPEN).vertex("r", "object").vertex("r.zip", "string").vertex("r.n", "integer").edge("r", "r.zip", "prop", "zip").edge("r", "r.n", "prop", "n").build()
    texts = ['{"zip":"12","x":{"a":1}}', '{"zip":"42","n":1,"a":"42","b":"true","c":"null","d":"{}","e":42,"f":true,"g":null,"h":[1,"2",{"k":"3"}],"i":"q\\"\\\\\\n"}', "{}", '{"zip":null}', "not json", "[1]", None]
    got = records.emit_json(records.parse_json(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t", s, "r")).orderBy("i").collect()
    for r in got:
        if r.t and r.t.startswith("{"):
            assert json.loads(r.json) == {k: v for k, v in json.loads(r.t).items() if k not in ("zip", "n") or v is not None}
        else:
            assert r.record is None and r.rest is None


def test_tables_from_several_files(spark, tmp_path):
    for name, text in {"a.tsv": "# c\n\nx\ty\n1\t2\nx\ty\n3\t4\t5\n", "b.tsv": "x\ty\n_\t\n"}.items():
        (tmp_path / name).write_text(text)
    got = records.read_table(spark, str(tmp_path))
    assert got.columns == ["x", "y", "col_2"]
    assert rows(got) == sorted([("1", "2", None), ("x", "y", None), ("3", "4", "5"), (None, "", None)], key=repr)
    (tmp_path / "c.tsv").write_text("other\theader\n")
    with pytest.raises(ValueError, match="different headers"):
        records.read_table(spark, str(tmp_path))
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "empty.tsv").write_text("# only\n\n")
    with pytest.raises(ValueError, match="no header"):
        records.read_table(spark, str(tmp_path / "e"))


def test_conllu_repeated_keys(spark):
    text = "# sent_id = 1\n# text = a\n# text = b = c\n1\tx\t_\n2\ty\n\n\n# sent_id = 2\n\n3\tz\n"
    sents, toks = records.parse_conllu(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string"))
    assert [(r.sent_idx, r.metadata) for r in sents.orderBy("sent_idx").collect()] == [(0, {"sent_id": "1", "text": "b = c"}), (1, {"sent_id": "2"}), (2, {})]
    again = records.parse_conllu(records.emit_conllu(sents, toks))
    assert rows(again[1]) == rows(toks) and rows(again[0].select("sent_idx", F.map_entries("metadata"))) == rows(sents.select("sent_idx", F.sort_array(F.map_entries("metadata"))))


def test_conllu_is_written_without_joins(spark):
    sents, toks = records.parse_conllu(spark.createDataFrame([(1, "1\tx\n")], "doc_id long, text string"))
    assert "Join" not in records.emit_conllu(sents, toks)._jdf.queryExecution().optimizedPlan().toString()


def test_merge_odd(spark):
    base = spark.createDataFrame([(None, "n", 1), (1, "a", 1), (2, "b", 1), (2, "b", 1)], "k int, kept string, v int")
    with pytest.raises(ValueError, match="kept"):
        merge.three_way_merge(base, base, base, ["k"])
    names = ("_kept", "_fate", "_conflict")
    got = merge.three_way_merge(base, base.withColumn("v", F.when(F.col("k").isNull(), 9).otherwise(F.col("v"))), base.where("k is null or k <> 1"), ["k"], names)
    assert rows(got) == sorted([(None, True, "n", 9, "ours", None), (1, False, None, None, "theirs", None), (2, True, "b", 1, "base", None)], key=repr)
    assert rows(merge.merged_rows(got, names)) == sorted([(None, "n", 9), (2, "b", 1)], key=repr)
    assert merge.conflicts(got, names).count() == 0
    assert merge.three_way_merge(base.limit(0), base.limit(0), base.limit(0), ["k"], names).count() == 0


def test_table_edits_odd(spark):
    schema = "id int, k string, there double, op string, row int"
    t = spark.createDataFrame([(1, "a", 1.0, "o", 1), (None, "n", 2.0, "o", 2), (3, "c", None, "o", 3), (4, "d", 4.0, "o", 4)], schema)
    log = [(1, "update", 1, "A", None, None), (2, "delete", None, None, None, None), (3, "insert", None, "again", None, None), (4, "update", 3, None, None, ["k", "row"]), (5, "delete", 9, None, None, None),
           (6, "insert", 1, "dup", None, None), (7, "zap", 1, "q", None, None), (8, "insert", 7, "new", None, None), (9, "update", 7, None, 7.5, None), (10, "update", 8, "x", None, None), (11, "delete", 4, None, None, None)]
    log = spark.createDataFrame([(s, o, i, k, x, n) for s, o, i, k, x, n in log], "seq long, op string, id int, k string, there double, set_null array<string>")
    got = edits.apply_table_edits(t.drop("op", "row"), "id", log)
    assert rows(got.rows) == sorted([(None, "again", None), (1, "A", 1.0), (3, None, None), (7, "new", 7.5)], key=repr)
    assert rows(got.errors) == [(10, "update", 8, "RowNotFound"), (5, "delete", 9, "RowNotFound"), (6, "insert", 1, "DuplicateKey"), (7, "zap", 1, "ApplyFailed")]
    none = edits.apply_table_edits(t.drop("op", "row"), "id", log.limit(0))
    assert none.rows.count() == 4 and none.errors.count() == 0


def test_hot_key_of_edits(spark):
    """A key with thousands of edits ends as its last ones say."""
    log = spark.range(9000).select(F.col("id").alias("seq"), F.when(F.col("id") % 100 == 0, "delete").when(F.col("id") % 100 == 1, "insert").otherwise("update").alias("op"), F.lit(1).alias("k"), F.when(F.col("id") % 3 == 0, F.col("id")).alias("v"))
    got = edits.apply_table_edits(spark.createDataFrame([], "k int, v long"), "k", log)
    assert rows(got.rows) == [(1, 8997)] and rows(got.errors) == [(0, "delete", 1, "RowNotFound")]


def test_update_cell_odd(spark):
    t = spark.createDataFrame([(1, 2, "a"), (1, 2, "a"), (1, 3, "b"), (None, 1, "n")], "k int, _n int, v string")
    assert rows(edits.update_cell(t, "k", 1, "v", "X", F.col("_n"))) == sorted([(1, 2, "X"), (1, 2, "a"), (1, 3, "b"), (None, 1, "n")], key=repr)
    assert rows(edits.update_cell(t, "k", None, "v", "X", F.col("_n")))[-1] == (None, 1, "X")
    assert rows(edits.update_cell(t, "k", 5, "v", "X", F.col("_n"))) == rows(t)


def chain(n):
    b = SchemaBuilder(OPEN).vertex("v0", "object")
    for i in range(1, n + 2):
        b.vertex(f"v{i}", "object").edge(f"v{i - 1}", f"v{i}", f"e{i}", None)
    return b.build()


def chain_tree(spark, n, records_=5):
    ids = spark.range(records_)
    nodes = ids.select(F.col("id").alias("record_id"), F.explode(F.sequence(F.lit(0), F.lit(n + 1))).alias("i")).select("record_id", F.col("i").cast("long").alias("node_id"), F.concat(F.lit("v"), "i").alias("anchor"))
    arcs = nodes.where("node_id > 0").select("record_id", (F.col("node_id") - 1).alias("parent"), F.col("node_id").alias("child"), F.lit(0).cast("long").alias("pos"), F.concat(F.lit("e"), "node_id").alias("kind"), F.lit(None).cast("string").alias("name"))
    return tree.Tree(written(nodes, "nodes"), written(arcs, "arcs"))


def test_long_dead_runs(spark):
    """A chain of dead vertices is climbed right, and the plan does not grow with it."""
    joins = {}
    for n in (1, 2, 4, 8, 16):
        s = chain(n)
        m = Compiled(frozenset({"v0", f"v{n + 1}"}), frozenset({Edge("v0", f"v{n + 1}", "to", None)}), {"v0": "v0", f"v{n + 1}": f"v{n + 1}"})
        t = chain_tree(spark, n)
        fast, slow = (tree.restrict(t, s, m, valid=v) for v in (True, False))
        want = sorted((r, 0, n + 1, "to") for r in range(5))
        assert rows(fast.tree.arcs.select("record_id", "parent", "child", "kind")) == want == rows(slow.tree.arcs.select("record_id", "parent", "child", "kind"))
        assert rows(fast.dropped_nodes.select("node_id", "contracted_into").distinct()) == sorted([(i, 0) for i in range(1, n + 1)], key=repr)
        joins[n] = fast.tree.arcs._jdf.queryExecution().optimizedPlan().toString().count("Join")
    assert joins[16] <= joins[8] <= joins[4] <= joins[2] + 1, joins


def test_edited_table_restarts(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    start = spark.range(200).select(F.col("id").alias("k"), F.lit("s").alias("v"))
    t = EditedTable(spark, at, "k", start, buckets=8)
    batch = lambda n, op, k, v: spark.createDataFrame([(n, op, k, v)], "seq long, op string, k long, v string")
    t.apply(batch(1, "update", 5, "a"), 0)
    before = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "t" / "data" / "-1").rglob("*.parquet")}
    t = EditedTable(spark, at, "k")  # a new process
    t.apply(batch(2, "delete", 6, None), 1)
    t.apply(batch(2, "delete", 6, None), 1)  # repeated
    t = EditedTable(spark, at, "k")
    t.apply(batch(3, "insert", 999, "new"), 2)
    t.apply(batch(4, "update", None, "no"), 3)
    got = dict(rows(EditedTable(spark, at, "k").read()))
    assert len(got) == 200 and got[5] == "a" and got[999] == "new" and 6 not in got
    assert {p.name: p.stat().st_mtime_ns for p in (tmp_path / "t" / "data" / "-1").rglob("*.parquet")} == before, "untouched buckets are not written again"
    assert len(list((tmp_path / "t" / "manifests").glob("[0-9-]*"))) <= 2
    assert [r.reason for r in spark.read.parquet(f"{at}/errors").collect()] == ["RowNotFound"]
    with pytest.raises(ValueError, match="no table"):
        EditedTable(spark, f"file://{tmp_path}/none", "k")
    assert EditedTable(spark, f"file://{tmp_path}/empty", "k", schema="k long, v string").read().count() == 0


def test_a_cluster_needs_a_shared_folder(spark):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(NoSharedFolder):
        shared_dir(Session())
    assert shared_dir(spark)
