import pytest

from weftline.functions import compile_expr, parse
from weftline.functions.columns import Unsupported
from weftline.functions.fallback import interpreted
from weftline.operators import lens, tree
from weftline.plans.migration import Compiled, Migration, from_rows, to_rows
from weftline.schema import OPEN, Edge, Schema, SchemaBuilder
from weftline.sources.languages import LanguageError, read_json_schema
from weftline.sources.registry import Codec, Registry, files, to_json_text

S = read_json_schema({"type": "object", "properties": {"a": {"type": "string"}, "n": {"type": "integer"}}})


def test_codecs(spark, tmp_path):
    r = Registry()
    texts = lambda *t: spark.createDataFrame([(x,) for x in t], "value string")
    assert {"json", "conllu", "avro", "tei", "redis", "yaml"} <= set(r.names())
    assert r.parse("openapi", texts('{"a":"x","n":3}'), S, "root").first().record.n == 3
    assert r.parse("yaml", texts("a: x\nn: 4\n", "a: [", None), S, "root").where("record is not null").first().record.n == 4
    assert r.parse("toml", texts('a = "q"\nn = 5\n'), S, "root").first().record.a == "q"
    assert tuple(r.parse("tsv", texts("x\t_"), S, "root").first()) == ("x", None)
    assert r.parse("tei", texts("<root><a>z</a><n>6</n></root>"), S, "root").first().record.n == 6
    assert r.emit("json", r.parse("json", texts('{"a":"x"}'), S, "root")).first().json == '{"a":"x"}'
    pair = r.parse("conllu", spark.createDataFrame([(1, "1\tA" + "\t_" * 8 + "\n\n")], "doc_id long, value string"))
    assert r.emit("conllu", pair).first().text.startswith("1\tA\t_")
    r.register(Codec("mine", "tree", lambda df, s, root: df, lambda df: df))
    assert r.parse("mine", texts("k")).first().value == "k"
    for bad in (lambda: r.parse("nothing", texts("k")), lambda: to_json_text(texts("k"), "value", "ini")):
        with pytest.raises(LanguageError):
            bad()
    (tmp_path / "f.txt").write_text("whole\nfile")
    assert files(spark, str(tmp_path)).first().value == "whole\nfile"


def test_interpreter_for_the_rest(spark):
    e = parse("let f = {g = \\x -> x + n} in f.g 1")
    with pytest.raises(Unsupported):
        compile_expr(e, {})
    df = spark.createDataFrame([(1,), (None,)], "n long")
    assert [r[0] for r in df.select(interpreted(e, df.columns, "long")).collect()] == [2, None]


def test_mappings_are_data():
    e = Edge("a", "b", "prop", "x")
    m = Migration({"a": "c"}, {e: e}, {"h": "k"}, {}, {("a", "b"): e})
    assert from_rows(to_rows(m)) == m


def test_symmetric_lens(spark):
    mid = SchemaBuilder(OPEN).vertex("r", "object").vertex("l", "string").vertex("x", "string").edge("r", "l", "prop", "l").edge("r", "x", "prop", "x").build()
    leg = lambda keep: lens.TreeLens(mid, Schema("open", {"r": "object", keep: "string"}, frozenset(e for e in mid.edges if e.tgt == keep)), Compiled(frozenset({"r", keep}), frozenset(e for e in mid.edges if e.tgt == keep), {"r": "r", keep: keep}))
    both = lens.SymmetricLens(leg("l"), leg("x"))
    n = spark.createDataFrame([(1, 0, "r", None), (1, 1, "l", "left"), (1, 2, "x", "right")], "record_id long, node_id long, anchor string, value string")
    a = spark.createDataFrame([(1, 0, 1, 0, "prop", "l"), (1, 0, 2, 1, "prop", "x")], "record_id long, parent long, child long, pos long, kind string, name string")
    view, c, _ = both.left.get(tree.Tree(n, a))
    assert sorted(r.value for r in both.to_right(view, c).nodes.where("value is not null").collect()) == ["right"]
    right, c2, _ = both.right.get(tree.Tree(n, a))
    assert sorted(r.value for r in both.to_left(right, c2).nodes.where("value is not null").collect()) == ["left"]
    merged = lens.merge_complements(c, c2)
    assert {r.node_id for r in merged.dropped_nodes.collect()} == {1, 2}
