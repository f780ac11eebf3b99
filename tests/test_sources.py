import json

import pytest
from pyspark.sql import functions as F

from weftline import versioning
from weftline.schema import OPEN, Schema, SchemaBuilder
from weftline.sources import languages, records
from weftline.streaming import edits as stream
from weftline.theory import Morphism, Theory, TheoryError, check_equation, check_model, check_morphism, colimit, compose, free_model, pullback, quotient, resolve, rewrite, same

POST = {"type": "object", "required": ["text"], "properties": {"text": {"type": "string", "maxLength": 20}, "tags": {"type": "array", "items": {"type": "string"}}, "at": {"type": "object", "properties": {"n": {"type": "integer"}}}}}


def test_json_round_trip_keeps_the_rest(spark):
    s = languages.read_json_schema(POST)
    texts = ['{"text":"hi","tags":["a","b"],"at":{"n":3},"other":{"x":1},"$type":"post","flag":true,"name":"q\\"z"}', '{"text":"only"}', "no json", None]
    df = records.parse_json(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string"), "t", s, "root")
    got = {r.id: r for r in df.collect()}
    assert got[0].record.tags == ["a", "b"] and got[0].record["at"].n == 3 and got[0].type == "post" and set(got[0].rest) == {"other", "flag", "name"}
    assert got[1].rest == {} and got[2].record is None and got[3].record is None
    out = {r.id: r.json for r in records.emit_json(df.where("id < 2")).collect()}
    assert json.loads(out[0]) == {k: v for k, v in json.loads(texts[0]).items() if k != "$type"} and json.loads(out[1]) == {"text": "only"}


def test_json_folder_and_tree(spark, tmp_path):
    s = languages.read_json_schema(POST)
    for i, t in enumerate(['{"text":"a","tags":["x","y"]}', "broken", '{"text":"b"}']):
        (tmp_path / f"{i}.json").write_text(t)
    good, bad = records.read_json_dir(spark, str(tmp_path), s, "root")
    assert good.count() == 2 and [r.file[-6:] for r in bad.collect()] == ["1.json"]
    t = records.to_tree(good.withColumn("record_id", F.monotonically_increasing_id()), s, "root")
    assert sorted(r.value for r in t.nodes.where("value is not null").collect()) == ["a", "b", "x", "y"]
    assert t.nodes.count() == 7 and t.arcs.count() == 5 and [r.pos for r in t.arcs.where("kind = 'item'").orderBy("pos").collect()] == [0, 1]


def test_tables(spark, tmp_path):
    p = tmp_path / "t.tsv"
    p.write_text("# note\n\na\tb\tc\n1\t_\tx y\r\n2\t\"q\"\t3\n\n# end\n")
    df = records.read_table(spark, str(p))
    assert [tuple(r) for r in df.orderBy("a").collect()] == [("1", None, "x y"), ("2", '"q"', "3")]
    assert [r.value for r in records.emit_table(df).orderBy("value").collect()] == ["1\t_\tx y", '2\t"q"\t3']
    (tmp_path / "e.tsv").write_text("")
    with pytest.raises(ValueError):
        records.read_table(spark, str(tmp_path / "e.tsv"))
    wide = records.split_table(spark.createDataFrame([("1,2,3",)], "value string"), ["a"], ",", extra=2)
    assert wide.columns == ["a", "col_1", "col_2"]
    records.write_table(df, str(tmp_path / "out"))
    assert records.read_table(spark, str(tmp_path / "out"), comment=None).count() == 2


CONLLU = "# sent_id = s1\n# text = The cat\n1\tThe\tthe\tDET\t_\t_\t2\tdet\t_\t_\n2\tcat\tcat\tNOUN\t_\tNumber=Sing\t0\troot\t_\t_\n\n# sent_id = s2\n1\tGo\tgo\tVERB\t_\t_\t0\troot\t_\t_\n\n"


def test_conllu_round_trip(spark):
    docs = spark.createDataFrame([(1, CONLLU), (2, ""), (3, None)], "doc_id long, text string")
    sents, toks = records.parse_conllu(docs)
    assert sorted((r.sent_idx, r.metadata["sent_id"]) for r in sents.collect()) == [(0, "s1"), (1, "s2")]
    assert [(r.FORM, r.FEATS) for r in toks.orderBy("sent_idx", "token_idx").collect()] == [("The", None), ("cat", "Number=Sing"), ("Go", None)]
    assert records.emit_conllu(sents, toks).first().text == CONLLU


def test_xml(spark):
    df = spark.createDataFrame([(1, '<n a="x"><name>Q</name><k>3</k></n>')], "id long, x string")
    r = records.parse_xml(df, "x", "_a string, name string, k int", "n").first().record
    assert (r["_a"], r.name, r.k) == ("x", "Q", 3)


USERS = "CREATE TABLE users (id INTEGER PRIMARY KEY, name VARCHAR(255) NOT NULL, email TEXT UNIQUE, active BOOLEAN DEFAULT true);\nCREATE TABLE posts (id INT, title TEXT, author_id INT, FOREIGN KEY (author_id) REFERENCES users (id));"


def test_schema_languages(spark):
    s = languages.read_sql(USERS)
    assert {e.tgt for e in s.outgoing("posts") if e.kind == "ref"} == {"users"} and s.constraints["users.name"]["maxLength"] == "255"
    assert languages.read_sql(languages.write_sql(s)).vertices == s.vertices
    j = languages.read_json_schema(POST)
    assert languages.read_json_schema(languages.write_json_schema(j)) == j and j.struct("root")["tags"].dataType.simpleString() == "array<string>"
    loop = languages.read_json_schema({"$ref": "#/$defs/n", "$defs": {"n": {"type": "object", "properties": {"next": {"$ref": "#/$defs/n"}}}}})
    assert loop.cyclic()
    avro = {"type": "record", "name": "R", "fields": [{"name": "a", "type": "long"}, {"name": "b", "type": ["null", "string"]}, {"name": "c", "type": {"type": "array", "items": "double"}}, {"name": "e", "type": {"type": "enum", "name": "E", "symbols": ["X", "Y"]}}]}
    av = languages.read_avro(avro)
    assert languages.read_avro(languages.write_avro(av, "R")).edges == av.edges and av.constraints
    df = spark.createDataFrame([(1, "x")], "id int, name string")
    assert languages.from_struct(df.schema, "t").struct("t").simpleString() == "struct<id:int,name:string>"
    with pytest.raises(languages.LanguageError):
        languages.read_sql("select 1")
    with pytest.raises(languages.LanguageError):
        languages.protocol("nothing")
    assert languages.protocol("conllu").shape == "tables" and languages.define(languages.Protocol("mine")).name in languages.PROTOCOLS
    checked = spark.createDataFrame([(("toolong" * 9,),)], "record struct<text:string>")
    conds = languages.checks(j, "root")
    assert checked.select(conds["maxLength_text"]).first()[0] is False


def test_versions(spark, tmp_path):
    mk = lambda **v: Schema("open", {"a": "object", **v})
    repo = versioning.Repository()
    with pytest.raises(versioning.VersionError):
        repo.commit("nothing")
    repo.add(mk())
    one = repo.commit("one")
    repo.branch("side")
    repo.add(mk(x="string"))
    two = repo.commit("two")
    repo.checkout("side")
    repo.add(mk(y="string"))
    repo.commit("three")
    merged, bad = repo.merge("main")
    assert not bad and set(repo.schema().vertices) == {"a", "x", "y"} and repo.merge_base(merged, two) == two
    assert repo.is_ancestor(one, "HEAD") and len(repo.log()) == 4 and repo.blame("x").id == merged
    repo.checkout("main")
    assert repo.merge("side")[0] == merged  # fast-forward
    repo.add(mk(x="integer"))
    repo.commit("int")
    repo.branch("other", two)
    repo.checkout("other")
    repo.add(mk(x="number"))
    repo.commit("num")
    found, bad = repo.merge("main")
    assert found is None and ("BothModifiedVertex", "x") in bad
    assert repo.bisect(one, "other", lambda s: s.vertices.get("x") != "number") == repo.tip
    repo.tag("v1")
    repo.reset(two, "soft")
    assert repo.staged.vertices["x"] == "number"
    repo.stash()
    assert repo.stash_pop().vertices["x"] == "number"
    repo.amend("again")
    assert repo.commits[repo.tip].message == "again" and repo.gc() >= 0
    repo.store.save(spark, str(tmp_path / "s"))
    assert set(versioning.Store.load(spark, str(tmp_path / "s")).objects) == set(repo.store.objects)
    df = spark.createDataFrame([(1, "x")], "id int, name string")
    r = versioning.Repository()
    r.add(languages.from_struct(df.schema, "t"))
    first = r.commit("1")
    b = SchemaBuilder(OPEN).vertex("t", "object").vertex("t.id", "int32").vertex("t.title", "string").edge("t", "t.id", "prop", "id").edge("t", "t.title", "prop", "title")
    r.add(b.build())
    second = r.commit("2")
    there = r.migrate(df, "t", first, second)
    assert there.columns == ["id", "title"] and r.migrate_back(there, "t", first, second).columns == ["id", "name"]


MONOID = Theory("monoid", frozenset({"M"}), {"e": ((), "M"), "m": (("M", "M"), "M")}, {"left": (("m", ("e",), ("var", "x")), ("var", "x")), "assoc": (("m", ("m", ("var", "x"), ("var", "y")), ("var", "z")), ("m", ("var", "x"), ("m", ("var", "y"), ("var", "z"))))})


def test_theories(spark):
    MONOID.check()
    with pytest.raises(TheoryError):
        Theory("bad", frozenset(), {"f": (("X",), "X")}).check()
    assert check_model(MONOID, {"M": [0, 1, 2]}, {"e": lambda: 0, "m": lambda a, b: (a + b) % 3}) == []
    assert check_model(MONOID, {"M": [0, 1]}, {"e": lambda: 1, "m": lambda a, b: a})[0][0] == "left"
    ident = Morphism({"M": "M"}, {"e": "e", "m": "m"})
    assert check_morphism(MONOID, MONOID, ident) == [] and compose(ident, ident) == ident
    assert check_morphism(MONOID, Theory("t", frozenset({"M"}), MONOID.ops), ident) != []
    glued = colimit(MONOID, Theory("act", frozenset({"M", "X"}), {"a": (("M", "X"), "X")}), Theory("s", frozenset({"M"})))
    assert glued.sorts == {"M", "X"} and "a" in glued.ops
    rules = Theory("r", frozenset({"N"}), {"z": ((), "N"), "s": (("N",), "N"), "p": (("N", "N"), "N")}, {}, {"pz": (("p", ("z",), ("var", "x")), ("var", "x")), "ps": (("p", ("s", ("var", "x")), ("var", "y")), ("s", ("p", ("var", "x"), ("var", "y"))))})
    two = ("s", ("s", ("z",)))
    assert rewrite(rules, ("p", two, two)) == ("s", ("s", two)) and same(("m", ("var", "a")), ("m", ("var", "b")))
    assert len(free_model(MONOID, 2)["M"]) == 1 and quotient(glued, [("M", "X")]).sorts == {"M"}
    assert pullback(MONOID, MONOID, ident, ident).sorts == {"M"} and resolve(Theory("k", extends=("monoid",)), {"monoid": MONOID}).ops == MONOID.ops
    nums = spark.range(10).withColumn("d", F.col("id") * 2)
    assert check_equation(nums, {"x": "id"}, F.col("d"), F.col("id") + F.col("id")).count() == 0
    assert check_equation(nums, {"x": "id"}, F.col("d"), F.col("id") + 1).count() == 9


def test_edit_stream(spark, tmp_path):
    start = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    t = stream.EditedTable(spark, str(tmp_path / "t"), "k", start)
    log = "seq long, op string, k long, v string"
    src = str(tmp_path / "log")
    spark.createDataFrame([(1, "update", 1, "z"), (2, "insert", 3, "c")], log).coalesce(1).write.mode("append").parquet(src)
    q = t.follow(spark.readStream.schema(log).parquet(src), str(tmp_path / "ck"))
    q.awaitTermination(60)
    spark.createDataFrame([(3, "delete", 2, None), (4, "delete", 9, None)], log).coalesce(1).write.mode("append").parquet(src)
    t.follow(spark.readStream.schema(log).parquet(src), str(tmp_path / "ck")).awaitTermination(60)
    assert sorted(map(tuple, t.read().collect())) == [(1, "z"), (3, "c")]
    assert [r.reason for r in spark.read.parquet(t.errors).collect()] == ["RowNotFound"]


def test_windows(spark, sf_dir, tmp_path):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    src = str(tmp_path / "ev")
    spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(src)
    schema = spark.read.parquet(src).schema
    q = stream.windowed_counts(spark.readStream.schema(schema).parquet(src), "ts", ["event_type"], "1 day", "1 hour").writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.sql("select sum(n) from counts").first()[0] == spark.read.parquet(src).count()
    assert stream.sessions(spark.read.parquet(src), "ts", ["user_id"], "1 hour", "1 hour").count() > 0
