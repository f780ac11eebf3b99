"""Registered queries over schemas, mappings, lens documents, languages and streams, each on the driver's tables with its SQL."""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .catalog import _LINES, _NODES, BLOCK, BOUGHT, CONTRACT, ORDER_LENS, ORDER_TREE, _checkpoints, _log, _turns, expressions, order_tree, query_of, table
from .functions import compile_expr, env_of, failure, parse
from .functions.fallback import interpreted, spread
from .functions.syntax import pretty
from .operators import edits, lens, relational, transforms, tree
from .plans import compare, lens_text
from .plans.migration import Compiled, compile_migration, compose, find_morphisms, invert, to_migration
from .plans.protolens import Chain, Rewrite, from_diff
from .schema import OPEN, Edge, Schema, SchemaBuilder
from .sources import languages, records
from .sources.registry import Registry
from .storage import new_folder
from .streaming import edits as streams
from .theory import check_equation
from .versioning import Repository


def _columns(name: str, prefix: str = "") -> str:
    return f"SELECT '{prefix}' || column_name AS c FROM (DESCRIBE {name})"


def _schema(df, root: str = "t", kind: str | None = None) -> Schema:
    """A table's schema, its root of another ``kind`` if one is given."""
    s = languages.from_struct(StructType(df.schema.fields), root)
    return s if kind is None else replace(s, vertices={**s.vertices, root: kind})


# Differences of tables' schemas ------------------------------------------------------------------


def _two(spark, d):
    """Orders, and orders with one column gone, one of another type, and lineitem's besides."""
    o = table(spark, d, "orders")
    new = o.drop("o_orderdate").withColumn("o_totalprice", F.col("o_totalprice").cast("string"))
    wide = new.join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return _schema(o), _schema(wide)


@query_of("schema_diff", f"""SELECT 'added_vertices' AS facet, c AS key FROM ({_columns('lineitem', 't.')}) UNION ALL SELECT 'added_edges', 't -prop[' || c || ']-> t.' || c FROM ({_columns('lineitem')})
    UNION ALL SELECT * FROM (VALUES ('removed_vertices', 't.o_orderdate'), ('removed_edges', 't -prop[o_orderdate]-> t.o_orderdate'), ('kind_changes', 't.o_totalprice')) v(facet, key)""")
def schema_diff(spark, d):
    return spark.createDataFrame([(c.facet, c.key) for c in compare.diff(*_two(spark, d))], "facet string, key string")


@query_of("schema_breaking", f"""SELECT kind, breaking, n FROM (SELECT 'AddedVertex' AS kind, false AS breaking, count(*) AS n FROM ({_columns('lineitem')}) UNION ALL SELECT 'AddedEdge', false, count(*) FROM ({_columns('lineitem')}))
    UNION ALL SELECT * FROM (VALUES ('RemovedVertex', true, 1), ('RemovedEdge', true, 1), ('KindChanged', true, 1)) v(kind, breaking, n)""")
def schema_breaking(spark, d):
    found = [(v.breaking, v.kind) for v in compare.classify(compare.diff(*_two(spark, d)))]
    return spark.createDataFrame(found, "breaking boolean, kind string").groupBy("kind", "breaking").agg(F.count("*").alias("n"))


@query_of("schema_morphism", "SELECT 'a.' || column_name AS source, 'r.' || column_name AS target FROM (DESCRIBE nation) UNION ALL SELECT 'a', 'r'")
def schema_morphism(spark, d):
    """A table's columns find themselves again under another root, among other columns."""
    n = table(spark, d, "nation")
    best = find_morphisms(_schema(n, "a"), _schema(n.withColumn("more", F.lit("x")), "r"), monic=True, max_results=1)[0]
    return spark.createDataFrame(list(best.pairs), "source string, target string")


@query_of("version_log", "SELECT row_number() OVER (ORDER BY r_regionkey) AS seq, r_name AS message, r_regionkey + 1 AS vertices FROM region")
def version_log(spark, d):
    """A commit for each region; the log names them in order, and each version's schema is its own."""
    repo = Repository()
    names = [r.r_name for r in table(spark, d, "region").orderBy("r_regionkey").collect()]
    for i, name in enumerate(names):
        repo.add(Schema("open", {f"v{j}": "object" for j in range(i + 1)}))
        repo.commit(name)
    sizes = spark.createDataFrame([(c, len(repo.schema(c).vertices)) for c in repo.commits], "id string, vertices int")
    return repo.frame(spark).join(sizes, "id").select("seq", "message", "vertices")


@query_of("lens_laws", """SELECT 'get_put' AS law, 0::BIGINT AS violations UNION ALL SELECT 'put_get', 0
    UNION ALL SELECT 'get_put, complement short of odd orders', (SELECT count(*) * 2 FROM orders WHERE o_orderkey % 2 = 1) + (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey % 2 = 1)""")
def lens_laws(spark, d):
    """Nothing violates the laws; and where the complement lacks orders, all that they held shows up."""
    _checkpoints(spark)
    t = lens.settled(order_tree(spark, d, often=True))
    view, c, _ = ORDER_LENS.get(t)
    view = lens.settled(view)
    a = lens.get_put(ORDER_LENS, t).agg(F.lit("get_put").alias("law"), F.count("*").alias("violations"))
    b = lens.put_get(ORDER_LENS, view, c).agg(F.lit("put_get").alias("law"), F.count("*").alias("violations"))
    short = lens.Complement(c.dropped_nodes.where(f"node_id / {BLOCK} % 2 <> 0"), c.originals, c.arcs, c.fans, c.fingerprint)
    back = lens.differences(t, ORDER_LENS.put(view, short)).agg(F.lit("get_put, complement short of odd orders").alias("law"), F.count("*").alias("violations"))
    return a.unionByName(b).unionByName(back)


@query_of("lens_symmetric", f"{_NODES} SELECT record_id, node_id, CASE anchor WHEN 'lineitem' THEN 'line' ELSE anchor END AS anchor FROM nodes WHERE anchor <> 'orders'")
def lens_symmetric(spark, d):
    """A change on the left side, put into the middle and got on the right."""
    same = Compiled(frozenset(ORDER_TREE.vertices), ORDER_TREE.edges, {v: v for v in ORDER_TREE.vertices})
    both = lens.SymmetricLens(lens.TreeLens(ORDER_TREE, ORDER_TREE, same, valid=True), ORDER_LENS)
    view, c, _ = both.left.get(order_tree(spark, d))
    return both.to_right(view, c).nodes.select("record_id", "node_id", "anchor")


@query_of("lens_complements_merged", f"{_NODES} SELECT record_id, node_id, CASE WHEN status = 'F' THEN 'first' ELSE 'second' END AS name FROM nodes WHERE anchor = 'orders'")
def lens_complements_merged(spark, d):
    """Of two complements the first one's nodes win."""
    _, c, _ = ORDER_LENS.get(order_tree(spark, d))
    named = lambda rows, n: lens.Complement(rows.withColumn("fields", F.col("fields").withField("name", F.lit(n))), c.originals, c.arcs, c.fans, c.fingerprint)
    both = lens.merge_complements(named(c.dropped_nodes.where("fields.status = 'F'"), "first"), named(c.dropped_nodes, "second"))
    return both.dropped_nodes.select("record_id", "node_id", "fields.name")


# Mappings and rewrites -----------------------------------------------------------------------------


@query_of("migration_compose_invert", "SELECT 'there' AS way, c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 'back', s_suppkey, s_name FROM supplier")
def migration_compose_invert(spark, d):
    """Two mappings as one, and one turned round."""
    mk = lambda *vs: SchemaBuilder(OPEN).vertex(vs[0], "table").vertex(vs[1], "table").build()
    a, b, c = mk("customer", "supplier"), mk("client", "vendor"), mk("buyer", "seller")
    f, g = to_migration(a, b, {"customer": "client", "supplier": "vendor"}), to_migration(b, c, {"client": "buyer", "vendor": "seller"})
    there = compile_migration(a, c, compose(f, g))
    data = {"customer": table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), "supplier": table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))}
    moved = relational.restrict(data, there)
    back = relational.restrict(moved, compile_migration(c, a, invert(compose(f, g), a, c)))
    return moved["buyer"].withColumn("way", F.lit("there")).unionByName(back["supplier"].withColumn("way", F.lit("back")))


@query_of("protolens_chain", f"{_NODES} SELECT record_id, node_id, CASE anchor WHEN 'lineitem' THEN 'row' ELSE anchor END AS anchor FROM nodes WHERE anchor IN ('customer', 'orders', 'lineitem')")
def protolens_chain(spark, d):
    """Rewrites of a schema, fused, written and read as JSON, move data as one mapping."""
    chain = Chain((Rewrite("rename_sort", ("lineitem", "line")), Rewrite("rename_sort", ("line", "row")), Rewrite("add_sort", ("note", "string", "n")), Rewrite("add_op", ("orders", "note", "prop", "note"))))
    assert len(chain.fused().steps) == 3
    _, m = Chain.from_json(chain.fused().to_json()).instantiate(ORDER_TREE)
    return tree.restrict(order_tree(spark, d), ORDER_TREE, m, valid=True).tree.nodes.select("record_id", "node_id", "anchor")


@query_of("protolens_from_diff", f"SELECT c AS vertex FROM ({_columns('lineitem', 't.')}) UNION ALL SELECT c FROM ({_columns('orders', 't.')}) WHERE c <> 't.o_orderdate' UNION ALL SELECT 't'")
def protolens_from_diff(spark, d):
    """The difference of two schemas as rewrites leads from one to the other."""
    a, b = _two(spark, d)
    to = from_diff(a, b).target(a)
    assert to.edges == b.edges and to.vertices == b.vertices
    return spark.createDataFrame([(v,) for v in sorted(to.vertices)], "vertex string")


@query_of("protolens_drop_sorts", "SELECT s_suppkey AS record_id, 'supplier' AS anchor, NULL AS value FROM supplier UNION ALL SELECT s_suppkey, 'supplier.s_label', s_name FROM supplier")
def protolens_drop_sorts(spark, d):
    """Columns as trees: one is renamed, the others are dropped, and the chain carries the data."""
    s = table(spark, d, "supplier")
    schema = languages.from_struct(s.schema, "supplier")
    t = records.to_tree(s.select(F.col("s_suppkey").alias("record_id"), F.struct("*").alias("record")), schema, "supplier")
    chain = Chain((Rewrite("rename_sort", ("supplier.s_name", "supplier.s_label")), *(Rewrite("drop_sort", (f"supplier.{c}",)) for c in ("s_suppkey", "s_nationkey", "s_acctbal"))))
    _, m = chain.instantiate(schema)
    return tree.restrict(t, schema, m).tree.nodes.select("record_id", "anchor", "value")


@query_of("lens_steps", "SELECT s_suppkey AS id, s_name || '!' AS s_name, round(s_acctbal) AS cents, s_name || '#' || s_nationkey AS tag FROM supplier")
def lens_steps(spark, d):
    """Steps of a lens document: expressions, nesting, a scope, hoisting, renaming by table, merging, and a lens by name."""
    known = {"close": lens_text.compile_document({"id": "close", "steps": [{"hoist_field": {"host": "box", "field": "cents"}}, {"hoist_field": {"host": "box", "field": "s_name"}}]})}
    doc = {"id": "all", "compose": [
        {"id": "open", "steps": [
            {"merge_sorts": {"sorts": ["s_name", "s_nationkey"], "into": "tag", "expr": 's_name ++ "#" ++ intToStr s_nationkey'}},
            {"compute_field": {"target": "shown", "expr": "tag"}},
            {"add_field": {"name": "s_name", "default": "kept"}},
        ]},
    ]}
    # Merging takes its fields, so the name is kept beside it first.
    df = table(spark, d, "supplier").withColumn("box", F.struct(F.col("s_name"), F.col("s_acctbal").alias("cents"))).withColumnRenamed("s_suppkey", "key")
    steps = [*lens_text.compile_document(doc).transforms, *lens_text.compile_document({"id": "scope", "steps": [{"scoped": {"focus": "box", "inner": [{"apply_expr": {"field": "s_name", "expr": 's_name ++ "!"'}}, {"apply_expr": {"field": "cents", "expr": "round cents"}}]}}, {"remove_field": "s_name"}, {"pullback": {"renames": {"key": "id"}}}]}).transforms, *known["close"].transforms]
    return transforms.select(df, steps).select("id", "s_name", F.col("cents").cast("double").alias("cents"), "tag")


# Edits of trees ---------------------------------------------------------------------------------------


@query_of("tree_edit_moves", """WITH t AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE turn = 3))
    SELECT conv_id AS record_id, 1::BIGINT AS node_id, 0::BIGINT AS parent, 'a=1' AS fields, 'turn' AS anchor FROM t UNION ALL SELECT conv_id, 3, 1, '', 'turn' FROM t UNION ALL SELECT conv_id, 4, 0, '', 'both' FROM t""")
def tree_edit_moves(spark, d):
    """Contraction, moves, fields and joins of nodes, in order: 0 - 1 - 2 - 3 - 4 becomes 0 - 1 - 3 and 0 - 4."""
    nodes, _ = _turns(spark, d)
    some = nodes.where("node_id = 4").select("record_id")
    nodes = nodes.join(some, "record_id", "left_semi").where("node_id < 5").unionByName(some.select("record_id", F.lit(5).cast("long").alias("node_id"), F.lit("turn").alias("anchor"), F.lit("x").alias("value"), F.create_map().cast("map<string,string>").alias("fields")))
    arcs = nodes.where("node_id > 0").select("record_id", (F.col("node_id") - 1).alias("parent"), F.col("node_id").alias("child"), F.lit(0).cast("long").alias("pos"), F.lit("says").alias("kind"), F.lit(None).cast("string").alias("name"))
    log = _log(some, (1, "contract_node", {"node": "2"}), (2, "set_field", {"node": "1", "field": "'a'", "value": "'1'"}), (3, "set_field", {"node": "1", "field": "'b'", "value": "'2'"}), (4, "remove_field", {"node": "1", "field": "'b'"}), (5, "move_subtree", {"node": "4", "parent": "0", "kind": "'says'"}), (6, "move_subtree", {"node": "1", "parent": "3", "kind": "'says'"}), (7, "join_features", {"node": "4", "anchor": "'both'", "joined": "array(5)"}))
    n, a, bad = edits.apply_tree_edits(nodes, arcs, log)
    text = F.array_join(F.transform(F.map_entries("fields"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    out = n.where("node_id > 0").join(a.select("record_id", F.col("child").alias("node_id"), "parent"), ["record_id", "node_id"], "left")
    return out.join(bad.where("reason <> 'CycleDetected'"), "record_id", "left_anti").select("record_id", "node_id", "parent", text.alias("fields"), "anchor")


THREAD = SchemaBuilder(OPEN).vertex("conversation", "object").vertex("turn", "object").edge("conversation", "turn", "starts", None).edge("turn", "turn", "replies", None).build()


@query_of("tree_recursive", """WITH t AS (SELECT conv_id, turn + 1 AS node_id, role FROM conversations), k AS (SELECT * FROM t WHERE role <> 'assistant')
    SELECT conv_id AS record_id, node_id AS child, coalesce((SELECT max(b.node_id) FROM k b WHERE b.conv_id = k.conv_id AND b.node_id < k.node_id), 0) AS parent FROM k""")
def tree_recursive(spark, d):
    """A recursive schema: in a thread of replies those of the assistant are contracted, however many follow each other."""
    _checkpoints(spark)
    nodes, _ = _turns(spark, d)
    nodes = nodes.withColumn("fields", F.struct(F.col("value").alias("role")))
    arcs = nodes.where("node_id > 0").select("record_id", (F.col("node_id") - 1).alias("parent"), F.col("node_id").alias("child"), F.lit(0).cast("long").alias("pos"), F.when(F.col("node_id") == 1, "starts").otherwise("replies").alias("kind"), F.lit(None).cast("string").alias("name"))
    edges = THREAD.edges | {Edge("conversation", "turn", "starts", None)}
    m = Compiled(frozenset(THREAD.vertices), frozenset(edges), {v: v for v in THREAD.vertices}).with_survival("turn", 'role /= "assistant"')
    return tree.restrict(tree.Tree(nodes, arcs), THREAD, m).tree.arcs.select("record_id", "child", "parent")


# Languages, codecs and the interpreter -----------------------------------------------------------------


@query_of("language_avro", "SELECT column_name AS name, CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' ELSE 'string' END AS type FROM (DESCRIBE part)")
def language_avro(spark, d):
    """A table's schema written as Avro and read again has the table's types."""
    again = languages.read_avro(json.dumps(languages.write_avro(_schema(table(spark, d, "part"), "part", "record"), "part")))
    root = again.roots()[0]
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in again.struct(root).fields], "name string, type string")


@query_of("language_sql", "SELECT column_name AS name, CASE column_type WHEN 'BIGINT' THEN 'int64' WHEN 'INTEGER' THEN 'int32' WHEN 'DOUBLE' THEN 'float64' ELSE 'string' END AS kind FROM (DESCRIBE customer)")
def language_sql(spark, d):
    """A table's schema written as SQL and read again."""
    again = languages.read_sql(languages.write_sql(_schema(table(spark, d, "customer"), "customer", "table")))
    return spark.createDataFrame([(e.label, again.vertices[e.tgt]) for e in again.outgoing("customer")], "name string, kind string")


@query_of("codec_roundtrip", "SELECT form, json_extract_string(props, '$.k')::BIGINT AS k, count(*) AS n FROM events, (VALUES ('json'), ('yaml')) v(form) GROUP BY ALL")
def codec_roundtrip(spark, d):
    """The same records through the codecs of two formats."""
    s = SchemaBuilder(OPEN).vertex("r", "object").vertex("r.k", "integer").edge("r", "r.k", "prop", "k").build()
    e, codecs = table(spark, d, "events").select(F.col("props").alias("value")), Registry()
    yaml = e.select(F.concat(F.lit("k: "), F.get_json_object("value", "$.k")).alias("value"))
    parts = [codecs.parse(form, texts, s, "r").select(F.lit(form).alias("form"), "record.k") for form, texts in (("json", e), ("yaml", yaml))]
    return parts[0].unionByName(parts[1]).groupBy("form", "k").agg(F.count("*").alias("n"))


@query_of("fn_interpreted", "SELECT p_partkey, p_size * (p_size + 1) // 2 + strlen(p_name) AS total FROM part")
def fn_interpreted(spark, d):
    """Functions as values, which columns cannot hold: the interpreter, a batch of rows at a time."""
    e = parse("let twice = \\f x -> f (f x) in fold (map [1 .. p_size] (\\x -> twice (\\y -> y) x)) (len p_name) (\\a x -> a + x)")
    return spread(table(spark, d, "part").select("p_partkey", "p_size", "p_name")).select("p_partkey", interpreted(e, ["p_size", "p_name"], "long").alias("total"))


@query_of("fn_printed", "SELECT o_orderkey, CASE WHEN o_totalprice > 1000 AND o_orderstatus = 'F' THEN upper(o_orderpriority) ELSE 'x' END AS a, (o_custkey + 2) * 3 - 1 AS b FROM orders")
def fn_printed(spark, d):
    """Expressions printed and parsed again mean the same."""
    texts = {"a": 'if o_totalprice > 1000.0 && o_orderstatus == "F" then upper o_orderpriority else "x"', "b": "(o_custkey + 2) * 3 - 1"}
    return expressions(table(spark, d, "orders"), ["o_orderkey"], **{n: pretty(parse(t)) for n, t in texts.items()})


@query_of("fn_failures", """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN p_size = 0 OR p_size * 400 > 10000 AND p_size % 7 = 0 THEN 'NoValue' WHEN p_size * 400 > 10000 THEN 'ListLimitExceeded' END AS reason FROM part) GROUP BY reason""")
def fn_failures(spark, d):
    """Lists beyond the limit are told apart from what has no value at all."""
    p = table(spark, d, "part")
    e = parse("length (map [1 .. p_size * 400] (\\x -> x)) / (if p_size * 400 > 10000 && p_size % 7 == 0 then 0 else p_size)")
    return p.select(failure(e, env_of(p.schema)).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query_of("fn_values", "SELECT n_nationkey, n_name || '|' || n_name AS joined, 2::BIGINT AS n FROM nation")
def fn_values(spark, d):
    return expressions(table(spark, d, "nation"), ["n_nationkey"], joined='join (values {a = n_name, b = n_name}) "|"', n="length (values {a = n_name, b = n_name})")


@query_of("theory_equation", "SELECT l_orderkey AS a, l_linenumber AS b FROM lineitem WHERE l_extendedprice * (1 - l_discount) <> l_extendedprice")
def theory_equation(spark, d):
    """Rows of a model that break an equation."""
    df = table(spark, d, "lineitem")
    env = env_of(df.schema)
    left, right = (compile_expr(parse(t), env).checked for t in ("l_extendedprice * (1.0 - l_discount)", "l_extendedprice"))
    return check_equation(df, {"a": "l_orderkey", "b": "l_linenumber"}, left, right, limit=None)


# Streams ----------------------------------------------------------------------------------------------


@query_of("stream_table_edits", """WITH log AS (SELECT event_id, user_id, event_type, value FROM events WHERE event_type IN ('signup', 'purchase', 'error')),
    per AS (SELECT *, coalesce(max(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id), -1) AS last_error FROM log),
    live AS (SELECT user_id, min(CASE WHEN event_type = 'signup' THEN event_id END) AS born FROM per WHERE event_id > last_error GROUP BY user_id)
    SELECT l.user_id, arg_max(p.value, p.event_id) AS value FROM live l JOIN per p ON p.user_id = l.user_id AND p.event_id >= l.born
    WHERE p.event_type = 'purchase' OR p.event_id = l.born GROUP BY l.user_id""")
def stream_table_edits(spark, d):
    """The edit log as a stream of files, read in several batches with a restart between, gives what one batch gives."""
    e = table(spark, d, "events").where(F.col("event_type").isin("signup", "purchase", "error"))
    op = F.when(F.col("event_type") == "signup", "insert").when(F.col("event_type") == "purchase", "update").otherwise("delete")
    log = e.select(F.col("event_id").alias("seq"), op.alias("op"), "user_id", "value")
    files, state, done = (new_folder(spark, n) for n in ("log", "edited", "done"))
    top = e.agg(F.max("event_id")).first()[0] or 0
    for i in range(2):
        third = (F.col("seq") > top * i // 2 - (i == 0)) & (F.col("seq") <= top * (i + 1) // 2)
        log.where(third).coalesce(1).write.mode("append").parquet(files)
        stream = spark.readStream.schema(log.schema).parquet(files)
        target = streams.EditedTable(spark, state, "user_id", schema="user_id long, value double", buckets=8)
        target.follow(stream, done).awaitTermination()
    return target.read()


@query_of("stream_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = streams.windowed_counts(e, "ts", ["event_type"], "1 day", "1 hour")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query_of("stream_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = streams.sessions(e, "ts", ["user_id"], "6 hours", "1 hour")
    return out.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


__all__ = ["BOUGHT", "CONTRACT", "_LINES"]
