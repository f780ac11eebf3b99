"""The registered queries: every operator applied to the driver's tables, each with the SQL that says what it must give."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import compile_expr, env_of, parse, predicate
from .operators import edit_lens, edits, fibers, graph, lens, merge, query, relational, transforms, tree
from .plans import compare, hom, lens_text
from .plans.migration import Compiled, Migration, compile_migration
from .schema import OPEN, Edge, Schema, SchemaBuilder
from .sources import languages, records
from .storage import new_folder, shared_dir, written
from .theory import Morphism
from .versioning import Repository

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
FLAGSHIP = "delta_rename"


def query_of(name: str, sql: str | None = None):
    """Register a query under ``name``, with its SQL."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: table(spark, sf_dir, n) for n in names}


def expressions(df: DataFrame, keep: list[str], **texts: str) -> DataFrame:
    """Columns computed by expressions, null where they have no value."""
    env = env_of(df.schema)
    return df.select(*keep, *[compile_expr(parse(t), env).checked.alias(n) for n, t in texts.items()])


# Restriction, extension and products of tables -------------------------------------------------

#: Expressions order floats as their reference does, -0.0 before 0.0; to SQL the two are equal. Added to 0.0, -0.0 is 0.0.
CLIENT = Compiled(
    frozenset({"client"}), frozenset(), {"customer": "client"},
    transforms={"client": [("rename", "c_custkey", "id"), ("rename", "c_name", "name"), ("compute", "band", "if c_acctbal + 0.0 < 0.0 then \"debt\" else if c_acctbal < 5000.0 then \"low\" else \"high\""), ("keep", ("id", "name", "c_mktsegment", "band"))]},
)


@query_of("delta_rename", """SELECT c_custkey AS id, c_name AS name, c_mktsegment,
    CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS band FROM customer""")
def delta_rename(spark, d):
    return relational.restrict(tables(spark, d, "customer"), CLIENT, apply_transforms=True)["client"].select("id", "name", "c_mktsegment", "band")


def _party(spark, d):
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    return {
        "customer": transforms.select(c, [("rename", "c_name", "name"), ("rename", "c_nationkey", "nation"), ("rename", "c_acctbal", "balance"), ("rename", "c_mktsegment", "segment"), ("keep", ("name", "nation", "balance", "segment"))]),
        "supplier": transforms.select(s, [("rename", "s_name", "name"), ("rename", "s_nationkey", "nation"), ("rename", "s_acctbal", "balance"), ("keep", ("name", "nation", "balance"))]),
    }


PARTY = Compiled(frozenset({"party"}), frozenset(), {"customer": "party", "supplier": "party"})
_PARTY_SQL = """SELECT c_name AS name, CAST(c_nationkey AS BIGINT) AS nation, c_acctbal AS balance, c_mktsegment AS segment FROM customer
    UNION ALL SELECT s_name, s_nationkey, s_acctbal, NULL FROM supplier"""


@query_of("delta_many_to_one", _PARTY_SQL)
def delta_many_to_one(spark, d):
    return relational.restrict(_party(spark, d), PARTY)["party"]


@query_of("sigma_union", f"""SELECT 'party' AS target, name, nation, balance, segment FROM ({_PARTY_SQL}) UNION ALL SELECT 'place', r_name, NULL, NULL, NULL FROM region""")
def sigma_union(spark, d):
    """Every table goes somewhere: an unmapped one stays, and a target that nothing maps to is empty."""
    m = Compiled(frozenset({"party", "empty"}), frozenset(), {"customer": "party", "supplier": "party", "region": "place"})
    out = relational.extend({**_party(spark, d), "region": table(spark, d, "region").select(F.col("r_name").alias("name"))}, m)
    targets = [out[t].withColumn("target", F.lit(t)) for t in ("party", "place", "empty")]
    return relational.union_all(targets).select("target", "name", "nation", "balance", "segment")


@query_of("pi_product", "SELECT n_nationkey, n_name, n_regionkey, r_regionkey, r_name FROM nation, region")
def pi_product(spark, d):
    m = Compiled(frozenset({"place"}), frozenset(), {"region": "place", "nation": "place"})
    return relational.product(tables(spark, d, "region", "nation"), m)["place"]


@query_of("pi_column_clash", "SELECT b.r_regionkey, b.r_name, n_nationkey FROM (SELECT n_nationkey FROM nation) a, region b")
def pi_column_clash(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", F.lit("lost").alias("r_name"))
    m = Compiled(frozenset({"t"}), frozenset(), {"a": "t", "b": "t"})
    return relational.product({"a": n, "b": table(spark, d, "region")}, m)["t"]


@query_of("chase_required", """SELECT r_regionkey, r_name FROM region
    UNION ALL SELECT 99, NULL WHERE EXISTS (SELECT 1 FROM nation WHERE n_regionkey = 1) AND NOT EXISTS (SELECT 1 FROM region WHERE r_regionkey = 99)
    UNION ALL SELECT 100, 'chained' WHERE EXISTS (SELECT 1 FROM nation WHERE n_regionkey = 1)""")
def chase_required(spark, d):
    rules = [("nation", {"n_regionkey": 1}, "region", {"r_regionkey": 99}), ("region", {"r_regionkey": 99}, "region", {"r_regionkey": 100, "r_name": "chained"}), ("nation", {"n_regionkey": -5}, "region", {"r_regionkey": 7})]
    return relational.chase(tables(spark, d, "region", "nation"), rules)["region"]


@query_of("dangling_keys", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)")
def dangling_keys(spark, d):
    t = tables(spark, d, "orders", "customer")
    return relational.dangling(t["orders"], t["customer"].where("c_acctbal >= 0"), "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


_LINE_ORDER = ["l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_shipdate"]


@query_of("row_ordinals", f"SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (ORDER BY {', '.join(_LINE_ORDER)}) - 1 AS ordinal FROM lineitem")
def row_ordinals(spark, d):
    return relational.ordinals(table(spark, d, "lineitem"), *_LINE_ORDER).select("l_orderkey", "l_linenumber", "l_extendedprice", "ordinal")


@query_of("coverage", """SELECT count(*) AS total, count(*) FILTER (ok) AS successful, count(*) FILTER (NOT ok) AS failed,
    count(*) FILTER (NOT a) AS failed_positive, count(*) FILTER (NOT b) AS failed_cheap, count(*) FILTER (ok) / count(*) AS ratio
    FROM (SELECT c_acctbal > 0 AS a, c_acctbal <= 9000 AS b, c_acctbal > 0 AND c_acctbal <= 9000 AS ok FROM customer)""")
def coverage(spark, d):
    return relational.coverage(table(spark, d, "customer"), {"positive": F.col("c_acctbal") > 0, "cheap": F.col("c_acctbal") <= 9000})


# Field transforms --------------------------------------------------------------------------------


@query_of("field_rename_drop_add", "SELECT p_partkey AS part_id, p_name, p_brand, p_size, p_retailprice, 'new' AS origin FROM part")
def field_rename_drop_add(spark, d):
    return transforms.select(table(spark, d, "part"), [("rename", "p_partkey", "part_id"), ("drop", "p_type"), ("add", "origin", "new"), ("add", "p_brand", "kept")])


@query_of("field_apply_compute", """SELECT l_orderkey, upper(l_returnflag) AS l_returnflag, CAST(l_linenumber AS BIGINT) AS l_linenumber,
    l_extendedprice * (1.0 - l_discount) AS net FROM lineitem""")
def field_apply_compute(spark, d):
    return transforms.select(table(spark, d, "lineitem"), [("apply", "l_returnflag", "upper l_returnflag", "lower l_returnflag"), ("apply", "l_linenumber", "split l_linenumber \",\"", None), ("compute", "net", "attrs.l_extendedprice * (1.0 - l_discount)"), ("compute", "l_tax", "1 / 0"), ("keep", ("l_orderkey", "l_returnflag", "l_linenumber", "net"))])


@query_of("field_case", """SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'big' WHEN o_orderpriority LIKE '%URGENT%' THEN 'urgent' ELSE o_orderstatus END AS o_orderstatus,
    CASE WHEN o_totalprice > 300000 THEN 1 END AS flag FROM orders""")
def field_case(spark, d):
    steps = [("case", (("o_totalprice > 300000.0", (("compute", "o_orderstatus", '"big"'), ("compute", "flag", "1"))), ('contains o_orderpriority "URGENT"', (("compute", "o_orderstatus", '"urgent"'),)))), ("keep", ("o_orderkey", "o_orderstatus", "flag"))]
    return transforms.select(table(spark, d, "orders"), steps)


@query_of("field_references", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'P' THEN NULL ELSE o_orderstatus END AS o_orderstatus FROM orders")
def field_references(spark, d):
    return transforms.select(table(spark, d, "orders"), [("references", "o_orderstatus", {"F": "finished", "P": None}), ("keep", ("o_orderkey", "o_orderstatus"))])


@query_of("field_nest_hoist_path", "SELECT s_suppkey, s_name, upper(s_name) AS shout, CAST(s_nationkey AS BIGINT) AS nation FROM supplier")
def field_nest_hoist_path(spark, d):
    steps = [("nest", ("s_name", "s_nationkey", "s_acctbal"), "info"), ("path", ("info",), ("rename", "s_nationkey", "nation")), ("scoped", "info", (("compute", "shout", "upper s_name"), ("drop", "s_acctbal"))), ("hoist", "info", "s_name"), ("hoist", "info", "nation"), ("hoist", "info", "shout")]
    return transforms.select(table(spark, d, "supplier"), steps).select("s_suppkey", "s_name", "shout", "nation")


@query_of("field_scoped_list", """SELECT o_custkey, list_aggregate(list_transform(list(o_totalprice), lambda x: x * 2.0), 'max') AS top, count(*) AS n FROM orders GROUP BY o_custkey""")
def field_scoped_list(spark, d):
    df = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct(F.col("o_totalprice").alias("price"), "o_orderstatus")).alias("orders"))
    out = transforms.select(df, [("scoped", "orders", (("apply", "price", "price * 2.0", "price / 2.0"), ("drop", "o_orderstatus")))])
    return out.select("o_custkey", F.array_max("orders.price").alias("top"), F.size("orders").cast("bigint").alias("n"))


@query_of("field_pullback_combine", "SELECT n_nationkey AS key, n_name || '@' || CAST(n_regionkey AS VARCHAR) AS place FROM nation")
def field_pullback_combine(spark, d):
    return transforms.select(table(spark, d, "nation"), [("pullback", {"n_nationkey": "key", "n_name": "name"}), ("combine", ("name", "n_regionkey"), "place", 'name ++ "@" ++ intToStr n_regionkey')]).select(F.col("key").cast("int").alias("key"), "place")


@query_of("survival_filter", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 150000 AND contains(o_orderpriority, 'URGENT')")
def survival_filter(spark, d):
    df = table(spark, d, "orders")
    return df.where(predicate(parse('o_totalprice > 150000.0 && contains o_orderpriority "URGENT"'), env_of(df.schema))).select("o_orderkey", "o_totalprice")


@query_of("predicate_without_value", "SELECT o_orderkey, o_custkey % 3 <> 0 AND 10 // nullif(o_custkey % 3, 0) > 5 AS kept_by_query, NOT (o_custkey % 3 <> 0 AND 10 // nullif(o_custkey % 3, 0) <= 5) AS kept_by_survival FROM orders")
def predicate_without_value(spark, d):
    df = table(spark, d, "orders")
    e, env = parse("10 / (o_custkey % 3) > 5"), env_of(df.schema)
    return df.select("o_orderkey", predicate(e, env).alias("kept_by_query"), predicate(e, env, otherwise=True).alias("kept_by_survival"))


# The expression language ------------------------------------------------------------------------


@query_of("fn_arithmetic", """SELECT l_orderkey, l_linenumber, l_orderkey + l_linenumber AS a, l_partkey - 7 AS b, l_linenumber * 3 AS c, -l_linenumber AS neg, abs(l_linenumber - 4) AS ab,
    CAST(trunc((l_partkey - 500) / 7) AS BIGINT) AS quot, CASE WHEN l_linenumber = 4 THEN NULL ELSE CAST(trunc(l_partkey / (l_linenumber - 4)) AS BIGINT) END AS by_zero, (l_partkey - 500) % 7 AS rem, l_quantity * 2 AS mixed, l_extendedprice / l_quantity AS real FROM lineitem""")
def fn_arithmetic(spark, d):
    return expressions(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], a="l_orderkey + l_linenumber", b="l_partkey - 7", c="l_linenumber * 3", neg="-l_linenumber", ab="abs (l_linenumber - 4)", quot="(l_partkey - 500) / 7", by_zero="l_partkey / (l_linenumber - 4)", rem="(l_partkey - 500) % 7", mixed="l_quantity * 2", real="l_extendedprice / l_quantity")


@query_of("fn_rounding", """SELECT l_orderkey, l_linenumber, CAST(floor(x) AS BIGINT) AS f, CAST(ceil(x) AS BIGINT) AS c, CAST(round(x) AS BIGINT) AS r, CAST(trunc(x) AS BIGINT) AS t
    FROM (SELECT *, (l_quantity - 25.0) / 2.0 AS x FROM lineitem)""")
def fn_rounding(spark, d):
    x = "((l_quantity - 25.0) / 2.0)"
    return expressions(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], f=f"floor {x}", c=f"ceil {x}", r=f"round {x}", t=f"floatToInt {x}")


@query_of("fn_compare_logic", """SELECT o_orderkey, o_orderstatus = 'F' AS eq, o_orderstatus <> 'F' AS neq, o_orderkey < 100 AS lt, o_totalprice <= 50000 AS lte, o_orderpriority > '3' AS gt, o_custkey >= 10 AS gte,
    o_orderkey < 100 AND o_orderstatus = 'F' AS both_, o_orderkey < 100 OR o_orderstatus = 'F' AS either, NOT (o_orderstatus = 'F') AS no, false AS int_is_no_float FROM orders""")
def fn_compare_logic(spark, d):
    return expressions(table(spark, d, "orders"), ["o_orderkey"], eq='o_orderstatus == "F"', neq='o_orderstatus /= "F"', lt="o_orderkey < 100", lte="o_totalprice <= 50000", gt='o_orderpriority > "3"', gte="o_custkey >= 10", both_='o_orderkey < 100 && o_orderstatus == "F"', either='o_orderkey < 100 || o_orderstatus == "F"', no='not (o_orderstatus == "F")', int_is_no_float="1 == 1.0")


@query_of("fn_strings", """SELECT p_partkey, p_name || '/' || p_brand AS cat, CAST(strlen(p_name) AS BIGINT) AS bytes, substr(p_name, 2, 4) AS mid, upper(p_type) AS up, lower(p_brand) AS low, p_name AS trimmed,
    split_part(p_name, ' ', 1) AS first, array_to_string(string_split(p_name, ' '), '-') AS dashed, replace(p_name, 'a', 'AA') AS rep, contains(p_name, 'e') AS has, left(p_type, 5) AS cut, CAST(len(string_split(p_name, ' ')) AS BIGINT) AS words FROM part""")
def fn_strings(spark, d):
    return expressions(table(spark, d, "part"), ["p_partkey"], cat='p_name ++ "/" ++ p_brand', bytes="len p_name", mid="slice p_name 1 5", up="upper p_type", low="lower p_brand", trimmed='trim ("  " ++ p_name ++ "\\t")', first='head (split p_name " ")', dashed='join (split p_name " ") "-"', rep='replace p_name "a" "AA"', has='contains p_name "e"', cut="truncateStr p_type 5", words='length (split p_name " ")')


@query_of("fn_unicode", "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS bytes, substr(text, 11, 20) AS mid, upper(replace(text, 'ß', 'SS')) AS up FROM documents")
def fn_unicode(spark, d):
    return expressions(table(spark, d, "documents"), ["doc_id"], bytes="len text", mid="slice text 10 30", up="upper text")


@query_of("fn_lists", """SELECT o_custkey, list_sort(list_transform(list(o_orderkey), lambda x: x + 1)) AS mapped, list_sort(list_filter(list(o_orderkey), lambda x: x % 2 = 0)) AS evens, CAST(sum(o_orderkey) AS BIGINT) AS total,
    count(*) AS n, CAST(min(o_orderkey) AS BIGINT) AS head, CAST(count(*) * 2 AS BIGINT) AS doubled FROM orders GROUP BY o_custkey""")
def fn_lists(spark, d):
    df = table(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("keys"))
    return expressions(df, ["o_custkey"], mapped="map keys (\\x -> x + 1)", evens="filter keys (\\x -> x % 2 == 0)", total="fold keys 0 (\\a x -> a + x)", n="length keys", head="head keys", doubled="length (flat_map keys (\\x -> [x, x]))")


@query_of("fn_list_shapes", """SELECT n_regionkey, list_append(l, CAST(-1 AS BIGINT)) AS app, l[2:] AS tl, list_reverse(l) AS rev, l[2] AS second, l[-1] AS last, list_transform(list_filter(l, lambda x: x > 3), lambda x: x * x) AS comp, range(1, 4) AS rng
    FROM (SELECT n_regionkey, list_sort(list(CAST(n_nationkey AS BIGINT))) AS l FROM nation GROUP BY n_regionkey)""")
def fn_list_shapes(spark, d):
    df = table(spark, d, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.col("n_nationkey").cast("bigint"))).alias("l"))
    out = expressions(df, ["n_regionkey"], app="append l (-1)", tl="tail l", rev="reverse l", comp="[x * x | x <- l, x > 3]", rng="[1 .. 3]")
    extra = df.select("n_regionkey", compile_expr(("index", ("var", "l"), ("lit", 1)), env_of(df.schema)).checked.alias("second"), compile_expr(("index", ("var", "l"), ("lit", -1)), env_of(df.schema)).checked.alias("last"))
    return out.join(extra, "n_regionkey")


@query_of("fn_records", """SELECT n_nationkey, n_name AS a, CAST(n_regionkey AS BIGINT) AS b, 'n,r,x' AS keys, true AS has, false AS hasnt, n_name || '!' AS field FROM nation""")
def fn_records(spark, d):
    r = "(merge {n = n_name, r = 0} {r = n_regionkey, x = 1})"
    return expressions(table(spark, d, "nation"), ["n_nationkey"], a=f"{r}.n", b=f"{r}.r", keys=f'join (keys {r}) ","', has=f'hasField {r} "x"', hasnt=f'hasField {r} "y"', field="let q = {v = n_name} in q.v ++ \"!\"")


@query_of("fn_coercions", """SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS i2f, CAST(trunc(o_totalprice) AS BIGINT) AS f2i, CAST(o_custkey AS VARCHAR) AS i2s, CAST(o_custkey AS VARCHAR) AS f2s, TRY_CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS s2i, NULL::BIGINT AS bad,
    CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS s2f, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders""")
def fn_coercions(spark, d):
    return expressions(table(spark, d, "orders"), ["o_orderkey"], i2f="intToFloat o_custkey", f2i="floatToInt o_totalprice", i2s="intToStr o_custkey", f2s="floatToStr (intToFloat o_custkey)", s2i="strToInt (slice o_orderpriority 0 1)", bad="strToInt (slice o_orderpriority 0 3)", s2f="strToFloat (slice o_orderpriority 0 1)", cents="round (o_totalprice * 100.0)")


@query_of("fn_utility_inspect", """SELECT c_custkey, least(greatest(c_acctbal, 0.0), 5000.0) AS clamped, c_name AS dflt, 'z' AS dflt_null, 'string' AS t1, 'int' AS t2, 'float' AS t3, 'list' AS t4, 'record' AS t5, 'null' AS t6, false AS isnull, true AS islist FROM customer""")
def fn_utility_inspect(spark, d):
    return expressions(table(spark, d, "customer"), ["c_custkey"], clamped="clamp c_acctbal 0.0 5000.0", dflt='default c_name "x"', dflt_null='default Null "z"', t1="typeOf c_name", t2="typeOf c_custkey", t3="typeOf c_acctbal", t4="typeOf [1]", t5="typeOf {a = 1}", t6="typeOf Null", isnull="isNull c_name", islist="isList [c_name]")


@query_of("fn_match_let", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE '?' || o_orderstatus END AS m, CASE WHEN o_orderstatus = 'F' THEN 1 END AS partial, (o_custkey + 1) * (o_custkey + 1) AS sq, CASE WHEN o_custkey % 2 = 0 THEN 'even' ELSE 'odd' END AS parity FROM orders""")
def fn_match_let(spark, d):
    return expressions(table(spark, d, "orders"), ["o_orderkey"], m='case o_orderstatus of { "F" -> "done"; "O" -> "open"; s -> "?" ++ s }', partial='case o_orderstatus of { "F" -> 1 }', sq="let x = o_custkey + 1 in (\\y -> y * y) x", parity='parity (o_custkey % 2) where parity n = if n == 0 then "even" else "odd"')


# Trees ------------------------------------------------------------------------------------------

ORDER_TREE = (
    SchemaBuilder(OPEN).vertex("customer", "object").vertex("orders", "object").vertex("lineitem", "object")
    .edge("customer", "orders", "places", "orders").edge("orders", "lineitem", "holds", "items").build()
)
#: Lines of an order get numbers below this within their order's block of node ids.
BLOCK = 1000


def order_tree(spark, d, often: bool = False) -> tree.Tree:
    """Customers with their orders and lines: node 0 is the customer, an order has a block of ids, its lines follow it.

    ``often``: the numbered lines are written once, for queries that read the tree many times; each reading sorts all lines otherwise.
    """
    c, o, li = (table(spark, d, t) for t in ("customer", "orders", "lineitem"))
    block = (F.col("o_orderkey") + 1) * BLOCK
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    lines = li.withColumn("n", F.row_number().over(w)).join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    if often:
        lines = written(lines.select("o_orderkey", "o_custkey", "n", "l_extendedprice", "l_returnflag"), "lines")

    def fields(name=None, price=None, status=None):
        none = {"name": "string", "price": "double", "status": "string"}
        given = {"name": name, "price": price, "status": status}
        return F.struct(*[(F.lit(None).cast(t) if given[n] is None else F.col(given[n]).cast(t)).alias(n) for n, t in none.items()]).alias("fields")

    nodes = c.select(F.col("c_custkey").alias("record_id"), F.lit(0).cast("bigint").alias("node_id"), F.lit("customer").alias("anchor"), fields("c_name", "c_acctbal", "c_mktsegment"))
    nodes = nodes.unionByName(o.select(F.col("o_custkey").alias("record_id"), block.alias("node_id"), F.lit("orders").alias("anchor"), fields("o_orderpriority", "o_totalprice", "o_orderstatus")))
    nodes = nodes.unionByName(lines.select(F.col("o_custkey").alias("record_id"), (block + F.col("n")).alias("node_id"), F.lit("lineitem").alias("anchor"), fields(None, "l_extendedprice", "l_returnflag")))
    arcs = o.select(F.col("o_custkey").alias("record_id"), F.lit(0).cast("bigint").alias("parent"), block.alias("child"), F.col("o_orderkey").alias("pos"), F.lit("places").alias("kind"), F.lit("orders").alias("name"))
    arcs = arcs.unionByName(lines.select(F.col("o_custkey").alias("record_id"), block.alias("parent"), (block + F.col("n")).alias("child"), F.col("n").cast("bigint").alias("pos"), F.lit("holds").alias("kind"), F.lit("items").alias("name")))
    return tree.Tree(nodes, arcs)


_LINES = f"""lines AS (SELECT *, (o_orderkey + 1) * {BLOCK} AS parent, (o_orderkey + 1) * {BLOCK} + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS node_id
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_NODES = f"""WITH {_LINES}, nodes AS (
    SELECT c_custkey AS record_id, 0::BIGINT AS node_id, 'customer' AS anchor, c_name AS name, c_acctbal AS price, c_mktsegment AS status FROM customer
    UNION ALL SELECT o_custkey, (o_orderkey + 1) * {BLOCK}, 'orders', o_orderpriority, o_totalprice, o_orderstatus FROM orders
    UNION ALL SELECT o_custkey, node_id, 'lineitem', NULL, l_extendedprice, l_returnflag FROM lines)"""


@query_of("query_anchor", f"{_NODES} SELECT * FROM nodes WHERE anchor = 'orders'")
def query_anchor(spark, d):
    return query.execute(order_tree(spark, d), query.InstanceQuery("orders"))


@query_of("query_path", f"{_NODES} SELECT record_id, node_id, anchor, price FROM nodes WHERE anchor = 'lineitem' AND price > 90000")
def query_path(spark, d):
    return query.execute(order_tree(spark, d), query.InstanceQuery("customer", ("places", "holds"), "price > 90000.0", None, ("price", "missing")))


@query_of("query_children_count", f"""{_NODES} SELECT record_id, node_id, anchor, name, price, status FROM nodes JOIN (SELECT parent, count(*) AS n FROM lines GROUP BY parent) k ON k.parent = node_id
    WHERE anchor = 'orders' AND k.n > 5 AND status = 'F'""")
def query_children_count(spark, d):
    return query.execute(order_tree(spark, d), query.InstanceQuery("orders", (), '_children_count > 5 && attrs.status == "F"'))


@query_of("query_limit_project", f"{_NODES} SELECT record_id, node_id, anchor, status FROM nodes WHERE anchor = 'orders' AND price > 100000 ORDER BY record_id, node_id LIMIT 25")
def query_limit_project(spark, d):
    return query.execute(order_tree(spark, d), query.InstanceQuery("orders", (), "price > 100000.0", 25, ("status",), "status"))


@query_of("query_graph_operations", f"""{_NODES} SELECT record_id, node_id, anchor, price FROM nodes WHERE anchor = 'orders' AND node_id IN (SELECT parent FROM lines)
    AND (SELECT first(l_returnflag ORDER BY l.node_id) FROM lines l WHERE l.parent = nodes.node_id) = 'R'""")
def query_graph_operations(spark, d):
    return query.execute(order_tree(spark, d), query.InstanceQuery("orders", (), 'hasEdge self "holds" && edgeCount self > 0 && self->holds.status == "R" && anchor self == "orders"', None, ("price",)))


@query_of("query_group_agg", f"{_NODES} SELECT status, count(*) AS n, max(price) AS top FROM nodes WHERE anchor = 'orders' GROUP BY status")
def query_group_agg(spark, d):
    return query.group_agg(query.execute(order_tree(spark, d), query.InstanceQuery("orders")), ["status"], n=F.count("*"), top=F.max("price"))


CONTRACT = Compiled(frozenset({"customer", "line"}), frozenset({Edge("customer", "line", "bought", "lines")}), {"customer": "customer", "lineitem": "line"})


@query_of("tree_restrict_nodes", f"{_NODES} SELECT record_id, node_id, CASE anchor WHEN 'lineitem' THEN 'line' ELSE anchor END AS anchor, price FROM nodes WHERE anchor <> 'orders'")
def tree_restrict_nodes(spark, d):
    return tree.restrict(order_tree(spark, d), ORDER_TREE, CONTRACT, valid=True).tree.nodes.select("record_id", "node_id", "anchor", "fields.price")


@query_of("tree_restrict_arcs", f"WITH {_LINES} SELECT o_custkey AS record_id, 0::BIGINT AS parent, node_id AS child, 'bought' AS kind, 'lines' AS name FROM lines")
def tree_restrict_arcs(spark, d):
    return tree.restrict(order_tree(spark, d), ORDER_TREE, CONTRACT, valid=True).tree.arcs.select("record_id", "parent", "child", "kind", "name")


@query_of("tree_restrict_predicate", f"""WITH {_LINES} SELECT o_custkey AS record_id, CASE WHEN o_orderstatus = 'F' THEN parent ELSE 0 END AS parent, node_id AS child FROM lines
    UNION ALL SELECT o_custkey, 0, (o_orderkey + 1) * {BLOCK} FROM orders WHERE o_orderstatus = 'F'""")
def tree_restrict_predicate(spark, d):
    edges = frozenset({Edge("customer", "orders", "places", "orders"), Edge("orders", "lineitem", "holds", "items"), Edge("customer", "lineitem", "bought", "lines")})
    m = Compiled(frozenset(ORDER_TREE.vertices), edges, {v: v for v in ORDER_TREE.vertices}).with_survival("orders", 'status == "F"')
    return tree.restrict(order_tree(spark, d, often=True), ORDER_TREE, m).tree.arcs.select("record_id", "parent", "child")


@query_of("tree_restrict_errors", f"SELECT c_custkey AS record_id, 'RootPruned' AS reason FROM customer WHERE c_acctbal < 0 UNION SELECT o_custkey, 'NoEdgeFound' FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey WHERE c_acctbal >= 0")
def tree_restrict_errors(spark, d):
    m = Compiled(frozenset({"customer", "lineitem"}), frozenset(), {"customer": "customer", "lineitem": "lineitem"}).with_survival("customer", "price + 0.0 >= 0.0")  # -0.0 counts as 0.0, as for CLIENT
    return tree.restrict(order_tree(spark, d, often=True), ORDER_TREE, m).errors


@query_of("tree_complement", f"SELECT o_custkey AS record_id, (o_orderkey + 1) * {BLOCK} AS node_id, 'orders' AS anchor, 0::BIGINT AS contracted_into FROM orders")
def tree_complement(spark, d):
    return tree.restrict(order_tree(spark, d), ORDER_TREE, CONTRACT, valid=True).dropped_nodes.select("record_id", "node_id", "anchor", "contracted_into")


@query_of("tree_transforms", f"{_NODES} SELECT record_id, node_id, name AS label, price / 2 AS half FROM nodes WHERE anchor = 'orders'")
def tree_transforms(spark, d):
    m = Compiled(frozenset(ORDER_TREE.vertices), ORDER_TREE.edges, {v: v for v in ORDER_TREE.vertices}).with_transforms("orders", ("rename", "name", "label"), ("compute", "half", "price / 2.0"))
    out = tree.restrict(order_tree(spark, d, often=True), ORDER_TREE, m).tree.nodes.where("anchor = 'orders'")
    return out.select("record_id", "node_id", "fields.label", "fields.half")


@query_of("tree_extend", f"WITH {_LINES} SELECT o_custkey AS record_id, parent, node_id AS child, 'rows' AS kind FROM lines")
def tree_extend(spark, d):
    m = Compiled(frozenset({"basket", "lineitem"}), frozenset(), {"orders": "basket", "lineitem": "lineitem"}, {Edge("orders", "lineitem", "holds", "items"): Edge("basket", "lineitem", "rows", "items")})
    return tree.extend(order_tree(spark, d), ORDER_TREE, m).arcs.select("record_id", "parent", "child", "kind")


@query_of("tree_product", f"""{_NODES}, n AS (SELECT record_id, node_id, CASE anchor WHEN 'customer' THEN anchor ELSE 'money' END AS anchor FROM nodes)
    SELECT record_id, node_id, anchor, (SELECT count(*) FROM lines l WHERE l.parent = n.node_id) AS below FROM n""")
def tree_product(spark, d):
    """Two anchors become one; their arcs go with them."""
    m = Compiled(frozenset({"customer", "money"}), frozenset({Edge("customer", "money", "places", "orders"), Edge("money", "money", "holds", "items")}), {"customer": "customer", "orders": "money", "lineitem": "money"})
    out = tree.product(order_tree(spark, d, often=True), ORDER_TREE, m, max_size=10**12)
    below = out.arcs.where("kind = 'holds'").groupBy("record_id", F.col("parent").alias("node_id")).agg(F.count("*").alias("below"))
    return out.nodes.join(below, ["record_id", "node_id"], "left").select("record_id", "node_id", "anchor", F.coalesce("below", F.lit(0)).alias("below"))


@query_of("tree_section", f"""{_NODES}, top AS (SELECT record_id, max(CASE WHEN anchor <> 'orders' THEN node_id END) AS t FROM nodes GROUP BY record_id)
    SELECT record_id, node_id, anchor FROM nodes WHERE anchor <> 'orders' UNION ALL SELECT record_id, t + 1, 'note' FROM top""")
def tree_section(spark, d):
    view = tree.restrict(order_tree(spark, d), ORDER_TREE, CONTRACT, valid=True).tree
    return tree.section(view, CONTRACT, [(0, "note", "remark", "added")]).nodes.select("record_id", "node_id", "anchor")


@query_of("tree_validate", """SELECT record_id, kind, count(*) AS n FROM (
    SELECT o_custkey AS record_id, 'InvalidAnchor' AS kind FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    UNION ALL SELECT o_custkey, 'InvalidEdge' FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    UNION ALL SELECT c_custkey, 'MissingRequiredEdge' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) GROUP BY record_id, kind""")
def tree_validate(spark, d):
    s = SchemaBuilder(OPEN).vertex("customer", "object").vertex("orders", "object").edge("customer", "orders", "places", "orders").required("customer", Edge("customer", "orders", "places", "orders")).build()
    return tree.validate(order_tree(spark, d, often=True), s).groupBy("record_id", "kind").agg(F.count("*").alias("n"))


@query_of("tree_provenance", f"{_NODES} SELECT record_id, node_id, anchor AS source_anchor, CASE anchor WHEN 'lineitem' THEN 'line' ELSE anchor END AS target_anchor FROM nodes WHERE anchor <> 'orders'")
def tree_provenance(spark, d):
    return tree.provenance(tree.restrict(order_tree(spark, d), ORDER_TREE, CONTRACT, valid=True))


FIBER = Compiled(frozenset({"doc", "money"}), frozenset(), {"customer": "doc", "orders": "money", "lineitem": "money"})


@query_of("fiber_decomposition", f"{_NODES} SELECT record_id, fiber, list_sort(list(node_id)) AS node_ids FROM (SELECT *, CASE anchor WHEN 'customer' THEN 'doc' ELSE 'money' END AS fiber FROM nodes) GROUP BY record_id, fiber")
def fiber_decomposition(spark, d):
    return fibers.decomposition(order_tree(spark, d).nodes, FIBER)


@query_of("fiber_sizes", f"{_NODES} SELECT CASE anchor WHEN 'customer' THEN 'doc' ELSE 'money' END AS fiber, count(*) AS n FROM nodes GROUP BY 1")
def fiber_sizes(spark, d):
    return fibers.sizes(order_tree(spark, d).nodes, FIBER)


@query_of("fiber_predicate", f"{_NODES} SELECT record_id, node_id FROM nodes WHERE anchor <> 'customer' AND price > 200000 AND status = 'O'")
def fiber_predicate(spark, d):
    return fibers.with_predicate(order_tree(spark, d).nodes, FIBER, "money", 'price > 200000.0 && status == "O"').select("record_id", "node_id")


@query_of("fiber_at_node", f"{_NODES} SELECT record_id, node_id FROM nodes WHERE anchor <> 'lineitem'")
def fiber_at_node(spark, d):
    return fibers.at_node(tree.restrict(order_tree(spark, d), ORDER_TREE, CONTRACT, valid=True), 0)


@query_of("fiber_group_by", f"""{_NODES} SELECT 'arc' AS what, 'money' AS fiber, o_custkey AS record_id, parent, node_id AS id FROM lines
    UNION ALL SELECT 'node', CASE anchor WHEN 'customer' THEN 'doc' ELSE 'money' END, record_id, NULL, node_id FROM nodes""")
def fiber_group_by(spark, d):
    """The sub-instance of every fiber: its nodes, and the arcs inside it."""
    nodes, arcs = fibers.group_by(order_tree(spark, d), FIBER)
    arcs = arcs.select(F.lit("arc").alias("what"), "fiber", "record_id", "parent", F.col("child").alias("id"))
    return arcs.unionByName(nodes.select(F.lit("node").alias("what"), "fiber", "record_id", F.lit(None).cast("bigint").alias("parent"), F.col("node_id").alias("id")))


@query_of("fiber_join", f"{_NODES} SELECT a.record_id, 'x' AS fiber, a.node_id AS left_id, b.node_id AS right_id FROM nodes a JOIN nodes b ON a.record_id = b.record_id WHERE a.anchor = 'customer' AND b.anchor = 'orders'")
def fiber_join(spark, d):
    t = order_tree(spark, d).nodes
    return fibers.join(t, Compiled(frozenset({"x"}), frozenset(), {"customer": "x"}), t, Compiled(frozenset({"x"}), frozenset(), {"orders": "x"}))


# Graphs -----------------------------------------------------------------------------------------


def place_graph(spark, d) -> graph.Graph:
    r, n, c = (table(spark, d, t) for t in ("region", "nation", "customer"))
    at = lambda k, base: (F.col(k).cast("bigint") + base)
    v = r.select(at("r_regionkey", 0).alias("id"), F.lit("region").alias("anchor")).unionByName(n.select(at("n_nationkey", 1000).alias("id"), F.lit("nation").alias("anchor"))).unionByName(c.select(at("c_custkey", 100000).alias("id"), F.lit("customer").alias("anchor")))
    e = n.select(at("n_nationkey", 1000).alias("src"), at("n_regionkey", 0).alias("dst"), F.lit("in").alias("kind"), F.lit("region").alias("name")).unionByName(c.select(at("c_custkey", 100000).alias("src"), at("c_nationkey", 1000).alias("dst"), F.lit("in").alias("kind"), F.lit("nation").alias("name")))
    return graph.Graph(v, e)


LAND = Compiled(frozenset({"continent", "nation"}), frozenset(), {"region": "continent", "nation": "nation"}, {Edge("nation", "region", "in", "region"): Edge("nation", "continent", "on", "land")})


@query_of("graph_restrict", "SELECT n_nationkey + 1000 AS src, CAST(n_regionkey AS BIGINT) AS dst, 'on' AS kind, 'land' AS name FROM nation")
def graph_restrict(spark, d):
    return graph.restrict(place_graph(spark, d), LAND).edges


@query_of("graph_extend", """SELECT r_regionkey::BIGINT AS id, 'continent' AS anchor FROM region UNION ALL SELECT n_nationkey + 1000, 'nation' FROM nation""")
def graph_extend(spark, d):
    return graph.extend(place_graph(spark, d), LAND).vertices


@query_of("graph_reachable", "SELECT c_nationkey::BIGINT + 1000 AS id FROM customer UNION SELECT n_regionkey::BIGINT FROM customer JOIN nation ON c_nationkey = n_nationkey UNION SELECT c_custkey + 100000 FROM customer")
def graph_reachable(spark, d):
    _checkpoints(spark)
    g = place_graph(spark, d)
    return graph.reachable(g, g.vertices.where("anchor = 'customer'"))


def _checkpoints(spark: SparkSession) -> None:
    """The session's checkpoint folder is set where only its configuration names one."""
    shared_dir(spark)


# Lenses -----------------------------------------------------------------------------------------

BOUGHT = Schema("open", {"customer": "object", "line": "object"}, CONTRACT.edges)
ORDER_LENS = lens.TreeLens(ORDER_TREE, BOUGHT, CONTRACT, valid=True)


@query_of("lens_get", f"{_NODES} SELECT record_id, count(*) AS n, sum(CASE anchor WHEN 'lineitem' THEN 1 ELSE 0 END)::BIGINT AS lines FROM nodes WHERE anchor <> 'orders' GROUP BY record_id")
def lens_get(spark, d):
    view, _, _ = ORDER_LENS.get(order_tree(spark, d))
    return view.nodes.groupBy("record_id").agg(F.count("*").alias("n"), F.count_if(F.col("anchor") == "line").alias("lines"))


@query_of("lens_put_edited", f"{_NODES} SELECT record_id, node_id, anchor, CASE anchor WHEN 'customer' THEN price + 1 ELSE price END AS price FROM nodes")
def lens_put_edited(spark, d):
    view, c, _ = ORDER_LENS.get(order_tree(spark, d))
    edited = view.nodes.withColumn("fields", F.when(F.col("anchor") == "customer", F.col("fields").withField("price", F.col("fields.price") + 1)).otherwise(F.col("fields")))
    return ORDER_LENS.put(tree.Tree(edited, view.arcs), c).nodes.select("record_id", "node_id", "anchor", "fields.price")


@query_of("lens_compose", f"{_NODES} SELECT record_id, node_id, CASE anchor WHEN 'lineitem' THEN 'entry' ELSE 'buyer' END AS anchor FROM nodes WHERE anchor <> 'orders'")
def lens_compose(spark, d):
    second = Compiled(frozenset({"buyer", "entry"}), frozenset({Edge("buyer", "entry", "has", None)}), {"customer": "buyer", "line": "entry"})
    both = lens.compose(ORDER_LENS, lens.TreeLens(BOUGHT, Schema("open", {"buyer": "object", "entry": "object"}, second.edges), second))
    return both.get(order_tree(spark, d))[0].nodes.select("record_id", "node_id", "anchor")


DOCUMENT = {"id": "orders", "steps": [{"rename_field": {"old": "o_orderkey", "new": "id"}}, {"rename_field": {"old": "id", "new": "key"}}, {"add_field": {"name": "tmp", "default": 1}}, {"remove_field": "tmp"}, {"compute_field": {"target": "urgent", "expr": 'contains o_orderpriority "URGENT"'}}, {"remove_field": "o_orderdate"}]}


@query_of("lens_document", "SELECT o_orderkey AS key, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, contains(o_orderpriority, 'URGENT') AS urgent FROM orders")
def lens_document(spark, d):
    return transforms.select(table(spark, d, "orders"), lens_text.compile_document(DOCUMENT).transforms)


@query_of("lens_rules", "SELECT o_orderkey AS key, CASE WHEN o_totalprice > 200000 THEN 'big' END AS size FROM orders")
def lens_rules(spark, d):
    doc = {"rules": [{"match": "o_orderkey", "replace": "key"}, {"match": {"when": "o_totalprice > 200000.0"}, "replace": {"size": '"big"'}}], "passthrough": "drop"}
    return transforms.select(table(spark, d, "orders"), lens_text.compile_document(doc).transforms)


@query_of("lens_auto", "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal AS c_balance, c_mktsegment AS tier, 'none' AS note FROM customer")
def lens_auto(spark, d):
    df = table(spark, d, "customer")
    old = languages.from_struct(df.schema, "customer")
    b = SchemaBuilder(OPEN).vertex("customer", "object")
    for n, k in (("c_custkey", "int64"), ("c_name", "string"), ("c_nationkey", "int32"), ("c_balance", "float64"), ("tier", "string"), ("note", "token")):
        b.vertex(f"customer.{n}", k).edge("customer", f"customer.{n}", "prop", n)
    new = b.part("defaults", "customer.note", "none").build()
    return transforms.select(df, lens_text.auto_steps(old, new, "customer"))


@query_of("lens_graph_path", "SELECT s_suppkey AS id, s_name AS title, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal FROM supplier")
def lens_graph_path(spark, d):
    g = lens_text.LensGraph()
    g.add("a", "b", lens_text.Lens("1", (("rename", "s_suppkey", "key"), ("rename", "s_name", "name"))))
    g.add("b", "c", lens_text.Lens("2", (("rename", "key", "id"), ("rename", "name", "title"))))
    g.add("a", "c", lens_text.Lens("3", (("drop", "s_name"), ("rename", "s_suppkey", "id"))))
    return transforms.select(table(spark, d, "supplier"), g.path("a", "c"))


# Schemas, merges and versions ---------------------------------------------------------------------

@query_of("schema_of_table", "SELECT column_name AS name, CASE column_type WHEN 'BIGINT' THEN 'int64' WHEN 'INTEGER' THEN 'int32' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'float64' WHEN 'FLOAT' THEN 'float32' ELSE 'timestamp' END AS kind FROM (DESCRIBE orders)")
def schema_of_table(spark, d):
    s = languages.from_struct(table(spark, d, "orders").schema, "orders")
    return spark.createDataFrame([(e.label, s.vertices[e.tgt]) for e in s.outgoing("orders")], "name string, kind string")


@query_of("compiled_migration", "SELECT s_suppkey, upper(s_name) AS s_name FROM supplier")
def compiled_migration(spark, d):
    src = SchemaBuilder(OPEN).vertex("supplier", "table").build()
    tgt = SchemaBuilder(OPEN).vertex("vendor", "table").build()
    m = compile_migration(src, tgt, Migration({"supplier": "vendor"})).with_transforms("vendor", ("apply", "s_name", "upper s_name", None), ("keep", ("s_suppkey", "s_name")))
    return relational.restrict(tables(spark, d, "supplier"), m, apply_transforms=True)["vendor"]


def _branches(spark, d):
    base = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    k = F.col("c_custkey")
    ours = base.where(k % 11 != 0).withColumn("c_mktsegment", F.when(k % 3 == 0, "OURS").otherwise(F.col("c_mktsegment")))
    theirs = base.where(k % 13 != 0).withColumn("c_mktsegment", F.when(k % 5 == 0, "THEIRS").when(k % 7 == 0, "OURS").otherwise(F.col("c_mktsegment")))
    return base, ours, theirs


@query_of("three_way_merge", """WITH b AS (SELECT c_custkey, c_mktsegment AS m, c_acctbal AS a FROM customer),
    o AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'OURS' ELSE m END AS m, a FROM b WHERE c_custkey % 11 <> 0),
    t AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'THEIRS' WHEN c_custkey % 7 = 0 THEN 'OURS' ELSE m END AS m, a FROM b WHERE c_custkey % 13 <> 0),
    j AS (SELECT b.c_custkey, b.m AS bm, b.a AS ba, o.m AS om, t.m AS tm FROM b LEFT JOIN o USING (c_custkey) LEFT JOIN t USING (c_custkey)),
    x AS (SELECT *, om IS NOT DISTINCT FROM bm AS os, tm IS NOT DISTINCT FROM bm AS ts, om IS NOT DISTINCT FROM tm AS al FROM j)
    SELECT c_custkey, CASE WHEN os THEN tm WHEN ts THEN om WHEN al THEN om ELSE bm END IS NOT NULL AS kept, CASE WHEN os THEN tm WHEN ts THEN om WHEN al THEN om ELSE bm END AS c_mktsegment,
    CASE WHEN CASE WHEN os THEN tm WHEN ts THEN om WHEN al THEN om ELSE bm END IS NOT NULL THEN ba END AS c_acctbal,
    CASE WHEN NOT (os OR ts OR al) THEN 'conflict' WHEN os AND ts THEN 'base' WHEN os THEN 'theirs' WHEN ts THEN 'ours' ELSE 'both' END AS fate,
    CASE WHEN os OR ts OR al THEN NULL WHEN om IS NOT NULL AND tm IS NOT NULL THEN 'both_modified' ELSE 'delete_modify' END AS conflict FROM x""")
def three_way_merge(spark, d):
    return merge.three_way_merge(*_branches(spark, d), ["c_custkey"])


@query_of("row_diff", "SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'removed' ELSE 'modified' END AS change FROM customer WHERE c_custkey % 11 = 0 OR (c_custkey % 3 = 0 AND c_mktsegment <> 'OURS')")
def row_diff(spark, d):
    base, ours, _ = _branches(spark, d)
    return compare.diff_frames(base, ours, ["c_custkey"])


@query_of("version_migrate", "SELECT n_nationkey AS id, n_name AS name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
def version_migrate(spark, d):
    repo = Repository()
    df = table(spark, d, "nation")
    repo.add(languages.from_struct(df.schema, "nation"))
    first = repo.commit("first")
    b = SchemaBuilder(OPEN).vertex("nation", "object")
    for n, k in (("id", "int32"), ("name", "string"), ("n_regionkey", "int32")):
        b.vertex(f"nation.{n}", k).edge("nation", f"nation.{n}", "prop", n)
    repo.add(b.build())
    repo.commit("second")
    steps = lens_text.auto_steps(repo.schema(first), repo.schema(), "nation", hints={"n_nationkey": "id", "n_name": "name"})
    return transforms.select(df, steps).select(F.col("id").cast("int").alias("id"), "name", "n_regionkey")


def _nation_versions(spark, d):
    """Two versions of a table: the second renames two columns, drops one and adds one."""
    repo, df = Repository(), table(spark, d, "nation")
    repo.add(languages.from_struct(df.schema, "nation"), nation=f"{d}/nation.parquet", region=f"{d}/region.parquet")
    first = repo.commit("first")
    b = SchemaBuilder(OPEN).vertex("nation", "object")
    for n, k in (("n_nationkey", "int32"), ("n_label", "string"), ("note", "token")):
        b.vertex(f"nation.{n}", k).edge("nation", f"nation.{n}", "prop", n)
    repo.add(b.build(), region=f"{d}/supplier.parquet")
    return repo, df, first, repo.commit("second")


@query_of("version_migrate_back", """SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN upper(n_name) || '!' ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_nationkey <> 4 UNION ALL SELECT 100, 'new', NULL""")
def version_migrate_back(spark, d):
    """There and back: edits of the new version stay, what it lacks comes from the complement, a new row has nothing there."""
    repo, df, a, b = _nation_versions(spark, d)
    new, complement = repo.forward(df, "nation", a, b, ["n_nationkey"])
    edited = new.where("n_nationkey <> 4").withColumn("n_label", F.expr("case when n_nationkey % 2 = 0 then upper(n_label) || '!' else n_label end"))
    edited = edited.unionByName(spark.createDataFrame([(100, "new")], "n_nationkey int, n_label string"), allowMissingColumns=True)
    return repo.backward(edited, complement, "nation", a, b, ["n_nationkey"])


@query_of("version_stale", "SELECT 'nation' AS dataset, count(*) AS n FROM nation")
def version_stale(spark, d):
    """Datasets that were written for an older schema, with their rows; one that came with the new schema is not among them."""
    repo, *_ = _nation_versions(spark, d)
    parts = [spark.read.parquet(path).agg(F.lit(name).alias("dataset"), F.count("*").alias("n")) for name, path, _, _ in repo.stale()]
    return relational.union_all(parts)


@query_of("version_folder", """SELECT '{"key":' || n_nationkey || ',"label":"' || n_name || '"}' AS value FROM nation WHERE n_nationkey % 5 <> 0""")
def version_folder(spark, d):
    """A folder of JSON records goes over to another version; what cannot be read is counted and left."""
    repo = Repository()
    for names in (("n_nationkey", "n_name"), ("key", "label")):
        b = SchemaBuilder(OPEN).vertex("nation", "object")
        for n, k in zip(names, ("int32", "string"), strict=True):
            b.vertex(f"nation.{n}", k).edge("nation", f"nation.{n}", "prop", n)
        repo.add(b.build())
        repo.commit(names[0])
    old, new = (c.id for c in sorted(repo.commits.values(), key=lambda c: c.seq))
    folder, to = new_folder(spark, "records"), new_folder(spark, "moved")
    text = F.when(F.col("n_nationkey") % 5 == 0, "no json").otherwise(F.to_json(F.struct("n_nationkey", "n_name")))
    table(spark, d, "nation").repartition(25, "n_nationkey").select(text.alias("value")).write.option("maxRecordsPerFile", 1).text(folder)
    repo.migrate_folder(spark, folder, to, "nation", old, new)
    return spark.read.text(to)


@query_of("hom_evaluate", f"{_NODES} SELECT record_id, node_id, CASE anchor WHEN 'lineitem' THEN 'line' ELSE anchor END AS anchor FROM nodes WHERE anchor <> 'orders'")
def hom_evaluate(spark, d):
    """A mapping written as an instance of the hom schema, checked against that schema, and applied from there."""
    m = hom.curry(CONTRACT, ORDER_TREE, spark)
    assert not tree.validate(m, hom.hom_schema(ORDER_TREE, BOUGHT)).count()
    return hom.evaluate(m, order_tree(spark, d, often=True), ORDER_TREE, BOUGHT).tree.nodes.select("record_id", "node_id", "anchor")


@query_of("cascade_data", f"WITH {_LINES} SELECT o_custkey AS record_id, parent, node_id AS child, 'contains' AS kind FROM lines UNION ALL SELECT o_custkey, 0, (o_orderkey + 1) * {BLOCK}, 'places' FROM orders")
def cascade_data(spark, d):
    """A map of theories renames an operation; the schema's edges and the data's arcs follow."""
    _, m = hom.induced_data(Morphism({}, {"holds": "contains"}), ORDER_TREE)
    return tree.restrict(order_tree(spark, d, often=True), ORDER_TREE, m).tree.arcs.select("record_id", "parent", "child", "kind")


@query_of("project_coproduct", f"{_NODES} SELECT record_id, node_id, 'a.json::' || anchor AS anchor, 'a.json' AS file FROM nodes UNION ALL SELECT record_id, node_id, 'b.json::' || anchor, 'b.json' FROM nodes WHERE anchor = 'customer'")
def project_coproduct(spark, d):
    """The data of two files side by side, under their schemas' coproduct."""
    t = order_tree(spark, d)
    small = SchemaBuilder(OPEN).vertex("customer", "object").build()
    _, ways = hom.coproduct({"a.json": ORDER_TREE, "b.json": small})
    other = tree.Tree(t.nodes.where("anchor = 'customer'"), t.arcs.limit(0))
    return hom.tagged({"a.json": t, "b.json": other}, ways).nodes.select("record_id", "node_id", "anchor", "file")


@query_of("tree_expand", f"""{_NODES}, f AS (SELECT * FROM orders WHERE o_orderstatus = 'F') SELECT o_custkey AS record_id, CASE WHEN o_orderstatus = 'F' THEN parent ELSE 0 END AS parent, node_id AS child FROM lines
    UNION ALL SELECT o_custkey, 0, (o_orderkey + 1) * {BLOCK} FROM f""")
def tree_expand(spark, d):
    """Contracted orders that are finished come back, with their lines under them."""
    t = order_tree(spark, d, often=True)
    r = tree.restrict(t, ORDER_TREE, CONTRACT, valid=True)
    record = tree.contractions(r, t.arcs)
    return tree.expand(r.tree, record, t.arcs, record.where("fields.status = 'F'")).arcs.select("record_id", "parent", "child")


@query_of("graph_reachable_after", """WITH e AS (SELECT n_nationkey::BIGINT + 1000 AS src, n_regionkey::BIGINT AS dst FROM nation WHERE n_nationkey NOT IN (3, 4) UNION ALL SELECT c_custkey + 100000, c_nationkey + 1000 FROM customer WHERE c_nationkey <> 7
    UNION ALL SELECT r_regionkey::BIGINT, 500 + r_regionkey FROM region UNION ALL SELECT 500 + r_regionkey, 600 + r_regionkey FROM region),
    a AS (SELECT DISTINCT c_custkey + 100000 AS id FROM customer), b AS (SELECT DISTINCT dst AS id FROM e WHERE src IN (FROM a)), c AS (SELECT DISTINCT dst AS id FROM e WHERE src IN (FROM b)),
    f AS (SELECT DISTINCT dst AS id FROM e WHERE src IN (FROM c)), g AS (SELECT DISTINCT dst AS id FROM e WHERE src IN (FROM f)) SELECT id FROM a UNION SELECT id FROM b UNION SELECT id FROM c UNION SELECT id FROM f UNION SELECT id FROM g""")
def graph_reachable_after(spark, d):
    """What customers reach after some edges went and others came, from what they reached before."""
    _checkpoints(spark)
    g = place_graph(spark, d)
    roots = g.vertices.where("anchor = 'customer'").select("id")
    before = graph.reachable(g, roots)
    gone = g.edges.where("src in (1003, 1004) or dst = 1007")
    r = table(spark, d, "region").select(F.col("r_regionkey").cast("bigint").alias("k"))
    new = r.select(F.col("k").alias("src"), (F.col("k") + 500).alias("dst")).unionByName(r.select((F.col("k") + 500).alias("src"), (F.col("k") + 600).alias("dst")))
    after = graph.Graph(g.vertices, g.edges.join(gone.select("src", "dst"), ["src", "dst"], "left_anti").select("src", "dst").unionByName(new))
    return graph.reachable_after(after, before, roots, new, gone.select("src", "dst"))


# Edits ------------------------------------------------------------------------------------------


@query_of("table_edits", """WITH log AS (SELECT event_id, user_id, event_type, value FROM events WHERE event_type IN ('signup', 'purchase', 'error')),
    per AS (SELECT user_id, event_id, event_type, value, coalesce(max(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id), -1) AS last_error FROM log),
    live AS (SELECT user_id, min(CASE WHEN event_type = 'signup' THEN event_id END) AS born FROM per WHERE event_id > last_error GROUP BY user_id)
    SELECT l.user_id, arg_max(p.value, p.event_id) AS value FROM live l JOIN per p ON p.user_id = l.user_id AND p.event_id >= l.born
    WHERE p.event_type = 'purchase' OR p.event_id = l.born GROUP BY l.user_id""")
def table_edits(spark, d):
    e = table(spark, d, "events").where(F.col("event_type").isin("signup", "purchase", "error"))
    op = F.when(F.col("event_type") == "signup", "insert").when(F.col("event_type") == "purchase", "update").otherwise("delete")
    log = e.select(F.col("event_id").alias("seq"), op.alias("op"), "user_id", "value")
    return edits.apply_table_edits(spark.createDataFrame([], "user_id long, value double"), "user_id", log).rows


@query_of("table_edit_bulk", "SELECT c_custkey, c_name FROM customer WHERE c_custkey % 10 <> 3 UNION ALL SELECT s_suppkey + 1000000, s_name FROM supplier")
def table_edit_bulk(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    less = edits.delete_rows(c, "c_custkey", c.where("c_custkey % 10 = 3"))
    return edits.insert_rows(less, table(spark, d, "supplier").select((F.col("s_suppkey") + 1000000).alias("c_custkey"), F.col("s_name").alias("c_name")))


@query_of("table_update_first", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_orderkey = 7 AND row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) = 1 THEN 'X' ELSE l_returnflag END AS l_returnflag FROM lineitem")
def table_update_first(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    return edits.update_cell(li, "l_orderkey", 7, "l_returnflag", "X", F.struct("l_linenumber", "l_partkey"))


def _turns(spark, d):
    t = table(spark, d, "conversations")
    ids = t.select("conv_id").distinct()
    empty = F.create_map().cast("map<string,string>").alias("fields")
    nodes = ids.select(F.col("conv_id").alias("record_id"), F.lit(0).cast("long").alias("node_id"), F.lit("conversation").alias("anchor"), F.lit(None).cast("string").alias("value"), empty)
    nodes = nodes.unionByName(t.select(F.col("conv_id").alias("record_id"), (F.col("turn") + 1).alias("node_id"), F.lit("turn").alias("anchor"), F.col("role").alias("value"), empty))
    arcs = t.select(F.col("conv_id").alias("record_id"), F.lit(0).cast("long").alias("parent"), (F.col("turn") + 1).alias("child"), F.col("turn").alias("pos"), F.lit("says").alias("kind"), F.lit(None).cast("string").alias("name"))
    return nodes, arcs


@query_of("tree_edits", """SELECT conv_id AS record_id, turn + 1 AS node_id, CASE WHEN turn = 1 THEN 'reply' ELSE 'turn' END AS anchor FROM conversations WHERE turn <> 0
    UNION ALL SELECT DISTINCT conv_id, 0::BIGINT, 'conversation' FROM conversations UNION ALL SELECT DISTINCT conv_id, 900::BIGINT, 'note' FROM conversations""")
def tree_edits(spark, d):
    nodes, arcs = _turns(spark, d)
    ids = nodes.where("node_id = 0").select("record_id")
    none = F.lit(None)
    one = lambda seq, op, node, parent=None, anchor=None: F.struct(F.lit(seq).cast("long").alias("seq"), F.lit(op).alias("op"), F.lit(node).cast("long").alias("node"), F.lit(parent).cast("long").alias("parent"), F.lit("says").alias("kind"), none.cast("string").alias("name"), F.lit(anchor).cast("string").alias("anchor"), none.cast("string").alias("field"), none.cast("string").alias("value"), none.cast("array<long>").alias("joined"))
    log = ids.select("record_id", F.explode(F.array(one(1, "insert_node", 900, 0, "note"), one(2, "delete_node", 1), one(3, "relabel_node", 2, None, "reply"), one(4, "delete_node", 12345))).alias("e")).select("record_id", "e.*")
    return edits.apply_tree_edits(nodes, arcs, log)[0].select("record_id", "node_id", "anchor")


@query_of("edit_translate", "SELECT c_custkey AS record_id, 1::BIGINT AS seq, 'identity' AS op, NULL::VARCHAR AS anchor FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT c_custkey, 2, 'relabel_node', 'line' FROM customer")
def edit_translate(spark, d):
    t = order_tree(spark, d)
    first = t.nodes.where("anchor = 'orders'").groupBy("record_id").agg(F.min("node_id").alias("node"))
    base = "cast(null as long) parent, cast(null as string) kind, cast(null as string) name, cast({a} as string) anchor, cast(null as string) field, cast(null as string) value, cast(null as array<long>) joined".split(", ")
    log = first.selectExpr("record_id", "1L seq", "'set_field' op", "node", *[x.format(a="null") for x in base]).unionByName(t.nodes.where("anchor = 'customer'").selectExpr("record_id", "2L seq", "'relabel_node' op", "node_id node", *[x.format(a="'lineitem'") for x in base]))
    return edits.translate(log, t.nodes.select("record_id", "node_id", "anchor"), CONTRACT).select("record_id", "seq", "op", "anchor")


def _log(df: DataFrame, *edits_: tuple) -> DataFrame:
    """A log from ``df``: an edit for each of its rows and each of (seq, op, columns by name)."""
    from functools import reduce

    kinds = {"node": "long", "parent": "long", "kind": "string", "name": "string", "anchor": "string", "field": "string", "value": "string", "joined": "array<long>"}
    parts = [df.select("record_id", F.lit(s).cast("long").alias("seq"), F.lit(op).alias("op"), *[F.expr(given.get(c, "null")).cast(t).alias(c) for c, t in kinds.items()]) for s, op, given in edits_]
    return reduce(DataFrame.unionByName, parts)


@query_of("edit_get", f"""SELECT o_custkey AS record_id, seq, op, n * k AS node, p AS parent, kind, name, anchor, why FROM (SELECT o_custkey, (o_orderkey + 1) * {BLOCK} AS n FROM orders),
    (VALUES (1, 'identity', 1, NULL, NULL, NULL, NULL, 'absorbed'), (3, 'identity', 1, NULL, NULL, NULL, NULL, 'absorbed'), (4, 'identity', 1, NULL, NULL, NULL, 'lineitem', 'NoPlace'), (6, 'identity', 1, NULL, NULL, NULL, NULL, 'absorbed')) v(seq, op, k, p, kind, name, anchor, why)
    UNION ALL SELECT o_custkey, 2, 'insert_node', (o_orderkey + 1) * {BLOCK} + 900, 0, 'bought', 'lines', 'line', NULL FROM orders
    UNION ALL SELECT o_custkey, 5, 'set_field', (o_orderkey + 1) * {BLOCK} + 900, NULL, NULL, NULL, NULL, NULL FROM orders""")
def edit_get(spark, d):
    """Edits of the source as edits of the view: those of dropped orders are absorbed, and a line put under an order is put under its customer."""
    t = order_tree(spark, d, often=True)
    at = t.nodes.where("anchor = 'orders'").select("record_id", "node_id")
    log = _log(at, (1, "set_field", {"node": "node_id", "field": "'name'", "value": "'x'"}), (2, "insert_node", {"node": "node_id + 900", "parent": "node_id", "kind": "'holds'", "name": "'items'", "anchor": "'lineitem'"}), (3, "remove_field", {"node": "node_id", "field": "'name'"}), (4, "relabel_node", {"node": "node_id", "anchor": "'lineitem'"}), (5, "set_field", {"node": "node_id + 900", "field": "'name'", "value": "'y'"}), (6, "delete_node", {"node": "node_id"}))
    got = edit_lens.EditLens(ORDER_LENS).get_edits(t, log).judged
    return got.select("record_id", "seq", "op", "node", "parent", "kind", "name", "anchor", F.col("reason").alias("why"))


BASKET = Compiled(
    frozenset({"buyer", "basket"}), frozenset({Edge("buyer", "basket", "has", "baskets")}), {"customer": "buyer", "orders": "basket"}, {Edge("customer", "orders", "places", "orders"): Edge("buyer", "basket", "has", "baskets")},
    transforms={"basket": [("rename", "name", "label"), ("compute", "half", "price / 2.0"), ("compute", "twice", "price * 2.0")]},
)


@query_of("edit_put", """SELECT c_custkey AS record_id, seq, op, node, kind, name, anchor, field, why FROM customer, (VALUES
    (1, 'insert_node', 7, 'places', 'orders', 'orders', NULL, NULL), (2, 'set_field', 7, NULL, NULL, NULL, 'name', NULL), (3, 'identity', 7, NULL, NULL, NULL, 'half', 'ComputedField'),
    (4, 'identity', 7, NULL, NULL, NULL, 'twice', NULL), (5, 'relabel_node', 0, NULL, NULL, 'customer', NULL, NULL), (6, 'identity', 8, 'has', NULL, 'buyer', NULL, 'NoEdgeFound')) v(seq, op, node, kind, name, anchor, field, why)""")
def edit_put(spark, d):
    """Edits of the view as edits of the source: names go back, computed fields cannot be set."""
    t = order_tree(spark, d)
    target = Schema("open", {"buyer": "object", "basket": "object"}, BASKET.edges)
    lens_ = edit_lens.EditLens(lens.TreeLens(ORDER_TREE, target, BASKET), {("basket", "twice"): "ignore"})
    log = _log(t.nodes.where("anchor = 'customer'"), (1, "insert_node", {"node": "7", "parent": "0", "kind": "'has'", "name": "'baskets'", "anchor": "'basket'"}), (2, "set_field", {"node": "7", "field": "'label'", "value": "'x'"}), (3, "set_field", {"node": "7", "field": "'half'", "value": "'1'"}), (4, "set_field", {"node": "7", "field": "'twice'", "value": "'1'"}), (5, "relabel_node", {"node": "0", "anchor": "'buyer'"}), (6, "insert_node", {"node": "8", "parent": "7", "kind": "'has'", "anchor": "'buyer'"}))
    got = lens_.put_edits(t, log)
    return got.log.join(got.errors.select("record_id", "seq", F.col("reason").alias("why")), ["record_id", "seq"], "left").select("record_id", "seq", "op", "node", "kind", "name", "anchor", "field", "why")


@query_of("edit_fans", """SELECT conv_id AS record_id, f AS hyper_edge, 0::BIGINT AS parent, m AS children FROM (SELECT DISTINCT conv_id FROM conversations), (VALUES ('kept', 'b=2'), ('late', 'x=0,y=2')) v(f, m)""")
def edit_fans(spark, d):
    """Fans go with their members, and edits add and remove them."""
    nodes, arcs = _turns(spark, d)
    ids = nodes.where("node_id = 0").select("record_id")
    fan = lambda n, **children: ids.select("record_id", F.lit(n).alias("hyper_edge"), F.lit(0).cast("long").alias("parent"), F.create_map(*[F.lit(x) for k, v in children.items() for x in (k, v)]).cast("map<string,bigint>").alias("children"))
    fans = fan("pair", a=1, b=2).unionByName(fan("kept", b=2)).unionByName(fan("gone", b=2))
    log = _log(ids, (1, "delete_node", {"node": "1"}), (2, "delete_fan", {"node": "0", "name": "'gone'"}), (3, "insert_fan", {"node": "0", "name": "'late'", "field": "'x,y'", "joined": "array(0, 2)"}), (4, "delete_fan", {"node": "0", "name": "'none'"}))
    out = edits.apply_tree_edits(nodes, arcs, log, fans)[3]
    text = F.array_join(F.transform(F.sort_array(F.map_entries("children")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.select("record_id", "hyper_edge", "parent", text.alias("children"))


# Sources and sinks --------------------------------------------------------------------------------

PROPS = SchemaBuilder(OPEN).vertex("props", "object").vertex("props.k", "integer").edge("props", "props.k", "prop", "k").build()


@query_of("json_scan", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_scan(spark, d):
    return records.parse_json(table(spark, d, "events"), "props", PROPS, "props").select("event_id", "record.k")


@query_of("json_sink", """SELECT n_nationkey, '{"name":"' || n_name || '","region":' || n_regionkey || '}' AS json FROM nation""")
def json_sink(spark, d):
    df = table(spark, d, "nation").select("n_nationkey", F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).alias("record"))
    return records.emit_json(df, rest=None).select("n_nationkey", "json")


@query_of("json_roundtrip_rest", """SELECT event_id, json_object('id', event_id, 'k', k, 'n', value, 't', k, 'u', 'true', 'v', 'null', 'w', json_object('x', [1, 2]), 'z', event_type)::VARCHAR AS json
    FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k, value, event_type FROM events) WHERE value <> floor(value)""")
def json_roundtrip_rest(spark, d):
    """Keys that the schema lacks go through as they are: texts that look like numbers, literals or objects stay texts."""
    e = table(spark, d, "events").where("value <> floor(value)").withColumn("k", F.get_json_object("props", "$.k"))
    text = F.to_json(F.struct(F.col("event_id").alias("id"), "k", F.col("value").alias("n"), F.col("k").alias("t"), F.lit("true").alias("u"), F.lit("null").alias("v"), F.struct(F.array(F.lit(1), F.lit(2)).alias("x")).alias("w"), F.col("event_type").alias("z")))
    s = SchemaBuilder(OPEN).vertex("e", "object").vertex("e.k", "string").vertex("e.id", "integer").edge("e", "e.k", "prop", "k").edge("e", "e.id", "prop", "id").build()
    return records.emit_json(records.parse_json(e.withColumn("text", text), "text", s, "e")).select("event_id", "json")


@query_of("table_file_scan", """SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS name, CASE WHEN n_regionkey > 2 THEN 'extra' END AS col_2, NULL::VARCHAR AS col_3 FROM nation
    UNION ALL SELECT 'key', 'name', NULL, NULL FROM nation WHERE n_regionkey = 0 UNION ALL SELECT 'a', 'b', 'c', '' """)
def table_file_scan(spark, d):
    """A file written and read: comments and blank lines go, rows that equal the header stay, fields beyond the header have names of their own."""
    n = table(spark, d, "nation")
    plain = n.select("n_nationkey", F.lit(0).alias("o"), F.concat_ws("\t", F.col("n_nationkey").cast("string"), "n_name", F.when(F.col("n_regionkey") > 2, "extra")).alias("value"))
    again = n.where("n_regionkey = 0").select("n_nationkey", F.lit(1).alias("o"), F.lit("key\tname").alias("value"))
    head = spark.createDataFrame([(-3, 0, "# a comment"), (-2, 0, ""), (-1, 0, "key\tname"), (-1, 1, "a\tb\tc\t")], "n_nationkey int, o int, value string")
    path = new_folder(spark, "delimited")
    plain.unionByName(again).unionByName(head).coalesce(1).sortWithinPartitions("n_nationkey", "o").select("value").write.text(path)
    return records.read_table(spark, path).select("key", "name", "col_2", "col_3")


@query_of("merge_null_keys", """SELECT nullif(n_nationkey, 3) AS k, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'ours' WHEN n_nationkey % 3 = 0 THEN 'theirs' ELSE 'base' END AS fate_
    FROM nation WHERE n_nationkey % 6 <> 0 UNION ALL SELECT n_nationkey, CASE WHEN n_nationkey % 6 = 0 THEN n_name END, 'conflict' FROM nation WHERE n_nationkey % 6 = 0""")
def merge_null_keys(spark, d):
    """A null key is a key; the added columns take names that the table does not have."""
    base = table(spark, d, "nation").select(F.expr("nullif(n_nationkey, 3)").alias("k"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("fate"), F.col("n_nationkey").alias("n"))
    ours = base.withColumn("fate", F.when(F.col("n") % 2 == 0, -1).otherwise(F.col("fate")))
    theirs = base.withColumn("fate", F.when(F.col("n") % 3 == 0, -2).otherwise(F.col("fate")))
    return merge.three_way_merge(base, ours, theirs, ["k"], ("kept_", "fate_", "conflict_")).select("k", "name", "fate_")


@query_of("json_to_tree", """SELECT event_id AS record_id, 'props' AS anchor, NULL::VARCHAR AS value FROM events UNION ALL SELECT event_id, 'props.k', CAST(json_extract(props, '$.k') AS VARCHAR) FROM events WHERE json_extract(props, '$.k') IS NOT NULL""")
def json_to_tree(spark, d):
    df = records.parse_json(table(spark, d, "events"), "props", PROPS, "props").withColumn("record_id", F.col("event_id"))
    return records.to_tree(df, PROPS, "props").nodes.select("record_id", "anchor", "value")


@query_of("xml_roundtrip", "SELECT n_nationkey, n_name AS name, n_regionkey AS region FROM nation")
def xml_roundtrip(spark, d):
    df = table(spark, d, "nation").select("n_nationkey", F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).alias("record"))
    text = records.emit_xml(df, root="nation").select("n_nationkey", "xml")
    return records.parse_xml(text, "xml", "name string, region int", "nation").select("n_nationkey", "record.name", "record.region")


@query_of("table_sink", "SELECT n_name || chr(9) || n_nationkey || chr(9) || n_regionkey AS value FROM nation")
def table_sink(spark, d):
    return records.emit_table(table(spark, d, "nation"))


@query_of("table_scan", "SELECT n_name AS a, CAST(n_nationkey AS VARCHAR) AS b, NULLIF(CAST(n_regionkey AS VARCHAR), '1') AS c FROM nation")
def table_scan(spark, d):
    lines = table(spark, d, "nation").select(F.concat_ws("\t", "n_name", "n_nationkey", F.when(F.col("n_regionkey") == 1, "_").otherwise(F.col("n_regionkey").cast("string"))).alias("value"))
    return records.split_table(lines, ["a", "b", "c"], "\t")


@query_of("conllu_tokens", """WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS sent FROM documents),
    w AS (SELECT doc_id, sent, list_filter(string_split_regex(line, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws FROM s),
    k AS (SELECT doc_id, sent, ws, row_number() OVER (PARTITION BY doc_id ORDER BY sent) - 1 AS sent_idx FROM w)
    SELECT doc_id, sent_idx, CAST(sent AS VARCHAR) AS sent_id, len(ws) AS words, CASE WHEN len(ws) > 0 THEN array_to_string(ws, ' ') END AS forms FROM k""")
def conllu_tokens(spark, d):
    """Forms in order and metadata (of a repeated key the last) of every sentence, after writing and reading."""
    sents, toks = records.sentences_of(table(spark, d, "documents").select("doc_id", "text"))
    text = records.emit_conllu(sents, toks).withColumn("text", F.regexp_replace("text", "(?m)^# sent_id = ", "# sent_id = x\n# sent_id = "))
    sents, toks = records.parse_conllu(text)
    forms = toks.groupBy("doc_id", "sent_idx").agg(F.count("*").alias("words"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("token_idx", "FORM"))), lambda x: x["FORM"]), " ").alias("forms"))
    return sents.select("doc_id", "sent_idx", F.col("metadata")["sent_id"].alias("sent_id")).join(forms, ["doc_id", "sent_idx"], "left").select("doc_id", F.col("sent_idx").cast("bigint").alias("sent_idx"), "sent_id", F.coalesce("words", F.lit(0)).alias("words"), "forms")


@query_of("conllu_roundtrip", """SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS BIGINT) AS words FROM documents WHERE len(list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) > 0""")
def conllu_roundtrip(spark, d):
    sents, toks = records.sentences_of(table(spark, d, "documents").select("doc_id", "text"))
    _, again = records.parse_conllu(records.emit_conllu(sents, toks))
    return again.groupBy("doc_id").agg(F.count("*").alias("words"))


@query_of("constraint_checks", "SELECT count(*) AS total, count(*) FILTER (ok) AS successful, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (NOT ok) AS failed_maxLength_name, count(*) FILTER (ok) / count(*) AS ratio FROM (SELECT strlen(p_name) <= 15 AS ok FROM part)")
def constraint_checks(spark, d):
    s = languages.read_json_schema({"type": "object", "properties": {"name": {"type": "string", "maxLength": 15}}})
    df = table(spark, d, "part").select(F.struct(F.col("p_name").alias("name")).alias("record"))
    return relational.coverage(df, languages.checks(s, "root"))


from . import catalog_schemas  # noqa: E402, F401  (it registers its queries here)

__all__ = ["FLAGSHIP", "QUERIES", "SQL", "json"]
