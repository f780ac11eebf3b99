"""Record formats: JSON, XML, delimited text and CoNLL-U, read and written by plans.

Text comes in as a DataFrame (a path's lines, whole files, or a column), so scans are distributed and splittable where the format is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import Schema

#: The ten columns of CoNLL-U. Fixed values.
CONLLU = ["ID", "FORM", "LEMMA", "UPOS", "XPOS", "FEATS", "HEAD", "DEPREL", "DEPS", "MISC"]


def parse_json(df: DataFrame, column: str, schema: Schema, root: str, mode: str = "PERMISSIVE") -> DataFrame:
    """``df`` with ``record`` (the schema's struct), ``type`` (the text's $type) and ``rest``: keys that the schema lacks, by name, as JSON text
    (a string keeps its quotes, so that text and numbers stay apart).

    Text that is no JSON object gives null in all three; with mode FAILFAST it fails the query.
    """
    known = [e.label for e in schema.outgoing(root)]
    open_map = F.from_json(F.col(column), "map<string,variant>", {"mode": mode})
    rest = F.transform_values(F.map_filter(open_map, lambda k, v: ~k.isin([*known, "$type"])), lambda k, v: F.coalesce(F.to_json(v), F.lit("null")))
    record = F.from_json(F.col(column), schema.struct(root), {"mode": mode})
    return df.withColumn("record", F.when(open_map.isNotNull(), record)).withColumn("type", F.get_json_object(column, "$['$type']")).withColumn("rest", rest)


def emit_json(df: DataFrame, record: str = "record", rest: str | None = "rest") -> DataFrame:
    """``df`` with ``json``: the record's fields without nulls, as they are typed, and the keys of ``rest`` (JSON texts) over them."""
    text = F.to_json(record)
    if rest is None:
        return df.withColumn("json", text)
    nothing = F.create_map().cast("map<string,string>")
    more = F.coalesce(F.col(rest), nothing)
    own = F.transform_values(F.from_json(text, "map<string,variant>"), lambda k, v: F.coalesce(F.to_json(v), F.lit("null")))
    merged = F.map_concat(F.map_filter(own, lambda k, v: ~F.map_contains_key(more, k)), more)
    pairs = F.transform(F.map_entries(merged), lambda e: F.concat(_quoted(e["key"]), F.lit(":"), e["value"]))
    plain = F.when(F.size(more) == 0, text)
    return df.withColumn("json", F.coalesce(plain, F.concat(F.lit("{"), F.array_join(F.sort_array(pairs), ","), F.lit("}"))))


def _quoted(v):
    """A text as JSON."""
    listed = F.to_json(F.array(v))
    return listed.substr(F.lit(2), F.length(listed) - 2)


def read_json_dir(spark: SparkSession, path: str, schema: Schema, root: str) -> tuple[DataFrame, DataFrame]:
    """A folder of JSON records: the good ones with their file, and the files of bad ones."""
    files = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    parsed = parse_json(files, "value", schema, root)
    return parsed.where("rest is not null").select("file", "record", "type", "rest"), parsed.where("rest is null").select("file")


def to_tree(df: DataFrame, schema: Schema, root: str, record: str = "record", key: str = "record_id"):
    """Nested records as nodes and arcs. Node ids are paths hashed to numbers: no numbering pass is needed.

    Scalars become leaves with a value; lists give a node for each element through their item edge.
    """
    from ..operators.tree import Tree

    if schema.depth() is None:
        raise ValueError("a recursive schema needs a bound on its depth")
    rows, arcs = [], []

    def node_id(path):
        return F.xxhash64(path)

    def visit(frame: DataFrame, value, vertex: str, path, parent, pos, kind, name):
        out = schema.outgoing(vertex)
        is_list = schema.vertices[vertex] in ("array", "list", "set")
        leaf = not out and not is_list
        here = frame.where(value.isNotNull())
        rows.append(here.select(F.col(key).alias("record_id"), node_id(path).alias("node_id"), F.lit(vertex).alias("anchor"), (value.cast("string") if leaf else F.lit(None).cast("string")).alias("value")))
        if parent is not None:
            arcs.append(here.select(F.col(key).alias("record_id"), node_id(parent).alias("parent"), node_id(path).alias("child"), pos.cast("long").alias("pos"), F.lit(kind).alias("kind"), F.lit(name).cast("string").alias("name")))
        if is_list:
            items = [e for e in out if e.kind in ("item", "items") or e.name in ("item", "items")]
            if items:
                depth = len(rows)
                inner = here.select("*", F.posexplode(value).alias(f"_p{depth}", f"_x{depth}"))
                visit(inner, F.col(f"_x{depth}"), items[0].tgt, F.concat(path, F.lit("/"), F.col(f"_p{depth}")), path, F.col(f"_p{depth}"), items[0].kind, items[0].name)
        else:
            for i, e in enumerate(out):
                visit(here, value.getField(e.label), e.tgt, F.concat(path, F.lit(f"/{e.label}")), path, F.lit(i), e.kind, e.name)

    visit(df, F.col(record), root, F.lit(root), None, F.lit(0), None, None)
    nodes = rows[0]
    for r in rows[1:]:
        nodes = nodes.unionByName(r)
    edges = arcs[0] if arcs else df.sparkSession.createDataFrame([], "record_id long, parent long, child long, pos long, kind string, name string")
    for a in arcs[1:]:
        edges = edges.unionByName(a)
    return Tree(nodes, edges)


def parse_xml(df: DataFrame, column: str, ddl: str, root: str | None = None) -> DataFrame:
    """``df`` with ``record``: elements as fields, attributes as fields with a leading underscore, text of an element that has attributes as _VALUE."""
    options = {"rowTag": root} if root else {}
    return df.withColumn("record", F.from_xml(F.col(column), ddl, options))


def emit_xml(df: DataFrame, record: str = "record", root: str = "ROW") -> DataFrame:
    return df.withColumn("xml", F.to_xml(F.col(record), {"rowTag": root}))


def read_table(spark: SparkSession, path: str, sep: str = "\t", comment: str | None = "#") -> DataFrame:
    """Delimited text without quoting: the first line of each file that is neither blank nor a comment names the columns, all of which are text;
    ``_`` is missing, fields that a line lacks are null, and fields beyond the names are ``col_<i>``, as many as the widest line has.

    Only that first line is a header: later lines that equal it are rows. Files with different headers are an error. One pass finds
    the header and the widest line; ``comment`` is one character.
    """
    if comment and len(comment) != 1:
        raise ValueError("a comment begins with one character")
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    useful = F.trim("value") != ""
    if comment:
        useful = useful & ~F.col("value").startswith(comment)
    parts = F.size(F.split(F.regexp_replace("value", "\r$", ""), "\\Q" + sep + "\\E", -1))
    per_file = lines.where(useful).groupBy("file").agg(F.min_by("value", F.struct("start", "at")).alias("head"), F.max(parts).alias("width"))
    found = per_file.groupBy("head").agg(F.max("width").alias("width")).limit(2).collect()
    if not found:
        raise ValueError(f"no header in {path}")
    if len(found) > 1:
        raise ValueError(f"files of {path} have different headers")
    names = found[0].head.rstrip("\r").split(sep)
    # Whole lines through the reader that knows each file's first line and its comments.
    options = {"header": True, "sep": "\u0001", "quote": "", "comment": comment or "", "nullValue": "\u0001", "lineSep": "\n"}
    rows = spark.read.schema("value string").options(**{k: v for k, v in options.items() if k != "comment" or v}).csv(path)
    return split_table(rows, names, sep, max(0, found[0].width - len(names)))


def split_table(lines: DataFrame, names: list[str], sep: str, extra: int = 0) -> DataFrame:
    """Lines (``value``) as columns of text."""
    parts = F.split(F.regexp_replace("value", "\r$", ""), "\\Q" + sep + "\\E", -1)
    cols = [F.nullif(F.get(parts, F.lit(i)), F.lit("_")).alias(n) for i, n in enumerate(names)]
    cols += [F.nullif(F.get(parts, F.lit(i)), F.lit("_")).alias(f"col_{i}") for i in range(len(names), len(names) + extra)]
    return lines.select(*cols)


def emit_table(df: DataFrame, sep: str = "\t") -> DataFrame:
    """Lines (``value``) of a table: columns sorted by name, ``_`` for what is missing. The header is ``sep.join(sorted(columns))``."""
    return df.select(F.concat_ws(sep, *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("_")) for c in sorted(df.columns)]).alias("value"))


def write_table(df: DataFrame, path: str, sep: str = "\t") -> None:
    """Part files with a header each."""
    out = df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("_")).alias(c) for c in sorted(df.columns)])
    out.write.option("header", True).option("sep", sep).option("quote", "\u0000").option("emptyValue", "").csv(path)


def parse_conllu(docs: DataFrame, ident: str = "doc_id", column: str = "text") -> tuple[DataFrame, DataFrame]:
    """Sentences (ident, sent_idx, metadata) and tokens (ident, sent_idx, token_idx and the ten columns) of CoNLL-U texts.

    Sentences are cut within each document, so no document meets another.
    """
    blocks = F.filter(F.split(F.regexp_replace(column, "\r", ""), r"\n[ \t]*\n+", -1), lambda b: F.trim(b) != "")
    sents = docs.select(ident, F.posexplode(blocks).alias("sent_idx", "_b")).withColumn("_lines", F.filter(F.split("_b", "\n"), lambda x: F.trim(x) != ""))
    meta = F.filter("_lines", lambda x: x.startswith("#"))
    pairs = F.transform(meta, lambda x: F.split(F.regexp_replace(x, r"^#\s*", ""), r"\s*=\s*", 2))
    given = F.filter(pairs, lambda p: F.size(p) == 2)
    # Of a repeated key the last value counts.
    last = F.filter(given, lambda p, i: ~F.exists(F.slice(given, i + 2, F.size(given)), lambda q: q[0] == p[0]))
    as_map = F.map_from_entries(F.transform(last, lambda p: F.struct(p[0], p[1])))
    sentences = sents.select(ident, "sent_idx", as_map.alias("metadata"))
    rows = sents.select(ident, "sent_idx", F.posexplode(F.filter("_lines", lambda x: ~x.startswith("#"))).alias("token_idx", "_l"))
    parts = F.split("_l", "\t", -1)
    tokens = rows.select(ident, "sent_idx", "token_idx", *[F.nullif(F.get(parts, F.lit(i)), F.lit("_")).alias(n) for i, n in enumerate(CONLLU)])
    return sentences, tokens


def emit_conllu(sentences: DataFrame, tokens: DataFrame, ident: str = "doc_id") -> DataFrame:
    """ident and the CoNLL-U text of its sentences, in order: one grouping of all lines by document, no join."""
    line = F.concat_ws("\t", *[F.coalesce(F.col(n), F.lit("_")) for n in CONLLU])
    heads = F.array_join(F.transform(F.sort_array(F.map_entries("metadata")), lambda e: F.concat(F.lit("# "), e["key"], F.lit(" = "), e["value"])), "\n")
    first = sentences.select(ident, F.struct(F.col("sent_idx").cast("long").alias("s"), F.lit(-1).cast("long").alias("t"), F.coalesce(heads, F.lit("")).alias("l")).alias("x"))
    lines = tokens.select(ident, F.struct(F.col("sent_idx").cast("long").alias("s"), F.col("token_idx").cast("long").alias("t"), line.alias("l")).alias("x"))
    whole = first.unionByName(lines).groupBy(ident).agg(F.sort_array(F.collect_list("x")).alias("xs"))

    def joined(x, i):
        before = F.get("xs", i - 1)
        gap = F.when(i == 0, "").when(before["s"] != x["s"], "\n\n").when(before["l"] == "", "").otherwise("\n")
        return F.concat(gap, x["l"])

    return whole.select(ident, F.concat(F.array_join(F.transform("xs", joined), ""), F.lit("\n\n")).alias("text"))


def sentences_of(docs: DataFrame, ident: str = "doc_id", column: str = "text") -> tuple[DataFrame, DataFrame]:
    """Plain texts as sentence and token tables: a line is a sentence, and its words are its tokens."""
    sents = docs.select(ident, F.posexplode(F.split(column, "\n")).alias("sent_idx", "_s"))
    rows = sents.select(ident, "sent_idx", F.posexplode(F.filter(F.split("_s", r"[\x20\x09-\x0D]+"), lambda w: w != "")).alias("token_idx", "FORM"))
    tokens = rows.select(ident, "sent_idx", "token_idx", (F.col("token_idx") + 1).cast("string").alias("ID"), "FORM", *[F.lit(None).cast("string").alias(n) for n in CONLLU[2:]])
    return sents.select(ident, "sent_idx", F.create_map(F.lit("sent_id"), F.col("sent_idx").cast("string")).alias("metadata")), tokens.select(ident, "sent_idx", "token_idx", *CONLLU)


def running_index(df: DataFrame, starts, partition: str, order: str) -> DataFrame:
    """A running count of rows that start something, within each partition."""
    return df.withColumn("index", F.sum(F.when(starts, 1).otherwise(0)).over(Window.partitionBy(partition).orderBy(order)))
