"""Schema languages: protocols, and reading and writing the ones that have a natural Spark type."""

from __future__ import annotations

import json
import re

from pyspark.sql import types as T

from ..schema import ARRAYS, Edge, EdgeRule, Protocol, Schema, SchemaBuilder, SchemaError


class LanguageError(ValueError):
    """Text that is not a schema of its language."""


def _protocol(name, shape="tree", reader=None, kinds=(), rules=(), sorts=()):
    return Protocol(name, frozenset(kinds), tuple(EdgeRule(k, frozenset(a), frozenset(b)) for k, a, b in rules), frozenset(sorts), shape, reader)


_PROP = [("prop", (), ()), ("item", (), ()), ("variant", (), ()), ("ref", (), ())]
#: Protocols by how their instances are read. Fixed values.
PROTOCOLS = {
    p.name: p
    for p in [
        *(_protocol(n, "tree", "json") for n in ("bead", "brat", "concrete", "decomp", "fovea", "nif", "ucca", "asyncapi", "jsonapi", "openapi", "raml", "ansible", "cloudformation", "bson", "cddl", "mongodb", "fhir", "geojson", "atproto")),
        *(_protocol(n, "tables", "json") for n in ("arrow", "dataframe", "parquet", "cassandra", "dynamodb", "asn1", "avro", "bond", "flatbuffers")),
        *(_protocol(n, "graph", "json") for n in ("neo4j",)),
        *(_protocol(n, "tree", "xml") for n in ("elan", "folia", "naf", "paula", "tei", "timeml", "docx", "odf")),
        *(_protocol(n, "tables", "tsv") for n in ("amr",)),
        _protocol("conllu", "tables", "conllu"),
        _protocol("redis", "tables", "table:space"),
        _protocol("swift-mt", "tables", "table::"),
        _protocol("edi-x12", "tables", "table:*"),
        *(_protocol(n, "tree", None) for n in ("iso-space", "laf-graf", "uima-cas", "web-annotation", "k8s-crd", "rss-atom", "vcard-ical", "raw_file", "msgpack-schema")),
        _protocol("sql", "tables", "csv"),
        _protocol("jsonschema", "tree", "json"),
    ]
}


def protocol(name: str) -> Protocol:
    if name not in PROTOCOLS:
        raise LanguageError(f"no protocol {name}")
    return PROTOCOLS[name]


def define(p: Protocol) -> Protocol:
    """Register a protocol of one's own."""
    PROTOCOLS[p.name] = p
    return p


#: JSON Schema constraints that a schema keeps. Fixed values.
JSON_SORTS = ("maxLength", "minLength", "maximum", "minimum", "exclusiveMaximum", "exclusiveMinimum", "maxGraphemes", "minGraphemes", "maxItems", "minItems", "maxSize", "pattern", "format", "enum", "const", "default")


def read_json_schema(doc: dict | str, root: str = "root", name: str = "jsonschema") -> Schema:
    """JSON Schema (and the schemas of OpenAPI and lexicons): objects, arrays, local references, alternatives, constraints, required."""
    doc = json.loads(doc) if isinstance(doc, str) else doc
    b, made = SchemaBuilder(Protocol(name)), {}

    def look(ref: str) -> dict:
        if not ref.startswith("#/"):
            raise LanguageError(f"a reference outside the document: {ref}")
        at = doc
        for part in ref[2:].split("/"):
            at = at[part.replace("~1", "/").replace("~0", "~")]
        return at

    def visit(d: dict, at: str) -> str:
        if "$ref" in d:
            ref = d["$ref"]
            if ref not in made:
                made[ref] = ref.rpartition("/")[2]
                visit(look(ref), made[ref])
            return made[ref]
        kind = d.get("type", "object" if "properties" in d else "union" if "oneOf" in d or "anyOf" in d else "any")
        kind = next((k for k in kind if k != "null"), "null") if isinstance(kind, list) else kind
        b.vertex(at, kind)
        for s in JSON_SORTS:
            if s in d:
                b.constraint(at, s, d[s] if not isinstance(d[s], (list, dict)) else json.dumps(d[s]))
        for n, sub in d.get("properties", {}).items():
            child = visit(sub, f"{at}.{n}")
            b.edge(at, child, "prop", n)
            if n in d.get("required", []):
                b.required(at, Edge(at, child, "prop", n))
        if kind == "array" and isinstance(d.get("items"), dict):
            b.edge(at, visit(d["items"], f"{at}:items"), "item", None)
        for i, sub in enumerate(d.get("oneOf", d.get("anyOf", []))):
            child = visit(sub, f"{at}:v{i}")
            b.edge(at, child, "variant", f"v{i}")
            b.part("variants", child, (at, f"v{i}"))
        return at

    visit(doc, root)
    return b.build()


def write_json_schema(s: Schema, root: str = "root") -> dict:
    def emit(v: str, seen=()) -> dict:
        if v in seen:
            return {"$ref": f"#/$defs/{v}"}
        kind, out = s.vertices[v], {}
        if kind not in ("any", "union"):
            out["type"] = kind
        for sort, x in sorted(s.constraints.get(v, {}).items()):
            try:
                out[sort] = json.loads(x)
            except ValueError:
                out[sort] = x
        props = {e.label: emit(e.tgt, (*seen, v)) for e in s.outgoing(v) if e.kind == "prop"}
        if props:
            out["properties"] = props
        if need := sorted(e.label for e in s.required.get(v, ())):
            out["required"] = need
        for e in s.outgoing(v):
            if e.kind == "item":
                out["items"] = emit(e.tgt, (*seen, v))
        if alts := [emit(e.tgt, (*seen, v)) for e in s.outgoing(v) if e.kind == "variant"]:
            out["oneOf"] = alts
        return out

    return emit(root)


def from_struct(t: T.StructType, root: str = "root", name: str = "dataframe") -> Schema:
    """A Spark type (and so a Parquet, Arrow or Avro file's) as a schema."""
    b = SchemaBuilder(Protocol(name))

    def visit(at: str, d: T.DataType):
        if isinstance(d, T.StructType):
            b.vertex(at, "object")
            for f in d.fields:
                visit(f"{at}.{f.name}", f.dataType)
                b.edge(at, f"{at}.{f.name}", "prop", f.name)
                if not f.nullable:
                    b.required(at, Edge(at, f"{at}.{f.name}", "prop", f.name))
        elif isinstance(d, T.ArrayType):
            b.vertex(at, "array")
            visit(f"{at}:items", d.elementType)
            b.edge(at, f"{at}:items", "item", None)
        else:
            b.vertex(at, _KIND_OF.get(d.simpleString().partition("(")[0], d.simpleString()))

    visit(root, t)
    return b.build()


_KIND_OF = {"string": "string", "tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", "float": "float32", "double": "float64", "boolean": "bool", "binary": "binary", "decimal": "decimal128", "date": "date32", "timestamp_ntz": "timestamp", "timestamp": "timestamp", "interval day to second": "duration"}
#: Avro's primitive types as kinds. Fixed values.
AVRO = {"null": "null", "boolean": "boolean", "int": "int32", "long": "int64", "float": "float32", "double": "float64", "bytes": "binary", "string": "string"}


def read_avro(doc: dict | str) -> Schema:
    doc = json.loads(doc) if isinstance(doc, str) else doc
    b, named = SchemaBuilder(Protocol("avro")), {}

    def visit(d, at: str) -> tuple[str, bool]:
        """The vertex, and whether it may be null."""
        if isinstance(d, list):
            rest = [x for x in d if x != "null"]
            if len(rest) == 1:
                return visit(rest[0], at)[0], True
            b.vertex(at, "union")
            for i, x in enumerate(rest):
                b.edge(at, visit(x, f"{at}:v{i}")[0], "variant", f"v{i}")
            return at, "null" in d
        if isinstance(d, str):
            if d in named:
                return named[d], False
            b.vertex(at, AVRO.get(d, d))
            return at, d == "null"
        kind = d["type"]
        if kind in ("record", "error"):
            named[d["name"]] = at
            b.vertex(at, "record")
            for f in d["fields"]:
                child, optional = visit(f["type"], f"{at}.{f['name']}")
                b.edge(at, child, "prop", f["name"])
                if not optional and "default" not in f:
                    b.required(at, Edge(at, child, "prop", f["name"]))
                if f.get("default") is not None:
                    b.constraint(child, "default", json.dumps(f["default"]))
        elif kind == "array":
            b.vertex(at, "array")
            b.edge(at, visit(d["items"], f"{at}:items")[0], "item", None)
        elif kind == "map":
            b.vertex(at, "map")
            b.edge(at, visit(d["values"], f"{at}:values")[0], "value", None)
        elif kind in ("enum", "fixed"):
            named[d["name"]] = at
            b.vertex(at, kind)
            b.constraint(at, "symbols" if kind == "enum" else "size", ",".join(d["symbols"]) if kind == "enum" else d["size"])
        else:
            return visit(kind, at)
        return at, False

    visit(doc, doc["name"] if isinstance(doc, dict) and "name" in doc else "root")
    return b.build()


def write_avro(s: Schema, root: str) -> dict:
    back = {v: k for k, v in AVRO.items()}

    def emit(v: str):
        kind, out = s.vertices[v], s.outgoing(v)
        if kind == "record":
            need = s.required.get(v, frozenset())
            fields = []
            for e in out:
                t = emit(e.tgt)
                default = s.constraints.get(e.tgt, {}).get("default")
                fields.append({"name": e.label, "type": t if e in need or default is not None else ["null", t]} | ({"default": json.loads(default)} if default is not None else {}))
            return {"type": "record", "name": v, "fields": fields}
        if kind == "array":
            return {"type": "array", "items": emit(out[0].tgt)}
        if kind == "map":
            return {"type": "map", "values": emit(out[0].tgt)}
        if kind == "enum":
            return {"type": "enum", "name": v, "symbols": s.constraints[v]["symbols"].split(",")}
        if kind == "fixed":
            return {"type": "fixed", "name": v, "size": int(s.constraints[v]["size"])}
        if kind == "union":
            return [emit(e.tgt) for e in out]
        return back.get(kind, kind)

    return emit(root)


_TABLE = re.compile(r"create\s+table\s+(?:if\s+not\s+exists\s+)?[`\"]?([\w.]+)[`\"]?\s*\((.*?)\)\s*(?:with\b[^;]*)?(?:;|\Z)", re.I | re.S)
_SPLIT = re.compile(r",(?![^()<>]*[)>])")
#: SQL types as kinds; sized types keep their size as a constraint. Fixed values.
SQL_KINDS = {"integer": "int32", "int": "int32", "serial": "int32", "bigint": "int64", "smallint": "int16", "tinyint": "int8", "varchar": "string", "char": "string", "text": "string", "ascii": "string", "boolean": "boolean", "bool": "boolean", "real": "float32", "float": "float32", "double": "float64", "decimal": "decimal", "numeric": "decimal", "date": "date", "timestamp": "timestamp", "timestamptz": "timestamp", "blob": "binary", "bytea": "binary", "uuid": "uuid", "json": "any", "jsonb": "any", "varint": "varint", "counter": "int64"}


def read_sql(text: str, name: str = "sql") -> Schema:
    """CREATE TABLE statements (SQL or CQL): a table is an object, its columns are properties, references are ref edges."""
    b, refs, found = SchemaBuilder(Protocol(name)), [], False
    text = re.sub(r"--[^\n]*", "", text)
    for table, body in _TABLE.findall(text):
        found = True
        b.vertex(table, "table")
        for part in map(str.strip, _SPLIT.split(body)):
            low = part.lower()
            if m := re.match(r"(?:constraint\s+\w+\s+)?foreign\s+key\s*\(\s*(\w+)\s*\)\s*references\s+(\w+)\s*(?:\(\s*(\w+)\s*\))?", low):
                refs.append((table, m[2], m[1]))
            elif m := re.match(r"(?:constraint\s+\w+\s+)?primary\s+key\s*\(\s*\(?([\w\s,()]+?)\)?\s*\)$", low):
                b.constraint(table, "primaryKey", ",".join(x.strip(" ()") for x in m[1].split(",")))
            elif part and not re.match(r"(unique|check|index|key)\b", low):
                m = re.match(r"[`\"]?(\w+)[`\"]?\s+([\w]+)\s*(?:<([^>]*)>)?\s*(?:\(\s*([\d\s,]+)\s*\))?(.*)$", part, re.S)
                if not m:
                    raise LanguageError(f"no column: {part!r}")
                col, kind, inner, size, rest = m.groups()
                at = f"{table}.{col}"
                b.vertex(at, SQL_KINDS.get(kind.lower(), kind.lower()))
                b.edge(table, at, "prop", col)
                if inner:
                    b.constraint(at, "of", inner.strip())
                if size:
                    b.constraint(at, "maxLength" if kind.lower() in ("varchar", "char") else "precision", size.replace(" ", ""))
                rest = rest.lower()
                if "not null" in rest or "primary key" in rest:
                    b.required(table, Edge(table, at, "prop", col))
                if "primary key" in rest:
                    b.constraint(table, "primaryKey", col)
                if "unique" in rest:
                    b.constraint(at, "unique", "true")
                if d := re.search(r"default\s+('[^']*'|[\w.+-]+)", rest):
                    b.constraint(at, "default", d[1])
                if r := re.search(r"references\s+(\w+)", rest):
                    refs.append((table, r[1], col))
    if not found:
        raise LanguageError("no CREATE TABLE")
    for table, to, col in refs:
        b.edge(table, to, "ref", col)
    return b.build()


def write_sql(s: Schema) -> str:
    back = {"int32": "INTEGER", "int64": "BIGINT", "int16": "SMALLINT", "int8": "TINYINT", "string": "TEXT", "boolean": "BOOLEAN", "float32": "REAL", "float64": "DOUBLE", "decimal": "DECIMAL", "date": "DATE", "timestamp": "TIMESTAMP", "binary": "BLOB", "uuid": "UUID"}
    out = []
    for t in sorted(v for v, k in s.vertices.items() if k == "table"):
        lines, need = [], s.required.get(t, frozenset())
        for e in s.outgoing(t):
            if e.kind != "prop":
                continue
            c = s.constraints.get(e.tgt, {})
            kind = f"VARCHAR({c['maxLength']})" if "maxLength" in c else back.get(s.vertices[e.tgt], s.vertices[e.tgt].upper())
            lines.append(f"  {e.label} {kind}" + " NOT NULL" * (e in need) + " UNIQUE" * ("unique" in c) + (f" DEFAULT {c['default']}" if "default" in c else ""))
        if key := s.constraints.get(t, {}).get("primaryKey"):
            lines.append(f"  PRIMARY KEY ({key})")
        lines += [f"  FOREIGN KEY ({e.name}) REFERENCES {e.tgt}" for e in s.outgoing(t) if e.kind == "ref"]
        out.append(f"CREATE TABLE {t} (\n" + ",\n".join(lines) + "\n);")
    return "\n".join(out) + "\n"


def checks(s: Schema, root: str) -> dict:
    """A record type's constraints and required fields as conditions on a struct column ``record``."""
    from pyspark.sql import functions as F

    out = {}
    for e in s.outgoing(root):
        c = F.col(f"record.`{e.label}`")
        if e in s.required.get(root, frozenset()):
            out[f"required_{e.label}"] = c.isNotNull()
        for sort, x in sorted(s.constraints.get(e.tgt, {}).items()):
            test = {"maxLength": lambda: F.octet_length(c) <= int(x), "minLength": lambda: F.octet_length(c) >= int(x), "maxGraphemes": lambda: F.char_length(c) <= int(x), "minGraphemes": lambda: F.char_length(c) >= int(x), "maximum": lambda: c <= float(x), "minimum": lambda: c >= float(x), "enum": lambda: c.isin(json.loads(x)), "pattern": lambda: c.rlike(x)}.get(sort)
            if test and s.vertices[e.tgt] not in ARRAYS:
                out[f"{sort}_{e.label}"] = c.isNull() | test()
    return out


__all__ = ["LanguageError", "SchemaError", "checks", "define", "from_struct", "protocol", "read_avro", "read_json_schema", "read_sql", "write_avro", "write_json_schema", "write_sql"]
