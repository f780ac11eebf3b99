"""Schemas: typed multigraphs with constraints, and what can be done with them on the driver.

Schemas are small metadata. ``to_frames`` gives the same content as tables, for queries over many versions.
"""

from __future__ import annotations

import json
from collections import defaultdict
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class SchemaError(ValueError):
    """A schema that its protocol does not allow."""


@dataclass(frozen=True, order=True)
class Edge:
    src: str
    tgt: str
    kind: str = "prop"
    name: str | None = None

    @property
    def label(self) -> str:
        """The key under which a record holds the target."""
        return self.name if self.name is not None else self.tgt


@dataclass(frozen=True)
class HyperEdge:
    id: str
    kind: str
    signature: tuple[tuple[str, str], ...]  # label, vertex
    parent_label: str

    @property
    def labels(self) -> dict[str, str]:
        return dict(self.signature)


@dataclass(frozen=True)
class EdgeRule:
    """Which vertex kinds an edge kind may connect; empty means any."""

    kind: str
    src: frozenset = frozenset()
    tgt: frozenset = frozenset()


@dataclass(frozen=True)
class Protocol:
    name: str
    kinds: frozenset = frozenset()  # empty: any
    rules: tuple[EdgeRule, ...] = ()
    constraint_sorts: frozenset = frozenset()
    shape: str = "tree"  # tree, tables or graph
    reader: str | None = None

    def rule(self, kind: str) -> EdgeRule | None:
        return next((r for r in self.rules if r.kind == kind), None)


OPEN = Protocol("open")
#: From most to least permissive. Fixed values.
USAGE = ("structural", "affine", "linear")
#: Round-trip classes of a coercion, from best to worst. Fixed values.
CLASSES = ("iso", "retraction", "projection", "opaque")


@dataclass(frozen=True)
class Coercion:
    forward: str
    inverse: str | None = None
    round_trip: str = "opaque"


@dataclass(frozen=True)
class Schema:
    protocol: str = "open"
    vertices: dict = field(default_factory=dict)  # id -> kind
    edges: frozenset = frozenset()
    hyper_edges: dict = field(default_factory=dict)  # id -> HyperEdge
    constraints: dict = field(default_factory=dict)  # vertex -> {sort: value}
    required: dict = field(default_factory=dict)  # vertex -> frozenset of edges
    nsids: dict = field(default_factory=dict)
    variants: dict = field(default_factory=dict)  # id -> (parent vertex, tag)
    orderings: dict = field(default_factory=dict)  # edge -> position
    recursion: dict = field(default_factory=dict)  # id -> target vertex
    spans: dict = field(default_factory=dict)  # id -> (left, right)
    usage: dict = field(default_factory=dict)  # edge -> structural, affine or linear
    nominal: dict = field(default_factory=dict)  # vertex -> bool
    coercions: dict = field(default_factory=dict)  # (kind, kind) -> Coercion
    mergers: dict = field(default_factory=dict)  # vertex -> expression text
    defaults: dict = field(default_factory=dict)
    policies: dict = field(default_factory=dict)

    def outgoing(self, v: str) -> list[Edge]:
        return sorted((e for e in self.edges if e.src == v), key=edge_key)

    def incoming(self, v: str) -> list[Edge]:
        return sorted((e for e in self.edges if e.tgt == v), key=edge_key)

    def between(self, a: str, b: str) -> list[Edge]:
        return sorted((e for e in self.edges if (e.src, e.tgt) == (a, b)), key=edge_key)

    def roots(self) -> list[str]:
        targets = {e.tgt for e in self.edges}
        return sorted(v for v in self.vertices if v not in targets)

    def cyclic(self) -> bool:
        return self.depth() is None

    def depth(self) -> int | None:
        """The longest path, or None if there are cycles."""
        out, state = {}, {}

        def visit(v):
            if state.get(v) == "open":
                return None
            if v not in out:
                state[v] = "open"
                below = [visit(e.tgt) for e in self.outgoing(v)]
                state[v] = "done"
                if None in below:
                    return None
                out[v] = 1 + max(below, default=-1)
            return out[v]

        depths = [visit(v) for v in sorted(self.vertices)]
        return None if None in depths else max(depths, default=0)

    def fingerprint(self) -> str:
        import hashlib

        return hashlib.sha256(json.dumps([sorted(self.vertices), len(self.edges)]).encode()).hexdigest()

    def struct(self, root: str) -> T.StructType:
        """The Spark type of a record at ``root``; recursive schemas have none."""
        if self.depth() is None:
            raise SchemaError("a recursive schema has no struct type: use nodes and arcs")
        return _spark_type(self, root, force=True)

    def to_frames(self, spark: SparkSession) -> dict[str, DataFrame]:
        return {
            "vertices": spark.createDataFrame(sorted(self.vertices.items()), "id string, kind string"),
            "edges": spark.createDataFrame([(e.src, e.tgt, e.kind, e.name) for e in sorted(self.edges, key=edge_key)], "src string, tgt string, kind string, name string"),
            "constraints": spark.createDataFrame([(v, s, x) for v, c in sorted(self.constraints.items()) for s, x in sorted(c.items())], "vertex string, sort string, value string"),
        }

    def to_dict(self) -> dict:
        return {
            "protocol": self.protocol,
            "vertices": self.vertices,
            "edges": [[e.src, e.tgt, e.kind, e.name] for e in sorted(self.edges, key=edge_key)],
            "hyper_edges": {k: [h.kind, [list(x) for x in h.signature], h.parent_label] for k, h in self.hyper_edges.items()},
            "constraints": self.constraints,
            "required": {v: [[e.src, e.tgt, e.kind, e.name] for e in sorted(es, key=edge_key)] for v, es in self.required.items()},
            **{k: getattr(self, k) for k in ("nsids", "nominal", "mergers", "defaults", "policies", "recursion")},
            "variants": {k: list(v) for k, v in self.variants.items()},
            "spans": {k: list(v) for k, v in self.spans.items()},
            "orderings": [[[e.src, e.tgt, e.kind, e.name], n] for e, n in self.orderings.items()],
            "usage": [[[e.src, e.tgt, e.kind, e.name], n] for e, n in self.usage.items()],
            "coercions": [[*k, c.forward, c.inverse, c.round_trip] for k, c in self.coercions.items()],
        }

    @staticmethod
    def from_dict(d: dict) -> Schema:
        edge = lambda x: Edge(*x)
        return Schema(
            d["protocol"], dict(d["vertices"]), frozenset(map(edge, d["edges"])),
            {k: HyperEdge(k, kind, tuple(map(tuple, sig)), parent) for k, (kind, sig, parent) in d.get("hyper_edges", {}).items()},
            {k: dict(v) for k, v in d.get("constraints", {}).items()}, {v: frozenset(map(edge, es)) for v, es in d.get("required", {}).items()},
            dict(d.get("nsids", {})), {k: tuple(v) for k, v in d.get("variants", {}).items()}, {edge(e): n for e, n in d.get("orderings", [])},
            dict(d.get("recursion", {})), {k: tuple(v) for k, v in d.get("spans", {}).items()}, {edge(e): n for e, n in d.get("usage", [])},
            dict(d.get("nominal", {})), {(a, b): Coercion(f, i, c) for a, b, f, i, c in d.get("coercions", [])},
            dict(d.get("mergers", {})), dict(d.get("defaults", {})), dict(d.get("policies", {})),
        )


def edge_key(e: Edge):
    return e.src, e.tgt, e.kind, e.name or ""


#: Vertex kinds and their Spark types. Fixed values.
KIND_TYPES = {
    "string": "string", "utf8": "string", "text": "string", "varchar": "string", "large-utf8": "string", "token": "string", "enum": "string", "category": "string", "dictionary": "string", "uuid": "string", "cid-link": "string", "datetime-string": "string",
    "int8": "tinyint", "tinyint": "tinyint", "int16": "smallint", "smallint": "smallint", "int32": "int", "int": "int", "int64": "bigint", "long": "bigint", "bigint": "bigint", "integer": "bigint",
    "uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)",
    "float16": "float", "float32": "float", "float": "float", "float64": "double", "double": "double", "number": "double",
    "bool": "boolean", "boolean": "boolean", "binary": "binary", "bytes": "binary", "blob": "binary", "fixed": "binary",
    "decimal128": "decimal(38,9)", "decimal": "decimal(38,9)", "varint": "decimal(38,0)", "date": "date", "date32": "date", "date64": "date",
    "timestamp": "timestamp_ntz", "datetime": "timestamp_ntz", "duration": "interval day to second", "timedelta": "interval day to second",
}
ARRAYS = {"array", "list", "set"}
OBJECTS = {"object", "record", "struct", "struct-type", "group", "table", "query", "body", "column-family"}


def _spark_type(s: Schema, v: str, force: bool = False) -> T.DataType:
    kind = s.vertices[v]
    out = s.outgoing(v)
    if kind in ARRAYS:
        items = [e for e in out if e.kind in ("item", "items") or e.name in ("item", "items")]
        return T.ArrayType(_spark_type(s, items[0].tgt)) if items else T.ArrayType(T.StringType())
    if out or kind in OBJECTS or force:
        return T.StructType([T.StructField(e.label, _spark_type(s, e.tgt)) for e in out])
    if kind == "decimal256":
        raise SchemaError("decimal256 has no Spark type")
    return T._parse_datatype_string(KIND_TYPES.get(kind, "string"))


class SchemaBuilder:
    """Builds a schema step by step, checked against its protocol."""

    def __init__(self, protocol: Protocol = OPEN):
        self.protocol = protocol
        self.parts: dict = defaultdict(dict)
        self.edges: list[Edge] = []
        self.need: dict = defaultdict(set)

    def vertex(self, name: str, kind: str, nsid: str | None = None) -> SchemaBuilder:
        if name in self.parts["vertices"]:
            raise SchemaError(f"vertex {name} exists")
        if self.protocol.kinds and kind not in self.protocol.kinds and not any(kind in r.src | r.tgt for r in self.protocol.rules):
            raise SchemaError(f"{self.protocol.name} has no vertex kind {kind}")
        self.parts["vertices"][name] = kind
        if nsid:
            self.parts["nsids"][name] = nsid
        return self

    def edge(self, src: str, tgt: str, kind: str = "prop", name: str | None = None) -> SchemaBuilder:
        for v in (src, tgt):
            if v not in self.parts["vertices"]:
                raise SchemaError(f"vertex {v} does not exist")
        rule = self.protocol.rule(kind)
        if self.protocol.rules and rule is None:
            raise SchemaError(f"{self.protocol.name} has no edge kind {kind}")
        if rule:
            for v, allowed in ((src, rule.src), (tgt, rule.tgt)):
                if allowed and self.parts["vertices"][v] not in allowed:
                    raise SchemaError(f"a {kind} edge cannot touch {v}, a {self.parts['vertices'][v]}")
        e = Edge(src, tgt, kind, name)
        if e in self.edges:
            raise SchemaError(f"edge {e} exists")
        self.edges.append(e)
        return self

    def hyper_edge(self, ident: str, kind: str, signature: dict, parent_label: str) -> SchemaBuilder:
        if missing := [v for v in signature.values() if v not in self.parts["vertices"]]:
            raise SchemaError(f"vertices {missing} do not exist")
        if parent_label not in signature:
            raise SchemaError(f"label {parent_label} is not in the signature")
        self.parts["hyper_edges"][ident] = HyperEdge(ident, kind, tuple(sorted(signature.items())), parent_label)
        return self

    def constraint(self, vertex: str, sort: str, value) -> SchemaBuilder:
        self.parts["constraints"].setdefault(vertex, {})[sort] = str(value)
        return self

    def required(self, vertex: str, *edges: Edge) -> SchemaBuilder:
        self.need[vertex] |= set(edges)
        return self

    def part(self, which: str, key, value) -> SchemaBuilder:
        """Any other part: nsids, variants, orderings, recursion, spans, usage, nominal, coercions, mergers, defaults, policies."""
        self.parts[which][key] = value
        return self

    def build(self) -> Schema:
        if not self.parts["vertices"]:
            raise SchemaError("a schema needs a vertex")
        return Schema(protocol=self.protocol.name, edges=frozenset(self.edges), required={v: frozenset(e) for v, e in self.need.items()}, **self.parts)


def validate(s: Schema, p: Protocol) -> list[str]:
    """What a protocol objects to."""
    out = []
    for v, kind in sorted(s.vertices.items()):
        if p.kinds and kind not in p.kinds:
            out.append(f"vertex {v}: unknown kind {kind}")
    for e in sorted(s.edges, key=edge_key):
        if missing := [v for v in (e.src, e.tgt) if v not in s.vertices]:
            out.append(f"edge {e.label}: dangling {', '.join(missing)}")
            continue
        rule = p.rule(e.kind)
        if p.rules and rule is None:
            out.append(f"edge {e.label}: unknown kind {e.kind}")
        elif rule:
            out += [f"edge {e.label}: {w} {v} is a {s.vertices[v]}" for w, v, ok in (("source", e.src, rule.src), ("target", e.tgt, rule.tgt)) if ok and s.vertices[v] not in ok]
    for v, sorts in sorted(s.constraints.items()):
        if v not in s.vertices:
            out.append(f"constraint on unknown vertex {v}")
        out += [f"vertex {v}: unknown constraint {x}" for x in sorted(sorts) if p.constraint_sorts and x not in p.constraint_sorts]
    for v, es in sorted(s.required.items()):
        out += [f"vertex {v}: required edge {e.label} is not in the schema" for e in sorted(es, key=edge_key) if e not in s.edges]
    return out


def normalize(s: Schema) -> Schema:
    """Edges past ``ref`` vertices, which go. Chains are followed; doing it again changes nothing."""
    refs = {v for v, k in s.vertices.items() if k == "ref"}

    def end(v, seen=()):
        out = [e.tgt for e in s.outgoing(v)]
        return end(out[0], (*seen, v)) if v in refs and len(out) == 1 and v not in seen else v

    gone = {v for v in refs if end(v) != v}
    edges = frozenset(replace(e, tgt=end(e.tgt)) for e in s.edges if e.src not in gone)
    return replace(s, vertices={v: k for v, k in s.vertices.items() if v not in gone}, edges=edges, constraints={v: c for v, c in s.constraints.items() if v not in gone}, required={v: frozenset(replace(e, tgt=end(e.tgt)) for e in es) for v, es in s.required.items() if v not in gone})


def pushout(a: Schema, b: Schema, same: dict[str, str]) -> tuple[Schema, dict, dict]:
    """``a`` and ``b`` glued where ``same`` (vertex of b -> vertex of a) says, and the maps into it."""
    to_b = {v: same.get(v, v if v not in a.vertices else f"{v}'") for v in b.vertices}
    to_a = {v: v for v in a.vertices}
    moved = {replace(e, src=to_b[e.src], tgt=to_b[e.tgt]) for e in b.edges}
    constraints = {v: dict(c) for v, c in a.constraints.items()}
    for v, c in b.constraints.items():
        for k, x in c.items():
            constraints.setdefault(to_b[v], {}).setdefault(k, x)
    required = dict(a.required)
    for v, es in b.required.items():
        required[to_b[v]] = required.get(to_b[v], frozenset()) | {replace(e, src=to_b[e.src], tgt=to_b[e.tgt]) for e in es}
    glued = Schema(a.protocol, {**{to_b[v]: k for v, k in b.vertices.items()}, **a.vertices}, a.edges | moved, {**b.hyper_edges, **a.hyper_edges}, constraints, required)
    return glued, to_a, to_b


def overlap(a: Schema, b: Schema) -> dict[str, str]:
    """Vertices that both have under one name and kind (b's -> a's)."""
    return {v: v for v, k in b.vertices.items() if a.vertices.get(v) == k}


def integrate(a: Schema, b: Schema) -> Schema:
    """Both, glued along their overlap."""
    return pushout(a, b, overlap(a, b))[0]
