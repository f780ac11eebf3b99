"""Mappings between schemas: building, checking, compiling, composing, inverting, searching.

All of this is metadata on the driver. A compiled mapping is what the operators turn into one DataFrame plan.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field, replace

from ..schema import Edge, Schema, edge_key


class MigrationError(ValueError):
    """A mapping that cannot be compiled, composed or inverted."""


@dataclass(frozen=True)
class Migration:
    """``vertex_map`` and ``edge_map`` go from source to target; ``resolver`` names the edge that replaces a contracted path."""

    vertex_map: dict = field(default_factory=dict)
    edge_map: dict = field(default_factory=dict)
    hyper_edge_map: dict = field(default_factory=dict)
    label_map: dict = field(default_factory=dict)  # (hyper edge, label) -> label
    resolver: dict = field(default_factory=dict)  # (target vertex, target vertex) -> Edge
    hyper_resolver: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Compiled:
    """What the operators need: survivors and maps in the target's names, transforms by target vertex, survival predicates by source vertex."""

    survivors: frozenset
    edges: frozenset
    vertex_map: dict
    edge_map: dict = field(default_factory=dict)
    resolver: dict = field(default_factory=dict)
    hyper_edge_map: dict = field(default_factory=dict)
    hyper_edges: dict = field(default_factory=dict)
    transforms: dict = field(default_factory=dict)  # target vertex -> list of transforms
    survival: dict = field(default_factory=dict)  # source vertex -> expression

    def target(self, v: str) -> str:
        return self.vertex_map.get(v, v)

    def survives(self, v: str) -> bool:
        return self.target(v) in self.survivors

    def edge_between(self, a: str, b: str) -> Edge | str:
        """The target edge from ``a`` to ``b``, or why there is none."""
        if (a, b) in self.resolver:
            return self.resolver[a, b]
        found = sorted((e for e in self.edges if (e.src, e.tgt) == (a, b)), key=edge_key)
        return found[0] if len(found) == 1 else "AmbiguousEdge" if found else "NoEdgeFound"

    def with_transforms(self, vertex: str, *transforms) -> Compiled:
        return replace(self, transforms={**self.transforms, vertex: [*self.transforms.get(vertex, []), *transforms]})

    def with_survival(self, vertex: str, expression) -> Compiled:
        return replace(self, survival={**self.survival, vertex: expression})


def identity(s: Schema) -> Migration:
    return Migration({v: v for v in s.vertices}, {e: e for e in s.edges}, {h: h for h in s.hyper_edges})


def to_rows(m: Migration) -> list[tuple[str, str, str]]:
    """A mapping as data: (what, source, target) rows, so that it can be kept in a table."""
    import json

    edge = lambda e: json.dumps([e.src, e.tgt, e.kind, e.name])
    out = [("vertex", a, b) for a, b in m.vertex_map.items()] + [("edge", edge(a), edge(b)) for a, b in m.edge_map.items()]
    out += [("hyper_edge", a, b) for a, b in m.hyper_edge_map.items()] + [("resolver", json.dumps(list(k)), edge(e)) for k, e in m.resolver.items()]
    return sorted(out)


def from_rows(rows) -> Migration:
    """The mapping that such rows describe."""
    import json

    edge = lambda t: Edge(*json.loads(t))
    by: dict = {"vertex": {}, "edge": {}, "hyper_edge": {}, "resolver": {}}
    for what, a, b in rows:
        by[what][edge(a) if what == "edge" else tuple(json.loads(a)) if what == "resolver" else a] = edge(b) if what in ("edge", "resolver") else b
    return Migration(by["vertex"], by["edge"], by["hyper_edge"], {}, by["resolver"])


class MigrationBuilder:
    def __init__(self):
        self.m = Migration()

    def map(self, a: str, b: str) -> MigrationBuilder:
        self.m = replace(self.m, vertex_map={**self.m.vertex_map, a: b})
        return self

    def map_edge(self, a: Edge, b: Edge) -> MigrationBuilder:
        self.m = replace(self.m, edge_map={**self.m.edge_map, a: b})
        return self

    def resolve(self, a: str, b: str, e: Edge) -> MigrationBuilder:
        self.m = replace(self.m, resolver={**self.m.resolver, (a, b): e})
        return self

    def build(self) -> Migration:
        return self.m


def compile_migration(src: Schema, tgt: Schema, m: Migration) -> Compiled:
    """Survivors are the image of the vertex map; target edges between survivors count too. A kind change with a coercion converts the value."""
    if bad := [v for v in m.vertex_map if v not in src.vertices]:
        raise MigrationError(f"not in the source: {sorted(bad)}")
    if bad := [v for v in m.vertex_map.values() if v not in tgt.vertices]:
        raise MigrationError(f"not in the target: {sorted(set(bad))}")
    survivors = frozenset(m.vertex_map.values())
    edges = frozenset(m.edge_map.values()) | {e for e in tgt.edges if e.src in survivors and e.tgt in survivors}
    transforms = {}
    for a, b in m.vertex_map.items():
        ka, kb = src.vertices[a], tgt.vertices[b]
        if ka != kb and (c := tgt.coercions.get((ka, kb)) or src.coercions.get((ka, kb))):
            transforms.setdefault(b, []).append(("apply", "__value__", c.forward, c.inverse))
    return Compiled(survivors, edges, dict(m.vertex_map), dict(m.edge_map), dict(m.resolver), dict(m.hyper_edge_map), dict(tgt.hyper_edges), transforms)


def compose(f: Migration, g: Migration) -> Migration:
    """First ``f``, then ``g``; what ``g`` does not map is lost."""
    return Migration(
        {a: g.vertex_map[b] for a, b in f.vertex_map.items() if b in g.vertex_map},
        {a: g.edge_map[b] for a, b in f.edge_map.items() if b in g.edge_map},
        {a: g.hyper_edge_map[b] for a, b in f.hyper_edge_map.items() if b in g.hyper_edge_map},
        {(h, x): g.label_map.get((f.hyper_edge_map.get(h, h), y), y) for (h, x), y in f.label_map.items()},
        {**{(g.vertex_map[a], g.vertex_map[b]): g.edge_map.get(e, e) for (a, b), e in f.resolver.items() if a in g.vertex_map and b in g.vertex_map}, **g.resolver},
        {**f.hyper_resolver, **g.hyper_resolver},
    )


def invert(m: Migration, src: Schema, tgt: Schema) -> Migration:
    """The way back, if ``m`` is a bijection on vertices, edges and hyper-edges."""
    for name, way, a, b in (("vertices", m.vertex_map, set(src.vertices), set(tgt.vertices)), ("edges", m.edge_map, set(src.edges), set(tgt.edges)), ("hyper-edges", m.hyper_edge_map, set(src.hyper_edges), set(tgt.hyper_edges))):
        if len(set(way.values())) < len(way):
            raise MigrationError(f"two {name} go to one")
        if set(way) != a or set(way.values()) != b:
            raise MigrationError(f"not all {name} are mapped")
    back = {v: k for k, v in m.vertex_map.items()}
    return Migration(back, {v: k for k, v in m.edge_map.items()}, {v: k for k, v in m.hyper_edge_map.items()}, {}, {(back[a], back[b]): e for (a, b), e in m.resolver.items()})


#: Constraints of which a smaller value is tighter, and of which a larger one is. Fixed values.
UPPER = {"maxLength", "maximum", "maxGraphemes", "maxSize", "exclusiveMaximum", "maxItems"}
LOWER = {"minLength", "minimum", "minGraphemes", "exclusiveMinimum", "minItems"}


def tightened(sort: str, old: str, new: str, unknown: bool) -> bool:
    """Is ``new`` more restrictive? ``unknown`` is the answer for values that are no numbers and for other sorts."""
    try:
        a, b = float(old), float(new)
    except ValueError:
        return unknown and old != new
    if sort in UPPER:
        return b < a
    if sort in LOWER:
        return b > a
    return unknown and old != new


def check_existence(src: Schema, tgt: Schema, m: Migration) -> list[tuple[str, str]]:
    """Why data cannot follow ``m``: (kind, detail) of each problem, warnings included."""
    out = []
    for a, b in sorted(m.vertex_map.items()):
        if a not in src.vertices or b not in tgt.vertices:
            out.append(("WellFormedness", f"{a} -> {b} leaves the schemas"))
            continue
        if src.vertices[a] != tgt.vertices[b]:
            known = (src.vertices[a], tgt.vertices[b]) in {**src.coercions, **tgt.coercions}
            out.append(("KindInconsistencyWarning" if known else "KindInconsistency", f"{a}: {src.vertices[a]} -> {b}: {tgt.vertices[b]}"))
        for sort, new in sorted(tgt.constraints.get(b, {}).items()):
            old = src.constraints.get(a, {}).get(sort)
            if old is not None and tightened(sort, old, new, False):
                out.append(("ConstraintTightened", f"{b}.{sort}: {old} -> {new}"))
    for a, b in sorted(m.edge_map.items(), key=lambda x: edge_key(x[0])):
        if a not in src.edges or b not in tgt.edges:
            out.append(("EdgeMissing", f"{a.label} -> {b.label}"))
        elif (m.vertex_map.get(a.src), m.vertex_map.get(a.tgt)) != (b.src, b.tgt):
            out.append(("WellFormedness", f"edge {a.label} does not follow its vertices"))
    for v, es in sorted(tgt.required.items()):
        if v in m.vertex_map.values():
            for e in sorted(es, key=edge_key):
                if e not in m.edge_map.values() and not any(m.vertex_map.get(x.src) == e.src and m.vertex_map.get(x.tgt) == e.tgt for x in src.edges):
                    out.append(("RequiredFieldMissing", f"{v}.{e.label}"))
    for (a, b), e in sorted(m.resolver.items()):
        if a not in tgt.vertices or b not in tgt.vertices or (e.src, e.tgt) != (a, b):
            out.append(("ResolverInvalid", f"{a} -> {b}"))
    for h, k in sorted(m.hyper_edge_map.items()):
        sig_a, sig_b = src.hyper_edges[h].labels, tgt.hyper_edges[k].labels
        for label, v in sorted(sig_a.items()):
            to = m.label_map.get((h, label), label)
            if to in sig_b and m.vertex_map.get(v) != sig_b[to]:
                out.append(("SignatureCoherence", f"{h}.{label}"))
        if lost := [x for x in sig_b if x not in {m.label_map.get((h, y), y) for y in sig_a}]:
            out.append(("Simultaneity", f"{k} lacks {', '.join(sorted(lost))}"))
    reached, todo = set(), [m.vertex_map[r] for r in src.roots() if r in m.vertex_map]
    while todo:
        v = todo.pop()
        if v not in reached:
            reached.add(v)
            todo += [e.tgt for e in tgt.outgoing(v)]
    out += [("ReachabilityRisk", v) for v in sorted(set(m.vertex_map.values()) - reached)]
    return out


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _alike(a: str, b: str) -> float:
    return 1 - _distance(a, b) / max(len(a), len(b), 1)


@dataclass(frozen=True, order=True)
class Found:
    quality: float
    pairs: tuple = ()

    @property
    def vertex_map(self) -> dict:
        return dict(self.pairs)


def score(src: Schema, tgt: Schema, way: dict) -> float:
    """0.25 names, 0.25 edges kept, 0.3 alike neighbourhoods, 0.2 alike degrees. Fixed weights."""
    if not way:
        return 0.0
    names = sum(_alike(a.rpartition(".")[2], b.rpartition(".")[2]) for a, b in way.items()) / len(way)
    own = [e for e in src.edges if e.src in way and e.tgt in way]
    kept = sum(any(x.kind == e.kind and x.name == e.name for x in tgt.between(way[e.src], way[e.tgt])) for e in own) / len(own) if own else 1.0
    labels = lambda s, v: {e.label.rpartition(".")[2] for e in s.outgoing(v)}
    jaccard = sum(len(labels(src, a) & labels(tgt, b)) / len(labels(src, a) | labels(tgt, b)) if labels(src, a) | labels(tgt, b) else 1.0 for a, b in way.items()) / len(way)
    degree = lambda s, v: len(s.outgoing(v)) + len(s.incoming(v))
    degrees = sum(1 / (1 + abs(degree(src, a) - degree(tgt, b))) for a, b in way.items()) / len(way)
    return 0.25 * names + 0.25 * kept + 0.3 * jaccard + 0.2 * degrees


def find_morphisms(src: Schema, tgt: Schema, monic=False, epic=False, iso=False, anchors: dict | None = None, max_results: int = 0, allowed=None) -> list[Found]:
    """Total maps of vertices that keep kinds and edges, best first. Backtracking, most constrained vertex first, with forward checking."""
    domains = {}
    for v, kind in src.vertices.items():
        dom = [w for w, k in sorted(tgt.vertices.items()) if k == kind and (allowed is None or allowed(v, w))]
        domains[v] = [anchors[v]] if anchors and v in anchors else sorted(dom, key=lambda w: (-_alike(v, w), w))
    best: list[Found] = []

    def compatible(a, w, b, x):
        return all(any(y.kind == e.kind and y.name == e.name for y in tgt.between(w, x)) for e in src.between(a, b)) and all(any(y.kind == e.kind and y.name == e.name for y in tgt.between(x, w)) for e in src.between(b, a))

    def go(way, left):
        if not left:
            if (epic or iso) and set(way.values()) != set(tgt.vertices):
                return
            found = Found(score(src, tgt, way), tuple(sorted(way.items())))
            (heapq.heappush if not max_results or len(best) < max_results else heapq.heappushpop)(best, found)
            return
        v = min(left, key=lambda x: (len(left[x]), x))
        for w in left[v]:
            if not compatible(v, w, v, w):
                continue
            rest = {b: [x for x in dom if (not (monic or iso) or x != w) and compatible(v, w, b, x)] for b, dom in left.items() if b != v}
            if all(rest.values()):
                go({**way, v: w}, rest)

    go({}, domains)
    return sorted(best, key=lambda f: (-f.quality, f.pairs))


def to_migration(src: Schema, tgt: Schema, way: dict) -> Migration:
    """A vertex map with the edges it carries along."""
    edges = {}
    for e in sorted(src.edges, key=edge_key):
        if e.src in way and e.tgt in way:
            found = tgt.between(way[e.src], way[e.tgt])
            alike = [x for x in found if x.kind == e.kind and x.name == e.name] or found
            if alike:
                edges[e] = alike[0]
    return Migration(dict(way), edges, {h: h for h in src.hyper_edges if h in tgt.hyper_edges})


def auto_migration(old: Schema, new: Schema) -> Migration:
    """Identity on what both have; edges match by ends and name."""
    same = {v: v for v in old.vertices if v in new.vertices}
    return to_migration(old, new, same)


def rename_candidates(old: Schema, new: Schema, least: float = 0.5) -> list[tuple[str, str, float]]:
    """Removed and added vertices that look alike: 0.3 kind, 0.3 outgoing, 0.2 incoming edges, 0.2 a name within three edits. Best first, each once."""
    gone, come = set(old.vertices) - set(new.vertices), set(new.vertices) - set(old.vertices)

    def alike(a, b):
        x, y = {(e.kind, e.name) for e in a}, {(e.kind, e.name) for e in b}
        return len(x & y) / len(x | y) if x | y else 1.0

    scored = [(0.3 * (old.vertices[a] == new.vertices[b]) + 0.3 * alike(old.outgoing(a), new.outgoing(b)) + 0.2 * alike(old.incoming(a), new.incoming(b)) + 0.2 * (_distance(a, b) <= 3), a, b) for a in gone for b in come]
    out, used = [], set()
    for s, a, b in sorted(scored, key=lambda x: (-x[0], x[1], x[2])):
        if s >= least and a not in used and b not in used:
            out.append((a, b, s))
            used |= {a, b}
    return out
