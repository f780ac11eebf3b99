"""Schema-polymorphic rewrites: steps that apply to any schema that has what they need, and give lenses when they do.

A rewrite knows its precondition, the schema it leads to, the mapping of data, and what data it loses.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from ..schema import Edge, Schema, edge_key
from .compare import diff
from .lens_text import COSTS
from .migration import Compiled, compile_migration, to_migration


class NotApplicable(ValueError):
    """A schema lacks what a rewrite needs."""


@dataclass(frozen=True)
class Rewrite:
    """``op``: add_sort, drop_sort, rename_sort, add_op, drop_op, rename_op, rename_edge_name, add_equation, drop_equation, pullback, coerce_sort, scoped."""

    op: str
    args: tuple = ()

    def needs(self, s: Schema) -> str | None:
        """What is missing, or None."""
        a = self.args
        if self.op in ("drop_sort", "coerce_sort") and a[0] not in s.vertices:
            return f"no vertex {a[0]}"
        if self.op == "rename_sort" and (a[0] not in s.vertices or a[1] in s.vertices):
            return f"cannot rename {a[0]} to {a[1]}"
        if self.op == "add_sort" and a[0] in s.vertices:
            return f"vertex {a[0]} exists"
        if self.op == "add_op" and (a[0] not in s.vertices or a[1] not in s.vertices):
            return f"no vertices {a[0]}, {a[1]}"
        if self.op in ("drop_op", "rename_op", "rename_edge_name") and not any((e.src, e.label) == (a[0], a[1]) for e in s.edges):
            return f"no edge {a[0]}.{a[1]}"
        if self.op == "scoped" and a[0] not in s.vertices:
            return f"no vertex {a[0]}"
        return None

    def target(self, s: Schema) -> Schema:
        if why := self.needs(s):
            raise NotApplicable(f"{self.op}: {why}")
        a = self.args
        if self.op == "add_sort":
            defaults = {**s.defaults, a[0]: a[2]} if len(a) > 2 and a[2] is not None else s.defaults
            return replace(s, vertices={**s.vertices, a[0]: a[1]}, defaults=defaults)
        if self.op == "drop_sort":
            keep = lambda d: {k: v for k, v in d.items() if k != a[0]}
            edges = frozenset(e for e in s.edges if a[0] not in (e.src, e.tgt))
            return replace(s, vertices=keep(s.vertices), edges=edges, constraints=keep(s.constraints), required={v: es & edges for v, es in keep(s.required).items()}, defaults=keep(s.defaults))
        if self.op in ("rename_sort", "pullback"):
            way = {a[0]: a[1]} if self.op == "rename_sort" else dict(a[0])
            to = lambda v: way.get(v, v)
            move = lambda e: replace(e, src=to(e.src), tgt=to(e.tgt))
            return replace(s, vertices={to(v): k for v, k in s.vertices.items()}, edges=frozenset(map(move, s.edges)), constraints={to(v): c for v, c in s.constraints.items()}, required={to(v): frozenset(map(move, es)) for v, es in s.required.items()}, defaults={to(v): x for v, x in s.defaults.items()})
        if self.op == "add_op":
            return replace(s, edges=s.edges | {Edge(a[0], a[1], a[2] if len(a) > 2 else "prop", a[3] if len(a) > 3 else None)})
        if self.op == "drop_op":
            return replace(s, edges=frozenset(e for e in s.edges if (e.src, e.label) != (a[0], a[1])))
        if self.op in ("rename_op", "rename_edge_name"):
            return replace(s, edges=frozenset(replace(e, name=a[2]) if (e.src, e.label) == (a[0], a[1]) else e for e in s.edges))
        if self.op == "coerce_sort":
            return replace(s, vertices={**s.vertices, a[0]: a[1]})
        if self.op == "scoped":
            inner = [Rewrite(op, tuple(x)) for op, x in a[1]]
            for r in inner:
                s = r.target(s)
            return s
        if self.op in ("add_equation", "drop_equation"):
            policies = dict(s.policies)
            policies.pop(a[0], None) if self.op == "drop_equation" else policies.update({a[0]: a[1]})
            return replace(s, policies=policies)
        raise NotApplicable(f"no rewrite {self.op}")

    def vertex_map(self, s: Schema) -> dict:
        way = {self.args[0]: self.args[1]} if self.op == "rename_sort" else dict(self.args[0]) if self.op == "pullback" else {}
        out = self.target(s).vertices
        return {v: way.get(v, v) for v in s.vertices if way.get(v, v) in out}

    def complement(self) -> str:
        """What must be kept to go back: none, dropped, added, or opaque."""
        if self.op in ("drop_sort", "drop_op"):
            return "dropped"
        if self.op in ("add_sort", "add_op"):
            return "added"
        if self.op == "coerce_sort":
            return self.args[3] if len(self.args) > 3 else "opaque"
        if self.op == "scoped":
            return max((Rewrite(op, tuple(x)).complement() for op, x in self.args[1]), key=lambda c: COSTS.get(c, 0), default="none")
        return "none"


@dataclass(frozen=True)
class Chain:
    """Rewrites one after another."""

    steps: tuple[Rewrite, ...] = ()

    def then(self, other: Chain) -> Chain:
        return Chain(self.steps + other.steps)

    def needs(self, s: Schema) -> list[str]:
        """Everything that keeps the chain from applying."""
        out = []
        for r in self.steps:
            why = r.needs(s)
            if why:
                return [*out, f"{r.op}: {why}"]
            s = r.target(s)
        return out

    def target(self, s: Schema) -> Schema:
        for r in self.steps:
            s = r.target(s)
        return s

    def instantiate(self, s: Schema) -> tuple[Schema, Compiled]:
        """The schema it leads to, and one compiled mapping for the whole chain."""
        way, at = {v: v for v in s.vertices}, s
        for r in self.steps:
            step = r.vertex_map(at)
            way = {a: step[b] for a, b in way.items() if b in step}
            at = r.target(at)
        m = compile_migration(s, at, to_migration(s, at, way))
        for r in self.steps:
            if r.op == "coerce_sort" and len(r.args) > 2:
                m = m.with_transforms(way.get(r.args[0], r.args[0]), ("apply", "__value__", r.args[2], None))
        return at, m

    def fused(self) -> Chain:
        """Without steps that undo each other, and with renames in a row made one."""
        steps = list(self.steps)
        i = 0
        while i + 1 < len(steps):
            a, b = steps[i], steps[i + 1]
            if a.op == b.op == "rename_sort" and a.args[1] == b.args[0]:
                steps[i : i + 2] = [] if a.args[0] == b.args[1] else [Rewrite("rename_sort", (a.args[0], b.args[1]))]
            elif (a.op, b.op) == ("add_sort", "drop_sort") and a.args[0] == b.args[0]:
                steps[i : i + 2] = []
            elif a.op == b.op == "rename_op" and a.args[0] == b.args[0] and a.args[2] == b.args[1]:
                steps[i : i + 2] = [] if a.args[1] == b.args[2] else [Rewrite("rename_op", (a.args[0], a.args[1], b.args[2]))]
            else:
                i += 1
                continue
            i = max(i - 1, 0)
        return Chain(tuple(steps))

    def cost(self) -> float:
        return sum(COSTS.get(r.complement(), 0.0) for r in self.steps)

    def fleet(self, schemas: dict[str, Schema]) -> tuple[dict[str, Schema], dict[str, list[str]]]:
        """The chain over many schemas: where it applies, and why not elsewhere."""
        done, bad = {}, {}
        for name, s in schemas.items():
            if why := self.needs(s):
                bad[name] = why
            else:
                done[name] = self.target(s)
        return done, bad

    def to_json(self) -> str:
        return json.dumps([[r.op, r.args] for r in self.steps])

    @staticmethod
    def from_json(text: str) -> Chain:
        def deep(x):
            return tuple(map(deep, x)) if isinstance(x, list) else x

        return Chain(tuple(Rewrite(op, tuple(a if isinstance(a, dict) else deep(a) for a in args)) for op, args in json.loads(text)))


def from_diff(a: Schema, b: Schema, renames: dict[str, str] | None = None) -> Chain:
    """Rewrites that lead from one schema to another."""
    steps = [Rewrite("rename_sort", (x, y)) for x, y in sorted((renames or {}).items())]
    mid = Chain(tuple(steps)).target(a)
    gone, come = [], []
    for c in diff(mid, b):
        if c.facet == "removed_vertices":
            gone.append(Rewrite("drop_sort", (c.key,)))
        elif c.facet == "added_vertices":
            come.append(Rewrite("add_sort", (c.key, b.vertices[c.key], b.defaults.get(c.key))))
        elif c.facet == "kind_changes":
            known = b.coercions.get((mid.vertices[c.key], b.vertices[c.key]))
            come.append(Rewrite("coerce_sort", (c.key, b.vertices[c.key], *((known.forward, known.round_trip) if known else ()))))
    at = Chain(tuple([*gone, *come])).target(mid)
    edges = [Rewrite("drop_op", (e.src, e.label)) for e in sorted(at.edges - b.edges, key=edge_key)]
    edges += [Rewrite("add_op", (e.src, e.tgt, e.kind, e.name)) for e in sorted(b.edges - at.edges, key=edge_key)]
    return Chain(tuple([*steps, *gone, *come, *edges]))


def vertical(*chains: Chain) -> Chain:
    """One after another."""
    out = Chain()
    for c in chains:
        out = out.then(c)
    return out


def horizontal(left: Chain, right: Chain, s: Schema) -> Chain:
    """Both at once: the right one's names follow the left one's renames."""
    way, at = {v: v for v in s.vertices}, s
    for r in left.steps:
        step = r.vertex_map(at)
        way = {a: step[b] for a, b in way.items() if b in step}
        at = r.target(at)
    moved = [Rewrite(r.op, tuple(way.get(a, a) if isinstance(a, str) else a for a in r.args)) for r in right.steps]
    return left.then(Chain(tuple(moved)))
