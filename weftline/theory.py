"""Theories: sorts, operations and equations; their maps, gluings, models and rewriting.

Small and symbolic, on the driver; only checking equations over large carriers is data-parallel, and that is a query.
Terms are tuples: ("var", name) or (operation, term, ...).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class TheoryError(ValueError):
    """A theory, map or term that is not well formed."""


@dataclass(frozen=True)
class Theory:
    name: str
    sorts: frozenset = frozenset()
    ops: dict = field(default_factory=dict)  # name -> (argument sorts, result sort)
    equations: dict = field(default_factory=dict)  # name -> (left, right)
    directed: dict = field(default_factory=dict)
    extends: tuple = ()

    def check(self) -> Theory:
        for op, (args, out) in self.ops.items():
            if bad := [s for s in (*args, out) if s not in self.sorts]:
                raise TheoryError(f"{op} uses unknown sorts {bad}")
        for name, (a, b) in {**self.equations, **self.directed}.items():
            env: dict = {}
            if sort_of(self, a, env) != sort_of(self, b, env):
                raise TheoryError(f"the sides of {name} have different sorts")
        return self


def resolve(t: Theory, known: dict[str, Theory]) -> Theory:
    """With all that it extends."""
    out = t
    for name in t.extends:
        if name not in known:
            raise TheoryError(f"no theory {name}")
        base = resolve(known[name], known)
        out = Theory(t.name, base.sorts | out.sorts, {**base.ops, **out.ops}, {**base.equations, **out.equations}, {**base.directed, **out.directed})
    return out


def sort_of(t: Theory, term, env: dict, want: str | None = None) -> str:
    """A term's sort; variables get theirs from where they stand."""
    if term[0] == "var":
        have = env.get(term[1])
        if have is None:
            if want is None:
                raise TheoryError(f"the sort of {term[1]} is open")
            env[term[1]] = have = want
        if want is not None and have != want:
            raise TheoryError(f"{term[1]} is a {have}, not a {want}")
        return have
    if term[0] not in t.ops:
        raise TheoryError(f"no operation {term[0]}")
    args, out = t.ops[term[0]]
    if len(args) != len(term) - 1:
        raise TheoryError(f"{term[0]} takes {len(args)} arguments")
    for s, x in zip(args, term[1:], strict=True):
        sort_of(t, x, env, s)
    if want is not None and out != want:
        raise TheoryError(f"{term[0]} gives a {out}, not a {want}")
    return out


def variables(term) -> list[str]:
    if term[0] == "var":
        return [term[1]]
    return list(dict.fromkeys(v for x in term[1:] for v in variables(x)))


def substitute(term, by: dict):
    return by.get(term[1], term) if term[0] == "var" else (term[0], *(substitute(x, by) for x in term[1:]))


def match(pattern, term, by: dict) -> bool:
    if pattern[0] == "var":
        return by.setdefault(pattern[1], term) == term
    return pattern[0] == term[0] and len(pattern) == len(term) and all(match(p, x, by) for p, x in zip(pattern[1:], term[1:], strict=True))


def same(a, b) -> bool:
    """Equal but for the names of variables."""
    way, back = {}, {}

    def go(x, y):
        if x[0] == y[0] == "var":
            return way.setdefault(x[1], y[1]) == y[1] and back.setdefault(y[1], x[1]) == x[1]
        return x[0] == y[0] and len(x) == len(y) and all(map(go, x[1:], y[1:]))

    return go(a, b)


def rewrite(t: Theory, term, steps: int = 1000):
    """The normal form under the directed equations."""
    for _ in range(steps):
        new = _once(t, term)
        if new is None:
            return term
        term = new
    raise TheoryError(f"no normal form within {steps} steps")


def _once(t: Theory, term):
    for a, b in t.directed.values():
        by: dict = {}
        if match(a, term, by):
            return substitute(b, by)
    if term[0] != "var":
        for i, x in enumerate(term[1:], 1):
            if (new := _once(t, x)) is not None:
                return (*term[:i], new, *term[i + 1 :])
    return None


@dataclass(frozen=True)
class Morphism:
    sorts: dict
    ops: dict  # name -> name


def translate(m: Morphism, term):
    return term if term[0] == "var" else (m.ops.get(term[0], term[0]), *(translate(m, x) for x in term[1:]))


def check_morphism(a: Theory, b: Theory, m: Morphism) -> list[str]:
    """What keeps ``m`` from being a map of theories."""
    out = [f"sort {s} is not mapped" for s in sorted(a.sorts) if m.sorts.get(s) not in b.sorts]
    for op, (args, res) in sorted(a.ops.items()):
        to = m.ops.get(op)
        if to not in b.ops:
            out.append(f"operation {op} is not mapped")
        elif (tuple(m.sorts.get(s) for s in args), m.sorts.get(res)) != (tuple(b.ops[to][0]), b.ops[to][1]):
            out.append(f"operation {op} changes its sorts")
    for name, (x, y) in sorted(a.equations.items()):
        left, right = translate(m, x), translate(m, y)
        if not any(same((":", left, right), (":", p, q)) or same((":", left, right), (":", q, p)) for p, q in b.equations.values()) and left != right:
            out.append(f"equation {name} is lost")
    return out


def compose(f: Morphism, g: Morphism) -> Morphism:
    return Morphism({k: g.sorts.get(v, v) for k, v in f.sorts.items()}, {k: g.ops.get(v, v) for k, v in f.ops.items()})


def colimit(a: Theory, b: Theory, shared: Theory) -> Theory:
    """Both, glued along what they share by name; other clashes are kept apart."""

    def apart(name, mine, theirs):
        return name if name in theirs or name not in mine else f"{b.name}.{name}"

    sorts = {s: apart(s, a.sorts, shared.sorts) for s in b.sorts}
    ops = {o: apart(o, a.ops, shared.ops) for o in b.ops}
    m = Morphism(sorts, ops)
    for o in shared.ops:
        if o in a.ops and o in b.ops and a.ops[o] != b.ops[o]:
            raise TheoryError(f"{o} differs")
    moved = {ops[o]: (tuple(sorts[s] for s in args), sorts[res]) for o, (args, res) in b.ops.items()}
    name = lambda e: e if e not in a.equations or e in shared.equations else f"{b.name}.{e}"
    eqs = {name(e): (translate(m, x), translate(m, y)) for e, (x, y) in b.equations.items()}
    return Theory(f"{a.name}+{b.name}", a.sorts | frozenset(sorts.values()), {**moved, **a.ops}, {**eqs, **a.equations}, {**b.directed, **a.directed}).check()


def pullback(a: Theory, b: Theory, f: Morphism, g: Morphism) -> Theory:
    """Pairs of sorts and operations that go to the same one."""
    sorts = {(x, y) for x in a.sorts for y in b.sorts if f.sorts.get(x) == g.sorts.get(y)}
    word = lambda p: p[0] if p[0] == p[1] else f"{p[0]}*{p[1]}"
    ops = {}
    for x, (xa, xr) in a.ops.items():
        for y, (ya, yr) in b.ops.items():
            if f.ops.get(x) == g.ops.get(y) and f.ops.get(x) is not None and len(xa) == len(ya) and all(p in sorts for p in [*zip(xa, ya, strict=True), (xr, yr)]):
                ops[word((x, y))] = (tuple(word(p) for p in zip(xa, ya, strict=True)), word((xr, yr)))
    return Theory(f"{a.name}x{b.name}", frozenset(map(word, sorts)), ops)


def quotient(t: Theory, same_sorts: list[tuple[str, str]]) -> Theory:
    """With sorts identified."""
    root = {s: s for s in t.sorts}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    for x, y in same_sorts:
        p, q = sorted((find(x), find(y)))
        root[q] = p
    return Theory(t.name, frozenset(map(find, t.sorts)), {o: (tuple(map(find, a)), find(r)) for o, (a, r) in t.ops.items()}, dict(t.equations), dict(t.directed))


def check_model(t: Theory, carriers: dict[str, list], ops: dict, limit: int = 100) -> list[tuple]:
    """(equation, assignment) where a finite model breaks an equation."""
    out = []
    for name, (a, b) in sorted(t.equations.items()):
        env: dict = {}
        sort_of(t, a, env) if a[0] != "var" else sort_of(t, b, env)
        sort_of(t, b, env) if b[0] != "var" else None
        names = sorted(env)
        for values in product(*[carriers[env[n]] for n in names]):
            by = dict(zip(names, values, strict=True))

            def run(x, by=by):
                return by[x[1]] if x[0] == "var" else ops[x[0]](*(run(y) for y in x[1:]))

            if run(a) != run(b):
                out.append((name, by))
                if len(out) >= limit:
                    return out
    return out


def check_equation(carrier: DataFrame, variable_columns: dict[str, str], left, right, limit: int | None = 100) -> DataFrame:
    """Rows of a carrier table on which the two sides (columns) of a one-row equation differ: so many, or all of them if ``limit`` is None.

    A limit's rows all pass through one task; without one they stay where they are.
    """
    bad = carrier.where(~left.eqNullSafe(right)).select(*[F.col(c).alias(v) for v, c in variable_columns.items()])
    return bad if limit is None else bad.limit(limit)


def free_model(t: Theory, depth: int = 3, most: int = 10_000) -> dict[str, list]:
    """Closed terms up to a depth, by sort, one of each class that the equations identify."""
    terms: dict[str, list] = {s: [] for s in t.sorts}
    for _ in range(depth):
        new = []
        for op, (args, res) in sorted(t.ops.items()):
            for xs in product(*[terms[s] for s in args]):
                new.append((res, (op, *xs)))
        for s, x in new:
            if x not in terms[s]:
                terms[s].append(x)
        if sum(map(len, terms.values())) > most:
            raise TheoryError(f"more than {most} terms")
    every = [x for xs in terms.values() for x in xs]
    root = {x: x for x in every}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    changed = True
    while changed:
        changed = False
        pairs = []
        for a, b in t.equations.values():
            for p, q in ((a, b), (b, a)):
                if p[0] == "var":
                    continue
                for x in every:
                    by: dict = {}
                    if match(p, x, by) and set(variables(q)) <= set(by):
                        pairs.append((x, substitute(q, by)))
        for x in every:  # congruence
            pairs.append((x, (x[0], *(find(y) for y in x[1:]))))
        for x, y in pairs:
            if y in root and find(x) != find(y):
                p, q = sorted((find(x), find(y)), key=lambda z: (len(str(z)), str(z)))
                root[q] = p
                changed = True
    return {s: [x for x in xs if find(x) == x] for s, xs in terms.items()}
