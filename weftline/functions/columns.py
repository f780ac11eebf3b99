"""Compilation of expressions to Spark columns.

Every expression becomes a pair of columns: a value, and whether there is one (``ok``). Nothing raises
at run time, so a filter can drop rows whose predicate has no value while a survival rule keeps them, as each
context asks. Types are static and come from the environment's column types; functions are inlined at
compile time, and stay only as arguments of list operations. All of it is built-in
functions: pruning, pushdown and code generation apply.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .evaluate import FLOAT, LIST, WHITE, ExprError
from .syntax import ARITY, named_function

#: Types: "int", "float", "string", "bool", "bytes", "null", ("list", t), ("record", ((name, t), ...)), "other".
NAMES = {"int": "bigint", "float": "double", "string": "string", "bool": "boolean", "bytes": "binary", "null": "void"}


class Unsupported(ExprError):
    """An expression that has a value, but none that columns can hold."""

    def __init__(self, detail: str):
        super().__init__("Unsupported", detail)


@dataclass(frozen=True)
class Typed:
    """A compiled expression. A null value with ``ok`` is the language's null.

    What is known without making the value: ``full``, that it is never null where it is ok; ``size``, a list's length; ``sure``, that every row is ok.
    """

    value: Column
    type: object
    ok: Column | None = None
    full: bool = False
    size: Column | None = None
    sure: bool = field(default=False, init=False)

    def __post_init__(self):
        if self.ok is None:
            object.__setattr__(self, "ok", F.lit(True))
            object.__setattr__(self, "sure", True)

    @property
    def checked(self) -> Column:
        """The value, null where there is none."""
        return F.when(self.ok, self.value)


@dataclass(frozen=True)
class Function:
    """A lambda at compile time."""

    name: str
    body: tuple
    env: dict


def type_of(t: T.DataType):
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, T.StringType):
        return "string"
    if isinstance(t, T.BinaryType):
        return "bytes"
    if isinstance(t, T.NullType):
        return "null"
    if isinstance(t, T.ArrayType):
        return ("list", type_of(t.elementType))
    if isinstance(t, T.StructType):
        return ("record", tuple((f.name, type_of(f.dataType)) for f in t.fields))
    return "other"


def ddl(t) -> str:
    if isinstance(t, tuple) and t[0] == "list":
        return f"array<{ddl(t[1])}>"
    if isinstance(t, tuple):
        return "struct<" + ",".join(f"`{n}`:{ddl(v)}" for n, v in t[1]) + ">"
    if t not in NAMES:
        raise Unsupported(f"a value of type {t}")
    return NAMES[t]


def column(c: Column, t) -> Column:
    """A column of a data type, in the language's own width."""
    return c.cast(ddl(t)) if t in ("int", "float") else c


def env_of(schema: T.StructType, prefix: str | None = None) -> dict[str, Typed]:
    """An environment of a frame's columns."""
    out = {}
    for f in schema.fields:
        c = F.col(f"{prefix}.`{f.name}`" if prefix else f"`{f.name}`")
        t = type_of(f.dataType)
        out[f.name] = Typed(column(c, t), t)
    return out


def _of(*xs: Typed) -> Column:
    """All have values, and none is null."""
    out = F.lit(True)
    for x in xs:
        out = out & x.ok if x.full else out & x.ok & x.value.isNotNull()
    return out


def _size(xs: Typed) -> Column:
    return F.size(xs.value) if xs.size is None else xs.size


def _fail() -> Typed:
    return Typed(F.lit(None), "null", F.lit(False))


def _result(value: Column, t, ok: Column) -> Typed:
    """A value that must not be null where all went well."""
    return Typed(value, t, F.coalesce(ok & value.isNotNull(), F.lit(False)), full=True)


def unify(a, b):
    """The type of a value that is one or the other."""
    if a == b or b == "null":
        return a
    if a == "null":
        return b
    if isinstance(a, tuple) and isinstance(b, tuple) and a[0] == b[0] == "list":
        return ("list", unify(a[1], b[1]))
    if isinstance(a, tuple) and isinstance(b, tuple) and a[0] == b[0] and [n for n, _ in a[1]] == [n for n, _ in b[1]]:
        return ("record", tuple((n, unify(x, y)) for (n, x), (_, y) in zip(a[1], b[1], strict=True)))
    raise Unsupported(f"values of type {a} and {b} in one place")


def _as(x: Typed, t) -> Column:
    return x.value.cast(ddl(t)) if x.type != t else x.value


def _double(x: Typed) -> Column:
    return x.value.cast("double")


def _total(c: Column) -> Column:
    """A key by which floats are ordered, -0.0 before 0.0 and NaN last."""
    return F.struct(c, F.when(c == 0, F.when(c.cast("string") == "-0.0", 0).otherwise(1)))


def _same(a: Typed, b: Typed) -> Column:
    """Structural equality of two values."""
    if a.type == "null" or b.type == "null":
        return a.value.isNull() & b.value.isNull()
    if a.type != b.type:
        try:
            t = unify(a.type, b.type)
        except Unsupported:
            return a.value.isNull() & b.value.isNull()
        a, b = Typed(_as(a, t), t, a.ok), Typed(_as(b, t), t, b.ok)
    if a.type == "float":
        return a.value.eqNullSafe(b.value) & ((a.value != 0) | F.isnull(a.value) | (a.value.cast("string") == b.value.cast("string")))
    return a.value.eqNullSafe(b.value)


class Compiler:
    def __init__(self, graph: Callable | None = None, most: int = LIST):
        self.most = most
        self.graph = graph

    def run(self, e, env: dict):
        kind = e[0]
        if kind == "var":
            if e[1] in env:
                return env[e[1]]
            f = named_function(e[1])
            return Function(f[1], f[2], {}) if f else _fail()
        if kind == "lit":
            return self.literal(e[1])
        if kind == "lam":
            return Function(e[1], e[2], env)
        if kind == "app":
            return self.call(self.run(e[1], env), self.run(e[2], env))
        if kind == "let":
            return self.within(self.run(e[2], env), lambda x: self.run(e[3], {**env, e[1]: x}))
        if kind == "record":
            parts = [(n, self.value(v, env)) for n, v in dict(e[1]).items()]
            t = ("record", tuple((n, p.type) for n, p in parts))
            return Typed(F.struct(*[p.value.alias(n) for n, p in parts]) if parts else F.lit(None), t, self.all_ok([p for _, p in parts]))
        if kind == "list":
            return self.list_of([self.value(v, env) for v in e[1]])
        if kind == "field":
            r = self.value(e[1], env)
            t = dict(r.type[1]).get(e[2]) if isinstance(r.type, tuple) and r.type[0] == "record" else None
            return Typed(column(r.value.getField(e[2]), t), t, r.ok & r.value.isNotNull()) if t else _fail()
        if kind == "index":
            xs, i = self.value(e[1], env), self.value(e[2], env)
            if not self.is_list(xs) or i.type != "int":
                return _fail()
            n = F.size(xs.value)
            at = F.when(i.value < 0, i.value + n).otherwise(i.value)
            ok = F.coalesce(_of(xs, i) & (at >= 0) & (at < n), F.lit(False))
            return Typed(F.get(xs.value, F.when(ok, at).cast("int")), xs.type[1], ok)
        if kind == "match":
            return self.match(e, env)
        return self.op(e[1], e[2], env)

    def value(self, e, env) -> Typed:
        x = self.run(e, env)
        if isinstance(x, Function):
            raise Unsupported("a function as a value")
        return x

    def literal(self, v) -> Typed:
        if v is None:
            return Typed(F.lit(None), "null")
        if isinstance(v, bool):
            return Typed(F.lit(v), "bool")
        if isinstance(v, int):
            return Typed(F.lit(v).cast("bigint"), "int")
        return Typed(F.lit(v), {float: "float", str: "string", bytes: "bytes"}[type(v)])

    def within(self, x, body):
        """``body`` of an argument that is evaluated first: without a value there is no result."""
        out = body(Typed(x.value, x.type, full=x.full, size=x.size) if isinstance(x, Typed) else x)
        if not isinstance(x, Typed) or not isinstance(out, Typed):
            return out
        return Typed(out.value, out.type, None if x.sure and out.sure else x.ok & out.ok, out.full, out.size)

    def call(self, f, x):
        if not isinstance(f, Function):
            return _fail()
        return self.within(x, lambda v: self.run(f.body, {**f.env, f.name: v}))

    def all_ok(self, parts) -> Column:
        out = F.lit(True)
        for p in parts:
            out = out & p.ok
        return out

    def is_list(self, x: Typed) -> bool:
        return isinstance(x.type, tuple) and x.type[0] == "list"

    def list_of(self, parts: list[Typed]) -> Typed:
        if not parts:
            return Typed(F.array(), ("list", "null"))
        t = parts[0].type
        for p in parts[1:]:
            t = unify(t, p.type)
        return Typed(F.array(*[_as(p, t) for p in parts]), ("list", t), self.all_ok(parts) if len(parts) <= self.most else F.lit(False))

    def match(self, e, env) -> Typed:
        v = self.value(e[1], env)
        arms = []
        for p, body in e[2]:
            found: dict = {}
            cond = self.pattern(p, Typed(v.value, v.type), found)
            if cond is not None:
                arms.append((cond, self.value(body, {**env, **found})))
        t = "null"
        for _, a in arms:
            t = unify(t, a.type)
        value, ok = F.lit(None).cast(ddl(t)) if t != "null" else F.lit(None), F.lit(False)
        for cond, a in reversed(arms):
            value, ok = F.when(cond, _as(a, t)).otherwise(value), F.when(cond, a.ok).otherwise(ok)
        return Typed(value, t, F.coalesce(v.ok & ok, F.lit(False)))

    def pattern(self, p, v: Typed, found: dict) -> Column | None:
        """The condition under which a pattern matches; None if it never can."""
        kind = p[0]
        if kind == "any":
            return F.lit(True)
        if kind == "bind":
            found[p[1]] = v
            return F.lit(True)
        if kind == "is":
            return _same(self.literal(p[1]), v)
        record = isinstance(v.type, tuple) and v.type[0] == "record"
        if kind == "items":
            if not self.is_list(v):
                return None
            cond = F.coalesce(F.size(v.value) == len(p[1]), F.lit(False))
            parts = [(q, Typed(F.get(v.value, F.lit(i)), v.type[1])) for i, q in enumerate(p[1])]
        elif not record:
            return None
        else:
            fields, cond = dict(v.type[1]), v.value.isNotNull()
            names = list(p[1]) if kind == "fields" else [("$tag", ("is", p[1])), *((f"${i}", q) for i, q in enumerate(p[2]))]
            if any(n not in fields for n, _ in names):
                return None
            parts = [(q, Typed(column(v.value.getField(n), fields[n]), fields[n])) for n, q in names]
        for q, x in parts:
            c = self.pattern(q, x, found)
            if c is None:
                return None
            cond = cond & c
        return cond

    def op(self, name: str, args, env) -> Typed:
        if len(args) != ARITY[name]:
            raise ExprError("ArityMismatch", name)
        if name in ("edge", "children", "has_edge", "edge_count", "anchor"):
            return self.graph(name, args, env, self) if self.graph else Typed(F.lit(None), "null")
        if name in ("map", "filter", "flat_map", "fold"):
            return self.higher(name, [self.run(a, env) for a in args])
        got = [self.value(a, env) for a in args]
        return getattr(self, "_" + name)(*got)

    def element(self, xs: Typed, c: Column) -> Typed:
        return Typed(c, xs.type[1])

    def higher(self, name, a) -> Typed:
        xs = a[0]
        if isinstance(xs, Function) or not self.is_list(xs) or not isinstance(a[-1], Function):
            return _fail()
        f = a[-1]
        if name == "fold":
            return self.fold(xs, a[1], f)
        probe = self.call(f, self.element(xs, F.lit(None)))
        if isinstance(probe, Function):
            raise Unsupported("a list of functions")
        each_ok = F.forall(xs.value, lambda x: F.coalesce(self.call(f, self.element(xs, x)).ok, F.lit(False)))
        ok = F.coalesce(_of(xs) & each_ok, F.lit(False))
        if name == "filter":
            if probe.type != "bool":
                return Typed(xs.value, xs.type, ok & (F.size(xs.value) == 0))
            bools = F.forall(xs.value, lambda x: self.call(f, self.element(xs, x)).value.isNotNull())
            return Typed(F.filter(xs.value, lambda x: self.call(f, self.element(xs, x)).value), xs.type, ok & bools)
        got = F.transform(xs.value, lambda x: self.call(f, self.element(xs, x)).value)
        if name == "map":
            fine = _of(xs) if probe.sure else ok
            return Typed(got, ("list", probe.type), F.coalesce(fine & (_size(xs) <= self.most), F.lit(False)), full=True, size=_size(xs))
        if not isinstance(probe.type, tuple) or probe.type[0] != "list":
            return Typed(F.array(), ("list", "null"), ok & (F.size(xs.value) == 0))
        flat = F.flatten(got)
        return Typed(flat, probe.type, F.coalesce(ok & F.forall(got, lambda x: x.isNotNull()) & (F.size(flat) <= self.most), F.lit(False)))

    def fold(self, xs: Typed, init, f: Function) -> Typed:
        if isinstance(init, Function):
            raise Unsupported("a function as an accumulator")
        t = init.type
        for _ in range(3):  # the accumulator's type, which its steps may widen
            step = self.call(self.call(f, Typed(F.lit(None), t)), self.element(xs, F.lit(None)))
            if isinstance(step, Function):
                return _fail()
            wider = unify(t, step.type)
            if wider == t:
                break
            t = wider
        start = F.struct(_as(init, t).cast(ddl(t)).alias("v"), F.coalesce(init.ok, F.lit(False)).alias("ok"))

        def merge(acc, x):
            s = self.call(self.call(f, Typed(acc["v"], t)), self.element(xs, x))
            return F.struct(_as(s, t).cast(ddl(t)).alias("v"), (acc["ok"] & F.coalesce(s.ok, F.lit(False))).alias("ok"))

        end = F.aggregate(xs.value, start, merge)
        return Typed(end["v"], t, F.coalesce(_of(xs) & end["ok"], F.lit(False)))

    def _arith(self, whole, real, a, b) -> Typed:
        if {a.type, b.type} - {"int", "float"}:
            return _fail()
        ok = _of(a, b)
        if a.type == b.type == "int":
            return _result(whole(a.value, b.value), "int", ok)
        return _result(real(_double(a), _double(b)), "float", ok)

    def _add(self, a, b):
        return self._arith(F.try_add, lambda x, y: x + y, a, b)

    def _sub(self, a, b):
        return self._arith(F.try_subtract, lambda x, y: x - y, a, b)

    def _mul(self, a, b):
        return self._arith(F.try_multiply, lambda x, y: x * y, a, b)

    def _div(self, a, b):
        def whole(x, y):
            low = F.lit(-(1 << 63)).cast("bigint")
            fine = (y != 0) & ~((x == low) & (y == -1))
            return F.when(fine, F.call_function("div", x, F.when(fine, y)))

        return self._arith(whole, lambda x, y: F.when(y != 0, x / F.when(y != 0, y)), a, b)

    def _mod(self, a, b):
        if a.type != "int" or b.type != "int":
            return _fail()
        return _result(F.try_mod(a.value, b.value), "int", _of(a, b))

    def _neg(self, a):
        if a.type == "float":
            return _result(-a.value, "float", _of(a))
        return _result(F.try_subtract(F.lit(0).cast("bigint"), a.value), "int", _of(a)) if a.type == "int" else _fail()

    def _abs(self, a):
        if a.type == "float":
            return _result(F.abs(a.value), "float", _of(a))
        return _result(F.when(a.value < 0, F.try_subtract(F.lit(0).cast("bigint"), a.value)).otherwise(a.value), "int", _of(a)) if a.type == "int" else _fail()

    def _to_int(self, a, c) -> Typed:
        if a.type != "float":
            return _fail()
        fine = (c >= F.lit(-(2.0**63))) & (c < F.lit(2.0**63)) & ~F.isnan(c)
        return _result(F.when(fine, F.when(fine, c).cast("bigint")), "int", _of(a))

    def _floor(self, a):
        return self._to_int(a, F.when(F.abs(a.value) < 2.0**52, F.floor(F.when(F.abs(a.value) < 2.0**52, a.value)).cast("double")).otherwise(a.value)) if a.type == "float" else _fail()

    def _ceil(self, a):
        return self._to_int(a, F.when(F.abs(a.value) < 2.0**52, F.ceil(F.when(F.abs(a.value) < 2.0**52, a.value)).cast("double")).otherwise(a.value)) if a.type == "float" else _fail()

    def _round(self, a):
        """Halves go away from zero."""
        if a.type != "float":
            return _fail()
        small = F.abs(a.value) < 2.0**52
        n = F.floor(F.when(small, F.abs(a.value))).cast("double")
        up = n + F.when(F.abs(a.value) - n >= 0.5, 1.0).otherwise(0.0)
        return self._to_int(a, F.when(small, F.when(a.value < 0, -up).otherwise(up)).otherwise(a.value))

    def _float_to_int(self, a):
        return self._to_int(a, a.value)

    def _eq(self, a, b):
        return Typed(_same(a, b), "bool", a.ok & b.ok)

    def _neq(self, a, b):
        return Typed(~_same(a, b), "bool", a.ok & b.ok)

    def _compare(self, f, a, b) -> Typed:
        if a.type == b.type and a.type in ("int", "string"):
            return _result(f(a.value, b.value), "bool", _of(a, b))
        if {a.type, b.type} - {"int", "float"}:
            return _fail()
        return _result(f(_total(_double(a)), _total(_double(b))), "bool", _of(a, b))

    def _lt(self, a, b):
        return self._compare(lambda x, y: x < y, a, b)

    def _lte(self, a, b):
        return self._compare(lambda x, y: x <= y, a, b)

    def _gt(self, a, b):
        return self._compare(lambda x, y: x > y, a, b)

    def _gte(self, a, b):
        return self._compare(lambda x, y: x >= y, a, b)

    def _logic(self, f, *xs) -> Typed:
        return _result(f(*[x.value for x in xs]), "bool", _of(*xs)) if all(x.type == "bool" for x in xs) else _fail()

    def _and(self, a, b):
        return self._logic(lambda x, y: x & y, a, b)

    def _or(self, a, b):
        return self._logic(lambda x, y: x | y, a, b)

    def _not(self, a):
        return self._logic(lambda x: ~x, a)

    def _text(self, value, t, strings, ints=()) -> Typed:
        if any(x.type != "string" for x in strings) or any(x.type != "int" for x in ints):
            return _fail()
        return _result(value(), t, _of(*strings, *ints))

    def _concat(self, a, b):
        return self._text(lambda: F.concat(a.value, b.value), "string", [a, b])

    def _len(self, a):
        return self._text(lambda: F.octet_length(a.value).cast("bigint"), "int", [a])

    def _slice(self, s, a, b):
        def value():
            lo = F.greatest(F.least(a.value, F.lit(1 << 30)), F.lit(0)).cast("int")
            hi = F.least(F.greatest(b.value, F.lit(0)), F.char_length(s.value)).cast("int")
            return F.substring(s.value, lo + 1, F.greatest(hi - lo, F.lit(0)))

        return self._text(value, "string", [s], [a, b])

    def _upper(self, a):
        return self._text(lambda: F.upper(a.value), "string", [a])

    def _lower(self, a):
        return self._text(lambda: F.lower(a.value), "string", [a])

    def _trim(self, a):
        return self._text(lambda: F.btrim(a.value, F.lit(WHITE)), "string", [a])

    def _split(self, s, d):
        def value():
            chars = F.concat(F.array(F.lit("")), F.filter(F.split(s.value, "", -1), lambda c: c != ""), F.array(F.lit("")))
            return F.when(d.value == "", chars).otherwise(F.split(s.value, F.concat(F.lit("\\Q"), F.replace(d.value, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), -1))

        return self._text(value, ("list", "string"), [s, d])

    def _join(self, xs, d):
        if d.type != "string" or not self.is_list(xs):
            return _fail()
        if xs.type[1] != "string":
            return Typed(F.lit(""), "string", _of(xs, d) & (F.size(xs.value) == 0))
        return _result(F.call_function("concat_ws", d.value, xs.value), "string", _of(xs, d) & F.forall(xs.value, lambda x: x.isNotNull()))

    def _replace(self, s, a, b):
        def value():
            spread = F.concat(b.value, F.regexp_replace(s.value, "(?s)(.)", F.concat(F.lit("$1"), F.regexp_replace(b.value, r"([\\$])", r"\\$1"))))
            return F.when(a.value == "", spread).otherwise(F.replace(s.value, a.value, b.value))

        return self._text(value, "string", [s, a, b])

    def _contains(self, s, t):
        return self._text(lambda: F.contains(s.value, t.value), "bool", [s, t])

    def _append(self, xs, x):
        if not self.is_list(xs):
            return _fail()
        t = unify(xs.type[1], x.type)
        one = F.array(_as(x, t))
        return Typed(F.concat(xs.value.cast(ddl(("list", t))) if xs.type[1] != t else xs.value, one), ("list", t), F.coalesce(_of(xs) & x.ok, F.lit(False)))

    def _head(self, xs):
        return Typed(F.get(xs.value, F.lit(0)), xs.type[1], F.coalesce(_of(xs) & (F.size(xs.value) > 0), F.lit(False))) if self.is_list(xs) else _fail()

    def _tail(self, xs):
        if not self.is_list(xs):
            return _fail()
        return Typed(F.slice(xs.value, 2, F.greatest(F.size(xs.value) - 1, F.lit(0))), xs.type, F.coalesce(_of(xs) & (F.size(xs.value) > 0), F.lit(False)))

    def _reverse(self, xs):
        return Typed(F.reverse(xs.value), xs.type, _of(xs), full=True, size=xs.size) if self.is_list(xs) else _fail()

    def _length(self, xs):
        return Typed(_size(xs).cast("bigint"), "int", _of(xs), full=True) if self.is_list(xs) else _fail()

    def _range(self, a, b):
        if a.type != "int" or b.type != "int":
            return _fail()
        n = F.try_subtract(b.value, a.value)
        fine = F.coalesce(n < self.most, F.lit(False))
        hi = F.when(fine & (n >= 0), b.value).otherwise(a.value)
        made = F.when(n < 0, F.array().cast("array<bigint>")).otherwise(F.sequence(a.value, hi))
        return Typed(made, ("list", "int"), F.coalesce(_of(a, b) & fine, F.lit(False)), full=True, size=F.when(n < 0, F.lit(0)).otherwise(F.try_add(n, F.lit(1)).try_cast("int")))

    def _fields(self, r: Typed):
        return r.type[1] if isinstance(r.type, tuple) and r.type[0] == "record" else None

    def _merge(self, a, b):
        fa, fb = self._fields(a), self._fields(b)
        if fa is None or fb is None:
            return _fail()
        new = {n: (a, t) for n, t in fa} | {n: (b, t) for n, t in fb}
        return Typed(F.struct(*[x.value.getField(n).alias(n) for n, (x, _) in new.items()]), ("record", tuple((n, t) for n, (_, t) in new.items())), _of(a, b))

    def _keys(self, r):
        f = self._fields(r)
        return Typed(F.array(*[F.lit(n) for n, _ in f]).cast("array<string>"), ("list", "string"), _of(r)) if f is not None else _fail()

    def _values(self, r):
        f = self._fields(r)
        if f is None:
            return _fail()
        return Typed(self.list_of([Typed(r.value.getField(n), t) for n, t in f]).value, self.list_of([Typed(F.lit(None), t) for _, t in f]).type, _of(r))

    def _has_field(self, r, n):
        f = self._fields(r)
        return _result(n.value.isin([x for x, _ in f]) if f else F.lit(False), "bool", _of(r, n)) if f is not None and n.type == "string" else _fail()

    def _default(self, a, b):
        t = unify(a.type, b.type)
        return Typed(F.coalesce(_as(a, t), _as(b, t)), t, a.ok & b.ok)

    def _clamp(self, x, lo, hi):
        if len({x.type, lo.type, hi.type}) > 1 or x.type not in ("int", "float"):
            return _fail()
        return _result(F.greatest(lo.value, F.least(x.value, hi.value)), x.type, _of(x, lo, hi) & (lo.value <= hi.value))

    def _truncate_str(self, s, n):
        """The longest whole characters within so many bytes: a character starts at a byte that is no continuation."""

        def value():
            most = F.greatest(n.value, F.lit(0))
            fits = F.aggregate(F.filter(F.split(s.value, "", -1), lambda c: c != ""), F.struct(F.lit("").alias("t"), F.lit(0).cast("bigint").alias("n")), lambda a, c: F.struct(F.when(a["n"] + F.octet_length(c) <= most, F.concat(a["t"], c)).otherwise(a["t"]).alias("t"), (a["n"] + F.octet_length(c)).alias("n")))["t"]
            return F.when(F.octet_length(s.value) <= most, s.value).otherwise(F.when(F.octet_length(s.value) == F.char_length(s.value), F.left(s.value, most.cast("int"))).otherwise(fits))

        return self._text(value, "string", [s], [n])

    def _int_to_float(self, a):
        return _result(_double(a), "float", _of(a)) if a.type == "int" else _fail()

    def _int_to_str(self, a):
        return _result(a.value.cast("string"), "string", _of(a)) if a.type == "int" else _fail()

    def _float_to_str(self, a):
        """Shortest digits without an exponent."""
        if a.type != "float":
            return _fail()
        s = a.value.cast("string")
        mantissa, power = F.regexp_extract(s, r"^-?([0-9]+\.[0-9]+)E", 1), F.regexp_extract(s, r"E(-?[0-9]+)$", 1)
        digits = F.regexp_replace(F.replace(mantissa, F.lit("."), F.lit("")), "0+$", "")
        p = F.when(power != "", power).cast("int")
        long = F.when(p >= 0, F.when(F.length(digits) <= p + 1, F.rpad(digits, p + 1, "0")).otherwise(F.concat(F.left(digits, p + 1), F.lit("."), F.substring(digits, p + 2, F.lit(400))))).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -p - 1), digits))
        sign = F.when(s.startswith("-"), "-").otherwise("")
        text = F.when(F.isnan(a.value), "NaN").when(s == "Infinity", "inf").when(s == "-Infinity", "-inf").when(s.contains("E"), F.concat(sign, long)).otherwise(F.regexp_replace(s, r"\.0$", ""))
        return _result(text, "string", _of(a))

    def _str_to_int(self, s):
        return _result(F.when(s.value.rlike(r"\A[+-]?[0-9]+\z"), s.value).try_cast("bigint"), "int", _of(s)) if s.type == "string" else _fail()

    def _str_to_float(self, s):
        return _result(F.when(s.value.rlike(rf"(?i)\A{FLOAT.pattern}\z"), s.value).try_cast("double"), "float", _of(s)) if s.type == "string" else _fail()

    def _type_of(self, v):
        name = v.type[0] if isinstance(v.type, tuple) else v.type
        return Typed(F.when(v.value.isNull(), "null").otherwise(name) if name != "null" else F.lit("null"), "string", v.ok)

    def _is_null(self, v):
        return Typed(v.value.isNull(), "bool", v.ok)

    def _is_list(self, v):
        return Typed(v.value.isNotNull() if self.is_list(v) else F.lit(False), "bool", v.ok)


def compile_expr(e, env: dict[str, Typed], graph: Callable | None = None, most: int = LIST) -> Typed:
    """The pair of columns of a tree, in an environment of typed columns. A list that is made longer than ``most`` has no value (``failure`` tells)."""
    out = Compiler(graph, most).value(e, env)
    return Typed(out.value, out.type, F.coalesce(out.ok, F.lit(False)))


def failure(e, env: dict[str, Typed], graph: Callable | None = None, most: int = LIST, beyond: int = 100 * LIST) -> Column:
    """Why a tree has no value: ``ListLimitExceeded`` if one would be there with lists of up to ``beyond`` elements, else ``NoValue``; null where it has a value."""
    ok = compile_expr(e, env, graph, most).ok
    return F.when(ok, F.lit(None).cast("string")).when(compile_expr(e, env, graph, beyond).ok, "ListLimitExceeded").otherwise("NoValue")


def predicate(e, env: dict[str, Typed], otherwise: bool = False, graph: Callable | None = None) -> Column:
    """A condition: the expression's truth, and ``otherwise`` where it has no value or is no bool."""
    t = compile_expr(e, env, graph)
    if t.type != "bool":
        return F.lit(otherwise)
    return F.coalesce(F.when(t.ok, t.value), F.lit(otherwise))
