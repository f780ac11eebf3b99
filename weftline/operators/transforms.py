"""Field transforms, compiled to columns of one projection.

A transform is a tuple: ("rename", old, new), ("drop", name), ("add", name, value), ("keep", names),
("apply", name, expression, inverse), ("compute", target, expression), ("path", (name, ...), transform),
("case", ((condition, transforms), ...)), ("references", name, {old: new or None}), ("hoist", parent, child),
("nest", (name, ...), into), ("scoped", name, transforms) for records and lists of records, ("pullback", {old: new}),
("coerce", name, expression), ("combine", (name, ...), target, expression).
Expressions are text or trees. A field that is null counts as absent, as columns have no third state.
An expression without a value leaves a field as it was.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import Typed, compile_expr, parse, predicate
from ..functions.columns import column, ddl, type_of


def tree_of(e):
    return parse(e) if isinstance(e, str) else e


def literal(value) -> Typed:
    from ..functions.columns import Compiler

    return Compiler().literal(value)


def environment(fields: dict[str, Typed]) -> dict[str, Typed]:
    """Fields by name, and all of them as the record ``attrs``."""
    out = dict(fields)
    if fields and "attrs" not in fields:
        out["attrs"] = Typed(F.struct(*[t.value.alias(n) for n, t in fields.items()]), ("record", tuple((n, t.type) for n, t in fields.items())))
    return out


def of_columns(schema, prefix: str | None = None) -> dict[str, Typed]:
    """The fields of a frame."""
    out = {}
    for f in schema.fields:
        c = F.col(f"{prefix}.`{f.name}`" if prefix else f"`{f.name}`")
        t = type_of(f.dataType)
        out[f.name] = Typed(column(c, t) if t in ("int", "float") else c, t)
    return out


def _merge(cond: Column, new: Typed, old: Typed | None) -> Typed:
    """``new`` where the condition holds, else ``old``."""
    if old is None or old.type == "null":
        return Typed(F.when(cond, new.value), new.type)
    if new.type == "null":
        return Typed(F.when(~cond, old.value), old.type)
    if new.type != old.type:  # an untyped map would hold either; a column needs one type
        t = "float" if {new.type, old.type} == {"int", "float"} else "string"
        new, old = (Typed(x.value.cast(ddl(t)), t) for x in (new, old))
    return Typed(F.when(cond, new.value).otherwise(old.value), new.type)


def apply(fields: dict[str, Typed], transforms, children: dict[str, Typed] | None = None) -> dict[str, Typed]:
    """``fields`` after the transforms in order. ``children`` are scalar children that expressions may read."""
    fields = dict(fields)
    for t in transforms:
        kind = t[0]
        if kind == "rename":
            if t[1] in fields:
                moved = fields.pop(t[1])
                fields[t[2]] = _merge(moved.value.isNotNull(), moved, fields.get(t[2]))
        elif kind == "drop":
            fields.pop(t[1], None)
        elif kind == "add":
            new = literal(t[2])
            fields[t[1]] = _merge(fields[t[1]].value.isNotNull(), fields[t[1]], new) if t[1] in fields else new
        elif kind == "keep":
            fields = {n: fields[n] for n in fields if n in set(t[1])}
        elif kind == "apply":
            source = fields.get(t[1]) or (children or {}).get(t[1])
            if source is not None:
                new = compile_expr(tree_of(t[2]), {t[1]: source, "v": source, "__value__": source})
                fields[t[1]] = _merge(source.value.isNotNull() & new.ok, new, source)
        elif kind == "compute":
            new = compile_expr(tree_of(t[2]), environment({**(children or {}), **fields}))
            fields[t[1]] = _merge(new.ok, new, fields.get(t[1]))
        elif kind == "path":
            fields = _path(fields, t[1], t[2])
        elif kind == "case":
            env, before, taken = environment({**(children or {}), **fields}), dict(fields), F.lit(False)
            for cond, inner in t[1]:
                hit = predicate(tree_of(cond), env) & ~taken
                after = apply(before, inner, children)
                for n in set(before) | set(after):
                    new = after.get(n) or Typed(F.lit(None), "null")
                    if n in after and n in before and after[n] is before[n]:
                        continue
                    fields[n] = _merge(hit, new, fields.get(n))
                taken = taken | hit
        elif kind == "references":
            fields = _references(fields, t[1], t[2])
        elif kind == "hoist":
            fields = _hoist(fields, t[1], t[2])
        elif kind == "nest":
            inner = {n: fields.pop(n) for n in t[1] if n in fields}
            if inner:
                fields[t[2]] = Typed(F.struct(*[x.value.alias(n) for n, x in inner.items()]), ("record", tuple((n, x.type) for n, x in inner.items())))
        elif kind == "scoped":
            fields = _scoped(fields, t[1], t[2])
        elif kind == "pullback":
            fields = {t[1].get(n, n): x for n, x in fields.items()}
        elif kind == "coerce":
            if t[1] in fields:
                new = compile_expr(tree_of(t[2]), {t[1]: fields[t[1]], "v": fields[t[1]], "__value__": fields[t[1]]})
                fields[t[1]] = Typed(new.checked, new.type)
        elif kind == "combine":
            new = compile_expr(tree_of(t[3]), environment(fields))
            fields = {n: x for n, x in fields.items() if n not in t[1]}
            fields[t[2]] = Typed(new.checked, new.type)
        else:
            raise ValueError(f"no such transform: {kind}")
    return fields


def _path(fields, path, inner):
    if not path:
        return apply(fields, [inner])
    head = fields.get(path[0])
    if head is None or not isinstance(head.type, tuple) or head.type[0] != "record":
        return fields
    below = {n: Typed(head.value.getField(n), t) for n, t in head.type[1]}
    new = _path(below, path[1:], inner)
    value = F.when(head.value.isNotNull(), F.struct(*[x.value.alias(n) for n, x in new.items()]))
    return {**fields, path[0]: Typed(value, ("record", tuple((n, x.type) for n, x in new.items())))}


def _hoist(fields, parent, child):
    head = fields.get(parent)
    if head is None or not isinstance(head.type, tuple) or head.type[0] != "record" or child not in dict(head.type[1]):
        return fields
    rest = [(n, t) for n, t in head.type[1] if n != child]
    out = dict(fields)
    if rest:
        out[parent] = Typed(F.when(head.value.isNotNull(), F.struct(*[head.value.getField(n).alias(n) for n, _ in rest])), ("record", tuple(rest)))
    else:
        out.pop(parent)
    out[child] = Typed(head.value.getField(child), dict(head.type[1])[child])
    return out


def _scoped(fields, name, inner):
    """Transforms inside a record, or inside every record of a list."""
    x = fields.get(name)
    if x is None or not isinstance(x.type, tuple):
        return fields

    def rewrite(c, t):
        after = apply({n: Typed(c.getField(n), k) for n, k in t[1]}, inner)
        value = F.struct(*[v.value.alias(n) for n, v in after.items()]) if after else F.lit(None)
        return value, ("record", tuple((n, v.type) for n, v in after.items()))

    if x.type[0] == "record":
        value, t = rewrite(x.value, x.type)
        return {**fields, name: Typed(F.when(x.value.isNotNull(), value), t)}
    if x.type[0] == "list" and isinstance(x.type[1], tuple) and x.type[1][0] == "record":
        t = rewrite(F.lit(None), x.type[1])[1]
        return {**fields, name: Typed(F.transform(x.value, lambda c: rewrite(c, x.type[1])[0]), ("list", t))}
    return fields


def _references(fields, name, renames: dict):
    x = fields.get(name)
    if x is None or not renames:
        return fields
    pairs = F.create_map(*[c for k, v in renames.items() for c in (F.lit(k), F.lit(v).cast("string"))])
    known = F.array(*[F.lit(k) for k in renames])

    def new(c):
        return F.when(F.array_contains(known, c), F.try_element_at(pairs, c)).otherwise(c)

    if x.type == "string":
        return {**fields, name: Typed(new(x.value), "string")}
    if x.type == ("list", "string"):
        return {**fields, name: Typed(F.filter(F.transform(x.value, new), lambda c: c.isNotNull()), x.type)}
    return fields


def select(df, transforms, keep: list[str] | None = None):
    """A frame's columns after the transforms, as one projection."""
    fields = apply(of_columns(df.schema), transforms)
    return df.select(*[c for c in (keep or [])], *[t.value.alias(n) for n, t in fields.items()])
