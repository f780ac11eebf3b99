"""Differences between schemas, and which of them break readers."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import CLASSES, USAGE, Protocol, Schema, edge_key
from .migration import tightened


@dataclass(frozen=True, order=True)
class Change:
    facet: str
    key: str
    old: str | None
    new: str | None


def _keyed(facet: str, a: dict, b: dict) -> list[Change]:
    text = lambda v: json.dumps(v, default=str, sort_keys=True) if not isinstance(v, str) else v
    out = []
    for k in sorted({*map(str, a), *map(str, b)}):
        x, y = ({str(i): v for i, v in d.items()}.get(k) for d in (a, b))
        if x is None:
            out.append(Change(f"added_{facet}", k, None, text(y)))
        elif y is None:
            out.append(Change(f"removed_{facet}", k, text(x), None))
        elif x != y:
            out.append(Change(f"modified_{facet}", k, text(x), text(y)))
    return out


def edge_text(e) -> str:
    return f"{e.src} -{e.kind}[{e.name if e.name is not None else ''}]-> {e.tgt}"


def diff(a: Schema, b: Schema) -> list[Change]:
    """All changes, facet by facet."""
    out = [Change("added_vertices", v, None, b.vertices[v]) for v in sorted(set(b.vertices) - set(a.vertices))]
    out += [Change("removed_vertices", v, a.vertices[v], None) for v in sorted(set(a.vertices) - set(b.vertices))]
    out += [Change("kind_changes", v, k, b.vertices[v]) for v, k in sorted(a.vertices.items()) if v in b.vertices and b.vertices[v] != k]
    out += [Change("added_edges", edge_text(e), None, e.kind) for e in sorted(b.edges - a.edges, key=edge_key)]
    out += [Change("removed_edges", edge_text(e), e.kind, None) for e in sorted(a.edges - b.edges, key=edge_key)]
    flat = lambda s: {f"{v}.{k}": x for v, c in s.constraints.items() for k, x in c.items()}
    out += _keyed("constraints", flat(a), flat(b))
    need = lambda s: {f"{v}: {edge_text(e)}": "required" for v, es in s.required.items() for e in es}
    out += _keyed("required", need(a), need(b))
    for facet, name in (("hyper_edges", "hyper_edges"), ("nsids", "nsids"), ("variants", "variants"), ("recursion_points", "recursion"), ("spans", "spans"), ("coercions", "coercions"), ("mergers", "mergers"), ("defaults", "defaults"), ("policies", "policies")):
        out += _keyed(facet, getattr(a, name), getattr(b, name))
    for facet, name in (("order_changes", "orderings"), ("usage_mode_changes", "usage"), ("nominal_changes", "nominal")):
        x, y = getattr(a, name), getattr(b, name)
        for k in sorted({*x, *y}, key=str):
            if x.get(k) != y.get(k):
                key = edge_text(k) if hasattr(k, "src") else str(k)
                out.append(Change(facet, key, None if x.get(k) is None else str(x[k]), None if y.get(k) is None else str(y[k])))
    return out


@dataclass(frozen=True, order=True)
class Verdict:
    breaking: bool
    kind: str
    key: str


def classify(changes: list[Change], protocol: Protocol | None = None) -> list[Verdict]:
    """Each change as one of the breaking or harmless kinds; changes of no consequence for readers are left out."""
    out = []
    for c in changes:
        f = c.facet
        if f == "removed_vertices":
            out.append(Verdict(True, "RemovedVertex", c.key))
        elif f == "removed_edges":
            governed = protocol is None or not protocol.rules or protocol.rule(c.old) is not None
            out.append(Verdict(governed, "RemovedEdge", c.key))
        elif f == "kind_changes":
            out.append(Verdict(True, "KindChanged", c.key))
        elif f == "added_vertices":
            out.append(Verdict(False, "AddedVertex", c.key))
        elif f == "added_edges":
            out.append(Verdict(False, "AddedEdge", c.key))
        elif f == "modified_constraints":
            hard = tightened(c.key.rpartition(".")[2], c.old, c.new, True)
            out.append(Verdict(hard, "ConstraintTightened" if hard else "ConstraintRelaxed", c.key))
        elif f == "added_constraints":
            out.append(Verdict(True, "ConstraintAdded", c.key))
        elif f == "removed_constraints":
            out.append(Verdict(False, "ConstraintRemoved", c.key))
        elif f == "removed_variants":
            out.append(Verdict(True, "RemovedVariant", c.key))
        elif f == "order_changes" and c.new is None:
            out.append(Verdict(True, "OrderToUnordered", c.key))
        elif f == "removed_recursion_points":
            out.append(Verdict(True, "RecursionBroken", c.key))
        elif f == "usage_mode_changes" and USAGE.index(c.new or USAGE[0]) > USAGE.index(c.old or USAGE[0]):
            out.append(Verdict(True, "LinearityTightened", c.key))
        elif f == "removed_coercions":
            out.append(Verdict(True, "CoercionRemoved", c.key))
        elif f == "modified_coercions":
            rank = lambda t: next((i for i, n in enumerate(CLASSES) if f"'{n}'" in t), len(CLASSES))
            if rank(c.new) > rank(c.old):
                out.append(Verdict(True, "CoercionClassDowngraded", c.key))
    return out


def compatible(verdicts: list[Verdict]) -> bool:
    return not any(v.breaking for v in verdicts)


def report_text(verdicts: list[Verdict]) -> str:
    lines = [f"{'compatible' if compatible(verdicts) else 'BREAKING'}: {sum(v.breaking for v in verdicts)} breaking, {sum(not v.breaking for v in verdicts)} other"]
    return "\n".join(lines + [f"  {'!' if v.breaking else ' '} {v.kind}: {v.key}" for v in sorted(verdicts, key=lambda v: (not v.breaking, v.kind, v.key))])


def report_json(verdicts: list[Verdict]) -> str:
    return json.dumps({"compatible": compatible(verdicts), "breaking": [[v.kind, v.key] for v in verdicts if v.breaking], "other": [[v.kind, v.key] for v in verdicts if not v.breaking]})


def diff_frames(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Row changes between two versions of a keyed table: keys and change (added, removed, modified)."""
    values = [c for c in old.columns if c not in keys]
    a = old.select(*keys, F.struct(*values).alias("a"))
    b = new.select(*keys, F.struct(*values).alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("modified")
    return a.join(b, keys, "full").where(~F.col("a").eqNullSafe(F.col("b"))).select(*keys, change.alias("change"))
