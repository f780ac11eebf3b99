"""Relational instances: tables with keys, restricted, extended and multiplied along a mapping.

An instance is a dict of DataFrames. Keys are columns, so nothing has to be renumbered when tables
are put together, and restriction is union and rename that Catalyst pushes projections and filters through.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.migration import Compiled
from ..storage import written
from .transforms import select

Tables = dict[str, DataFrame]


class ProductSizeExceeded(ValueError):
    """A product larger than its limit."""


class NonTermination(ValueError):
    """Dependencies that never settle."""


def union_all(frames: list[DataFrame]) -> DataFrame:
    """All rows, columns by name, missing ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def restrict(tables: Tables, m: Compiled, apply_transforms: bool = False) -> Tables:
    """Each surviving table from the tables mapped to it (or of its own name if there are none)."""
    out = {}
    for v in sorted(m.survivors):
        sources = sorted(a for a, b in m.vertex_map.items() if b == v and a in tables) or ([v] if v in tables else [])
        if sources:
            out[v] = union_all([tables[a] for a in sources])
            if apply_transforms and v in m.transforms:
                out[v] = select(out[v], m.transforms[v])
    return out


def restrict_keys(keys: dict, m: Compiled) -> dict:
    """Foreign keys (edge -> (column, column)) that survive, under their new edges."""
    out = {}
    for e, cols in keys.items():
        to = m.edge_map.get(e)
        if to is not None and to.src in m.survivors and to.tgt in m.survivors:
            out[to] = cols
        elif e in m.edges:
            out[e] = cols
    return out


def extend(tables: Tables, m: Compiled) -> Tables:
    """Every table goes to its target, columns are united and missing ones null; targets without rows are empty."""
    groups: dict[str, list[str]] = {}
    for a in sorted(tables):
        groups.setdefault(m.target(a), []).append(a)
    out = {v: union_all([tables[a] for a in sources]) for v, sources in groups.items()}
    spark = next(iter(tables.values())).sparkSession if tables else None
    for v in m.survivors:
        if v not in out and spark:
            out[v] = spark.createDataFrame([], "_empty boolean").drop("_empty")
    return out


def ordinals(df: DataFrame, *order, name: str = "ordinal") -> DataFrame:
    """``df`` with row numbers from 0 by ``order`` under ``name`` (a column of that name is replaced): per-partition counts, no single task.

    The sorted rows are written once, so that counting and numbering see the same partitions. Ties are numbered in some order.
    """
    at, kept = F.monotonically_increasing_id(), [F.col(f"`{c}`") for c in df.columns if c != name]
    ranked = written(df.orderBy(*order).select(F.struct(*kept).alias("row"), F.shiftrightunsigned(at, 33).alias("part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("place")), "sorted")
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row a partition
    starts = ranked.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("base"))
    return ranked.join(F.broadcast(starts), "part").select("row.*", (F.col("base") + F.col("place")).alias(name))


def product(tables: Tables, m: Compiled, max_size: int = 1_000_000, strict: bool = False) -> Tables:
    """Per target the product of the tables mapped to it, later columns win. Empty factors are left out unless ``strict``."""
    out = {}
    for v in sorted(m.survivors):
        sources = sorted(a for a, b in m.vertex_map.items() if b == v and a in tables) or ([v] if v in tables else [])
        if len(sources) < 2:
            if sources:
                out[v] = tables[sources[0]]
            continue
        sizes = {a: tables[a].limit(max_size + 1).count() for a in sources}
        used = [a for a in sources if strict or sizes[a]]
        if not used:
            out[v] = tables[sources[0]]
            continue
        n = 1
        for a in used:
            n *= sizes[a]
        if n > max_size:
            raise ProductSizeExceeded(f"{v}: {n} rows, limit {max_size}")
        whole = tables[used[0]]
        for a in used[1:]:  # a product is what this operator means; its size was checked
            whole = whole.drop(*[c for c in whole.columns if c in tables[a].columns]).crossJoin(tables[a])
        out[v] = whole
    return out


def _holds(row: dict):
    cond = F.lit(True)
    for c, v in row.items():
        cond = cond & F.col(c).eqNullSafe(F.lit(v))
    return cond


def chase(tables: Tables, dependencies: list[tuple[str, dict, str, dict]], max_iterations: int = 100) -> Tables:
    """Rows that dependencies demand. (table, pattern, table, row): if a row matches the pattern, there must be such a row.

    All guards of a round are one aggregation per table; demanded rows are constants, so rounds are few.
    """
    tables = dict(tables)
    spark = next(iter(tables.values())).sparkSession if tables else None
    for _ in range(max_iterations):
        guards: dict[str, dict] = {}
        for i, (a, pattern, b, row) in enumerate(dependencies):
            if a in tables:
                guards.setdefault(a, {})[f"p{i}"] = _holds(pattern) if set(pattern) <= set(tables[a].columns) else F.lit(False)
            if b in tables:
                guards.setdefault(b, {})[f"c{i}"] = _holds(row) if set(row) <= set(tables[b].columns) else F.lit(False)
        truth: dict = {}
        for t, g in guards.items():
            truth |= tables[t].agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(k) for k, c in g.items()]).first().asDict()
        due = [(b, row) for i, (a, _, b, row) in enumerate(dependencies) if truth.get(f"p{i}") and not truth.get(f"c{i}")]
        if not due:
            return tables
        for b, row in due:
            old = tables.get(b)
            kinds = {f.name: f.dataType for f in old.schema.fields} if old is not None else {}
            new = spark.range(1).select(*[F.lit(v).cast(kinds[c]).alias(c) if c in kinds else F.lit(v).alias(c) for c, v in row.items()])
            tables[b] = new if old is None or not old.columns else old.unionByName(new, allowMissingColumns=True)
    raise NonTermination(f"not settled after {max_iterations} rounds")


def dependencies_of(schema) -> list[tuple[str, dict, str, dict]]:
    """What a schema's required edges demand: where a table has rows, the table it needs has one."""
    return [(v, {}, e.tgt, {}) for v, es in sorted(schema.required.items()) for e in sorted(es, key=lambda e: (e.src, e.tgt, e.kind))]


def dangling(child: DataFrame, parent: DataFrame, column: str, key: str) -> DataFrame:
    """Rows whose key has no parent."""
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)), column, "left_anti")


def coverage(df: DataFrame, checks: dict) -> DataFrame:
    """total, successful, failed and ratio (1.0 for nothing) of rows that meet all ``checks`` (name -> condition), and failures by name."""
    ok = reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(False)) for c in checks.values()], F.lit(True))
    total = F.count("*")
    aggs = [total.alias("total"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed")]
    aggs += [F.count_if(~F.coalesce(c, F.lit(False))).alias(f"failed_{n}") for n, c in checks.items()]
    return df.agg(*aggs).withColumn("ratio", F.when(F.col("total") == 0, 1.0).otherwise(F.col("successful") / F.col("total")))
