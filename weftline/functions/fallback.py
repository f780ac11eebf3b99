"""Expressions that columns cannot hold (recursion, functions as values, mixed lists), evaluated in Arrow batches.

The slow path: use it only where ``compile_expr`` raises ``Unsupported``.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from .evaluate import ExprError, evaluate
from .syntax import free_names


#: Values that a worker keeps, for rows with the same input; beyond that the oldest go.
KEPT = 1 << 16


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out over all cores. A table of a few MB is read by one or two tasks, and where each row is long work they would do it all."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def _exact(kind: pa.DataType) -> bool:
    """Are equal values of the type the same value? Of floats 0.0 and -0.0 are not."""
    return any(f(kind) for f in (pa.types.is_integer, pa.types.is_boolean, pa.types.is_string, pa.types.is_large_string, pa.types.is_binary, pa.types.is_large_binary))


def interpreted(e, columns: list[str], returns: str) -> Column:
    """The value of a tree per row, null where it has none. A batch crosses to Python once, as Arrow columns; rows with the same input are evaluated once."""
    used = sorted(free_names(e) & set(columns))
    kind = to_arrow_type(_parse_datatype_string(returns))

    def value(env: dict):
        try:
            return evaluate(e, env)
        except (ExprError, RecursionError):
            return None

    known: dict = {}

    def of(row: tuple):
        if row not in known:
            if len(known) >= KEPT:
                del known[next(iter(known))]
            known[row] = value(dict(zip(used, row, strict=True)))
        return known[row]

    @F.arrow_udf(returns)
    def run(rows: pa.Array) -> pa.Array:
        parts = [rows.field(c).to_pylist() for c in used]
        every = zip(*parts, strict=True) if used else (() for _ in range(len(rows)))
        again = all(_exact(rows.field(c).type) for c in used)
        return pa.array([of(r) if again else value(dict(zip(used, r, strict=True))) for r in every], kind)

    return run(F.struct(*[F.col(f"`{c}`") for c in used]) if used else F.struct(F.lit(1).alias("_")))
