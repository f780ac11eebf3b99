"""Three-way merge of keyed tables: base, ours and theirs grouped by key, and one CASE."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


OUTCOME = ("kept", "fate", "conflict")


def three_way_merge(base: DataFrame, ours: DataFrame, theirs: DataFrame, keys: list[str], outcome: tuple[str, str, str] = OUTCOME) -> DataFrame:
    """Every key's merged columns, with ``fate`` (base, ours, theirs, both) or ``conflict``.

    A row that one side leaves alone takes the other side's. Both sides alike: that value. Both sides added
    differently: a conflict without a row (``kept`` false). Both modified differently, or one modified what the
    other removed: a conflict in which the base stays.

    Null keys are keys like others. A side has one row per key; of several the least counts. ``outcome`` names the three columns
    that are added, which no column of the tables may be called.
    """
    values = [c for c in base.columns if c not in keys]
    if taken := set(outcome) & set(base.columns):
        raise ValueError(f"columns named {sorted(taken)}: give other names in ``outcome``")
    sides = [df.select(F.struct(*[F.col(f"`{k}`") for k in keys]).alias("k"), F.lit(i).alias("side"), F.struct(*[F.col(f"`{c}`") for c in values]).alias("row")) for i, df in enumerate((base, ours, theirs))]
    # One grouping instead of two joins; it also puts null keys together.
    one = F.first if "map<" in sides[0].schema["row"].dataType.simpleString() else F.min
    pick = [one(F.when(F.col("side") == i, F.col("row")), *([True] if one is F.first else [])).alias(n) for i, n in enumerate("bot")]
    j = sides[0].unionByName(sides[1]).unionByName(sides[2]).groupBy("k").agg(*pick)
    b, o, t = F.col("b"), F.col("o"), F.col("t")
    o_same, t_same, alike = b.eqNullSafe(o), b.eqNullSafe(t), o.eqNullSafe(t)
    in_b, in_o, in_t = b.isNotNull(), o.isNotNull(), t.isNotNull()
    conflict = (
        F.when(o_same | t_same | alike, F.lit(None).cast("string"))
        .when(~in_b, "both_added")
        .when(in_o & in_t, "both_modified")
        .otherwise("delete_modify")
    )
    value = F.when(o_same, t).when(t_same, o).when(alike, o).when(in_b, b)
    fate = F.when(conflict.isNotNull(), "conflict").when(o_same & t_same, "base").when(o_same, "theirs").when(t_same, "ours").otherwise("both")
    out = j.select("k", value.alias("v"), fate.alias("fate"), conflict.alias("conflict"))
    kept, fate_name, conflict_name = outcome
    mine = [F.col("k").getField(k).alias(k) for k in keys]
    return out.select(*mine, F.col("v").isNotNull().alias(kept), *[F.col("v").getField(c).alias(c) for c in values], F.col("fate").alias(fate_name), F.col("conflict").alias(conflict_name))


def merged_rows(merged: DataFrame, outcome: tuple[str, str, str] = OUTCOME) -> DataFrame:
    """The rows that stand."""
    return merged.where(F.col(outcome[0])).drop(*outcome)


def conflicts(merged: DataFrame, outcome: tuple[str, str, str] = OUTCOME) -> DataFrame:
    return merged.where(F.col(outcome[2]).isNotNull())
