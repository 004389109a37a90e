"""Order-dependent steps over unordered data: each takes the columns that give the order, so any partitioning gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key. A map-side minimum goes before the shuffle, so a hot key costs one row per task."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, "_first.*").select(*df.columns)


def capped(df: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """The first rows of each key up to a number (a feature of the output, as its reports keep so many cells per column).

    The planner cuts each partition to that number before the shuffle.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")


def before_boundary(df: DataFrame, keys: list[str], order: str, boundary: Column) -> DataFrame:
    """Rows of each key before its first row for which boundary holds; all rows where there is none."""
    stop = df.filter(boundary).groupBy(*keys).agg(F.min(order).alias("_stop"))
    return df.join(stop, keys, "left").filter(F.col("_stop").isNull() | (F.col(order) < F.col("_stop"))).drop("_stop")


def first_seen_ids(df: DataFrame, scope: list[str], keys: list[str], order: list[str], prefix: str = "inline-") -> DataFrame:
    """(scope, keys, id): ids in the order in which the keys first appear in their scope. The numbering sorts distinct keys only."""
    seen = df.groupBy(*scope, *keys).agg(F.min(F.struct(*order)).alias("_at"))
    w = Window.partitionBy(*scope).orderBy("_at", *keys)
    return seen.select(*scope, *keys, F.concat(F.lit(prefix), F.row_number().over(w).cast("string")).alias("id"))


def unpivot(df: DataFrame, keep: list[str], groups: dict[str, dict[str, str]], name: str, absent_zero: bool = True) -> DataFrame:
    """One row per group of columns with any value: groups maps a group's name to {field: column}. Numbers of 0 are absent."""
    fields = list(dict.fromkeys(f for g in groups.values() for f in g))
    rows = F.array(*(
        F.struct(F.lit(g).alias(name), *((F.col(cols[f]) if f in cols else F.lit(None).cast("double")).alias(f) for f in fields)) for g, cols in groups.items()
    ))
    out = df.select(*keep, F.inline(rows))
    some = None
    for f in fields:
        there = F.col(f).isNotNull() & ((F.col(f) != 0) if absent_zero else F.lit(True))
        some = there if some is None else some | there
    return out.filter(some)
