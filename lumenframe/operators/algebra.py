"""Labelled-array algebra on cell DataFrames: selection, alignment, reshaping, combination. Catalyst expressions and joins only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sel_range(df: DataFrame, dim: str, low, high) -> DataFrame:
    """Labels from low to high, both included."""
    return df.where(F.col(dim).between(low, high))


def sel_points(df: DataFrame, points: DataFrame, dims: list[str]) -> DataFrame:
    """The cells at each row of points; a point that repeats gives its cells again."""
    return df.join(points, dims, "inner")


def mask_semi(df: DataFrame, keep: DataFrame, dims: list[str]) -> DataFrame:
    """Cells whose labels occur in keep (a boolean mask's true labels, or another array's)."""
    return df.join(keep, dims, "left_semi")


def mask_anti(df: DataFrame, drop: DataFrame, dims: list[str]) -> DataFrame:
    return df.join(drop, dims, "left_anti")


def stride(df: DataFrame, dim: str, step: int, start: int = 0) -> DataFrame:
    return df.where((F.col(dim) >= start) & ((F.col(dim) - start) % step == 0))


def take(df: DataFrame, dim: str, positions: list[int]) -> DataFrame:
    """Cells at listed labels in the order given, as pos; repeats are kept. The list is the call's own argument."""
    index = df.sparkSession.createDataFrame([(i, p) for i, p in enumerate(positions)], f"pos int, `{dim}` {df.schema[dim].dataType.simpleString()}")
    return df.join(F.broadcast(index), dim)


def where(df: DataFrame, cond: Column, other, value: str = "value") -> DataFrame:
    return df.withColumn(value, F.when(cond, F.col(value)).otherwise(other))


def crop(df: DataFrame, cond: Column, dims: list[str]) -> DataFrame:
    """The bounding box, over dims, of the cells that satisfy cond."""
    ends = [f(d).alias(f"_{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))]
    box = df.where(cond).agg(*ends)
    inside = reduce(Column.__and__, [F.col(d).between(F.col(f"_lo_{d}"), F.col(f"_hi_{d}")) for d in dims])
    return df.join(F.broadcast(box), inside).select(*df.columns)  # one row


def fill(df: DataFrame, value: str = "value", by: float = 0.0) -> DataFrame:
    """NaN and null become by."""
    return df.withColumn(value, F.coalesce(F.nanvl(value, F.lit(None).cast("double")), F.lit(by)))


def dropna(df: DataFrame, dim: str, how: str = "all", value: str = "value") -> DataFrame:
    """Labels of dim without any (all) or with only (any) present values stay."""
    present = F.col(value).isNotNull() & ~F.isnan(value)
    agg = F.bool_or(present) if how == "all" else F.bool_and(present)
    return df.join(df.groupBy(dim).agg(agg.alias("_ok")).where("_ok"), dim, "left_semi")


def clip(df: DataFrame, low=None, high=None, value: str = "value") -> DataFrame:
    v = F.col(value)
    v = v if low is None else F.greatest(v, F.lit(low))
    v = v if high is None else F.least(v, F.lit(high))
    return df.withColumn(value, v)


def unstack(df: DataFrame, rows: list[str], dim: str, labels: list, value: str = "value") -> DataFrame:
    """A column for each given label of dim."""
    return df.groupBy(*rows).pivot(dim, labels).agg(F.first(value))


def stack(df: DataFrame, rows: list[str], dim: str, value: str = "value") -> DataFrame:
    """The columns beside rows as labels of dim; nulls are left out."""
    out = df.unpivot(rows, [c for c in df.columns if c not in rows], dim, value)
    return out.where(F.col(value).isNotNull())


def combine(a: DataFrame, b: DataFrame, dims: list[str], fn, value: str = "value", how: str = "inner") -> DataFrame:
    """fn of two arrays' values aligned on shared dims; a small side is broadcast by Spark's own size check."""
    right = b.select(*dims, F.col(value).alias("_other"))
    return a.join(right, dims, how).withColumn(value, fn(F.col(value), F.col("_other"))).drop("_other")


def reindex(df: DataFrame, grid: DataFrame, dims: list[str]) -> DataFrame:
    """df on grid's labels, null where it has none."""
    return grid.join(df, dims, "left")


def merge(a: DataFrame, b: DataFrame, dims: list[str], names: tuple[str, str], value: str = "value") -> DataFrame:
    """Two variables on the union of their labels."""
    return a.select(*dims, F.col(value).alias(names[0])).join(b.select(*dims, F.col(value).alias(names[1])), dims, "full")


def merge_same(a: DataFrame, b: DataFrame, dims: list[str], value: str = "value") -> DataFrame:
    """One variable from two pieces; fails where both have a cell with different values."""
    j = a.join(b.withColumnRenamed(value, "_b"), dims, "full")
    clash = F.col(value).isNotNull() & F.col("_b").isNotNull() & (F.col(value) != F.col("_b"))
    return j.withColumn(value, F.when(clash, F.raise_error("conflicting values")).otherwise(F.coalesce(value, "_b"))).drop("_b")


def concat(parts: list[tuple[dict, DataFrame]]) -> DataFrame:
    """Union along new dims: each part with its labels as columns."""
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [df.withColumns({k: F.lit(v) for k, v in labels.items()}) for labels, df in parts])


def sample(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    return df.orderBy(F.rand(seed)).limit(n)


def normalize(df: DataFrame, by: list[str], value: str = "value", keep_constant: bool = False) -> DataFrame:
    """Values from 0 to 1 within each group; constant groups become null, or stay if keep_constant."""
    ends = df.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    flat = F.col(value) if keep_constant else F.lit(None).cast("double")
    scaled = F.when(F.col("_hi") > F.col("_lo"), (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(flat)
    return df.join(ends, by).withColumn(value, scaled).drop("_lo", "_hi")
