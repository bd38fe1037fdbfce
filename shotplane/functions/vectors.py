"""Column functions on vectors and signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ZERO = 0.0


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    d = "array<double>"
    return total(F.zip_with(F.slice(a.cast(d), 1, n), F.slice(b.cast(d), 1, n), lambda x, y: x * y))


def normalized(v: Column) -> Column:
    """The vector over its length, which counts as 1e-6 at least."""
    w = v.cast("array<double>")
    return F.transform(w, lambda x: x / F.greatest(F.sqrt(dot(v, v)), F.lit(1e-6)))


def centroids(df: DataFrame, keys: list[str], vector: str = "embed") -> DataFrame:
    """The normalised sum of each group's vectors: keys, centroid, n."""
    parts = df.select(*keys, F.posexplode(F.col(vector).cast("array<double>")).alias("pos", "x"))
    sums = parts.groupBy(*keys, "pos").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    return sums.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("v"), F.max("n").alias("n")).select(*keys, normalized(F.col("v")).alias("centroid"), "n")


def sig_dist(a: Column, b: Column) -> Column:
    """Mean absolute difference of two grey signatures over 255; 1 if either is empty or they differ in length."""
    d = "array<double>"
    diff = total(F.zip_with(a.cast(d), b.cast(d), lambda x, y: F.abs(x - y)))
    return F.when((F.coalesce(F.size(a), F.lit(0)) != F.coalesce(F.size(b), F.lit(0))) | (F.coalesce(F.size(a), F.lit(0)) <= 0), 1.0).otherwise(diff / (F.size(a) * 255.0))


def stretch(values: Column) -> Column:
    """A grey signature's levels stretched to 0..255, truncated."""
    lo, hi = F.array_min(values), F.array_max(values)
    return F.transform(values, lambda v: F.floor((v - lo) * 255 / F.greatest(hi - lo, F.lit(1))).cast("int"))


def percentile_by_index(values: Column, share: float = 0.9) -> Column:
    """The value at index floor(share * n) of the sorted array, without interpolation; 0 if it is empty."""
    s = F.array_sort(values)
    return F.when(F.size(values) > 0, F.element_at(s, F.floor(F.size(values) * F.lit(share)).cast("int") + 1)).otherwise(0.0)


def named(values: Column, names: list[str], name: str) -> Column:
    """The value that stands at a name's place, 0 if the name or the place is missing."""
    at = names.index(name) if name in names else -1
    return F.coalesce(F.get(values, F.lit(at)), F.lit(0.0)) if at >= 0 else F.lit(0.0)
