"""Exact order statistics of groups, whatever their size, without a group in one task or one buffer.

Values are counted first, so equal ones are one row. Each group's distinct values are cut into ``CUTS``
buckets at approximate quantiles, which sketches of bounded size give; sums over buckets tell which ones
hold the wanted ranks, and only the values of these are put in order, bucket by bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTS = 64


def _steps(start: dict[str, Column], *steps) -> Column:
    """Steps that each add named values told from those before, so each is computed once."""
    out = F.struct(*(c.alias(k) for k, c in start.items()))
    for step in steps:
        told = lambda x: F.struct(*(c.alias(k) for k, c in step(x).items()))  # noqa: B023, E731 - called at once
        out = F.get(F.transform(F.array(out), told), F.lit(0))
    return out


def interpolated(low: Column, high: Column, share: Column) -> Column:
    """low * (1 - share) + high * share with the first product unrounded, as engines with fused products have it.

    What is rounded in between decides on which side of a half such a value falls. The rounding errors of
    the product, by halves of 26 bits of its factors, and of the sum are told exactly and added again.
    """
    half = F.lit(134217729.0)
    x = _steps(
        {"low": low, "high": high, "share": share, "rest": 1 - share},
        lambda x: {"low": x["low"], "rest": x["rest"], "a": x["low"] * x["rest"], "b": x["high"] * x["share"], "p": x["low"] * half, "q": x["rest"] * half},
        lambda x: {"a": x["a"], "b": x["b"], "low": x["low"], "rest": x["rest"], "a1": x["p"] - (x["p"] - x["low"]), "b1": x["q"] - (x["q"] - x["rest"]), "total": x["a"] + x["b"]},
        lambda x: {"a": x["a"], "b": x["b"], "total": x["total"], "a1": x["a1"], "b1": x["b1"], "a2": x["low"] - x["a1"], "b2": x["rest"] - x["b1"], "back": x["total"] - x["a"]},
        lambda x: {"exact": x["total"] + (((x["a"] - (x["total"] - x["back"])) + (x["b"] - x["back"])) + (x["a2"] * x["b2"] - (((x["a"] - x["a1"] * x["b1"]) - x["a2"] * x["b1"]) - x["a1"] * x["b2"])))},
    )
    return F.when((low == high) | (share == 0), low).otherwise(x["exact"])


def quantile(values: Column, share: float) -> Column:
    """Of a sorted array, with interpolation between the two nearest values; null of an empty one."""
    place = (F.size(values) - 1) * F.lit(share)
    low, high = (F.get(values, f(place).cast("int")) for f in (F.floor, F.ceil))
    return F.when(F.size(values) > 0, interpolated(low, high, place - F.floor(place)))


def ranked(rows: DataFrame, by: list[str], value: str, ranks: Column) -> DataFrame:
    """by, total, rank and value: the values at some ranks (from 1) of each group's non-null values.

    ranks is an array of bigints told from the column ``total``, the number of these values.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    # null keys join as themselves
    counts = rows.where(F.col(value).isNotNull()).groupBy(*(F.col(c).alias(k) for c, k in zip(by, keys)), F.col(value).alias("_value")).agg(F.count("*").alias("_n"))
    cuts = counts.groupBy(*keys).agg(F.percentile_approx("_value", [i / CUTS for i in range(1, CUTS)], F.lit(CUTS * 10)).alias("_cuts"), F.sum("_n").alias("total"))
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    dealt = counts.alias("c").join(cuts.alias("g"), same("c", "g")).select(*(f"c.{k}" for k in keys), "_value", "_n", "total", "_cuts", F.size(F.filter("_cuts", lambda x: x < F.col("_value"))).alias("_bucket"))
    # a group has CUTS of these rows at most
    low, high = F.get("_cuts", F.col("_bucket") - 1), F.get("_cuts", F.col("_bucket"))
    sums = dealt.groupBy(*keys, "_bucket").agg(F.sum("_n").alias("_in"), *(F.first(x).alias(c) for x, c in ((F.col("total"), "total"), (low, "_low"), (high, "_high"))))
    upto = F.sum("_in").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0))
    held = sums.withColumn("_before", upto - F.col("_in")).withColumn("_ranks", F.filter(F.array_distinct(ranks), lambda r: (r > F.col("_before")) & (r <= F.col("_before") + F.col("_in"))))
    # sketches need not come out alike twice, so buckets are told by their own ends from here on
    held = held.where(F.size("_ranks") > 0).select(*keys, "_bucket", "_low", "_high", "_before", "_ranks", "total")
    inside = F.coalesce(F.col("_value") > F.col("_low"), F.lit(True)) & F.coalesce(F.col("_value") <= F.col("_high"), F.lit(True))
    near = counts.alias("d").join(held.alias("h"), [*same("d", "h"), inside]).select(*(f"d.{k}" for k in keys), "total", "_bucket", "_value", "_n", "_before", "_ranks")
    last = F.col("_before") + F.sum("_n").over(Window.partitionBy(*keys, "_bucket").orderBy("_value").rowsBetween(Window.unboundedPreceding, 0))
    placed = near.withColumn("_last", last).withColumn("rank", F.explode(F.filter("_ranks", lambda r: (r <= F.col("_last")) & (r > F.col("_last") - F.col("_n")))))
    return placed.select(*(F.col(k).alias(c) for k, c in zip(keys, by)), "total", "rank", F.col("_value").alias(value))


def percentiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """by, n and a column for each share: percentiles with interpolation between the two nearest values."""
    place = lambda p: (F.col("total") - 1) * F.lit(p)
    ranks = F.array(*(x for p in shares.values() for x in (F.floor(place(p)) + 1, F.ceil(place(p)) + 1)))
    found = ranked(rows, by, value, ranks).groupBy(*by, "total").agg(F.map_from_entries(F.collect_list(F.struct("rank", F.col(value).cast("double").alias("v")))).alias("_at"))

    def told(p: float) -> Column:
        low, high = (F.element_at("_at", f(place(p)) + 1) for f in (F.floor, F.ceil))
        return interpolated(low, high, place(p) - F.floor(place(p)))

    return found.select(*by, F.col("total").alias("n"), *(told(p).alias(name) for name, p in shares.items()))


def upper_middle(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by and value: the upper of the two middle values, without a mean."""
    return ranked(rows, by, value, F.array(F.floor(F.col("total") / 2) + 1)).select(*by, value)
