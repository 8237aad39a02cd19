"""Coins that may be the same one: fields agree where one contains the other, and unknown ones agree with all."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("ruler", "year", "nominal", "mint")
LEAST = 3  # fields that both know; all of these must agree
GRAM = 3


def _grams(text: Column, size: Column) -> Column:
    """All runs of so many characters, each once."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substr(text, i, size)))


def related_values(rows: DataFrame, field: str) -> DataFrame:
    """(value, other) for the distinct values of a field of which one contains the other, or that are equal.

    A text that another contains has all its runs of three characters in it, so it asks for its rarest one
    alone; shorter texts ask for themselves. Only values that share it are looked at.
    """
    values = rows.select(F.col(field).alias("value")).where(F.col("value").isNotNull()).distinct()
    size = F.least(F.length("value"), F.lit(GRAM))
    lists = F.flatten(F.array(*(F.when(F.length("value") >= n, _grams(F.col("value"), F.lit(n))).otherwise(F.array().cast("array<string>")) for n in range(1, GRAM + 1))))
    index = values.select(F.col("value").alias("other"), F.explode(lists).alias("gram"))
    often = index.groupBy("gram").agg(F.count("*").alias("n"))
    asked = values.select("value", F.explode(_grams(F.col("value"), size)).alias("gram")).join(often, "gram").groupBy("value").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    inside = asked.join(index, "gram").where(F.col("other").contains(F.col("value"))).select("value", "other")
    return inside.unionByName(inside.select(F.col("other").alias("value"), F.col("value").alias("other"))).distinct()


def likely_duplicates(coins: DataFrame, id_col: str = "coin_id") -> DataFrame:
    """Each coin with ``first`` (smallest id of its identity) and ``n_same``: other coins that may be the same.

    Fields are texts or null (unknown). Two coins agree when both know at least three of the four fields
    and each field that both know is equal or contained in the other's. Coins of one identity are counted
    first, so a popular one is one row; pairs of identities come from the four choices of three fields, by
    a join on all three after one side's values were replaced by what they agree with.
    """
    identity = [F.col(f).cast("string").alias(f) for f in FIELDS]
    texts = coins.select(F.col(id_col).alias("id"), *identity).select("id", *(F.nullif(F.lower(F.trim(f)), F.lit("")).alias(f) for f in FIELDS))
    groups = texts.groupBy(*FIELDS).agg(F.min("id").alias("first"), F.count("*").alias("n"))
    known = sum((F.col(f).isNotNull().cast("int") for f in FIELDS), F.lit(0))
    groups = groups.where(known >= LEAST)
    related = {f: related_values(groups, f) for f in FIELDS}
    pairs = None
    for chosen in combinations(FIELDS, LEAST):
        left = groups.select(F.col("first").alias("a"), *(F.col(f).alias(f"a_{f}") for f in FIELDS))
        for f in chosen:  # what the value agrees with
            left = left.join(related[f].select(F.col("value").alias(f"a_{f}"), F.col("other").alias(f"is_{f}")), f"a_{f}")
        right = groups.select(F.col("first").alias("b"), F.col("n").alias("b_n"), *(F.col(f).alias(f"b_{f}") for f in FIELDS))
        on = F.col("a") != F.col("b")
        for f in chosen:
            on = on & (F.col(f"is_{f}") == F.col(f"b_{f}"))
        (left_out,) = set(FIELDS) - set(chosen)
        x, y = F.col(f"a_{left_out}"), F.col(f"b_{left_out}")
        on = on & F.coalesce(x.contains(y) | y.contains(x), F.lit(True))
        own = left.join(right, on).select("a", "b", "b_n")
        pairs = own if pairs is None else pairs.unionByName(own)
    others = pairs.distinct().groupBy("a").agg(F.sum("b_n").alias("others"))
    counted = groups.join(others, F.col("first") == F.col("a"), "left").select(*FIELDS, "first", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_same"))
    t = texts.alias("t")
    same = F.lit(True)
    for f in FIELDS:
        same = same & F.col(f"t.{f}").eqNullSafe(F.col(f"c.{f}"))
    return t.join(counted.alias("c"), same, "left").select(F.col("t.id").alias(id_col), F.coalesce("c.first", "t.id").alias("first"), F.coalesce("c.n_same", F.lit(0)).alias("n_same"))
