"""Checks of an identification: against reigns, against references, against fingerprints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import fold

# Points for fields that agree in case-free text.
EVIDENCE = {"ruler": 3, "nominal": 3, "year": 2, "mint": 1}
#: A doubtful identification has no more confidence than this, and no estimate.
DOUBTFUL = 72


def agreeing(coins: DataFrame, others: DataFrame, points: dict[str, int], least: int, id_col: str) -> DataFrame:
    """(coin_id, id_col, score) of pairs that agree in enough points; one equi-join for each field, added up."""
    text = lambda c: F.lower(F.col(c).cast("string")).alias(c)
    hits = [coins.select("coin_id", text(c)).join(others.select(id_col, text(c)), c).where(F.col(c) != "").select("coin_id", id_col, F.lit(p).alias("p")) for c, p in points.items()]
    scored = reduce(DataFrame.unionByName, hits).groupBy("coin_id", id_col).agg(F.sum("p").cast("int").alias("score"))
    return scored.where(F.col("score") >= least)


def chronology(coins: DataFrame, reigns: DataFrame) -> DataFrame:
    """Adds mismatch: rulers of the coin's year are known and the coin's is none of them.

    reigns: (name, from_year, to_year). Where it is true, confidence is at most DOUBTFUL and the
    estimate is zero.
    """
    years = reigns.select(fold(F.col("name")).alias("_name"), F.explode(F.sequence("from_year", "to_year")).alias("year")).groupBy("year").agg(F.collect_set("_name").alias("_names"))
    ruler = fold(F.col("ruler"))
    named = F.exists("_names", lambda n: F.contains(ruler, n) | F.contains(n, ruler))
    mismatch = F.coalesce(F.col("_names").isNotNull() & (ruler != "") & (ruler != "nie ustalono") & ~named, F.lit(False))
    out = coins.join(years, "year", "left").withColumn("mismatch", mismatch).drop("_names")
    doubt = lambda c: F.when(F.col("mismatch"), 0.0).otherwise(F.col(c))
    return out.withColumns({"confidence": F.when(F.col("mismatch"), F.least(F.col("confidence"), F.lit(DOUBTFUL))).otherwise(F.col("confidence")), "estimate_low": doubt("estimate_low"), "estimate_high": doubt("estimate_high")})


def fingerprint_status(score: Column, matched: Column, conflicts: Column) -> Column:
    """supported, conflict or neutral from five features on; fixed values: 85 without conflicts, two conflicts or under 45."""
    return F.when(matched < 5, "neutral").when((score >= 85) & (conflicts == 0), "supported").when((conflicts >= 2) | (score < 45), "conflict").otherwise("neutral")


def verdict(checks: Column) -> Column:
    """supported, conflict, mixed or neutral from an array of single verdicts."""
    yes, no = F.array_contains(checks, "supported"), F.array_contains(checks, "conflict")
    return F.when(yes & no, "mixed").when(no, "conflict").when(yes, "supported").otherwise("neutral")


def route(stage: Column, samples: Column, accuracy: Column, hits: Column, quality: Column, ambiguity: Column) -> Column:
    """fast only for a basic stage that passes all thresholds (fixed values), else strong and the first reason."""
    return (
        F.when(stage != "basic", "strong: stage")
        .when(samples < 100, "strong: samples")
        .when(accuracy < 97, "strong: accuracy")
        .when(hits < 2, "strong: hits")
        .when(quality < 90, "strong: quality")
        .when(ambiguity > 10, "strong: ambiguity")
        .otherwise("fast")
    )


def reference_score(label: Column, year: Column, nominal_forms: Column, ruler_forms: Column) -> Column:
    """Year 4, a form of the nominal 4, of the ruler 3, the word poland 2."""
    has = lambda forms: F.exists(forms, lambda f: F.contains(label, f))
    return F.contains(label, year).cast("int") * 4 + has(nominal_forms).cast("int") * 4 + has(ruler_forms).cast("int") * 3 + F.contains(label, F.lit("poland")).cast("int") * 2


def reference_status(label: Column, year: Column, nominal_forms: Column, ruler_forms: Column) -> Column:
    has = lambda forms: F.exists(forms, lambda f: F.contains(label, f))
    core = F.contains(label, year) & has(nominal_forms)
    return F.when(core & has(ruler_forms), "supported").when(core & (F.size(ruler_forms) > 0), "possible_conflict").otherwise("neutral")
