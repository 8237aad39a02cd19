"""Order statistics against numpy, with ties, a hot group, null keys and null values."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tessera.operators import selection


def test_against_numpy(spark, monkeypatch):
    monkeypatch.setattr(selection, "CUTS", 8)
    rng = np.random.default_rng(3)
    groups = {"hot": rng.integers(0, 5000, 20_000), "ties": np.repeat([1, 2, 2, 9], 500), "one": np.array([7]), "two": np.array([1, 4]), None: rng.integers(-50, 50, 301), "odd": np.array([3, 1, 2])}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("hot", None), ("nothing", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    shares = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.9, "e": 1.0}
    got = {r.g: r for r in selection.percentiles(df, ["g"], "v", shares).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert got[g].n == len(values) and np.allclose([got[g][name] for name in shares], np.quantile(values, list(shares.values())))
    upper = {r.g: r.v for r in selection.upper_middle(df, ["g"], "v").collect()}
    assert upper == {g: float(np.sort(v)[len(v) // 2]) for g, v in groups.items()}
    assert selection.percentiles(df.where("false"), ["g"], "v", shares).collect() == []


def test_interpolation_rounds_as_sql_does(spark):
    """Values on whose side of a half the rounding in between decides."""
    for places, low, high, share in ((47, 79656.04, 85949.69, 0.9), (46, 27736.85, 33643.45, 0.25)):
        at = int((places - 1) * share)
        values = [low] * (at + 1) + [high] * (places - at - 1)
        expected = duckdb.execute(f"SELECT quantile_cont(v, {share}) FROM (SELECT unnest(?) AS v)", [values]).fetchone()[0]
        df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
        assert selection.percentiles(df, ["g"], "v", {"p": share}).first().p == expected
        assert df.groupBy("g").agg(F.array_sort(F.collect_list("v")).alias("v")).select(selection.quantile(F.col("v"), share)).first()[0] == expected


def test_buckets_are_told_by_their_own_ends(spark):
    """Sketches are told once: cuts that come out otherwise a second time would put values into other buckets."""
    df = spark.range(400).selectExpr("id % 2 AS g", "cast(id AS double) AS v")
    plan = selection.upper_middle(df, ["g"], "v")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("percentile_approx(") == 1
