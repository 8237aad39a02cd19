"""Valuation from cells of facts, against the pairs themselves."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import cells, market
from tessera.operators.match import comparables
from tessera.plans import valuation

FIELDS = "ruler string, nominal string, year int, mint string, variant string, catalog_ref string"
VALUES = (("A", "B"), ("n", "m"), (1500, 1501), ("x", "y"), ("v1", "v2"), ("K1", "K2"))
GRADES = ("F", "VF", "XF", "AU")


def described(rng, share=0.3):
    return tuple(None if rng.random() < share else rng.choice(v) for v in VALUES)


def coins(spark, n=80, seed=5):
    rng = random.Random(seed)
    rows = [(i, *described(rng), rng.choice((None, *GRADES))) for i in range(n)]
    return spark.createDataFrame(rows, f"coin_id long, {FIELDS}, grade string").withColumn("band", market.grade_band(F.col("grade")))


def sales(spark, n=600, seed=6):
    rng = random.Random(seed)
    few = [described(rng, 0.2) for _ in range(60)]
    rows = [(f"f{i}", *rng.choice(few), rng.choice((None, *GRADES)), rng.choice(("H1", "H2")), float(rng.randint(1, 4)), rng.choice("hrt"), rng.choice((None, "u"))) for i in range(n)]
    frame = spark.createDataFrame(rows, f"fact_id string, {FIELDS}, grade string, house string, amount double, kind string, source_url string")
    prices = {c: F.when(F.col("kind") == c[0], F.col("amount")) for c in ("hammer_price", "realized_price", "total_price")}
    return frame.withColumns({"source": F.lit("S"), "sold_at": F.lit("2000-01-01").cast("timestamp"), "currency": F.lit("PLN"), **prices})


def told(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_kinds_are_counts_of_pairs(spark):
    rows = valuation.usable(sales(spark), "2001-11-05", "PLN")
    pairs = comparables(coins(spark), rows, carry=valuation.CARRY)
    expected = told(pairs.groupBy("coin_id", *valuation.KIND).agg(F.count("*").alias("pairs")))
    assert told(cells.kinds(coins(spark), rows).select("coin_id", *valuation.KIND, "pairs")) == expected and len(expected) > 300


def test_valuation_makes_no_pairs(spark, monkeypatch):
    """As from the pairs, which grow with the square of the tables, but without these."""
    pairs = valuation.records(coins(spark), sales(spark), "2001-11-05", "PLN")
    expected = told(valuation.appraised(coins(spark), pairs))
    monkeypatch.setattr(valuation, "comparables", lambda *_, **__: pytest.fail("all pairs are made"))
    got = told(valuation.valuation(coins(spark), sales(spark), "2001-11-05", "PLN"))
    assert got == expected and len({r[6] for r in got}) > 3 and sum(r[5] for r in got) > 100


def test_a_sale_looks_up_the_rate_of_its_day(spark):
    """Rates are chosen by day before the sales are read, so no sale is repeated or shuffled to choose."""
    rates = spark.createDataFrame([("EUR", 3, 4.0), ("EUR", 7, 4.5), ("EUR", 9, 5.0)], "currency string, d int, rate double").selectExpr("currency", "date_add(date'2000-01-01', d) AS rate_day", "rate")
    rows = spark.range(16).selectExpr("cast(id AS string) AS fact_id", "timestamp(date_add(date'2000-01-01', cast(id AS int))) AS sold_at", "2.0D AS price", "IF(id = 15, 'PLN', 'EUR') AS currency")
    out = market.converted(rows, rates, "PLN", 3)
    nearest = {**dict.fromkeys(range(6), 4.0), 6: 4.5, 7: 4.5, 8: 4.5, **dict.fromkeys(range(9, 13), 5.0), 15: 1.0}
    assert {int(r.fact_id): r.rate for r in out.collect()} == nearest and out.count() == len(nearest)
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()


def respelled(frame):
    """Some sales with a mint that folds to the same text and a link that is missing."""
    more = {"mint": F.upper("mint"), "fact_id": F.concat("fact_id", F.lit("-m"))}
    return frame.unionByName(frame.where("hash(fact_id) % 5 = 0").withColumns(more))


@pytest.mark.parametrize("change", [lambda x: x, respelled])
def test_unique_sales_are_told_before_pairs(spark, monkeypatch, change):
    """Each coin's first row of a sale depends on which bands the coin can have; rows of one key but other spelling wait."""
    facts = change(sales(spark, 900)).cache()
    pairs = valuation.unique_sales(valuation.records(coins(spark), facts, "2001-11-05", "PLN"))
    expected = told(valuation.appraised(coins(spark), pairs))
    if change is not respelled:
        monkeypatch.setattr(valuation, "unique_sales", lambda *_: pytest.fail("pairs are made"))
    assert told(valuation.valuation_once(coins(spark), facts, "2001-11-05", "PLN")) == expected
    assert sum(r[1] for r in expected) < valuation.records(coins(spark), facts, "2001-11-05", "PLN").count()


def blanked(frame):
    """Some sales with an empty variant where others have none: one sale key, but not alike to a coin."""
    more = {"variant": F.coalesce("variant", F.lit("")), "fact_id": F.concat("fact_id", F.lit("-m")), "hammer_price": F.col("hammer_price") + 1}
    return frame.unionByName(frame.where("hash(fact_id) % 5 = 0").withColumns(more))


@pytest.mark.parametrize("change", [lambda x: x.withColumn("sold_at", F.expr("date_add(sold_at, hash(fact_id) % 9)").cast("timestamp")), blanked])
def test_disputes_are_told_before_pairs(spark, monkeypatch, change):
    facts = change(sales(spark, 900)).cache()
    pairs = valuation.disputed(valuation.records(coins(spark), facts, "2001-11-05", "PLN"))
    expected = told(valuation.appraised(coins(spark), pairs, disputed=F.col("disputed")))
    plain = told(valuation.valuation(coins(spark), facts, "2001-11-05", "PLN"))
    if change is not blanked:
        monkeypatch.setattr(valuation, "disputed", lambda *_: pytest.fail("pairs are made"))
    assert told(valuation.valuation_agreed(coins(spark), facts, "2001-11-05", "PLN")) == expected != plain
