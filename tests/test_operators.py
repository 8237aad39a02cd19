"""Literal cases at the boundaries of each operator."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import collection, cost, extract, fingerprint, ingest, knowledge, lifecycle, market
from tessera.plans import valuation as plan


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_text_folds(spark):
    rows = [("  Złoty Ślązak ß",), ("Łódź-Đ 1",), (None,), ("",)]
    got = values(spark, rows, "t string", text.fold(F.col("t")), text.fold_plain(F.col("t")), text.fold_l(F.col("t")))
    assert got[0] == ("zloty slazak ss", "z oty slazak", "zloty slazak")
    assert got[1][0] == "lodz d 1" and got[2] == (None, None, None) and got[3] == ("", "", "")


@pytest.mark.parametrize("value, unknown", [("Nie ustalono", True), ("UNBEKANNT", True), ("zu bestätigen", True), ("non déterminé", True), ("", True), (None, True), ("Kraków", False), ("brakteat", False)])
def test_unknown_values(spark, value, unknown):
    assert values(spark, [(value,)], "t string", text.is_unknown(F.col("t"))) == [(unknown,)]


def test_numbers_years_and_rounding(spark):
    got = values(spark, [("1,5", "ok 1608/1612", -2.5), ("1.234,50", "x 850", 2.5), ("", None, 0.4)], "n string, y string, r double", text.number(F.col("n")), text.year_of(F.col("y")), text.round_half_up(F.col("r")))
    assert got == [(1.5, 1608, -2), (None, None, 3), (None, None, 0)]


def test_fee_with_vat(spark):
    c = cost.buyer_cost(F.lit(1000.0), F.lit(20.0), F.lit(23.0))
    assert values(spark, [(1,)], "x int", c["premium"], c["vat"], c["total"]) == [(200.0, 46.0, 1246.0)]
    assert values(spark, [(1,)], "x int", cost.buyer_cost(F.lit(1000.0), F.lit(10.0), F.lit(20.0))["total"]) == [(1120.0,)]


def test_no_rule_is_incomplete(spark):
    sales = spark.createDataFrame([("a", "Unknown", dt.datetime(2020, 1, 1), 1000.0)], "fact_id string, house string, sold_at timestamp, hammer_price double")
    rules = spark.createDataFrame([("House", None, None, dt.date(2019, 1, 1), 20.0, 23.0, 0.0)], "house string, valid_from date, valid_to date, checked_at date, premium_pct double, vat_pct double, fixed_fee double")
    row = cost.cost_for_house(sales, rules).first()
    assert row.complete is False and row.total is None
    row = cost.cost_for_house(sales.withColumn("house", F.lit(" HOUSE ")), rules).first()
    assert row.complete and row.total == 1246.0


@pytest.mark.parametrize("grade, band", [("AU 58", "AU"), ("almost unc", "AU"), ("EF", "XF"), ("Very Fine", "VF"), ("fine", "F"), ("II", None), ("", None), (None, None)])
def test_grade_bands(spark, grade, band):
    assert values(spark, [(grade,)], "g string", market.grade_band(F.col("g"))) == [(band,)]


def test_freshness_boundaries(spark):
    days = [(dt.datetime(2001, 11, 5) - dt.timedelta(days=d),) for d in (30, 31, 180, 181)] + [(None,)]
    got = [r[0] for r in values(spark, days, "d timestamp", market.freshness(F.col("d"), "2001-11-05"))]
    assert got == ["fresh", "aging", "aging", "stale", "unknown"]


def test_iqr_keeps_small_groups_and_marks_far_prices(spark):
    df = spark.createDataFrame([("a", str(i), p) for i, p in enumerate([10.0, 11.0, 12.0, 13.0, 500.0])] + [("b", "x", 1.0), ("b", "y", 900.0)], "g string, fact_id string, price double")
    assert [r.fact_id for r in market.iqr_outliers(df, "g").where("outlier").collect()] == ["4"]


def test_dedupe_is_idempotent_and_leaves_thin_keys(spark):
    df = spark.createDataFrame([("1", "a|b|c|d|e", 5), ("2", "a|b|c|d|e", 9), ("3", "a||||", 1), ("4", "a||||", 1)], "fact_id string, k string, score int")
    once = market.dedupe(df, F.col("k"), [F.desc("score"), F.col("fact_id")])
    got = {r.fact_id: (r.copies, r.kept, r.duplicate_of) for r in once.collect()}
    assert got == {"1": (2, False, "2"), "2": (2, True, None), "3": (1, True, None), "4": (1, True, None)}
    again = market.dedupe(once.where("kept").select("fact_id", "k", "score"), F.col("k"), [F.desc("score"), F.col("fact_id")])
    assert again.where("NOT kept").isEmpty()


@pytest.mark.parametrize("row, value", [((False, 4200.0, 1200.0, None, None), 4200.0), ((True, 4200.0, None, None, None), 0.0), ((False, None, None, 800.0, 1200.0), 1000.0), ((False, None, None, None, None), 0.0)])
def test_display_value(spark, row, value):
    assert values(spark, [row], "stale boolean, market_median double, estimated_value double, estimate_low double, estimate_high double", collection.display_value()) == [(value,)]


def test_nominal_rank_and_years(spark):
    got = values(spark, [("półtalar",), ("talar",), ("10 złotych",), ("7 x",), ("",)], "n string", F.round(collection.nominal_rank(F.col("n")), 3))
    assert [g[0] for g in got] == [110.0, 120.0, 110.414, 7.0, float("-inf")]
    assert values(spark, [("XVI w.",), ("1608",), ("?",), ("XIX-XX w",), ("iv w.",), ("XLIX w",), (None,)], "y string", collection.year_value(F.col("y"))) == [(1500,), (1608,), (None,), (1800,), (300,), (4800,), (None,)]


def test_trust_and_learning(spark):
    rows = [(True, 2, False), (True, 1, True), (False, 5, True), (False, 0, False)]
    level = knowledge.trust_level(F.col("e"), F.col("s"), F.col("c"))
    got = values(spark, rows, "e boolean, s int, c boolean", level, knowledge.trust_rank(level))
    assert got == [("multi_source_verified", 90), ("expert_verified", 70), ("user_corrected", 30), ("ai_suggestion", 10)]
    boosts = [r[0] for r in values(spark, [(1, 30), (1, 70), (1, 90), (9, 90)], "n int, r int", knowledge.learned_boost(F.col("n"), F.col("r")))]
    assert 0 < boosts[0] <= 10 < boosts[1] and 12 <= boosts[2] <= 24 and boosts[3] == 24


def test_changed_fields_and_invalidation(spark):
    df = spark.createDataFrame([(1, True, "grosz", "Grosz", 5.0, False), (2, True, "ort", "grosz", 5.0, False), (3, False, "ort", "grosz", 5.0, False), (4, True, "unknown", "x", 5.0, True)], "id int, ok boolean, now string, was string, median double, stale boolean")
    df = df.withColumn("changed", lifecycle.changed_fields(F.col("ok"), {"nominal": (F.col("now"), F.col("was"))}))
    once = lifecycle.invalidate(df, ("median",))
    got = {r.id: (r.median, r.stale) for r in once.collect()}
    assert got == {1: (5.0, False), 2: (None, True), 3: (5.0, False), 4: (5.0, True)}
    twice = lifecycle.invalidate(once, ("median",))
    assert sorted(map(tuple, once.select("id", "median", "stale").collect()), key=str) == sorted(map(tuple, twice.select("id", "median", "stale").collect()), key=str)


def test_catalogue_gate(spark):
    rows = [("K1", "v", 72, 1, 0, "R4"), ("K1", "v", 86, 2, 0, "R4"), ("K1", "v", 86, 0, 3, "R"), ("K1", "unknown", 90, 9, 9, "R"), ("K1", "v", 90, 9, 9, "R9"), (None, "v", 90, 9, 9, "R")]
    got = values(spark, rows, "ref string, v string, c int, d int, f int, r string", lifecycle.reference_accepted(*(F.col(c) for c in ("ref", "v", "c", "d", "f", "r"))))
    assert [g[0] for g in got] == [False, True, True, False, False, False]


def test_similarities(spark):
    got = values(spark, [(10.0, 5.0, ["a", "b"], ["b", "c"]), (0.0, 0.0, [], ["a"])], "a double, b double, x array<string>, y array<string>", fingerprint.number_similarity(F.col("a"), F.col("b")), fingerprint.set_similarity(F.col("x"), F.col("y")))
    assert got == [(0.5, 0.5), (1.0, None)]


def test_lot_page(spark):
    html = "<html><script>x</script><style>y</style><p>Lot number: 12</p><p>Grade: AU&nbsp;58</p>Sell price: 1.234,50 z&#322;<b>Sell date:</b> 03-02-2020</html>".replace("&#322;", "ł")
    plain = extract.plain_text(F.col("h"))
    got = spark.createDataFrame([(html,), (None,)], "h string").select(*(c.alias(n) for n, c in extract.lot_facts(plain).items())).collect()
    assert (got[0].lot, got[0].realized_price, got[0].currency, str(got[0].sold_at), got[0].grade) == ("12", 1234.5, "PLN", "2020-02-03", "AU 58")
    assert got[1].realized_price is None


def test_upsert_and_running_cap(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "bb"), (2, 1, "c")], "k int, t int, v string")
    assert sorted(r.v for r in ingest.upsert_latest(df, ["k"], [F.col("t")]).collect()) == ["bb", "c"]
    assert sorted(r.v for r in ingest.running_cap(df, "k", ["t"], F.length("v"), 2).collect()) == ["a", "c"]


def test_valuation_tiers(spark):
    def pairs(n, quality, distance, basis="hammer"):
        return [(1, f"{quality}{i}", basis, distance, True, quality) for i in range(n)]

    schema = "coin_id int, fact_id string, basis string, band_distance int, banded boolean, quality string"

    def got(*rows):
        out = plan.chosen(spark.createDataFrame([r for part in rows for r in part], schema)).collect()
        return {r.tier for r in out}.pop(), sum(r.used for r in out)

    assert got(pairs(3, "strict", 0), pairs(4, "good", 1)) == ("strict-condition", 3)
    assert got(pairs(2, "strict", 0), pairs(2, "good", 1)) == ("strict+good-condition", 4)
    assert got(pairs(2, "strict", 0), pairs(1, "good", 2)) == ("insufficient-condition", 0)
    assert got(pairs(3, "indicative", 0)) == ("insufficient", 0)
    assert got(pairs(2, "strict", 0, "hammer"), pairs(3, "good", 0, "realized")) == ("strict+good-condition", 3)
    assert got(pairs(2, "strict", 0, "hammer"), pairs(2, "good", 0, "realized")) == ("insufficient-price-basis", 0)
