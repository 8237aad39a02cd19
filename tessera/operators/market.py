"""Prices, evidence and statistics of market facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.selection import percentiles
from tessera.functions.text import fold_plain, key_of, round_half_up

DAY_MS = 86_400_000
YEAR_DAYS = 365.25
BANDS = ("F", "VF", "XF", "AU")


def price_basis(facts: DataFrame) -> DataFrame:
    """Adds basis (hammer, realized, total or unknown, the first that is above zero) and price."""
    basis = F.lit("unknown")
    price = F.lit(None).cast("double")
    for name in ("total", "realized", "hammer"):  # the last one wraps the others, so it is asked first
        value = F.col(f"{name}_price")
        basis, price = F.when(value > 0, name).otherwise(basis), F.when(value > 0, value).otherwise(price)
    return facts.withColumns({"basis": basis, "price": price})


def valid(facts: DataFrame) -> DataFrame:
    """Facts with an id, source, day, currency and a positive first non-null price."""
    first = F.coalesce("hammer_price", "realized_price", "total_price", "amount")
    named = (F.col(c).isNotNull() & (F.col(c).cast("string") != "") for c in ("fact_id", "source", "sold_at", "currency"))
    out = facts.where(first > 0)
    for ok in named:
        out = out.where(ok)
    return out


def age_days(day: Column, as_of: str) -> Column:
    return (F.unix_millis(F.lit(as_of).cast("timestamp")) - F.unix_millis(day.cast("timestamp"))) / DAY_MS


def search(facts: DataFrame, as_of: str, years: float | None = None, currency: str | None = None, text: str | None = None, **equal: str) -> DataFrame:
    """Facts of a period (years of 365.25 days) and currency, equal fields, and a text in any field.

    A field that is asked for must be known in the fact.
    """
    out = facts
    if years is not None:
        out = out.where(age_days(F.col("sold_at"), as_of) <= years * YEAR_DAYS)
    if currency is not None:
        out = out.where(F.col("currency") == currency)
    for name, value in equal.items():
        out = out.where(fold_plain(F.col(name).cast("string")) == fold_plain(F.lit(value)))
    if text is not None:
        hay = F.concat_ws(" ", *(F.col(c).cast("string") for c in ("title", "ruler", "nominal", "year", "mint", "variant", "house")))
        out = out.where(F.contains(fold_plain(hay), fold_plain(F.lit(text))))
    return out


def grade_band(grade: Column) -> Column:
    """AU, XF, VF or F of a grade as written, else null. Letters beyond ASCII count as blanks."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.upper(grade), "[^A-Z0-9+ -]", " "), " +", " "))
    # fixed values: what the bands are called
    band = F.lit(None).cast("string")
    for name, pattern in (
        ("F", r"\bF\b|FINE|SLAB|WYRAZNIE ZUZYT"),
        ("VF", r"\bVF\b|VERY FINE|DOBRZE ZACHOWAN"),
        ("XF", r"\bXF\b|\bEF\b|EXTREMELY FINE|BARDZO DOBRZE ZACHOWAN"),
        ("AU", r"\bAU\b|ABOUT UNC|ALMOST UNC|PRAWIE MENNICZ|NIEMAL MENNICZ"),
    ):
        band = F.when(plain.rlike(pattern), name).otherwise(band)
    return band


def band_distance(a: Column, b: Column) -> Column:
    """Steps between two bands; null if either is unknown."""
    order = F.array(*map(F.lit, BANDS))
    return F.when(a.isNotNull() & b.isNotNull(), F.abs(F.array_position(order, a) - F.array_position(order, b))).cast("int")


def statistics(priced: DataFrame, *by: str) -> DataFrame:
    """count, low (p10), q1, median, q3, high (p90) of price, rounded half up; groups without a price have none."""
    shares = {"low": 0.1, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 0.9}
    told = percentiles(priced, list(by), "price", shares).select(*by, "n", *(round_half_up(F.col(c)).cast("long").alias(c) for c in shares))
    empty = priced.groupBy(*by).agg(F.count("price").alias("n")).where("n = 0")
    return told.unionByName(empty.select(*by, "n", *(F.lit(None).cast("long").alias(c) for c in shares)))


def dominant_basis(priced: DataFrame, *by: str, least: int = 3) -> DataFrame:
    """The first of hammer, realized and total with enough rows; null if none has."""
    counts = priced.groupBy(*by).agg(*(F.count_if(F.col("basis") == b).alias(f"n_{b}") for b in ("hammer", "realized", "total")))
    first = F.coalesce(*(F.when(F.col(f"n_{b}") >= least, b) for b in ("hammer", "realized", "total")))
    return counts.withColumn("dominant", first)


def evidence(facts: DataFrame) -> DataFrame:
    """Adds evidence_score (0 to 100), evidence_level and core_complete.

    Fixed values: source 10, URL 20, day 15, currency 10, price 20, identity 15, specific 7, grade 3;
    strong from 85, usable from 65, limited from 45.
    """
    priced = F.greatest(*(F.coalesce(F.col(c), F.lit(0.0)) for c in ("hammer_price", "realized_price", "total_price"))) > 0
    identity = F.col("ruler").isNotNull() & F.col("nominal").isNotNull() & F.col("year").isNotNull()
    has = {
        "source": (F.col("source").isNotNull(), 10),
        "url": (F.col("source_url").isNotNull(), 20),
        "day": (F.col("sold_at").isNotNull(), 15),
        "currency": (F.col("currency").isNotNull(), 10),
        "price": (priced, 20),
        "identity": (identity, 15),
        "specific": (F.col("variant").isNotNull() | F.col("catalog_ref").isNotNull(), 7),
        "grade": (F.col("grade").isNotNull(), 3),
    }
    score = sum((F.when(ok, w).otherwise(0) for ok, w in has.values()), F.lit(0))
    level = F.when(F.col("evidence_score") >= 85, "strong").when(F.col("evidence_score") >= 65, "usable").when(F.col("evidence_score") >= 45, "limited").otherwise("weak")
    core = has["source"][0] & has["url"][0] & has["day"][0] & has["currency"][0] & has["price"][0] & identity
    return facts.withColumn("evidence_score", score).withColumns({"evidence_level": level, "core_complete": core})


def freshness(day: Column, as_of: str) -> Column:
    """fresh up to 30 days, aging up to 180, stale beyond, unknown without a day."""
    days = F.floor(age_days(day, as_of))
    return F.when(day.isNull(), "unknown").when(days <= 30, "fresh").when(days <= 180, "aging").otherwise("stale")


SALE_FIELDS = ("house", "ruler", "nominal", "year", "mint", "variant", "catalog_ref")


def sale_key(price: Column) -> Column:
    """Ten parts that tell one sale: day, house, lot identity, basis and price."""
    return key_of(F.date_format("sold_at", "yyyy-MM-dd"), *(fold_plain(F.col(c).cast("string")) for c in SALE_FIELDS), F.col("basis"), price)


def dedupe(facts: DataFrame, key: Column, order: list[Column], parts: int = 5, id_col: str = "fact_id") -> DataFrame:
    """Adds copies, kept and duplicate_of: of rows with one key the first in order is kept.

    A key with fewer than ``parts`` filled parts tells too little; such a row stands alone.
    """
    filled = F.size(F.filter(F.split("_key", r"\|"), lambda p: p != ""))
    keyed = facts.withColumn("_key", key).withColumn("_key", F.when(filled >= parts, F.col("_key")).otherwise(F.concat(F.lit("#"), F.col(id_col).cast("string"))))
    own = Window.partitionBy("_key")
    ranked = keyed.withColumns({"copies": F.count("*").over(own), "_n": F.row_number().over(own.orderBy(*order)), "_first": F.first(id_col).over(own.orderBy(*order))})
    kept = F.col("_n") == 1
    return ranked.withColumns({"kept": kept, "duplicate_of": F.when(~kept, F.col("_first"))}).drop("_key", "_n", "_first")


def conflicts(facts: DataFrame, *by: str) -> DataFrame:
    """Sale groups in which more than one hammer, realized or total price, basis or currency is given.

    Least and largest values tell which groups clash; distinct values are counted in these alone.
    """
    given = {**{c: F.when(F.col(c) > 0, F.col(c)) for c in ("hammer_price", "realized_price", "total_price")}, "basis": F.col("basis"), "currency": F.col("currency")}
    ends = facts.groupBy(*by).agg(*(f(x).alias(f"{e}_{c}") for c, x in given.items() for e, f in (("min", F.min), ("max", F.max))))
    clash = ends.where(" OR ".join(f"min_{c} <> max_{c}" for c in given)).select(*(F.col(c).alias(f"_{c}") for c in by))
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    rows = facts.join(clash, on, "left_semi")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *(F.count_distinct(x).alias(f"n_{c}") for c, x in given.items()))


def iqr_outliers(priced: DataFrame, *by: str, least: int = 4) -> DataFrame:
    """Adds outlier: price beyond 1.5 interquartile ranges, in groups of at least four.

    The lower fence is not below zero; a group keeps all rows if fewer than two would be left.
    """
    q = priced.groupBy(*by).agg(F.count("price").alias("_n"), F.percentile("price", F.array(F.lit(0.25), F.lit(0.75))).alias("_q"))
    q = q.select(*by, "_n", F.get("_q", F.lit(0)).alias("_q1"), F.get("_q", F.lit(1)).alias("_q3"))
    step = (F.col("_q3") - F.col("_q1")) * 1.5
    beyond = (F.col("_n") >= least) & (F.col("_q3") > F.col("_q1")) & ((F.col("price") < F.greatest(F.lit(0.0), F.col("_q1") - step)) | (F.col("price") > F.col("_q3") + step))
    joined = priced.join(q, list(by)).withColumn("_beyond", beyond)
    left = F.count_if(~F.col("_beyond")).over(Window.partitionBy(*by))
    return joined.withColumn("outlier", F.col("_beyond") & (left >= 2)).drop("_n", "_q1", "_q3", "_beyond")


def liquidity(facts: DataFrame, as_of: str, *by: str) -> DataFrame:
    """Sales, years with sales, sales of the last three years, sales a year, and high / medium / low / none.

    Fixed values: high from 12 sales, 4 years and 4 recent; medium from 5, 3 and 2.
    """
    recent = F.count_if(age_days(F.col("sold_at"), as_of) <= 3 * YEAR_DAYS)
    out = facts.groupBy(*by).agg(F.count("sold_at").alias("n"), F.count_distinct(F.year("sold_at")).alias("years"), recent.alias("recent"))
    level = F.when((F.col("n") >= 12) & (F.col("years") >= 4) & (F.col("recent") >= 4), "high").when((F.col("n") >= 5) & (F.col("years") >= 3) & (F.col("recent") >= 2), "medium")
    return out.withColumns({"per_year": round_half_up(F.col("n") / F.greatest(F.col("years"), F.lit(1)) * 100) / 100, "liquidity": level.when(F.col("n") > 0, "low").otherwise("none")})


def trend(priced: DataFrame, as_of: str, *by: str) -> DataFrame:
    """Median price of the last three years against the years before, back to ten.

    Needs four sales, two in each period; up or down from 15 %, else stable.
    """
    age = age_days(F.col("sold_at"), as_of) / YEAR_DAYS
    rows = priced.withColumns({"_recent": F.when(age <= 3, F.col("price")), "_older": F.when((age > 3) & (age <= 10), F.col("price"))})
    out = rows.groupBy(*by).agg(F.count("_recent").alias("n_recent"), F.count("_older").alias("n_older"), F.median("_recent").alias("recent"), F.median("_older").alias("older"))
    enough = (F.col("n_recent") >= 2) & (F.col("n_older") >= 2) & (F.col("older") > 0)
    out = out.withColumn("change_pct", F.when(enough, round_half_up((F.col("recent") - F.col("older")) / F.col("older") * 100)).cast("long"))
    return out.withColumn("trend", F.when(F.col("change_pct").isNull(), "insufficient").when(F.col("change_pct") >= 15, "up").when(F.col("change_pct") <= -15, "down").otherwise("stable")).drop("recent", "older")


def converted(priced: DataFrame, rates: DataFrame, to: str, most_days: int = 3) -> DataFrame:
    """price in the currency ``to``, by the rate nearest to the sale's day and at most so many days off.

    rates: (currency, rate_day, rate). Rows in ``to`` keep their price; rows without a rate go.
    The rate of each currency and day is chosen first, so a sale looks up one row and is not compared.
    """
    day = F.to_date("sold_at")
    offsets = F.array(*(F.lit(d) for d in range(-most_days, most_days + 1)))
    spread = rates.select("currency", "rate_day", "rate", F.explode(offsets).alias("_off")).withColumn("_day", F.date_sub("rate_day", F.col("_off")))
    of_day = spread.groupBy("currency", "_day").agg(F.min(F.struct(F.abs("_off"), "_off", "rate_day", "rate")).alias("_best")).select("currency", "_day", "_best.rate_day", "_best.rate")
    near = priced.where(F.col("currency") != to).withColumn("_day", day).join(of_day, ["currency", "_day"])
    own = priced.where(F.col("currency") == to).withColumns({"rate_day": day, "rate": F.lit(1.0)})
    return own.unionByName(near.select(own.columns)).withColumn("price_to", F.col("price") * F.col("rate"))
