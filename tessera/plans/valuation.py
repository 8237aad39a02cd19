"""Valuation of coins: comparables, evidence, tiers, dominant basis, statistics, one step after another.

Every choice is a count over a coin's own pairs. valued() counts pairs by their kind from cells of
facts, chooses by these counts, and makes the chosen pairs alone for their prices. The pairs themselves,
as records() gives them, are not made.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import key_of, round_half_up
from tessera.operators.cells import BASES, FIELDS, NO_BAND, QUALITIES, band_place, kind_code, kinds, survivors, values
from tessera.operators.market import SALE_FIELDS, evidence, grade_band, price_basis, sale_key, search
from tessera.operators.match import comparables
from tessera.operators.selection import quantile
from tessera.sources.shared import stash

CARRY = ("hammer_price", "realized_price", "total_price", "source_url", "evidence_score", *SALE_FIELDS)


#: What the choice of a pair depends on.
KIND = ("banded", "band_distance", "quality", "basis")
STATISTICS = {"low": 0.1, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 0.9}


def chosen(pairs: DataFrame, n: Column | None = None) -> DataFrame:
    """Adds tier and used: the rows that a coin's price comes from. With n, a row stands for n pairs of one kind.

    Rows of the coin's own grade band if there are three, else those at most one band off (or of none)
    if four, else insufficient-condition; a coin without a band keeps all. Of these the strict rows if
    there are three, else strict and good ones if four, else insufficient. Of these the first price
    basis with three rows, else insufficient-price-basis. Tiers of a coin with a band end in -condition.
    """
    own = Window.partitionBy("coin_id")
    _count = lambda rule: F.coalesce(F.sum(F.when(rule, F.lit(1) if n is None else n)).over(own), F.lit(0))
    near = F.coalesce(F.col("band_distance") <= 1, F.lit(True))
    rows = pairs.withColumns({"_same": _count(F.col("band_distance") == 0), "_near": _count(near)})
    pool = F.when(~F.col("banded"), F.lit(True)).when(F.col("_same") >= 3, F.coalesce(F.col("band_distance") == 0, F.lit(False))).otherwise((F.col("_near") >= 4) & near)
    rows = rows.withColumn("_pool", pool)
    strict, good = F.col("quality") == "strict", F.col("quality").isin("strict", "good")
    rows = rows.withColumns({"_strict": _count(F.col("_pool") & strict), "_good": _count(F.col("_pool") & good)})
    rows = rows.withColumn("_chosen", F.col("_pool") & F.when(F.col("_strict") >= 3, strict).otherwise((F.col("_good") >= 4) & good))
    rows = rows.withColumns({f"_{b}": _count(F.col("_chosen") & (F.col("basis") == b)) for b in BASES})
    main = F.coalesce(*(F.when(F.col(f"_{b}") >= 3, b) for b in BASES))
    suffix = F.when(F.col("banded"), "-condition").otherwise("")
    tier = F.when(F.col("banded") & (F.col("_same") < 3) & (F.col("_near") < 4), "insufficient-condition")
    tier = tier.when((F.col("_strict") < 3) & (F.col("_good") < 4), "insufficient").when(F.col("_main").isNull(), "insufficient-price-basis")
    tier = tier.when(F.col("_strict") >= 3, F.concat(F.lit("strict"), suffix)).otherwise(F.concat(F.lit("strict+good"), suffix))
    rows = rows.withColumn("_main", main).withColumn("tier", tier)
    used = F.coalesce(F.col("_chosen") & (F.col("basis") == F.col("_main")), F.lit(False))
    return rows.withColumn("used", used).withColumn("main", F.col("_main")).drop(*(c for c in rows.columns if c.startswith("_")))


def appraised(coins: DataFrame, pairs: DataFrame, value: str = "price", disputed: Column | None = None) -> DataFrame:
    """One row for each coin: counts of its records, tier, basis, statistics, quality and can_estimate.

    Fixed values: quality is strong for strict tiers, usable for strict+good ones, limited else, none
    without records. Disputed rows count for the tier but not for the statistics; where only such
    rows are left there is no estimate. Statistics are zero without prices.
    """
    priced = F.when(F.col("used") & ~(F.lit(False) if disputed is None else disputed), F.col(value))
    return _told(coins, chosen(pairs).groupBy("coin_id").agg(*_counts(F.lit(1)), F.array_sort(F.collect_list(priced)).alias("prices")))


def _counts(n: Column) -> list[Column]:
    """Of a coin's rows, each of which stands for n pairs: their number, that of each quality, tier and basis."""
    counts = [F.sum(n).alias("records"), *(F.sum(F.when(F.col("quality") == q, n)).alias(f"n_{q}") for q in QUALITIES)]
    return [*counts, F.first("tier").alias("tier"), F.first(F.when(F.col("tier").startswith("strict"), F.col("main"))).alias("basis")]


def _told(coins: DataFrame, own: DataFrame) -> DataFrame:
    """appraised() from counts and sorted prices of coins."""
    out = coins.select("coin_id").join(own, "coin_id", "left").withColumn("n", F.when(F.col("prices").isNotNull(), F.size("prices")))
    level = F.when(F.col("records").isNull(), "none").when(F.col("tier").isin("strict", "strict-condition"), "strong").when(F.col("tier").startswith("strict+good"), "usable").otherwise("limited")
    numbers = {c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("records", *(f"n_{q}" for q in QUALITIES), "n")}
    stats = [F.coalesce(round_half_up(quantile(F.col("prices"), share)), F.lit(0)).cast("long").alias(c) for c, share in STATISTICS.items()]
    can = level.isin("strong", "usable") & (F.coalesce(F.col("n"), F.lit(0)) > 0)
    return out.select("coin_id", *numbers.values(), F.coalesce("tier", F.lit("none")).alias("tier"), "basis", *stats, level.alias("quality"), can.alias("can_estimate"))


def price_range(currency: str) -> Column:
    return F.when(F.col("can_estimate"), F.concat(F.col("low").cast("string"), F.lit("–"), F.col("high").cast("string"), F.lit(f" {currency}")))


def usable(facts: DataFrame, as_of: str, currency: str | None, years: float = 10, gated: bool = False) -> DataFrame:
    """Facts of the period and currency with a price. With gated, only those whose core evidence is complete and strong or usable."""
    rows = evidence(price_basis(search(facts, as_of, years=years, currency=currency)).where("price > 0").withColumn("band", grade_band(F.col("grade"))))
    if gated:
        rows = rows.where("core_complete AND evidence_level IN ('strong', 'usable')")
    return rows


def records(coins: DataFrame, facts: DataFrame, as_of: str, currency: str | None, years: float = 10) -> DataFrame:
    """Comparable rows of the period and currency."""
    return comparables(coins, usable(facts, as_of, currency, years), carry=CARRY)


def unique_sales(pairs: DataFrame) -> DataFrame:
    """Each coin's sales once: of rows with one sale key the best evidence, then one with a link, then the least id.

    A key with fewer than five filled parts tells too little, so such a row stands alone.
    """
    key = sale_key(F.col("price"))
    filled = F.size(F.filter(F.split(key, r"\|"), lambda x: x != ""))
    alone = F.when(filled < 5, F.col("fact_id"))
    best = Window.partitionBy("coin_id", key, alone).orderBy(F.desc("evidence_score"), F.col("source_url").isNull(), "fact_id")
    return pairs.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def disputed(pairs: DataFrame) -> DataFrame:
    """Adds disputed: of one coin's rows of one sale, more than one hammer, realized or total price, basis or currency is given."""
    sale = Window.partitionBy("coin_id", key_of(F.date_format("sold_at", "yyyy-MM-dd"), *(F.col(c) for c in SALE_FIELDS)))
    prices = [F.when(F.col(f"{b}_price") > 0, F.col(f"{b}_price")) for b in BASES]
    clash = F.lit(False)
    for x in (*prices, F.col("basis"), F.col("currency")):
        clash = clash | F.coalesce(F.min(x).over(sale) != F.max(x).over(sale), F.lit(False))
    return pairs.withColumn("disputed", clash)


def once(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """unique_sales() of facts before they are paired, and facts for which that must wait.

    Rows of one sale key agree with a coin alike but for their bands. So which of them is the first that a coin
    can have depends on the coin's band and the pair's level alone: ``counted`` has the bits for which a row is
    it, and rows that never are go. Keys fold their text; rows of one key that are written differently wait.
    """
    key = sale_key(F.col("price"))
    filled = F.size(F.filter(F.split(key, r"\|"), lambda x: x != ""))
    rows = rows.withColumns({"_key": key, "_alone": F.when(filled < 5, F.col("fact_id"))})
    sale = Window.partitionBy("_key", "_alone")
    before = sale.orderBy(F.desc("evidence_score"), F.col("source_url").isNull(), "fact_id").rowsBetween(Window.unboundedPreceding, -1)
    own = F.call_function("shiftleft", F.lit(1), band_place())
    rows = rows.withColumns({"_own": own, "_seen": F.coalesce(F.bit_or(own).over(before), F.lit(0)), **_mixed(sale)})
    first = [F.when((F.col("_own").bitwiseAND(s) != 0) & (F.col("_seen").bitwiseAND(s) == 0), 1 << bit).otherwise(0) for bit, s in survivors().items()]
    rows = rows.withColumn("counted", sum(first[1:], first[0]).cast("int")).where("counted <> 0 OR _mixed").drop("_key", "_alone", "_own", "_seen")
    return _apart(rows, "unique-sales")


def clashing(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """disputed() of facts before they are paired, and facts for which that must wait.

    Which rows of a sale a coin can have depends on its band and the pair's level alone: the column ``disputed``
    has the bits for which these rows clash. The ends of the values are told by band first, so no sale is held whole.
    """
    given = {**{f"{b}_price": F.when(F.col(f"{b}_price") > 0, F.col(f"{b}_price")) for b in BASES}, "basis": F.col("basis"), "currency": F.col("currency")}
    key = key_of(F.date_format("sold_at", "yyyy-MM-dd"), *(F.col(c) for c in SALE_FIELDS))
    ends = rows.groupBy(key.alias("_key"), band_place().alias("_band")).agg(*(f(x).alias(f"{e}_{c}") for c, x in given.items() for e, f in (("min", F.min), ("max", F.max))), *(f(_written()).alias(f"_{e}") for e, f in (("min", F.min), ("max", F.max))))
    bands = ends.groupBy("_key").agg(F.collect_list(F.struct("_band", *(f"{e}_{c}" for c in given for e in ("min", "max")))).alias("_bands"), (~F.min("_min").eqNullSafe(F.max("_max"))).alias("_mixed"))

    def clash(of: int) -> Column:
        held = F.filter("_bands", lambda x: F.lit(of).bitwiseAND(F.call_function("shiftleft", F.lit(1), x["_band"])) != 0)
        return functools.reduce(Column.__or__, (F.coalesce(F.array_min(held[f"min_{c}"]) != F.array_max(held[f"max_{c}"]), F.lit(False)) for c in given))

    sets = survivors()
    bits = [F.when(clash(s), sum(1 << bit for bit, x in sets.items() if x == s)).otherwise(0) for s in sorted({*sets.values()} - {0})]
    every = (1 << NO_BAND + 1) - 1
    sales = bands.select("_key", "_mixed", F.when(clash(every), sum(bits[1:], bits[0])).otherwise(0).cast("int").alias("disputed")).where("disputed <> 0 OR _mixed")
    out = rows.withColumn("_key", key).join(sales, "_key", "left").drop("_key")
    return _apart(out.withColumns({"disputed": F.coalesce("disputed", F.lit(0)), "_mixed": F.coalesce("_mixed", F.lit(False))}), "sales")


def _written() -> Column:
    """What decides how a fact agrees with a coin, but for its band."""
    return F.struct("nominal", *FIELDS)


def _mixed(sale) -> dict[str, Column]:
    return {"_mixed": ~F.min(_written()).over(sale).eqNullSafe(F.max(_written()).over(sale))}


def _apart(rows: DataFrame, tag: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows and those of mixed sales, written once as both counts and prices read them; None if there are no such."""
    kept = stash(rows, tag)
    mixed = kept.where("_mixed").drop("_mixed", "counted", "disputed")
    return kept.where("NOT _mixed").drop("_mixed"), None if mixed.isEmpty() else mixed


def valuation_once(coins: DataFrame, facts: DataFrame, as_of: str, currency: str | None, years: float = 10) -> DataFrame:
    """appraised() over unique_sales() of the comparable records, without their pairs."""
    rows, mixed = once(usable(facts, as_of, currency, years))
    return valued(coins, rows, apart=None if mixed is None else unique_sales(comparables(coins, mixed, carry=CARRY)))


def valuation_agreed(coins: DataFrame, facts: DataFrame, as_of: str, currency: str | None, years: float = 10) -> DataFrame:
    """appraised() over the comparable records with disputed() ones left out of the statistics, without their pairs."""
    rows, mixed = clashing(usable(facts, as_of, currency, years))
    return valued(coins, rows, apart=None if mixed is None else disputed(comparables(coins, mixed, carry=CARRY)))


def valuation(coins: DataFrame, facts: DataFrame, as_of: str, currency: str | None, years: float = 10, gated: bool = False, value: str = "price") -> DataFrame:
    """appraised() over the comparable records of a period and currency, without their pairs."""
    return valued(coins, usable(facts, as_of, currency, years, gated), value)


def valued(coins: DataFrame, rows: DataFrame, value: str = "price", apart: DataFrame | None = None) -> DataFrame:
    """appraised() of the pairs of coins and usable facts; apart are pairs that count besides.

    The choice of each coin is written once to the shared folder, as counts and prices both depend on it.
    """
    counts = kinds(coins, rows)
    if apart is not None:
        counts = counts.unionByName(apart.groupBy("coin_id", *KIND).agg(F.count("*").alias("pairs"))).groupBy("coin_id", *KIND).agg(F.sum("pairs").alias("pairs"))
    choice = chosen(counts, F.col("pairs"))
    code = kind_code(F.col("band_distance"), F.col("quality"))
    plan = stash(choice.groupBy("coin_id").agg(*_counts(F.col("pairs")), F.collect_list(F.when(F.col("used"), code)).alias("kinds"), F.first("main").alias("main")), "valuation")
    wanted = plan.where(F.size("kinds") > 0).select("coin_id", "kinds", "main")
    prices = values(coins.join(wanted, "coin_id"), rows, value)
    if apart is not None:
        more = apart.where(~F.col("disputed")) if "disputed" in apart.columns else apart
        more = more.join(wanted, "coin_id").where((F.col("basis") == F.col("main")) & F.array_contains("kinds", code))
        prices = prices.unionByName(more.select("coin_id", value))
    prices = prices.groupBy("coin_id").agg(F.array_sort(F.collect_list(value)).alias("prices"))
    return _told(coins, plan.join(prices, "coin_id", "left").withColumn("prices", F.coalesce("prices", F.array().cast("array<double>"))))
