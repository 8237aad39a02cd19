"""What a buyer pays and a seller gets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def buyer_cost(hammer: Column, premium_pct: Column, vat_pct: Column, shipping: float = 0.0, insurance: float = 0.0, customs_pct: float = 0.0, import_vat_pct: float = 0.0, other: Column | float = 0.0) -> dict[str, Column]:
    """premium, vat on it, customs, import VAT and total."""
    other = other if isinstance(other, Column) else F.lit(other)
    premium = hammer * premium_pct / 100
    vat = premium * vat_pct / 100
    base = hammer + premium + vat + F.lit(shipping) + F.lit(insurance)
    customs = base * customs_pct / 100
    import_vat = (base + customs + other) * import_vat_pct / 100
    return {"premium": premium, "vat": vat, "customs": customs, "import_vat": import_vat, "total": base + customs + other + import_vat}


def seller_net(hammer: Column, fee_pct: float, fee_vat_pct: float, other: float = 0.0) -> Column:
    fee = hammer * fee_pct / 100
    return hammer - fee - fee * fee_vat_pct / 100 - other


def with_fee_rule(sales: DataFrame, rules: DataFrame, id_col: str = "fact_id") -> DataFrame:
    """Each sale with the rule of its house that was valid that day and was checked last, or nulls.

    Houses compare without case and outer blanks; open ends are null. A house has few rules, so the
    join by house stays near the number of sales.
    """
    house, day = F.lower(F.trim("house")), F.to_date("sold_at")
    # numbered first: with one candidate or none, rows pass through the window without a sort on ties
    r = rules.select(house.alias("_house"), *(F.col(c).alias(f"rule_{c}" if c in ("checked_at", "valid_from") else c) for c in rules.columns if c != "house"))
    holds = (F.col("rule_valid_from").isNull() | (F.col("rule_valid_from") <= F.col("_day"))) & (F.col("valid_to").isNull() | (F.col("valid_to") >= F.col("_day")))
    s = sales.withColumns({"_house": house, "_day": day})
    joined = s.join(r, (s["_house"] == r["_house"]) & holds, "left").drop(r["_house"])
    last = Window.partitionBy(id_col).orderBy(F.desc_nulls_last("rule_checked_at"), F.desc("rule_valid_from"))
    return joined.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_house", "_day")


def cost_for_house(sales: DataFrame, rules: DataFrame, id_col: str = "fact_id") -> DataFrame:
    """Premium, VAT and total by the house's rule; without one they are null and complete is false."""
    ruled = with_fee_rule(sales, rules, id_col)
    cost = buyer_cost(F.col("hammer_price"), F.col("premium_pct"), F.col("vat_pct"), other=F.col("fixed_fee"))
    complete = F.col("premium_pct").isNotNull()
    return ruled.withColumns({"complete": complete, **{k: F.when(complete, cost[k]) for k in ("premium", "vat", "total")}})


def purchasing_power(amount: Column, factor: Column, source: Column, as_of: Column) -> Column:
    """The amount in today's money; null unless the factor's source and day are known."""
    return F.when(source.isNotNull() & as_of.isNotNull() & (factor > 0), amount * factor)


def record_cost(records: DataFrame, rules: DataFrame, id_col: str = "fact_id") -> DataFrame:
    """result_basis and result_value of each record, and what its buyer paid: complete, premium, vat and total.

    The result is the first of hammer, realized and total price above zero, else the plain amount. The
    buyer's cost needs a hammer price and a rule of the house.
    """
    basis, value = F.lit("unknown"), F.col("amount")
    for name in ("total", "realized", "hammer"):  # the last one wraps the others, so it is asked first
        known = F.col(f"{name}_price") > 0
        basis, value = F.when(known, name).otherwise(basis), F.when(known, F.col(f"{name}_price")).otherwise(value)
    out = cost_for_house(records.withColumns({"result_basis": basis, "result_value": value}), rules, id_col)
    complete = F.col("complete") & F.coalesce(F.col("hammer_price") > 0, F.lit(False))
    return out.withColumns({"complete": complete, **{k: F.when(complete, F.col(k)) for k in ("premium", "vat", "total")}})
