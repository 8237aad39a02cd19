"""Rows of earlier versions brought to the present one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The present version of a coin's record.
VERSION = 4


def prices_by_type(rows: DataFrame) -> DataFrame:
    """The one price of an earlier fact goes where its price_type says, unless a price is there; other prices of that kind are not known."""
    kind = F.coalesce("price_type", F.lit("unknown"))
    out = rows.withColumn("price_type", kind)
    moved = {f"{k}_price": F.when(F.col("price_type") == k, F.coalesce(f"{k}_price", "price")) for k in ("hammer", "realized")}
    return out.withColumns({**moved, "source_url": F.coalesce("source_url", F.lit("")), "market_fact": F.lit(True)})


def quarantined(coins: DataFrame, derived: tuple[str, ...], changed: Column, resolved: Column, version: int = VERSION) -> DataFrame:
    """Sets apart derived data of records of an earlier version whose identity was corrected and not analysed again since.

    Their derived columns become null, they are stale and wait for a new analysis. Records of the
    present version stay as they are; all others get its number. Done again, it changes nothing.
    """
    has = F.lit(False)
    for c in derived:
        has = has | F.col(c).isNotNull()
    hit = F.coalesce((F.coalesce("record_version", F.lit(0)) < version) & changed & has & ~F.coalesce("stale", F.lit(False)) & ~resolved, F.lit(False))
    out = coins.withColumn("quarantined", hit)
    now = F.col("quarantined")
    return out.withColumns({
        **{c: F.when(~now, F.col(c)) for c in derived},
        "stale": F.coalesce("stale", F.lit(False)) | now,
        "needs_reanalysis": now,
        "record_version": F.greatest(F.coalesce("record_version", F.lit(0)), F.lit(version)),
    })
