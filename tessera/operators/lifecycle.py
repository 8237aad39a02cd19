"""What happens to derived data when an identity is corrected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import comparable, is_unknown, key_of

IDENTITY = ("nominal", "ruler", "variant")


def changed_fields(accepted: Column, pairs: dict[str, tuple[Column, Column]]) -> Column:
    """Names of the fields in which an accepted row is known and differs from what was read at first."""
    changed = [F.when(accepted & ~is_unknown(now) & (comparable(now) != comparable(was)), F.lit(name)) for name, (now, was) in pairs.items()]
    return F.array_compact(F.array(*changed))


def identity_key(*columns: Column) -> Column:
    return key_of(*(comparable(c.cast("string")) for c in columns))


def invalidate(rows: DataFrame, derived: tuple[str, ...], changed: str = "changed") -> DataFrame:
    """Derived columns become null and the row stale where fields changed; doing it again changes nothing.

    A row that needs a new analysis already still does.
    """
    hit = F.size(changed) > 0
    out = rows.withColumns({c: F.when(~hit, F.col(c)) for c in derived})
    return out.withColumns({"stale": F.col("stale") | hit, "needs_reanalysis": F.coalesce(F.col("needs_reanalysis"), F.lit(False)) | hit if "needs_reanalysis" in rows.columns else hit})


def resolution(current: Column, *done: Column) -> Column:
    """resolved when all keys that analyses were made for equal the current one, else waiting or drifted."""
    known = [d.isNotNull() for d in done]
    all_equal = F.lit(True)
    any_known = F.lit(False)
    for d, k in zip(done, known, strict=True):
        all_equal, any_known = all_equal & F.coalesce(d == current, F.lit(False)), any_known | k
    return F.when(all_equal, "resolved").when(any_known, "drifted").otherwise("waiting")


def reference_accepted(reference: Column, variant: Column, confidence: Column, diagnostics: Column, features: Column, rarity: Column) -> Column:
    """Whether a catalogue reference is backed well enough; otherwise it stays a candidate.

    Fixed values: confidence from 80, two diagnostics or three sure features, rarity R or R1 to R8.
    """
    ok = reference.isNotNull() & ~is_unknown(variant) & (confidence >= 80) & ((diagnostics >= 2) | (features >= 3)) & rarity.rlike("^(R|R[1-8])$")
    return F.coalesce(ok, F.lit(False))


def market_refreshed(coins: DataFrame, valuations: DataFrame) -> DataFrame:
    """Coins that wait for the market after a correction, patched by a valuation made for what they are now.

    coins: coin_id, accepted, needs_reanalysis, identity_key (as it is now), detail_key (that the last detail
    analysis was made for), market_median, stale; valuations: coin_id, identity_key, n, median, quality.
    A valuation of an earlier identity changes nothing, nor does one of a coin that is not accepted, does not
    wait, or whose detail analysis is of another identity. One without sales leaves no median. ``refreshed``
    says which rows were patched. A coin has one valuation at most for each key.
    """
    v = valuations.select("coin_id", "identity_key", F.col("n").alias("_n"), F.col("median").alias("_median"), F.col("quality").alias("_quality"), F.lit(True).alias("_hit"))
    waits = F.coalesce(F.col("accepted") & F.col("needs_reanalysis") & (F.col("detail_key") == F.col("identity_key")), F.lit(False))
    rows = coins.join(v, ["coin_id", "identity_key"], "left")
    hit = waits & F.coalesce("_hit", F.lit(False))
    patch = {
        "market_median": F.when(F.col("_n") > 0, F.col("_median")),
        "valuation_quality": F.coalesce("_quality", F.lit("none")),
        "auction_records": F.coalesce("_n", F.lit(0)),
        "market_key": F.col("identity_key"),
        "needs_reanalysis": F.lit(False),
        "stale": F.lit(False),
    }
    out = rows.withColumn("refreshed", hit)
    for name, value in patch.items():
        out = out.withColumn(name, F.when(F.col("refreshed"), value).otherwise(F.col(name) if name in coins.columns else F.lit(None)))
    return out.drop("_n", "_median", "_quality", "_hit")
