"""Saved state as JSON: lists that are none become empty, settings get defaults, unreadable rows are kept aside."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed names of the lists that a saved state has.
LISTS = ("coins", "albums", "watchlist", "events", "history")


def state_scan(rows: DataFrame, json: str, defaults: dict[str, str], lists: tuple[str, ...] = LISTS) -> DataFrame:
    """rows with a column for each list (array of variants), settings (map of strings) and unreadable (string) in place of json.

    A list that is missing or is no array is empty. Settings are the defaults, overridden by those given;
    settings that are no object count as none. JSON that cannot be read, which includes a key that is
    given twice, stays in ``unreadable`` and has empty lists and defaults, as has null or empty JSON.
    """
    state = F.try_parse_json(F.col(json))
    out = rows.withColumn("_state", state).withColumn("unreadable", F.when(F.col("_state").isNull() & (F.col(json) != ""), F.col(json)))
    empty = F.expr("CAST(array() AS array<variant>)")
    own = F.coalesce(F.try_variant_get("_state", "$.settings", "map<string,string>"), F.expr("CAST(map() AS map<string,string>)"))
    base = F.create_map(*(F.lit(x) for pair in defaults.items() for x in pair)) if defaults else F.expr("CAST(map() AS map<string,string>)")
    left = F.map_filter(base, lambda k, _: ~F.map_contains_key(own, k))
    found = {name: F.coalesce(F.try_variant_get("_state", f"$.{name}", "array<variant>"), empty) for name in lists}
    return out.withColumns({**found, "settings": F.map_concat(left, own)}).drop("_state", json)


def with_older(current: DataFrame, older: DataFrame, owner: str) -> DataFrame:
    """Rows of the current store, and those of the older one whose owner has none in the current one.

    A null owner is an owner like any other. ``from_older`` tells the rows apart.
    """
    has = current.select(F.col(owner).alias("_owner")).distinct()
    missing = older.join(has, F.col(owner).eqNullSafe(F.col("_owner")), "left_anti")
    return current.withColumn("from_older", F.lit(False)).unionByName(missing.withColumn("from_older", F.lit(True)))
