"""Albums of a collection, as array columns, and what happens when a target is bought."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Albums that every collection has.
DEFAULTS = (("my-album", "Mój album", "collection"), ("goals", "Moje cele", "targets"), ("dreams", "Marzenia", "dreams"))


def changed(coins: DataFrame, moves: DataFrame, albums: DataFrame) -> DataFrame:
    """coins with album_ids after one move each: (coin_id, source, target), either null.

    A target must be an album, source and target must differ, and a coin must exist; other moves
    change nothing. Assigning adds the target, removing takes the source away, moving does both.
    """
    known = moves.join(albums.select(F.col("album_id").alias("target"), F.lit(True).alias("_there")), "target", "left")
    good = known.where((F.col("target").isNull() | F.col("_there")) & ~F.coalesce(F.col("source") == F.col("target"), F.lit(False))).drop("_there")
    out = coins.join(good.select("coin_id", "source", "target"), "coin_id", "left")
    without = F.when(F.col("source").isNotNull(), F.array_remove("album_ids", F.col("source"))).otherwise(F.col("album_ids"))
    with_ = F.when(F.col("target").isNotNull(), F.array_union(without, F.array("target"))).otherwise(without)
    return out.withColumn("album_ids", with_).drop("source", "target")


def with_defaults(albums: DataFrame, coins: DataFrame, legacy: DataFrame) -> DataFrame:
    """albums less legacy ones that no coin is in, and with the default ones whose id, kind and name are not there."""
    used = coins.select(F.explode("album_ids").alias("album_id")).distinct()
    old = legacy.join(used, "album_id", "left_anti")
    kept = albums.join(old, ["album_id", "name"], "left_anti").select("album_id", "name", "kind")
    wanted = albums.sparkSession.createDataFrame(list(DEFAULTS), "album_id string, name string, kind string")
    a, b = wanted.alias("a"), kept.alias("b")
    there = (F.col("a.album_id") == F.col("b.album_id")) | (F.col("a.kind") == F.col("b.kind")) | (F.lower("a.name") == F.lower("b.name"))
    return kept.unionByName(a.join(b, there, "left_anti"))


def bought(coins: DataFrame, lots: DataFrame, watchlist: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(coins, watchlist) after targets were bought at lots (coin_id, hammer_price, realized_price, price).

    A bought coin leaves goals and dreams for the collection, its purchase price is the lot's first
    given price if that is positive, and it is no longer watched.
    """
    paid = F.coalesce("hammer_price", "realized_price", "price")
    won = lots.select("coin_id", F.when(paid > 0, paid).alias("_paid"), F.lit(True).alias("_won"))
    moved = F.array_union(F.filter("album_ids", lambda x: ~x.isin("goals", "dreams")), F.array(F.lit("my-album")))
    out = coins.join(won, "coin_id", "left")
    out = out.withColumns({"album_ids": F.when(F.col("_won"), moved).otherwise(F.col("album_ids")), "purchase_price": F.coalesce("_paid", "purchase_price")}).drop("_paid", "_won")
    return out, watchlist.join(won, "coin_id", "left_anti")


def in_album(coins: DataFrame, album: str, **facets: str) -> DataFrame:
    out = coins.where(F.array_contains("album_ids", album))
    for name, value in facets.items():
        out = out.where(F.col(name).cast("string") == value)
    return out


def rarity_key(confirmed: Column, reference: Column, general: Column) -> Column:
    """The catalogue's rarity where its evidence is confirmed, else the general one."""
    return F.when(confirmed & reference.isNotNull(), F.concat(F.lit("kopicki:"), reference)).when(general.isNotNull(), F.concat(F.lit("general:"), general))
