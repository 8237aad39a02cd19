"""Backups: one JSON document an owner, checked as a whole, restored by a swap of versions.

A document is {"format": ..., "version": 1 to 8, "items": {key: text}}. Which keys there may be and what
their texts must hold is given by ``Rules``; one bad item rejects its document.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSIONS = range(1, 9)  # fixed values: versions that are read; the last one is written
#: Parts of the core state that are lists.
STATE_LISTS = ("coins", "albums", "watchlist", "events", "history")


@dataclasses.dataclass(frozen=True)
class Rules:
    """format: the tag; state: the key of the core state; json: keys of other JSON; choices: keys of texts out of a list; passing: JSON keys that are checked but not kept."""

    format: str
    state: str
    json: tuple[str, ...] = ()
    choices: dict[str, tuple[str, ...]] = dataclasses.field(default_factory=dict)
    passing: tuple[str, ...] = ()

    @property
    def allowed(self) -> list[str]:
        return [self.state, *self.json, *self.choices, *self.passing]


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _state_ok(parsed: Column) -> Column:
    """An object, whose lists are lists and whose settings are an object, where they are there."""
    ok = _kind(parsed).startswith("OBJECT")
    for name in STATE_LISTS:
        ok = ok & F.coalesce(_kind(F.try_variant_get(parsed, f"$.{name}", "variant")).startswith("ARRAY"), F.lit(True))
    return ok & F.coalesce(_kind(F.try_variant_get(parsed, "$.settings", "variant")).startswith("OBJECT"), F.lit(True))


def items(backups: DataFrame, owner: str, json: str) -> DataFrame:
    """owner, key, value (a variant) of every item of documents that have an object of items."""
    parsed = backups.select(F.col(owner).alias("owner"), F.try_variant_get(F.try_parse_json(json), "$.items", "variant").alias("_items"))
    objects = parsed.where(_kind(F.col("_items")).startswith("OBJECT"))
    return objects.lateralJoin(backups.sparkSession.tvf.variant_explode(F.col("_items").outer())).select("owner", "key", "value")


def checked(backups: DataFrame, rules: Rules, owner: str = "owner", json: str = "json") -> tuple[DataFrame, DataFrame]:
    """(owner, status, bad keys) of each document and (owner, key, value) of the items of good ones.

    status: ok; unsupported (no JSON, another format or version, no items); unknown_key; bad_value. An
    owner has one document.
    """
    found = items(backups, owner, json).withColumns({"text": F.when(_kind(F.col("value")) == "STRING", F.try_variant_get("value", "$", "string")), "unknown": ~F.col("key").isin(rules.allowed)})
    parsed = F.try_parse_json("text")
    good = parsed.isNotNull()
    good = F.when(F.col("key") == rules.state, good & F.coalesce(_state_ok(parsed), F.lit(False))).otherwise(good)
    for key, texts in rules.choices.items():
        good = F.when(F.col("key") == key, F.col("text").isin(*texts)).otherwise(good)
    found = found.withColumn("bad", ~F.col("unknown") & ~F.coalesce(F.col("text").isNotNull() & good, F.lit(False)))
    told = found.groupBy("owner").agg(F.bool_or("unknown").alias("unknown"), F.bool_or("bad").alias("bad"), F.array_sort(F.collect_set(F.when(F.col("unknown") | F.col("bad"), F.col("key")))).alias("keys"))
    document = F.try_parse_json(json)
    supported = (F.try_variant_get(document, "$.format", "string") == rules.format) & (_kind(F.try_variant_get(document, "$.version", "variant")) == "BIGINT") & F.try_variant_get(document, "$.version", "int").isin(*VERSIONS) & _kind(F.try_variant_get(document, "$.items", "variant")).startswith("OBJECT")
    heads = backups.select(F.col(owner).alias("owner"), F.coalesce(supported, F.lit(False)).alias("supported"))
    status = F.when(~F.col("supported"), "unsupported").when(F.col("unknown"), "unknown_key").when(F.col("bad"), "bad_value").otherwise("ok")
    none = F.array().cast("array<string>")
    verdicts = heads.join(told, "owner", "left").withColumn("status", status)
    verdicts = verdicts.select("owner", "status", F.when(F.col("supported"), F.coalesce("keys", none)).otherwise(none).alias("bad_keys"))
    kept = found.join(verdicts.where("status = 'ok'").select("owner"), "owner", "left_semi").where(~F.col("key").isin(*rules.passing) if rules.passing else F.lit(True))
    return verdicts, kept.select("owner", "key", F.col("text").alias("value"))


def exported(items: DataFrame, rules: Rules) -> DataFrame:
    """One document an owner of the items (owner, key, value) that rules keep."""
    kept = items.where(F.col("key").isin([k for k in rules.allowed if k not in rules.passing]) & F.col("value").isNotNull())
    lists = kept.groupBy("owner").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("items"))
    return lists.select("owner", F.to_json(F.struct(F.lit(rules.format).alias("format"), F.lit(VERSIONS[-1]).alias("version"), "items")).alias("json"))


class Store:
    """Items of all owners in versions under a shared folder; readers see the last one that was committed.

    A restore writes the next version whole and then its marker. Whatever fails before the marker leaves
    the former version in force; what it had written is overwritten by the next attempt.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.empty = spark.createDataFrame([], "owner long, key string, value string")
        self.spark.createDataFrame([(-1,)], "version long").write.mode("overwrite").parquet(f"{self.folder}/markers/first")

    def version(self) -> int:
        return self.spark.read.schema("version long").option("recursiveFileLookup", "true").parquet(f"{self.folder}/markers").agg(F.max("version")).first()[0]

    def items(self) -> DataFrame:
        last = self.version()
        return self.empty if last < 0 else self.spark.read.schema(self.empty.schema).parquet(f"{self.folder}/version={last}")

    def restore(self, backups: DataFrame, rules: Rules) -> DataFrame:
        """Takes the good documents in and returns the verdicts on all: their keys are replaced, passing ones removed, others stay."""
        verdicts, new = checked(backups, rules)
        owners = verdicts.where("status = 'ok'").select("owner")
        old = self.items().join(new.select("owner", "key"), ["owner", "key"], "left_anti")
        if rules.passing:
            old = old.join(owners.withColumn("_gone", F.lit(True)), "owner", "left").where(F.col("_gone").isNull() | ~F.col("key").isin(*rules.passing)).drop("_gone")
        self.commit(old.unionByName(new))
        return verdicts

    def commit(self, rows: DataFrame) -> None:
        following = self.version() + 1
        rows.write.mode("overwrite").parquet(f"{self.folder}/version={following}")
        self.spark.createDataFrame([(following,)], "version long").write.mode("overwrite").parquet(f"{self.folder}/markers/{following}")
