"""Sharding by sampled splitters: size-weighted key samples, quantile boundaries, exact cuts.

Records are ordered by (hash of the text, doc_id), so equal texts are neighbours. Where records are
equal in both, they get a number that is written down and comes last in the key. A size-weighted
sample of the keys gives quantile boundaries of many small ranges; one aggregation measures every
range. A range that turns out overfull is subdivided: records of overfull ranges are sampled once
more, in proportion, and the new quantiles are boundaries too. Sample keys carry all parts, so a hot
text is divided by its doc_ids, and a hot record by its numbers. Shard cuts then fall inside single ranges, where a running sum places
them exactly, so shard sizes differ by no more than a record.

A record weighs its bytes and ``ROW`` more, so that many small records fill a range as well. Ranges
are of ``RANGE`` weight, so a task is bounded however large the input is, and their number grows with
it. The driver gets ``PER_RANGE`` sample keys and one row of sums for each: 24 bytes times 16 for
256 MB of input, which is 150 MB for 100 TB.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import col, give_back, id_number, stash, table, without

RANGE = 1 << 28  # weight of a range
LEAST_RANGES = 256
PER_RANGE = 16
ROW = 128
ROUNDS = 3  # of subdivision
KEY = ["_h", "_id", "_row"]


def weighted_sample(keyed: DataFrame, total: int, n: int, seed: int) -> pd.DataFrame:
    """About n keys, each record drawn with odds in proportion to its weight; large ones are sure."""
    step = max(total / n, 1.0)
    draw = F.pmod(F.xxhash64(F.lit(seed), *KEY), F.lit(1 << 30)) / float(1 << 30)
    return keyed.where(draw * step < F.col("_size") + ROW).select(*KEY).toPandas()


def splitters(sample: pd.DataFrame, every: int) -> pd.DataFrame:
    """Every so manieth key of a sample, as boundaries."""
    return sample.sort_values(KEY, ignore_index=True).iloc[every::every].drop_duplicates()


def measured(keyed: DataFrame, cuts: pd.DataFrame) -> tuple[DataFrame, pd.DataFrame]:
    """keyed with _range, and the weight and bytes of each range in use, in order."""
    cuts = cuts.sort_values(KEY)
    ranged = keyed.withColumn("_range", range_of([cuts[k].to_numpy(np.int64) for k in KEY]))
    sums = ranged.groupBy("_range").agg(F.sum(F.col("_size") + ROW).alias("weight"), F.sum("_size").alias("bytes")).toPandas()
    return ranged, sums.sort_values("_range", ignore_index=True)


def divide(keyed: DataFrame, total: int, seed: int, room: int | None = None) -> tuple[DataFrame, pd.DataFrame]:
    """Ranges of about ``room`` weight each; those that hold over twice as much are sampled again and subdivided."""
    room = room or max(1, min(RANGE, total // LEAST_RANGES))
    cuts = splitters(weighted_sample(keyed, total, PER_RANGE * (total // room + 1), seed), PER_RANGE)
    ranged, sums = measured(keyed, cuts)
    for again in range(ROUNDS):
        over = sums[sums["weight"] > 2 * room]
        if over.empty:
            break
        mine = ranged.join(F.broadcast(keyed.sparkSession.createDataFrame(over[["_range"]].astype(int), "_range int")), "_range", "left_semi")  # no more than there are ranges
        held = int(over["weight"].sum())
        more = splitters(weighted_sample(mine, held, 2 * PER_RANGE * (held // room + 1), seed + 1 + again), PER_RANGE)
        before, cuts = len(cuts), pd.concat([cuts, more]).drop_duplicates()
        if len(cuts) == before:
            break
        ranged, sums = measured(keyed, cuts)
    return ranged, sums


def rank_among(cuts: list[np.ndarray], keys: list[np.ndarray]) -> np.ndarray:
    """How many cuts are not above each key; cuts are in order, part by part."""
    low, high = np.searchsorted(cuts[0], keys[0], "left"), np.searchsorted(cuts[0], keys[0], "right")
    if len(cuts) == 1:
        return high
    equal, out = np.flatnonzero(low < high), low.copy()
    for a in np.unique(low[equal]):  # only keys whose first part is a boundary's
        own = equal[low[equal] == a]
        out[own] += rank_among([c[a : high[own[0]]] for c in cuts[1:]], [k[own] for k in keys[1:]])
    return out


def range_of(cuts: list[np.ndarray]) -> Column:
    @F.pandas_udf("int")
    def find(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        try:
            for keys in parts:
                yield pd.Series(rank_among(cuts, [k.to_numpy(np.int64) for k in keys]).astype(np.int32))
        finally:
            give_back()

    return find(*KEY)


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", seed: int = 11) -> DataFrame:
    """Every row of docs with size, shard (0 to shards - 1) and slot (gapless from 0 in its shard).

    Law ``bytes``: size is the UTF-8 bytes of the text plus 1 (null text: 1), and shard totals
    differ from an equal share by less than one record. Equal texts lie together unless a cut falls
    between them. A null id sorts first, an id that is no number by its hash; repeated rows are placed
    side by side, in any order; an empty table gives an empty result. Columns of docs named size, shard or slot are replaced.
    """
    rest = without(docs, ["size", "shard", "slot", *KEY, "_size", "_range"])
    keyed = rest.withColumns(
        {
            "_h": F.xxhash64(col(text_col).cast("string")),
            "_id": id_number(id_col),
            "_size": F.coalesce(F.octet_length(col(text_col).cast("string")), F.lit(0)).cast("long") + 1,
        }
    )
    alike = keyed.groupBy("_h", "_id").agg(F.count("*").alias("n"), F.sum("_size").alias("bytes"))
    total, rows, most = alike.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    weight = total + ROW * rows
    if most > 1:  # numbered once, as another reading might number rows otherwise
        keyed = stash(keyed.withColumn("_row", F.monotonically_increasing_id()), "shard-numbered")
    else:
        keyed = keyed.withColumn("_row", F.lit(0).cast("long"))
    ranged, sums = divide(keyed, weight, seed)

    # bytes and rows before each range, and the shards that the cuts inside it begin
    before = np.concatenate([[0], np.cumsum(sums["bytes"].to_numpy(np.int64))])
    places = pd.DataFrame({"_range": sums["_range"].astype(int), "_bytes_before": before[:-1]})
    spark = docs.sparkSession
    offsets = F.broadcast(spark.createDataFrame(places, "_range int, _bytes_before long"))

    # A record goes to the shard in which its middle byte lies.
    within = Window.partitionBy("_range").orderBy(*KEY)
    placed = ranged.withColumns({"_upto": F.sum("_size").over(within.rowsBetween(Window.unboundedPreceding, 0)), "_row": F.row_number().over(within)})
    middle = (F.col("_bytes_before") + F.col("_upto")) * 2 - F.col("_size")
    placed = placed.join(offsets, "_range").withColumn("shard", F.least(F.floor(middle * shards / F.lit(2.0 * max(total, 1))), F.lit(shards - 1)).cast("int"))

    # A range has rows of few shards, in order; slots go on from the rows of the shard's earlier ranges.
    pieces = placed.groupBy("_range", "shard").agg(F.count("*").alias("n"), F.min("_row").alias("first")).toPandas().sort_values(["shard", "_range"])
    pieces["_slot0"] = pieces.groupby("shard")["n"].cumsum() - pieces["n"] - pieces["first"]
    slots = F.broadcast(spark.createDataFrame(pieces[["_range", "shard", "_slot0"]].astype("int64"), "_range long, shard long, _slot0 long").select(F.col("_range").cast("int"), F.col("shard").cast("int"), "_slot0"))
    out = placed.join(slots, ["_range", "shard"])
    return out.select(*[col(c) for c in rest.columns], F.col("_size").alias("size"), "shard", (F.col("_row") + F.col("_slot0")).cast("long").alias("slot"))


def op4_sampled_splitter_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))  # before sharding, so no text is shuffled
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", crc.alias("text_crc32"))
    return shard(docs).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
