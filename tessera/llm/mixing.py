"""Mixing sources to target weights: capped water-filling and seeded repetitions.

Water-filling: every source asks for its share of the wanted total; a source above its cap stops at
the cap, and what it gives up goes to the others in proportion to their weights, until none is
above. Repetitions: a source with target r times its size takes floor(r) whole passes and a seeded
part of one more. That part is the records whose seeded hash lies below a cutoff, chosen from
histograms of size over hash buckets so that the source's taken size comes nearest to its target.

Work on records is one projection and two aggregations; the per-source tables hold one row for each
source and ``COARSE`` bucket at most.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import col, drop_stash, stash, table, without

COARSE = FINE = 256
#: Per-source tables of up to so many rows (under 10 MB) are broadcast; larger ones are joined by key.
BROADCAST_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def weighed(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """sources (_source, source_size) with the weights in turn, by code point, null last.

    Names are put into ranges and numbered inside each; only the counts of ranges reach the driver.
    """
    ranged = stash(sources.repartitionByRange(F.col("_source") == "-", "_source").withColumn("_part", F.spark_partition_id()), "mix-sources")
    counts = sorted((r["_part"], r["count"]) for r in ranged.groupBy("_part").count().collect())
    before = np.concatenate([[0], np.cumsum([n for _, n in counts])]).tolist()
    first = F.create_map(*(F.lit(x) for (part, _), n in zip(counts, before, strict=False) for x in (part, n))) if counts else F.lit(None).cast("map<int,int>")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(F.col("_source") == "-", "_source")) - 1 + first[F.col("_part")]
    return ranged.withColumn("_weight", F.get(F.array(*map(F.lit, weights)), F.pmod(place, F.lit(len(weights))).cast("int")))


def filled(sources: DataFrame, scale: float, cap: float) -> DataFrame:
    """sources with target, _whole and _want: water-filling, in rounds over all sources at once.

    A source stops at cap times its size once the level (words for a unit of weight) reaches that;
    each round raises the level by what the stopped ones leave, until none stops any more. One row
    of sums reaches the driver in a round.
    """
    most = F.col("source_size") * cap
    open_ = (F.col("source_size") > 0) & (F.col("_weight") > 0)
    whole = sources.agg(F.sum("source_size").alias("all"), F.sum(F.when(open_, most)).alias("most")).first()
    total, level = min(scale * (whole["all"] or 0), whole["most"] or 0), 0.0
    while True:
        stops = open_ & (most <= level * F.col("_weight"))
        sums = sources.agg(F.sum(F.when(stops, most)).alias("full"), F.sum(F.when(open_ & ~stops, F.col("_weight"))).alias("weight")).first()
        left = (total - (sums["full"] or 0)) / sums["weight"] if sums["weight"] else level
        if left <= level:
            break
        level = left
    target = F.when(open_, F.least(most, level * F.col("_weight"))).otherwise(0.0)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("long")
    want = F.greatest(F.col("target") - F.col("_whole") * F.col("source_size"), F.lit(0.0))
    return sources.withColumn("target", target.cast("double")).withColumn("_whole", whole).withColumn("_want", want).select("_source", "source_size", "target", "_whole", "_want")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _attach(rows: DataFrame, small: DataFrame, n: int) -> DataFrame:
    """rows with the per-source columns of small, on a null-safe key."""
    side = F.broadcast(small) if n <= BROADCAST_SOURCES else small
    return rows.join(side, "_source", "left")


def mix(
    docs: DataFrame,
    source_col: str = "source",
    id_col: str = "doc_id",
    text_col: str = "text",
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    scale: float = 1.5,
    cap: float = 2.0,
    seed: int = 17,
) -> DataFrame:
    """Every row of docs with size, source_size, target, copies and taken (copies times size).

    Sources in code point order, null last, get the weights in turn; together they want scale times
    the size of all rows, and none more than cap times its own. Size is the number of words of the
    text; null and empty texts have size 0 and are taken 0 words. A null source is a source of its
    own. Equal (id, text) rows draw the same number, so repeated rows are taken or left together.
    An empty table gives an empty result; added names replace columns of docs.
    """
    rest = without(docs, ["size", "source_size", "target", "copies", "taken", "_source", "_coarse", "_fine"])
    draw = F.pmod(F.xxhash64(F.lit(seed), col(id_col), col(text_col)), F.lit(COARSE * FINE))
    # the key: "+" and the name, or "-" for null, so that it joins as an ordinary value
    key = F.when(col(source_col).isNull(), "-").otherwise(F.concat(F.lit("+"), col(source_col).cast("string")))
    sized = rest.withColumns({"_source": key, "size": n_words(col(text_col)), "_coarse": F.floor(draw / FINE).cast("int"), "_fine": F.pmod(draw, F.lit(FINE)).cast("int")})

    # one row for each (source, bucket, sub-bucket) in use
    counted = stash(sized.groupBy("_source", "_coarse", "_fine").agg(F.sum("size").alias("n")), "mix-histogram")
    sources = weighed(counted.groupBy("_source").agg(F.sum("n").alias("source_size")), weights)
    targets = stash(filled(sources, scale, cap), "mix-targets")
    n_sources = targets.count()

    # the coarse bucket in which the cutoff lies, then the sub-bucket: each window has 256 rows a source
    run = Window.partitionBy("_source").orderBy("_coarse").rowsBetween(Window.unboundedPreceding, 0)
    coarse = _attach(counted.groupBy("_source", "_coarse").agg(F.sum("n").alias("n")), targets, n_sources)
    coarse = coarse.withColumn("upto", F.sum("n").over(run)).where((F.col("upto") > F.col("_want")) & (F.col("upto") - F.col("n") <= F.col("_want")))
    edge = coarse.groupBy("_source").agg(F.min(F.struct("_coarse", (F.col("_want") - F.col("upto") + F.col("n")).alias("rest"))).alias("e")).select("_source", F.col("e._coarse").alias("_cut"), "e.rest")
    fine = _attach(counted, edge, n_sources).where(F.col("_coarse") == F.col("_cut"))
    fine = fine.withColumn("upto", F.sum("n").over(Window.partitionBy("_source").orderBy("_fine").rowsBetween(Window.unboundedPreceding, 0)))
    # a sub-bucket is in if that brings the source nearer to its target
    fine = fine.groupBy("_source").agg(F.first("_cut").alias("_cut"), F.sum(((F.col("upto") - F.col("n") / 2) <= F.col("rest")).cast("int")).alias("k"), F.sort_array(F.collect_list("_fine")).alias("used"))
    cut = fine.select("_source", "_cut", F.when(F.col("k") < F.size("used"), F.get("used", F.col("k"))).otherwise(F.lit(FINE)).alias("_sub"))
    plan = stash(_attach(targets, cut, n_sources), "mix-plan")
    for used in (counted, targets):
        drop_stash(used)

    below = (F.col("_coarse") < F.col("_cut")) | ((F.col("_coarse") == F.col("_cut")) & (F.col("_fine") < F.col("_sub")))
    extra = (F.col("_want") > 0) & F.coalesce(below, F.lit(True))
    copies = (F.col("_whole") + extra.cast("long")).cast("long")
    out = _attach(sized, plan, n_sources).withColumn("copies", F.least(copies, F.lit(int(np.floor(cap)))))
    return out.select(*[col(c) for c in rest.columns], "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
