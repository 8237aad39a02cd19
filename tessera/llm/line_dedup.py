"""Line deduplication by winnowing over line hashes.

A window is the fewest lines that hold ``min_words`` words, from a given line on or up to a given
line; a long line is a window of its own. Winnowing selects the line of least hash in every window;
windows side by side mostly select the same line, so a text has few selected positions, and any run
that two texts share has a position that both select. Each selected position is a row: its line's
hash, which is the fingerprint, and the windows around the line that selected it.

Positions are joined on the fingerprint: one whose line is selected nowhere else goes at once, and
with it all its windows. What is left is extended both ways: every window around a shared position
is compared, by a hash of all its lines, with those of the fingerprint's other positions. A window
that occurred before is deleted.

That deletes every repeated run whole. Take a line of a run of min_words words or more that occurred
before: the window from it on lies in the run, or the one up to it does, or else the words on either
side are too few and the window from the run's first line on reaches over it. Any window inside the
run occurred before as well, wherever its first occurrence is, and selected the same line there.

A row's place is its id, then its text, then, where rows share both, a number that is given once and
written down; so a copy is a copy whatever its id, and one of them stays.

Hot lines are not gathered: counts are combined where the rows are, a fingerprint's rows meet its
count in several places, and later windows are joined to the first occurrence alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import col, drop_stash, id_number, slices, stash, table, without

_B = np.uint64(0x9E3779B97F4A7C15)  # any odd number: powers of it have inverses modulo 2^64
_B_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SALTS = 8
KEY = ["_id", "_th", "_row"]
POSITION = "_id long, _th long, _row long, fp long, at int, windows array<struct<start:int,stop:int,win:bigint>>"
_WINDOW = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("win", pa.int64())])


def _least(hashes: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The last place of the least hash in each window, from two spans of a power of two that cover it."""

    def lesser(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(hashes[b] <= hashes[a], b, a)

    out = np.empty(len(first), np.int64)
    level = np.frexp(stop - first)[1] - 1
    least = np.arange(len(hashes))  # of the 2^k lines from each line on
    for k in range(level.max(initial=-1) + 1):
        own = level == k
        out[own] = lesser(least[first[own]], least[stop[own] - (1 << k)])
        least = lesser(least[: -(1 << k)], least[1 << k :])
    return out


def windows(texts: list[str], min_words: int) -> dict[str, np.ndarray]:
    """All windows of texts: their text's number, first and last line (exclusive), selected line, its hash, their own.

    A line without words is selected in no window.
    """
    lines = [t.split("\n") for t in texts]
    count = np.array([len(x) for x in lines], np.int64)
    n = int(count.sum())
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for own in lines for x in own), np.uint64, n)
    words = np.fromiter((len(x.split()) for own in lines for x in own), np.int64, n)
    upto = np.concatenate([[0], np.cumsum(words)])
    begin, end = np.repeat(np.cumsum(count) - count, count), np.repeat(np.cumsum(count), count)
    line = np.arange(n)
    onward = np.searchsorted(upto, upto[:-1] + min_words, "left")  # fewest lines with enough words
    back_to = np.searchsorted(upto, upto[1:] - min_words, "right") - 1
    forth = onward <= end
    back = back_to >= begin
    back[back] = ~forth[back_to[back]] | (onward[back_to[back]] != line[back] + 1)  # each window once
    doc = np.repeat(np.arange(len(texts)), count)
    doc, first, stop = np.concatenate([doc[forth], doc[back]]), np.concatenate([line[forth], back_to[back]]), np.concatenate([onward[forth], line[back] + 1])
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(n + 1, _B, np.uint64)) * _B_INVERSE  # B^0, B^1, ...
        inverse = np.cumprod(np.full(n + 1, _B_INVERSE, np.uint64)) * _B
        sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes * power[:-1], dtype=np.uint64)])
        win = (sums[stop] - sums[first]) * inverse[first] + (stop - first).astype(np.uint64)
    at = _least(np.where(words > 0, hashes, np.uint64(2**64 - 1)), first, stop)
    return {"count": count, "doc": doc, "first": first, "stop": stop, "at": at, "fp": hashes[at], "win": win}


def _emit(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            w = windows(batch.column(3).to_pylist(), min_words)
            keys = [batch.column(k).to_numpy() for k in range(3)]
            begin = np.concatenate([[0], np.cumsum(w["count"])])
            by = np.argsort(w["at"], kind="stable")
            at = w["at"][by]
            own = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else by
            doc, base = w["doc"][by], begin[w["doc"][by]]
            parts = [pa.array((w["first"][by] - base).astype(np.int32)), pa.array((w["stop"][by] - base).astype(np.int32)), pa.array(w["win"][by].view(np.int64))]
            around = pa.ListArray.from_arrays(pa.array(np.append(own, len(at)).astype(np.int32)), pa.StructArray.from_arrays(parts, fields=list(_WINDOW)))
            columns = [*(pa.array(key[doc[own]]) for key in keys), pa.array(w["fp"][by][own].view(np.int64)), pa.array((at[own] - base[own]).astype(np.int32)), around]
            yield pa.RecordBatch.from_arrays(columns, names=[*KEY, "fp", "at", "windows"])

    return run


def repeated_runs(keyed: DataFrame, min_words: int) -> DataFrame:
    """(_id, _th, _row, runs): for each text with repeated runs, the first and last (exclusive) lines of each."""
    rows = stash(keyed.where("_text IS NOT NULL").select(*KEY, "_text").mapInArrow(_emit(min_words), POSITION), "line-positions")
    shared = rows.groupBy("fp").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    shared = shared.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64(*KEY, "at"), F.lit(SALTS)).cast("int")
    met = rows.withColumn("_salt", salt).join(shared.hint("merge"), ["fp", "_salt"])
    met = stash(met.select(*KEY, "fp", F.inline("windows")), "line-windows")
    here = F.struct(*KEY, "start")
    first = met.groupBy("fp", "win").agg(F.min(here).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    first = stash(first, "line-first")
    later = met.join(first, ["fp", "win"]).where(here != F.col("_first"))
    runs = stash(later.groupBy(*KEY).agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("runs")), "line-runs")
    for used in (rows, met, first):
        drop_stash(used)
    return runs


def _cut(texts: pd.Series, runs: pd.Series) -> pd.DataFrame:
    out = []
    for text, own in zip(texts, runs, strict=True):
        if text is None:
            out.append((0, 0, "", None))
        elif own is None or not len(own):
            out.append((text.count("\n") + 1, 0, "", text))
        else:
            lines = text.split("\n")
            edge = np.zeros(len(lines) + 1, np.int64)
            for r in own:
                edge[r["start"]] += 1
                edge[r["stop"]] -= 1
            gone = np.cumsum(edge[:-1]) > 0
            turns = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
            spans = ",".join(f"{a}-{b}" for a, b in zip(turns[::2], turns[1::2], strict=True))
            out.append((len(lines), int(gone.sum()), spans, "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)))
    return pd.DataFrame(out, columns=["n_lines", "n_removed", "removed", "kept_text"])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """Every row of docs with n_lines, n_removed, removed (``first-last,...``, last exclusive) and kept_text.

    A run of lines of min_words words or more that occurred before is removed; before is by id, then
    by a hash of the text, then by line, so the first occurrence stays. Runs of fewer words, such as
    a short line that many texts share, stay. A null text has no lines and stays null; an empty one
    is one empty line. A null id comes first, an id that is no number stands where its hash does. Of
    rows of equal id and text any one is first, and the others repeat it. Added names replace
    columns of docs.
    """
    added = ["n_lines", "n_removed", "removed", "kept_text"]
    rest = without(docs, [*added, *KEY, "_text", "_cut", "runs"])
    text = col(text_col).cast("string")
    keyed = rest.withColumns({"_id": id_number(id_col), "_th": F.xxhash64(text), "_text": text})
    if keyed.where("_text IS NOT NULL").groupBy("_id", "_th").agg(F.count("*").alias("_n")).where("_n > 1").isEmpty():
        keyed = keyed.withColumn("_row", F.lit(0).cast("long"))
    else:  # numbered once, as another reading might number rows otherwise
        keyed = stash(keyed.withColumn("_row", F.monotonically_increasing_id()), "line-numbered")
    cut = F.pandas_udf(_cut, "n_lines long, n_removed long, removed string, kept_text string")
    # by key at every size: whether the runs would fit a broadcast says nothing of larger inputs
    runs = repeated_runs(keyed, min_words).hint("merge")
    out = keyed.join(runs, KEY, "left").withColumn("_cut", cut("_text", "runs"))
    return out.select(*[col(c) for c in rest.columns], *[F.col(f"_cut.{c}").alias(c) for c in added])


def op9_line_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "removed", "kept_text")
