"""Rows that are alike in every part of a key, phrases of many items, and one very long text."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontamination, language_id, line_dedup, sharding
from tessera.llm.language_id import Model, Words


@pytest.mark.parametrize("seed", [11, 168])
def test_equal_records_are_divided(spark, seed):
    """A tenth of all records are one text without an id: they spread over ranges, whatever the seed."""
    df = spark.range(60_000).select(F.when(F.col("id") % 10 != 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 10 != 0, F.concat(F.lit("t"), F.col("id").cast("string"))).otherwise("same").alias("text"))
    out = sharding.shard(df, 16, seed=seed).toPandas()
    own = out.groupby("shard")["size"].sum()
    assert len(out) == 60_000 and own.max() - own.min() <= 2 * out["size"].max()
    assert all(sorted(x.slot) == list(range(len(x))) for _, x in out.groupby("shard"))


def test_sample_of_equal_records_is_in_proportion(spark):
    """The draw is by record, so a key of a tenth of all weight gets about a tenth of the sample."""
    rows = spark.range(100_000).select(F.when(F.col("id") % 10 == 0, 5).otherwise(F.xxhash64("id")).alias("_h"), F.lit(1).cast("long").alias("_id"), F.monotonically_increasing_id().alias("_row"), F.lit(10).cast("long").alias("_size"))
    total = rows.agg(F.sum(F.col("_size") + sharding.ROW)).first()[0]
    for seed in (11, 168):
        drawn = sharding.weighted_sample(rows, total, 4000, seed)
        assert 3500 < len(drawn) < 4500 and 300 < (drawn["_h"] == 5).sum() < 500
        _, sums = sharding.divide(rows, total, seed, room=total // 64)
        assert sums.weight.sum() == total and sums.weight.max() <= 2 * (total // 64) + 138


def test_rank_among_cuts():
    rng = random.Random(1)
    cuts = sorted({tuple(rng.randrange(4) for _ in range(3)) for _ in range(20)})
    keys = [tuple(rng.randrange(-1, 5) for _ in range(3)) for _ in range(500)]
    got = sharding.rank_among([np.array(c) for c in zip(*cuts, strict=True)], [np.array(k) for k in zip(*keys, strict=True)])
    assert got.tolist() == [sum(c <= k for c in cuts) for k in keys]


def test_lines_of_rows_that_share_an_id(spark):
    """Of rows of equal id and text one stays whole; texts of one id that differ are compared as well."""
    passage = "\n".join(" ".join(f"w{i}x{j}" for j in range(10)) for i in range(6))
    rows = [(None, passage)] * 40 + [(1, passage)] * 2 + [(2, "own line\n" + passage), (2, "other line\n" + passage), (None, None), (None, None)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    whole = out[(out.n_removed == 0) & out.kept_text.notna()]
    assert len(out) == 46 and len(whole) == 1 and whole.doc_id.isna().all()
    assert (out[out.doc_id == 1].n_removed == 6).all() and sorted(out[out.doc_id == 2].kept_text) == ["other line", "own line"]


def test_phrase_of_many_items(spark):
    """A thousand items say one word, which one text repeats; occurrences are not repeated by item."""
    items = [(f"i{k:04}", "Yes") for k in range(1000)] + [("other", "no yes")]
    phrases = decontamination.Phrases([(name, decontamination.words_of(t)) for name, t in items], 10)
    text = "yes " * 200_000 + "no yes"
    tracemalloc.start()
    (n_words, mask, found), empty = decontamination._judge([text, ""], phrases, None, None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n_words == 200_002 and mask.all() and len(found) == 1001 and empty[0] == 0 and empty[2] == []
    assert peak < 200 << 20
    docs = spark.createDataFrame([(k, "well yes" if k % 2 else "well") for k in range(400)], "doc_id long, text string")
    got = decontamination.decontaminate(docs, spark.createDataFrame(items, "item_id string, text string")).collect()
    assert len(got) == 400 and all(len(r["items"]) == (1000 if r.doc_id % 2 else 0) for r in got)


@pytest.fixture(scope="module")
def five_languages():
    rng = np.random.default_rng(0)
    vocab = [["".join(rng.choice(list("abcdefghijklmnop"[k : k + 9]), rng.integers(2, 9))) for _ in range(500)] for k in range(5)]
    rows = []
    for k, own in enumerate(vocab):
        words, n = Words([" ".join(own)]), np.zeros(language_id.BUCKETS)
        for _, bucket in words.grams():
            n += np.bincount(bucket, minlength=language_id.BUCKETS)
        used = np.flatnonzero(n)
        rows.append(language_id._pack(pa.table({"lang": [f"l{k}"] * len(used), "bucket": used, "n": n[used].astype(np.int64)})))
    return Model(pa.concat_tables(rows)), vocab, rng


def test_stretches_give_what_whole_texts_give(five_languages, monkeypatch):
    model, vocab, rng = five_languages
    monkeypatch.setattr(language_id, "STRETCH", 3000)
    monkeypatch.setattr(language_id, "room", lambda size, langs: size)
    for trial in range(12):
        parts = [(int(rng.integers(5)), int(rng.integers(1, 400))) for _ in range(rng.integers(1, 12))] if trial > 1 else [(trial, 3000)]
        text = "\n".join(" ".join(rng.choice(vocab[k], n)) for k, n in parts)
        (lang, score, spans), long = language_id._predict([text], model, 8.0, True)[0], language_id._predict_long(pa.array([text])[0].as_buffer(), model, 8.0, True)
        assert long[0] == lang and long[1] == pytest.approx(score) and long[2] == spans
    for odd in (" ", "1 2 3 " * 3000, "é" * 20_000, "x" * 20_000, " " * 9000):
        buffer = pa.array([odd])[0].as_buffer()
        assert "".join(language_id.stretch_at(buffer, at) for at in language_id.stretches(buffer, 3000)) == odd
        assert (language_id._predict_long(buffer, model, 8.0, True)[0] == language_id.UND) == (not language_id.has_letter(odd))


def test_memory_of_one_long_text(five_languages):
    """Twelve times the text takes no more memory, but for the text itself."""
    model, vocab, rng = five_languages
    peaks = []
    for turns in (1, 12):
        text = " ".join(" ".join(rng.choice(vocab[k % 5], 30_000)) for k in range(5 * turns))
        buffer = pa.array([text])[0].as_buffer()
        tracemalloc.start()
        assert len(language_id._predict_long(buffer, model, 8.0, True)[2]) >= 5 * turns
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.3 * peaks[0] and peaks[1] < 100 << 20
