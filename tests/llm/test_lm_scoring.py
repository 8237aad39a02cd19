"""Scores against a plain model with exact counts, the filter's errors, passes over blocks, and odd rows."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
import regex
from pyspark.sql import functions as F

from tessera.llm import lm_scoring, vocab_slices

DATA = "/root/testdata/sf0.001"


def tokens(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return regex.findall(r"[^\x20\x09-\x0D]+", lower) + [" "]


def plain(rows, order=2):
    """(n_tokens, n_known, N, base, score) of each (text, trained), with counts as their levels tell them."""
    counts = [Counter() for _ in range(order)]
    for text, trained in rows:
        t = tokens(text)
        for i in range(len(t)) if trained else ():
            counts[0][t[i],] += 1
            for n in range(2, order + 1):
                gram = tuple(t[i - n + 1 : i + 1]) if i >= n - 1 else (" ", *t[:n - 1]) if n == i + 2 else None
                if gram:
                    counts[n - 1][gram] += 1
    total, words = sum(counts[0].values()), len(counts[0])
    rough = [{g: lm_scoring.COUNT_OF[lm_scoring.level_of(np.array([c]))[0]] for g, c in own.items()} for own in counts]
    for text, _ in rows:
        t = tokens(text)
        score = 0.0
        for i in range(len(t)):
            own = rough[0].get((t[i],), 0)
            p = (own + 1) / (total + words + 1)
            before = rough[0].get((t[i - 1] if i else " ",), 0)
            for n in range(2, order + 1):
                gram = tuple(t[i - n + 1 : i + 1]) if i >= n - 1 else (" ", *t[:n - 1]) if n == i + 2 else None
                if not gram:
                    continue
                context = before if n == 2 else rough[n - 2].get(gram[:-1], 0)
                seen = min(rough[n - 1].get(gram, 0), context)
                p = (seen + lm_scoring.MASS * p) / (context + lm_scoring.MASS)
            score += math.log10(p)
        base = sum(math.log10((counts[0][w,] + 1) / (total + words + 1)) for w in t)
        yield len(t), sum(counts[0][w,] > 0 for w in t), total, base, score


@pytest.fixture(scope="module")
def documents():
    rows = pq.read_table(f"{DATA}/documents.parquet").to_pydict()
    return {i: (t, zlib.crc32(str(i).encode()) % 7 != 2) for i, t in zip(rows["doc_id"], rows["text"])}


def test_query_against_exact_counts(spark, documents):
    out = {r.doc_id: r for r in lm_scoring.op12_log_frequency_filter(spark, DATA).collect()}
    assert set(out) == set(documents)
    scores = []
    for (i, (_, trained)), (n, known, total, base, score) in zip(documents.items(), plain(list(documents.values()))):
        r = out[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not trained, n, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        scores.append((r.score, score))
    off = [abs(a - b) / -b for a, b in scores]
    assert max(off) < 0.1 and sum(off) / len(off) < 0.01  # what false positives do, most of all in short texts
    assert sum(r.score for r in out.values()) > sum(r.base_score for r in out.values())


def test_filter_reads_back_levels_and_rarely_errs():
    rng = np.random.default_rng(5)
    hashes = rng.integers(0, 1 << 63, 60_000, dtype=np.uint64)
    counts = np.minimum(rng.zipf(1.5, 30_000), 1 << 30)
    rows = []
    for s in range(4):
        own = ((hashes[:30_000] >> np.uint64(32)) % np.uint64(4)) == s
        keys = (hashes[:30_000] & lm_scoring.LOW).astype(np.uint32)[own]
        rows.append({"segment": s, "bits": lm_scoring.segment_bits(np.repeat(keys, 2), np.stack([counts[own] - counts[own] // 2, counts[own] // 2]).T.ravel()).tobytes()})
    levels = lm_scoring.Block(rows, {r["segment"]: len(r["bits"]) for r in rows}, 4).levels(hashes)
    true = lm_scoring.level_of(counts)
    assert (levels[:30_000] >= true).all() and (levels[:30_000] > true).mean() < 0.05
    assert 0 < (levels[30_000:] > 0).mean() < 0.05  # 2^-6 by design
    assert (np.diff(lm_scoring.COUNT_OF) >= 0).all() and lm_scoring.COUNT_OF[1] == 1


@pytest.mark.parametrize("order", [2, 3])
def test_passes_over_blocks_and_small_slices_change_nothing(spark, documents, monkeypatch, order):
    df = spark.createDataFrame([(i, t, k) for i, (t, k) in documents.items()], "doc_id long, text string, k boolean")
    whole = {r.id: r for r in lm_scoring.score_texts(df, F.col("k"), order=order).collect()}
    monkeypatch.setattr(lm_scoring, "FILTER_BLOCK", 20_000)
    parts = {r.id: r for r in lm_scoring.score_texts(df.repartition(5), F.col("k"), order=order).collect()}
    assert {i: (r.n_tokens, r.n_known) for i, r in whole.items()} == {i: (r.n_tokens, r.n_known) for i, r in parts.items()}
    assert all(math.isclose(whole[i].score, parts[i].score, rel_tol=1e-9) for i in whole)
    exact = dict(zip(documents, plain(list(documents.values()), order)))
    off = [abs(r.score - exact[i][4]) / -exact[i][4] for i, r in whole.items()]
    assert max(off) < 0.1 and sum(off) / len(off) < 0.02  # what false positives do, most of all in short texts


def test_stretches_cut_at_white_space(monkeypatch):
    text = "Some  Wörter\tof a long\x1ctext\n\n" * 50 + "x" * 40
    monkeypatch.setattr(lm_scoring, "STRETCH", 7)
    assert [w.decode() for part in lm_scoring.split_words(text) for w in part] == tokens(text)[:-1]


def test_slices_keep_documents_whole(spark, odd_docs, monkeypatch):
    monkeypatch.setattr(vocab_slices, "SLICE", 100)
    out = vocab_slices.vocab_slices(odd_docs, F.col("text"), {"id": F.col("doc_id")}, lm_scoring.split_words, "test-slices").collect()
    back = Counter()
    for r in out:
        seq, starts = vocab_slices.documents(r.seq, r.lengths)
        assert len(set(map(bytes, r.words))) == len(r.words)
        for i, a, b in zip(r.id, starts, starts[1:]):
            back[i, b" ".join(bytes(r.words[k]) for k in seq[a:b])] += 1
    assert back == Counter((r.doc_id, b" ".join((r.text or "").encode().lower().split())) for r in odd_docs.collect())


def test_odd_rows(spark, odd_docs):
    out = lm_scoring.score_texts(odd_docs, F.lit(True)).collect()
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    expected = Counter((i, n, known, total, round(base, 6)) for (i, _), (n, known, total, base, _) in zip(rows, plain([(t, True) for _, t in rows])))
    assert Counter((r.id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == expected
    untrained = lm_scoring.score_texts(odd_docs, F.lit(None).cast("boolean")).collect()
    assert len(untrained) == len(rows) and all(r.score == r.base_score == 0 and r.n_known == 0 and r.train_tokens == 0 for r in untrained)
    assert lm_scoring.score_texts(odd_docs.where("false"), F.lit(True)).collect() == []
