"""Operators against plain versions on small tables, and round trips."""

import collections
import glob
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat_formatting, decontamination, jaccard_join, language_id, line_dedup, mixing, nearest_neighbours, pii, sharding, url_filters
from tessera.llm.common import stash
from tessera.llm.components import connected

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").toPandas()


def test_language_model_on_held_out(spark):
    out = language_id.op1_language_id(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (out.lang == out.lang_pred).mean() >= 0.95


def test_viterbi_is_exact():
    rng = np.random.default_rng(0)
    for _ in range(60):
        offsets = np.concatenate([[0], np.cumsum(rng.integers(0, 8, 4))])
        scores = rng.normal(0, 3, (offsets[-1], 3)).astype(np.float32)
        labels = language_id.label_words(scores, offsets, 4.0)
        for a, b in itertools.pairwise(offsets):
            value = lambda p: sum(scores[a + i, x] for i, x in enumerate(p)) - 4 * sum(x != y for x, y in itertools.pairwise(p))  # noqa: B023, E731
            if a < b:
                assert abs(value(labels[a:b]) - max(map(value, itertools.product(range(3), repeat=b - a)))) < 1e-4


def test_language_scripts_narrow(spark):
    rows = [(i, "слово дело время", "ru") for i in range(5)] + [(i, "word time deal", "en") for i in range(5)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id int, text string, lang string"))
    probe = spark.createDataFrame([("ббб",), ("zzz",), ("слово дело время слово дело word time deal word time",)], "text string")
    got = [(r.lang_pred, len(r.spans)) for r in language_id.identify(probe, model).collect()]
    assert got[0] == ("ru", 1) and got[1] == ("en", 1) and got[2][1] == 2


def test_escapes_round_trip():
    rng = random.Random(2)
    for _ in range(500):
        text = "".join(rng.choice("<|\\n\nim_start>é😀") for _ in range(rng.randrange(12)))
        assert "<|" not in chat_formatting.escape(text) and chat_formatting.unescape(chat_formatting.escape(text)) == text
        assert chat_formatting.unescape_role(chat_formatting.escape_role(text)) == text
        chunk, a, b = chat_formatting.format_turn(text, text)
        assert chat_formatting.read_turns(chunk) == [(text, text)] and chat_formatting.unescape(chunk[a:b]) == text


def test_tree_layout():
    turns = [[("u", "a"), ("assistant", "b"), ("u", "c")], [("u", "a"), ("assistant", "b"), ("u", "d")], [("u", "a")], [("u", "z")]]
    tree = chat_formatting.build_tree([(str(i), t) for i, t in enumerate(turns)])
    nodes = tree["nodes"]
    assert len(nodes) == 5
    for n in nodes:
        up = n["parent"]
        chain, k = [], up
        while k >= 0:
            chain, k = [k, *chain], nodes[k]["parent"]
        attended = [t for a, b in n["ancestors"] for t in range(a, b)]
        assert attended == [t for k in chain for t in range(nodes[k]["token_start"], nodes[k]["token_end"])]
        assert all(a[1] < b[0] for a, b in itertools.pairwise(n["ancestors"]))
        assert n["position"] == sum(b - a for a, b in n["ancestors"]) and (up < 0 or nodes[up]["start"] < n["start"] < n["exit"] <= nodes[up]["exit"])
    for leaf in tree["leaves"]:
        n = nodes[leaf["node"]]
        path = "".join(tree["text"][a:b] for a, b in n["ancestors"]) + tree["text"][n["start"] : n["end"]]
        assert chat_formatting.read_turns(path) == turns[int(leaf["path"])]


@pytest.mark.parametrize("part", [2, 5, 512])
@pytest.mark.parametrize("tokenizer", [None, "/opt/tokenizers/*.json"])
def test_hot_trees_write_shared_turns_once(spark, part, tokenizer):
    """Whatever the size of pieces: one node for each distinct prefix, and positions, intervals and turns of each path."""
    path = next(iter(sorted(glob.glob(tokenizer))), None) if tokenizer else None
    if tokenizer and not path:
        pytest.skip("no tokenizer here")
    rng = random.Random(part)
    said = {i: [("user", "hi")] + [(rng.choice(["user", "assistant"]), rng.choice("abc<|\\é")) for _ in range(rng.randrange(6))] for i in range(60)}
    said[60], said[61] = [("user", "hi")], [("user", "other"), ("assistant", "x")]
    df = spark.createDataFrame([(i, k, r, t) for i, turns in said.items() for k, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    trees, index = chat_formatting.chat_format(df, part=part, tokenizer_path=path)
    trees = stash(trees, "test-trees")
    pieces = {t.piece: t for t in trees.collect()}
    prefixes = {tuple(turns[: k + 1]) for turns in said.values() for k in range(len(turns))}
    assert sum(len(t.nodes) for t in pieces.values()) == len(prefixes)
    assert (part == 512) == all(not t.above for t in pieces.values())
    leaf = {}
    for t in pieces.values():
        above = [pieces[p] for p in t.above]
        before = sum(p.nodes[0].token_end for p in above)
        for n in t.nodes:
            assert n.position == before + sum(b - a for a, b in n.ancestors)
            if path:
                assert t.position_ids[n.token_start : n.token_end] == list(range(n.position, n.position + n.token_end - n.token_start))
        for x in t.leaves:
            chain, k = [], x.node
            while k >= 0:
                chain, k = [t.nodes[k], *chain], t.nodes[k].parent
            leaf[x.path] = "".join(p.text for p in above) + "".join(t.text[n.start : n.end] for n in chain)
    of = {r.conv_id: r.path for r in index.collect()}
    assert {i: chat_formatting.read_turns(leaf[of[i]]) for i in said} == said
    read = {r.path: r for r in chat_formatting.read_back(trees).collect()}
    for i, turns in said.items():
        lost = "".join(t for r, t in turns if r == "assistant")
        assert (read[of[i]].n_turns, read[of[i]].loss_sha256) == (len(turns), hashlib.sha256(lost.encode()).hexdigest())


def test_conversations_against_plain_loops(spark):
    got = chat_formatting.op2_chat_prefix_tree(spark, DATA).toPandas().set_index("conv_id")
    said = spark.read.parquet(f"{DATA}/conversations.parquet").toPandas().sort_values(["conv_id", "turn"])
    said["text"] = said.text.fillna("")
    for k, own in said.groupby("conv_id"):
        whole = "".join(f"{r}\n{t}\n" for r, t in zip(own.role, own.text, strict=True))
        lost = "".join(t for r, t in zip(own.role, own.text, strict=True) if r == "assistant")
        assert tuple(got.loc[k, ["n_turns", "turns_sha256", "loss_chars", "loss_sha256"]]) == (len(own), hashlib.sha256(whole.encode()).hexdigest(), len(lost), hashlib.sha256(lost.encode()).hexdigest())
    assert got.loc[-1, "n_turns"] == 2 and got.loc[-1, "loss_chars"] == 34


def decontamination_by_loops(texts: dict, items: dict, window: int = 10) -> dict:
    """The contract by nested loops, for small tests: doc -> (n_words, n_hit, sorted items)."""
    out = {}
    for doc, text in texts.items():
        words, hit, found = decontamination.words_of(text), set(), set()
        for item, phrase in items.items():
            p = decontamination.words_of(phrase)
            size = min(window, len(p))
            for j in range(len(p) - size + 1) if size else ():
                for i in range(len(words) - size + 1):
                    if words[i : i + size] == p[j : j + size]:
                        hit.update(range(i, i + size))
                        found.add(str(item))
        out[doc] = (len(words), len(hit), sorted(found))
    return out


def test_decontamination_against_loops(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("aa bb cc dd éé 1".split())
    texts = {i: " ".join(word() for _ in range(rng.randrange(60))) for i in range(40)}
    items = {i: " ".join(word() for _ in range(rng.randrange(8))) for i in range(15)}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    b = spark.createDataFrame(list(items.items()), "item_id long, text string")
    want = decontamination_by_loops(texts, items, 4)
    for size in (64, 1 << 23):
        for words in (10, 1 << 20):
            got = decontamination.decontaminate(d, b, window=4, shard_bytes=size, block_words=words).collect()
            assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in got} == want
            for r in got:
                words_left = len(decontamination.words_of(r.clean_text))
                assert words_left == r.n_words - r.n_hit


def test_contamination_of_documents(spark, docs):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet").toPandas()
    got = decontamination.op3_benchmark_decontamination(spark, DATA).toPandas()
    assert got.contaminated.any() and not got.contaminated.all()
    some = got[got.contaminated].doc_id.tolist()[:3] + got[~got.contaminated].doc_id.tolist()[:3]
    texts = dict(zip(docs.doc_id, docs.text, strict=True))
    want = decontamination_by_loops({k: texts[k] for k in some}, dict(zip(bench.item_id, bench.text, strict=True)))
    for r in got[got.doc_id.isin(some)].itertuples():
        assert (r.n_words, r.n_hit, r.items_sha256) == (*want[r.doc_id][:2], hashlib.sha256(",".join(want[r.doc_id][2]).encode()).hexdigest())


def test_shards_are_even(spark):
    out = sharding.op4_sampled_splitter_sharding(spark, DATA).toPandas()
    own = out.groupby("shard")["size"].sum()
    assert own.max() - own.min() <= 2 * out["size"].max() and set(out.shard) <= set(range(16))
    again = sharding.op4_sampled_splitter_sharding(spark, DATA).toPandas()
    assert out.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))


def test_hot_text_is_divided(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 3000, "x" * 9).otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"))
    own = [r.n for r in sharding.shard(df, 16).groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert len(own) == 16 and max(own) - min(own) <= 20


def water_fill(size, weight, total, cap):
    """Targets by the contract's words, for small tests: fill, stop those above, reshare until none is above."""
    most, target = size * cap, np.zeros(len(size))
    open_ = size > 0
    left = min(total, most[open_].sum())
    while open_.any():
        target[open_] = left * weight[open_] / weight[open_].sum()
        over = open_ & (target > most)
        if not over.any():
            break
        target[over] = most[over]
        left -= most[over].sum()
        open_ &= ~over
    return target


def test_water_filling(spark):
    rng = np.random.default_rng(1)
    for k in range(12):
        names = [chr(97 + i) if i % 3 else chr(0x1F600 + i) for i in range(9)] + [None]
        size = rng.integers(0, 100, 10) * rng.integers(0, 2, 10) * (k > 0)
        df = spark.createDataFrame([("-" if n is None else "+" + n, int(s)) for n, s in zip(names, size, strict=True)], "_source string, source_size long")
        got = {r._source: r for r in mixing.filled(mixing.weighed(df, (3.0, 1.0, 2.0)), 1.5, 2.0).collect()}
        order = sorted(got, key=lambda s: (s == "-", s.encode()))
        own = np.array([got[s].source_size for s in order], float)
        want = water_fill(own, np.resize([3.0, 1.0, 2.0], 10), 1.5 * own.sum(), 2.0)
        assert np.allclose([got[s].target for s in order], want)
        assert all(r._whole * r.source_size + r._want == pytest.approx(r.target) for r in got.values())


def test_mixing_against_plain_loops(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").toPandas()
    got = mixing.op6_source_mixing(spark, DATA).toPandas().set_index("doc_id").loc[docs.doc_id]
    size = np.array([0 if t is None else len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in docs.text])
    names = sorted({s for s in docs.source if s is not None}, key=lambda s: s.encode()) + ([None] if docs.source.isna().any() else [])
    of = np.array([names.index(s if isinstance(s, str) else None) for s in docs.source])
    own = np.bincount(of, size, len(names))
    target = water_fill(own, np.resize([3.0, 1.0, 2.0], len(names)), 1.5 * own.sum(), 2.0)
    assert (got["size"].to_numpy() == size).all() and (got.source_size.to_numpy() == own[of]).all()
    assert np.allclose(got.target, target[of]) and (got.taken <= 2 * got["size"]).all()
    taken = np.bincount(of, got.taken, len(names))
    assert (np.abs(taken - target) <= [size[of == k].max() for k in range(len(names))]).all()


def test_shards_against_plain_loops(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").toPandas()
    out = sharding.op4_sampled_splitter_sharding(spark, DATA).toPandas().set_index("doc_id").loc[docs.doc_id]
    data = [b"" if t is None else t.encode() for t in docs.text]
    assert out["size"].tolist() == [len(d) + 1 for d in data] and out.text_crc32.tolist() == [zlib.crc32(d) for d in data]
    for _, own in out.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    ends = out.sort_values(["shard", "slot"])["size"].cumsum().to_numpy()
    middle = ends - out.sort_values(["shard", "slot"])["size"].to_numpy() / 2
    assert (np.minimum(np.floor(middle * 16 / ends[-1]), 15) == out.sort_values(["shard", "slot"])["shard"]).all()


def test_overfull_ranges_are_subdivided(spark):
    """A third of all rows have no text, and long texts draw nearly all of the first sample."""
    rows = spark.range(30_000).select(F.col("id").alias("_id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.xxhash64("id")).alias("_h"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 5000).cast("long").alias("_size"), F.lit(0).cast("long").alias("_row"))
    total = rows.agg(F.sum(F.col("_size") + sharding.ROW)).first()[0]
    for seed in range(3):
        _, sums = sharding.divide(rows, total, seed, room=total // 64)
        assert sums.weight.sum() == total and sums.weight.max() <= 2 * (total // 64) + 5000


def test_urls_against_plain_model(spark):
    """Scores from counts by the same formula, and a threshold between labelled URLs, in plain Python."""
    pages = spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url").toPandas()
    got = url_filters.op8_url_language_model(spark, DATA).toPandas().set_index("page_id").loc[pages.page_id]
    upper = str.maketrans(url_filters.UPPER + "123456789", url_filters.LOWER + "000000000")
    counts = {"allow": collections.Counter(), "block": collections.Counter()}
    folded, labels = {}, {}
    for url, rule, host, path in zip(pages.url, got.rule, got.host, got.path, strict=True):
        rest = url.split("://", 1)[1] if isinstance(url, str) and "://" in url else ""
        assert host == re.match(r"[^/?#]*", rest)[0].translate(str.maketrans(url_filters.UPPER, url_filters.LOWER)) and path == re.match(r"[^/?#]*([^?#]*)", rest)[1]
        fits = [(r, v) for v, r in url_filters.RULES if ("." + host).endswith("." + r[: r.index("/")]) and path.startswith(r[r.index("/") :])]
        best = max(fits, key=lambda f: len(f[0]), default=(None, None))
        assert (rule if isinstance(rule, str) else None) == best[0]
        plain = "^^^" + re.sub(r"[^a-z0./_?=&%#:~-]", "*", rest.translate(upper))
        folded[url], labels[url] = [plain[i : i + 4] for i in range(len(plain) - 3)], best[1]
        if best[1] and isinstance(url, str) and not url_filters.kept_out(url):
            for g in folded[url]:
                for k in range(1, 5):
                    counts[best[1]][(k, g[4 - k :])] += 1
                    counts[best[1]][(k, g[4 - k : -1], "context")] += 1

    def log_p(c, g):
        p = (c[(1, g[3:])] + 1) / (c[(1, "", "context")] + url_filters.SYMBOLS)
        for k in (2, 3, 4):
            p = (c[(k, g[4 - k :])] + url_filters.LAMBDA * p) / (c[(k, g[4 - k : -1], "context")] + url_filters.LAMBDA)
        return np.log(p)

    known = [u for u in folded if folded[u]]
    score = {u: np.mean([log_p(counts["allow"], g) - log_p(counts["block"], g) for g in folded[u]]) for u in known}
    for url, s in zip(pages.url, got.score, strict=True):
        assert (url not in score and np.isnan(s)) or s == pytest.approx(score[url], abs=1e-6)
    free = got[got.rule.isna() & got.score.notna()]
    assert free[free.verdict == "block"].score.max() < free[free.verdict == "allow"].score.min() or free.verdict.nunique() == 1


def test_mix_comes_near_its_targets(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 10 % 4).cast("string")).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 50 + 1).cast("int")).alias("text"))
    own = mixing.mix(df).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("most")).collect()
    assert all(abs(r.taken - r.target) <= r.most for r in own)


def test_nearest_with_factor_one_is_exact(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(600, 6)) * rng.uniform(0.5, 2, (600, 1))
    v[100:160] = v[5]
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = nearest_neighbours.nearest(df, df.where("vec_id % 20 = 0"), k=20, factor=1.0).toPandas()
    for q, own in got.groupby("query_id"):
        score = nearest_neighbours.exact_scores(np.broadcast_to(v[q], v.shape), v)
        order = [i for i in np.lexsort((np.arange(600), -score)) if i != q][:20]
        assert own.sort_values("rank").vec_id.tolist() == order and np.allclose(own.sort_values("rank").score, score[order], atol=0)


def test_recall_of_the_query(spark):
    got = nearest_neighbours.op5_vantage_point_search(spark, DATA).toPandas()
    e = spark.read.parquet(f"{DATA}/embeddings.parquet").toPandas()
    v, ids = np.stack(e.embedding).astype(float), e.vec_id.to_numpy()
    hit = 0
    for q, own in got.groupby("query_id"):
        score = v @ v[ids == q][0]
        score[ids == q] = -np.inf
        hit += len(set(ids[np.lexsort((ids, -score))[:20]]) & set(own.vec_id))
    assert hit / (20 * got.query_id.nunique()) >= 0.95


@pytest.mark.parametrize("outlier", [None, 5.0, 10.0, 1e200])
def test_recall_with_mixed_norms_and_an_outlier(spark, outlier):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(300, 32))[rng.integers(0, 300, 32_000)] + rng.normal(0, 0.4, (32_000, 32))  # 4,000 a shard
    v *= rng.choice([0.8, 1.0, 1.25], (32_000, 1)) / np.linalg.norm(v, axis=1, keepdims=True)
    if outlier:
        v[7] *= outlier
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(32_000), "embedding": pa.array(list(v))}))
    got = nearest_neighbours.nearest(df, df.where("vec_id % 200 = 1"), k=20).toPandas()
    hit = 0
    for q, own in got.groupby("query_id"):
        score = v @ v[q]
        score[q] = -np.inf
        hit += len(set(np.argsort(-score)[:20]) & set(own.vec_id))
    assert hit / (20 * 160) >= 0.9


def grouped(noise):
    """8,192 vectors of 64 components in 200 groups."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(200, 64))[rng.integers(0, 200, 8192)] + rng.normal(0, noise, (8192, 64))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize("factor", [1.0, 1.2, 1.5])
def test_recall_of_full_shards(factor):
    """One shard of loose groups; of factor 1 everything is right."""
    v = grouped(0.5)
    ids, q = np.arange(8192), np.arange(0, 8192, 20)
    got = nearest_neighbours.search_tree(nearest_neighbours.VPTree(v), ids, np.arange(8193), q, v[q], 20, factor).to_pandas()
    hit = 0
    for i, own in got.groupby("query_id"):
        score = v @ v[i]
        score[i] = -np.inf
        hit += len(set(np.argsort(-score)[:20]) & set(own.vec_id))
    assert len(got) == 20 * len(q) and hit / len(got) >= (1.0 if factor == 1 else 0.95)


@pytest.mark.parametrize("noise, most", [(0.5, 0.6), (0.2, 0.25)])
def test_larger_factors_compare_less(noise, most):
    """The share of pairs compared: at factor 1 well below all of them, and less with each larger factor."""
    v = grouped(noise)
    tree = nearest_neighbours.VPTree(v)
    shares = [tree.search(v[::20], 21, factor)[2] / (len(v[::20]) * len(v)) for factor in (1.0, 1.2, 1.5, 2.0, 3.0)]
    assert shares[0] <= most and all(a > b for a, b in zip(shares, shares[1:]))


def test_bounds_hold_for_every_vector():
    rng = np.random.default_rng(5)
    v = rng.normal(size=(3000, 8)) * rng.choice([1e-3, 0.5, 1.0, 1.3, 40.0], (3000, 1))
    tree = nearest_neighbours.VPTree(v)
    q = v[::50] / np.linalg.norm(v[::50], axis=1, keepdims=True)
    high, products = tree.bounds(q, 1.0), q @ tree.v.T
    assert all((products[:, a:b].max(1) <= high[:, leaf]).all() for leaf, (a, b) in enumerate(tree.leaves))


def test_ties_go_to_the_smaller_ids(spark):
    """Vectors that differ in a component the queries lack all score the same."""
    df = spark.createDataFrame([(i, [1.0, float(i % 997)]) if i else (0, [1.0, 0.0]) for i in range(3000)], "vec_id long, embedding array<double>")
    got = nearest_neighbours.nearest(df, df.where("vec_id = 0"), k=20, factor=1.0).orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(1, 21)) and {r.score for r in got} == {1.0}


def test_longer_vector_displaces_no_others(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 0.0, 0.0]), (3, [0.5, 0.0, 1.0])], "vec_id long, embedding array<double>")
    got = [(r.query_id, r.vec_id, r.score) for r in nearest_neighbours.nearest(df, df).orderBy("query_id").collect()]
    assert got == [(0, 1, 0.5), (1, 0, 0.5), (2, 3, 0.5), (3, 2, 0.5)]


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str | None) -> str:
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, kind, m.end()))
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out))


def test_personal_data_against_plain_patterns(spark):
    rng = random.Random(5)
    texts = [None, "", "a@b.c_d@e.f x@y..z", "1.2.3.4.5.6.7.8 001.002.003.0004", "4111 1111 1111 1111 5-4111111111111111", "+1 (800) 555-1212) +1+2345678901", "é😀 a@b.co 😀 +12345678901", "1" * 20_000, "a." * 9_000 + "@b"]
    texts += ["".join(rng.choice("0123456789 -.+@ab()é") for _ in range(150)) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in pii.find_pii(df).collect():
        got = ",".join(f"{s.kind}:{s.start}:{s.end}" for s in r.pii if s.base)
        assert got == base_spans(texts[r.doc_id])


def test_added_kinds_need_checksum_or_context(spark):
    texts = ["DE89 3704 0044 0532 0130 00", "DE88 3704 0044 0532 0130 00", "ssn 123-45-6789", "123-45-6789"]
    got = {r.doc_id: [s.kind for s in r.pii] for r in pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    assert "iban" in got[0] and "iban" not in got[1] and got[2] == ["ssn"] and got[3] == []


def test_context_is_read_on_both_sides(spark):
    gap = " " * 40
    texts = ["123-45-6789 is my social security number", "😀 123-45-6789 is my SSN", f"123-45-6789{gap}ssn", f"ssn{gap}123-45-6789", "s123-45-6789sn", f"{'x' * 38}ss 123-45-6789 no"]
    got = {r.doc_id: [(s.kind, s.start, s.score) for s in r.pii] for r in pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    assert got == {0: [("ssn", 0, 0.6)], 1: [("ssn", 2, 0.6)], 2: [], 3: [], 4: [], 5: []}


def lines_by_loops(texts: dict[int, str | None], min_words: int = 50) -> dict[int, list[int]]:
    """The same by plain loops, for small tests: the removed lines of each text.

    Every line is compared with every earlier one, and runs are followed to the first mismatch.
    """
    out: dict[int, set[int]] = {k: set() for k in texts}
    lines = {k: t.split("\n") for k, t in texts.items() if t is not None}
    for k0, k in ((a, b) for b in lines for a in lines if a <= b):
        for i0, i in ((a, b) for b in range(len(lines[k])) for a in range(b if k0 == k else len(lines[k0]))):
            if min(i0, i) and lines[k0][i0 - 1] == lines[k][i - 1]:
                continue  # inside a run
            n = 0
            while i + n < len(lines[k]) and i0 + n < len(lines[k0]) and lines[k0][i0 + n] == lines[k][i + n]:
                n += 1
            if sum(len(x.split()) for x in lines[k][i : i + n]) >= min_words:
                out[k].update(range(i, i + n))
    return {k: sorted(v) for k, v in out.items()}


def test_lines_against_loops(spark):
    rng = random.Random(6)
    lines = [" ".join(rng.choice("abcdefgh") for _ in range(rng.choice([0, 1, 3, 12]))) for _ in range(12)]
    texts = {i: "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 25))) for i in range(30)}
    df = spark.createDataFrame([*texts.items(), (99, None)], "doc_id long, text string")
    want = lines_by_loops(texts, 10)
    for r in line_dedup.dedup_lines(df, min_words=10).collect():
        gone = [x for s in r.removed.split(",") if s for x in range(*map(int, s.split("-")))]
        assert gone == want.get(r.doc_id, [])


def test_repeated_passage_goes_once(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    df = spark.createDataFrame([(1, f"start\n{passage}\nend"), (2, f"other\n{passage}\nlast"), (3, "start\nend")], "doc_id long, text string")
    got = {r.doc_id: r.kept_text for r in line_dedup.dedup_lines(df).collect()}
    assert got == {1: f"start\n{passage}\nend", 2: "other\nlast", 3: "start\nend"}


def test_repeated_runs_go_whole(spark):
    long, short = " ".join(f"p{i}" for i in range(60)), [f"a{i} b{i} c{i} d{i}" for i in range(10)]
    run = [long, *short]
    spaced = [x for line in run for x in (line, "", "")]
    texts = {
        1: "\n".join(["start", *run, "end"]),
        2: "\n".join(["other", *run, "last"]),
        3: "\n".join(["gap", *spaced]),
        4: "\n".join([*spaced, "final"]),
        5: "\n".join(["head", long, "tail one two", "tail three"]),
        6: "\n".join(["body", long, "tail one two", "tail three"]),
        7: "\n".join([*short[::-1], long]),
        8: "\n".join([*short[::-1], long, "fin"]),
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.removed, r.kept_text) for r in line_dedup.dedup_lines(df).collect()}
    assert got[2] == ("1-12", "other\nlast") and got[4] == ("0-33", "final")
    assert got[6] == ("1-4", "body")  # of its run only the long line is in an earlier text than 5
    assert got[8] == ("0-11", "fin")
    want = lines_by_loops(texts)
    assert {k: [x for s in v[0].split(",") if s for x in range(*map(int, s.split("-")))] for k, v in got.items()} == want


@pytest.mark.parametrize("seed", range(40))
def test_windows_cover_repeated_runs(seed):
    rng = random.Random(seed)
    lines = [" ".join(rng.choice("abc") for _ in range(rng.choice([0, 0, 1, 3, 12]))) for _ in range(5)]
    texts = {i: "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 20))) for i in range(8)}
    first, gone = {}, {k: set() for k in texts}
    w = line_dedup.windows(list(texts.values()), 10)
    begin = np.concatenate([[0], np.cumsum(w["count"])])
    for k, a, b, key in sorted(zip(w["doc"], w["first"], w["stop"], zip(w["fp"], w["win"], strict=True), strict=True), key=lambda x: x[:3]):
        if first.setdefault(key, (k, a)) != (k, a):
            gone[k].update(range(a - begin[k], b - begin[k]))
    assert {k: sorted(v) for k, v in gone.items()} == lines_by_loops(texts, 10)


def jaccard_brute(texts, percent=75):
    sets = {}
    for k, t in texts.items():
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    comp = {k: k for k in sets}
    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]) and comp[a] != comp[b]:
            low, high = sorted((comp[a], comp[b]))
            comp = {k: low if c == high else c for k, c in comp.items()}
    return {k: (len(sets[k]), comp[k]) for k in sets}


def near_texts():
    rng = random.Random(7)
    texts = {}
    for g in range(12):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([3, 6, 40, 120]))]
        for _ in range(rng.choice([1, 2, 9])):
            own = list(base)
            for _ in range(rng.randrange(1 + len(own) // 40)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(9)}"
            texts[len(texts)] = " ".join(own)
    shared = [f"hot{i}" for i in range(30)]
    for _ in range(20):
        texts[len(texts)] = " ".join([f"u{rng.randrange(10**6)}" for _ in range(60)] + shared)
    texts[len(texts)] = None
    return texts


@pytest.mark.parametrize("chunk, heavy_from", [(384, 32), (5, 3)])
def test_components_against_all_pairs(spark, monkeypatch, chunk, heavy_from):
    monkeypatch.setattr(jaccard_join, "CHUNK", chunk)
    monkeypatch.setattr(jaccard_join, "HEAVY_FROM", heavy_from)
    texts = near_texts()
    got = jaccard_join.near_components(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r._id: (r.n, r.component) for r in got} == jaccard_brute(texts)


def test_only_copies_go_whatever_their_ids(spark):
    text = {c: " ".join(f"{c}{i}" for i in range(30)) for c in "abcdefgh"}
    more = {c: f"{t} more" for c, t in text.items()}
    rows = [(None, text["a"]), (None, text["b"]), (None, text["c"]), (None, more["c"]), (1, text["d"]), (1, text["e"]), (1, text["e"]), (None, text["f"]), (2, more["f"]), (2, text["g"]), (3, more["g"]), (None, text["h"]), (None, text["h"]), (4, None), (4, None)]
    for ids in ("bigint", "string"):
        df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc_id", F.expr("concat('x', doc_id)" if ids == "string" else "doc_id"))
        got = [r.text for r in jaccard_join.deduplicate(df).collect()]
        assert len(got) == 10 and got.count(None) == 2
        assert sorted(t[0] for t in got if t) == list("abcdefgh")  # one of each group
        if ids == "bigint":
            assert text["f"] in got and text["g"] in got  # that of the smallest id


def test_components_of_documents(spark, docs):
    got = jaccard_join.op10_ngram_jaccard_join(spark, DATA).toPandas()
    want = jaccard_brute(dict(zip(docs.doc_id, docs.text, strict=True)))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.itertuples()} == want


def test_signature_tree_loses_no_pair():
    rng = np.random.default_rng(8)
    pool = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool, rng.integers(3, 120))) for _ in range(50)]
    sets += [np.unique(np.append(s[: max(1, int(len(s) * 0.9))], rng.integers(0, 1 << 63, 2, dtype=np.uint64))) for s in sets]
    n = np.array([len(s) for s in sets])
    every = np.ones(len(sets), bool)
    exact = jaccard_join.match_sets([s.tobytes() for s in sets], n, 75, np.arange(len(sets)), every)
    maybe = jaccard_join.match_bitmaps([jaccard_join.bitmap(s) for s in sets], n, 75, np.arange(len(sets)), every)
    links = 0
    for a, b in itertools.combinations(range(len(sets)), 2):
        both = len(np.intersect1d(sets[a], sets[b]))
        if 100 * both >= 75 * (n[a] + n[b] - both):
            links += 1
            assert exact[a] == exact[b] and maybe[a] == maybe[b]
    assert links > 20


def test_connected_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 150)] + [(200, 200)]
    got = connected(spark.createDataFrame(links, "a long, b long")).collect()
    roots = {r.node: r.root for r in got}
    assert len({roots[i] for i in range(41)}) == 1 and len({roots[i] for i in range(100, 150)}) == 1 and roots[0] != roots[100]


def test_secrets_need_their_context(spark):
    code = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    texts = [f'token = "{code}" x', f"commit {code} x", f"{code} is the api key", "token = " + "a" * 40, "token = " + "1" * 40]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = [[(s.kind, s.start, s.end) for s in r.pii] for r in pii.find_pii(df).orderBy("doc_id").collect()]
    assert got == [[("secret", 9, 49)], [], [("secret", 0, 40)], [], []]


def test_many_matches_in_one_text(spark):
    """Places of more matches than a block holds, and pieces of unequal length between them."""
    rng = random.Random(8)
    parts = [("é" * rng.randrange(60) + " ", f"a{i}@b{i}.cd") for i in range(700)]
    df = spark.createDataFrame([(1, "".join(a + b for a, b in parts))], "doc_id long, text string")
    at, want = 0, []
    for a, b in parts:
        want.append((at + len(a), at + len(a) + len(b)))
        at += len(a) + len(b)
    assert [(s.start, s.end) for s in pii.find_pii(df).first().pii] == want
