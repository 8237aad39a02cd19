"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import pytest

import corpus_pipeline
from tessera.llm import chat_formatting, decontamination, jaccard_join, language_id, line_dedup, mixing, nearest_neighbours, pii, sharding, url_filters
from tessera.llm.common import stash

DATA = "/root/testdata/sf0.001"


def bench(spark):
    return spark.createDataFrame([(1, "same text of some words"), (None, "12345"), (2, None), (3, "")], "item_id long, text string")


OPS = {
    "language_id": lambda spark, d: language_id.identify(d, language_id.train(d)),
    "decontaminate": lambda spark, d: decontamination.decontaminate(d, bench(spark)),
    "shard": lambda spark, d: sharding.shard(d, 4),
    "mix": lambda spark, d: mixing.mix(d),
    "pii": lambda spark, d: pii.find_pii(d),
    "lines": lambda spark, d: line_dedup.dedup_lines(d),
    "components": lambda spark, d: jaccard_join.near_components(d),
}


@pytest.mark.parametrize("name", OPS)
def test_odd_rows_keep_their_number(spark, odd_docs, name):
    out = OPS[name](spark, odd_docs)
    assert len(out.collect()) == 14
    assert len({c.lower() for c in out.columns}) == len(out.columns)


@pytest.mark.parametrize("name", OPS)
def test_empty_tables(spark, odd_docs, name):
    assert OPS[name](spark, odd_docs.where("false")).collect() == []


def test_pipeline_stages_on_odd_rows(spark, odd_docs):
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stash(stage(spark, docs, DATA), "test-stage")
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    empty = docs.select("doc_id", "text", "lang", "source", "n_chars").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stash(stage(spark, empty, DATA), "test-stage").isEmpty()


def test_language_of_texts_without_letters(spark, odd_docs):
    got = {r.doc_id: r for r in OPS["language_id"](spark, odd_docs).collect()}
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (3, 4, 5, 6))
    assert got[1].lang_pred != "und" and 0 < got[1].score <= 1
    nothing = language_id.train(odd_docs.where("false"))
    assert {r.lang_pred for r in language_id.identify(odd_docs, nothing).collect()} == {"und"}


def test_sharding_places(spark, odd_docs):
    rows = OPS["shard"](spark, odd_docs).collect()
    for s in {r.shard for r in rows}:
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own)))
    assert sorted(r["size"] for r in rows if r.text is None) == [1, 1, 1]


def test_mixing_of_nulls(spark, odd_docs):
    rows = OPS["mix"](spark, odd_docs).collect()
    assert all(r.taken == r.copies * r["size"] and r.taken <= 2 * r["size"] for r in rows)
    assert all(r["size"] == 0 for r in rows if not (r.text or "").strip())


def test_components_of_odd_rows(spark, odd_docs):
    rows = OPS["components"](spark, odd_docs).collect()
    by = {r._id: r for r in rows}
    assert by[2].component == by[1].component == 1 and by[8].component == by[7].component == 7
    assert by[3].key is None and by[5].n == 0 and by[4].component == 4
    kept = jaccard_join.deduplicate(odd_docs).select("doc_id", "text").collect()
    assert sorted((r.doc_id for r in kept if r.doc_id), key=int) == [1, 3, 4, 5, 6, 7, 9, 10]
    assert sum(r.doc_id is None for r in kept) == 3


def test_pii_of_nulls(spark, odd_docs):
    assert all(r.pii == [] for r in OPS["pii"](spark, odd_docs).where("text IS NULL OR text = ''").collect())


def test_conversations(spark):
    said = [(1, 0, "user", "hi"), (1, 1, "assistant", "a <|im_end|> \\ b"), (2, 0, "user", "hi"), (2, 1, "assistant", None), (None, 0, None, "x"), (None, None, "user", ""), (3, 0, "us\ner", "<|<|\\<|"), (3, 0, "us\ner", "<|<|\\<|")]
    df = spark.createDataFrame([(*r, 1) for r in said], "conv_id long, turn long, role string, text string, path int")
    trees, index = chat_formatting.chat_format(df)
    read = {r.path: r for r in chat_formatting.read_back(trees).collect()}
    got = {r.conv_id: read[r.path] for r in index.collect()}
    assert {k: v.n_turns for k, v in got.items()} == {1: 2, 2: 2, 3: 2, None: 2}
    assert got[1].loss_chars == len("a <|im_end|> \\ b") and got[2].loss_chars == 0
    text = {t.piece: t for t in trees.collect()}
    shared = [t for t in text.values() if len(t.leaves) == 2]
    assert len(shared) == 1 and shared[0].text.count("<|im_start|>user\nhi") == 1
    assert chat_formatting.format_trees(chat_formatting.conversations_of(df.where("false"), "conv_id", "turn", "role", "text")).collect() == []


def test_urls(spark):
    urls = [None, "", "no scheme", "HTTP://A.NET", "http://a.net/x", "http://EXAMPLE.net/en/1", "http://x.org/fr/2?q", "http://x.org/en/ü", "http://y.example.com/de/", "http://net/", "http://z.com#f", "http://z.com#f"]
    df = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, score int")
    got = [(r.host, r.path, r.rule, r.verdict) for r in url_filters.filter_urls(df).orderBy("page_id").collect()]
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3][:3] == ("a.net", "", None)
    assert got[4] == ("a.net", "/x", "net/", "block") and got[5] == ("example.net", "/en/1", "example.net/en/", "allow")
    assert got[6] == ("x.org", "/fr/2", "org/fr/", "allow") and got[8][2] == "example.com/de/" and got[9][2] == "net/" and got[10] == got[11]
    assert url_filters.filter_urls(df.where("false")).collect() == []


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[1.0, 0.0], [1.0, 0.0], [0.5, 0.5], None, [0.0, 0.0], [nan, 1.0], [inf, 1.0], [1.0, None], [1.0], [-1.0, 0.2]]
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, score int")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in nearest_neighbours.nearest(df, df.where("vec_id IN (0, 3, 9)"), k=20).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 0.5), (0, 3, 9, -1.0), (9, 1, 2, -0.4), (9, 2, 0, -1.0), (9, 3, 1, -1.0)]
    assert nearest_neighbours.nearest(df.where("false"), df).collect() == []
