"""Alignment against whole texts tokenised and aligned by plain loops."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow.parquet as pq
import pytest

from tessera.llm import token_alignment, vocab_slices

DATA = "/root/testdata/sf0.001"
A = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
B = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()


@pytest.fixture(scope="module")
def both():
    return token_alignment.Tokenizers(A, B)


def tokens(both, text):
    if not text:
        return None
    a, b = both.a.encode(" " + text, add_special_tokens=False).ids, both.b.encode(text)
    same = b"".join(both.a_bytes[i] for i in a) == (" " + text).encode() == b"".join(both.b_bytes[i] for i in b)
    return (a, b) if same else None


def plain(both, texts):
    """The columns of each text."""
    rows, holders = [], Counter()
    for text in texts:
        got = tokens(both, text)
        if not got:
            rows.append(None)
            continue
        spans = []
        for ids, sizes in zip(got, (both.a_size, both.b_size)):
            at, own = 0, []
            for i in ids:
                own.append((at, at + int(sizes[i]), i))
                at += int(sizes[i])
            spans.append(own)
        ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        at, groups = [0, 0], []
        for end in ends:
            sides = []
            for k, own in enumerate(spans):
                first = at[k]
                while at[k] < len(own) and own[at[k]][1] <= end:
                    at[k] += 1
                sides.append(",".join(str(i) for _, _, i in own[first : at[k]]))
            groups.append("|".join(sides))
        links, k = [], 0
        for s, e, i in spans[0]:
            while k and spans[1][k][0] > s:
                k -= 1
            while spans[1][k][1] <= s:
                k += 1
            while k < len(spans[1]) and spans[1][k][0] < e:
                links.append((i, spans[1][k][2]))
                k += 1
            k -= 1
        holders.update(set(links))
        rows.append((len(got[0]), len(got[1]), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = defaultdict(int)
    for (a, _), n in holders.items():
        top[a] = max(top[a], n)
    for r in rows:
        yield (*r[:3], len(r[3]), sum(holders[p] == top[p[0]] for p in r[3]), sum(holders[p] for p in r[3]), r[4]) if r else (0, 0, 0, 0, 0, 0, "")


NAMES = "n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
HARD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a   b  ", "\n a", "a\n b", "a \n b", "a\n  b", "\t x\t y", "a b  c d", "a　 b 　c", "a​ b﻿ c᠎ d", "x\x85 y \x1c z\x1f w",
    "<|endoftext|> <s> </s> <unk> <0x41>", "don't  we'll 's 't", "▁ a▁b ▁▁", "é é ́ x", "日本語 テキスト 中文", "😀 👩‍👩‍👧 \U0010ffff", "a\0b \0 c", "1234567 12 3.14159", "x" * 300 + " " + "y" * 300, "naïve ünï cödé ß", "\r\n a\r\n\r\n b", "ﬁ Å Ω ½",
]


def test_whole_table_against_plain_loops(spark, both):
    rows = pq.read_table(f"{DATA}/documents.parquet").to_pydict()
    out = {r.doc_id: tuple(r[n] for n in NAMES) for r in token_alignment.op13_segment_alignment(spark, DATA).collect()}
    assert out == dict(zip(rows["doc_id"], plain(both, rows["text"])))


@pytest.mark.parametrize("small", [False, True])
def test_hard_texts_by_both_ways(spark, both, monkeypatch, small):
    if small:  # many slices and stretches, pairs by a join
        monkeypatch.setattr(vocab_slices, "SLICE", 60)
        monkeypatch.setattr(token_alignment, "STRETCH", 5)
        monkeypatch.setattr(token_alignment, "PAIR_BYTES", 0)
        monkeypatch.setattr(token_alignment, "TOGETHER", 7)
    texts = HARD + HARD[:9] + [" ".join(x or "" for x in HARD if x and "▁" not in x)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "key long, body string, slice int, pairs string")
    out = {r.id: tuple(r[n] for n in NAMES) for r in token_alignment.align(df.repartition(3), A, B, "key", "body").collect()}
    assert out == dict(enumerate(plain(both, texts)))


def test_vocabularies_decide_whether_texts_are_cut(both):
    assert token_alignment.splitter(A, B) is token_alignment.cut_segments
    assert token_alignment.splitter(A.replace('"add_prefix_space":false', '"add_prefix_space":true').replace('"add_prefix_space": false', '"add_prefix_space": true'), B) is token_alignment.one_segment
    for text in HARD:
        assert b" ".join(s for part in token_alignment.cut_segments(text or "") for s in part) == (text or "").encode()


def test_odd_rows(spark, both, odd_docs):
    rows = odd_docs.collect()
    expected = Counter((r.doc_id, *p) for r, p in zip(rows, plain(both, [r.text for r in rows])))
    assert Counter((r.id, *(r[n] for n in NAMES)) for r in token_alignment.align(odd_docs, A, B).collect()) == expected
    assert token_alignment.align(odd_docs.where("false"), A, B).collect() == []
