"""Every stage of the pipeline against plain loops over what the stage before it kept."""

import re

import numpy as np

import corpus_pipeline
from tests.llm.test_brute_force import decontamination_by_loops, jaccard_brute, water_fill
from tessera.llm import decontamination
from tessera.llm.common import stash, table

DATA = "/root/testdata/sf0.001"


def test_pipeline_against_plain_loops(spark):
    before = table(spark, DATA, "documents")
    columns = before.columns
    seen = {"documents": before.toPandas()}
    for name, stage in corpus_pipeline.STAGES:
        before = stash(stage(spark, before, DATA), f"test-{name}")
        seen[name] = before.toPandas()
        assert before.columns[: len(columns)] == columns

    docs, told = seen["documents"], seen["language_id"].set_index("doc_id")
    letters = {d for d, t in zip(docs.doc_id, docs.text, strict=True) if isinstance(t, str) and any(c.isalpha() for c in t)}
    assert set(told.index) == letters and told.index.is_unique
    named = docs[docs.lang.notna() & docs.doc_id.isin(letters)].set_index("doc_id")
    assert (told.loc[named.index].lang == named.lang).mean() > 0.95
    assert told.text.to_dict() == {d: t for d, t in zip(docs.doc_id, docs.text, strict=True) if d in letters}

    component = jaccard_brute(told.text.to_dict())
    unique = seen["near_duplicates"].set_index("doc_id")
    assert sorted(unique.index) == sorted({c for _, c in component.values()})

    bench = spark.read.parquet(f"{DATA}/benchmark.parquet").toPandas()
    found = decontamination_by_loops(unique.text.to_dict(), dict(zip(bench.item_id, bench.text, strict=True)))
    clean = seen["decontamination"].set_index("doc_id")
    assert sorted(clean.index) == sorted(d for d, (n, hit, _) in found.items() if not hit or hit < n)
    for d, (n, hit, _) in found.items():
        if d in clean.index:
            assert len(decontamination.words_of(clean.text[d])) == n - hit and (hit or clean.text[d] == unique.text[d])

    mixed = seen["mixing"]
    copies = mixed.groupby("doc_id").size().reindex(clean.index, fill_value=0)
    assert copies.max() <= 2 and set(mixed.doc_id) <= set(clean.index)
    size = clean.text.map(lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t)))
    names = sorted(clean.source.dropna().unique(), key=lambda s: s.encode()) + ([None] if clean.source.isna().any() else [])
    of = clean.source.map(lambda s: names.index(s if isinstance(s, str) else None)).to_numpy()
    own = np.bincount(of, size, len(names))
    target = water_fill(own, np.resize([3.0, 1.0, 2.0], len(names)), 1.5 * own.sum(), 2.0)
    taken = np.bincount(of, size * copies, len(names))
    assert (np.abs(taken - target) <= [size[of == k].max() for k in range(len(names))]).all()

    shards = seen["sharding"]
    assert sorted(shards.doc_id) == sorted(mixed.doc_id) and shards["size"].tolist() == [len(t.encode()) + 1 for t in shards.text]
    for _, part in shards.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    bytes_ = shards.groupby("shard")["size"].sum()
    assert bytes_.max() - bytes_.min() <= 2 * shards["size"].max()
