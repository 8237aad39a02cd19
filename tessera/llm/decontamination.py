"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of documents inside one scan task, closed when its text reaches
``shard_bytes``. Its words are coded in the alphabet of the test phrases; every other word is a
separator, because no phrase can span it. The shard's suffix array gives the Burrows-Wheeler
transform, a wavelet matrix over it answers ranks, backward search finds each phrase's suffix
range, and positions sampled from the suffix array locate the occurrences. Overlapping occurrences
merge into removal spans.

There is no shuffle: documents are indexed where they are scanned. Test phrases are broadcast, one
block of about ``block_words`` words at a time. A larger test set takes one pass over the documents
for each block, which carries the words hit so far along, so no worker ever holds more than a block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import col, drop_stash, giving_back, stash, table, without

#: Words are maximal runs of digits, a-z and bytes of non-ASCII characters, after A-Z is lowered.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
SAMPLE_EVERY = 8
HELD_ITEMS = 1 << 16  # names of items that rows hold before they are handed on


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class Phrases:
    """A block of test phrases: the vocabulary, the windows by length, and the owner set of each window.

    An owner set is all items that have the window; equal sets of several windows are one.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        self.vocab: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[int]] = {}
        for name, words in items:
            codes = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words]
            size = min(window, len(codes))
            for i in range(len(codes) - size + 1) if size else ():
                owners.setdefault(tuple(codes[i : i + size]), set()).add(number[name])
        sets: dict[tuple[int, ...], int] = {}
        self.by_length: list[tuple[np.ndarray, np.ndarray]] = []
        for size in sorted({len(w) for w in owners}):
            own = [(w, sets.setdefault(tuple(sorted(o)), len(sets))) for w, o in owners.items() if len(w) == size]
            self.by_length.append((np.array([w for w, _ in own], np.int64), np.array([o for _, o in own], np.int64)))
        self.owners = [[self.names[i] for i in o] for o in sets]
        self.shortest = min((w.shape[1] for w, _ in self.by_length), default=0)


class FMIndex:
    """Suffix order, wavelet matrix and sampled positions of a text of codes in which 0 separates."""

    def __init__(self, text: np.ndarray, sigma: int):
        n = self.n = len(text)
        order = suffix_array(text)
        before = text[order - 1]  # the text ends in a separator, so order 0 wraps to a separator
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])[:sigma]
        self.bits = max(1, int(sigma - 1).bit_length())
        self.zeros, self.ranks = [], []
        self.bwt = before
        level = before
        for b in range(self.bits - 1, -1, -1):
            ones = (level >> b) & 1
            self.ranks.append(np.concatenate([[0], np.cumsum(ones, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(n - int(self.ranks[-1][-1]))
            level = np.concatenate([level[ones == 0], level[ones == 1]])
        # sampled: every 8th position, and each one after a separator, so that no walk crosses one
        sampled = (order % SAMPLE_EVERY == 0) | (before == 0)
        self.sample_rank = np.concatenate([[0], np.cumsum(sampled)])
        self.sampled, self.samples = sampled, order[sampled]

    def rank(self, code: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often code stands before row upto of the transform."""
        low, high = np.zeros_like(upto), upto
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            one, r, z = ((code >> b) & 1).astype(bool), self.ranks[level], self.zeros[level]
            low = np.where(one, z + r[low], low - r[low])
            high = np.where(one, z + r[high], high - r[high])
        return high - low

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of phrases that occur, with their ranges in suffix order."""
        alive = np.arange(len(phrases))
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            code = phrases[alive, k]
            low, high = self.starts[code] + self.rank(code, low), self.starts[code] + self.rank(code, high)
            keep = low < high
            alive, low, high = alive[keep], low[keep], high[keep]
        return alive, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        found, at, steps = np.zeros(len(rows), np.int64), rows.copy(), np.zeros(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            done = self.sampled[at[open_]]
            i = open_[done]
            found[i] = self.samples[self.sample_rank[at[i]]] + steps[i]
            open_ = open_[~done]
            code = self.bwt[at[open_]]
            at[open_] = self.starts[code] + self.rank(code, at[open_])
            steps[open_] += 1
        return found


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Prefix doubling; a separator is unlike any other, so comparisons end at it."""
    n = len(text)
    rank = text.astype(np.int64)
    gaps = np.flatnonzero(text == 0)
    rank += len(gaps)
    rank[gaps] = np.arange(len(gaps))
    order = np.argsort(rank, kind="stable")
    width = 1
    key = rank[order]
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = key[1:] != key[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = first
    todo = np.flatnonzero(~(new & np.append(new[1:], True)))  # slots of groups not yet in order
    while len(todo):
        at = order[todo]
        head = rank[at]
        key = head * (n + 1) + np.where(at + width < n, rank[np.minimum(at + width, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[todo] = at
        new = np.empty(len(todo), bool)
        new[0] = True
        new[1:] = key[1:] != key[:-1]
        rank[at] = todo[np.maximum.accumulate(np.where(new, np.arange(len(todo)), 0))]
        todo = todo[~(new & np.append(new[1:], True))]
        width *= 2
    return order


class Shard:
    """Documents on their way into one index."""

    def __init__(self, phrases: Phrases):
        self.phrases, self.codes, self.sizes, self.symbols = phrases, [], [], 0
        self.runs: list[np.ndarray] = []

    def add(self, words: list[bytes]) -> None:
        codes = np.fromiter(map(self.phrases.vocab.get, words, repeat(0)), np.int64, len(words))
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (codes > 0).view(np.int8), [0]])))
        start, end = edge[::2], edge[1::2]
        long = end - start >= self.phrases.shortest
        start, end = start[long], end[long]
        base = sum(self.sizes[-1:])
        if len(start):
            keep = np.repeat(start - np.concatenate([[0], np.cumsum(end - start + 1)[:-1]]), end - start + 1)
            at = np.arange(len(keep)) + keep
            self.codes.append(np.append(codes, 0)[at])
            self.codes[-1][np.cumsum(end - start + 1) - 1] = 0
            self.runs.append(np.stack([start + base, end - start + 1]))
            self.symbols += len(at)
        self.sizes.append(base + len(words))

    def occurrences(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word positions (documents in a row), lengths and owner sets of all occurrences."""
        nothing = np.zeros(0, np.int64)
        if not self.codes:
            return nothing, nothing, nothing
        text, runs = np.concatenate(self.codes), np.concatenate(self.runs, axis=1)
        index = FMIndex(text, len(self.phrases.vocab) + 1)
        run_at = np.concatenate([[0], np.cumsum(runs[1])[:-1]])
        out = []
        for windows, owners in self.phrases.by_length:
            hit, low, high = index.search(windows)
            n = high - low
            rows = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else nothing
            at = index.locate(rows)
            run = np.searchsorted(run_at, at, "right") - 1
            at = runs[0][run] + at - run_at[run]
            out.append((at, np.full(len(at), windows.shape[1]), np.repeat(owners[hit], n)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _ranges(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))).tolist()
    return list(zip(edge[::2], edge[1::2], strict=True))


def _judge(texts: list[str | None], phrases: Phrases, hits: list | None, known: list | None) -> Iterator[tuple[int, np.ndarray, list[str]]]:
    """(n_words, mask of the words hit, items) of each document of one shard, in turn.

    hits and known are word ranges and items of earlier blocks. Occurrences are reduced to owner
    sets of documents before any item is looked up, so a phrase that many items share costs no more.
    """
    shard = Shard(phrases)
    for text in texts:
        shard.add(words_of(text))
    ends = np.array(shard.sizes, np.int64)
    upto = np.concatenate([[0], ends])
    total = int(upto[-1])
    at, size, owner = shard.occurrences()
    cover = np.bincount(at, minlength=total + 1) - np.bincount(at + size, minlength=total + 1)
    hit = np.cumsum(cover)[:total] > 0
    met = np.unique(np.searchsorted(ends, at, "right") * len(phrases.owners) + owner) if len(at) else at
    doc, owner = np.divmod(met, max(1, len(phrases.owners)))
    of = np.searchsorted(doc, np.arange(len(texts) + 1)).tolist()
    for d, own in enumerate(hits or ()):
        for r in own or ():
            hit[upto[d] + r["start"] : upto[d] + r["end"]] = True
    for d in range(len(texts)):
        items = set(known[d] or ()) if known else set()
        for o in owner[of[d] : of[d + 1]].tolist():
            items.update(phrases.owners[o])
        yield int(upto[d + 1] - upto[d]), hit[upto[d] : upto[d + 1]], sorted(items)


def _found(text: str | None, judged: tuple[int, np.ndarray, list[str]], clean: bool) -> tuple:
    """(n_words, n_hit, items, spans, clean text) of one document."""
    n_words, mask, items = judged
    n, spans, kept = int(mask.sum()), [], text
    if n:
        places = [m.span() for m in _WORD.finditer(text)]
        spans = [(places[a][0], places[b - 1][1]) for a, b in _ranges(mask)]
        if clean:
            cut = [0, *(x for s in spans for x in s), len(text)]
            kept = "".join(text[a:b] for a, b in zip(cut[::2], cut[1::2], strict=True))
    return n_words, n, items, [{"start": a, "end": b} for a, b in spans], kept


ADDS = {
    "n_words": (T.LongType(), pa.int64()),
    "n_hit": (T.LongType(), pa.int64()),
    "items": (T.ArrayType(T.StringType()), pa.list_(pa.string())),
    "spans": (T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    "clean_text": (T.StringType(), pa.string()),
}


def phrase_blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_words: int) -> Iterator[Phrases]:
    block, size = [], 0
    for item, text in benchmark.select(col(item_col).cast("string"), col(text_col).cast("string")).toLocalIterator():
        if words := words_of(text):
            block.append(("null" if item is None else item, words))
            size += len(words)
        if size >= block_words:
            yield Phrases(block, window)
            block, size = [], 0
    if block:
        yield Phrases(block, window)


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    clean: bool = True,
    shard_bytes: int = 1 << 23,
    block_words: int = 1 << 18,
) -> DataFrame:
    """Every row of docs with n_words, n_hit, items, spans and, if asked, clean_text.

    items: sorted ids of the items of which a window occurs; spans: code point ranges that merge all
    occurrences; clean_text: the text less its spans. A null or empty text has no words, no spans,
    and stays as it is; a null item id is named "null"; an item without words matches nothing; with
    an empty benchmark nothing is hit. Repeated rows each get their result. Columns of docs that
    have one of the added names are replaced. shard_bytes bounds the text of a shard (a
    longer document is a shard of its own).
    """
    spark = docs.sparkSession
    adds = {k: v for k, v in ADDS.items() if clean or k != "clean_text"}
    carried = {"_hits": ADDS["spans"], "_items": ADDS["items"]}
    rest = without(docs, {*adds, *carried} - {text_col})
    names = [f.name for f in rest.schema.fields if not (text_col in adds and f.name == text_col)]
    held, before = rest, False
    blocks = phrase_blocks(benchmark, item_col, item_text_col, window, block_words)
    block = next(blocks, None) or Phrases([], window)
    while True:
        following = next(blocks, None)
        sent, last = spark.sparkContext.broadcast(block), following is None
        fields = [held.schema[n] for n in (names if last else rest.columns)]
        schema = T.StructType([*fields, *(T.StructField(k, v[0]) for k, v in (adds if last else carried).items())])
        out = held.mapInArrow(giving_back(_pass(sent, text_col, [f.name for f in fields], adds if last else carried, before, last, clean, shard_bytes)), schema)
        if last:
            return out
        out = stash(out, "decontaminate")
        sent.destroy()
        if before:
            drop_stash(held)
        held, before, block = out, True, following


def _pass(sent, text_col: str, kept: list[str], adds: dict, before: bool, last: bool, clean: bool, shard_bytes: int):
    """One block of phrases over all documents: columns kept and added, shard by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = size = 0
            lengths = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_pylist()
            for i, n in enumerate([*lengths, None]):
                if i > start and (n is None or size + n > shard_bytes):
                    part = batch.slice(start, i - start)
                    texts = part.column(text_col).to_pylist()
                    hits, known = (part.column(c).to_pylist() if before else None for c in ("_hits", "_items"))
                    judged = zip(texts, _judge(texts, sent.value, hits, known), strict=True)
                    done, rows, held = 0, [], 0
                    for d, (text, (n_words, mask, items)) in enumerate(judged, 1):
                        rows.append(_found(text, (n_words, mask, items), clean) if last else ([{"start": a, "end": b} for a, b in _ranges(mask)], items))
                        held += len(items)
                        if held > HELD_ITEMS or d == len(texts):
                            arrays = [pa.array([r[k] for r in rows], v[1]) for k, v in enumerate(adds.values())]
                            some = part.slice(done, d - done)
                            yield pa.RecordBatch.from_arrays([*(some.column(c) for c in kept), *arrays], names=[*kept, *adds])
                            done, rows, held = d, [], 0
                    start, size = i, 0
                size += n or 0

    return run


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), clean=False)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
