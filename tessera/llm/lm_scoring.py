"""Language-model scoring with a log-frequency Bloom filter of n-gram counts.

A count is quantised on a logarithmic scale to a level q, and its n-gram is put into a Bloom filter once
for each level from 1 to q. A count is read back by asking for level 1, 2, ... until the filter says no.
Probabilities of words in their context come from such counts of all orders, smoothed order by order:

    p(w | h) = (count(h w) + MASS p(w | shorter h)) / (count(h) + MASS)

and, at the lowest order, (count(w) + 1) / (N + V + 1). A document ends with an end token, which is also
the context of the next one's first word. An n-gram counts as seen only where its parts are seen, and no
more often than its context, which undoes most false positives.

The filter is made of segments by hash, each built by one task from the n-grams that fall into it and as
large as their levels need, so it grows with the text it was trained on and its error rate does not. It
goes to the workers in blocks of ``FILTER_BLOCK`` bytes at most, one after the other; each further block
takes another pass over the slices, with the levels found so far beside them.

``base_score`` needs exact counts of words: slices of documents (see vocab_slices) send what they have of
each word to its bucket, where it is added up, and get the sum back. Nothing here reaches the driver but
totals and one block of the filter.

Odd rows: a null, empty or blank text is its end token alone. Null or repeated ids and repeated rows are
scored (and learned from) as they are; a null id hashes as the empty text does. Without training texts
every score is that of the formulas with N = V = 0. Other columns play no part.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, col, drop_stash, giving_back, stash, table
from tessera.llm.vocab_slices import ANSWERS, STRETCH, documents, packed, parted, questions, unpacked, vocab_slices, with_answers
from tessera.llm.vocab_slices import places as word_places

ORDER = 2
BASE = 1.5  # of the levels
HASHES = 6
MASS = 16.0
SEGMENT = 1 << 20  # n-grams of a segment, if all were different
FILTER_BLOCK = 128 << 20
LEVELS = 255
SPACE = re.compile(rb"[\x20\x09-\x0d]")
LOW = np.uint64(0xFFFFFFFF)
HALF = np.uint64(32)
END_HASH = np.uint64(xxhash.xxh64_intdigest(b" "))  # no word has a space


def split_words(text: str) -> Iterator[list[bytes]]:
    """Words between white space, A-Z in lower case, a stretch at a time."""
    data = text.encode().lower()
    a = 0
    while a < len(data):
        cut = SPACE.search(data, a + STRETCH) if len(data) - a > STRETCH else None
        b = cut.start() if cut else len(data)
        yield data[a:b].split()
        a = b


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of pairs of hashes."""
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ b
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def level_of(counts: np.ndarray) -> np.ndarray:
    return np.minimum(1 + np.floor(np.log(counts) / math.log(BASE) + 1e-9), LEVELS).astype(np.int64)


def _middle(q: int) -> float:
    """The middle of the counts at level q."""
    least, most = math.ceil(BASE ** (q - 1) - 1e-9), math.ceil(BASE**q - 1e-9) - 1
    return (least + max(most, least)) / 2


#: The count that a level stands for.
COUNT_OF = np.array([0.0] + [_middle(q) for q in range(1, LEVELS + 1)])


def grams(hashes: np.ndarray, seq: np.ndarray, starts: np.ndarray, order: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For each order: the number of the n-gram that ends at each token (-1: none), and hashes by number.

    Also where each document's tokens start. The last of hashes is the end token's.
    """
    end, n_docs = len(hashes) - 1, len(starts) - 1
    begins = starts[:-1] + np.arange(n_docs)
    token = np.full(len(seq) + n_docs, end, np.int64)
    words = np.ones(len(token), bool)
    words[starts[1:] + np.arange(n_docs)] = False
    token[words] = seq
    ids, known = [token], [hashes]
    if order > 2:
        since = np.arange(len(token)) - np.repeat(begins, np.diff(np.append(begins, len(token))))
    for n in range(2, order + 1):
        before = np.concatenate([[end], ids[-1][:-1]])
        key = (before << 32) | token
        if n == 2:
            found, own = np.unique(key, return_inverse=True)
        else:  # inside a document; a shorter context serves at its start
            inside = since >= n - 2
            found, some = np.unique(key[inside], return_inverse=True)
            own = np.full(len(token), -1)
            own[inside] = some
        ids.append(own)
        known.append(mix(known[-1][found >> 32], hashes[found & 0xFFFFFFFF]))
    return ids, known, begins


def _hashes(words: list[bytes]) -> np.ndarray:
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    out[-1] = END_HASH
    return out


def _trained(seq: np.ndarray, starts: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """seq and starts of the training documents alone."""
    counts = np.diff(starts)
    return seq[np.repeat(train, counts)], np.concatenate([[0], np.cumsum(counts[train])])


def _occurrences(row: dict) -> np.ndarray:
    """The training occurrences of each word of a slice."""
    seq, _ = _trained(*documents(row["seq"], row["lengths"]), np.array(row["train"], bool))
    return np.bincount(seq, minlength=len(row["words"]))


@giving_back
def _add_up(batches):
    """What all slices have of each word, back to the slices; of each bucket also (slice -1) total and number."""
    bucket, held = None, []

    def told():
        counts: dict[bytes, int] = {}
        for r in held:
            for word, n in zip(parted(r["words"], r["sizes"]), unpacked(r["weights"]).tolist()):
                counts[word] = counts.get(word, 0) + n
        seen = [n for n in counts.values() if n]
        rows = [{"slice": -1, "ats": b"", "body": packed(np.array([sum(seen), len(seen)], np.int64)), "sizes": b""}]
        for r in held:
            words = parted(r["words"], r["sizes"])
            rows.append({"slice": r["slice"], "ats": r["ats"], "body": packed(np.fromiter(map(counts.__getitem__, words), np.int64, len(words))), "sizes": b""})
        return pa.RecordBatch.from_pylist(rows, schema=pa.schema([("slice", pa.int64()), ("ats", pa.binary()), ("body", pa.binary()), ("sizes", pa.binary())]))

    for batch in batches:
        for row in batch.to_pylist():
            if held and row["bucket"] != bucket:
                yield told()
                held = []
            bucket = row["bucket"]
            held.append(row)
    if held:
        yield told()


def _ngram_counts(order: int, segments: int):
    """Packed n-grams of each slice's training documents, by segment: keys and counts, both u32."""

    @giving_back
    def run(batches):
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                seq, starts = _trained(*documents(row["seq"], row["lengths"]), np.array(row["train"], bool))
                if len(starts) == 1:
                    continue
                ids, known, _ = grams(_hashes(row["words"]), seq, starts, order)
                counts = [np.bincount(own[own >= 0], minlength=len(h)) for own, h in zip(ids, known)]
                hashes, counts = np.concatenate(known), np.concatenate(counts)
                hashes, counts = hashes[counts > 0], counts[counts > 0]
                segment = (hashes >> HALF) % np.uint64(segments)
                by = np.argsort(segment, kind="stable")
                keys, counts, segment = (hashes & LOW).astype(np.uint32)[by], counts.astype(np.uint32)[by], segment[by].astype(np.int64)
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(segment)) + 1, [len(segment)]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(segment[cuts[:-1]]), pa.array([keys[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()), pa.array([counts[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())],
                    names=["segment", "keys", "counts"],
                )

    return run


def places(keys: np.ndarray, level: int | np.ndarray, size: np.ndarray | int) -> Iterator[np.ndarray]:
    """The HASHES bits of (key, level) in a segment of so many bits."""
    x = mix(keys, np.asarray(level, np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))
    one, two = x & LOW, (x >> HALF) | np.uint64(1)
    for i in range(HASHES):
        yield (((one + np.uint64(i) * two) & LOW) * np.asarray(size, np.uint64)) >> HALF


def segment_bits(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The filter of one segment, as large as its levels need for half of the bits to be set."""
    keys, own = np.unique(keys, return_inverse=True)
    levels = level_of(np.bincount(own, weights=counts))
    size = -(-math.ceil(int(levels.sum()) * HASHES / math.log(2)) // 64) * 64
    bits = np.zeros(size, bool)
    keys = keys.astype(np.uint64)
    for q in range(1, int(levels.max()) + 1):
        for at in places(keys[levels >= q], q, size):
            bits[at] = True
    return np.packbits(bits, bitorder="little")


@giving_back
def _build(batches):
    parts: dict[int, tuple[list[bytes], list[bytes]]] = {}
    for batch in batches:
        for s, k, c in zip(*[batch.column(n).to_pylist() for n in ("segment", "keys", "counts")]):
            own = parts.setdefault(s, ([], []))
            own[0].append(k)
            own[1].append(c)
    for s in list(parts):
        keys, counts = parts.pop(s)
        bits = segment_bits(np.frombuffer(b"".join(keys), np.uint32), np.frombuffer(b"".join(counts), np.uint32))
        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([bits.tobytes()], pa.binary())], names=["segment", "bits"])


class Block:
    """Some segments of the filter, end to end."""

    def __init__(self, rows: Iterable, sizes: dict[int, int], segments: int):
        """rows: segment and bits of the segments in sizes, which has their bytes."""
        self.segments = segments
        self.at, self.size = np.zeros(segments, np.uint64), np.zeros(segments, np.uint64)
        upto = 0
        for s, n in sizes.items():
            self.at[s], self.size[s] = 8 * upto, 8 * n
            upto += n
        self.bits = np.empty(upto, np.uint8)
        for r in rows:
            at = int(self.at[r["segment"]]) // 8
            self.bits[at : at + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        """How many levels of each n-gram are members, from the first on; 0 where the segment is elsewhere."""
        segment = ((hashes >> HALF) % np.uint64(self.segments)).astype(np.int64)
        out = np.zeros(len(hashes), np.uint8)
        left = np.flatnonzero(self.size[segment] > 0)
        for q in range(1, LEVELS + 1):
            if not len(left):
                break
            own = segment[left]
            keys, size, at = hashes[left] & LOW, self.size[own], self.at[own]
            hit = np.ones(len(left), bool)
            for place in places(keys, q, size):
                bit = at + place
                hit &= ((self.bits[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
            left = left[hit]
            out[left] = q
        return out


def _probe(block, order: int):
    """Slices with the levels of their n-grams as far as this block has them."""

    @giving_back
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.slice(i, 1)
                row = part.select(["words", "seq", "lengths", "levels"]).to_pylist()[0]
                _, known, _ = grams(_hashes(row["words"]), *documents(row["seq"], row["lengths"]), order)
                levels = np.maximum(block.value.levels(np.concatenate(known)), np.frombuffer(row["levels"], np.uint8) if row["levels"] else 0)
                yield part.set_column(part.schema.get_field_index("levels"), "levels", pa.array([levels.tobytes()], pa.binary()))

    return run


def _score(block, order: int, n_train: int, n_words: int, id_type: pa.DataType):
    """Scores of the documents of slices; the block is the last one."""

    @giving_back
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.select(["words", "seq", "lengths", "levels"]).slice(i, 1).to_pylist()[0]
                hashes = _hashes(row["words"])
                ids, known, begins = grams(hashes, *documents(row["seq"], row["lengths"]), order)
                levels = block.value.levels(np.concatenate(known))
                if row["levels"]:
                    levels = np.maximum(levels, np.frombuffer(row["levels"], np.uint8))
                counts = np.split(COUNT_OF[levels], np.cumsum([len(h) for h in known])[:-1])

                exact = np.zeros(len(hashes))
                for r in batch.column("found")[i].as_py():
                    exact[word_places(r["ats"])] = unpacked(r["body"], np.int64)
                exact[-1] = batch.column("ends")[i].as_py()
                base = np.log10(exact + 1) - math.log10(n_train + n_words + 1)

                own = counts[0][ids[0]]
                p = (own + 1) / (n_train + n_words + 1)
                for n in range(1, order):
                    context = np.concatenate([counts[0][-1:], own[:-1]])
                    inside = ids[n] >= 0
                    seen = np.where(inside & (own > 0), counts[n][ids[n]], 0.0)
                    own = np.minimum(seen, context)
                    p = np.where(inside, (own + MASS * p) / (context + MASS), p)
                columns = [np.add.reduceat(x, begins) for x in (np.ones(len(p), np.int64), (exact > 0)[ids[0]].astype(np.int64), base[ids[0]], np.log10(p))]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, 1).flatten().cast(id_type), batch.column("train").slice(i, 1).flatten(), *map(pa.array, columns)], names=["id", "train", "n_tokens", "n_known", "base_score", "score"])

    return run


def score_texts(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """id, trained, n_tokens, n_known, train_tokens, base_score, score of each row; learned where train is true."""
    spark = docs.sparkSession
    bound_batches(spark)
    sliced = vocab_slices(docs, col(text_col), {"id": col(id_col), "train": F.coalesce(train, F.lit(False))}, split_words, "lm-slices")
    counts = stash(questions(sliced.select("slice", "words", "seq", "lengths", "train"), _occurrences).mapInArrow(_add_up, ANSWERS), "lm-words", compression="zstd")
    total = np.array([unpacked(r.body, np.int64) for r in counts.where("slice = -1").select("body").toLocalIterator()]).reshape(-1, 2).sum(axis=0).tolist()
    ends = sliced.agg(F.coalesce(F.sum(F.size(F.filter("train", lambda t: t))), F.lit(0))).first()[0]
    n_train, n_words = total[0] + ends, total[1] + (ends > 0)

    segments = max(8, -(-n_train * order // SEGMENT))
    packed = sliced.select("words", "seq", "lengths", "train").mapInArrow(_ngram_counts(order, segments), "segment long, keys binary, counts binary")
    filters = stash(packed.repartition(segments, "segment").mapInArrow(_build, "segment long, bits binary"), "lm-filter")
    blocks: list[dict[int, int]] = [{}]
    for r in filters.select("segment", F.length("bits").alias("size")).orderBy("segment").collect():
        if blocks[-1] and sum(blocks[-1].values()) + r["size"] > FILTER_BLOCK:
            blocks.append({})
        blocks[-1][r["segment"]] = r["size"]

    def sent(block: dict[int, int]):
        rows = filters.where(F.col("segment").between(min(block), max(block))).toLocalIterator() if block else []
        return spark.sparkContext.broadcast(Block(rows, block, segments))

    probed = sliced.withColumn("levels", F.lit(None).cast("binary"))
    for k, block in enumerate(blocks[:-1]):
        former, probed = probed, stash(probed.mapInArrow(_probe(sent(block), order), probed.schema), "lm-levels")
        if k:
            drop_stash(former)

    both = with_answers(probed, counts.where("slice >= 0")).withColumn("ends", F.lit(ends).cast("long"))
    kind = docs.select(col(id_col)).schema[0].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    scored = both.select("id", "train", "words", "seq", "lengths", "levels", "found", "ends").mapInArrow(
        _score(sent(blocks[-1]), order, n_train, n_words, to_arrow_type(kind)), f"id {kind.simpleString()}, train boolean, n_tokens long, n_known long, base_score double, score double"
    )
    drop_stash(filters)
    return scored.select("id", F.col("train").alias("trained"), "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")


def op12_log_frequency_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document, by a model of those whose hashed id does not leave 2 of 7."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % 7 == 2
    scored = score_texts(table(spark, sf_dir, "documents"), ~held_out)
    return scored.select(F.col("id").alias("doc_id"), (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
