"""Texts as runs of words: slices of documents, each with its own list of distinct words.

A slice holds some documents in the order they are read, of about ``SLICE`` bytes of text; a longer
document is a slice of its own. One row has its distinct words once, and each document as numbers into
these. A word that is in every document so meets the corpus once a slice and not once a document.

What the corpus knows of words is asked for by bucket, a hash of the word: each slice sends one packed row
to each bucket that it has words of, equal words meet in the one task that has their bucket, and answers
come back packed as well. Buckets grow in number with the words, so a task's share stays bounded; a word
that is in every slice adds one entry a slice to its bucket. Slices are written down, so that their
numbers stay the same whatever is run again.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import col, giving_back, slices, stash

SLICE = 4 << 20
BUCKET = 400_000  # words of all slices in a bucket
STRETCH = 1 << 20  # characters of a text that are split at a time


def _encode(split: Callable[[str], Iterator[list[bytes]]], kept: Sequence[str], fields: list[pa.Field]):
    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        numbers = itertools.count()

        def fresh():
            return defaultdict(itertools.count().__next__), [], [], [[] for _ in kept], 0

        def row():
            words = list(vocab)
            values = [task + next(numbers), words, packed(np.concatenate(runs) if runs else np.zeros(0, np.uint32)), np.array(lengths, np.int64).tobytes(), *columns]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, fields)], schema=pa.schema(fields))

        vocab, runs, lengths, columns, size = fresh()
        for batch in slices(batches, size=STRETCH):
            texts = batch.column("_text")
            for i, values in enumerate(zip(*[batch.column(f"_{k}").to_pylist() for k in range(len(kept))])):
                text = texts[i].as_py() or ""
                if lengths and size + len(text) > SLICE:
                    yield row()
                    vocab, runs, lengths, columns, size = fresh()
                n = 0
                for words in split(text):
                    runs.append(np.fromiter(map(vocab.__getitem__, words), np.uint32, len(words)))
                    n += len(words)
                lengths.append(n)
                size += len(text)
                for column, value in zip(columns, values):
                    column.append(value)
        if lengths:
            yield row()

    return run


def vocab_slices(docs: DataFrame, text: F.Column, kept: dict[str, F.Column], split: Callable[[str], Iterator[list[bytes]]], tag: str) -> DataFrame:
    """Written rows slice, words, seq and lengths (see documents()), and a list for each of kept."""
    rows = docs.select(text.alias("_text"), *[c.alias(f"_{k}") for k, c in enumerate(kept.values())])
    kinds = [rows.schema[f"_{k}"].dataType.simpleString() for k in range(len(kept))]
    schema = "slice long, words array<binary>, seq binary, lengths binary" + "".join(f", {n} array<{k}>" for n, k in zip(kept, kinds))
    empty = docs.sparkSession.createDataFrame([], schema)
    arrow = [pa.field("slice", pa.int64()), pa.field("words", pa.list_(pa.binary())), pa.field("seq", pa.binary()), pa.field("lengths", pa.binary())]
    arrow += [pa.field(n, pa.list_(_arrow(empty.schema[n].dataType.elementType))) for n in kept]
    return stash(rows.mapInArrow(_encode(split, list(kept), arrow), schema), tag, compression="zstd")


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def packed(values: np.ndarray | bytes) -> bytes:
    """Compressed, with the plain size before it."""
    data = values if isinstance(values, bytes) else np.ascontiguousarray(values).tobytes()
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unpacked(data: bytes, kind: type = np.uint32) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], size, codec="zstd", asbytes=True) if size else b"", kind)


def documents(seq: bytes, lengths: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words of a slice, and where each document's start; the last entry is the end."""
    counts = np.frombuffer(lengths, np.int64)
    return unpacked(seq), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def summed(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of values over each document."""
    upto = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return upto[starts[1:]] - upto[starts[:-1]]


def joined(values: list[bytes]) -> tuple[bytes, bytes]:
    """All values end to end, and their sizes."""
    return packed(b"".join(values)), packed(np.fromiter(map(len, values), np.uint32, len(values)))


def parted(data: bytes, sizes: bytes) -> list[bytes]:
    whole = unpacked(data, np.uint8).tobytes()
    cuts = np.concatenate([[0], np.cumsum(unpacked(sizes), dtype=np.int64)]).tolist()
    return [whole[a:b] for a, b in zip(cuts, cuts[1:])]


def places(ats: bytes) -> np.ndarray:
    """Where in its slice each of a packed row's words stands."""
    return np.cumsum(unpacked(ats), dtype=np.int64)


QUESTIONS = "bucket int, slice long, ats binary, words binary, sizes binary, weights binary"
ANSWERS = "slice long, ats binary, body binary, sizes binary"


def questions(sliced: DataFrame, weigh: Callable[[dict], np.ndarray] | None = None) -> DataFrame:
    """Packed rows of all words with their places in slices, each bucket in one task, one after the other.

    weigh gives a u32 beside each word of a slice's row (as a dict of its columns).
    """
    total = sliced.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    buckets = max(8, -(-total // BUCKET))

    @giving_back
    def run(batches):
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                words = row["words"]
                if not words:
                    continue
                weights = weigh(row) if weigh else None
                bucket = (np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) % np.uint64(buckets)).astype(np.int32)
                by = np.argsort(bucket, kind="stable")
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket[by])) + 1, [len(by)]])
                parts = [by[a:b] for a, b in zip(cuts, cuts[1:])]
                bodies = [joined([words[k] for k in part.tolist()]) for part in parts]
                columns = [bucket[by[cuts[:-1]]], [row["slice"]] * len(parts), [packed(np.diff(p, prepend=0).astype(np.uint32)) for p in parts], [b for b, _ in bodies], [s for _, s in bodies], [packed(weights[p].astype(np.uint32)) if weigh else None for p in parts]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), *[pa.binary()] * 4))], names=["bucket", "slice", "ats", "words", "sizes", "weights"])

    return sliced.mapInArrow(run, QUESTIONS).repartition(buckets, "bucket").sortWithinPartitions("bucket")


def answers(found: DataFrame) -> DataFrame:
    """One row a slice: found, the packed answers of all buckets to it."""
    return found.groupBy("slice").agg(F.collect_list(F.struct("ats", "body", "sizes")).alias("found"))


def with_answers(sliced: DataFrame, found: DataFrame) -> DataFrame:
    both = sliced.join(answers(found), "slice", "left")
    return both.withColumn("found", F.coalesce("found", F.array().cast(both.schema["found"].dataType)))
