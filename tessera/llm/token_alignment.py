"""Cross-tokenizer alignment: distinct segments are tokenised and aligned once, documents composed of these.

A text is cut before each run of white space that begins with a space and follows anything else. No token
can reach across such a cut: ``splitter`` makes sure from both vocabularies that no entry has a space
after something that is not white space, and that the tokenizers' other steps work inside such segments;
otherwise a text stays one segment. Documents become slices (see vocab_slices): each distinct segment of a
slice goes once to the bucket of its hash, where equal segments meet and are tokenised and aligned once,
and the alignment comes back to the slice, in which all documents are composed by counting.

An alignment is one list of both tokenizers' tokens by where they end. At each end one pair of tokens that
overlap is over, so the list holds all links as well; where both end, a group is cut.

Id pairs are counted over all documents and come back to slices: broadcast as long as all of them take
``PAIR_BYTES`` at most, else joined to each slice's own pairs.

Odd rows: null and empty texts, and texts that one of the tokenizers does not give back byte for byte, have
no tokens: zeros and an empty digest. Null or repeated ids and repeated rows are rows of their own, and
each counts as a document. Other columns play no part. A stretch without any cut is one segment, however
long it is.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, col, giving_back, stash, table
from tessera.llm.vocab_slices import ANSWERS, STRETCH, documents, joined, packed, parted, places, questions, summed, unpacked, vocab_slices, with_answers

PAIR_BYTES = 64 << 20
PAIR_WIDTH = 17
VOCABULARY = 1 << 16  # ids whose endings are made beforehand
TOGETHER = 4096  # segments that are tokenised at a time
#: Before a space, unless white space stands before it, or what some engine may take for it. Not before the
#: text's last character: the second tokenizer gives an empty string no space.
CUT = re.compile(r"(?<=[^\s\x85\u180e\u200b\ufeff])(?= (?!\Z))")
SPACED = re.compile(r"[\s\x85\u180e\u200b\ufeff] ")
OF_B, FINAL, ID = 1 << 30, 1 << 31, (1 << 30) - 1
UNLIKE = np.array([0xFFFFFFFF], np.uint32).tobytes()  # tokens that are not the text


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers from their files' contents, and the bytes of each id's token."""

    def __init__(self, a: str, b: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_str(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        letters = byte_level()
        entries = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.a_bytes[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.a_size = np.array([len(x) for x in self.a_bytes])
        self.b_size = np.array([len(x) for x in self.b_bytes])

    def codes(self, segments: list[bytes]) -> list[bytes]:
        """The alignment of each segment; a space comes before each, which the second tokenizer adds itself."""
        texts = [s.decode() for s in segments]
        a = [e.ids for e in self.a.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)]
        b = self.b.encode(texts, num_threads=1)
        same = [b"".join([self.a_bytes[i] for i in x]) == b" " + s == b"".join([self.b_bytes[i] for i in y]) for s, x, y in zip(segments, a, b)]
        a, b = [x for x, ok in zip(a, same) if ok], [y for y, ok in zip(b, same) if ok]
        counts = np.array([len(x) + len(y) for x, y in zip(a, b)], np.int64)
        a_ids, b_ids = (np.fromiter(itertools.chain.from_iterable(own), np.int64) for own in (a, b))
        ends = np.concatenate([np.cumsum(self.a_size[a_ids]), np.cumsum(self.b_size[b_ids])])
        order = np.argsort(ends, kind="stable")  # of equal ends, the first tokenizer's is first
        ends = ends[order]
        events = np.concatenate([a_ids, b_ids | OF_B])[order].astype(np.uint32)
        both = np.flatnonzero(ends[1:] == ends[:-1])
        events[both] |= FINAL
        events[both + 1] |= FINAL
        cuts = np.concatenate([[0], np.cumsum(counts)])
        aligned = (events[x:y].tobytes() for x, y in zip(cuts, cuts[1:]))
        return [next(aligned) if ok else UNLIKE for ok in same]


def splitter(a: str, b: bytes) -> Callable[[str], Iterator[list[bytes]]]:
    """Cuts texts where neither tokenizer can merge across, or not at all if that can't be told."""
    from sentencepiece import sentencepiece_model_pb2

    steps, own = json.loads(a), Tokenizers(a, b)
    safe = steps["normalizer"] is None and steps["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    model = sentencepiece_model_pb2.ModelProto.FromString(b)
    rules = model.normalizer_spec
    safe &= rules.name == "identity" and rules.add_dummy_prefix and rules.escape_whitespaces and not rules.remove_extra_whitespaces
    safe &= model.trainer_spec.model_type == model.trainer_spec.BPE and not model.trainer_spec.treat_whitespace_as_suffix
    for token in own.a_bytes + own.b_bytes:
        for at in [m.start() for m in re.finditer(b" ", token) if m.start()]:
            before = token[:at].decode(errors="replace")[-1]
            safe &= before.isspace()
    return cut_segments if safe else one_segment


def cut_segments(text: str) -> Iterator[list[bytes]]:
    """Segments less the space that each begins with; the first one's is the space before the text."""
    text = f" {text}" if text else ""
    a = 0
    while a < len(text):
        cut = CUT.search(text, a + STRETCH) if len(text) - a > STRETCH else None
        b = cut.start() if cut else len(text)
        part = text[a:b]
        if part.endswith(" ") or SPACED.search(part):
            yield [s[1:].encode() for s in CUT.split(part)]
        else:  # every space is a cut
            yield part[1:].encode().split(b" ")
        a = b


def one_segment(text: str) -> Iterator[list[bytes]]:
    yield [text.encode()] if text else []


def _tokenise(sent):
    """Packed alignments for packed segments; the distinct ones of a bucket are tokenised once."""

    @giving_back
    def run(batches):
        tokenizers, bucket, known = Tokenizers(*sent.value), None, {}
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                if row["bucket"] != bucket:
                    bucket, known = row["bucket"], {}
                words = parted(row["words"], row["sizes"])
                new = [w for w in words if w not in known]
                for a in range(0, len(new), TOGETHER):
                    known.update(zip(new[a : a + TOGETHER], tokenizers.codes(new[a : a + TOGETHER])))
                body, sizes = joined([known[w] for w in words])
                yield pa.RecordBatch.from_arrays([pa.array([row["slice"]]), pa.array([row["ats"]]), pa.array([body]), pa.array([sizes])], names=["slice", "ats", "body", "sizes"])

    return run


@functools.cache
def _endings(n: int) -> list[str]:
    """Each id with what can stand behind it."""
    return [f"{i}{after}" for i in range(n) for after in (",", "|", ";", "")]


def _following(mask: np.ndarray) -> np.ndarray:
    """The first index at or after each one where mask holds."""
    at = np.where(mask, np.arange(len(mask)), len(mask))
    return np.minimum.accumulate(at[::-1])[::-1]


class Aligned:
    """The alignments of a slice's words, in their order."""

    def __init__(self, found: list[dict]):
        parts = [(places(r["ats"]), parted(r["body"], r["sizes"])) for r in found]
        codes: list[bytes] = [b""] * sum(len(own) for _, own in parts)
        for ats, own in parts:
            for at, code in zip(ats.tolist(), own):
                codes[at] = code
        self.valid = np.array([c != UNLIKE for c in codes], bool)
        codes = [c if ok else b"" for c, ok in zip(codes, self.valid.tolist())]
        self.events = np.frombuffer(b"".join(codes), np.uint32)
        sizes = np.array([len(c) // 4 for c in codes], np.int64)
        self.cuts = np.concatenate([[0], np.cumsum(sizes)])
        of_b, final = (self.events & OF_B) > 0, (self.events & FINAL) > 0
        self.n_a, self.n_b, self.n_groups = (summed(x.astype(np.int64), self.cuts) for x in (~of_b, of_b, final & of_b))
        link = ~(final & of_b)  # the last pair of a group ends at two tokens
        ids = (self.events & ID).astype(np.int64)
        pairs = (ids[_following(~of_b)[link]] << 32) | ids[_following(of_b)[link]] if len(ids) else ids
        self.n_links = summed(link.astype(np.int64), self.cuts)
        self.pairs, self.links = np.unique(pairs, return_inverse=True)

    def texts(self) -> list[str]:
        """Each word's groups as a1,a2|b1;a3|b2,b3."""
        if not len(self.events):
            return [""] * len(self.valid)
        of_b, final = (self.events & OF_B) > 0, (self.events & FINAL) > 0
        group = np.concatenate([[0], np.cumsum(final & of_b)[:-1]])
        by = np.argsort(2 * group + of_b, kind="stable")  # words keep their places
        of_b, group = of_b[by], group[by]
        after = np.where(np.append(group[1:] != group[:-1], True), 2, np.where(np.append(of_b[1:] != of_b[:-1], False), 1, 0))
        after[self.cuts[1:][np.diff(self.cuts) > 0] - 1] = 3
        ids = (self.events[by] & ID).astype(np.int64)
        parts = list(map(_endings(int(ids.max()) + 1 if ids.max() >= VOCABULARY else VOCABULARY).__getitem__, (4 * ids + after).tolist()))
        cuts = self.cuts.tolist()
        return ["".join(parts[x:y]) for x, y in zip(cuts, cuts[1:])]


def spread(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """values[starts[i] : starts[i] + counts[i]] of all i, one after the other."""
    upto = np.cumsum(counts)
    return values[np.arange(upto[-1] if len(upto) else 0) + np.repeat(starts - (upto - counts), counts)]


def _compose(batches):
    """A slice's documents: all but what needs the pairs of the whole corpus, and the slice's own pairs."""
    for batch in batches:
        for i in range(batch.num_rows):
            part = batch.slice(i, 1)
            own = Aligned(part.column("found")[0].as_py())
            seq, starts = documents(part.column("seq")[0].as_py(), part.column("lengths")[0].as_py())
            counts = np.diff(starts)
            whole = summed((~own.valid[seq]).astype(np.int64), starts) == 0
            seq, counts = seq[np.repeat(whole, counts)].astype(np.int64), np.where(whole, counts, 0)
            starts = np.concatenate([[0], np.cumsum(counts)])
            texts, digests, listed = own.texts(), [], starts.tolist()
            for a, b in zip(listed, listed[1:]):
                digest = hashlib.sha256()
                for x in range(a, b, 1 << 16):
                    digest.update((";" * (x > a) + ";".join(map(texts.__getitem__, seq[x : min(b, x + (1 << 16))].tolist()))).encode())
                digests.append(digest.hexdigest() if b > a else "")
            # each pair once a document
            inside = np.unique((np.repeat(np.arange(len(counts)), counts) << 32) | seq)
            words = inside & 0xFFFFFFFF
            n = own.n_links[words]
            met = np.unique((np.repeat(inside >> 32, n) << 32) | spread(own.links, np.concatenate([[0], np.cumsum(own.n_links)])[words], n))
            n_docs = np.bincount(met & 0xFFFFFFFF, minlength=len(own.pairs))
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, pa.int64())) for x in (*(summed(x[seq], starts) for x in (own.n_a, own.n_b, own.n_groups, own.n_links)), own.pairs, n_docs)]
            binaries = [pa.array([x], pa.binary()) for x in (packed(seq.astype(np.uint32)), counts.astype(np.int64).tobytes(), packed(own.links.astype(np.uint32)), packed(own.n_links.astype(np.uint32)))]
            yield pa.RecordBatch.from_arrays([part.column("slice"), part.column("id"), pa.array([digests]), *lists, *binaries], names=["slice", "id", "digest", "n_a", "n_b", "n_groups", "n_links", "pairs", "n_docs", "seq", "lengths", "links", "word_links"])


def _finish(sent):
    """Documents with what the corpus tells of their pairs: from ``sent``, or from the slice's own answers."""

    @giving_back
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.slice(i, 1)
                pairs = part.column("pairs").flatten().to_numpy()
                if sent is None:
                    counts, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
                    found = part.column("found").flatten()
                    at = found.field("at").to_numpy()
                    counts[at], best[at] = found.field("n").to_numpy(), found.field("best").to_numpy(zero_copy_only=False)
                else:
                    keys, counts, best = sent.value
                    at = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)  # a pair of texts without tokens has no key
                    counts, best = (counts[at], best[at]) if len(keys) else (np.zeros(len(pairs)), np.zeros(len(pairs)))
                word_links = unpacked(part.column("word_links")[0].as_py()).astype(np.int64)
                links = unpacked(part.column("links")[0].as_py()).astype(np.int64)
                cuts = np.concatenate([[0], np.cumsum(word_links)])
                seq, starts = documents(part.column("seq")[0].as_py(), part.column("lengths")[0].as_py())
                told = [pa.array(summed(summed(x.astype(np.int64)[links], cuts)[seq], starts)) for x in (best, counts)]
                plain = [part.column(x).flatten() for x in ("id", "n_a", "n_b", "n_groups", "n_links")]
                yield pa.RecordBatch.from_arrays([*plain, *told, part.column("digest").flatten()], names=["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return run


def pair_counts(composed: DataFrame) -> DataFrame:
    """pair, n (documents that hold it), best (no pair of the same first id is in more), written down."""
    pairs = composed.select(F.explode(F.arrays_zip("pairs", "n_docs")).alias("own")).where("own.n_docs > 0")
    counts = pairs.groupBy(F.col("own.pairs").alias("pair")).agg(F.sum("own.n_docs").alias("n"))
    of_a = Window.partitionBy(F.shiftright("pair", 32))  # as many rows as the other vocabulary has at most
    return stash(counts.withColumn("best", F.col("n") == F.max("n").over(of_a)), "alignment-pairs")


def align(docs: DataFrame, a: str, b: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row.

    a: contents of a tokenizers file of byte-level BPE, b: of a sentencepiece model with byte fallback.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    sent = spark.sparkContext.broadcast((a, b))
    sliced = vocab_slices(docs, col(text_col), {"id": col(id_col)}, splitter(a, b), "alignment-segments")
    codes = questions(sliced.select("slice", "words")).mapInArrow(_tokenise(sent), ANSWERS)
    both = with_answers(sliced.select("slice", "seq", "lengths", "id"), codes)
    kind = docs.select(col(id_col)).schema[0].dataType.simpleString()
    lists = "n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, pairs array<long>, n_docs array<long>"
    composed = stash(both.mapInArrow(_compose, f"slice long, id array<{kind}>, digest array<string>, {lists}, seq binary, lengths binary, links binary, word_links binary"), "alignment-slices", compression="zstd")

    counts = pair_counts(composed)
    final = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    rows = composed.drop("slice", "n_docs")
    if counts.count() * PAIR_WIDTH <= PAIR_BYTES:
        found = counts.toArrow().sort_by("pair")
        return rows.mapInArrow(_finish(spark.sparkContext.broadcast(tuple(found[x].to_numpy() for x in ("pair", "n", "best")))), final)
    own = composed.select("slice", F.posexplode("pairs").alias("at", "pair"))
    # pairs that only texts without tokens have are in no document
    told = own.join(counts, "pair").groupBy("slice").agg(F.collect_list(F.struct("at", "n", "best")).alias("found"))
    both = composed.drop("n_docs").join(told, "slice", "left")
    return both.withColumn("found", F.coalesce("found", F.array().cast(both.schema["found"].dataType))).drop("slice").mapInArrow(_finish(None), final)


def op13_segment_alignment(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """A row for each document. folder: of the tokenizers' files, the installed ones by default."""
    if folder is None:
        import public_tokenizers

        folder = os.path.dirname(public_tokenizers.path("byte_bpe_50k.json"))
    with open(f"{folder}/byte_bpe_50k.json", encoding="utf-8") as f:
        a = f.read()
    with open(f"{folder}/piece_bpe_32k.model", "rb") as f:
        b = f.read()
    return align(table(spark, sf_dir, "documents"), a, b).withColumnRenamed("id", "doc_id")
