"""Language identification of words, spans and documents.

Each word is scored by byte n-grams (1 to 4, with the word's ends) under every language's smoothed
counts. The script of a word leaves only the languages that are written in it. Viterbi decoding with
a switching penalty then labels the words, so single odd words do not break a span while a longer
passage in another language does.

Counting is a sum over all labelled texts: every task counts its own into ``BUCKETS`` hashed n-grams
per language, one aggregation adds them up, and a task for each language turns them into
log-probabilities. The model has ``BUCKETS`` numbers per language (256 kB), whatever the number of
texts; that is what the driver gets and broadcasts.

A text longer than a slice is read in stretches. Viterbi goes over them forwards, keeps its values at
the start of each, and then backwards, decoding one stretch again at a time, so what is held does not
grow with the text.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import col, give_back, giving_back, slices, table, without

BUCKETS = 1 << 16
HELD_LANGS = 64  # whose counts a task holds before it hands them on
SLICE = 1 << 21  # bytes of text that are coded at a time
STRETCH = 1 << 19  # bytes of a longer text that are coded at a time
FEW = 8  # languages; with more, slices and stretches get smaller in proportion
UND = "und"
#: Beyond ASCII, all but letters and their marks parts words: quotes, dashes, digits, symbols, emoji.
_SYMBOLS = regex.compile(r"[^\x00-\x7F\p{L}\p{M}]+")
#: Bytes of words: ASCII letters and, once symbols are gone, everything beyond ASCII.
_LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
LONGEST = 48  # bytes; longer runs, as in scripts without spaces, are cut
#: First code points of script blocks, in order, and the script from there on.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0900, "Devanagari"),
    (0x0980, "Bengali"), (0x0A00, "Indic"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"),
    (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Latin"), (0x2E80, "Han"), (0x3040, "Kana"), (0x3100, "Han"), (0x3130, "Hangul"), (0x3400, "Han"),
    (0xAC00, "Hangul"), (0xD7B0, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Kana"), (0x10000, "Other"),
    (0x20000, "Han"), (0x32000, "Other"),
)
_SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})


_STARTS = [start for start, _ in SCRIPTS]


@lru_cache(1 << 16)
def _script(char: str) -> int:
    return _SCRIPT_NAMES.index(SCRIPTS[bisect(_STARTS, ord(char)) - 1][1])


_LATIN = _script("a")


def script_of(word: str) -> int:
    """The script of most of a word's letters, the first by name where two have as many."""
    if word.isascii() or max(word) < "\u0370":  # all Latin
        return _LATIN
    count = Counter(map(_script, word))
    return max(sorted(count), key=count.get)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def room(size: int, langs: int) -> int:
    return max(1 << 12, size * FEW // max(FEW, langs))


def stretches(text: pa.Buffer, size: int = STRETCH) -> list[tuple[int, int]]:
    """Byte ranges of a text, cut before a space or line end; a longer run without one is cut between code points."""
    data, cuts = memoryview(text), [0]
    while len(data) - cuts[-1] > size:
        own = bytes(data[cuts[-1] : cuts[-1] + size])
        cut = max(own.rfind(b" "), own.rfind(b"\n"))
        if cut <= 0:
            cut = size
            while data[cuts[-1] + cut] & 0xC0 == 0x80:
                cut -= 1
        cuts.append(cuts[-1] + cut)
    return list(zip(cuts, [*cuts[1:], len(data)], strict=True))


def stretch_at(text: pa.Buffer, at: tuple[int, int]) -> str:
    return bytes(memoryview(text)[at[0] : at[1]]).decode("utf-8", "replace")


class Words:
    """The words of a batch of texts: distinct ones, and which of them each text has in order."""

    def __init__(self, texts: list[str | None]):
        # NFC, so that a letter has the same bytes however it was typed
        plain = [(t.lower() if t.isascii() else _SYMBOLS.sub(" ", unicodedata.normalize("NFC", t).lower())).encode("utf-8", "replace").translate(_LETTERS) if t else b"" for t in texts]
        lists = pc.ascii_split_whitespace(pa.array(plain, pa.large_binary()).cast(pa.large_string()))
        coded = lists.flatten().dictionary_encode()
        self.distinct: list[str] = coded.dictionary.to_pylist()
        ids = coded.indices.to_numpy().astype(np.int64)
        filled = np.array([bool(w) for w in self.distinct] or [False])[ids] if len(ids) else np.zeros(0, bool)
        upto = np.concatenate([[0], np.cumsum(filled)])
        offsets = lists.offsets.to_numpy()
        self.offsets = upto[offsets - offsets[0]]
        self.ids = ids[filled]
        self._cut_long()
        joined = (" " + " ".join(self.distinct) + " ").encode()
        self.bytes = np.frombuffer(joined, np.uint8).astype(np.uint32)
        self.owner = np.cumsum(self.bytes == 32) - 1
        self.scripts = np.array([script_of(w) for w in self.distinct] or [0], np.int64)

    def _cut_long(self) -> None:
        long = {i: [w[k : k + LONGEST // 4] for k in range(0, len(w), LONGEST // 4)] for i, w in enumerate(self.distinct) if len(w.encode()) > LONGEST}
        if not long:
            return
        pieces = {i: range(len(self.distinct) + k, len(self.distinct) + k + len(p)) for k, (i, p) in zip(np.cumsum([0] + [len(p) for p in long.values()]).tolist(), long.items(), strict=False)}
        self.distinct += [x for p in long.values() for x in p]
        n = np.ones(len(self.distinct), np.int64)
        for i, p in long.items():
            n[i] = len(p)
        times = n[self.ids]
        upto = np.concatenate([[0], np.cumsum(times)])
        whole = np.repeat(self.ids, times)
        at = np.arange(upto[-1]) - np.repeat(upto[:-1], times)
        first = np.full(len(self.distinct), -1, np.int64)
        for i, p in pieces.items():
            first[i] = p.start
        self.ids = np.where(first[whole] >= 0, first[whole] + at, whole)
        self.offsets = upto[self.offsets]

    def grams(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word, bucket) arrays of the n-grams of all distinct words, for n from 1 to 4."""
        b, space = self.bytes, self.bytes == 32
        for n in range(1, 5):
            last = max(0, len(b) - n + 1)
            code = np.zeros(last, np.uint32)
            good = ~space[:last] if n == 1 else np.ones(last, bool)
            for k in range(n):
                code = (code << np.uint32(8)) | b[k : last + k]
                if 0 < k < n - 1:
                    good &= ~space[k : last + k]
            if n == 2:
                good &= ~(space[:last] & space[1 : last + 1])
            with np.errstate(over="ignore"):
                bucket = ((code ^ np.uint32(n * 0x01000193)) * np.uint32(2654435761)) >> np.uint32(16)
            yield self.owner[:last][good], bucket[good].astype(np.int64)


def count_ngrams(labelled: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all rows of (lang, text); buckets from BUCKETS on count letters by script."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, n in counts.items():
                used = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(n[used].astype(np.int64))], names=["lang", "bucket", "n"])
            counts.clear()

        def coded() -> Iterator[tuple[list[str], Words]]:
            for batch in slices(batches, size=SLICE):
                langs, first = batch.column(0).to_pylist(), batch.column(1)[0].as_buffer()
                if len(first) > SLICE:  # a slice of its own
                    yield from ((langs, Words([stretch_at(first, at)])) for at in stretches(first))
                else:
                    yield langs, Words(batch.column(1).to_pylist())

        for langs, words in coded():
            names = sorted(set(langs))
            lang_of = np.repeat(np.array([names.index(x) for x in langs], np.int64), np.diff(words.offsets))
            times = np.bincount(words.ids * len(names) + lang_of, minlength=len(words.distinct) * len(names)).reshape(-1, len(names)).astype(np.float64)
            grams = list(words.grams())
            size = np.array([len(w) for w in words.distinct] or [0])
            for k, lang in enumerate(names):
                own = counts.setdefault(lang, np.zeros(BUCKETS + len(_SCRIPT_NAMES)))
                for word, bucket in grams:
                    own[:BUCKETS] += np.bincount(bucket, times[word, k], BUCKETS)
                if len(times):
                    own[BUCKETS:] += np.bincount(words.scripts, times[:, k] * size, len(_SCRIPT_NAMES))
            if len(counts) > HELD_LANGS:
                yield from flush()
        yield from flush()

    return labelled.mapInArrow(giving_back(run), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def _pack(counts: pa.Table) -> pa.Table:
    """One language: log-probabilities of its buckets, and its letters by script."""
    n = np.zeros(BUCKETS + len(_SCRIPT_NAMES))
    n[counts["bucket"].to_numpy()] = counts["n"].to_numpy()
    grams = n[:BUCKETS]
    log_p = (np.log(grams + 0.5) - np.log(grams.sum() + 0.5 * BUCKETS)).astype(np.float32)
    return pa.table({"lang": counts["lang"][:1], "log_p": pa.array([log_p.tobytes()], pa.binary()), "scripts": pa.array([n[BUCKETS:]])})


class Model:
    """Log-probabilities of n-gram buckets by language, and the languages of each script."""

    def __init__(self, packed: pa.Table):
        rows = sorted(zip(packed["lang"].to_pylist(), packed["log_p"], packed["scripts"], strict=True), key=lambda r: r[0].encode())
        self.langs = [r[0] for r in rows]
        self.log_p = np.empty((BUCKETS, len(rows)), np.float32)
        scripts = np.zeros((len(_SCRIPT_NAMES), len(rows)))
        for k, (_, log_p, letters) in enumerate(rows):
            self.log_p[:, k] = np.frombuffer(log_p.as_buffer(), np.float32)
            scripts[:, k] = letters.as_py()
        self.written = scripts >= 0.01 * np.maximum(scripts.sum(0), 1.0)  # script x language
        self.written[~self.written.any(1)] = True  # a script never seen leaves all

    def word_scores(self, words: Words, sharpness: float = 4.0, floor: float = -12.0) -> np.ndarray:
        """Log-posterior of each language for each distinct word."""
        total = np.zeros((len(words.distinct), len(self.langs)))
        n = np.zeros(len(words.distinct))
        for word, bucket in words.grams():
            n += np.bincount(word, minlength=len(n))
            for k in range(len(self.langs)):
                total[:, k] += np.bincount(word, self.log_p[bucket, k], len(n))
        score = sharpness * total / np.sqrt(np.maximum(n, 1.0))[:, None]
        score[~self.written[words.scripts[: len(score)]]] = -1e9
        score -= score.max(1, keepdims=True)
        score -= np.log(np.exp(score).sum(1, keepdims=True))
        return np.maximum(score, floor).astype(np.float32)


def viterbi(scores: np.ndarray, offsets: np.ndarray, penalty: float) -> np.ndarray:
    """Best labels of many texts' words at once; offsets part the texts. All texts take each step together."""
    sizes = np.diff(offsets)
    by = np.argsort(-sizes, kind="stable")
    start, size = offsets[:-1][by], sizes[by]
    labels = np.zeros(len(scores), np.int64)
    back = np.zeros(scores.shape, np.int16)
    if not len(size) or not size[0]:
        return labels
    alive = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")  # texts with more than t words
    value = scores[start[: alive[0]]].astype(np.float64)
    ends = np.zeros(len(size), np.int64)
    own = np.arange(scores.shape[1])
    for t in range(size[0]):
        n = alive[t]
        if t:
            value = value[:n]
            best = value.argmax(1)
            switch = value[np.arange(n), best] - penalty
            stay = value >= switch[:, None]
            back[start[:n] + t] = np.where(stay, own, best[:, None])
            value = np.where(stay, value, switch[:, None]) + scores[start[:n] + t]
        over = alive[t + 1] if t + 1 < size[0] else 0
        ends[over:n] = value[over:n].argmax(1)
    now = ends.copy()
    for t in range(size[0] - 1, -1, -1):
        n = alive[t]
        labels[start[:n] + t] = now[:n]
        now[:n] = back[start[:n] + t, now[:n]]
    return labels


def label_words(scores: np.ndarray, offsets: np.ndarray, penalty: float) -> np.ndarray:
    """viterbi(), leaving out texts in which no switch can pay.

    Against a text's best single language, a stretch in another gains no more than the largest sum of
    score differences over any stretch. k such stretches cost k - 1 penalties at least (k > 1; all of
    the text in one other language gains nothing), so nothing pays while that sum is under half a
    penalty.
    """
    n = len(offsets) - 1
    labels = np.zeros(len(scores), np.int64)
    mixed = []
    for d in range(n):
        a, b = offsets[d], offsets[d + 1]
        if a == b:
            continue
        own = scores[a:b]
        best = int(own.sum(0, dtype=np.float64).argmax())
        labels[a:b] = best
        run = np.zeros((b - a + 1, own.shape[1]))
        np.cumsum(own - own[:, best : best + 1], axis=0, dtype=np.float64, out=run[1:])
        if (run[1:] - np.minimum.accumulate(run, axis=0)[:-1]).max() >= penalty / 2:
            mixed.append(d)
    if mixed:
        parts = [np.arange(offsets[d], offsets[d + 1]) for d in mixed]
        at = np.concatenate(parts)
        labels[at] = viterbi(scores[at], np.concatenate([[0], np.cumsum([len(p) for p in parts])]), penalty)
    return labels


ADDS = {
    "lang_pred": (T.StringType(), pa.string()),
    "score": (T.DoubleType(), pa.float64()),
    "spans": (T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("first", T.LongType()), T.StructField("last", T.LongType())])), pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))),
}


def _predict(texts: list[str | None], model: Model, penalty: float, spans: bool) -> list[tuple]:
    out: list[tuple] = []
    if not model.langs:
        return [(UND, 0.0, [])] * len(texts)
    words = Words(texts)
    scores = model.word_scores(words)
    size = np.array([len(w) for w in words.distinct] or [0])
    budget, a = max(1, (1 << 21) // len(model.langs)), 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(words.offsets, words.offsets[a] + budget, "right")) - 1)
        ids = words.ids[words.offsets[a] : words.offsets[b]]
        offsets = words.offsets[a : b + 1] - words.offsets[a]
        own = scores[ids]
        labels = label_words(own, offsets, penalty)
        doc = np.repeat(np.arange(b - a), np.diff(offsets))
        letters = size[ids]
        shape = (b - a, len(model.langs))
        share = np.bincount(doc * shape[1] + labels, letters, shape[0] * shape[1]).reshape(shape)
        sure = np.bincount(doc * shape[1] + labels, letters * np.exp(own[np.arange(len(ids)), labels].astype(np.float64)), shape[0] * shape[1]).reshape(shape)
        best = share.argmax(1)
        score = sure[np.arange(b - a), best] / np.maximum(share.sum(1), 1)
        for d in range(b - a):
            if offsets[d] == offsets[d + 1] or not has_letter(texts[a + d]):
                out.append((UND, 0.0, []))
                continue
            own_spans = []
            if spans:
                row = labels[offsets[d] : offsets[d + 1]]
                edge = np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1, [len(row)]]).tolist()
                own_spans = [{"lang": model.langs[row[x]], "first": x, "last": y - 1} for x, y in zip(edge, edge[1:], strict=False)]
            out.append((model.langs[best[d]], min(1.0, float(score[d])), own_spans))
        a = b
    return out


def _steps(value: np.ndarray | None, scores: np.ndarray, penalty: float, back: np.ndarray | None = None) -> np.ndarray | None:
    """Viterbi's values after the words of scores, from those before them (None: a text begins)."""
    for t, own in enumerate(scores):
        if value is None:
            value = own.astype(np.float64)
            continue
        best = value.argmax()
        switch = value[best] - penalty
        if back is not None:
            back[t] = np.where(value >= switch, back[t], best)
        value = np.maximum(value, switch) + own
    return value


def _predict_long(text: pa.Buffer, model: Model, penalty: float, spans: bool) -> tuple:
    """_predict() of one text, a stretch at a time.

    The first pass settles texts in which no switch pays, as label_words() does, if their first
    stretch is in their language. Otherwise the values at the start of each stretch are kept, and
    stretches are decoded from the last to the first.
    """
    n_langs = len(model.langs)
    if not n_langs:
        return UND, 0.0, []
    parts = stretches(text, room(STRETCH, n_langs))

    def coded(at: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, str]:
        plain = stretch_at(text, at)
        words = Words([plain])
        size = np.array([len(w) for w in words.distinct] or [0])
        return model.word_scores(words)[words.ids], size[words.ids], plain

    total, upto, least, gain = np.zeros(n_langs), np.zeros(n_langs), np.zeros(n_langs), 0.0
    guess, letter, n_words, n_letters, sure = None, False, 0, 0, 0.0
    for at in parts:
        own, letters, plain = coded(at)
        letter = letter or has_letter(plain)
        if not len(own):
            continue
        total += own.sum(0, dtype=np.float64)
        guess = int(total.argmax()) if guess is None else guess
        run = upto + np.cumsum(own - own[:, guess : guess + 1], axis=0, dtype=np.float64)
        before = np.minimum.accumulate(np.concatenate([np.minimum(least, upto)[None], run]), axis=0)
        gain = max(gain, float((run - before[:-1]).max()))
        upto, least = run[-1], before[-1]
        n_words += len(own)
        n_letters += int(letters.sum())
        sure += float((letters * np.exp(own[:, guess].astype(np.float64))).sum())
    if not letter or not n_words:
        return UND, 0.0, []
    if gain < penalty / 2 and int(total.argmax()) == guess:
        return model.langs[guess], min(1.0, sure / max(n_letters, 1)), [{"lang": model.langs[guess], "first": 0, "last": n_words - 1}] if spans else []

    starts, value = [], None
    for at in parts:
        starts.append(value)
        value = _steps(value, coded(at)[0], penalty)
    now, end = int(value.argmax()), n_words
    share, certain, found = np.zeros(n_langs), np.zeros(n_langs), []
    for at, value in zip(reversed(parts), reversed(starts), strict=True):
        own, letters, _ = coded(at)
        back = np.tile(np.arange(n_langs, dtype=np.int16), (len(own), 1))
        _steps(value, own, penalty, back)
        labels = np.empty(len(own), np.int64)
        for t in range(len(own) - 1, -1, -1):
            labels[t] = now
            now = int(back[t, now])
        share += np.bincount(labels, letters, n_langs)
        certain += np.bincount(labels, letters * np.exp(own[np.arange(len(own)), labels].astype(np.float64)), n_langs)
        edge = np.concatenate([[0], np.flatnonzero(np.diff(labels)) + 1, [len(labels)]]).tolist() if spans and len(own) else [0]
        for x, y in zip(edge[-2::-1], edge[:0:-1], strict=True):
            lang, first, last = model.langs[labels[x]], end - len(own) + x, end - len(own) + y - 1
            if found and found[-1]["lang"] == lang:
                found[-1]["first"] = first
            else:
                found.append({"lang": lang, "first": first, "last": last})
        end -= len(own)
    best = int(share.argmax())
    return model.langs[best], min(1.0, float(certain[best] / max(share.sum(), 1))), found[::-1]


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Count all rows with a text and a language."""
    rows = labelled.select(col(lang_col).cast("string").alias("lang"), col(text_col).cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    packed = count_ngrams(rows).groupBy("lang").applyInArrow(_pack, "lang string, log_p binary, scripts array<double>")
    return Model(packed.toArrow())


def identify(docs: DataFrame, model: Model, text_col: str = "text", penalty: float = 8.0, spans: bool = True) -> DataFrame:
    """Every row of docs with lang_pred, score and spans (language, first and last word).

    lang_pred has the most letters; score is the mean posterior of its words, weighted by letters,
    over all letters of the text, however long it is. A null text, or one without a letter, is ``und`` with score 0; so
    is every text if nothing was learned. Equal texts get equal results; added names replace columns.
    """
    rest = without(docs, ADDS)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.StructType([T.StructField(k, v[0]) for k, v in ADDS.items()]))
    def told(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for batch in texts:
                rows = []
                for part in slices(iter([pa.RecordBatch.from_arrays([batch], ["t"])]), 1000, room(SLICE, len(sent.value.langs))):
                    first = part.column(0)[0].as_buffer()
                    if first is not None and len(first) > SLICE:  # a slice of its own
                        rows.append(_predict_long(first, sent.value, penalty, spans))
                    else:
                        rows += _predict(part.column(0).to_pylist(), sent.value, penalty, spans)
                yield pa.StructArray.from_arrays([pa.array([r[k] for r in rows], v[1]) for k, v in enumerate(ADDS.values())], names=list(ADDS))
        finally:
            give_back()

    # not deterministic as far as the optimizer knows, or it would label texts twice to filter by the label
    out = rest.withColumn("_told", told.asNondeterministic()(col(text_col).cast("string")))
    return out.select(*[col(c) for c in rest.columns], *[F.col(f"_told.{k}").alias(k) for k in ADDS])


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "spans")
