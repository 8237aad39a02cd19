"""N-gram Jaccard join with signature trees.

Texts with the same shingles are one set. Two sets can only reach the threshold if they share one of
their first shingles in a common order (prefix filter), so sets meet in groups, one for each shared
first shingle; groups of the same smallest set are one group. The order puts shingles that many
texts share last, where they are hardly ever first. Which those are is counted over all texts; any
order gives the same links, so the bound on their number (``HEAVY``) is a matter of speed alone.

A signature tree holds the sets of a group by size: its nodes carry an OR-combined bitmap of
shingles and a size range, and a dual traversal leaves out node pairs whose largest possible overlap
is too small. That is done twice. First with bitmaps alone, of two to four bits a shingle: sets that
may be linked form candidate components. Then, inside these, with whole sets: what the tree leaves is
compared exactly, unless earlier links connect it. Only sets with a possible partner are shuffled.

A group of more than ``CHUNK`` sets is divided into chunks. Each chunk is joined with itself and with
the first one; then the sets outside the group's largest component are joined with every chunk. Two
sets of that component need no link of their own, so no pair that matters is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import col, drop_stash, giving_back, id_number, slices, stash, table, without
from tessera.llm.components import connected

HEAVY = 1 << 18
HEAVY_FROM = 32  # texts
CHUNK = 384
FANOUT = 8
PIECE = 1 << 20  # bytes of text that are hashed at a time; a longer text is a piece of its own
WEIGHT = 2048  # shingles; a larger set counts as several when groups are divided
SALTS = 64  # parts of a large group when its rows are joined with what is known of the group
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_ODD = 0x9E3779B97F4A7C15
_SPACE = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])
#: A random number for each byte; A-Z have those of a-z, white space has none.
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_BYTE[_SPACE] = 0
_powers: list[np.ndarray] = []


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX[0]
        x = (x ^ (x >> np.uint64(27))) * _MIX[1]
        return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64, and of its inverse; those of a piece are kept."""
    if _powers and len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    own = [np.cumprod(np.full(max(n, PIECE), np.uint64(x))) for x in (_ODD, pow(_ODD, -1, 1 << 64))]
    if n <= PIECE:
        _powers[:] = own
    return own[0], own[1]


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of the texts in data, and how many words stand before each text."""
    space = _SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    begin = offsets[:-1][offsets[:-1] < len(data)]
    first[begin] = ~space[begin]
    starts = np.flatnonzero(first)
    up, down = _power(len(data))
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(_BYTE[data] * up[: len(data)], starts) if len(starts) else np.zeros(0, np.uint64)
        return _mixed(sums * down[starts]), np.searchsorted(starts, offsets)


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; null and blank texts have none."""
    whole = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1] if len(whole) else np.zeros(1, np.int64)
    data = np.frombuffer(whole.buffers()[2] or b"", np.uint8)
    out: list[np.ndarray] = []
    none = np.zeros(0, np.uint64)
    a = 0
    while a < len(whole):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + PIECE, "right")) - 1)
        words, at = _word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        n = max(0, len(words) - size + 1)
        with np.errstate(over="ignore"):
            rolled = np.full(n, np.uint64(size))
            for k in range(size):
                rolled *= np.uint64(_ODD)
                rolled += words[k : n + k]
                rolled ^= rolled >> np.uint64(29)
            rolled = _mixed(rolled)
            for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if y - x >= size:
                    own = np.sort(rolled[x : y - size + 1])
                    new = np.empty(len(own), bool)
                    new[0] = True
                    np.not_equal(own[1:], own[:-1], out=new[1:])
                    out.append(own[new])
                elif y > x:  # the whole sequence as one shingle
                    h = np.array([y - x], np.uint64)
                    for w in words[x:y]:
                        h = _mixed(h * np.uint64(_ODD) + w)
                    out.append(h)
                else:
                    out.append(none)
        a = b
    return out


def set_key(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes(), len(s)) - (1 << 63)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1


def bitmap(s: np.ndarray) -> bytes:
    """Two to four bits a shingle; the width is a power of two, so that halves fold onto each other."""
    width = max(64, 1 << (2 * len(s) - 1).bit_length())
    bits = np.zeros(width, bool)
    bits[(s & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def _scan(size: int, least: int = 4):
    """Of each text its key, size and bitmap; of each batch the shingles that several sets share.

    The latter have the shingle as key, the number of sets as n, and the smallest of their keys as _id.
    """
    names = ["shared", "_name", "_id", "_th", "key", "n", "bitmap"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(batch.column(3), size)
            keys = [set_key(s) if len(s) else None for s in sets]
            n = pa.array([len(s) for s in sets], pa.int64())
            maps = pa.array([bitmap(s) if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sets), bool)), batch.column(0), batch.column(1), batch.column(2), pa.array(keys, pa.int64()), n, maps], names=names)
            found = sorted({k: s for k, s in zip(keys, sets, strict=True) if k is not None}.items())
            if not found:
                continue
            tokens = np.concatenate([s for _, s in found])
            owner = np.repeat(np.array([k for k, _ in found], np.int64), [len(s) for _, s in found])
            by = np.argsort(tokens, kind="stable")
            tokens = tokens[by]
            first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
            count = np.diff(np.append(first, len(tokens)))
            first, count = first[count >= least], count[count >= least]
            label = owner[by[first]]
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(first), bool)), pa.nulls(len(first), batch.column(0).type), pa.array(label), pa.array(label), pa.array(tokens[first].view(np.int64)), pa.array(count), pa.nulls(len(first), pa.binary())], names=names)

    return run


def _prefixes(size: int, percent: int, heavy):
    """(grouped, label, key, n): a light first shingle, or the label of a heavy one, of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, rank, labels = heavy.value  # sorted by token
        for batch in slices(batches):
            light, light_key, label, label_key, seen = [], [], [], [], set()
            for s in shingle_sets(batch.column(0), size):
                if not len(s) or (key := set_key(s)) in seen:
                    continue
                seen.add(key)
                p = prefix_length(len(s), percent)
                at = np.searchsorted(tokens, s)
                known = tokens[np.minimum(at, len(tokens) - 1)] == s if len(tokens) else np.zeros(len(s), bool)
                own = s[~known][:p]
                light.append(own)
                light_key.append((key, len(s), len(own)))
                if len(own) < p:
                    at = at[known]
                    first = np.unique(labels[at[np.argsort(rank[at])][: p - len(own)]])
                    label.append(first)
                    label_key.append((key, len(s), len(first)))
            for grouped, value, keys in ((False, light, light_key), (True, label, label_key)):
                if value:
                    times = [t for _, _, t in keys]
                    k, n = (np.repeat(np.array([x[i] for x in keys], kind), times) for i, kind in ((0, np.int64), (1, np.int32)))
                    v = np.concatenate(value)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), grouped)), pa.array(v.view(np.int64)), pa.array(k), pa.array(n)], names=["grouped", "label", "key", "n"])

    return run


def _groups(percent: int):
    """From rows sorted by (grouped, label, n, key): (g, key) of all shingles that several sets share.

    Sets that share a shingle are one group as far as sizes follow each other closely enough: sets on
    both sides of a gap cannot reach the threshold. Only the last row is carried from batch to batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # label, first key of the run, latest size
        for batch in batches:
            grouped, label, key, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            out_g, out_key = [label[grouped]], [key[grouped]]
            label, key, n = label[~grouped], key[~grouped], n[~grouped].astype(np.int64)
            if len(label):
                if last:
                    label, key, n = (np.concatenate([[x], y]) for x, y in zip(last, (label, key, n), strict=True))
                new = np.concatenate([[True], (label[1:] != label[:-1]) | (n[1:] * percent > 100 * n[:-1])])
                first = key[new][np.cumsum(new) - 1]
                differs = key != first
                out_g += [first[differs], first[differs]]
                out_key += [key[differs], first[differs]]
                last = (label[-1], first[-1], n[-1])
            g, k = np.concatenate(out_g), np.concatenate(out_key)
            if len(g):
                pairs = np.unique(np.stack([g, k], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["g", "key"])

    return run


def _sets(size: int):
    """(key, n, payload) of (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            sets = shingle_sets(batch.column(1), size)
            n = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n, pa.array([s.tobytes() for s in sets], pa.binary())], names=["key", "n", "payload"])

    return run


class SignatureTree:
    """Sets in order of size, FANOUT to a node at every level; level 0 holds the sets themselves.

    A node has the OR of its bitmaps, its least and largest size, and the largest surplus: how many
    shingles of a set go beyond one for each bit.
    """

    def __init__(self, packed: np.ndarray, n: np.ndarray):
        self.levels = [(packed, n, n, n - np.bitwise_count(packed).sum(1, dtype=np.int64))]
        while len(self.levels[-1][1]) > 1:
            sig, low, high, more = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(sig, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(more, at)))

    def possible(self, level: int, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """Which node pairs can hold two sets that reach the threshold."""
        sig, low, high, more = self.levels[level]
        fits = (low[a] * percent <= 100 * high[b]) & (low[b] * percent <= 100 * high[a])
        a, b = a[fits], b[fits]
        most = np.empty(len(a), np.int64)
        for k in range(0, len(a), 1 << 14):  # bounds the bitmaps in memory
            x, y = a[k : k + (1 << 14)], b[k : k + (1 << 14)]
            most[k : k + (1 << 14)] = np.bitwise_count(sig[x] & sig[y]).sum(1, dtype=np.int64) + np.minimum(more[x], more[y])
        # 100 i >= p (x + y - i), for the least sizes that the nodes hold
        fits[fits] = most * (100 + percent) >= percent * (low[a] + low[b])
        return fits

    def pairs(self, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs a < b of sets that the dual traversal leaves."""
        a = b = np.zeros(1, np.int64)
        kids = np.arange(FANOUT)
        for level in range(len(self.levels) - 1, -1, -1):
            fits = self.possible(level, a, b, percent)
            if level:
                fits |= a == b
            a, b = a[fits], b[fits]
            if level:
                width = len(self.levels[level - 1][1])
                left = np.broadcast_to(a[:, None, None] * FANOUT + kids[:, None], (len(a), FANOUT, FANOUT)).reshape(-1)
                right = np.broadcast_to(b[:, None, None] * FANOUT + kids, (len(b), FANOUT, FANOUT)).reshape(-1)
                keep = (left < right) | ((left == right) & (level > 1))
                keep &= (left < width) & (right < width)
                a, b = left[keep], right[keep]
        return a, b


def labels_of(n: int, a: np.ndarray, b: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Component labels of n nodes from links (a, b) and the components they are in already."""
    _, first, same = np.unique(group, return_index=True, return_inverse=True)
    a, b = np.concatenate([a, np.arange(n)]), np.concatenate([b, first[same]])
    comp = np.arange(n)
    while True:
        least = np.minimum(comp[a], comp[b])
        new = comp.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == comp).all():
            return comp
        comp = new


def match_bitmaps(payloads: list[bytes], n: np.ndarray, percent: int, group: np.ndarray, probe: np.ndarray) -> np.ndarray:
    """Labels of sets that may be linked, by their bitmaps.

    Linked sets have bitmaps of one width, or of neighbouring ones; the wider is folded then.
    """
    width = np.array([len(p) for p in payloads])
    left, right = [], []
    for w in np.unique(width):
        own = np.flatnonzero((width == w) | (width == 2 * w))
        own = own[np.argsort(n[own], kind="stable")]
        packed = np.empty((len(own), w), np.uint8)
        for row, i in zip(packed, own.tolist(), strict=True):
            p = np.frombuffer(payloads[i], np.uint8)
            row[:] = p if len(p) == w else p[:w] | p[w:]
        a, b = SignatureTree(packed.view(np.uint64), n[own]).pairs(percent)
        a, b = own[a], own[b]
        keep = ((width[a] == w) | (width[b] == w)) & (probe[a] | probe[b])
        left.append(a[keep])
        right.append(b[keep])
    return labels_of(len(n), np.concatenate(left), np.concatenate(right), group)


def match_sets(payloads: list[bytes], n: np.ndarray, percent: int, group: np.ndarray, probe: np.ndarray) -> np.ndarray:
    """Labels of sets that are linked, by their shingles."""
    order = np.argsort(n, kind="stable")
    sets = [np.frombuffer(payloads[i], np.uint64) for i in order]
    comp, ask = labels_of(len(n), order[:0], order[:0], group)[order], probe[order]
    bits = int(np.clip(1 << int(4 * n.max() - 1).bit_length(), 64, 1 << 15))
    signature = np.zeros((len(sets), bits), bool)
    for row, s in zip(signature, sets, strict=True):
        row[(s & np.uint64(bits - 1)).astype(np.int64)] = True
    a, b = SignatureTree(np.packbits(signature, axis=1).view(np.uint64), n[order]).pairs(percent)
    del signature
    keep = ask[a] | ask[b]
    for i, j in zip(a[keep].tolist(), b[keep].tolist(), strict=True):
        if comp[i] != comp[j]:
            x, y = sets[i], sets[j]
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= percent * (len(x) + len(y) - both):
                comp[comp == comp[j]] = comp[i]
    out = np.empty_like(comp)
    out[order] = comp
    return out


def _join_task(match: Callable, percent: int):
    def run(rows: pa.Table) -> pa.Table:
        """Links (a, b), from each set to one of its component, for each pid in the task."""
        pid, key, n = rows["pid"].to_numpy(), rows["key"].to_numpy(), rows["n"].to_numpy()
        probe, comp = rows["probe"].to_numpy(), rows["comp"].to_numpy()
        payloads = rows["payload"].to_pylist()
        by = np.lexsort((key, pid))
        left, right = [], []
        for own in np.split(by, np.flatnonzero(np.diff(pid[by])) + 1) if len(by) else ():
            own = own[np.concatenate([[True], np.diff(key[own]) != 0])]
            if len(own) < 2:
                continue
            found = match([payloads[i] for i in own], n[own], percent, comp[own], probe[own])
            _, first, same = np.unique(found, return_index=True, return_inverse=True)
            a, b = key[own], key[own[first[same]]]
            left.append(a[a != b])
            right.append(b[a != b])
        return pa.table({"a": pa.array(np.concatenate(left) if left else [], pa.int64()), "b": pa.array(np.concatenate(right) if right else [], pa.int64())})

    return run


def _salted(groups: DataFrame, facts: DataFrame, how: str) -> DataFrame:
    """groups with the facts of their group, of which there are few; a large group's rows meet them in SALTS places."""
    salt = F.pmod(F.xxhash64("key", F.lit(7)), F.lit(SALTS)).cast("int")
    spread = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return groups.withColumn("_salt", salt).join(spread, ["g", "_salt"], how).drop("_salt")


def linked(groups: DataFrame, payloads: DataFrame, match: Callable, percent: int, weight: Column | None = None) -> DataFrame:
    """(node, root) of all keys that match links, directly or by way of others, inside groups (g, key).

    payloads: (key, n, payload), one row for each key at least. weight: how many sets a row counts
    for when a group is divided; one if not given.
    """
    groups = groups.select("g", "key", (F.lit(1) if weight is None else weight).cast("long").alias("w"))
    large = groups.groupBy("g").agg(F.ceil(F.sum("w") / CHUNK).cast("int").alias("chunks")).where("chunks > 1")
    large = stash(large, "jaccard-sizes")
    members = _salted(groups, large, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    members = stash(members.withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int")), "jaccard-members")
    # Small groups share tasks of about CHUNK sets; each chunk of a large one is a task.
    lots = max(1, (members.agg(F.sum("w")).first()[0] or 0) // CHUNK)
    parts = F.when(F.col("chunk") == 0, F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array("chunk"))
    tasks = members.select("g", "chunks", "key", F.explode(parts).alias("part")).select(
        "key",
        F.xxhash64("g", "part").alias("pid"),
        F.when(F.col("chunks") == 1, F.pmod(F.xxhash64("g"), F.lit(lots))).otherwise(F.xxhash64("g", "part")).alias("task"),
        F.lit(True).alias("probe"),
        F.col("key").alias("comp"),
    )
    links = stash(payloads.join(tasks, "key").groupBy("task").applyInArrow(_join_task(match, percent), "a long, b long"), "jaccard-links")
    roots = connected(links)
    many = members.where("chunks > 1")
    if not large.isEmpty():
        known = stash(many.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("comp", F.coalesce("root", "key")).drop("root"), "jaccard-large")
        largest = known.groupBy("g", "comp").agg(F.count("*").alias("c"), F.sum("w").alias("w")).groupBy("g").agg(F.max(F.struct("c", "comp", "w")).alias("t"), F.sum("w").alias("w"))
        rest = largest.select("g", F.col("t.comp").alias("main"), (F.col("w") - F.col("t.w")).alias("others")).where("others > 0")
        rest = stash(rest.select("g", "main", F.ceil(F.col("others") / CHUNK).cast("int").alias("lots")), "jaccard-rest")
        if not rest.isEmpty():
            open_ = _salted(known, rest, "inner")
            ask = open_.where(F.col("comp") != F.col("main")).withColumn("lot", F.pmod(F.xxhash64("key", F.lit(3)), F.col("lots")).cast("int"))
            asked = ask.select("g", "key", "comp", "lot", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(True).alias("probe"))
            every = open_.select("g", "key", "comp", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), "chunk", F.lit(False).alias("probe"))
            pairs = asked.unionByName(every).groupBy("g", "lot", "chunk", "key", "comp").agg(F.max("probe").alias("probe"))
            task = F.xxhash64("g", "lot", "chunk")
            pairs = pairs.select("key", task.alias("pid"), task.alias("task"), "probe", "comp")
            more = stash(payloads.join(pairs, "key").groupBy("task").applyInArrow(_join_task(match, percent), "a long, b long"), "jaccard-more")
            drop_stash(roots)
            roots = connected(links.unionByName(more))
            drop_stash(more)
        drop_stash(rest)
        drop_stash(known)
    for used in (links, members, large):
        drop_stash(used)
    return roots


def text_hash(text_col: str) -> Column:
    return F.xxhash64(col(text_col).cast("string"))


def near_components(docs: DataFrame, size: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_name, _id, _th, key, n, component, root): of every row its set, the set's size and its component.

    _name is the id, of whatever type; component is the smallest id of the row's component that is
    not null, or null where all are. root is the key of one set of the component, which tells
    components apart where ids are null or repeat; it is null where key is. _id and _th are hashes of
    id and text. key is null and component the own id where the text is null or has no words.
    Repeated rows have one set; an empty table has no rows; other columns are ignored. percent is 50
    or more: bitmaps of linked sets are then of one width or of neighbouring ones.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    spark = docs.sparkSession
    plain = docs.select(col(id_col).alias("_name"), id_number(id_col).alias("_id"), text_hash(text_col).alias("_th"), col(text_col).cast("string").alias("_text"))
    kind = plain.schema["_name"].dataType.simpleString()
    scanned = stash(plain.mapInArrow(giving_back(_scan(size)), f"shared boolean, _name {kind}, _id long, _th long, key long, n long, bitmap binary"), "jaccard-scan")
    rows = scanned.where("NOT shared")
    owners = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("_name").alias("least"), F.min(F.struct("_id", "_th", "n", "bitmap")).alias("o"))
    owners = stash(owners.select("key", "least", F.col("o._id").alias("_id"), F.col("o._th").alias("_th"), F.col("o.n").alias("n"), F.col("o.bitmap").alias("payload")), "jaccard-owners")

    common = scanned.where("shared").groupBy("key").agg(F.sum("n").alias("n"), F.min("_id").alias("label"))
    common = common.where(F.col("n") >= HEAVY_FROM).orderBy(F.desc("n"), "key").limit(HEAVY).toArrow()
    token, n = common["key"].to_numpy().view(np.uint64), common["n"].to_numpy()
    by = np.argsort(token)
    rank = np.empty(len(by), np.int64)
    rank[np.lexsort((token, n))] = np.arange(len(by))
    heavy = spark.sparkContext.broadcast((token[by], rank[by], common["label"].to_numpy()[by]))

    first = plain.select("_text").mapInArrow(giving_back(_prefixes(size, percent, heavy)), "grouped boolean, label long, key long, n int")
    spread = F.when(F.col("grouped"), F.pmod(F.xxhash64("key"), F.lit(64))).otherwise(0)
    met = first.repartition("label", spread).sortWithinPartitions("grouped", "label", "n", "key").mapInArrow(giving_back(_groups(percent)), "g long, key long").distinct()
    met = stash(met, "jaccard-groups")
    heavy.destroy()
    maybe = linked(met, owners.select("key", "n", "payload"), match_bitmaps, percent)
    drop_stash(met)

    wanted = stash(maybe.join(owners.drop("payload"), maybe["node"] == owners["key"]).select("root", "key", "_id", "_th", "n"), "jaccard-wanted")
    # one plan at every size: the texts go to the wanted names, which may be as many as there are copies
    found = plain.select("_id", "_th", "_text").join(wanted.select("_id", "_th", "key").hint("merge"), ["_id", "_th"])
    sets = stash(found.select("key", "_text").mapInArrow(giving_back(_sets(size)), "key long, n long, payload binary"), "jaccard-sets")
    roots = linked(wanted.select(F.col("root").alias("g"), "key", "n"), sets, match_sets, percent, F.ceil(F.col("n") / WEIGHT))

    named = roots.withColumnRenamed("node", "key").join(owners.select("key", "least"), "key")
    smallest = stash(named.groupBy("root").agg(F.min("least").alias("component")), "jaccard-smallest")
    linked_keys = stash(named.join(smallest, "root").select("key", "component", "root"), "jaccard-components")
    final = owners.select("key", "least").join(linked_keys, "key", "left").select("key", F.coalesce("component", "least").alias("component"), F.coalesce("root", "key").alias("root"))
    final = stash(final, "jaccard-final")
    for used in (maybe, wanted, sets, roots, smallest, linked_keys, owners):
        drop_stash(used)
    component = F.when(F.col("key").isNull(), F.col("_name")).otherwise(F.col("component"))
    return rows.join(final, "key", "left").select("_name", "_id", "_th", "key", "n", component.alias("component"), "root")


def deduplicate(docs: DataFrame, size: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of docs: that of its smallest id, then text hash. Rows without words all stay.

    A null id comes first, ids that are no numbers go by a hash. Ids can repeat: texts that are no
    copies of each other all stay, whatever their ids. Of rows of equal id and text one stays.
    """
    rest = without(docs, ["_name", "_id", "_th", "_n"])
    found = stash(near_components(rest, size, percent, id_col, text_col).select("_id", "_th", "root"), "jaccard-found")
    same = found.where("root IS NOT NULL").groupBy("root", "_id", "_th").agg(F.count("*").alias("_n"))
    first = same.groupBy("root").agg(F.min(F.struct("_id", "_th", "_n")).alias("o")).select("o.*")
    wordless = found.where("root IS NULL").select("_id", "_th", F.lit(0).cast("long").alias("_n")).distinct()
    keep = stash(first.unionByName(wordless), "jaccard-keep")
    drop_stash(found)
    kept = rest.withColumns({"_id": id_number(id_col), "_th": text_hash(text_col)}).join(keep, ["_id", "_th"])
    if not keep.where("_n > 1").isEmpty():  # one of equal rows, by an aggregation that combines them where they are
        kept = kept.where("_n <= 1").unionByName(kept.where("_n > 1").dropDuplicates(["_id", "_th"]))
    return kept.select(*[col(c) for c in rest.columns])


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("_name").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
