"""Embedding whitening: Welford's updates inside partitions, merged in a tree, then a symmetric QR eigen-solve.

Every entry c becomes the whole number floor(1024 c) + 100000, so counts, sums and deviations are exact.
A task keeps count, mean and co-moments of its vectors and brings each further vector in by a rank-one
update; a block of such updates is one matrix product, with each vector's own running mean. Means are kept
relative to the task's first vector, so the offset costs no digits. The states of all tasks are written
down and merged ``FAN_IN`` at a time by the parallel update formula; no task holds more than two states.

One task brings the covariance to tridiagonal form by reflections and solves it by implicitly shifted QR
steps. Only the leading components reach the driver. They go out to the workers in blocks of
``MODEL_BYTES`` at most, which is one block unless the table has vectors of very many lengths. A second
pass measures how far the whitened covariance is from the identity.

Odd rows: a vector that is null, empty or holds a null or non-finite entry has no part and is not
returned. Null or repeated ids and repeated rows count as they are. Vectors are whitened with those of
their own length. Entries beyond 2^52 stop there. A component without variance (constant vectors, fewer
vectors than components) has null ``whitened`` and is left out of ``identity_error``; ``explained`` is null
where nothing varies. A deviation that no long can hold is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, col, drop_stash, giving_back, stash, table

COMPONENTS = 8
BLOCK = 1024  # vectors in one matrix product
FAN_IN = 32
MODEL_BYTES = 64 << 20
LARGEST = float(1 << 52)
STATE = "_key int, _n long, _origin binary, _sums array<string>, _mean binary, _m2 binary"
ADDED = "n", "deviation", "whitened", "explained", "identity_error"


def lattice(values: np.ndarray) -> np.ndarray:
    """floor(1024 c) + 100000 of each entry, as whole numbers."""
    return np.clip(np.floor(values * 1024.0), -LARGEST, LARGEST).astype(np.int64) + 100_000


class Moments:
    """Count, exact sums, mean and co-moments of vectors; the mean is relative to ``origin``."""

    def __init__(self, origin: np.ndarray):
        d = len(origin)
        self.n, self.origin, self.sums = 0, origin, [0] * d
        self.mean, self.m2 = np.zeros(d), np.zeros((d, d))

    def add(self, x: np.ndarray) -> None:
        for a in range(0, len(x), BLOCK):
            rows = x[a : a + BLOCK]
            if rows.dtype == np.int64:  # exact, whatever the size
                small = np.abs(rows).max() < 1 << 50
                self.sums = [s + int(t) for s, t in zip(self.sums, rows.sum(axis=0) if small else rows.astype(object).sum(axis=0))]
            z = (rows - self.origin).astype(np.float64)
            upto = self.n + np.arange(1.0, len(z) + 1)[:, None]
            means = self.mean + np.cumsum(z - self.mean, axis=0) / upto
            step = z - np.vstack([self.mean, means[:-1]])  # from the mean before each vector
            self.m2 += (step * ((upto - 1) / upto)).T @ step
            self.mean, self.n = means[-1], self.n + len(z)

    def merge(self, other: Moments) -> None:
        n = self.n + other.n
        apart = (other.origin - self.origin) + (other.mean - self.mean)
        self.m2 += other.m2 + np.outer(apart, apart) * (self.n * other.n / n)
        self.mean = self.mean + apart * (other.n / n)
        self.sums = [a + b for a, b in zip(self.sums, other.sums)]
        self.n = n

    def row(self, key: int) -> dict:
        return {"_key": key, "_n": self.n, "_origin": self.origin.astype(np.float64).tobytes(), "_sums": [str(s) for s in self.sums], "_mean": self.mean.tobytes(), "_m2": self.m2.tobytes()}

    @staticmethod
    def of(row: dict) -> Moments:
        out = Moments(np.frombuffer(row["_origin"]))
        out.n, out.sums = row["_n"], [int(s) for s in row["_sums"]]
        out.mean = np.frombuffer(row["_mean"])
        out.m2 = np.frombuffer(row["_m2"]).reshape(len(out.mean), -1).copy()
        return out


def blocks(lists: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, matrix) of the lists of each length; nulls have none."""
    lengths = np.diff(lists.offsets.to_numpy()) if lists.null_count == 0 else np.array([-1 if x is None else x for x in pa.compute.list_value_length(lists).to_pylist()])
    starts = lists.offsets.to_numpy()[:-1]
    flat = lists.values.to_numpy(zero_copy_only=False)
    for d in np.unique(lengths):
        if d > 0:
            at = np.flatnonzero(lengths == d)
            yield int(d), at, flat[starts[at][:, None] + np.arange(d)].astype(np.float64)


def moments(df: DataFrame, whole: bool) -> DataFrame:
    """States of (_key, _vector) rows, one for each task and key; whole: of lattice numbers."""

    @giving_back
    def run(batches):
        states: dict[int, Moments] = {}
        for batch in batches:
            keys = batch.column("_key").to_numpy(zero_copy_only=False)
            for _, at, rows in blocks(batch.column("_vector")):
                x = lattice(rows) if whole else rows
                for key in np.unique(keys[at]):
                    own = x[keys[at] == key]
                    if key not in states:
                        states[key] = Moments(own[0] if whole else np.zeros(own.shape[1]))
                    states[key].add(own)
        for key, s in states.items():
            yield pa.RecordBatch.from_pylist([s.row(int(key))], schema=ARROW_STATE)

    return df.select("_key", "_vector").mapInArrow(run, STATE)


ARROW_STATE = pa.schema([("_key", pa.int32()), ("_n", pa.int64()), ("_origin", pa.binary()), ("_sums", pa.list_(pa.string())), ("_mean", pa.binary()), ("_m2", pa.binary())])


@giving_back
def _merge(batches):
    states: dict[int, Moments] = {}
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            if row["_key"] in states:
                states[row["_key"]].merge(Moments.of(row))
            else:
                states[row["_key"]] = Moments.of(row)
    for key, s in states.items():
        yield pa.RecordBatch.from_pylist([s.row(key)], schema=ARROW_STATE)


def merged(states: DataFrame) -> DataFrame:
    """One state for each key, by a tree of merges. states: as many rows as tasks and keys made."""
    tasks = states.count()
    while tasks > 1:
        tasks = -(-tasks // FAN_IN)
        states = states.repartition(tasks).mapInArrow(_merge, STATE)
    return states


def symmetric_qr(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as rows, each with its largest entry positive."""
    a, n = (v + v.T) / 2, len(v)
    q = np.eye(n)  # rows: the basis
    for k in range(n - 2):
        u = a[k + 1 :, k].copy()
        norm = np.linalg.norm(u)
        if norm == 0 or not u[1:].any():
            continue
        u[0] += np.copysign(norm, u[0])
        u /= np.linalg.norm(u)
        a[k + 1 :] -= 2 * np.outer(u, u @ a[k + 1 :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ u, u)
        q[k + 1 :] -= 2 * np.outer(u, u @ q[k + 1 :])
    d, e = np.diag(a).copy(), np.diag(a, -1).copy()
    eps = np.finfo(float).eps
    high = n - 1
    while high > 0:
        e[np.abs(e) <= eps * (np.abs(d[:-1]) + np.abs(d[1:]))] = 0
        if e[high - 1] == 0:
            high -= 1
            continue
        low = high - 1
        while low > 0 and e[low - 1] != 0:
            low -= 1
        half = (d[high - 1] - d[high]) / 2
        shift = d[high] - e[high - 1] ** 2 / (half + np.copysign(np.hypot(half, e[high - 1]), half))
        x, z = d[low] - shift, e[low]
        for k in range(low, high):  # a rotation of rows k and k + 1 chases the bulge down
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > low:
                e[k - 1] = r
            one, two, off = d[k], d[k + 1], e[k]
            d[k] = c * c * one + 2 * c * s * off + s * s * two
            d[k + 1] = s * s * one - 2 * c * s * off + c * c * two
            e[k] = c * s * (two - one) + (c * c - s * s) * off
            if k < high - 1:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            q[[k, k + 1]] = np.array([[c, s], [-s, c]]) @ q[[k, k + 1]]
    order = np.argsort(-d, kind="stable")
    values, vectors = d[order], q[order]
    signs = np.sign(vectors[np.arange(n), np.abs(vectors).argmax(axis=1)])
    return values, vectors * signs[:, None]


def _solve(components: int):
    @giving_back
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                s = Moments.of(row)
                values, vectors = symmetric_qr(s.m2 / s.n)
                k = min(components, len(values))
                total = float(np.trace(s.m2)) / s.n
                # below this an eigenvalue is rounding
                seen = values[:k] > max(total, 0) * len(values) * np.finfo(float).eps
                yield pa.RecordBatch.from_pylist([{"d": row["_key"], "n": s.n, "sums": row["_sums"], "values": np.where(seen, values[:k], 0.0).tolist(), "vectors": vectors[:k].tobytes(), "total": total}])

    return run


def fit(df: DataFrame, vec_col: str, components: int) -> list[dict]:
    """The model of each vector length: n, sums, leading eigenvalues and eigenvectors, total variance."""
    states = stash(moments(df.select(F.size(col(vec_col)).alias("_key"), col(vec_col).cast("array<double>").alias("_vector")), True), "whitening")
    models = merged(states).mapInArrow(_solve(components), "d long, n long, sums array<string>, values array<double>, vectors binary, total double").collect()
    drop_stash(states)
    return [{**m.asDict(), "identity_error": None} for m in models]


def _apply(vec_col: str, models: list[dict]):
    """The column of what is added to each vector of the lengths that models have."""
    kind = "struct<n: bigint, deviation: bigint, whitened: array<double>, explained: array<double>, identity_error: double>"
    arrow = pa.struct([("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.list_(pa.float64())), ("explained", pa.list_(pa.float64())), ("identity_error", pa.float64())])
    by = {m["d"]: m for m in models}

    @F.arrow_udf(kind)
    def told(vectors: pa.Array) -> pa.Array:
        out: list = [None] * len(vectors)
        for d, at, rows in blocks(vectors):
            m = by[d]
            n, sums = m["n"], [int(s) for s in m["sums"]]
            x = lattice(rows)
            if n * max(np.abs(x).max(), 1) < 1 << 61:  # |sums| is no larger
                off = n * x - np.array(sums, np.int64)
            else:
                off = n * x.astype(object) - np.array(sums, object)
            exact = off if off.dtype == np.int64 and (off.astype(np.float64) ** 2).sum(axis=1).max() < 2.0**62 else off.astype(object)
            deviations = (exact * exact).sum(axis=1)
            values = np.array(m["values"])
            on = (off.astype(np.float64) / n) @ np.frombuffer(m["vectors"]).reshape(len(values), d).T
            white = on / np.sqrt(np.where(values > 0, values, 1))
            explained = [v / m["total"] if m["total"] > 0 else None for v in m["values"]]
            for i, j in enumerate(at):
                told_off = int(deviations[i])
                whitened = [w if v > 0 else None for w, v in zip(white[i].tolist(), m["values"])]
                out[j] = {"n": n, "deviation": told_off if told_off < 1 << 63 else None, "whitened": whitened, "explained": explained, "identity_error": m["identity_error"]}
        return pa.array(out, arrow)

    return told(col(vec_col).cast("array<double>"))


def whiten(df: DataFrame, vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Rows of df with a whole vector, and n, deviation, whitened and explained (arrays) and identity_error."""
    bound_batches(df.sparkSession)
    good = F.exists(col(vec_col), lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    clean = df.where(col(vec_col).isNotNull() & (F.size(col(vec_col)) > 0)).where(~good)
    models = fit(clean, vec_col, components)
    parts, size = [[]], 0
    for m in models:  # broadcast in blocks of a bounded size
        own = len(m["vectors"]) + 24 * m["d"]
        if parts[-1] and size + own > MODEL_BYTES:
            parts.append([])
            size = 0
        parts[-1].append(m)
        size += own

    name = "_told"
    while name in {c.lower() for c in df.columns}:
        name += "_"

    def told(part: list[dict]) -> DataFrame:
        own = clean.where(F.size(col(vec_col)).isin([m["d"] for m in part])) if len(parts) > 1 else clean
        return own.withColumn(name, _apply(vec_col, part))

    def over(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    seen = over([told(p).select(F.size(col(vec_col)).alias("_key"), F.filter(f"{name}.whitened", lambda w: w.isNotNull()).alias("_vector")) for p in parts])
    states = stash(moments(seen, False), "whitened")
    for row in merged(states).collect():
        s = Moments.of(row.asDict())
        next(m for m in models if m["d"] == row["_key"])["identity_error"] = float(np.abs(s.m2 / s.n - np.eye(len(s.mean))).max())
    drop_stash(states)
    kept = [c for c in df.columns if c.lower() not in {a.lower() for a in ADDED}]
    return over([told(p).select(*[col(c) for c in kept], *[F.col(f"{name}.{a}").alias(a) for a in ADDED]) for p in parts])


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each vector and component of embeddings."""
    told = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    pairs = told.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "own"))
    return pairs.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", F.col("own.whitened").alias("whitened"), F.col("own.explained").alias("explained"), "identity_error")
