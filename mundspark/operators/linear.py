"""Multinomial logistic regression on sparse rows of hashed features.

Rows are packed into blobs of numbers once and staged; each evaluation is one pass of numpy over the blobs. A task holds the
coefficients, their gradient and one blob, the driver a few vectors of that length, whatever the number of rows."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Most entries of a blob (a longer row has its own), numbers of a piece of a sum that travels, steps that L-BFGS remembers,
#: and the relative change at which it ends.
ENTRIES, PIECE, MEMORY, TOLERANCE = 1 << 18, 1 << 16, 5, 1e-6
BLOBS = "held boolean, labels binary, sizes binary, slots binary, values binary"
#: Deletes what a query shuffled as soon as it ends: a fit sums up a gradient of all slots for each step.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def pack(df: DataFrame, docs: int, features: int) -> DataFrame:
    """Blobs of (label, held, terms), terms being an array of (slot, tf, df), as TF-IDF rows of unit length (see
    features.tfidf). Colliding terms of a row are summed; values have single precision."""

    def blobs(batches):
        schema = pa.schema([("held", pa.bool_()), *[(c, pa.binary()) for c in ("labels", "sizes", "slots", "values")]])
        for b in batches:
            lists = b.column("terms")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            sizes, t = np.diff(offsets), lists.flatten()
            slot, tf, df = (t.field(k).to_numpy(zero_copy_only=False) for k in ("slot", "tf", "df"))
            row = np.repeat(np.arange(len(sizes)), sizes)
            w = (1 + np.log(tf)) * (np.log((1.0 + docs) / (1 + df)) + 1)
            w /= np.sqrt(np.bincount(row, w * w, len(sizes)))[row]
            key = row * features + slot
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
            w, row, slot = np.add.reduceat(w[order], first).astype(np.float32), key[first] // features, (key[first] % features).astype(np.int32)
            sizes = np.bincount(row, minlength=len(sizes))
            labels, held = b.column("label").to_numpy(zero_copy_only=False), b.column("held").to_numpy(zero_copy_only=False)
            for h in (False, True):
                rows = np.flatnonzero((held == h) & (sizes > 0))
                mine = (held == h)[row]
                s, v, ends = slot[mine], w[mine], np.cumsum(sizes[rows])
                i = at = 0
                while i < len(rows):
                    j = max(i + 1, int(np.searchsorted(ends, at + ENTRIES, "right")))
                    to = int(ends[j - 1])
                    one = (labels[rows[i:j]].astype(np.int32), sizes[rows[i:j]].astype(np.int32), s[at:to], v[at:to])
                    yield pa.RecordBatch.from_arrays([pa.array([h]), *[pa.array([x.tobytes()], pa.binary()) for x in one]], schema=schema)
                    i, at = j, to

    return df.select("label", "held", "terms").mapInArrow(blobs, BLOBS)


def _rows(batches):
    """Labels, place of each row's first entry, row of each entry, slots and values of each blob."""
    for b in batches:
        for k in range(b.num_rows):
            get = lambda c, t: np.frombuffer(b.column(c)[k].as_buffer(), t)  # noqa: B023, E731
            sizes = get("sizes", np.int32)
            yield get("labels", np.int32), np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes), get("slots", np.int32), get("values", np.float32)


def _summed(blobs: DataFrame, size: int, tail: int, add: Callable, kind: type = np.float64) -> tuple[np.ndarray, np.ndarray]:
    """The sum of a vector to which add(vector, *row) adds what each blob has: its first size numbers, which travel as kind,
    and the last tail ones. Each task sums up its own, pieces are summed over the tasks, and only the result travels to the
    driver."""
    spark = blobs.sparkSession
    of = lambda k: kind if k >= 0 else np.float64

    def batch(k, x):
        return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.astype(of(k)).tobytes()], pa.binary())], ["piece", "sums"])

    def own(batches):
        v = np.zeros(size + tail)
        for r in _rows(batches):
            add(v, *r)
        for k in range(0, size, PIECE):
            if (x := v[k : min(k + PIECE, size)]).any():
                yield batch(k // PIECE, x)
        yield batch(-1, v[size:])

    def all_of(batches):
        v: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column("piece").to_pylist(), b.column("sums")):
                x = np.frombuffer(x.as_buffer(), of(k))
                v[k] = v[k] + x if k in v else x.astype(float)
        for k, x in v.items():
            yield batch(k, x)

    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        pieces = "piece int, sums binary"
        # as many sums as run at a time
        parts = blobs.coalesce(spark.sparkContext.defaultParallelism).mapInArrow(own, pieces).repartition("piece").mapInArrow(all_of, pieces)
        out, end = np.zeros(size, kind), np.zeros(tail)
        for r in parts.collect():
            if r["piece"] < 0:
                end[:] = np.frombuffer(r["sums"], float)
            else:
                out[r["piece"] * PIECE :][:PIECE] = np.frombuffer(r["sums"], kind)
        return out, end
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


class LinearModel:
    """Classes in ascending order, coefficients (slot, class) and intercepts."""

    def __init__(self, labels: list[int], coefficients: np.ndarray, intercepts: np.ndarray):
        self.labels, self.coefficients, self.intercepts = labels, coefficients, intercepts

    def predict(self, blobs: DataFrame) -> DataFrame:
        """(label, prediction) of every row, the lower class on a tie."""
        model = blobs.sparkSession.sparkContext.broadcast((self.coefficients, self.intercepts))
        names = np.array(self.labels, np.int32)

        def best(batches):
            for y, first, _, slots, values in _rows(batches):
                m = _margins(*model.value, first, slots, values)
                yield pa.RecordBatch.from_arrays([pa.array(y), pa.array(names[m.argmax(1)])], ["label", "prediction"])

        return blobs.mapInArrow(best, "label int, prediction int")


def _margins(coefficients, intercepts, first, slots, values):
    x = coefficients[slots]
    x *= values[:, None]
    return np.add.reduceat(x, first, axis=0, dtype=float) + intercepts


def fit(blobs: DataFrame, counts: dict[int, int], features: int, reg: float, iterations: int) -> LinearModel:
    """Fitted by L-BFGS to rows whose class weights are balanced by counts, the documents of each label: mean log loss plus
    reg / 2 times the squares of the coefficients of features of unit deviation. As they have deviation 0, slots
    without entries or with the same value everywhere have coefficient 0."""
    labels = sorted(counts)
    n, k, context = features, len(labels), blobs.sparkSession.sparkContext
    names, weights = np.array(labels, np.int32), np.array([sum(counts.values()) / (k * counts[x]) for x in labels])

    def moments(v, y, first, row, slots, values):
        w, x = weights[np.searchsorted(names, y)], values.astype(float)
        v[:n] += np.bincount(slots, w[row] * x, n)
        v[n : 2 * n] += np.bincount(slots, w[row] * x * x, n)
        v[2 * n :] += w.sum(), (w * w).sum()

    v, (total, squares) = _summed(blobs, 2 * n, 2, moments)
    if not total:
        raise ValueError("no rows to fit")
    mean = v[:n] / total
    spread = np.sqrt(np.maximum(v[n:] - mean * v[:n], 0) / max(total - squares / total, 1e-300))
    scale = np.divide(1, spread, out=np.zeros(n), where=spread > 1e-12)
    shift = mean * scale  # features are centred, which leaves rows sparse and only moves intercepts

    def model(p):
        b = p[: n * k].reshape(n, k)
        return b * scale[:, None].astype(np.float32), p[n * k :] - np.array([shift @ b[:, c] for c in range(k)])

    def loss(p):
        shared = context.broadcast(model(p))

        def add(v, y, first, row, slots, values):
            at, i = np.searchsorted(names, y), np.arange(len(y))
            m = _margins(*shared.value, first, slots, values)
            m -= m.max(1, keepdims=True)
            e = np.exp(m)
            s, w = e.sum(1), weights[at]
            v[-1] += (w * (np.log(s) - m[i, at])).sum()
            e /= s[:, None]
            e[i, at] -= 1
            e *= w[:, None]
            v[n * k : -1] += e.sum(0)
            for c in range(k):
                v[c * n : (c + 1) * n] += np.bincount(slots, e[row, c] * values, n)

        v, end = _summed(blobs, n * k, k + 1, add, np.float32)
        shared.destroy()
        end /= total
        g = np.empty(n * k + k, np.float32)
        g[n * k :] = end[:-1]
        b = g[: n * k].reshape(n, k)
        b[:] = v.reshape(k, n).T
        for c in range(k):
            b[:, c] *= scale / total
            b[:, c] -= shift * end[c]
        b += np.float32(reg) * p[: n * k].reshape(n, k)
        return end[-1] + reg / 2 * _dot(p[: n * k], p[: n * k]), g

    return LinearModel(labels, *model(minimum(loss, np.zeros(n * k + k, np.float32), iterations)))


def _dot(a: np.ndarray, b: np.ndarray) -> float:
    return sum(float(a[i : i + PIECE] @ b[i : i + PIECE]) for i in range(0, len(a), PIECE))


def minimum(f: Callable, x: np.ndarray, iterations: int) -> np.ndarray:
    """Where f, which gives the value and gradient of a convex function, is least, by L-BFGS from x, in x's precision. It ends
    when ten steps change the value by less than TOLERANCE of the first, or the gradient is as small."""
    past: deque = deque(maxlen=MEMORY)
    y, g = f(x)
    values = [y]
    for _ in range(iterations):
        size = _dot(g, g) ** 0.5
        if size <= max(TOLERANCE * abs(y), 1e-8) or len(values) > 10 and values[-11] - y <= TOLERANCE * abs(values[0]):
            break
        d, alphas = -g, []
        for s, z, r in reversed(past):
            alphas.append(r * _dot(s, d))
            d -= alphas[-1] * z
        d *= 1 / (past[-1][2] * _dot(past[-1][1], past[-1][1])) if past else 1 / size
        for (s, z, r), a in zip(past, reversed(alphas)):
            d += (a - r * _dot(z, d)) * s
        slope = _dot(g, d)
        if slope >= 0:
            past.clear()
            d, slope = g / -size, -size
        t = 1.0
        for _ in range(20):
            x1 = x + t * d
            y1, g1 = f(x1)
            if y1 <= y + 1e-4 * t * slope:
                break
            t = min(max(-slope * t * t / (2 * (y1 - y - t * slope)), 0.1 * t), 0.5 * t)
        else:
            break
        x -= x1  # x and g become the step and the change of the gradient, with their signs turned
        g -= g1
        if (sz := _dot(x, g)) > 0:
            past.append((x, g, 1 / sz))
        x, y, g = x1, y1, g1
        values.append(y)
        del x1, g1, d
    return x
