"""Hashed text features and their counts by class, gathered on Spark and small enough for one table."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, tidily

GRAMS = 4096
#: Bytes by kind: letters of either case, digits, blank, line end, bytes of non-ASCII letters; other signs as they are.
_SHAPE = np.arange(256, dtype=np.uint8)
for _lo, _hi, _to in ((97, 122, 97), (65, 90, 65), (48, 57, 48), (128, 255, 97)):
    _SHAPE[_lo : _hi + 1] = _to
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _grams(a: np.ndarray) -> np.ndarray:
    x = a.astype(np.uint32)
    return ((x[:-2] * 0x9E3779B1 + x[1:-1] * 0x85EBCA6B + x[2:] * 0xC2B2AE35) >> np.uint32(20)).astype(np.int64)


def letter_grams(text: str) -> np.ndarray:
    """How often each of GRAMS classes of three lower-cased bytes stands in the whole text."""
    a = _LOWER[np.frombuffer((" " + text + " ").encode("utf-8", "surrogatepass"), np.uint8)]
    return np.bincount(_grams(a), minlength=GRAMS)


def features(text: str) -> np.ndarray:
    """Which features a whole text shows: hashed lower-cased words (8 of 9 places), and shapes of three bytes that make at least a hundredth of it."""
    from .hashing import word_hashes

    raw = text.encode("utf-8", "surrogatepass") + b"\n"
    words, _ = word_hashes(raw, np.array([len(raw) - 1]))
    shape = np.bincount(_grams(_SHAPE[np.frombuffer(b" " + raw, np.uint8)]), minlength=GRAMS)
    return np.concatenate([np.unique(words % np.uint64(8 * GRAMS)).astype(np.int64), 8 * GRAMS + np.flatnonzero(100 * shape >= len(raw))])


def gram_counts(df: DataFrame) -> DataFrame:
    """(label, t) -> label, gram, n: summed by task, then over all."""

    def run(frames):
        sums: dict = {}
        for x in frames:
            for label, t in zip(x["label"], x["t"], strict=True):
                sums[label] = sums.get(label, 0) + letter_grams(t)
        for label, n in sums.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"label": label, "gram": at, "n": n[at]})

    return df.mapInPandas(tidily(run), "label string, gram long, n long").groupBy("label", "gram").agg(F.sum("n").alias("n"))


def feature_counts(df: DataFrame) -> DataFrame:
    """(y, z, t) -> feature, n, y, z: how many texts show it, and of how many each label is 1."""

    def run(frames):
        sums = np.zeros((9 * GRAMS, 3))
        for x in frames:
            for y, z, t in zip(x["y"], x["z"], x["t"], strict=True):
                sums[features(t)] += (1, y, z)
        at = np.flatnonzero(sums[:, 0])
        yield pd.DataFrame({"feature": at, "n": sums[at, 0], "y": sums[at, 1], "z": sums[at, 2]})

    return df.mapInPandas(tidily(run), "feature long, n double, y double, z double").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("y").alias("y"), F.sum("z").alias("z"))


def odds(n: np.ndarray, ones: np.ndarray, rows: float, total: float, clear: float = 15.0) -> np.ndarray:
    """Each feature's log-likelihood ratio for label 1, by counts with half a text added; 0 unless its chi-square is at least `clear`."""
    zeros, p = n - ones, min(max(total / max(rows, 1), 1e-9), 1 - 1e-9)
    chi = (ones - n * p) ** 2 / np.maximum(n * p * (1 - p), 1e-9)
    llr = np.log((ones + 0.5) / (total + 1)) - np.log((zeros + 0.5) / (rows - total + 1))
    return np.where((chi >= clear) & (n >= 3), llr, 0.0)


def logistic(x: np.ndarray, y: np.ndarray) -> list[float]:
    """A slope for each column of x and a shift, of a logistic fit with a little ridge toward slopes of 1."""
    x = np.column_stack([x, np.ones(len(x))])
    toward, ridge = np.append(np.ones(x.shape[1] - 1), 0.0), np.append(np.ones(x.shape[1] - 1), 0.1)
    w = toward.copy()
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * (w - toward)
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge)
        w = w - np.clip(np.linalg.solve(h, g), -1, 1)
    return w.tolist()


def scored(df: DataFrame, columns: str, score, names: list[str], beside: str | None = None) -> DataFrame:
    """df (columns..., t) with t replaced by what score(text) returns, a tuple of doubles named names; beside: a column whose value score takes too."""
    keep = [c for c in df.columns if c != "t"]

    def run(batches):
        for b in chunks(batches, 2000):
            at = lambda c: b.column(b.schema.get_field_index(c))  # noqa: B023, E731
            out = [score(*x) for x in zip(*[at(c).to_pylist() for c in (["t", beside] if beside else ["t"])], strict=True)]
            grid = np.array(out, float).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([at(c) for c in keep] + [pa.array(grid[:, i]) for i in range(len(names))], names=keep + names)

    return df.mapInArrow(tidily(run), columns + "".join(f", `{n}` double" for n in names))
