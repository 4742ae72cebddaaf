"""Text quality by positive-unlabelled learning (operator 6)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm.common import P

#: Rows of each kind (trusted positives, unlabelled) that the model is fitted on at most; they are the
#: first by a seeded hash of the key, so the sample is the same in every run.
SAMPLE = 12_000

_CLASSES = np.zeros((256, 9))
for _k, _chars in enumerate([b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:", b"!?", b"'\"()-", bytes(range(0x80, 0x100))]):
    _CLASSES[list(_chars), _k] = 1
N_FEATURES = 9 + 1 + 13


def features(text: bytes) -> list[float]:
    """What a text looks like, from all of it: shares of kinds of bytes, words, repetition, lines."""
    n = len(text)
    if not n:
        return [0.0] * N_FEATURES
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    shares = hist @ _CLASSES / n
    words = text.split()
    count = len(words) or 1
    kinds = set(words)
    lines = text.split(b"\n")
    bare = sum(map(len, kinds)) / (len(kinds) or 1)
    repeated = 1 - len(set(zip(words, words[1:]))) / max(1, count - 1)
    same = sum(map(bytes.__eq__, words, words[1:])) / count
    packed = len(zlib.compress(text, 1)) / n
    odd = 1 - shares.sum()
    return [
        *shares, odd, np.log1p(n) / 10, sum(map(len, words)) / count / 10, bare / 10, len(kinds) / count, np.log1p(len(kinds)) / np.log1p(count),
        repeated, same, packed, sum(map(bytes.isupper, words)) / count, sum(map(bytes.isalpha, words)) / count, len(lines) / count, len(set(lines)) / len(lines), sum(map(bytes.istitle, words)) / count,
    ]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit_nnpu(pos: np.ndarray, unl: np.ndarray, prior: float, *, hidden: int = 16, steps: int = 1500, batch: int = 512, rate: float = 0.01, seed: int = 5) -> Model:
    """Minimises the non-negative unbiased risk  prior R_p(+) + max(0, R_u(-) - prior R_p(-))  with the
    sigmoid loss, for a network with one hidden layer.  Where a batch's estimate of the negative risk falls
    below zero, the step goes against it instead, as the method has it."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([pos, unl])
    mean, scale = both.mean(0), both.std(0) + 1e-6
    p_all, u_all = (pos - mean) / scale, (unl - mean) / scale
    par = [rng.normal(0, 1 / np.sqrt(both.shape[1]), (both.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m, v = [np.zeros_like(x) for x in par], [np.zeros_like(x) for x in par]
    for t in range(1, steps + 1):
        p, u = p_all[rng.integers(0, len(p_all), batch)], u_all[rng.integers(0, len(u_all), batch)]
        x = np.concatenate([p, u])
        h = np.tanh(x @ par[0] + par[1])
        s = 1 / (1 + np.exp(-np.clip(h @ par[2] + par[3], -30, 30)))  # loss of -1; 1 - s is the loss of +1
        ds = s * (1 - s)
        sp, su = s[: len(p)], s[len(p) :]
        if su.mean() - prior * sp.mean() >= 0:
            g = np.concatenate([-2 * prior * ds[: len(p)] / len(p), ds[len(p) :] / len(u)])
        else:
            g = np.concatenate([prior * ds[: len(p)] / len(p), -ds[len(p) :] / len(u)])
        gh = np.outer(g, par[2]) * (1 - h * h)
        grad = [x.T @ gh + 1e-4 * par[0], gh.sum(0), h.T @ g + 1e-4 * par[2], np.array([g.sum()])]
        for k in range(4):
            m[k] = 0.9 * m[k] + 0.1 * grad[k]
            v[k] = 0.999 * v[k] + 0.001 * grad[k] ** 2
            par[k] = par[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return Model(mean, scale, par[0], par[1], par[2], float(par[3][0]))


def class_prior(labels: DataFrame, label: str) -> float:
    """The share of positives among the labelled rows, kept off 0 and 1."""
    r = labels.agg(F.avg(F.when(F.col(label) == 1, 1.0).when(F.col(label) == 0, 0.0))).first()[0]
    return min(0.98, max(0.02, r if r is not None else 0.5))


def train(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", label: str = "quality", sample: int = SAMPLE, seed: int = 11) -> Model | None:
    """Fits the model on `sample` trusted positives (rows of labels with 1) and as many texts of docs taken
    as unlabelled.  Where rows share a key, the one with the least hash of its text is learned from.  Null keys
    and labels aren't learned from.  None if there is no positive at all."""
    ids = lambda d, kind: d.where(F.col(key).isNotNull()).select(F.col(key).alias(f"{P}id")).distinct().orderBy(F.xxhash64(F.lit(seed), f"{P}id"), f"{P}id").limit(sample).withColumn(f"{P}kind", F.lit(kind))
    chosen = ids(labels.where(F.col(label) == 1), 1).unionByName(ids(docs, 0))
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    picked = docs.select(F.col(key), body.alias(f"{P}t")).join(F.broadcast(chosen), F.col(key) == F.col(f"{P}id"))
    one = picked.groupBy(f"{P}kind", f"{P}id").agg(F.min(F.struct(F.xxhash64(f"{P}t").alias("h"), F.col(f"{P}t").alias("t"))).alias("r")).select(f"{P}kind", F.col("r.t").alias(f"{P}t"))  # 2 x sample rows

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([features(t.as_py()) for t in b.column(1)], pa.list_(pa.float64()))], names=["kind", "x"])

    rows = one.mapInArrow(measure, "kind int, x array<double>").toArrow()
    kind = rows.column("kind").to_numpy()
    if not (kind == 1).any():
        return None
    x = np.array(rows.column("x").to_pylist(), np.float64).reshape(-1, N_FEATURES)
    order = np.lexsort((*x.T, kind))  # the same batches whatever order the rows came in
    x, kind = x[order], kind[order]
    return fit_nnpu(x[kind == 1], x[kind == 0], class_prior(labels, label))


def score(df: DataFrame, model: Model | None, text: str = "text", out: str = "score") -> DataFrame:
    """df and `out`, the model's score of every whole text (null counts as empty; without a model 1).  An
    empty text has no features but is scored like any other."""
    cols = [c for c in df.columns if c != out]
    if model is None:
        return df.select(*cols, F.lit(1.0).alias(out))

    @F.pandas_udf("double")
    def rate(texts):
        import pandas as pd

        x = np.array([features(t) for t in texts], np.float64).reshape(-1, N_FEATURES)
        return pd.Series(model.score(x))

    return df.select(*cols, rate(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias(out))


def held_out(key: str) -> F.Column:
    """Rows whose labels are never learned from: crc32 of the key as text, remainder 2 by 4."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))
