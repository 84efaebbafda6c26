"""Toxicity by averaged subword embeddings and a linear softmax.

A word is the bag of its character n-grams (3 to 5 bytes, with marks for its
ends) and of itself, each hashed to a bucket that has an embedding. A word's
vector is the mean over its bag, a document's the mean over its distinct words, and a
linear softmax over the two labels follows; embeddings and softmax are trained
together in numpy, on all rows of the sample in each step. A bucket's vector is
scaled by how rare it is, so that the n-grams of every sentence don't drown the
few that tell; weight decay holds back what few documents have. A misspelt word
that training never saw still shares most of its n-grams' vectors.

Trained on a bounded sample: at most max_rows_per_label whole texts of either
label, those of the least hashes of their ids, and of these no more than
max_chars code points (a text that would go beyond is passed over), weighted so
that the labels count as in all labelled rows. Of texts of one id the least in
order is learned from. Every text is scored whole. Null and empty texts have no
words; their score is that of the trained bias. Without labelled rows of both
labels each score is the share of the label that there is (0 if none). A label
other than 0 or 1, or null, isn't learned from. Rows are independent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.llm._common import chunks, session, text_or_empty, tidy, written
from gossamer.llm._words import Memory

BUCKETS = 1 << 16
DIM = 8
_MIX = np.uint64(0x9E3779B97F4A7C15)
_ENDS = ".,;:!?\"'()[]{}<>*#%&$|-_/\\"


def bag(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of each word, one after the other, and how many each has."""
    bare = [w.strip(_ENDS) for w in words]
    marked = [f"<{w}>".encode() if w else b"" for w in bare]
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    b = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), size)
    found, of = [], []
    for n in (3, 4, 5):
        if len(b) < n:
            break
        h = np.full(len(b) - n + 1, n, np.uint64)
        for k in range(n):
            h = (h ^ b[k : len(b) - n + 1 + k]) * _MIX
            h ^= h >> np.uint64(29)
        inside = word[: len(h)] == word[n - 1 :]
        found.append(h[inside])
        of.append(word[: len(h)][inside])
    some = np.flatnonzero(size)
    if len(some):
        found.append(pd.util.hash_array(np.array([bare[i] for i in some], object), categorize=False).astype(np.uint64))
        of.append(some)
    if not found:
        return np.empty(0, np.int64), np.zeros(len(words), np.int64)
    flat, of_all = np.concatenate(found), np.concatenate(of)
    order = np.argsort(of_all, kind="stable")
    return (flat[order] >> np.uint64(48)).astype(np.int64) % BUCKETS, np.bincount(of_all, minlength=len(words))


def features(texts: list[str], memory: Memory) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each text as buckets and their weights in the mean over distinct words of the means over bags."""
    for codes in memory.codes([t.lower().split() for t in texts]):
        flat, size = memory.values(np.unique(codes))
        x = np.bincount(flat, np.repeat(1 / np.maximum(size, 1), size), BUCKETS) / max((size > 0).sum(), 1)
        at = np.flatnonzero(x)
        yield at.astype(np.int32), x[at].astype(np.float32)


@dataclass
class Model:
    bucket: np.ndarray  # each bucket's part of the logit: its embedding times the softmax weights' difference
    bias: float

    def scores(self, texts: list[str], memory: Memory) -> list[float]:
        out = []
        for codes in memory.codes([t.lower().split() for t in texts]):
            got, size = memory.values(np.unique(codes))
            n = size.sum()
            out.append(float(1 / (1 + np.exp(-(got.sum() / n if n else 0.0) - self.bias))))
        return out

    def word_logits(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The mean over each word's bag; a word without letters or digits has none."""
        flat, size = bag(words)
        has = size > 0
        total = np.bincount(np.repeat(np.arange(len(words)), size), self.bucket[flat], len(words))
        return total[has] / size[has], has.astype(np.int64)


class Rows:
    """Documents as rows of buckets and weights; products with all of them, so many entries at a time."""

    def __init__(self, docs: list[tuple[np.ndarray, np.ndarray]], most: int = 1_000_000):
        self.parts: list[tuple[slice, np.ndarray, np.ndarray, np.ndarray]] = []
        self.n, at = len(docs), 0
        while at < len(docs):
            end, size = at, 0
            while end < len(docs) and (end == at or size + len(docs[end][0]) <= most):
                size += len(docs[end][0])
                end += 1
            own = docs[at:end]
            self.parts.append((slice(at, end), np.concatenate([b for b, _ in own]).astype(np.int32), np.concatenate([w for _, w in own]).astype(np.float32), np.array([len(b) for b, _ in own])))
            at = end

    def times(self, u: np.ndarray) -> np.ndarray:
        """Each row's weighted sum of u over its buckets."""
        out = np.zeros(self.n)
        for rows, b, w, size in self.parts:
            out[rows] = np.bincount(np.repeat(np.arange(len(size)), size), w * u[b], len(size))
        return out

    def back(self, r: np.ndarray, power: int = 1) -> np.ndarray:
        """Each bucket's sum over rows of r times the weight there to a power."""
        out = np.zeros(BUCKETS)
        for rows, b, w, size in self.parts:
            out += np.bincount(b, np.repeat(r[rows], size) * w**power, BUCKETS)
        return out


def train(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, importance: np.ndarray, *, steps: int = 100, rate: float = 0.02, decay: float = 0.01, least_docs: int = 3, floor: float = 2e-4, seed: int = 7) -> Model:
    """Embeddings and softmax together, from documents given as buckets and weights, by RMSProp with momentum and a falling rate.

    Of two labels the softmax sees the difference of their weights only, so a
    row's gradient is its residual along that difference: one product with all
    rows a step, whatever DIM is. Buckets of fewer than least_docs documents
    have no vector; floor bounds how much a rare one is scaled up.
    """
    rng = np.random.default_rng(seed)
    rows, share = Rows(docs), importance / importance.sum()
    even = np.full(rows.n, 1 / max(1, rows.n))
    scale = (rows.back(np.ones(rows.n), 0) >= least_docs) / (np.sqrt(rows.back(even, 2)) + floor)
    mean = rows.back(even)
    emb, out = rng.normal(0, 1e-3, (BUCKETS, DIM)), rng.normal(0, DIM**-0.5, (DIM, 2))
    prior = float((share * labels).sum())
    bias = np.log(prior / (1 - prior))
    held: list[tuple[np.ndarray, np.ndarray]] | None = None
    for step in range(steps):
        turn = out[:, 1] - out[:, 0]
        u = scale * (emb @ turn)
        z = rows.times(u) - mean @ u + bias
        r = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - labels) * share
        g = scale * (rows.back(r) - mean * r.sum())
        along = emb.T @ g
        grads = (np.outer(g, turn) + decay * emb, np.stack((-along, along), axis=1))
        held = [(0.9 * m + 0.1 * x, 0.9 * q + 0.1 * x * x) for (m, q), x in zip(held, grads, strict=True)] if held else [(0.1 * x, x * x) for x in grads]
        left = rate * (1 - step / steps)
        emb -= left * held[0][0] / np.sqrt(held[0][1] + 1e-14)
        out -= 0.1 * left * held[1][0] / np.sqrt(held[1][1] + 1e-14)
        bias -= 5 * left * r.sum()
    u = scale * (emb @ (out[:, 1] - out[:, 0]))
    return Model(u, float(bias - mean @ u))


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_rows_per_label: int = 2000, max_chars: int = 32_000_000) -> Model:
    """Learns from the texts of docs that labels has a 0 or 1 for. What is broadcast is the sample's ids, two times max_rows_per_label at most."""
    spark = session(docs)
    rows = labels.select(F.col(doc_id).cast("string").alias("id"), F.col(label).cast("int").alias("y")).where("y in (0, 1) and id is not null").distinct()
    total = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(total) < 2:
        return Model(np.zeros(BUCKETS), 40.0 if 1 in total else -40.0)
    first = [F.xxhash64("id"), F.col("id")]
    chosen = rows.where("y = 0").orderBy(*first).limit(max_rows_per_label).unionByName(rows.where("y = 1").orderBy(*first).limit(max_rows_per_label))
    sample = docs.select(F.col(doc_id).cast("string").alias("id"), text_or_empty(text).alias("text")).join(F.broadcast(chosen), "id")
    sample = written(sample.groupBy("id", "y").agg(F.min("text").alias("text")).withColumn("h", F.xxhash64("id")), "toxicity-sample")
    kept, so_far = [], 0
    for r in sorted(sample.select("h", "id", "y", F.length("text").alias("n")).collect()):
        if so_far + r["n"] <= max_chars:
            so_far += r["n"]
            kept.append((r["id"], r["y"]))
    got = sorted(sample.join(F.broadcast(spark.createDataFrame(kept, "id string, y int")), ["id", "y"]).select("id", "y", "text").collect()) if kept else []
    y = np.array([r["y"] for r in got], np.int64)
    n = np.bincount(y, minlength=2)
    if not n.all():
        return Model(np.zeros(BUCKETS), float(np.log(total[1] / total[0])))
    weight = np.array([total[0] / n[0], total[1] / n[1]])
    memory = Memory(bag, 100_000)
    return train([x for part in chunks([r["text"] for r in got]) for x in features(part, memory)], y, weight[y])


def score(docs: DataFrame, model: Model, *, text: str = "text", name: str = "score") -> DataFrame:
    """Adds (or replaces) the score of each whole text: how likely label 1 is."""
    session(docs)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memory = Memory(model.word_logits)
        for values in batches:
            yield pa.array([s for part in chunks(values) for s in model.scores(part, memory)], pa.float64())

    return docs.withColumn(name, F.arrow_udf(tidy(run), "double", F.ArrowUDFType.SCALAR_ITER)(F.col(text).cast("string")))
