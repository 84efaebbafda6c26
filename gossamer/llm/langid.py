"""Language identification by rank-order profiles.

A profile is a language's most frequent letter n-grams (n from 1 to 3, words
padded with a blank on either side) in order of frequency. A document's own
most frequent n-grams are compared with each profile by out-of-place distance:
the sum of the differences of ranks, the profile's length for an n-gram that
the profile lacks. The nearest language wins, ties go to the smaller name.

The profiles are fitted on a bounded sample of labelled rows: about
max_rows_per_lang whole texts of each language, chosen by a hash of the id, of
the max_langs languages that have most rows (ties go to the smaller name).
Every text is predicted whole. Null text, or text without a letter: `und` and
score 0; so is every text if nothing could be learned. Rows are independent:
a null id, repeated ids and repeated rows each give their own row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gossamer.llm._common import chunks, session, tidy, unused
from gossamer.llm._words import Memory

UND = "und"
LONGEST = 3
PAD = ord(" ")
#: How many quartile ranges below the lower quartile a score is far out; scores are counted in bins; fewer rows teach no least score.
FENCE, BINS, ROWS = 3.0, 10_000, 20
#: A score of nothing in common is zero.
TINY = 1e-9


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of each word's runs of letters, each run padded with blanks; an n-gram packs up to three code points."""
    runs: list[str] = []
    size: list[int] = []
    for w in words:
        if w.isalpha():
            x = f" {w} "
        else:
            x = f" {' '.join(''.join(c if c.isalpha() else ' ' for c in w).split())} "
            x = "" if x == "  " else x
        runs.append(x)
        size.append(len(x))
    n = np.array(size, np.int64)
    cp = np.frombuffer("".join(runs).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if not len(cp):
        return np.empty(0, np.int64), np.zeros(len(words), np.int64)
    word = np.repeat(np.arange(len(words)), n)
    found, of = [], []
    key = cp
    for k in range(1, LONGEST + 1):
        if k > 1:
            key = (key[:-1] << 21) | cp[k - 1 :]
        inside = word[: len(key)] == word[k - 1 :]
        # blanks alone tell nothing, nor do n-grams across a blank inside
        good = inside & ((cp[: len(key)] != PAD) if k == 1 else True)
        if k == 3:
            good &= cp[1:-1] != PAD
        found.append(key[good])
        of.append(word[: len(key)][good])
    flat, of_all = np.concatenate(found), np.concatenate(of)
    order = np.argsort(of_all, kind="stable")
    return flat[order], np.bincount(of_all, minlength=len(words))


@dataclass
class Profiles:
    langs: list[str]
    grams: np.ndarray  # sorted, of all languages
    ranks: np.ndarray  # [gram, language]; length where the profile lacks the gram
    length: int

    def distances(self, top: np.ndarray) -> np.ndarray:
        """Out-of-place distance of a document's grams, most frequent first, to each language."""
        at = np.minimum(np.searchsorted(self.grams, top), len(self.grams) - 1)
        known = self.grams[at] == top
        own = np.arange(len(top))[:, None]
        return np.where(known[:, None] & (self.ranks[at] < self.length), np.minimum(np.abs(self.ranks[at] - own), self.length), self.length).sum(axis=0)


class Counter:
    """Counts a document's grams through the word memory, which holds each word's grams."""

    def __init__(self):
        self.words = Memory(grams, 150_000)

    def counts(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text its distinct grams, ascending, and how often it has each."""
        for codes in self.words.codes([t.lower().split() for t in texts]):
            words, times = np.unique(codes, return_counts=True)
            flat, size = self.words.values(words)
            yield summed(flat, np.repeat(times, size))


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, ascending, and the sum of n for each."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(n[order], first)


def most_frequent(gram: np.ndarray, n: np.ndarray, length: int) -> np.ndarray:
    """The most frequent of a document's grams in that order, ties by the gram itself."""
    if len(gram) > length:
        some = n >= np.partition(n, len(n) - length)[len(n) - length]
        gram, n = gram[some], n[some]
    return gram[np.argsort(-n, kind="stable")][:length]


def fit(train: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", length: int = 400, max_rows_per_lang: int = 2000, max_langs: int = 1000) -> Profiles:
    """Learns a profile of `length` n-grams for each language of the rows that have a text and a language."""
    spark = session(train)
    rows = train.select(F.col(doc_id).cast("string").alias("id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("text is not null and lang is not null")
    total = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs).collect()
    if not total:
        return Profiles([], np.empty(0, np.int64), np.empty((0, 0), np.int64), length)
    # hashes lie between -2^63 and 2^63
    below = spark.createDataFrame([(r["lang"], min(1.0, max_rows_per_lang / r["n"]) * 2.0**64 - 2.0**63) for r in total], "lang string, below double")
    sample = rows.join(F.broadcast(below), "lang").where(F.coalesce(F.xxhash64("id").cast("double"), F.lit(0.0)) < F.col("below"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter()
        for batch in batches:
            names, at = batch.column(0).to_pylist(), 0
            for part in chunks(batch.column(1)):
                own: dict[str, list] = {}
                for name, held in zip(names[at:], count.counts(part)):
                    own.setdefault(name, []).append(held)
                at += len(part)
                for name, held in own.items():
                    gram, n = summed(np.concatenate([g for g, _ in held]), np.concatenate([k for _, k in held]))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(gram), pa.string()), pa.array(gram, pa.int64()), pa.array(n.astype(np.int64), pa.int64())], names=["lang", "gram", "n"])

    n = sample.select("lang", "text").mapInArrow(tidy(run), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = [F.desc("n"), F.asc("gram")]
    for keys in (["lang", F.pmod(F.col("gram"), F.lit(64))], ["lang"]):  # first within salts, as one language may have most of the rows
        n = n.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*best))).where(F.col("rank") <= length)
    got = n.collect()
    langs = sorted({r["lang"] for r in got})
    all_grams = np.array(sorted({r["gram"] for r in got}), np.int64)
    ranks = np.full((len(all_grams), len(langs)), length, np.int64)
    for r in got:
        ranks[np.searchsorted(all_grams, r["gram"]), langs.index(r["lang"])] = r["rank"] - 1
    return Profiles(langs, all_grams, ranks, length)


def predict(docs: DataFrame, profiles: Profiles, *, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """Adds (or replaces) the predicted language and how near its profile is: 1 less the distance over the largest possible."""
    session(docs)

    def judge(values: pa.Array, count: Counter) -> pa.Array:
        langs, scores = [], []
        for part in chunks(values):
            for gram, n in count.counts(part):
                top = most_frequent(gram, n, profiles.length)
                if not len(top) or not profiles.langs:
                    langs.append(UND)
                    scores.append(0.0)
                    continue
                d = profiles.distances(top)
                best = int(np.argmin(d))
                langs.append(profiles.langs[best])
                scores.append(float(1 - d[best] / (len(top) * profiles.length)))
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["l", "s"])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        count = Counter()
        for values in batches:
            yield judge(values, count)

    said = F.arrow_udf(tidy(run), "l string, s double", F.ArrowUDFType.SCALAR_ITER)(F.col(text).cast("string"))
    (hidden,) = unused(docs, "said")
    out = docs.withColumn(hidden, said)
    return out.withColumn(pred, F.col(f"{hidden}.l")).withColumn(score, F.col(f"{hidden}.s")).drop(hidden)


def least_scores(told: DataFrame, *, lang: str = "lang", score: str = "score", fence: float = FENCE, rows: int = ROWS) -> dict[str, float]:
    """For each language of the labelled rows, the least score that isn't far below theirs: the lower quartile less fence quartile ranges.

    A language with fewer than so many scored rows teaches nothing: there any score above zero is enough.
    """
    bins: dict[str, list[tuple[int, int]]] = {}
    n = told.where((F.col(score) > 0) & F.col(lang).isNotNull()).groupBy(F.col(lang).cast("string").alias("lang"), F.floor(F.col(score) * BINS).cast("long").alias("bin")).count()
    for r in n.collect():
        bins.setdefault(r["lang"], []).append((r["bin"], r["count"]))
    out = {}
    for name, held in bins.items():
        held.sort()
        upto = np.cumsum([k for _, k in held])
        low, high = (held[int(np.searchsorted(upto, q * upto[-1]))][0] / BINS for q in (0.25, 0.75))
        out[name] = max(TINY, low - fence * (high - low)) if upto[-1] >= rows else TINY
    return out


def accepted(pred: str = "lang_pred", score: str = "score", langs: list[str] | None = None, least: float | dict[str, float] = 0.0) -> Column:
    """Which predictions a corpus keeps: a known language (one of langs, if given) with at least this score, or that of its language."""
    if isinstance(least, dict):
        at = F.lit(TINY)
        for name, x in sorted(least.items()):
            at = F.when(F.col(pred) == name, F.lit(x)).otherwise(at)
    else:
        at = F.lit(least)
    good = (F.col(pred) != UND) & (F.col(score) >= at)
    return good & F.col(pred).isin(langs) if langs is not None else good
