"""Nearest neighbours by vantage-point trees, one to a shard.

Vectors are dealt by hash to shards of about SHARD_ROWS rows; every row is in
a tree. A node's vantage point is the farthest of a few of its points from the
first; its other points are halved by the median distance to it. A search goes
to the nearer side first and to the other only if, with d the distance to the
vantage point, m the median and t the tenth best distance so far, factor x
|d - m| <= t: with factor 1 the triangle inequality proves that nothing is
lost, a larger one prunes more and may lose neighbours. Queries go to each
shard in blocks of BLOCK_ROWS; the shards' best are merged by query.

Distances are Euclidean, in double precision, on the original vectors. Vectors
that are null, empty, zero, or hold a null or a value that isn't finite take
no part; nor does a vector of another length than the query's meet it. A row
with a null id takes no part either. Rows equal in id and vector count once;
several vectors of one id are candidates each, never for a query of that id,
and as queries they share one list, each candidate at its nearest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gossamer.llm._common import session, written

SHARD_ROWS, BLOCK_ROWS, LEAF_ROWS = 8192, 1024, 64
FACTOR = 1.6


class Tree:
    """A vantage-point tree over rows of x, in arrays."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF_ROWS):
        self.x = x
        self.nodes: list[tuple] = []
        self.root = self.build(np.arange(len(x)), leaf)

    def build(self, rows: np.ndarray, leaf: int) -> int:
        own = len(self.nodes)
        self.nodes.append(())
        if len(rows) <= leaf:
            self.nodes[own] = (rows,)
            return own
        some = rows[:: max(1, len(rows) // 16)]
        v = some[np.argmax(distances(self.x[some], self.x[rows[:1]])[:, 0])]
        rest = rows[rows != v]
        d = distances(self.x[rest], self.x[v : v + 1])[:, 0]
        middle = float(np.median(d))
        near = d <= middle
        if near.all():  # all as far: nothing to halve
            self.nodes[own] = (rows,)
            return own
        self.nodes[own] = (v, middle, self.build(rest[near], leaf), self.build(rest[~near], leaf))
        return own


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean, row by row of a against each of b, by differences: exact, unlike by products."""
    out = np.empty((len(a), len(b)))
    for at in range(0, len(a), max(1, 2_000_000 // max(1, b.size))):
        part = a[at : at + max(1, 2_000_000 // max(1, b.size))]
        out[at : at + len(part)] = np.sqrt(((part[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))
    return out


class Search:
    """The k best of a tree for many queries at once."""

    def __init__(self, tree: Tree, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, k: int, factor: float):
        self.tree, self.ids, self.q, self.q_ids, self.k, self.factor = tree, ids, q, q_ids, k, factor
        self.d = np.full((len(q), k), np.inf)
        self.of = np.full((len(q), k), -1, np.int64)
        self.repeated = len(np.unique(ids)) < len(ids)
        if len(ids) and len(q):
            self.visit(tree.root, np.arange(len(q)))

    def offer(self, who: np.ndarray, rows: np.ndarray, d: np.ndarray) -> None:
        """Rows at these distances; keeps the best, ties to smaller ids; an id counts once."""
        d = np.where(self.ids[rows][None, :] == self.q_ids[who][:, None], np.inf, d)
        worst = self.d[who, -1]
        some = (d <= worst[:, None]).any(axis=1)
        if not some.any():
            return
        who, d = who[some], d[some]
        all_d = np.concatenate((self.d[who], d), axis=1)
        all_of = np.concatenate((self.of[who], np.where(np.isfinite(d), rows[None, :], -1)), axis=1)
        all_id = np.where(all_of >= 0, self.ids[all_of], 2**63 - 1)
        order = np.lexsort((all_id, all_d), axis=1)
        if self.repeated:  # of several vectors of one id the nearest counts
            for r in range(len(who)):
                i = all_id[r, order[r]]
                _, first = np.unique(i, return_index=True)
                later = np.ones(len(i), bool)
                later[first] = False
                all_d[r, order[r][later]], all_of[r, order[r][later]] = np.inf, -1
            order = np.lexsort((np.where(all_of >= 0, all_id, 2**63 - 1), all_d), axis=1)
        order = order[:, : self.k]
        self.d[who], self.of[who] = np.take_along_axis(all_d, order, 1), np.take_along_axis(all_of, order, 1)

    def visit(self, node: int, who: np.ndarray) -> None:
        if not len(who):
            return
        said = self.tree.nodes[node]
        if len(said) == 1:
            self.offer(who, said[0], distances(self.q[who], self.tree.x[said[0]]))
            return
        v, middle, inside, outside = said
        d = distances(self.q[who], self.tree.x[v : v + 1])
        self.offer(who, np.array([v]), d)
        gap = d[:, 0] - middle
        within = gap <= 0
        self.visit(inside, who[within])
        self.visit(outside, who[~within])
        open_ = lambda: self.factor * np.abs(gap) <= self.d[who, -1]
        self.visit(outside, who[within & open_()])
        self.visit(inside, who[~within & open_()])


def usable(vector: Column) -> Column:
    v = vector.cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce((F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def packed(rows: DataFrame, key: str, size: int) -> DataFrame:
    """Rows of key, id, v gathered by key (about size rows each): key, dim, ids, data."""

    def gather(table: pa.Table) -> pa.Table:
        ids = table["id"].to_numpy()
        flat = table["v"].combine_chunks().flatten().to_numpy()
        dim = table["dim"][0].as_py()
        order = np.lexsort((*flat.reshape(-1, dim).T[::-1], ids))
        return pa.table({key: table[key][:1], "dim": table["dim"][:1], "ids": pa.array([ids[order].tobytes()], pa.binary()), "data": pa.array([flat.reshape(-1, dim)[order].tobytes()], pa.binary())})

    return rows.groupBy("dim", key).applyInArrow(gather, f"{key} int, dim int, ids binary, data binary")


def nearest(vectors: DataFrame, queries: Column, *, vec_id: str = "vec_id", vector: str = "embedding", k: int = 10, factor: float = FACTOR, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row that queries (a condition on vectors) selects."""
    session(vectors)
    rows = vectors.where(usable(F.col(vector)) & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("q"))
    rows = written(rows.groupBy("id", "v").agg(F.max("q").alias("q")).withColumn("dim", F.size("v")), "vectors")
    n, asked = rows.agg(F.count("*"), F.count_if("q")).first()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-asked // block_rows))
    deal = lambda of: F.pmod(F.xxhash64("id", "v"), F.lit(of)).cast("int")
    trees = packed(rows.withColumn("shard", deal(shards)), "shard", shard_rows)
    asks = packed(rows.where("q").withColumn("block", deal(blocks)), "block", block_rows).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    asks = asks.select("shard", "dim", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = (None, None, None)
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                if held[0] != (row["shard"], dim):
                    ids = np.frombuffer(row["ids"], np.int64)
                    held = ((row["shard"], dim), ids, Tree(np.frombuffer(row["data"], np.float64).reshape(-1, dim)))
                q_ids = np.frombuffer(row["q_ids"], np.int64)
                found = Search(held[2], held[1], np.frombuffer(row["q_data"], np.float64).reshape(-1, dim), q_ids, k, factor)
                q, at = np.nonzero(found.of >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[q]), pa.array(held[1][found.of[q, at]]), pa.array(found.d[q, at])], names=["query_id", "vec_id", "score"])

    # sizes are estimated without the repetition by shard: no side may be gathered on the driver to be broadcast
    pairs = asks.join(trees.hint("merge"), ["shard", "dim"]).select("shard", "dim", "ids", "data", "q_ids", "q_data")
    best = pairs.mapInArrow(search, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force_sql(k: int = 10) -> str:
    """What an exact search returns, by DuckDB; for recall, not for equality."""
    return f"""
WITH v AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
p AS (SELECT q.vec_id AS query_id, c.vec_id, min(list_distance(q.e, c.e)) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0 GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank, vec_id, score FROM p QUALIFY rank <= {k}
"""
