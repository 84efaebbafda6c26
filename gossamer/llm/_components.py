"""Connected components by stars around least neighbours, with joins and partial aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.llm._common import written


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for each node of the edges a, b.

    In each round every node links itself and all its neighbours to the least
    of them, until only stars are left. A node keeps no more neighbours than it
    has, rounds are written to the shared folder, and no node's neighbours are
    ever gathered in one place. No edges: no rows.
    """
    e = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    seen = None
    while True:
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not mark[0] or tuple(mark) == seen:
            break
        seen = tuple(mark)
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written before it is joined, so that Spark can split the rows of a node with many neighbours
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        linked = both.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        e = written(linked.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    return e.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("root")), F.struct(F.col("b").alias("node"), F.col("b").alias("root")))).alias("x")).select("x.*").distinct()
