"""The observation log as a stream: each micro-batch is classified against the states so far and merged into them.

A batch's states are a folder of their own, named by the batch; which one is
current stands in a pointer file that is replaced in one step. A batch that is
replayed after a failure starts from the states before it, so it changes
nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gossamer.operators import change

STATE = "key string, content_sha256 string, semantic_sha256 string, first_seen_at double, last_seen_at double, last_changed_at double, change_count long, last_change_kind string, recrawl_interval_seconds double"
OBSERVATION = "key string, observed_at double, status int, content_sha256 string, semantic_sha256 string"


class StateTable:
    """Snapshots below a folder; snapshot(n) holds the states after batch n."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _has(self, name: str) -> bool:
        return self._fs().exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"))

    def before(self, batch: int) -> DataFrame:
        """States after the latest batch that is complete and earlier than this."""
        for n in range(batch - 1, -1, -1):
            if self._has(f"batch={n}/_SUCCESS"):
                return self.spark.read.schema(STATE).parquet(f"{self.path}/batch={n}")
        return self.spark.createDataFrame([], STATE)

    def publish(self, states: DataFrame, batch: int) -> None:
        states.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")


def merge(states: DataFrame, batch: DataFrame, policy: change.RecrawlPolicy) -> DataFrame:
    """states after a batch of observations; late ones count where their time puts them within the batch."""
    known = states.select("key", F.col("last_seen_at").alias("observed_at"), F.lit(None).cast("int").alias("status"), "content_sha256", "semantic_sha256", F.lit(0).alias("own"))
    log = known.unionByName(batch.select("key", "observed_at", "status", "content_sha256", "semantic_sha256", F.lit(1).alias("own")))
    # what is known comes before whatever the batch has
    log = log.withColumn("place", F.struct("own", "observed_at"))
    seen = change.classify(log, ["key"], "place").where("own = 1 and kind <> 'error'")
    new = seen.groupBy("key").agg(
        F.min("observed_at").alias("first"), F.max("observed_at").alias("last"), F.max(F.when(change.changed(F.col("kind")) | (F.col("kind") == "new"), F.col("observed_at"))).alias("changed"), F.count_if(change.changed(F.col("kind"))).alias("n"), F.max_by("kind", "place").alias("kind"),
        F.max_by(F.struct("content_sha256", "semantic_sha256"), F.when(F.col("content_sha256").isNotNull(), F.col("place"))).alias("prints"), F.sort_array(F.collect_list(F.struct("place", "kind"))).alias("history"),
    )
    j = states.join(new, "key", "full_outer")
    interval = F.when(F.col("history").isNull(), F.col("recrawl_interval_seconds")).otherwise(F.aggregate(F.transform("history", lambda x: x["kind"]), F.coalesce("recrawl_interval_seconds", F.lit(0.0)), lambda held, kind: F.coalesce(policy.next_interval(kind, held), held)))
    return j.select(
        "key", F.coalesce("prints.content_sha256", "content_sha256").alias("content_sha256"), F.coalesce("prints.semantic_sha256", "semantic_sha256").alias("semantic_sha256"), F.coalesce("first_seen_at", "first").alias("first_seen_at"), F.coalesce("last", "last_seen_at").alias("last_seen_at"),
        F.coalesce("changed", "last_changed_at").alias("last_changed_at"), (F.coalesce("change_count", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("long").alias("change_count"), F.coalesce("kind", "last_change_kind").alias("last_change_kind"), interval.alias("recrawl_interval_seconds"),
    )


def run(observations: DataFrame, table: StateTable, checkpoint: str, policy: change.RecrawlPolicy | None = None, **trigger):
    """Starts the query over a stream of OBSERVATION rows; trigger: availableNow=True, or processingTime=..."""
    policy = policy or change.RecrawlPolicy()

    def one(batch: DataFrame, n: int) -> None:
        table.publish(merge(table.before(n), batch, policy), n)

    return observations.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
