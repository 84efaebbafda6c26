import json

from pyspark.sql import functions as F

from gossamer.operators import change, discovery, policy
from gossamer.sources import records
from gossamer.sources.replay import SnapshotSource
from gossamer.streaming import observations as stream

LOG = [("a", 2.0, 200, "r1", "s1"), ("a", 3.0, 200, "r2", "s1"), ("a", 4.0, 200, "r3", "s2"), ("a", 5.0, 304, None, None), ("b", 1.0, 304, None, None), ("b", 2.0, 200, "x", "y")]
POLICY = change.RecrawlPolicy(1.0, 10.0, 80.0, 2.0)


def test_history_of_a_resource(spark):
    s = {r["key"]: r for r in change.rollup(spark.createDataFrame(LOG, stream.OBSERVATION), ["key"], POLICY).collect()}
    a = s["a"]
    assert (a["change_count"], a["last_changed_at"], a["last_seen_at"], a["last_change_kind"], a["content_sha256"]) == (2, 4.0, 5.0, "not_modified", "r3")
    assert a["recrawl_interval_seconds"] == 2.0  # new 10, representation 10, semantic 1, not modified 2
    assert s["b"]["first_seen_at"] == 2.0  # a 304 before anything was seen leaves no state


def test_stream_gives_the_same_states_and_replays_change_nothing(spark, tmp_path):
    rows = [x for x in LOG if x[:2] != ("b", 1.0)]
    for k, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, stream.OBSERVATION).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(stream.OBSERVATION).parquet(str(tmp_path / "in"))
        table = stream.StateTable(spark, f"file://{tmp_path}/states")
        stream.run(source, table, str(tmp_path / "cp"), POLICY).awaitTermination()
        assert table.before(k + 1).count() > 0
    own = change.rollup(spark.createDataFrame(rows, stream.OBSERVATION), ["key"], POLICY)
    names = ["key", "first_seen_at", "last_seen_at", "last_changed_at", "change_count", "last_change_kind", "recrawl_interval_seconds", "content_sha256"]
    want = sorted(map(tuple, own.select(names).collect()))
    assert sorted(map(tuple, table.before(2).select(names).collect())) == want
    # batch 1 again: from the states before it, to the same states
    again = spark.createDataFrame(rows[2:], stream.OBSERVATION)
    table.publish(stream.merge(table.before(1), again, POLICY), 1)
    assert sorted(map(tuple, table.before(2).select(names).collect())) == want


def test_moving_averages_and_choice(spark):
    log = spark.createDataFrame([(k, "x", "http:direct", False, 0.0, 100.0, 0.0) for k in range(6)] + [(6, "x", "browser:direct", True, 1.0, 100.0, 0.0)], "n int, context_key string, action string, success boolean, quality double, latency_ms double, cost double")
    stats = policy.action_stats(log, ["context_key", "action"], "n", alpha=0.5)
    actions = spark.createDataFrame([(0, "browser", "direct"), (1, "http", "direct")], "action_pos int, engine string, route string")
    d = spark.createDataFrame([(1, "x"), (2, "new"), (10, "x")], "decision_no long, context_key string")
    got = {r["decision_no"]: r["action"] for r in policy.choose(d, actions, stats, explore_every=10).collect()}
    assert got == {1: "browser:direct", 2: "http:direct", 10: "browser:direct"}


def test_reach_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "parent string, child string")
    got = discovery.reach(edges, spark.createDataFrame([("a",)], "node string"))
    assert {r["node"]: r["depth"] for r in got.collect()} == {"a": 0, "b": 1, "c": 2}


def test_record_files(spark, tmp_path):
    df = spark.createDataFrame([("u", None, ["a"])], "url string, title string, links array<string>")
    records.write_records(df, str(tmp_path / "x.json"))
    assert json.loads((tmp_path / "x.json").read_text()) == [{"url": "u", "title": None, "links": ["a"]}]
    records.write_records(df, str(tmp_path / "x.jsonl"))
    assert spark.read.json(str(tmp_path / "x.jsonl")).first()["url"] == "u"


def test_snapshot_source(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(json.dumps({"requested_url": "u", "url": "u", "status_code": 200, "body": "x", "observed_at": 1.0}) + "\n")
    spark.dataSource.register(SnapshotSource)
    assert spark.read.format("snapshot").option("path", str(tmp_path)).load().where(F.col("status_code") == 200).count() == 1
