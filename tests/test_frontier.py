import random

from pyspark.sql import functions as F

from gossamer.operators import frontier

ROW = "crawl_id string, url string, queue_key string, priority long, depth int, available_at double, metadata_json string, state string, attempt int, lease_token string, lease_expires_at double, error string, sequence long"
QUEUE = "crawl_id string, queue_key string, max_concurrency int, delay_seconds double, blocked_until double, crawl_limit long, active long, issued long, next_allowed_at double"


def greedy(rows, queues, budget, limit, now):
    """The walk that lease() has to equal: a crawl's requests in order, one at a time."""
    q = {x[1]: dict(active=x[6], issued=x[7], cap=x[2], delay=x[3], blocked=x[4], most=x[5], next=x[8]) for x in queues}
    out, spent = [], 0
    for r in sorted((r for r in rows if r[7] == "queued" and r[5] <= now), key=lambda r: (-r[3], r[5], r[12])):
        s = q[r[2]]
        if len(out) >= limit:
            break
        if s["blocked"] > now or s["next"] > now or s["active"] >= s["cap"] or (s["most"] is not None and s["issued"] >= s["most"]):
            continue
        if r[8] == 0 and budget is not None and spent >= budget:
            continue
        spent += r[8] == 0
        s["active"], s["issued"] = s["active"] + 1, s["issued"] + 1
        if s["delay"] > 0:
            s["next"] = now + s["delay"]
        out.append(r[1])
    return out


def test_lease_is_the_greedy_walk(spark):
    rng = random.Random(5)
    rows, queues, crawls, expected = [], [], [], {}
    for k in range(60):
        crawl, own, own_q = f"c{k}", [], []
        for n in range(rng.randint(1, 4)):
            own_q.append((crawl, f"q{n}", rng.randint(1, 3), rng.choice([0.0, 0.0, 2.0]), rng.choice([0.0, 0.0, 0.0, 200.0]), rng.choice([None, None, rng.randint(1, 4)]), rng.randint(0, 1), rng.randint(0, 2), rng.choice([0.0, 0.0, 150.0])))
        for n in range(rng.randint(0, 14)):
            own.append((crawl, f"u{n}", rng.choice(own_q)[1], rng.randint(0, 2), 0, float(rng.choice([50, 99, 101])), None, rng.choice(["queued"] * 4 + ["done"]), rng.choice([0, 0, 1]), None, 0.0, None, n))
        budget = rng.choice([None, 0, 1, 2, 5])
        limit = 6
        expected[crawl] = greedy(own, own_q, budget, limit, 100.0)
        rows += own
        queues += own_q
        crawls.append((crawl, None if budget is None else budget + 7, 7))
    f, q, w = spark.createDataFrame(rows, ROW), spark.createDataFrame(queues, QUEUE), spark.createDataFrame(crawls, "crawl_id string, crawl_limit long, issued long")
    got = {}
    for r in frontier.lease(f, q, w, limit=6, lease_seconds=5.0, now=100.0).orderBy("crawl_id", "pos").collect():
        got.setdefault(r["crawl_id"], []).append(r["url"])
    assert got == {k: v for k, v in expected.items() if v}


def tables(spark, *urls, **queue):
    rows = [("c", u, "q", p, 0, 0.0, None, "queued", 0, None, 0.0, None, k) for k, (u, p) in enumerate(urls)]
    held = {"max_concurrency": 2, "delay_seconds": 0.0} | queue
    q = [("c", "q", held["max_concurrency"], held["delay_seconds"], 0.0, None, 0, 0, 0.0)]
    return spark.createDataFrame(rows, ROW), spark.createDataFrame(q, QUEUE), spark.createDataFrame([("c", None, 0)], "crawl_id string, crawl_limit long, issued long")


def step(spark, f, q, w, now):
    """A call and its tables, held as rows between calls."""
    got = frontier.lease(f, q, w, limit=10, lease_seconds=5.0, now=now)
    leases = spark.createDataFrame(got.collect(), got.schema)
    new = frontier.apply_leases(f, q, w, leases, now)
    return leases, *(spark.createDataFrame(x.collect(), x.schema) for x in new)


def test_expired_leases_come_back_with_a_new_attempt(spark):
    f, q, w = tables(spark, ("a", 1))
    first, f, q, w = step(spark, f, q, w, 100.0)
    none, f, q, w = step(spark, f, q, w, 104.0)
    again, f, q, w = step(spark, f, q, w, 106.0)
    a, b = first.first(), again.first()
    assert none.count() == 0 and b["attempt"] == 2 and a["lease_token"] != b["lease_token"]
    assert [r["active"] for r in q.collect()] == [1] and [r["issued"] for r in w.collect()] == [1]


def test_delay_and_concurrency(spark):
    f, q, w = tables(spark, ("a", 1), ("b", 1), max_concurrency=1, delay_seconds=2.0)
    first, f, q, w = step(spark, f, q, w, 100.0)
    done = first.select("crawl_id", "url", "lease_token", F.lit("ack").alias("verb"), F.lit(None).cast("double").alias("available_at"), F.lit(None).cast("string").alias("error"))
    f, q, stale = frontier.apply_outcomes(f, q, done)
    assert stale.count() == 0
    assert frontier.lease(f, q, w, limit=5, lease_seconds=5.0, now=101.0).count() == 0
    assert [r["url"] for r in frontier.lease(f, q, w, limit=5, lease_seconds=5.0, now=102.0).collect()] == ["b"]


def test_add_keeps_the_first_and_ignores_known_urls(spark):
    f, q, w = tables(spark, ("a", 1))
    new = spark.createDataFrame([("c", "b", "q", 10, 0, 0.0, None, 1), ("c", "a", "q", 99, 0, 0.0, None, 2), ("c", "b", "q", 5, 0, 0.0, None, 3)], "crawl_id string, url string, queue_key string, priority long, depth int, available_at double, metadata_json string, n int")
    added = frontier.add(f, new, F.col("n"))
    assert [(r["url"], r["priority"], r["sequence"]) for r in added.collect()] == [("b", 10, 1)]
    assert [r["url"] for r in frontier.lease(f.unionByName(added), q, w, limit=5, lease_seconds=5.0, now=1.0).orderBy("pos").collect()] == ["b", "a"]


def test_a_host_without_a_queue_row_is_leased_once(spark):
    new = spark.createDataFrame([("c", f"http://h/{k}", "h", 0, 0, 0.0, None, "queued", 0, None, 0.0, None, k) for k in range(3)], ROW)
    queues, crawls = spark.createDataFrame([], QUEUE), spark.createDataFrame([], "crawl_id string, crawl_limit long, issued long")
    first = frontier.lease(new, queues, crawls, limit=10, lease_seconds=60.0, now=100.0)
    assert [r["url"] for r in first.collect()] == ["http://h/0"]
    f, q, c = frontier.apply_leases(new, queues, crawls, first, 100.0)
    assert [(r["active"], r["issued"], r["max_concurrency"]) for r in q.collect()] == [(1, 1, 1)] and [r["issued"] for r in c.collect()] == [1]
    assert frontier.lease(f, q, c, limit=10, lease_seconds=60.0, now=101.0).count() == 0
    assert frontier.missing_queues(new, queues).count() == 1 and frontier.missing_crawls(new, crawls).count() == 1
