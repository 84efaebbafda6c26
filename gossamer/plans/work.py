"""Queries over the frontier, stores, claims, lifecycles, routes and walks."""

from __future__ import annotations

from pyspark.sql import functions as F

from gossamer.functions import urls
from gossamer.operators import discovery, frontier, policy, store
from gossamer.plans import duck
from gossamer.plans.pages import rel
from gossamer.plans.relations import NOW, relation

QUERIES, ORACLES = {}, {}
c = F.col


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


_RECLAIMED = """f AS (SELECT * REPLACE (CASE WHEN state = 'leased' AND lease_expires_at <= 9e8 THEN 'queued' ELSE state END AS state), state = 'leased' AND lease_expires_at <= 9e8 AS freed FROM frontier),
q AS (SELECT u.* REPLACE (greatest(0, u.active - coalesce(x.n, 0)) AS active) FROM queues u LEFT JOIN (SELECT crawl_id, queue_key, count(*) AS n FROM f WHERE freed GROUP BY ALL) x USING (crawl_id, queue_key))"""


@query(f"{rel('queues', 'frontier')}, {_RECLAIMED} SELECT crawl_id, queue_key, max(q.active)::BIGINT AS active, count(*) FILTER (f.state = 'queued') AS queued, count(*) FILTER (f.freed) AS freed FROM f JOIN q USING (crawl_id, queue_key) GROUP BY crawl_id, queue_key")
def reclaim_leases(spark, sf_dir):
    old = relation(spark, sf_dir, "frontier")
    f, q = frontier.reclaim(old, relation(spark, sf_dir, "queues"), NOW)
    freed = old.groupBy("crawl_id", "queue_key").agg(F.count_if(frontier.expired(NOW)).alias("freed"))
    n = f.groupBy("crawl_id", "queue_key").agg(F.count_if(c("state") == "queued").alias("queued"))
    return q.join(n, ["crawl_id", "queue_key"]).join(freed, ["crawl_id", "queue_key"]).select("crawl_id", "queue_key", "active", "queued", "freed")


_LEASE = f"""{rel('queues', 'crawls')}, {_RECLAIMED},
cap AS (SELECT crawl_id, queue_key, CASE WHEN blocked_until > 9e8 OR next_allowed_at > 9e8 THEN 0 ELSE greatest(0, least(max_concurrency - active, coalesce(crawl_limit - issued, 1000000000), CASE WHEN delay_seconds > 0 THEN 1 ELSE 1000000000 END)) END AS cap FROM q),
d AS (SELECT f.*, cap, attempt = 0 AS fst, row_number() OVER (PARTITION BY crawl_id ORDER BY priority DESC, available_at, sequence) AS p FROM f JOIN cap USING (crawl_id, queue_key) WHERE state = 'queued' AND available_at <= 9e8),
r AS (SELECT *, row_number() OVER (PARTITION BY crawl_id, queue_key ORDER BY p) AS rn FROM d),
a AS (SELECT *, sum(CASE WHEN rn <= cap AND fst THEN 1 ELSE 0 END) OVER (PARTITION BY crawl_id ORDER BY p) AS firsts FROM r),
e AS (SELECT a.*, CASE WHEN w.crawl_limit IS NULL THEN 1e18 WHEN w.crawl_limit - w.issued <= 0 THEN -1 ELSE coalesce(min(CASE WHEN firsts >= w.crawl_limit - w.issued THEN p END) OVER (PARTITION BY crawl_id), 1e18) END AS star FROM a JOIN crawls w USING (crawl_id)),
g AS (SELECT *, sum(CASE WHEN rn <= cap AND p <= star THEN 1 ELSE 0 END) OVER (PARTITION BY crawl_id, queue_key) AS taken, sum(CASE WHEN p > star AND NOT fst THEN 1 ELSE 0 END) OVER (PARTITION BY crawl_id, queue_key ORDER BY p) AS late FROM e),
k AS (SELECT *, row_number() OVER (PARTITION BY crawl_id ORDER BY p) AS pos FROM g WHERE (rn <= cap AND p <= star) OR (p > star AND NOT fst AND late <= cap - taken)),
leases AS (SELECT *, attempt + 1 AS new_attempt FROM k WHERE pos <= 80)"""


def _leased(spark, sf_dir):
    return frontier.lease(relation(spark, sf_dir, "frontier"), relation(spark, sf_dir, "queues"), relation(spark, sf_dir, "crawls"), limit=80, lease_seconds=75.0, now=NOW)


@query(f"{_LEASE} SELECT crawl_id, url, queue_key, new_attempt::INT AS attempt, sequence, pos::BIGINT AS pos, 9e8 + 75e0 AS lease_expires_at FROM leases")
def lease_batch(spark, sf_dir):
    return _leased(spark, sf_dir).select("crawl_id", "url", "queue_key", "attempt", "sequence", "pos", "lease_expires_at")


@query(f"""{_LEASE} SELECT q.crawl_id, q.queue_key, (q.active + coalesce(n, 0))::BIGINT AS active, (q.issued + coalesce(n, 0))::BIGINT AS issued, CASE WHEN n > 0 THEN 9e8 + q.delay_seconds ELSE q.next_allowed_at END AS next_allowed_at, (w.issued + coalesce(m, 0))::BIGINT AS crawl_issued
FROM q LEFT JOIN (SELECT crawl_id, queue_key, count(*) AS n FROM leases GROUP BY ALL) x USING (crawl_id, queue_key) JOIN crawls w ON w.crawl_id = q.crawl_id LEFT JOIN (SELECT crawl_id, count(*) FILTER (new_attempt = 1) AS m FROM leases GROUP BY ALL) y ON y.crawl_id = q.crawl_id""")
def lease_state(spark, sf_dir):
    """Queues and budgets after a batch of leases."""
    f, q, w = frontier.apply_leases(relation(spark, sf_dir, "frontier"), relation(spark, sf_dir, "queues"), relation(spark, sf_dir, "crawls"), _leased(spark, sf_dir), NOW)
    return q.join(w.select("crawl_id", c("issued").alias("crawl_issued")), "crawl_id").select("crawl_id", "queue_key", "active", "issued", "next_allowed_at", "crawl_issued")


@query(f"""{rel('outcomes', 'queues')}, o AS (SELECT crawl_id, url, lease_token AS t, verb, available_at AS later, error AS e FROM outcomes), j AS (SELECT f.*, o.*, coalesce(f.state = 'leased' AND f.lease_token = o.t, false) AS hit FROM frontier f LEFT JOIN o USING (crawl_id, url))
SELECT crawl_id, url, CASE WHEN hit THEN CASE verb WHEN 'ack' THEN 'done' WHEN 'fail' THEN 'failed' ELSE 'queued' END ELSE state END AS state, CASE WHEN hit AND verb = 'retry' THEN later ELSE available_at END AS available_at,
CASE WHEN NOT hit THEN lease_token END AS lease_token, CASE WHEN hit THEN CASE WHEN verb <> 'ack' THEN e END ELSE error END AS error FROM j""")
def apply_outcomes(spark, sf_dir):
    f, _, _ = frontier.apply_outcomes(relation(spark, sf_dir, "frontier"), relation(spark, sf_dir, "queues"), relation(spark, sf_dir, "outcomes"))
    return f.select("crawl_id", "url", "state", "available_at", "lease_token", "error")


@query(f"{rel('outcomes')} SELECT crawl_id, url, verb FROM outcomes WHERE lease_token = 'stale'")
def stale_outcomes(spark, sf_dir):
    _, _, stale = frontier.apply_outcomes(relation(spark, sf_dir, "frontier"), relation(spark, sf_dir, "queues"), relation(spark, sf_dir, "outcomes"))
    return stale.select("crawl_id", "url", "verb")


@query(f"{rel('frontier')} SELECT crawl_id, count(*) FILTER (state = 'queued') AS queued, count(*) FILTER (state = 'leased') AS leased, count(*) FILTER (state = 'done') AS done, count(*) FILTER (state = 'failed') AS failed FROM frontier GROUP BY crawl_id")
def frontier_stats(spark, sf_dir):
    return frontier.stats(relation(spark, sf_dir, "frontier"))


@query(f"{rel('crawls', 'frontier')}, w AS (SELECT * FROM crawls WHERE crawl_id <> 'c3'), t AS (SELECT crawl_id, count(*) FILTER (attempt > 0) AS n FROM frontier GROUP BY crawl_id) SELECT t.crawl_id, w.crawl_limit, coalesce(w.issued, t.n)::BIGINT AS issued FROM t LEFT JOIN w USING (crawl_id)")
def rebuild_budget(spark, sf_dir):
    return frontier.rebuilt_budget(relation(spark, sf_dir, "frontier"), relation(spark, sf_dir, "crawls").where("crawl_id <> 'c3'"))


_NEW = """SELECT crawl_id, CASE WHEN sequence % 3 = 0 THEN url ELSE url || '/new' || CAST(sequence % 50 AS STRING) END AS url, queue_key, priority, depth, available_at, metadata_json, sequence AS n FROM frontier WHERE sequence % 2 = 0
UNION ALL SELECT crawl_id, url || '/new' || CAST(sequence % 50 AS STRING), queue_key, priority + 1, depth, available_at, metadata_json, sequence + 1000000 FROM frontier WHERE sequence % 4 = 0"""


@query(f"""{rel('frontier')}, r AS ({_NEW}), a AS (SELECT *, row_number() OVER (PARTITION BY crawl_id, url ORDER BY n) AS k FROM r WHERE NOT EXISTS (SELECT 1 FROM frontier f WHERE f.crawl_id = r.crawl_id AND f.url = r.url)),
t AS (SELECT crawl_id, max(sequence) AS top FROM frontier GROUP BY crawl_id) SELECT a.crawl_id, a.url, a.priority, 'queued' AS state, 0 AS attempt, (t.top + row_number() OVER (PARTITION BY a.crawl_id ORDER BY n))::BIGINT AS sequence FROM a JOIN t USING (crawl_id) WHERE k = 1""")
def frontier_add(spark, sf_dir):
    f = relation(spark, sf_dir, "frontier")
    f.createOrReplaceTempView("frontier")
    return frontier.add(f, spark.sql(_NEW), c("n")).select("crawl_id", "url", "priority", "state", "attempt", "sequence")


@query(f"""{rel('queues')}, r AS ({_NEW}), k AS (SELECT * FROM queues WHERE queue_key <> 'h4' AND crawl_id <> 'c3')
SELECT DISTINCT crawl_id, queue_key, 1 AS max_concurrency, 0e0 AS delay_seconds, 0::BIGINT AS active, 0::BIGINT AS issued FROM r WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.crawl_id = r.crawl_id AND k.queue_key = r.queue_key)""")
def frontier_add_queues(spark, sf_dir):
    """The queue rows that inserts make where some queues have none."""
    q = relation(spark, sf_dir, "queues").where("queue_key <> 'h4' AND crawl_id <> 'c3'")
    return frontier.missing_queues(spark.sql(_NEW), q).select("crawl_id", "queue_key", "max_concurrency", "delay_seconds", "active", "issued")


@query(f"""{rel('frontier')}, u AS (SELECT crawl_id, url, priority, 0 AS src, sequence AS n FROM frontier WHERE sequence % 5 = 0 UNION ALL SELECT crawl_id, url, CAST(-10 AS BIGINT), 1, sequence FROM frontier WHERE sequence % 3 = 0 UNION ALL SELECT crawl_id, url, CAST(0 AS BIGINT), 2, sequence FROM frontier WHERE sequence % 2 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY crawl_id, url ORDER BY src, n) AS k FROM u) SELECT crawl_id, url, priority, src::INT AS source_rank FROM r WHERE k = 1""")
def frontier_union(spark, sf_dir):
    f = relation(spark, sf_dir, "frontier").select("crawl_id", "url", "priority", c("sequence").alias("n"))
    parts = [f.where("n % 5 = 0"), f.where("n % 3 = 0").withColumn("priority", F.lit(-10).cast("long")), f.where("n % 2 = 0").withColumn("priority", F.lit(0).cast("long"))]
    return frontier.union_requests(parts, c("n")).select("crawl_id", "url", "priority", "source_rank")


_POLICIES = """SELECT crawl_id, queue_key, CAST(CASE WHEN queue_key = 'h1' THEN 0 ELSE 4 END AS INT) AS max_concurrency, CASE WHEN queue_key = 'h2' THEN -1e0 ELSE 3e0 END AS delay_seconds, CASE WHEN queue_key = 'h11' THEN CAST(0 AS BIGINT) WHEN queue_key = 'h12' THEN CAST(9 AS BIGINT) END AS crawl_limit
FROM queues WHERE queue_key < 'h2' OR queue_key = 'h2' UNION ALL SELECT crawl_id, 'fresh', CAST(2 AS INT), 1e0, CAST(NULL AS BIGINT) FROM queues WHERE queue_key = 'h4'"""


@query(f"""{rel('queues')}, p AS ({_POLICIES}), g AS (SELECT * FROM p WHERE max_concurrency > 0 AND delay_seconds >= 0 AND (crawl_limit IS NULL OR crawl_limit > 0))
SELECT crawl_id, queue_key, coalesce(g.max_concurrency, q.max_concurrency)::INT AS max_concurrency, coalesce(g.delay_seconds, q.delay_seconds) AS delay_seconds, CASE WHEN g.max_concurrency IS NOT NULL THEN g.crawl_limit ELSE q.crawl_limit END AS crawl_limit, coalesce(q.active, 0)::BIGINT AS active FROM queues q FULL JOIN g USING (crawl_id, queue_key)""")
def queue_policy_upsert(spark, sf_dir):
    q = relation(spark, sf_dir, "queues")
    q.createOrReplaceTempView("queues")
    return frontier.set_policies(q, spark.sql(_POLICIES)).select("crawl_id", "queue_key", "max_concurrency", "delay_seconds", "crawl_limit", "active")


@query(f"{rel('queues')}, p AS ({_POLICIES}) SELECT crawl_id, queue_key, CASE WHEN max_concurrency <= 0 THEN 'max_concurrency must be positive' WHEN delay_seconds < 0 THEN 'delay_seconds cannot be negative' ELSE 'crawl_limit must be positive' END AS error FROM p WHERE max_concurrency <= 0 OR delay_seconds < 0 OR crawl_limit <= 0")
def invalid_queue_policies(spark, sf_dir):
    relation(spark, sf_dir, "queues").createOrReplaceTempView("queues")
    p = spark.sql(_POLICIES).withColumn("error", frontier.invalid_policy(c("max_concurrency"), c("delay_seconds"), c("crawl_limit")))
    return p.where("error is not null").select("crawl_id", "queue_key", "error")


@query(f"{rel('frontier')} SELECT crawl_id, url, state FROM frontier WHERE crawl_id NOT IN ('c1', 'c4')")
def purge_crawl(spark, sf_dir):
    gone = spark.createDataFrame([("c1",), ("c4",), ("c4",)], "crawl_id string")
    return frontier.purge(relation(spark, sf_dir, "frontier"), gone).select("crawl_id", "url", "state")


@query(f"{rel('variants')}, {duck.url_parts('variants', 'u', 'page_id, v', 'x')} SELECT page_id, v, canon AS url, CASE WHEN v % 3 = 0 THEN 'given' WHEN canon IS NOT NULL THEN h END AS queue_key FROM x")
def normalize_requests(spark, sf_dir):
    v = relation(spark, sf_dir, "variants").select("page_id", "v", c("u").alias("url"), F.when(c("v") % 3 == 0, "given").alias("queue_key"))
    return frontier.normalized(v)


@query(f"""{rel('frontier')}, s AS (SELECT crawl_id, count(*) FILTER (state = 'queued') AS queued, count(*) FILTER (state = 'leased') AS leased, count(*) FILTER (state = 'done') AS done, count(*) FILTER (state = 'failed') AS failed FROM frontier GROUP BY crawl_id)
SELECT crawl_id, done + failed >= CAST(substr(crawl_id, 2) AS BIGINT) * 1000 OR (queued = 0 AND leased = 0) AS complete FROM s""")
def crawl_completion(spark, sf_dir):
    s = frontier.stats(relation(spark, sf_dir, "frontier"))
    return s.select("crawl_id", frontier.complete(c("queued"), c("leased"), c("done"), c("failed"), F.substring("crawl_id", 2, 9).cast("long") * 1000).alias("complete"))


@query(f"{rel('frontier')} SELECT crawl_id, url, CASE WHEN starts_with(metadata_json, '{{') THEN metadata_json END AS metadata FROM frontier")
def decode_metadata(spark, sf_dir):
    return relation(spark, sf_dir, "frontier").select("crawl_id", "url", store.decoded_metadata(c("metadata_json")).alias("metadata"))


# -- results and states


@query(f"""{rel('results')}, n AS (SELECT *, row_number() OVER (PARTITION BY crawl_id, request_url ORDER BY k % 2 DESC, recorded_at DESC, k) AS r FROM results)
SELECT crawl_id, request_url, recorded_at, k FROM n WHERE r = 1""")
def upsert_results(spark, sf_dir):
    r = relation(spark, sf_dir, "results")
    old = frontier.first_of(r.where("k % 2 = 0"), ["crawl_id", "request_url"], F.desc("recorded_at"), c("k"))
    return store.upsert(old, r.where("k % 2 = 1"), ["crawl_id", "request_url"], F.desc("recorded_at"), c("k")).select("crawl_id", "request_url", "recorded_at", "k")


@query("""SELECT page_id, '{"content_type":null,"engine":"http","links":["https://a.example/' || page_id || '"],"metadata":"{}","route":"direct","status_code":200,"title":"t \\"' || page_id || '\\" é","url":"https://b.example/' || page_id || '"}' AS record FROM pages""")
def record_json(spark, sf_dir):
    i = c("page_id").cast("string")
    r = F.struct(
        F.concat(F.lit("https://b.example/"), i).alias("url"), F.lit(200).alias("status_code"), F.lit(None).cast("string").alias("content_type"), F.concat(F.lit('t "'), i, F.lit('" é')).alias("title"),
        F.array(F.concat(F.lit("https://a.example/"), i)).alias("links"), F.lit("http").alias("engine"), F.lit("direct").alias("route"), F.lit("{}").alias("metadata"),
    )
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", store.record_json(r).alias("record"))


@query(f"""{rel('results')} SELECT k, CASE WHEN k % 9 > 0 THEN 'https://r.example/' || k END AS url, CASE WHEN k % 9 > 0 THEN CASE WHEN k % 2 = 0 THEN 'browser' ELSE 'http' END END AS engine, CASE WHEN k % 9 > 0 THEN 'direct' END AS route, CASE WHEN k % 9 > 0 THEN CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END END::BIGINT AS n_links, CASE WHEN k % 9 > 0 THEN '{{}}' END AS metadata FROM results""")
def decode_records(spark, sf_dir):
    # what is no JSON has no url either
    r = relation(spark, sf_dir, "results").select("k", store.decoded_record(F.when(F.get_json_object("record_json", "$.url").isNotNull(), c("record_json"))).alias("r"))
    return r.select("k", "r.url", "r.engine", "r.route", F.when(c("r").isNotNull(), F.size("r.links")).cast("long").alias("n_links"), "r.metadata")


@query(f"{rel('results')} SELECT crawl_id, count(*) AS n FROM results GROUP BY crawl_id")
def result_counts(spark, sf_dir):
    return relation(spark, sf_dir, "results").groupBy("crawl_id").agg(F.count("*").alias("n"))


@query(f"{rel('results')} SELECT crawl_id, request_url, k, row_number() OVER (PARTITION BY crawl_id ORDER BY recorded_at, request_url, k)::BIGINT AS pos FROM results")
def results_ordered(spark, sf_dir):
    from pyspark.sql import Window

    return relation(spark, sf_dir, "results").select("crawl_id", "request_url", "k", F.row_number().over(Window.partitionBy("crawl_id").orderBy("recorded_at", "request_url", "k")).cast("long").alias("pos"))


@query(f"{rel('results')} SELECT request_url, recorded_at, k FROM results WHERE crawl_id = 'c7' ORDER BY recorded_at, request_url LIMIT 50 OFFSET 100")
def results_page(spark, sf_dir):
    return store.page_of(relation(spark, sf_dir, "results"), "c7", 50, 100).select("request_url", "recorded_at", "k")


@query(f"{rel('states')} SELECT crawl_id, request_url, next_fetch_at FROM states WHERE next_fetch_at <= 9e8 ORDER BY next_fetch_at, crawl_id, request_url LIMIT 500")
def due_resources(spark, sf_dir):
    return store.due(relation(spark, sf_dir, "states"), NOW, 500).select("crawl_id", "request_url", "next_fetch_at")


@query(f"{rel('states')} SELECT crawl_id, request_url, last_seen_at FROM states ORDER BY last_seen_at, request_url LIMIT 300")
def forced_recrawl(spark, sf_dir):
    return relation(spark, sf_dir, "states").orderBy("last_seen_at", "request_url").limit(300).select("crawl_id", "request_url", "last_seen_at")


@query(f"{rel('states')} SELECT crawl_id, request_url, recrawl_interval_seconds, next_fetch_at FROM states WHERE crawl_id = 'c10'")
def resource_state_lookup(spark, sf_dir):
    return relation(spark, sf_dir, "states").where("crawl_id = 'c10'").select("crawl_id", "request_url", "recrawl_interval_seconds", "next_fetch_at")


@query(f"{rel('manifests')} SELECT crawl_id, 's' || (k % 50) || '.example' AS seed_host, follow_links, max_pages FROM manifests WHERE k % 10 = 3")
def manifest_lookup(spark, sf_dir):
    m = relation(spark, sf_dir, "manifests").where("k % 10 = 3").withColumn("seeds", F.from_json("seeds", "array<string>"))
    return m.select("crawl_id", urls.host(F.get("seeds", F.lit(0))).alias("seed_host"), "follow_links", "max_pages")


# -- claims and manifests


@query(f"""{rel('states', 'manifests', 'claims')} SELECT s.crawl_id, s.request_url, 9e8 + 120e0 AS expires_at, s.next_fetch_at FROM states s JOIN manifests m ON m.crawl_id = s.crawl_id AND m.lifecycle = 'completed'
WHERE s.next_fetch_at <= 9e8 AND NOT EXISTS (SELECT 1 FROM claims x WHERE x.crawl_id = s.crawl_id AND x.request_url = s.request_url AND x.expires_at > 9e8) ORDER BY s.next_fetch_at, s.crawl_id, s.request_url LIMIT 400""")
def claim_due(spark, sf_dir):
    got = store.claim_due(relation(spark, sf_dir, "states"), relation(spark, sf_dir, "manifests"), relation(spark, sf_dir, "claims"), limit=400, lease_seconds=120.0, now=NOW)
    return got.select("crawl_id", "request_url", "expires_at", "next_fetch_at")


@query(f"""{rel('states', 'claims', 'given')}, g AS (SELECT g.* FROM given g JOIN claims x USING (crawl_id, request_url, token)) SELECT s.crawl_id, s.request_url, coalesce(g.interval_seconds, s.recrawl_interval_seconds) AS recrawl_interval_seconds, coalesce(g.at, s.next_fetch_at) AS next_fetch_at
FROM states s LEFT JOIN g USING (crawl_id, request_url)""")
def reschedule_claims(spark, sf_dir):
    s, _ = store.reschedule(relation(spark, sf_dir, "states"), relation(spark, sf_dir, "claims"), relation(spark, sf_dir, "given"))
    return s.select("crawl_id", "request_url", "recrawl_interval_seconds", "next_fetch_at")


@query(f"{rel('claims', 'given')} SELECT crawl_id, request_url, token FROM claims x WHERE NOT EXISTS (SELECT 1 FROM given g WHERE g.crawl_id = x.crawl_id AND g.request_url = x.request_url AND g.token = x.token)")
def release_claims(spark, sf_dir):
    return store.release(relation(spark, sf_dir, "claims"), relation(spark, sf_dir, "given")).select("crawl_id", "request_url", "token")


@query(f"{rel('claims', 'manifests')} SELECT x.crawl_id, x.request_url FROM claims x WHERE x.crawl_id IN (SELECT crawl_id FROM manifests WHERE k % 3 > 0)")
def orphan_prune(spark, sf_dir):
    return store.prune(relation(spark, sf_dir, "claims"), relation(spark, sf_dir, "manifests").where("k % 3 > 0"), ["crawl_id"]).select("crawl_id", "request_url")


_SUBMITTED = "SELECT 'c' || CAST(k * 2 % 1700 AS STRING) AS crawl_id, k, CASE WHEN k % 4 = 0 THEN '[]' ELSE '[\"https://s' || CAST(k * 2 % 1700 % 50 AS STRING) || '.example/\"]' END AS seeds, k * 2 % 1700 % 2 = 0 AS follow_links, CAST(10 + k * 2 % 1700 % 90 AS BIGINT) AS max_pages FROM manifests"


@query(f"""{rel('manifests')}, b AS ({_SUBMITTED}) SELECT k, crawl_id, row_number() OVER (PARTITION BY crawl_id ORDER BY k) = 1 AND crawl_id NOT IN (SELECT crawl_id FROM manifests) AS created FROM b""")
def create_manifests(spark, sf_dir):
    m = relation(spark, sf_dir, "manifests")
    m.createOrReplaceTempView("manifests")
    return store.created(m, spark.sql(_SUBMITTED), c("k")).select("k", "crawl_id", "created")


@query(f"""{rel('manifests')}, b AS ({_SUBMITTED}) SELECT b.crawl_id FROM b JOIN manifests a USING (crawl_id) WHERE a.seeds IS DISTINCT FROM b.seeds OR a.follow_links IS DISTINCT FROM b.follow_links OR a.max_pages IS DISTINCT FROM b.max_pages""")
def manifest_conflicts(spark, sf_dir):
    m = relation(spark, sf_dir, "manifests")
    m.createOrReplaceTempView("manifests")
    return store.conflicts(m, spark.sql(_SUBMITTED), ["seeds", "follow_links", "max_pages"])


@query(f"{rel('manifests')} SELECT crawl_id, CASE k % 5 WHEN 0 THEN 'paused' WHEN 1 THEN 'completed' ELSE lifecycle END AS lifecycle, CASE WHEN k % 5 < 2 THEN 9e8 ELSE updated_at END AS updated_at FROM manifests")
def lifecycle_apply(spark, sf_dir):
    m = relation(spark, sf_dir, "manifests")
    wanted = m.where("k % 5 < 3").select("crawl_id", F.when(c("k") % 5 == 0, "paused").when(c("k") % 5 == 1, "completed").otherwise("unknown").alias("lifecycle"))
    return store.set_lifecycle(m, wanted, NOW).select("crawl_id", "lifecycle", "updated_at")


@query(f"{rel('manifests')} SELECT crawl_id FROM manifests WHERE lifecycle = 'active' ORDER BY updated_at, crawl_id LIMIT 100")
def runnable_crawls(spark, sf_dir):
    return store.runnable(relation(spark, sf_dir, "manifests"), 100)


_FOLD = """list_reduce(list(CASE command WHEN 'cancel' THEN 1 WHEN 'pause' THEN 2 WHEN 'resume' THEN CASE WHEN complete THEN 4 ELSE 3 END ELSE 5 END ORDER BY event_id),
  lambda a, x: CASE WHEN x = 1 THEN 13 WHEN x = 2 AND a <> 13 THEN 11 WHEN x = 3 AND a = 11 THEN 10 WHEN x = 4 AND a = 11 THEN 12 WHEN x = 5 AND a = 10 THEN 12 ELSE a END, 10)"""


@query(f"{rel('commands')} SELECT crawl_id, CASE {_FOLD} WHEN 10 THEN 'active' WHEN 11 THEN 'paused' WHEN 12 THEN 'completed' ELSE 'cancelled' END AS lifecycle, count(*) AS commands FROM commands GROUP BY crawl_id")
def lifecycle_fold(spark, sf_dir):
    return store.lifecycle_fold(relation(spark, sf_dir, "commands"), "crawl_id", "event_id")


@query(f"""{rel('manifests', 'frontier')}, s AS (SELECT crawl_id, 'https://s' || (k % 50) || '.example/' AS url FROM manifests WHERE k < 7 UNION ALL SELECT crawl_id, min(url) FROM frontier GROUP BY crawl_id) SELECT crawl_id, url FROM s WHERE NOT EXISTS (SELECT 1 FROM frontier f WHERE f.crawl_id = s.crawl_id AND f.url = s.url)""")
def resubmit_seeds(spark, sf_dir):
    """Seeds that submitting a crawl again adds: those that its frontier lacks."""
    f, m = relation(spark, sf_dir, "frontier"), relation(spark, sf_dir, "manifests")
    seeds = m.where("k < 7").select("crawl_id", F.get(F.from_json("seeds", "array<string>"), F.lit(0)).alias("url")).unionByName(f.groupBy("crawl_id").agg(F.min("url").alias("url")))
    req = seeds.select("crawl_id", "url", urls.host(c("url")).alias("queue_key"), F.lit(0).cast("long").alias("priority"), F.lit(0).alias("depth"), F.lit(NOW).alias("available_at"), F.lit("{}").alias("metadata_json"))
    return frontier.add(f, req, c("url")).select("crawl_id", "url")


# -- batches and summaries


@query(f"""{rel('records')}, k AS (SELECT pos, coalesce(requested_url, url) AS key FROM records UNION SELECT pos, url FROM records), b AS (SELECT key, min(pos) AS pos FROM k GROUP BY key), l AS (SELECT DISTINCT 'https://q.example/' || (page_id % 130) AS url FROM pages)
SELECT l.url, b.pos, CASE WHEN b.pos IS NULL THEN 'fail' ELSE 'ack' END AS verb FROM l LEFT JOIN b ON b.key = l.url""")
def batch_outcomes(spark, sf_dir):
    r = relation(spark, sf_dir, "records")
    leases = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.concat(F.lit("https://q.example/"), (c("page_id") % 130).cast("string")).alias("url")).distinct()
    return store.batch_outcomes(leases, r).select("url", "pos", "verb")


@query(f"""{rel('records')}, k AS (SELECT pos, coalesce(requested_url, url) AS key FROM records UNION SELECT pos, url FROM records) SELECT key, max(pos) AS pos FROM k GROUP BY key""")
def latest_record_lookup(spark, sf_dir):
    return store.index_records(relation(spark, sf_dir, "records"), last=True).select("key", "pos")


@query(f"""{rel('records')}, k AS (SELECT pos, coalesce(requested_url, url) AS key FROM records UNION SELECT pos, url FROM records), b AS (SELECT key, min(pos) AS pos FROM k GROUP BY key), l AS (SELECT DISTINCT 'https://q.example/' || (page_id % 130) AS url FROM pages)
SELECT count(*) AS leased, count(b.pos) AS persisted, count(*) - count(b.pos) AS failed FROM l LEFT JOIN b ON b.key = l.url""")
def batch_counters(spark, sf_dir):
    return batch_outcomes(spark, sf_dir).agg(F.count("*").alias("leased"), F.count("pos").alias("persisted"), F.count_if(c("verb") == "fail").alias("failed"))


@query(f"{_LEASE} SELECT count(DISTINCT crawl_id) AS crawls, count(*) AS leased, count(*) FILTER (sequence % 10 < 8) AS persisted, count(*) FILTER (sequence % 10 >= 8) AS failed FROM leases")
def worker_sweep(spark, sf_dir):
    """One sweep over all crawls: what was leased, and what came of it (here by number)."""
    return _leased(spark, sf_dir).agg(F.count_distinct("crawl_id").alias("crawls"), F.count("*").alias("leased"), F.count_if(c("sequence") % 10 < 8).alias("persisted"), F.count_if(c("sequence") % 10 >= 8).alias("failed"))


_CLAIMED = f"""{rel('states', 'manifests', 'claims')}, n AS (SELECT s.* FROM states s JOIN manifests m ON m.crawl_id = s.crawl_id AND m.lifecycle = 'completed' WHERE s.next_fetch_at <= 9e8 AND NOT EXISTS (SELECT 1 FROM claims x WHERE x.crawl_id = s.crawl_id AND x.request_url = s.request_url AND x.expires_at > 9e8) ORDER BY s.next_fetch_at, s.crawl_id, s.request_url LIMIT 400)"""


@query(f"""{_CLAIMED} SELECT count(*) AS claimed, count(*) FILTER (k % 10 < 9) AS checked, count(*) FILTER (k % 10 < 3) AS not_modified, count(*) FILTER (k % 10 BETWEEN 3 AND 4) AS unchanged, count(*) FILTER (k % 10 = 5) AS representation_changed, count(*) FILTER (k % 10 BETWEEN 6 AND 7) AS semantic_changed, count(*) FILTER (k % 10 = 8) AS failures FROM n""")
def recrawl_sweep(spark, sf_dir):
    """Claims of one sweep: released where the crawl isn't completed any more, else checked; counts by kind."""
    from gossamer.operators import change

    got = store.claim_due(relation(spark, sf_dir, "states"), relation(spark, sf_dir, "manifests"), relation(spark, sf_dir, "claims"), limit=400, lease_seconds=120.0, now=NOW)
    k = F.substring_index("request_url", "/", -1).cast("long") % 10
    kind = F.when(k < 3, "not_modified").when(k < 5, "unchanged").when(k == 5, "representation_changed").when(k < 8, "semantic_changed")
    checked = change.kind_counts(got.where(k < 9).withColumn("kind", kind))
    return checked.join(got.agg(F.count("*").alias("claimed")), F.lit(True)).select("claimed", "checked", "not_modified", "unchanged", "representation_changed", "semantic_changed", "failures")


@query(f"""{rel('frontier', 'results')}, s AS (SELECT crawl_id, count(*) FILTER (state = 'queued') AS queued, count(*) FILTER (state = 'leased') AS leased, count(*) FILTER (state = 'done') AS done, count(*) FILTER (state = 'failed') AS failed FROM frontier GROUP BY crawl_id),
r AS (SELECT crawl_id, count(*) AS n FROM results GROUP BY crawl_id), m AS (SELECT 'c' || c_custkey AS crawl_id, CASE c_custkey % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'paused' WHEN 2 THEN 'completed' ELSE 'cancelled' END AS lifecycle FROM customer)
SELECT m.crawl_id, lifecycle, coalesce(n, 0) AS results, coalesce(queued, 0) AS queued, coalesce(leased, 0) AS leased, coalesce(done, 0) AS done, coalesce(failed, 0) AS failed FROM m LEFT JOIN r USING (crawl_id) LEFT JOIN s USING (crawl_id)""")
def crawl_status(spark, sf_dir):
    m, s = relation(spark, sf_dir, "manifests").select("crawl_id", "lifecycle"), frontier.stats(relation(spark, sf_dir, "frontier"))
    n = relation(spark, sf_dir, "results").groupBy("crawl_id").agg(F.count("*").alias("results"))
    return m.join(n, "crawl_id", "left").join(s, "crawl_id", "left").na.fill(0, ["results", "queued", "leased", "done", "failed"])


@query(f"""{rel('frontier')} SELECT '{{"crawl_id":"' || crawl_id || '","done":' || count(*) FILTER (state = 'done') || ',"failed":' || count(*) FILTER (state = 'failed') || ',"queued":' || count(*) FILTER (state = 'queued') || '}}' AS summary FROM frontier GROUP BY crawl_id""")
def run_summary(spark, sf_dir):
    return frontier.stats(relation(spark, sf_dir, "frontier")).select(F.to_json(F.struct("crawl_id", "done", "failed", "queued")).alias("summary"))


# -- routes


def _ema(value: str, first: str) -> str:
    return f"round(list_reduce(list(CAST({value} AS DOUBLE) ORDER BY event_id), lambda a, x: 0.25e0 * x + 0.75e0 * a, {first}), 6)"


_STATS = f"""SELECT context_key, action, count(*) AS samples, {_ema('CASE WHEN success THEN 1 ELSE 0 END', '0.5e0')} AS success_ema, {_ema('quality', '0.5e0')} AS quality_ema, {_ema('latency_ms', '1000e0')} AS latency_ms_ema, {_ema('cost', '0e0')} AS cost_ema FROM outcome_log GROUP BY context_key, action"""


def _stats(spark, sf_dir):
    s = policy.action_stats(relation(spark, sf_dir, "outcome_log"), ["context_key", "action"], "event_id")
    return s.select("context_key", "action", "samples", *[F.round(f"{n}_ema", 6).alias(f"{n}_ema") for n in ("success", "quality", "latency_ms", "cost")])


@query(f"{rel('outcome_log')} {_STATS}")
def action_ema(spark, sf_dir):
    return _stats(spark, sf_dir)


@query(f"""{rel('outcome_log')}, t AS ({_STATS}), d AS (SELECT event_id AS n, 'u' || (event_id % 170) AS context_key FROM events), a(p, engine, route) AS (VALUES (0, 'http', 'direct'), (1, 'http', 'proxy'), (2, 'browser', 'direct')),
j AS (SELECT d.n, d.context_key, a.p, a.engine || ':' || a.route AS action, coalesce(t.samples, 0) AS samples, coalesce(success_ema, 0.5e0) * coalesce(quality_ema, 0.5e0) - least(coalesce(latency_ms_ema, 1000e0) / 20000e0, 0.25e0) - least(coalesce(cost_ema, 0e0), 0.25e0) - CASE WHEN engine = 'browser' THEN 0.04e0 ELSE 0e0 END - CASE WHEN route = 'proxy' THEN 0.02e0 ELSE 0e0 END + CASE WHEN t.samples IS NULL AND engine = 'http' THEN 0.015e0 ELSE 0e0 END AS score
 FROM d CROSS JOIN a LEFT JOIN t ON t.context_key = d.context_key AND t.action = a.engine || ':' || a.route),
r AS (SELECT *, n % 10 = 0 AS explored, CASE WHEN n % 10 = 0 THEN row_number() OVER (PARTITION BY n ORDER BY samples, p) ELSE row_number() OVER (PARTITION BY n ORDER BY score DESC, p) END AS k FROM j) SELECT n AS decision_no, context_key, action, explored FROM r WHERE k = 1""")
def choose_action(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/events.parquet").select(c("event_id").alias("decision_no"), F.concat(F.lit("u"), (c("event_id") % 170).cast("string")).alias("context_key"))
    actions = spark.createDataFrame([(0, "http", "direct"), (1, "http", "proxy"), (2, "browser", "direct")], "action_pos int, engine string, route string")
    return policy.choose(d, actions, _stats(spark, sf_dir), explore_every=10)


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 OR page_id % 2 = 0 THEN 'http:direct' WHEN page_id % 3 = 1 THEN 'http:proxy' ELSE 'http:direct,http:proxy' END AS actions FROM pages""")
def available_actions(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    mode = F.when(c("page_id") % 3 == 0, "direct").when(c("page_id") % 3 == 1, "required").otherwise("auto")
    return p.select("page_id", F.array_join(policy.available(mode, c("page_id") % 2 == 1, F.lit("http")), ",").alias("actions"))


_EVENTS = "SELECT event_id, 'r' || CAST(event_id % 300 AS STRING) AS request_key, 'u' || CAST(event_id % 300 % 7 AS STRING) AS context_key, CASE WHEN event_type IN ('error', 'purchase') THEN 'observe' ELSE 'choose' END AS verb FROM events"


@query(f"""WITH e AS ({_EVENTS}), l AS (SELECT *, lag(verb) OVER (PARTITION BY request_key ORDER BY event_id) AS b FROM e), m AS (SELECT *, verb = 'choose' AND (b IS NULL OR b = 'observe') AS new FROM l)
SELECT event_id, request_key, new, CASE WHEN new THEN sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY context_key ORDER BY event_id) END::BIGINT AS decision_no FROM m""")
def route_choice(spark, sf_dir):
    spark.read.parquet(f"{sf_dir}/events.parquet").createOrReplaceTempView("events")
    return policy.pending_choices(spark.sql(_EVENTS), "request_key", "event_id").select("event_id", "request_key", "new", "decision_no")


@query("""WITH e AS (SELECT event_id, event_type AS lane, CASE WHEN event_id % 4 > 0 THEN 's' || (user_id % 20) END AS sid FROM events), f AS (SELECT *, sid IS NULL OR row_number() OVER (PARTITION BY lane, sid ORDER BY event_id) = 1 AS takes FROM e),
t AS (SELECT *, CASE WHEN takes THEN sum(CASE WHEN takes THEN 1 ELSE 0 END) OVER (PARTITION BY lane ORDER BY event_id) - 1 END AS turn FROM f), u AS (SELECT *, CASE WHEN sid IS NULL THEN turn ELSE min(turn) OVER (PARTITION BY lane, sid) END AS own FROM t)
SELECT event_id, 'http://p' || (own % 3)::BIGINT || '.example:1' AS proxy_url FROM u""")
def proxy_assignment(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", c("event_type").alias("lane"), F.when(c("event_id") % 4 > 0, F.concat(F.lit("s"), (c("user_id") % 20).cast("string"))).alias("session_id"))
    return policy.assigned_proxies(e, [f"http://p{k}.example:1" for k in range(3)], "lane", "event_id").select("event_id", "proxy_url")


@query("""SELECT page_id, CASE WHEN page_id % 4 = 3 THEN 0e0 WHEN page_id % 4 < 2 THEN CASE WHEN page_id % 5 = 0 THEN 0.2e0 WHEN page_id % 3 > 0 THEN 1e0 ELSE 0.25e0 END
ELSE CASE WHEN page_id % 6 < 2 THEN 1e0 WHEN page_id % 6 < 4 THEN CASE WHEN page_id % 7 > 0 THEN 1e0 ELSE 0.5e0 END ELSE 0.25e0 END END AS quality FROM pages""")
def outcome_quality(spark, sf_dir):
    i = c("page_id")
    kind = F.when(i % 4 == 3, "failure").when(i % 4 < 2, "http").otherwise("raw")
    status = F.when(i % 6 < 2, 200).when(i % 6 < 4, 302).otherwise(500)
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", policy.outcome_quality(kind, status, i % 3 > 0, i % 5 == 0, i % 7 > 0).alias("quality"))


# -- discovery


@query(f"""{rel('robots')} SELECT page_id, 'https://r' || page_id || '.example/s/' || page_id || '.xml https://s.example/b.xml' AS sitemaps FROM robots""")
def robots_sitemaps(spark, sf_dir):
    return relation(spark, sf_dir, "robots").select("page_id", F.array_join(discovery.robots_sitemaps(c("body"), c("source_url")), " ").alias("sitemaps"))


_SITEMAP_URLS = """CASE page_id % 5 WHEN 0 THEN 'https://s' || page_id || '.example/a/' || page_id || ' https://s' || page_id || '.example/dir/b?x=1&y=2' WHEN 1 THEN 'https://s' || page_id || '.example/n/' || page_id || '.xml https://t.example/m.xml'
WHEN 2 THEN 'https://t.example/' || page_id || ' https://s' || page_id || '.example/x/' || page_id END"""


@query(f"{rel('sitemaps')} SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'urlset' WHEN 1 THEN 'sitemapindex' WHEN 2 THEN 'text' END AS kind, {_SITEMAP_URLS} AS urls FROM sitemaps")
def parse_sitemaps(spark, sf_dir):
    s = relation(spark, sf_dir, "sitemaps").select("page_id", discovery.sitemap(c("body"), c("source_url")).alias("s"))
    return s.select("page_id", "s.kind", F.array_join("s.urls", " ").alias("urls"))


@query(f"{rel('sitemaps')} SELECT page_id, {_SITEMAP_URLS} AS urls FROM sitemaps WHERE page_id % 5 = 2")
def text_sitemaps(spark, sf_dir):
    return relation(spark, sf_dir, "sitemaps").where("page_id % 5 = 2").select("page_id", F.array_join(discovery.text_urls(c("body"), c("source_url")), " ").alias("urls"))


@query(f"""{rel('feeds')} SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'feed-rss' WHEN 1 THEN 'feed-atom' END AS kind, CASE page_id % 4 WHEN 0 THEN 'https://f' || page_id || '.example/i/' || page_id || ' https://g.example/2' WHEN 1 THEN 'https://f' || page_id || '.example/e/' || page_id || ' https://f' || page_id || '.example/r/' || page_id END AS urls FROM feeds""")
def parse_feeds(spark, sf_dir):
    f = relation(spark, sf_dir, "feeds").select("page_id", discovery.feed(c("body"), c("source_url")).alias("f"))
    return f.select("page_id", "f.kind", F.array_join("f.urls", " ").alias("urls"))


@query("SELECT page_id, octet_length(encode(html)) > 5000 AS oversized FROM pages")
def oversized_docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", discovery.oversized(c("html"), 5000).alias("oversized"))


@query(f"{rel('sitemaps')} SELECT page_id, regexp_matches(substr(body, 1, 262144), '(?i)<!(doctype|entity)') AS unsafe FROM sitemaps")
def unsafe_xml(spark, sf_dir):
    return relation(spark, sf_dir, "sitemaps").select("page_id", discovery.unsafe_xml(c("body")).alias("unsafe"))


_EDGES = "SELECT 'n' || CAST(page_id AS STRING) AS parent, 'n' || CAST((page_id * 3 + 1) % 200 AS STRING) AS child FROM pages UNION ALL SELECT 'n' || CAST(page_id AS STRING), 'n' || CAST((page_id * 7 + 2) % 260 AS STRING) FROM pages"


@query(f"""WITH RECURSIVE e AS ({_EDGES}), w(node, depth) AS (SELECT * FROM (VALUES ('n0', 0), ('n5', 0)) UNION SELECT e.child, w.depth + 1 FROM w JOIN e ON e.parent = w.node WHERE w.depth < 5) SELECT node, min(depth)::INT AS depth FROM w GROUP BY node""")
def crawl_reachability(spark, sf_dir):
    spark.read.parquet(f"{sf_dir}/pages.parquet").createOrReplaceTempView("pages")
    return discovery.reach(spark.sql(_EDGES), spark.createDataFrame([("n0",), ("n5",)], "node string"), max_depth=5)


@query(f"""{rel('sites')}, i AS (SELECT site, unnest(range(0, 7)) AS d FROM sites) SELECT site, 'https://' || site || '.example/p/' || p AS url, 'https://' || site || '.example/' || 'm' || (p // 3) || '.xml' AS source_url, 'urlset' AS via, 1 AS depth, (p + 1)::BIGINT AS pos FROM (SELECT site, unnest(range(0, 12)) AS p FROM sites) AS x""")
def sitemap_walk(spark, sf_dir):
    """An index of six maps, three urls each (and one that an earlier map has): five documents in all, so four maps."""
    s = relation(spark, sf_dir, "sites").withColumn("root", F.concat(F.lit("https://"), c("site"), F.lit(".example/")))
    index = s.select(F.concat("root", F.lit("index.xml")).alias("url"), F.lit(200).alias("status"), F.lit("sitemapindex").alias("kind"), F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.concat(c("root"), F.lit("m"), k.cast("string"), F.lit(".xml"))).alias("urls"))
    m = s.select("root", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k"))
    maps = m.select(F.concat("root", F.lit("m"), c("k").cast("string"), F.lit(".xml")).alias("url"), F.lit(200).alias("status"), F.lit("urlset").alias("kind"), F.transform(F.sequence(c("k") * 3 - F.when(c("k") > 0, 1).otherwise(0), c("k") * 3 + 2), lambda p: F.concat(c("root"), F.lit("p/"), p.cast("string"))).alias("urls"))
    roots = s.select("site", F.concat("root", F.lit("index.xml")).alias("url"), F.lit(0).alias("pos"))
    return discovery.sitemap_walk(index.unionByName(maps), roots, max_documents=5, max_depth=4, max_urls=12)


_HOPS = "SELECT 'http://a.example/' || CAST(page_id AS STRING) AS url, CASE WHEN page_id % 17 = 0 THEN CAST(NULL AS STRING) WHEN page_id % 17 = 9 THEN 'https://b.example/' || CAST(page_id AS STRING) ELSE 'http://a.example/' || CAST(page_id - 1 AS STRING) END AS location FROM pages"


@query(f"""WITH RECURSIVE h AS ({_HOPS}), w(start, url, hops, same) AS (SELECT url, url, 0, true FROM h UNION ALL SELECT w.start, h.location, w.hops + 1, w.same AND starts_with(h.location, 'http:') = starts_with(h.url, 'http:') FROM w JOIN h ON h.url = w.url WHERE h.location IS NOT NULL AND w.hops < 6)
SELECT w.start, w.url AS final_url, w.hops, w.same AS same_origin, CASE WHEN h.location IS NULL THEN 'ok' ELSE 'too_many' END AS status FROM w LEFT JOIN h ON h.url = w.url WHERE h.location IS NULL OR w.hops = 6""")
def redirect_chains(spark, sf_dir):
    spark.read.parquet(f"{sf_dir}/pages.parquet").createOrReplaceTempView("pages")
    h = spark.sql(_HOPS)
    return discovery.redirect_chains(h.select("url"), h, max_redirects=6)


@query("""SELECT page_id, greatest(0, least(page_id % 20, 500 - coalesce(sum(page_id % 20) OVER (PARTITION BY page_id % 3 ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS allowed FROM pages""")
def discovery_budget(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", (c("page_id") % 20).alias("n"), (c("page_id") % 3).alias("lane"))
    return discovery.discovery_budget(p, "lane", "page_id", "n", 500).select("page_id", "allowed")
