"""The work queue as tables: insert, lease by priority and politeness, outcomes, reclaim, budgets, purge.

Verbs take snapshots and give new ones; `now` is a parameter everywhere.
Columns: frontier(crawl_id, url, queue_key, priority, depth, available_at,
metadata_json, state, attempt, lease_token, lease_expires_at, error, sequence),
queues(crawl_id, queue_key, max_concurrency, delay_seconds, blocked_until,
crawl_limit, active, issued, next_allowed_at), crawls(crawl_id, crawl_limit,
issued).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gossamer.functions import urls

STATES = ("queued", "leased", "done", "failed")
KEY = ["crawl_id", "url"]
QUEUE = ["crawl_id", "queue_key"]
REQUEST = ["crawl_id", "url", "queue_key", "priority", "depth", "available_at", "metadata_json"]


def normalized(requests: DataFrame) -> DataFrame:
    """Canonical url; queue_key defaults to the host. Unusable urls give a null url."""
    url = urls.canonical(F.col("url"))
    return requests.withColumn("queue_key", F.coalesce("queue_key", urls.host(url))).withColumn("url", url)


def first_of(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__r = 1").drop("__r")


def union_requests(sources: list[DataFrame], *order: Column) -> DataFrame:
    """Requests of several sources, each (crawl_id, url) once; the earliest source's attributes win, within it the order given."""
    out = None
    for rank, s in enumerate(sources):
        s = s.withColumn("source_rank", F.lit(rank))
        out = s if out is None else out.unionByName(s)
    return first_of(out, KEY, F.col("source_rank"), *order)


def add(frontier: DataFrame, requests: DataFrame, *order: Column) -> DataFrame:
    """The rows that inserting requests adds: new keys only, queued, numbered per crawl after what it has, in the order given.

    Sequences are numbered within a crawl, which is all that leasing needs.
    """
    new = first_of(requests.join(frontier.select(*KEY), KEY, "left_anti"), KEY, *order)
    top = frontier.groupBy("crawl_id").agg(F.max("sequence").alias("__top"))
    number = F.row_number().over(Window.partitionBy("crawl_id").orderBy(*order))
    return new.join(top, "crawl_id", "left").withColumn("sequence", F.coalesce("__top", F.lit(0)) + number).select(
        *REQUEST, F.lit("queued").alias("state"), F.lit(0).alias("attempt"), F.lit(None).cast("string").alias("lease_token"), F.lit(0.0).alias("lease_expires_at"), F.lit(None).cast("string").alias("error"), F.col("sequence").cast("long"),
    )


def missing_queues(requests: DataFrame, queues: DataFrame) -> DataFrame:
    """The queue rows that inserting requests (or leasing them) makes: one request at a time, no delay, no limit, nothing issued."""
    new = requests.select(*QUEUE).distinct().join(queues.select(*QUEUE), QUEUE, "left_anti")
    fresh = {"max_concurrency": F.lit(1), "delay_seconds": F.lit(0.0), "blocked_until": F.lit(0.0), "crawl_limit": F.lit(None), "active": F.lit(0), "issued": F.lit(0), "next_allowed_at": F.lit(0.0)}
    return new.select(*[fresh[c].cast(t).alias(c) if c in fresh else F.col(c) for c, t in queues.dtypes])


def missing_crawls(requests: DataFrame, crawls: DataFrame) -> DataFrame:
    """The crawl rows that inserting requests makes: no limit, nothing issued."""
    new = requests.select("crawl_id").distinct().join(crawls.select("crawl_id"), "crawl_id", "left_anti")
    return new.select(*[F.col(c) if c == "crawl_id" else F.lit(0 if c == "issued" else None).cast(t).alias(c) for c, t in crawls.dtypes])


def expired(now: float) -> Column:
    return (F.col("state") == "leased") & (F.col("lease_expires_at") <= now)


def reclaim(frontier: DataFrame, queues: DataFrame, now: float) -> tuple[DataFrame, DataFrame]:
    """Expired leases are queued again, attempts kept; their queues' active counts go down, not below 0."""
    freed = frontier.where(expired(now)).groupBy(*QUEUE).agg(F.count("*").alias("__freed"))
    back = frontier.withColumns({"lease_token": F.when(~expired(now), F.col("lease_token")), "lease_expires_at": F.when(expired(now), 0.0).otherwise(F.col("lease_expires_at")), "state": F.when(expired(now), "queued").otherwise(F.col("state"))})
    active = F.greatest(F.lit(0), F.col("active") - F.coalesce("__freed", F.lit(0)))
    return back, queues.join(freed, QUEUE, "left").withColumn("active", active.cast("long")).select(*queues.columns)


def lease(frontier: DataFrame, queues: DataFrame, crawls: DataFrame, *, limit: int, lease_seconds: float, now: float) -> DataFrame:
    """The leases that one call per crawl gives, as the greedy walk in (priority down, available_at, sequence) gives them.

    Politeness is a cap for each queue, the crawl's budget counts first leases
    only, and a first lease that the budget refuses doesn't use up its queue's
    cap. So up to the row where the budget ends each queue takes its first cap
    rows, and beyond it retries alone compete for what is left of the caps.
    """
    frontier, queues = reclaim(frontier, queues, now)
    shut = (F.col("blocked_until") > now) | (F.col("next_allowed_at") > now)
    most = F.least(F.col("max_concurrency") - F.col("active"), F.coalesce(F.col("crawl_limit") - F.col("issued"), F.lit(2**31)), F.when(F.col("delay_seconds") > 0, F.lit(1)).otherwise(F.lit(2**31)))
    caps = queues.select(*QUEUE, F.when(shut, 0).otherwise(F.greatest(F.lit(0), most)).cast("long").alias("cap"))
    left = crawls.select("crawl_id", (F.col("crawl_limit") - F.col("issued")).alias("budget"))
    order = [F.desc("priority"), F.asc("available_at"), F.asc("sequence")]
    due = frontier.where((F.col("state") == "queued") & (F.col("available_at") <= now)).withColumn("first", F.col("attempt") == 0)
    ranked = due.withColumn("rank", F.row_number().over(Window.partitionBy(*QUEUE).orderBy(*order))).withColumn("retry_rank", F.sum((~F.col("first")).cast("int")).over(Window.partitionBy(*QUEUE).orderBy(*order)))
    # no other row can be leased; what is left for the window over a whole crawl is a cap or two of rows for each queue
    able = ranked.join(caps, QUEUE, "left").withColumn("cap", F.coalesce("cap", F.lit(1))).where((F.col("rank") <= F.col("cap")) | (~F.col("first") & (F.col("retry_rank") <= F.col("cap"))))
    able = able.join(left, "crawl_id", "left")
    crawl = Window.partitionBy("crawl_id").orderBy(*order)
    able = able.withColumn("within", F.col("rank") <= F.col("cap"))
    able = able.withColumn("firsts", F.sum((F.col("within") & F.col("first")).cast("int")).over(crawl))
    before_end = F.col("budget").isNull() | (F.col("firsts") - (F.col("within") & F.col("first")).cast("int") < F.col("budget"))
    able = able.withColumn("open", before_end)
    queue = Window.partitionBy(*QUEUE)
    able = able.withColumn("taken", F.sum((F.col("within") & F.col("open")).cast("int")).over(queue))
    rest = F.sum((~F.col("open") & ~F.col("first")).cast("int")).over(queue.orderBy(*order))
    able = able.withColumn("late_rank", rest)
    chosen = able.where((F.col("within") & F.col("open")) | (~F.col("open") & ~F.col("first") & (F.col("late_rank") <= F.col("cap") - F.col("taken"))))
    chosen = chosen.withColumn("pos", F.row_number().over(crawl)).where(F.col("pos") <= limit)
    token = F.sha2(F.concat_ws("|", "crawl_id", "url", F.col("attempt").cast("string"), F.lit(str(now))), 256)
    return chosen.select(*REQUEST, "sequence", (F.col("attempt") + 1).cast("int").alias("attempt"), token.alias("lease_token"), F.lit(now).alias("leased_at"), F.lit(now + lease_seconds).alias("lease_expires_at"), F.col("pos").cast("long").alias("pos"))


def apply_leases(frontier: DataFrame, queues: DataFrame, crawls: DataFrame, leases: DataFrame, now: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables after leases were given (and expired ones reclaimed); queues and crawls that had no row have one."""
    queues = queues.unionByName(missing_queues(leases, queues))
    crawls = crawls.unionByName(missing_crawls(leases, crawls))
    frontier, queues = reclaim(frontier, queues, now)
    new = leases.select(*KEY, F.col("attempt").alias("__attempt"), F.col("lease_token").alias("__token"), F.col("lease_expires_at").alias("__until"))
    hit = F.col("__token").isNotNull()
    f = frontier.join(new, KEY, "left").withColumns({"state": F.when(hit, "leased").otherwise(F.col("state")), "attempt": F.coalesce("__attempt", "attempt"), "lease_token": F.coalesce("__token", "lease_token"), "lease_expires_at": F.coalesce("__until", "lease_expires_at")})
    by_queue = leases.groupBy(*QUEUE).agg(F.count("*").alias("__n"))
    got = F.coalesce("__n", F.lit(0))
    q = queues.join(by_queue, QUEUE, "left").withColumns({"active": F.col("active") + got, "issued": F.col("issued") + got, "next_allowed_at": F.when(F.col("__n") > 0, F.lit(now) + F.col("delay_seconds")).otherwise(F.col("next_allowed_at"))})
    by_crawl = leases.groupBy("crawl_id").agg(F.count_if(F.col("attempt") == 1).alias("__n"))
    c = crawls.join(by_crawl, "crawl_id", "left").withColumn("issued", F.col("issued") + F.coalesce("__n", F.lit(0)))
    return f.select(*frontier.columns), q.select(*queues.columns), c.select(*crawls.columns)


def apply_outcomes(frontier: DataFrame, queues: DataFrame, outcomes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """frontier and queues after outcomes (crawl_id, url, lease_token, verb, available_at, error), and the outcomes whose lease isn't active.

    ack and fail end a request, retry queues it again at available_at. As the
    durable store does, an ack clears the error.
    """
    o = outcomes.select(*KEY, F.col("lease_token").alias("__token"), F.col("verb").alias("__verb"), F.col("available_at").alias("__at"), F.col("error").alias("__error"))
    j = frontier.join(o, KEY, "left")
    hit = F.coalesce((F.col("state") == "leased") & (F.col("lease_token") == F.col("__token")), F.lit(False))
    verb = F.col("__verb")
    j = j.withColumn("__hit", hit)
    f = j.withColumns({
        "state": F.when(F.col("__hit"), F.when(verb == "ack", "done").when(verb == "fail", "failed").otherwise("queued")).otherwise(F.col("state")),
        "available_at": F.when(F.col("__hit") & (verb == "retry"), F.col("__at")).otherwise(F.col("available_at")),
        "lease_token": F.when(~F.col("__hit"), F.col("lease_token")), "lease_expires_at": F.when(F.col("__hit"), 0.0).otherwise(F.col("lease_expires_at")),
        "error": F.when(F.col("__hit"), F.when(verb != "ack", F.col("__error"))).otherwise(F.col("error")),
    }).select(*frontier.columns)
    freed = j.where("__hit").groupBy(*QUEUE).agg(F.count("*").alias("__n"))
    q = queues.join(freed, QUEUE, "left").withColumn("active", F.greatest(F.lit(0), F.col("active") - F.coalesce("__n", F.lit(0))).cast("long")).select(*queues.columns)
    live = frontier.where("state = 'leased'").select(*KEY, "lease_token")
    return f, q, outcomes.join(live, [*KEY, "lease_token"], "left_anti")


def stats(frontier: DataFrame) -> DataFrame:
    """Requests of each crawl by state, 0 where there are none."""
    return frontier.groupBy("crawl_id").agg(*[F.count_if(F.col("state") == s).alias(s) for s in STATES])


def rebuilt_budget(frontier: DataFrame, crawls: DataFrame) -> DataFrame:
    """crawls with a row for each crawl of the frontier; a missing one has issued as many as were ever tried, and no limit."""
    tried = frontier.groupBy("crawl_id").agg(F.count_if(F.col("attempt") > 0).alias("__tried"))
    return tried.join(crawls, "crawl_id", "full_outer").select("crawl_id", "crawl_limit", F.coalesce("issued", "__tried").cast("long").alias("issued"))


def invalid_policy(max_concurrency: Column, delay: Column, limit: Column) -> Column:
    """Why a queue policy is refused; null if it is fine."""
    return F.when(~(max_concurrency > 0), "max_concurrency must be positive").when(~(delay >= 0), "delay_seconds cannot be negative").when(limit.isNotNull() & ~(limit > 0), "crawl_limit must be positive")


def set_policies(queues: DataFrame, policies: DataFrame) -> DataFrame:
    """queues after valid policies (crawl_id, queue_key, max_concurrency, delay_seconds, crawl_limit); new queues start idle."""
    good = policies.where(invalid_policy(F.col("max_concurrency"), F.col("delay_seconds"), F.col("crawl_limit")).isNull())
    p = good.select(*QUEUE, F.struct("max_concurrency", "delay_seconds", "crawl_limit").alias("__p"))
    own = ("max_concurrency", "delay_seconds", "crawl_limit")
    fresh = {"blocked_until": F.lit(0.0), "active": F.lit(0), "issued": F.lit(0), "next_allowed_at": F.lit(0.0)}
    kinds = dict(queues.dtypes)
    j = queues.join(p, QUEUE, "full_outer")
    return j.select(*[F.when(F.col("__p").isNotNull(), F.col(f"__p.{c}")).otherwise(F.col(c)).cast(kinds[c]).alias(c) if c in own else F.coalesce(F.col(c), fresh[c]).cast(kinds[c]).alias(c) if c in fresh else F.col(c) for c in queues.columns])


def purge(table: DataFrame, crawl_ids: DataFrame) -> DataFrame:
    return table.join(crawl_ids.select("crawl_id").distinct(), "crawl_id", "left_anti")


def complete(queued: Column, leased: Column, done: Column, failed: Column, max_pages: Column) -> Column:
    return (done + failed >= max_pages) | ((queued == 0) & (leased == 0))
