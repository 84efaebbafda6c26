"""Route scoring from outcomes, choices with exploration, proxies in turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALPHA = 0.25
#: What is assumed of an action without outcomes: success, quality, latency (ms), cost.
PRIOR = (0.5, 0.5, 1000.0, 0.0)


def ema(values: Column, first: float, alpha: float = ALPHA) -> Column:
    return F.aggregate(values, F.lit(first), lambda held, x: F.lit(alpha) * x + F.lit(1 - alpha) * held)


def action_stats(outcomes: DataFrame, key: list[str], order: str, alpha: float = ALPHA) -> DataFrame:
    """samples and moving averages of success, quality, latency_ms and cost for each key, folded in order.

    Rows of a key are folded in one place, as the fold isn't associative; cut
    logs by time and carry the state on where a key has very many.
    """
    got = outcomes.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(order, F.col("success").cast("double").alias("success"), "quality", "latency_ms", "cost"))).alias("log"))
    names = ("success", "quality", "latency_ms", "cost")
    return got.select(*key, F.size("log").cast("long").alias("samples"), *[ema(F.col("log").getField(n), p, alpha).alias(f"{n}_ema") for n, p in zip(names, PRIOR, strict=True)])


def score(success: Column, quality: Column, latency: Column, cost: Column, samples: Column, engine: Column, route: Column) -> Column:
    of = lambda c, n: F.when(c, F.lit(n)).otherwise(F.lit(0.0))
    return success * quality - F.least(latency / 20000.0, F.lit(0.25)) - F.least(cost, F.lit(0.25)) - of(engine == "browser", 0.04) - of(route == "proxy", 0.02) + of((samples == 0) & (engine == "http"), 0.015)


def choose(decisions: DataFrame, actions: DataFrame, stats: DataFrame, *, explore_every: int) -> DataFrame:
    """For each decision (decision_no, context_key) the action: the best score, or every so many decisions the least sampled; ties to the first.

    actions: action_pos, engine, route. Each decision meets each of these few.
    """
    full = decisions.withColumn("__a", F.lit(1)).join(actions.withColumn("__a", F.lit(1)), "__a").drop("__a").withColumn("action", F.concat_ws(":", "engine", "route"))
    s = full.join(stats.select("context_key", "action", "samples", "success_ema", "quality_ema", "latency_ms_ema", "cost_ema"), ["context_key", "action"], "left")
    prior = [F.coalesce(c, F.lit(p)) for c, p in zip(("success_ema", "quality_ema", "latency_ms_ema", "cost_ema"), PRIOR, strict=True)]
    samples = F.coalesce("samples", F.lit(0))
    s = s.withColumn("score", score(*prior, samples, F.col("engine"), F.col("route"))).withColumn("samples", samples)
    w = Window.partitionBy("decision_no")
    explore = F.col("decision_no") % explore_every == 0
    rank = F.when(explore, F.row_number().over(w.orderBy("samples", "action_pos"))).otherwise(F.row_number().over(w.orderBy(F.desc("score"), "action_pos")))
    return s.withColumn("__r", rank).where("__r = 1").select("decision_no", "context_key", "action", explore.alias("explored"))


def available(mode: Column, has_proxy: Column, engine: Column) -> Column:
    """Actions in order, as engine:route."""
    direct, proxy = F.concat(engine, F.lit(":direct")), F.concat(engine, F.lit(":proxy"))
    return F.when((mode == "direct") | ~has_proxy, F.array(direct)).when(mode == "required", F.array(proxy)).otherwise(F.array(direct, proxy))


def pending_choices(events: DataFrame, key: str, order: str) -> DataFrame:
    """events (verb choose or observe) with new: whether a choose makes a decision, i.e. none is pending for its key; and decision_no among new ones of a context.

    An observe ends the pending decision.
    """
    w = Window.partitionBy(key).orderBy(order)
    before = F.lag("verb").over(w)
    made = events.withColumn("new", (F.col("verb") == "choose") & (before.isNull() | (before == "observe")))
    number = F.sum(F.col("new").cast("int")).over(Window.partitionBy("context_key").orderBy(order))
    return made.withColumn("decision_no", F.when(F.col("new"), number).cast("long"))


def assigned_proxies(requests: DataFrame, pool: list[str], lane: str, order: str) -> DataFrame:
    """requests with proxy_url: proxies in turn, a session (null: none) keeps its first. lane: the pool's instance."""
    if not pool:
        raise ValueError("proxy pool requires at least one URL")
    first = F.row_number().over(Window.partitionBy(lane, "session_id").orderBy(order)) == 1
    r = requests.withColumn("__takes", F.col("session_id").isNull() | first)
    r = r.withColumn("__turn", F.when(F.col("__takes"), F.sum(F.col("__takes").cast("int")).over(Window.partitionBy(lane).orderBy(order)) - 1))
    own = F.min("__turn").over(Window.partitionBy(lane, "session_id"))
    turn = F.when(F.col("session_id").isNull(), F.col("__turn")).otherwise(own)
    urls = F.array(*[F.lit(u) for u in pool])
    return r.withColumn("proxy_url", F.element_at(urls, (turn % len(pool) + 1).cast("int"))).drop("__takes", "__turn")


def outcome_quality(kind: Column, status: Column, has_body: Column, escalates: Column, has_location: Column) -> Column:
    """How good a fetch was: of page fetches (kind http), raw fetches (raw) and failures."""
    ok = (status >= 200) & (status < 400)
    return (
        F.when(kind == "failure", 0.0).when(kind == "http", F.when(escalates, 0.2).when(has_body, 1.0).otherwise(0.25))
        .when(kind == "raw", F.when(status.isin(301, 302, 303, 307, 308) & ~has_location, 0.5).when(ok, 1.0).otherwise(0.25))
    )
