"""Fingerprints, change classes, and what an observation log says about each resource."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gossamer.functions import html as H
from gossamer.functions import robust

KINDS = ("new", "not_modified", "unchanged", "representation_changed", "semantic_changed")


@dataclass(frozen=True)
class RecrawlPolicy:
    """Seconds between fetches of a resource."""

    min_interval: float = 900.0
    base_interval: float = 86400.0
    max_interval: float = 2592000.0
    stable_multiplier: float = 2.0

    def __post_init__(self):
        if not 0 < self.min_interval <= self.base_interval <= self.max_interval or self.stable_multiplier < 1:
            raise ValueError("intervals must ascend from above 0, the multiplier be 1 at least")

    def next_interval(self, kind: Column, previous: Column) -> Column:
        base = F.lit(self.base_interval)
        held = F.when(previous > 0, previous).otherwise(base)
        return (
            F.when(kind == "new", base)
            .when(kind.isin("not_modified", "unchanged"), F.least(F.lit(self.max_interval), held * self.stable_multiplier))
            .when(kind == "representation_changed", F.greatest(F.lit(self.min_interval), F.least(base, held)))
            .when(kind == "semantic_changed", F.lit(self.min_interval))
        )

    def failure_interval(self, previous: Column) -> Column:
        held = F.when(previous > 0, previous).otherwise(F.lit(self.base_interval))
        return F.greatest(F.lit(self.min_interval), F.least(F.lit(self.base_interval), held))


def raw_fingerprint(body: Column) -> Column:
    return F.sha2(body, 256)


def semantic_fingerprint(title: Column, links: Column, canonical_url: Column, json_ld: Column, malformed: Column, open_graph: Column) -> Column:
    """SHA-256 of the canonical JSON of what a page says: sorted distinct links, structured evidence, title.

    json_ld: the canonical texts of the valid payloads; they enter the JSON as they are.
    """
    structured = F.struct(canonical_url.alias("canonical_url"), F.array().cast("array<string>").alias("json_ld"), malformed.alias("malformed_json_ld"), F.map_from_entries(F.sort_array(F.map_entries(open_graph))).alias("open_graph"))
    said = F.struct(F.sort_array(F.array_distinct(links)).alias("links"), structured.alias("structured"), title.alias("title"))
    # within a JSON text this stands once: quotes in strings are escaped, and OpenGraph keys begin with og:
    place = '"json_ld":['
    whole = F.replace(F.to_json(said, {"ignoreNullFields": "false"}), F.lit(f"{place}]"), F.concat(F.lit(place), F.array_join(json_ld, ","), F.lit("]")))
    return F.sha2(whole, 256)


def with_evidence(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Adds evidence, content_sha256 and semantic_sha256; all null where html is.

    JSON-LD counts by what it says: the order of keys and blanks don't matter,
    and of malformed scripts only how many there are. Only pages that have any
    send it to Python.
    """
    e = F.when(F.col(html).isNotNull(), H.evidence(F.col(html), F.col(url)))
    x = F.col("evidence")
    out = pages.withColumn("evidence", e)
    hidden = "payloads"
    while hidden in out.columns:
        hidden = f"_{hidden}"
    out = out.withColumn(hidden, F.coalesce(robust.canonical_payloads(F.when(F.size(x["json_ld"]) > 0, x["json_ld"])), F.array().cast("array<string>")))
    malformed = (F.size(x["json_ld"]) - F.size(hidden)).cast("long")
    semantic = semantic_fingerprint(x["title"], x["links"], x["canonical_url"], F.col(hidden), malformed, x["open_graph"])
    return out.withColumn("content_sha256", raw_fingerprint(F.col(html))).withColumn("semantic_sha256", F.when(F.col(html).isNotNull(), semantic)).drop(hidden)


def change_kind(status: Column, prev_raw: Column, prev_semantic: Column, raw: Column, semantic: Column) -> Column:
    """304 comes before all else, then whether there is a previous fingerprint, then what differs."""
    return (
        F.when(status == 304, "not_modified").when(prev_raw.isNull(), "new").when(~semantic.eqNullSafe(prev_semantic), "semantic_changed").when(~raw.eqNullSafe(prev_raw), "representation_changed").otherwise("unchanged")
    )


def changed(kind: Column) -> Column:
    return kind.isin("representation_changed", "semantic_changed")


def classify(log: DataFrame, key: list[str], at: str = "observed_at") -> DataFrame:
    """Adds kind to observations with status, content_sha256 and semantic_sha256 (null for 304).

    A 304 before anything was seen has the kind `error`.
    """
    before = Window.partitionBy(*key).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    log = log.withColumn("previous_sha256", F.last("content_sha256", ignorenulls=True).over(before)).withColumn("previous_semantic", F.last("semantic_sha256", ignorenulls=True).over(before))
    kind = change_kind(F.col("status"), F.col("previous_sha256"), F.col("previous_semantic"), F.col("content_sha256"), F.col("semantic_sha256"))
    return log.withColumn("kind", F.when((F.col("status") == 304) & F.col("previous_sha256").isNull(), "error").otherwise(kind))


def interval_fold(kinds: Column, policy: RecrawlPolicy) -> Column:
    """The interval after kinds in their order."""
    return F.aggregate(kinds, F.lit(0.0), lambda held, kind: F.coalesce(policy.next_interval(kind, held), held))


def rollup(log: DataFrame, key: list[str], policy: RecrawlPolicy | None = None, at: str = "observed_at") -> DataFrame:
    """A resource's state after all its observations; errors leave no trace."""
    policy = policy or RecrawlPolicy()
    seen = classify(log, key, at).where("kind <> 'error'")
    own = seen.groupBy(*key).agg(
        F.min(at).alias("first_seen_at"), F.max(at).alias("last_seen_at"), F.max(F.when(changed(F.col("kind")) | (F.col("kind") == "new"), F.col(at))).alias("last_changed_at"),
        F.count_if(changed(F.col("kind"))).alias("change_count"), F.max_by("kind", at).alias("last_change_kind"),
        F.max_by("content_sha256", F.when(F.col("content_sha256").isNotNull(), F.col(at))).alias("content_sha256"), F.sort_array(F.collect_list(F.struct(at, "kind"))).alias("history"),
    )
    interval = interval_fold(F.transform("history", lambda x: x["kind"]), policy)
    return own.withColumn("recrawl_interval_seconds", interval).withColumn("next_fetch_at", F.col("last_seen_at") + F.col("recrawl_interval_seconds")).drop("history")


def schedule(states: DataFrame, outcomes: DataFrame, key: list[str], policy: RecrawlPolicy, now: float) -> DataFrame:
    """states with the interval and next fetch that this round's outcomes (key, kind; null: failed) ask for."""
    kind = F.col("o.kind")
    hit = F.col("o.__hit").isNotNull()
    interval = F.when(kind.isNull(), policy.failure_interval(F.col("s.recrawl_interval_seconds"))).otherwise(policy.next_interval(kind, F.col("s.recrawl_interval_seconds")))
    joined = states.alias("s").join(outcomes.select(*key, "kind", F.lit(1).alias("__hit")).alias("o"), key, "left")
    replaced = {"recrawl_interval_seconds": F.when(hit, interval).otherwise(F.col("s.recrawl_interval_seconds")), "next_fetch_at": F.when(hit, F.lit(now) + interval).otherwise(F.col("s.next_fetch_at"))}
    return joined.select(*[replaced[c].alias(c) if c in replaced else (F.col(c) if c in key else F.col(f"s.{c}")) for c in states.columns])


def kind_counts(outcomes: DataFrame) -> DataFrame:
    """One row: how many outcomes of each kind; a null kind is a failure."""
    return outcomes.agg(F.count("*").alias("checked"), *[F.count_if(F.col("kind") == k).alias(k) for k in KINDS[1:]], F.count_if(F.col("kind").isNull()).alias("failures"))


def route_outcome(status: Column) -> Column:
    """What becomes of a refetch: 304 needs nothing, other than 2xx fails, 2xx goes on."""
    return F.when(status == 304, "not_modified").when((status >= 200) & (status < 300), "fetched").otherwise("failed")
