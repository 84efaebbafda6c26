"""Results, resource states, claims, manifests: upserts, top-k reads, claims with tokens, the lifecycle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RECORD = "url string, status_code int, content_type string, title string, links array<string>, engine string, route string, metadata string"
LIFECYCLES = ("active", "paused", "completed", "cancelled")
COMMANDS = ("pause", "resume", "cancel", "finish")


def upsert(old: DataFrame, new: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """old with new's rows in place of those of equal key; of several new rows the last in the order given wins."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return both.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("__new"), *order))).where("__r = 1").drop("__r", "__new")


def record_json(record: Column) -> Column:
    """A record as canonical JSON: keys in alphabetical order, nulls written."""
    names = sorted(x.split()[0] for x in RECORD.split(", "))
    return F.to_json(F.struct(*[record[n].alias(n) for n in names]), {"ignoreNullFields": "false"})


def decoded_record(text: Column) -> Column:
    """A stored record with the defaults of fields that are missing."""
    r = F.from_json(text, RECORD)
    d = {"engine": F.lit("http"), "route": F.lit("direct"), "links": F.array().cast("array<string>"), "metadata": F.lit("{}")}
    return F.when(r.isNotNull(), F.struct(*[(F.coalesce(r[n], d[n]) if n in d else r[n]).alias(n) for n in (x.split()[0] for x in RECORD.split(", "))]))


def decoded_metadata(text: Column) -> Column:
    """Metadata if it is a JSON object, else null."""
    return F.when(F.get_json_object(text, "$").isNotNull() & F.trim(text).startswith("{"), F.get_json_object(text, "$"))


def decoded_fingerprint(metadata: Column) -> Column:
    """The fingerprint in a record's metadata; null unless both hashes are text."""
    f = F.from_json(F.get_json_object(metadata, "$.fingerprint"), "content_sha256 string, semantic_sha256 string, etag string, last_modified string")
    return F.when(f["content_sha256"].isNotNull() & f["semantic_sha256"].isNotNull(), f)


def due(states: DataFrame, now: float, limit: int) -> DataFrame:
    return states.where(F.col("next_fetch_at").isNotNull() & (F.col("next_fetch_at") <= now)).orderBy("next_fetch_at", "crawl_id", "request_url").limit(limit)


def page_of(results: DataFrame, crawl_id: str, limit: int, offset: int) -> DataFrame:
    if not 1 <= limit <= 1000 or offset < 0:
        raise ValueError("limit must be from 1 to 1000, offset not negative")
    return results.where(F.col("crawl_id") == crawl_id).orderBy("recorded_at", "request_url").offset(offset).limit(limit)


def runnable(manifests: DataFrame, limit: int) -> DataFrame:
    return manifests.where("lifecycle = 'active'").orderBy("updated_at", "crawl_id").limit(limit).select("crawl_id")


def claim_due(states: DataFrame, manifests: DataFrame, claims: DataFrame, *, limit: int, lease_seconds: float, now: float) -> DataFrame:
    """New claims on the resources of completed crawls that are due and not claimed, longest due first."""
    done = manifests.where("lifecycle = 'completed'").select("crawl_id")
    live = claims.where(F.col("expires_at") > now).select("crawl_id", "request_url")
    free = states.where(F.col("next_fetch_at") <= now).join(done, "crawl_id").join(live, ["crawl_id", "request_url"], "left_anti")
    token = F.sha2(F.concat_ws("|", "crawl_id", "request_url", F.lit(str(now))), 256)
    return free.orderBy("next_fetch_at", "crawl_id", "request_url").limit(limit).select("crawl_id", "request_url", token.alias("token"), F.lit(now + lease_seconds).alias("expires_at"), "next_fetch_at", "recrawl_interval_seconds")


def matching(claims: DataFrame, given: DataFrame) -> DataFrame:
    """What of given (crawl_id, request_url, token, ...) holds an actual claim."""
    return given.join(claims.select("crawl_id", "request_url", "token"), ["crawl_id", "request_url", "token"], "left_semi")


def reschedule(states: DataFrame, claims: DataFrame, given: DataFrame) -> tuple[DataFrame, DataFrame]:
    """states and claims after given (crawl_id, request_url, token, interval_seconds, at); without its claim it changes nothing."""
    key = ["crawl_id", "request_url"]
    good = matching(claims, given).select(*key, "interval_seconds", "at")
    s = states.join(good, key, "left").withColumns({"recrawl_interval_seconds": F.coalesce("interval_seconds", "recrawl_interval_seconds"), "next_fetch_at": F.coalesce("at", "next_fetch_at")})
    return s.select(*states.columns), release(claims, given)


def release(claims: DataFrame, given: DataFrame) -> DataFrame:
    return claims.join(given.select("crawl_id", "request_url", "token"), ["crawl_id", "request_url", "token"], "left_anti")


def prune(children: DataFrame, parents: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose parent is still there."""
    return children.join(parents.select(*key).distinct(), key, "left_semi")


def created(manifests: DataFrame, new: DataFrame, *order: Column) -> DataFrame:
    """new with created: whether it makes a manifest, or its id is taken (by an older one or an earlier new one)."""
    first = F.row_number().over(Window.partitionBy("crawl_id").orderBy(*order)) == 1
    old = manifests.select("crawl_id", F.lit(True).alias("__old")).distinct()
    return new.withColumn("__first", first).join(old, "crawl_id", "left").withColumn("created", F.col("__first") & F.col("__old").isNull()).drop("__first", "__old")


def conflicts(manifests: DataFrame, submitted: DataFrame, fields: list[str]) -> DataFrame:
    """Submitted manifests whose id exists with other settings."""
    a, b = manifests.alias("a"), submitted.alias("b")
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}"))
    return b.join(a, "crawl_id").where(~same).select("crawl_id")


def set_lifecycle(manifests: DataFrame, wanted: DataFrame, now: float) -> DataFrame:
    """manifests after wanted (crawl_id, lifecycle); values out of the vocabulary change nothing."""
    good = wanted.where(F.col("lifecycle").isin(*LIFECYCLES)).select("crawl_id", F.col("lifecycle").alias("__to"))
    return manifests.join(good, "crawl_id", "left").withColumns({"lifecycle": F.coalesce("__to", "lifecycle"), "updated_at": F.when(F.col("__to").isNotNull(), now).otherwise(F.col("updated_at"))}).select(*manifests.columns)


def lifecycle_step(state: Column, command: Column, complete: Column) -> Column:
    """pause and resume do nothing to a cancelled crawl; resume completes a crawl with nothing left to do; finish ends an active one."""
    return (
        F.when(command == "cancel", "cancelled").when((command == "pause") & (state != "cancelled"), "paused")
        .when((command == "resume") & (state == "paused"), F.when(complete, "completed").otherwise("active")).when((command == "finish") & (state == "active"), "completed").otherwise(state)
    )


def lifecycle_fold(log: DataFrame, key: str, at: str) -> DataFrame:
    """Each crawl's lifecycle after its commands (columns command, complete), in order, from `active` on."""
    told = log.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(at, "command", "complete"))).alias("log"))
    return told.select(key, F.aggregate("log", F.lit("active"), lambda s, x: lifecycle_step(s, x["command"], x["complete"])).alias("lifecycle"), F.size("log").cast("long").alias("commands"))


def refused_commands(log: DataFrame, key: str, at: str) -> DataFrame:
    """The commands of the log that lifecycle_fold passes over as they are errors: a cancelled crawl can't be paused or resumed."""
    cancelled = log.where("command = 'cancel'").groupBy(key).agg(F.min(at).alias("__since"))
    late = log.where(F.col("command").isin("pause", "resume")).join(cancelled, key).where(F.col(at) > F.col("__since")).drop("__since")
    return late.withColumn("error", F.concat(F.lit("cancelled crawl cannot be "), F.col("command"), F.lit("d: "), F.col(key)))


def index_records(records: DataFrame, *, last: bool) -> DataFrame:
    """key, pos of the record that each requested or final URL leads to: the first or the last that has it.

    records: pos, requested_url, url.
    """
    keys = records.select("pos", F.explode(F.array_distinct(F.array(F.coalesce("requested_url", "url"), "url"))).alias("key"))
    order = F.desc("pos") if last else F.asc("pos")
    return keys.withColumn("__r", F.row_number().over(Window.partitionBy("key").orderBy(order))).where("__r = 1").drop("__r")


def batch_outcomes(leases: DataFrame, records: DataFrame) -> DataFrame:
    """leases with the pos of their record and verb: ack, or fail without one."""
    found = leases.join(index_records(records, last=False).withColumnRenamed("key", "url"), "url", "left")
    return found.withColumn("verb", F.when(F.col("pos").isNull(), "fail").otherwise("ack")).withColumn("error", F.when(F.col("pos").isNull(), "fetch batch produced no PageRecord"))


def merged_rendering(static: DataFrame, rendered: DataFrame, on: Sequence[str] = ("url",)) -> DataFrame:
    """Static records with their rendering merged in: its fields and metadata win, requested_url stays; a note where rendering failed.

    static: url, requested_url, title, requires_browser, metadata (map); rendered: the columns on, title, metadata. A record's
    rendering is the one with its values of on; name more than url where several records have one URL.
    """
    r = rendered.select(*on, F.col("title").alias("__title"), F.col("metadata").alias("__meta"), F.lit(True).alias("__hit"))
    j = static.join(r, list(on), "left")
    hit = F.col("requires_browser") & F.col("__hit").isNotNull()
    own = F.map_filter("metadata", lambda k, _: ~F.map_contains_key(F.coalesce("__meta", F.create_map().cast("map<string,string>")), k))
    note = F.create_map(F.lit("browser_error"), F.lit("render failed"))
    meta = F.when(hit, F.map_concat(own, "__meta")).when(F.col("requires_browser"), F.map_concat(F.map_filter("metadata", lambda k, _: k != "browser_error"), note)).otherwise(F.col("metadata"))
    return j.select("url", "requested_url", F.when(hit, F.col("__title")).otherwise(F.col("title")).alias("title"), F.when(hit, "browser").otherwise("http").alias("engine"), meta.alias("metadata"))
