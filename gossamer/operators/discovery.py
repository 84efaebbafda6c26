"""robots, sitemaps and feeds as tables, and bounded walks over them."""

from __future__ import annotations

import re
import tempfile
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gossamer.functions import urls

LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
MAX_BYTES = 10 * 1024 * 1024


def unsafe_xml(body: Column) -> Column:
    """Whether the first 256 KiB declare a document type or an entity; such a document is refused before any parser sees it."""
    return F.substring(body, 1, 262144).rlike(r"(?i)<!(doctype|entity)")


def oversized(body: Column, most: int = MAX_BYTES) -> Column:
    return F.octet_length(body) > most


def _distinct_urls(base: Column, values: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(values, lambda v: urls.safe_join(base, v)), lambda u: u.isNotNull()))


def _unescaped(text: Column) -> Column:
    for name, c in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(c))
    return text


def robots_sitemaps(text: Column, source_url: Column) -> Column:
    lines = F.transform(F.split(text, LINE_ENDS), lambda x: F.trim(F.regexp_extract(x, "^([^#]*)", 1)))
    found = F.filter(lines, lambda x: F.lower(F.trim(F.regexp_extract(x, "^([^:]*):", 1))) == "sitemap")
    return _distinct_urls(source_url, F.transform(found, lambda x: F.trim(F.regexp_extract(x, "^[^:]*:(.*)$", 1))))


def text_urls(text: Column, source_url: Column) -> Column:
    return _distinct_urls(source_url, F.split(text, LINE_ENDS))


def _elements(body: Column, name: str) -> Column:
    return F.regexp_extract_all(body, F.lit(rf"(?s)<(?:\w+:)?{name}(?:\s[^>]*)?>(.*?)</(?:\w+:)?{name}>"), F.lit(1))


def sitemap(body: Column, source_url: Column) -> Column:
    """kind (urlset, sitemapindex, text, or null if refused) and urls: of each entry the first loc, or of a text each line."""
    bare = F.regexp_replace(body, r"^\s+", "")
    root = F.regexp_extract(bare, r"(?s)^(?:<\?.*?\?>|<!--.*?-->|\s)*<(?:\w+:)?(\w+)", 1)
    xml = bare.startswith("<")
    kind = F.when(~xml, "text").when(unsafe_xml(bare) | ~root.isin("urlset", "sitemapindex"), None).otherwise(root)
    entries = F.when(root == "urlset", _elements(bare, "url")).otherwise(_elements(bare, "sitemap"))
    locs = F.transform(entries, lambda e: _unescaped(F.regexp_extract(e, r"(?s)<(?:\w+:)?loc(?:\s[^>]*)?>(.*?)</(?:\w+:)?loc>", 1)))
    found = F.when(kind == "text", text_urls(bare, source_url)).when(kind.isNotNull(), _distinct_urls(source_url, locs))
    return F.struct(kind.alias("kind"), found.alias("urls"))


def feed(body: Column, source_url: Column) -> Column:
    """kind (feed-rss, feed-atom or null) and urls: an item's first usable link; an entry's best link, alternate before others."""
    bare = F.regexp_replace(body, r"^\s+", "")
    root = F.lower(F.regexp_extract(bare, r"(?s)^(?:<\?.*?\?>|<!--.*?-->|\s)*<(?:\w+:)?(\w+)", 1))
    kind = F.when(unsafe_xml(bare), None).when(root.isin("rss", "rdf"), "feed-rss").when(root == "feed", "feed-atom")
    first_valid = lambda e: F.get(F.filter(F.transform(_elements(e, "link"), lambda x: urls.safe_join(source_url, _unescaped(x))), lambda u: u.isNotNull()), F.lit(0))
    rss = F.transform(_elements(bare, "item"), first_valid)

    def best(entry: Column) -> Column:
        tags = F.regexp_extract_all(entry, F.lit(r"(?s)<(?:\w+:)?link\s[^>]*>"), F.lit(0))
        rel = lambda t: F.lower(F.regexp_extract(t, r'\srel="([^"]*)"', 1))
        made = F.transform(tags, lambda t, k: F.struct(F.when(rel(t).isin("", "alternate"), 0).otherwise(1).alias("p"), k.alias("k"), urls.safe_join(source_url, _unescaped(F.regexp_extract(t, r'\shref="([^"]*)"', 1))).alias("u")))
        return F.get(F.array_sort(F.filter(made, lambda m: m.u.isNotNull())), F.lit(0))["u"]

    atom = F.transform(_elements(bare, "entry"), best)
    found = F.array_distinct(F.filter(F.when(kind == "feed-rss", rss).when(kind == "feed-atom", atom), lambda u: u.isNotNull()))
    return F.struct(kind.alias("kind"), found.alias("urls"))


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, on one machine (tests) a folder of our own, on a cluster an error."""
    said = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if said:
        return said.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='gossamer-')}")
    return spark.sparkContext.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """Cuts the lineage of a loop's table: written as Parquet to the folder that all executors share, and read again.

    With checkpoints a crawl's steps grew from 0.4 to 23 seconds within eight
    batches (most likely by the constraints that a checkpoint hands on to the
    optimizer), and they have no sizes to plan joins by. A table that grows by unions would have more partitions each time: so
    many as a shuffle has, or the cores, stay.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gossamer/{uuid.uuid4().hex}"
    df.coalesce(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def reach(edges: DataFrame, seeds: DataFrame, *, max_depth: int | None = None) -> DataFrame:
    """node, depth of what seeds (node) lead to over edges (parent, child), each at its least depth; cycles are fine."""
    seen = kept(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    front, depth = seen, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        new = front.join(edges, front["node"] == edges["parent"]).select(F.col("child").alias("node")).distinct().join(seen, "node", "left_anti")
        front = kept(new.withColumn("depth", F.lit(depth)))
        if not front.head(1):
            break
        seen = kept(seen.unionByName(front))
    return seen


@dataclass(frozen=True)
class Walked:
    """urls of a walk, the documents that it asked for (site, url, depth, rank), and the sites that a bound cut short."""

    urls: DataFrame
    documents: DataFrame
    truncated: DataFrame


def walk(documents: DataFrame, roots: DataFrame, *, max_documents: int, max_depth: int, max_urls: int, scope: DataFrame | None = None) -> Walked:
    """What each site's sitemaps lead to: site, url, source_url, via, depth, pos, each url where it is found first.

    documents: url, status, kind, urls (in order); roots: site, url, pos. Level
    by level, in order within a level; a document counts against
    max_documents even if it fails; a url is found once per site. With scope
    (site, host) only urls on their site's host count.
    """
    key = ["site", "url"]
    level = kept(roots.select("site", "url", F.row_number().over(Window.partitionBy("site").orderBy("pos", "url")).alias("pos")).withColumn("depth", F.lit(0)))
    seen, parts, cut = None, None, []
    for depth in range(max_depth + 1):
        first = level.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy("pos"))).where("__r = 1").drop("__r")
        if seen is not None:
            used = seen.groupBy("site").agg(F.count("*").alias("used"))
            first = first.join(seen.select(*key), key, "left_anti").join(used, "site", "left")
        else:
            first = first.withColumn("used", F.lit(0))
        order = F.row_number().over(Window.partitionBy("site").orderBy("pos"))
        ranked = kept(first.withColumn("rank", order + F.coalesce("used", F.lit(0))).select("site", "url", "depth", "rank"))
        cut.append(ranked.where(F.col("rank") > max_documents).select("site"))
        first = ranked.where(F.col("rank") <= max_documents)
        level = None
        if not first.head(1):
            break
        seen = first if seen is None else kept(seen.unionByName(first))
        got = first.join(documents.where("status between 200 and 299 and kind is not null"), "url").select("site", F.col("url").alias("source_url"), "depth", "rank", "kind", F.posexplode("urls").alias("k", "url"))
        got = kept(got)
        found = got.where("kind <> 'sitemapindex'").select("site", "url", "source_url", F.col("kind").alias("via"), "depth", "rank", "k")
        parts = found if parts is None else parts.unionByName(found)
        nested = got.where("kind = 'sitemapindex'").select("site", "url", F.row_number().over(Window.partitionBy("site").orderBy("rank", "k")).alias("pos"))
        level = kept(nested.withColumn("depth", F.lit(depth + 1)))
    if parts is None:  # no roots
        parts = roots.where("false").select("site", "url", F.col("url").alias("source_url"), F.lit("").alias("via"), F.lit(0).alias("depth"), F.lit(0).alias("rank"), F.lit(0).alias("k"))
        seen = ranked
    if level is not None:  # indexes at the last depth lead further
        cut.append(level.select("site"))
    if scope is not None:
        parts = parts.withColumn("host", urls.host(F.col("url"))).join(scope.select("site", "host"), ["site", "host"], "left_semi").drop("host")
    first = parts.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy("rank", "k"))).where("__r = 1").drop("__r")
    placed = first.withColumn("pos", F.row_number().over(Window.partitionBy("site").orderBy("rank", "k")).cast("long"))
    cut.append(placed.where(F.col("pos") > max_urls).select("site"))
    return Walked(placed.where(F.col("pos") <= max_urls).select("site", "url", "source_url", "via", "depth", "pos"), seen, reduce(DataFrame.unionByName, cut).distinct())


def sitemap_walk(documents: DataFrame, roots: DataFrame, *, max_documents: int, max_depth: int, max_urls: int) -> DataFrame:
    """The urls of walk."""
    return walk(documents, roots, max_documents=max_documents, max_depth=max_depth, max_urls=max_urls).urls


def discover(seeds: DataFrame, fetched: DataFrame, *, max_documents: int = 32, max_depth: int = 4, max_urls: int = 10_000, max_bytes: int = MAX_BYTES, same_domain: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """urls, failures (site, url, error) and the state (site, documents, truncated) of each seed's (site, seed) discovery.

    fetched: url, status, body. A site's roots are the sitemaps that its
    robots.txt names, else /sitemap.xml. A document that isn't there, has a
    status other than 2xx, is too large or no sitemap is a failure; so is a
    missing robots.txt, but not one with another status.
    """
    sites = seeds.select("site", urls.canonical(F.col("seed")).alias("seed")).where("seed is not null").withColumn("robots", F.concat(urls.origin(F.col("seed")), F.lit("/robots.txt")))
    got = fetched.select("url", "status", "body")
    robots = sites.join(got.withColumnRenamed("url", "robots"), "robots", "left")
    named = F.when(F.col("status").between(200, 299), robots_sitemaps(F.col("body"), F.col("robots")))
    default = F.array(F.concat(urls.origin(F.col("seed")), F.lit("/sitemap.xml")))
    roots = kept(robots.select("site", "robots", "status", F.posexplode(F.when(F.size(named) > 0, named).otherwise(default)).alias("pos", "url")))
    parsed = got.withColumn("large", oversized(F.col("body"), max_bytes)).withColumn("map", F.when(~F.col("large"), sitemap(F.col("body"), F.col("url"))))
    parsed = parsed.select("url", "status", "large", "map.kind", "map.urls")
    walked = walk(parsed, roots.select("site", "url", "pos"), max_documents=max_documents, max_depth=max_depth, max_urls=max_urls, scope=sites.select("site", urls.host(F.col("seed")).alias("host")) if same_domain else None)
    tried = walked.documents.join(parsed, "url", "left")
    error = (
        F.when(F.col("status").isNull(), "FetchError: not_found").when(~F.col("status").between(200, 299), F.concat(F.lit("HTTP "), F.col("status").cast("string")))
        .when(F.col("large"), "FetchError: too_large").when(F.col("kind").isNull(), "ParseError: not a sitemap")
    )
    no_robots = roots.where("status is null").select("site", F.col("robots").alias("url"), F.lit("FetchError: not_found").alias("error")).distinct()
    failures = no_robots.unionByName(tried.select("site", "url", error.alias("error")).where("error is not null"))
    n = walked.documents.groupBy("site").agg(F.count("*").alias("documents"))
    state = sites.select("site").join(n, "site", "left").na.fill(0, ["documents"]).join(walked.truncated.withColumn("__cut", F.lit(True)), "site", "left")
    return walked.urls, failures, state.select("site", "documents", F.col("__cut").isNotNull().alias("truncated"))


def redirect_chains(starts: DataFrame, hops: DataFrame, *, max_redirects: int = 10) -> DataFrame:
    """start, final_url, hops, status of following hops (url, location) from starts (url): `ok`, or `too_many`.

    Hops whose location is null end a chain. Validators go along only while the origin stays: same_origin.
    """
    at = starts.select(F.col("url").alias("start"), F.col("url"), F.lit(0).alias("hops"), F.lit(True).alias("same_origin"))
    done = None
    moves = hops.where("location is not null").select(F.col("url").alias("__from"), F.col("location").alias("__to"))
    for k in range(max_redirects + 1):
        j = kept(at.join(moves, at["url"] == moves["__from"], "left"))
        ended = j.where("__to is null" if k < max_redirects else "true")
        status = F.when(F.col("__to").isNull(), "ok").otherwise("too_many")
        part = ended.select("start", F.col("url").alias("final_url"), "hops", "same_origin", status.alias("status"))
        done = part if done is None else done.unionByName(part)
        if k < max_redirects:
            going = j.where("__to is not null")
            at = going.select("start", F.col("__to").alias("url"), (F.col("hops") + 1).alias("hops"), (F.col("same_origin") & urls.same_origin(F.col("url"), F.col("__to"))).alias("same_origin"))
    return done


def discovery_budget(found: DataFrame, lane: str, order: str, n: str, most: int) -> DataFrame:
    """found with allowed: how many of a seed's n urls fit into what earlier seeds of the lane left of most."""
    before = F.coalesce(F.sum(n).over(Window.partitionBy(lane).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return found.withColumn("allowed", F.greatest(F.lit(0), F.least(F.col(n), F.lit(most) - before)).cast("long"))
