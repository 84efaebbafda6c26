"""Queries over pages: URLs, evidence, fingerprints, changes and schedules."""

from __future__ import annotations

from pyspark.sql import functions as F

from gossamer.functions import html as H
from gossamer.functions import robust, urls
from gossamer.operators import change, egress, store
from gossamer.plans import duck
from gossamer.plans.relations import NOW, relation

POLICY = change.RecrawlPolicy()
QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def rel(*names: str) -> str:
    from gossamer.plans.relations import duck as text

    return "WITH " + text(*names)


c = F.col


@query(f"{rel('variants')}, {duck.url_parts('variants', 'u', 'page_id, v', 'x')} SELECT page_id, v, canon AS canonical_url FROM x")
def canonicalize_urls(spark, sf_dir):
    return relation(spark, sf_dir, "variants").select("page_id", "v", urls.canonical(c("u")).alias("canonical_url"))


@query(f"{rel('refs')}, r AS (SELECT page_id, v, {duck.resolve('base', 'ref')} AS u FROM refs), {duck.url_parts('r', 'u', 'page_id, v, u', 'x')} SELECT page_id, v, u AS resolved, canon AS canonical_url FROM x")
def resolve_links(spark, sf_dir):
    r = relation(spark, sf_dir, "refs").withColumn("resolved", urls.resolve(c("base"), c("ref")))
    return r.select("page_id", "v", "resolved", urls.canonical(c("resolved")).alias("canonical_url"))


@query(f"{rel('variants')}, {duck.url_parts('variants', 'u', 'page_id, v', 'x')} SELECT page_id, v, CASE WHEN length(h) > 0 AND (contains(h, ':') OR regexp_matches(h, '^[^.]{{1,63}}(\\.[^.]{{1,63}})*$')) THEN h END AS host FROM x")
def page_hosts(spark, sf_dir):
    return relation(spark, sf_dir, "variants").select("page_id", "v", urls.host(c("u")).alias("host"))


@query(f"""{rel('refs')}, r AS (SELECT page_id, v, base, {duck.resolve('base', 'ref')} AS u FROM refs), {duck.url_parts('r', 'u', 'page_id, v', 'x')}, {duck.url_parts('r', 'base', 'page_id, v', 'y')}
SELECT x.page_id, x.v, x.canon AS link FROM x JOIN y USING (page_id, v) WHERE x.ok AND x.h = y.h""")
def in_scope_links(spark, sf_dir):
    r = relation(spark, sf_dir, "refs").withColumn("u", urls.resolve(c("base"), c("ref"))).withColumn("link", urls.canonical(c("u")))
    return r.where(c("link").isNotNull() & urls.same_host(c("u"), c("base"))).select("page_id", "v", "link")


@query(f"""{rel('variants')}, {duck.url_parts('variants', 'u', 'page_id, v', 'x')}, {duck.url_parts('pages', "'https://h' || page_id || '.example:443/'", 'page_id', 'y')}
SELECT x.page_id, x.v, coalesce(x.s = y.s AND x.h = y.h AND CASE WHEN x.o = '' THEN CASE x.s WHEN 'https' THEN 443 ELSE 80 END ELSE try_cast(x.o AS INT) END = 443, false) AS same_origin FROM x JOIN y USING (page_id)""")
def same_origin_pairs(spark, sf_dir):
    v = relation(spark, sf_dir, "variants").withColumn("w", F.concat(F.lit("https://h"), c("page_id").cast("string"), F.lit(".example:443/")))
    return v.select("page_id", "v", F.coalesce(urls.same_origin(c("u"), c("w")), F.lit(False)).alias("same_origin"))


@query(f"SELECT page_id, {duck.part('url', 1)} || '://' || {duck.part('url', 2)} AS origin, {duck.part('url', 1)} || '://' || {duck.part('url', 2)} || '/robots.txt' AS robots_url FROM pages")
def url_origins(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", urls.origin(c("url")).alias("origin"), F.concat(urls.origin(c("url")), F.lit("/robots.txt")).alias("robots_url"))


_IDS = "CASE page_id % 6 WHEN 0 THEN 'cr_' || CAST(page_id AS STRING) WHEN 1 THEN '-x' WHEN 2 THEN '' WHEN 3 THEN 'a b' WHEN 4 THEN repeat('a', 128) ELSE repeat('a', 129) END"


@query(f"SELECT page_id, regexp_matches({_IDS}, '^[A-Za-z0-9][A-Za-z0-9._\\-]{{0,127}}$') AS valid FROM pages")
def valid_crawl_ids(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", urls.valid_crawl_id(F.expr(_IDS)).alias("valid"))


@query("SELECT page_id, substr(sha256('c' || page_id), 1, 24) AS tag FROM pages")
def crawl_hash_tag(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", urls.crawl_hash_tag(F.concat(F.lit("c"), c("page_id").cast("string"))).alias("tag"))


_LENGTHS = "CASE page_id % 8 WHEN 0 THEN CAST(page_id AS STRING) WHEN 1 THEN ' 12 ' WHEN 2 THEN '-5' WHEN 3 THEN '+7' WHEN 4 THEN '1_000' WHEN 5 THEN '1.5' WHEN 6 THEN '' ELSE CAST(NULL AS STRING) END"


@query(f"""SELECT page_id, CASE WHEN n >= 0 THEN n END AS content_length FROM (SELECT page_id, CASE WHEN regexp_matches(t, '^[+\\-]?[0-9]+(_[0-9]+)*$') THEN try_cast(replace(replace(t, '_', ''), '+', '') AS BIGINT) END AS n
FROM (SELECT page_id, trim({_LENGTHS}) AS t FROM pages) AS a) AS b""")
def content_length(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", urls.content_length(F.expr(_LENGTHS)).alias("content_length"))


@query("""SELECT page_id, CASE page_id % 3 WHEN 0 THEN '"e' || page_id || '"' END AS etag, CASE page_id % 2 WHEN 0 THEN 'Mon ' || page_id END AS last_modified FROM pages""")
def http_validators(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    h = F.map_from_arrays(F.array(F.lit("ETag"), F.lit("Last-Modified"), F.lit("X")), F.array(F.when(c("page_id") % 3 == 0, F.concat(F.lit(' "e'), c("page_id").cast("string"), F.lit('" '))).otherwise(F.lit("  ")), F.when(c("page_id") % 2 == 0, F.concat(F.lit("Mon "), c("page_id").cast("string"))), F.lit("y")))
    return p.select("page_id", urls.validators(h).alias("v")).select("page_id", "v.etag", "v.last_modified")


@query("""SELECT page_id, array_to_string(list_filter([CASE WHEN page_id % 2 = 0 THEN 'If-Modified-Since=d' || page_id END, CASE WHEN page_id % 3 = 0 THEN 'If-None-Match=e' || page_id END], lambda x: x IS NOT NULL), '&') AS headers FROM pages""")
def conditional_headers(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    m = urls.conditional_headers(F.when(c("page_id") % 3 == 0, F.concat(F.lit("e"), c("page_id").cast("string"))), F.when(c("page_id") % 2 == 0, F.concat(F.lit("d"), c("page_id").cast("string"))))
    return p.select("page_id", F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "&").alias("headers"))


@query(f"SELECT page_id, {duck.title('html')} AS title FROM pages")
def page_titles(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", H.title(c("html")).alias("title"))


@query(f"WITH {duck.links('pages', 'page_id', 'html', 'url', 'lk')} SELECT page_id, len(links)::BIGINT AS n_links, array_to_string(links, ' ') AS links FROM lk")
def page_links(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", H.links(c("html"), c("url")).alias("l"))
    return p.select("page_id", F.size("l").cast("long").alias("n_links"), F.array_join("l", " ").alias("links"))


@query(f"""{rel('rich')}, a AS (SELECT page_id, url, list_filter(regexp_extract_all(html, '(?is)<link\\s[^>]*>'), lambda t: list_contains(regexp_split_to_array(lower(regexp_extract(t, '(?is)\\srel="([^"]*)"', 1)), '\\s+'), 'canonical') AND regexp_extract(t, '(?is)\\shref="([^"]*)"', 1) <> '') AS ts FROM rich),
b AS (SELECT page_id, url, regexp_extract(ts[1], '(?is)\\shref="([^"]*)"', 1) AS r FROM a WHERE len(ts) > 0), d AS (SELECT page_id, {duck.resolve('url', duck.unescape('r'))} AS u FROM b), {duck.url_parts('d', 'u', 'page_id', 'x')}
SELECT p.page_id, x.canon AS canonical_url FROM pages p LEFT JOIN x USING (page_id)""")
def canonical_links(spark, sf_dir):
    return relation(spark, sf_dir, "rich").select("page_id", H.canonical_link(c("html"), c("url")).alias("canonical_url"))


@query(f"{rel('rich')} SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END::BIGINT AS payloads, CASE WHEN page_id % 7 = 0 THEN 1 ELSE 0 END::BIGINT AS malformed FROM rich")
def json_ld_counts(spark, sf_dir):
    return relation(spark, sf_dir, "rich").select("page_id", H.json_ld_counts(c("html")).alias("j")).select("page_id", "j.payloads", "j.malformed")


@query(f"""{rel('rich')}, t AS (SELECT page_id, unnest(ts) AS t, generate_subscripts(ts, 1) AS k FROM (SELECT page_id, regexp_extract_all(html, '(?is)<meta\\s[^>]*>') AS ts FROM rich) AS a),
m AS (SELECT page_id, k, lower(trim(regexp_extract(t, '(?is)\\sproperty="([^"]*)"', 1))) AS p, trim(regexp_extract(t, '(?is)\\scontent="([^"]*)"', 1)) AS v FROM t),
g AS (SELECT page_id, p, list(v ORDER BY k) AS vs FROM m WHERE starts_with(p, 'og:') AND v <> '' GROUP BY ALL)
SELECT page_id, p AS property, array_to_string(vs, '|') AS contents FROM g""")
def open_graph(spark, sf_dir):
    return relation(spark, sf_dir, "rich").select("page_id", F.explode(H.open_graph(c("html"))).alias("property", "v")).select("page_id", "property", F.array_join("v", "|").alias("contents"))


@query(f"""{rel('shells')}, a AS (SELECT page_id, html, CASE page_id % 4 WHEN 0 THEN 0 WHEN 1 THEN length('Head ' || page_id) + CASE WHEN page_id % 90 > 0 THEN 1 + 5 * (page_id % 90) - 1 ELSE 0 END WHEN 2 THEN 399 ELSE 2 * length('a ' || page_id || ' b') - 1 + 1 - (length('a ' || page_id || ' b') - length('a ' || page_id) - 1) + 0 END AS n0 FROM shells),
b AS (SELECT page_id, html, CASE WHEN page_id % 4 = 3 THEN length('a ' || page_id || ' b') + 1 + length('a ' || page_id) + 1 + 1 ELSE n0 END::BIGINT AS n, length(regexp_replace(html, '<script', '', 'g')) AS cut FROM a),
d AS (SELECT page_id, n, ((length(html) - cut) / 7)::BIGINT AS scripts, page_id % 4 <> 1 AS root, page_id % 4 = 0 AS js FROM b),
e AS (SELECT *, CASE WHEN n < 80 THEN 2 WHEN n < 200 THEN 1 ELSE 0 END + CASE WHEN root THEN 2 ELSE 0 END + CASE WHEN js THEN 3 ELSE 0 END + CASE WHEN scripts >= 3 THEN 1 ELSE 0 END - CASE WHEN n >= 300 THEN 3 ELSE 0 END AS score FROM d)
SELECT page_id, score >= 4 AND n < 300 AS requires_browser, score::BIGINT AS score, n AS visible_text_length, scripts AS script_count,
  array_to_string(list_filter([CASE WHEN n < 80 THEN 'very-little-visible-content' WHEN n < 200 THEN 'little-visible-content' END, CASE WHEN root THEN 'client-app-root' END, CASE WHEN js THEN 'javascript-required-message' END, CASE WHEN scripts >= 3 THEN 'script-heavy-shell' END, CASE WHEN n >= 300 THEN 'meaningful-server-rendered-content' END], lambda x: x IS NOT NULL), ',') AS reasons FROM e""")
def rendering_assessment(spark, sf_dir):
    r = relation(spark, sf_dir, "shells").select("page_id", H.rendering(c("html")).alias("r"))
    return r.select("page_id", "r.requires_browser", "r.score", "r.visible_text_length", "r.script_count", F.array_join("r.reasons", ",").alias("reasons"))


@query(f"""WITH {duck.links('pages', 'page_id', 'html', 'url', 'lk')} SELECT page_id, {duck.title('html')} AS title, len(links)::BIGINT AS n_links, links[1] AS first_link, CAST(NULL AS VARCHAR) AS canonical_url, 0::BIGINT AS malformed_json_ld FROM pages JOIN lk USING (page_id)""")
def parse_pages(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", H.evidence(c("html"), c("url")).alias("e"))
    return p.select("page_id", "e.title", F.size("e.links").cast("long").alias("n_links"), F.get("e.links", F.lit(0)).alias("first_link"), "e.canonical_url", "e.malformed_json_ld")


@query(f"""WITH {duck.links('pages', 'page_id', 'html', 'url', 'lk')} SELECT page_id, len(links)::BIGINT AS n_links FROM lk""")
def parse_pages_robust(spark, sf_dir):
    """The tolerant parser on the same pages: whole evidence, here its number of links."""
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", robust.page_any(c("html"), c("url")).alias("e")).select("page_id", F.size("e.links").cast("long").alias("n_links"))


@query("SELECT page_id, sha256(html) AS content_sha256, octet_length(encode(html))::BIGINT AS n_bytes FROM pages")
def content_fingerprint(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", change.raw_fingerprint(c("html")).alias("content_sha256"), F.octet_length("html").cast("long").alias("n_bytes"))


@query(f"WITH {duck.links('pages', 'page_id', 'html', 'url', 'lk')} SELECT page_id, {duck.semantic(duck.title('html'), 'links')} AS semantic_sha256 FROM pages JOIN lk USING (page_id)")
def semantic_fingerprint(spark, sf_dir):
    return change.with_evidence(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "semantic_sha256")


_PAYLOADS = """CASE WHEN page_id % 5 < 3 THEN '{"a":"x' || page_id || '","b":[1,true,null]}' WHEN page_id % 5 = 3 THEN '[{"@id":7,"@type":"Thing"}],"plain"' ELSE '' END"""


@query(f"""WITH {duck.links('pages', 'page_id', 'html', 'url', 'lk')} SELECT page_id, {duck.semantic(duck.title('html'), 'links', _PAYLOADS, "CASE WHEN page_id % 5 = 2 THEN '1' ELSE '0' END")} AS semantic_sha256 FROM pages JOIN lk USING (page_id)""")
def semantic_fingerprint_json_ld(spark, sf_dir):
    """Pages with valid, reordered and malformed JSON-LD: what it says counts, not how it is written."""
    return change.with_evidence(relation(spark, sf_dir, "linked")).select("page_id", "semantic_sha256")


def _classified(spark, sf_dir):
    return change.classify(change.with_evidence(relation(spark, sf_dir, "log")), ["page_id"])


@query(f"{rel('log')}, {duck.observed()} SELECT page_id, k, kind, kind IN ('representation_changed', 'semantic_changed') AS changed FROM obs")
def change_kinds(spark, sf_dir):
    return _classified(spark, sf_dir).select("page_id", "k", "kind", change.changed(c("kind")).alias("changed"))


_STATE = f"""SELECT page_id, min(observed_at) AS first_seen_at, max(observed_at) AS last_seen_at, max(observed_at) FILTER (kind IN ('new', 'representation_changed', 'semantic_changed')) AS last_changed_at, count(*) FILTER (kind IN ('representation_changed', 'semantic_changed')) AS change_count,
  arg_max(kind, observed_at) AS last_change_kind, arg_max(raw, observed_at) FILTER (raw IS NOT NULL) AS content_sha256, {duck.fold('list(kind ORDER BY observed_at)')} AS recrawl_interval_seconds FROM obs WHERE kind <> 'error' GROUP BY page_id"""


@query(f"{rel('log')}, {duck.observed()}, s AS ({_STATE}) SELECT *, last_seen_at + recrawl_interval_seconds AS next_fetch_at FROM s")
def resource_state_rollup(spark, sf_dir):
    return change.rollup(change.with_evidence(relation(spark, sf_dir, "log")), ["page_id"], POLICY)


@query(f"{rel('log')}, {duck.observed()} SELECT page_id, count(*) FILTER (kind = 'not_modified') AS touched, count(*) FILTER (kind = 'error') AS errors, max(observed_at) FILTER (kind = 'not_modified') AS last_touched_at FROM obs GROUP BY page_id")
def not_modified_rollup(spark, sf_dir):
    return _classified(spark, sf_dir).groupBy("page_id").agg(F.count_if(c("kind") == "not_modified").alias("touched"), F.count_if(c("kind") == "error").alias("errors"), F.max(F.when(c("kind") == "not_modified", c("observed_at"))).alias("last_touched_at"))


_KIND_OF = "CASE k % 5 WHEN 0 THEN 'new' WHEN 1 THEN 'not_modified' WHEN 2 THEN 'unchanged' WHEN 3 THEN 'representation_changed' ELSE 'semantic_changed' END"


@query(f"{rel('states')} SELECT k, {_KIND_OF} AS kind, {duck.next_interval(_KIND_OF, 'recrawl_interval_seconds')} AS interval_seconds, 9e8 + {duck.next_interval(_KIND_OF, 'recrawl_interval_seconds')} AS next_fetch_at FROM states")
def recrawl_interval_step(spark, sf_dir):
    s = relation(spark, sf_dir, "states").withColumn("kind", F.expr(_KIND_OF)).withColumn("interval_seconds", POLICY.next_interval(c("kind"), c("recrawl_interval_seconds")))
    return s.select("k", "kind", "interval_seconds", (F.lit(NOW) + c("interval_seconds")).alias("next_fetch_at"))


_KIND_E = "CASE event_type WHEN 'signup' THEN 'representation_changed' WHEN 'error' THEN 'semantic_changed' WHEN 'view' THEN 'unchanged' WHEN 'click' THEN 'not_modified' ELSE 'unchanged' END"


@query(f"SELECT user_id, count(*) AS n, {duck.fold(f'list({_KIND_E} ORDER BY event_id)')} AS interval_seconds FROM events GROUP BY user_id")
def recrawl_interval_fold(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("kind", F.expr(_KIND_E)).groupBy("user_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("event_id", "kind"))).alias("log"))
    return e.select("user_id", "n", change.interval_fold(F.transform("log", lambda x: x["kind"]), POLICY).alias("interval_seconds"))


@query(f"{rel('states')} SELECT k, greatest(900e0, least(86400e0, CASE WHEN recrawl_interval_seconds > 0 THEN recrawl_interval_seconds ELSE 86400e0 END)) AS interval_seconds FROM states")
def failure_interval(spark, sf_dir):
    return relation(spark, sf_dir, "states").select("k", POLICY.failure_interval(c("recrawl_interval_seconds")).alias("interval_seconds"))


_OUT = f"CASE WHEN k % 6 = 5 THEN NULL ELSE {_KIND_OF} END"


@query(f"""{rel('states')} SELECT crawl_id, request_url, CASE WHEN k % 2 = 1 THEN recrawl_interval_seconds ELSE i END AS recrawl_interval_seconds, CASE WHEN k % 2 = 1 THEN next_fetch_at ELSE 9e8 + i END AS next_fetch_at
FROM (SELECT *, CASE WHEN k % 6 = 5 THEN greatest(900e0, least(86400e0, CASE WHEN recrawl_interval_seconds > 0 THEN recrawl_interval_seconds ELSE 86400e0 END)) ELSE {duck.next_interval(_KIND_OF, 'recrawl_interval_seconds')} END AS i FROM states) AS x""")
def apply_schedule(spark, sf_dir):
    s = relation(spark, sf_dir, "states")
    outcomes = s.where("k % 2 = 0").select("crawl_id", "request_url", F.expr(_OUT).alias("kind"))
    return change.schedule(s, outcomes, ["crawl_id", "request_url"], POLICY, NOW).select("crawl_id", "request_url", "recrawl_interval_seconds", "next_fetch_at")


@query(f"""{rel('log')}, {duck.observed()}, n AS (SELECT * FROM obs WHERE k = 2 AND kind <> 'error') SELECT page_id, kind, {duck.next_interval('kind', '7200e0')} AS interval_seconds, observed_at + {duck.next_interval('kind', '7200e0')} AS next_fetch_at FROM n""")
def schedule_after_persist(spark, sf_dir):
    n = _classified(spark, sf_dir).where("k = 2 and kind <> 'error'").withColumn("interval_seconds", POLICY.next_interval(c("kind"), F.lit(7200.0)))
    return n.select("page_id", "kind", "interval_seconds", (c("observed_at") + c("interval_seconds")).alias("next_fetch_at"))


@query(f"""{rel('log')}, {duck.observed()}, v AS (SELECT * FROM obs WHERE k <= 2 AND kind <> 'error'), s AS (SELECT page_id, arg_max(kind, observed_at) AS kind, {duck.fold('list(kind ORDER BY observed_at)')} AS interval_seconds FROM v GROUP BY page_id)
SELECT kind, count(*) AS n_pages, sum(interval_seconds) AS interval_seconds FROM s GROUP BY kind""")
def page_change_report(spark, sf_dir):
    """Flagship: pages by the kind of their last change after two versions, and the seconds until they are due again."""
    s = change.rollup(change.with_evidence(relation(spark, sf_dir, "log").where("k <= 2")), ["page_id"], POLICY)
    return s.groupBy(c("last_change_kind").alias("kind")).agg(F.count("*").alias("n_pages"), F.sum("recrawl_interval_seconds").alias("interval_seconds"))


_PRINT = """CASE page_id % 4 WHEN 0 THEN '{"fingerprint":{"content_sha256":"a' || CAST(page_id AS STRING) || '","semantic_sha256":"b"}}' WHEN 1 THEN '{"fingerprint":{"content_sha256":"a"}}' WHEN 2 THEN '{"x":1}' ELSE 'broken' END"""


@query("SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'a' || page_id END AS content_sha256, page_id % 4 = 0 AS usable FROM pages")
def decode_fingerprints(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", store.decoded_fingerprint(F.expr(_PRINT)).alias("f"))
    return p.select("page_id", "f.content_sha256", c("f").isNotNull().alias("usable"))


@query("""
SELECT page_id, CASE WHEN page_id % 5 = 4 THEN 'not_found' WHEN octet_length(encode(html)) > 6000 OR page_id % 9 = 0 THEN 'too_large' END AS error, CASE WHEN page_id % 5 <> 4 AND octet_length(encode(html)) <= 6000 AND page_id % 9 <> 0 THEN sha256(html) END AS body_sha256 FROM pages""")
def bounded_fetch(spark, sf_dir):
    from gossamer.sources import replay

    snap = relation(spark, sf_dir, "snapshot").select("page_id", "requested_url", "url", "status_code", "body", F.when(c("lying"), F.create_map(F.lit("content-length"), F.lit("999999"))).otherwise(F.create_map().cast("map<string,string>")).alias("headers"))
    asked = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.when(c("page_id") % 5 == 4, F.concat("url", F.lit("!"))).otherwise(c("url")).alias("url"))
    return replay.fetch(asked, snap, max_bytes=6000, on=["page_id"]).select("page_id", "error", F.sha2("body", 256).alias("body_sha256"))


_IP = "CASE page_id % 8 WHEN 0 THEN '10.1.2.' || CAST(page_id % 256 AS STRING) WHEN 1 THEN '8.8.' || CAST(page_id % 256 AS STRING) || '.8' WHEN 2 THEN '172.' || CAST(page_id % 64 AS STRING) || '.0.1' WHEN 3 THEN '100.' || CAST(page_id % 256 AS STRING) || '.0.1' WHEN 4 THEN '256.1.1.1' WHEN 5 THEN '169.254.169.254' WHEN 6 THEN '192.168.0.1' ELSE '198.' || CAST(16 + page_id % 6 AS STRING) || '.1.1' END"


def _not_global(n: str) -> str:
    return " OR ".join(f"{n} BETWEEN {a} AND {b}" for a, b in egress.ranges())


_NUMBER = "CASE WHEN regexp_matches(a, '^(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(\\.(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}$') THEN split_part(a, '.', 1)::BIGINT * 16777216 + split_part(a, '.', 2)::BIGINT * 65536 + split_part(a, '.', 3)::BIGINT * 256 + split_part(a, '.', 4)::BIGINT END"


@query(f"WITH x AS (SELECT page_id, {_IP} AS a FROM pages), y AS (SELECT *, {_NUMBER} AS n FROM x) SELECT page_id, a AS address, NOT ({_not_global('n')}) AS public FROM y")
def egress_ip_filter(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.expr(_IP).alias("address")).select("page_id", "address", egress.public_ipv4(c("address")).alias("public"))


_TARGET = f"CASE page_id % 5 WHEN 0 THEN 'http://' || {_IP} || '/x' WHEN 1 THEN 'https://Host' || CAST(page_id % 30 AS STRING) || '.example/' WHEN 2 THEN 'http://localhost:8000/' WHEN 3 THEN 'http://printer.local./' ELSE 'https://none' || CAST(page_id AS STRING) || '.example/' END"


@query(f"""WITH t AS (SELECT page_id, {_TARGET} AS url FROM pages), {duck.url_parts('t', 'url', 'page_id', 'x')}, dns AS (SELECT DISTINCT 'host' || (page_id % 30) || '.example' AS host, page_id % 30 % 3 AS m FROM pages),
z AS (SELECT x.*, h AS a, d.m FROM x LEFT JOIN dns d ON d.host = x.h), y AS (SELECT *, {_NUMBER} AS num FROM z)
SELECT page_id, canon AS canonical_url, coalesce(ok, false) AND CASE WHEN num IS NOT NULL THEN NOT ({_not_global('num')}) WHEN page_id % 5 = 0 THEN false ELSE coalesce(m = 0, false) END AS allowed FROM y""")
def egress_allowed(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    dns = p.select((c("page_id") % 30).alias("m")).distinct().select(F.concat(F.lit("host"), c("m").cast("string"), F.lit(".example")).alias("host"), F.when(c("m") % 3 == 0, F.array(F.lit("93.184.216.34"), F.lit("1.1.1.1"))).when(c("m") % 3 == 1, F.array(F.lit("1.1.1.1"), F.lit("10.0.0.1"))).otherwise(F.array().cast("array<string>")).alias("addresses"))
    return egress.allowed(p.select("page_id", F.expr(_TARGET).alias("url")), dns).select("page_id", "canonical_url", "allowed")


_PROXY = "CASE page_id % 6 WHEN 0 THEN 'http://us%40er:p%3Aw@8.8.8.8:3128' WHEN 1 THEN 'http://10.0.0.1:3128' WHEN 2 THEN 'socks5://8.8.8.8:1080' WHEN 3 THEN 'https://8.8.8.8' WHEN 4 THEN 'http://localhost:80' ELSE 'https://proxy.example:8443' END"


@query("SELECT page_id, page_id % 6 IN (0, 5) AS allowed, CASE WHEN page_id % 6 = 0 THEN 'us@er' END AS username FROM pages")
def proxy_endpoints(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.expr(_PROXY).alias("p"))
    return p.select("page_id", egress.proxy_allowed(c("p")).alias("allowed"), urls.proxy_parts(c("p"))["username"].alias("username"))


@query(f"""WITH {duck.links('pages', 'page_id', 'html', 'url', 'lk')}, l AS (SELECT 'c' || page_id AS crawl_id, page_id, unnest(links) AS link FROM lk UNION ALL SELECT 'c' || page_id, page_id, 'https://elsewhere.example/' FROM pages) SELECT crawl_id, link FROM l WHERE link <> 'https://elsewhere.example/'""")
def scoped_links(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("crawl_id", F.concat(F.lit("c"), c("page_id").cast("string")))
    links = p.select("crawl_id", F.explode(F.concat(H.links(c("html"), c("url")), F.array(F.lit("https://elsewhere.example/")))).alias("link"))
    return egress.scoped(links, p.select("crawl_id", c("url").alias("seed"))).select("crawl_id", "link")


@query(f"""WITH {duck.links('pages', 'page_id', 'html', 'url', 'lk')}, {duck.url_parts('pages', 'url', 'page_id', 'u')} SELECT page_id, canon AS url, CASE WHEN page_id % 10 = 9 THEN 503 ELSE 200 END AS status_code, {duck.title('html')} AS title, len(links)::BIGINT AS n_links, 'http' AS engine, 'direct' AS route, sha256(html) AS content_sha256
FROM pages JOIN lk USING (page_id) JOIN u USING (page_id) WHERE page_id % 6 <> 0""")
def crawl_page_records(spark, sf_dir):
    """Seeds fetched from the snapshot and read: url, title, links, fingerprint of each page that didn't move."""
    s = change.with_evidence(relation(spark, sf_dir, "snapshot").where("requested_url = url"), "body", "url")
    return s.select("page_id", urls.canonical(c("url")).alias("url"), "status_code", "evidence.title", F.size("evidence.links").cast("long").alias("n_links"), F.lit("http").alias("engine"), F.lit("direct").alias("route"), "content_sha256")


@query(f"WITH {duck.url_parts('pages', 'url', 'page_id, html', 'u')} SELECT page_id, canon AS url, {duck.title('html')} AS title FROM u WHERE page_id = (SELECT min(page_id) FROM pages)")
def scrape_one(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.join(p.agg(F.min("page_id").alias("page_id")), "page_id").select("page_id", urls.canonical(c("url")).alias("url"), H.title(c("html")).alias("title"))


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 AND page_id % 2 = 0 THEN 'rendered ' || page_id ELSE 'static' END AS title, CASE WHEN page_id % 3 = 0 AND page_id % 2 = 0 THEN 'browser' ELSE 'http' END AS engine,
CASE WHEN page_id % 3 = 0 AND page_id % 2 = 0 THEN 'a=2,b=3,k=1' WHEN page_id % 3 = 0 THEN 'a=1,browser_error=render failed,k=1' ELSE 'a=1,k=1' END AS metadata FROM pages""")
def browser_escalation_merge(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    m = lambda *kv: F.create_map(*[F.lit(x) for x in kv])
    static = p.select(c("url"), c("page_id").alias("requested_url"), F.lit("static").alias("title"), (c("page_id") % 3 == 0).alias("requires_browser"), m("a", "1", "k", "1").alias("metadata"))
    rendered = p.where("page_id % 2 = 0 and page_id % 10 <> 11").select("url", c("page_id").alias("requested_url"), F.concat(F.lit("rendered "), c("page_id").cast("string")).alias("title"), m("a", "2", "b", "3").alias("metadata"))
    out = store.merged_rendering(static, rendered, on=["url", "requested_url"])
    return out.select(c("requested_url").alias("page_id"), "title", "engine", F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("metadata"))


@query("SELECT page_id, 200 + page_id % 3 * 104 AS status, CASE page_id % 3 WHEN 0 THEN 'fetched' WHEN 1 THEN 'not_modified' ELSE 'failed' END AS outcome FROM (SELECT page_id::BIGINT AS page_id FROM pages) AS x")
def recrawl_outcomes(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", (c("page_id") % 3 * 104 + 200).alias("status")).withColumn("outcome", change.route_outcome(c("status")))


@query(f"""{rel('log')}, {duck.observed()}, o AS (SELECT CASE WHEN page_id % 11 = 10 THEN NULL ELSE kind END AS kind FROM obs WHERE k = 4 AND kind NOT IN ('error', 'new'))
SELECT count(*) AS checked, count(*) FILTER (kind = 'not_modified') AS not_modified, count(*) FILTER (kind = 'unchanged') AS unchanged, count(*) FILTER (kind = 'representation_changed') AS representation_changed, count(*) FILTER (kind = 'semantic_changed') AS semantic_changed, count(*) FILTER (kind IS NULL) AS failures FROM o""")
def recrawl_summary(spark, sf_dir):
    o = _classified(spark, sf_dir).where("k = 4 and kind not in ('error', 'new')").withColumn("kind", F.when(c("page_id") % 11 != 10, c("kind")))
    return change.kind_counts(o)


@query(f"""{rel('log')}, {duck.observed()}, p AS (SELECT page_id, observed_at + 1e5 AS now, kind, {duck.next_interval('kind', '7200e0')} AS i FROM obs WHERE k = 4 AND kind <> 'error')
SELECT page_id, kind, CASE WHEN page_id % 8 = 7 THEN 7200e0 ELSE i END AS recrawl_interval_seconds, 9e8 + CASE WHEN page_id % 8 = 7 THEN 7200e0 ELSE i END AS next_fetch_at FROM p""")
def recrawl_pipeline(spark, sf_dir):
    """Refetch, classify, schedule: failures (here one page in eight) take the failure interval."""
    o = _classified(spark, sf_dir).where("k = 4 and kind <> 'error'")
    states = o.select("page_id", F.lit(7200.0).alias("recrawl_interval_seconds"), F.lit(0.0).alias("next_fetch_at"))
    out = change.schedule(states, o.select("page_id", F.when(c("page_id") % 8 != 7, c("kind")).alias("kind")), ["page_id"], POLICY, NOW)
    return out.join(o.select("page_id", "kind"), "page_id").select("page_id", "kind", "recrawl_interval_seconds", "next_fetch_at")


@query(f"""WITH {duck.links('pages', 'page_id', 'html', 'url', 'lk')}, {duck.url_parts('pages', 'url', 'page_id', 'u')} SELECT page_id, canon AS url, {duck.title('html')} AS title, '{{"recrawl":true,"content_sha256":"' || sha256(html) || '","semantic_sha256":"' || {duck.semantic(duck.title('html'), 'links')} || '"}}' AS metadata FROM pages JOIN lk USING (page_id) JOIN u USING (page_id)""")
def recrawl_records(spark, sf_dir):
    p = change.with_evidence(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    meta = F.to_json(F.struct(F.lit(True).alias("recrawl"), "content_sha256", "semantic_sha256"))
    return p.select("page_id", urls.canonical(c("url")).alias("url"), "evidence.title", meta.alias("metadata"))
