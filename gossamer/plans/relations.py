"""The relations that registered queries work on, derived from the driver's tables by SQL that both engines run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NOW = 9.0e8
TABLES = ("pages", "events", "orders", "customer", "lineitem")
SPARK = {"epoch": lambda c: f"CAST(timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {c}) AS DOUBLE)"}
DUCK = {"epoch": lambda c: f"CAST(epoch({c}) AS DOUBLE)"}


def _text(name: str, engine: dict) -> str:
    return {
        "frontier": f"""
SELECT crawl_id, url, queue_key, priority, depth, available_at, metadata_json, state,
  CAST(CASE WHEN state = 'queued' THEN k % 3 ELSE 1 + k % 2 END AS INT) AS attempt,
  CASE WHEN state = 'leased' THEN 't' || CAST(sequence AS STRING) END AS lease_token,
  CASE WHEN state = 'leased' THEN available_at + 5e7 ELSE 0e0 END AS lease_expires_at, CAST(NULL AS STRING) AS error, sequence
FROM (SELECT l_orderkey AS k, 'c' || CAST(l_orderkey % 7 AS STRING) AS crawl_id, 'h' || CAST(min(l_suppkey) % 40 AS STRING) AS queue_key,
  'https://h' || CAST(min(l_suppkey) % 40 AS STRING) || '.example/' || CAST(l_orderkey AS STRING) || '/' || CAST(l_linenumber AS STRING) AS url,
  CAST(l_linenumber AS BIGINT) AS priority, CAST(l_orderkey % 4 AS INT) AS depth, {engine['epoch']('min(l_shipdate)')} AS available_at,
  CASE WHEN l_orderkey % 5 = 0 THEN '[1]' WHEN l_orderkey % 5 = 1 THEN 'broken' ELSE '{{"n":' || CAST(l_orderkey AS STRING) || '}}' END AS metadata_json,
  CASE WHEN (l_orderkey + l_linenumber) % 10 < 6 THEN 'queued' WHEN (l_orderkey + l_linenumber) % 10 = 6 THEN 'leased' WHEN (l_orderkey + l_linenumber) % 10 < 9 THEN 'done' ELSE 'failed' END AS state,
  CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS sequence FROM lineitem GROUP BY l_orderkey, l_linenumber) AS x""",
        "queues": """
SELECT crawl_id, queue_key, CAST(1 + count(*) % 3 AS INT) AS max_concurrency, CASE WHEN count(*) % 2 = 0 THEN 0e0 ELSE 2e0 END AS delay_seconds,
  CASE WHEN queue_key = 'h3' THEN 9.5e8 ELSE 0e0 END AS blocked_until, CASE WHEN queue_key IN ('h5', 'h7') THEN CAST(sum(attempt) + 1 AS BIGINT) END AS crawl_limit,
  CAST(count(*) % 2 AS BIGINT) AS active, CAST(sum(attempt) AS BIGINT) AS issued, CASE WHEN queue_key = 'h9' THEN 9.1e8 ELSE 0e0 END AS next_allowed_at
FROM frontier GROUP BY crawl_id, queue_key""",
        "crawls": """
SELECT crawl_id, CASE WHEN crawl_id = 'c6' THEN CAST(NULL AS BIGINT) ELSE issued + 9 * CAST(substr(crawl_id, 2) AS BIGINT) END AS crawl_limit, issued
FROM (SELECT crawl_id, count(CASE WHEN attempt > 0 THEN 1 END) AS issued FROM frontier GROUP BY crawl_id) AS x""",
        "outcomes": """
SELECT crawl_id, url, CASE WHEN sequence % 3 = 0 THEN 'stale' ELSE lease_token END AS lease_token, CASE WHEN sequence % 4 = 0 THEN 'fail' WHEN sequence % 4 = 1 THEN 'retry' ELSE 'ack' END AS verb,
  available_at + 10e0 AS available_at, 'e' || CAST(sequence % 4 AS STRING) AS error FROM frontier WHERE state = 'leased'""",
        "states": f"""
SELECT 'c' || CAST(o_custkey AS STRING) AS crawl_id, 'https://r' || CAST(o_orderkey % 97 AS STRING) || '.example/' || CAST(o_orderkey AS STRING) AS request_url,
  CASE WHEN o_orderkey % 11 = 0 THEN CAST(NULL AS DOUBLE) ELSE {engine['epoch']('o_orderdate')} END AS next_fetch_at, {engine['epoch']('o_orderdate')} - 1000e0 AS last_seen_at,
  CASE WHEN o_orderkey % 13 = 0 THEN CAST(NULL AS DOUBLE) WHEN o_orderkey % 13 = 1 THEN 0e0 ELSE 300e0 * (o_orderkey % 10000) END AS recrawl_interval_seconds, o_orderkey AS k FROM orders""",
        "manifests": """
SELECT 'c' || CAST(c_custkey AS STRING) AS crawl_id, CASE c_custkey % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'paused' WHEN 2 THEN 'completed' ELSE 'cancelled' END AS lifecycle,
  '["https://s' || CAST(c_custkey % 50 AS STRING) || '.example/"]' AS seeds, c_custkey % 2 = 0 AS follow_links, CAST(10 + c_custkey % 90 AS BIGINT) AS max_pages, CAST(c_custkey * 7 % 1000 AS DOUBLE) AS updated_at, c_custkey AS k FROM customer""",
        "claims": """
SELECT crawl_id, request_url, 'k' || CAST(k AS STRING) AS token, 9e8 + (k % 200 - 100) AS expires_at, k FROM states WHERE k % 5 = 0""",
        "given": """
SELECT crawl_id, request_url, CASE WHEN k % 3 = 0 THEN 'stale' ELSE token END AS token, CAST(60 + k % 100 AS DOUBLE) AS interval_seconds, 9e8 + k % 100 AS at FROM claims WHERE k % 2 = 0""",
        "results": f"""
SELECT 'c' || CAST(o_custkey % 50 AS STRING) AS crawl_id, 'https://r.example/' || CAST(o_orderkey % 4000 AS STRING) AS request_url, {engine['epoch']('o_orderdate')} + o_orderkey * 1e-3 AS recorded_at, o_orderkey AS k,
  CASE WHEN o_orderkey % 9 = 0 THEN 'broken' ELSE '{{"url":"https://r.example/' || CAST(o_orderkey AS STRING) || '","status_code":200,"title":"t ' || CAST(o_orderkey AS STRING) || '"' || CASE WHEN o_orderkey % 2 = 0 THEN ',"engine":"browser","links":["https://a.example/"]' ELSE '' END || '}}' END AS record_json FROM orders""",
        "log": f"""
SELECT page_id, url, k, 1e9 + 1000e0 * k + page_id AS observed_at, CASE WHEN m = 3 THEN 304 ELSE 200 END AS status,
  CASE m WHEN 3 THEN CAST(NULL AS STRING) WHEN 1 THEN html || '<!-- v' || CAST(k AS STRING) || ' -->' WHEN 2 THEN replace(html, '<title>', '<title>v' || CAST(k AS STRING) || ' ') ELSE html END AS html
FROM (SELECT page_id, url, html, 1 AS k, CASE WHEN page_id % 7 = 6 THEN 3 ELSE 0 END AS m FROM pages UNION ALL SELECT page_id, url, html, 2 AS k, page_id % 5 AS m FROM pages UNION ALL SELECT page_id, url, html, 3 AS k, (page_id + 2) % 5 AS m FROM pages UNION ALL SELECT page_id, url, html, 4 AS k, page_id % 3 AS m FROM pages) AS x WHERE m < 4""",
        "rich": """
SELECT page_id, url, replace(html, '</head>',
  CASE WHEN page_id % 3 = 0 THEN '<script type="application/ld+json; charset=utf-8">{"id":' || CAST(page_id AS STRING) || '}</script>' ELSE '' END || CASE WHEN page_id % 7 = 0 THEN '<script type="application/ld+json">{"id":</script>' ELSE '' END ||
  CASE WHEN page_id % 4 < 2 THEN '<meta property="og:title" content=" T' || CAST(page_id AS STRING) || ' "><meta property="OG:image" content="/a.png"><meta property="og:image" content="/b.png"><meta property="og:empty" content=" "><meta property="article:tag" content="x">' ELSE '' END ||
  CASE page_id % 5 WHEN 0 THEN '<link rel="stylesheet" href="/x.css"><link rel="alternate Canonical" href="/c/' || CAST(page_id AS STRING) || '#top"><link rel="canonical" href="/late">' WHEN 1 THEN '<link rel="canonical" href="ftp://x.example/">' ELSE '' END ||
  CASE WHEN page_id % 6 = 0 THEN '<noscript>Please <b>Enable JavaScript</b></noscript><script src="/1.js"></script><script src="/2.js"></script>' ELSE '' END || '</head>') || CASE WHEN page_id % 6 < 2 THEN '<div id="root"></div>' ELSE '' END AS html FROM pages""",
        "linked": """
SELECT page_id, url, replace(html, '</head>', CASE page_id % 5 WHEN 0 THEN '<script type="application/ld+json">{"b": [1, true, null], "a": "x' || CAST(page_id AS STRING) || '"}</script>'
  WHEN 1 THEN '<script type="application/ld+json">' || chr(10) || '{"a":"x' || CAST(page_id AS STRING) || '","b":[1,true,null]}' || chr(10) || '</script>'
  WHEN 2 THEN '<script type="application/ld+json">{"b": [1, true, null], "a": "x' || CAST(page_id AS STRING) || '"}</script><script type="application/ld+json">{"broken' || CAST(page_id AS STRING) || '</script>'
  WHEN 3 THEN '<script type="application/ld+json">[{"@type": "Thing", "@id": 7}]</script><script type="application/ld+json">"plain"</script>' ELSE '' END || '</head>') AS html FROM pages""",
        "shells": """
SELECT page_id, url, CASE page_id % 4 WHEN 0 THEN '<html><body><div id="root"></div><noscript>You need to enable JavaScript to run this app.</noscript><script src="1"></script><script src="2"></script><script src="3"></script></body></html>'
  WHEN 1 THEN '<html><body><h1>Head ' || CAST(page_id AS STRING) || '</h1><p>' || repeat('word ', CAST(page_id % 90 AS INT)) || '</p><script>x</script></body></html>'
  WHEN 2 THEN '<html><body><div data-reactroot="1"></div><article>' || repeat('long text ', 40) || '</article></body></html>' ELSE '<html><body><main><p>a ' || CAST(page_id AS STRING) || '</p><p>b</p></main><div id="app"></div></body></html>' END AS html FROM pages""",
        "variants": """
SELECT page_id, v, CASE v WHEN 0 THEN url WHEN 1 THEN upper(url) WHEN 2 THEN 'https://Example' || i || '.COM.:443/a/b?x=2&a=1#f' WHEN 3 THEN 'http://user:pw@h' || i || '.example/' WHEN 4 THEN 'ftp://h.example/' || i
  WHEN 5 THEN 'http://h' || i || '.example:80' WHEN 6 THEN 'http://h..example/' || i WHEN 7 THEN 'https://h' || i || '.example:8443/p?#frag' WHEN 8 THEN 'mailto:x' || i || '@y.example' WHEN 9 THEN 'http://[2001:DB8::' || i || ']:8080/x y'
  WHEN 10 THEN '  http://h' || i || '.example/a;p=1?q=a%20b ' WHEN 11 THEN 'http://h' || i || '.example:99999/' WHEN 12 THEN 'http:///nohost/' || i ELSE '/relative/' || i END AS u
FROM (SELECT page_id, url, CAST(page_id AS STRING) AS i FROM pages) AS p CROSS JOIN (SELECT 0 AS v UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7 UNION ALL SELECT 8 UNION ALL SELECT 9 UNION ALL SELECT 10 UNION ALL SELECT 11 UNION ALL SELECT 12 UNION ALL SELECT 13) AS n""",
        "refs": """
SELECT page_id, v, url AS base, CASE v WHEN 0 THEN '/root/' || i || '?a=1' WHEN 1 THEN 'sub/' || i || '.html' WHEN 2 THEN '//cdn.example/' || i WHEN 3 THEN '?page=' || i WHEN 4 THEN '#frag' WHEN 5 THEN 'HTTPS://Other.example:443/' || i WHEN 6 THEN 'javascript:void(0)' ELSE '' END AS ref
FROM (SELECT page_id, url, CAST(page_id AS STRING) AS i FROM pages) AS p CROSS JOIN (SELECT 0 AS v UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7) AS n""",
        "robots": """
SELECT page_id, 'https://r' || CAST(page_id AS STRING) || '.example/robots.txt' AS source_url, 'User-agent: *' || chr(10) || 'Disallow: /x # no' || chr(13) || chr(10) || 'SiteMap: /s/' || CAST(page_id AS STRING) || '.xml # main' || chr(10) || 'sitemap : https://S.example/b.xml' || chr(10) || '# Sitemap: /c.xml' || chr(10)
  || CASE WHEN page_id % 2 = 0 THEN 'Sitemap: /s/' || CAST(page_id AS STRING) || '.xml' || chr(10) ELSE '' END || 'Sitemap:' || chr(10) || 'Sitemap: ftp://x.example/' AS body FROM pages""",
        "sitemaps": """
SELECT page_id, 'https://s' || CAST(page_id AS STRING) || '.example/dir/map.xml' AS source_url, CASE page_id % 5
  WHEN 0 THEN '<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> /a/' || i || '#x </loc><loc>/second</loc></url><url><loc>/a/' || i || '</loc></url><url><loc>b?x=1&amp;y=2</loc></url><url><loc>mailto:x</loc></url></urlset>'
  WHEN 1 THEN '  <sitemapindex><sitemap><loc>/n/' || i || '.xml</loc></sitemap><sm:sitemap><sm:loc>https://T.example/m.xml</sm:loc></sm:sitemap></sitemapindex>'
  WHEN 2 THEN 'https://t.example/' || i || chr(10) || chr(10) || '/x/' || i || chr(13) || chr(10) || 'https://t.example/' || i
  WHEN 3 THEN '<!DOCTYPE urlset [<!ENTITY a "b">]><urlset><url><loc>/a</loc></url></urlset>' ELSE '<html><url><loc>/a</loc></url></html>' END AS body FROM (SELECT page_id, CAST(page_id AS STRING) AS i FROM pages) AS p""",
        "feeds": """
SELECT page_id, 'https://f' || CAST(page_id AS STRING) || '.example/feed' AS source_url, CASE page_id % 4
  WHEN 0 THEN '<rss version="2.0"><channel><link>/home</link><item><title>a</title><link>mailto:x</link><link>/i/' || i || '</link></item><item><link>/i/' || i || '#again</link></item><item><link>https://g.example/2</link></item></channel></rss>'
  WHEN 1 THEN '<feed xmlns="http://www.w3.org/2005/Atom"><link href="/self"/><entry><link rel="self" href="/s/' || i || '"/><link href="/e/' || i || '"/></entry><entry><link rel="related" href="/r/' || i || '"/></entry><entry><title>none</title></entry></feed>'
  WHEN 2 THEN '<!DOCTYPE rss><rss><channel><item><link>/x</link></item></channel></rss>' ELSE '<opml/>' END AS body FROM (SELECT page_id, CAST(page_id AS STRING) AS i FROM pages) AS p""",
        "outcome_log": """
SELECT event_id, 'u' || CAST(user_id AS STRING) AS context_key, CASE event_type WHEN 'view' THEN 'http:direct' WHEN 'click' THEN 'http:proxy' WHEN 'purchase' THEN 'browser:direct' ELSE 'browser:proxy' END AS action, event_type <> 'error' AS success,
  CASE WHEN event_type = 'click' THEN 0.2e0 WHEN event_type = 'error' THEN 0e0 ELSE 1e0 END AS quality, value * 10e0 AS latency_ms, CASE WHEN event_type = 'purchase' THEN 0.1e0 ELSE 0e0 END AS cost FROM events""",
        "commands": """
SELECT event_id, 'c' || CAST(user_id AS STRING) AS crawl_id, CASE event_type WHEN 'view' THEN 'pause' WHEN 'click' THEN 'resume' WHEN 'purchase' THEN 'finish' WHEN 'error' THEN CASE WHEN event_id % 40 = 0 THEN 'cancel' ELSE 'pause' END ELSE 'resume' END AS command, event_id % 3 = 0 AS complete FROM events""",
        "snapshot": """
SELECT page_id, url AS requested_url, CASE WHEN page_id % 6 = 0 THEN url || '/final' ELSE url END AS url, CASE WHEN page_id % 10 = 9 THEN 503 ELSE 200 END AS status_code, html AS body, page_id % 9 = 0 AS lying FROM pages""",
        "web": """
SELECT 'w' || s AS crawl_id, k, 'https://w' || s || '.example/p/' || CAST(k AS STRING) AS requested_url, 'https://w' || s || '.example/' || CASE WHEN k % 4 = 3 THEN 'q/' ELSE 'p/' END || CAST(k AS STRING) AS url, CAST(CASE WHEN k % 7 = 5 THEN 503 ELSE 200 END AS INT) AS status_code,
  '<html><head><title>Page ' || CAST(k AS STRING) || '</title></head><body><a href="/p/' || CAST(2 * k + 1 AS STRING) || '">left</a><a href="//w' || s || '.example/p/' || CAST(2 * k + 2 AS STRING) || '#x">right</a><a href="mailto:x">m</a><a href="https://elsewhere.example/">out</a><a href="/p/0">root</a><a href="/p/' || CAST(2 * k + 1 AS STRING) || '">again</a></body></html>' AS body
FROM (SELECT CAST(page_id % 6 AS STRING) AS s, CAST((page_id - page_id % 6) / 6 AS BIGINT) AS k FROM pages) AS x WHERE k % 11 <> 10""",
        "watched": """
SELECT 'c' || CAST(page_id % 8 AS STRING) AS crawl_id, url || '?' || CAST(page_id AS STRING) AS request_url, page_id, html AS old_html, CASE WHEN page_id % 3 = 0 THEN 'e' || CAST(page_id AS STRING) END AS etag,
  CASE WHEN page_id % 13 = 0 THEN CAST(NULL AS DOUBLE) ELSE 8.9e8 + page_id * 7919 % 20000000 END AS next_fetch_at, 8e8 + page_id * 31 % 1000 AS last_seen_at, CASE WHEN page_id % 7 = 0 THEN CAST(NULL AS DOUBLE) ELSE 600e0 * (page_id % 9) END AS recrawl_interval_seconds,
  CASE WHEN page_id % 10 = 9 THEN 503 WHEN page_id % 10 = 8 THEN 404 ELSE 200 END AS status_code, CASE WHEN page_id % 2 = 0 THEN 'e' || CAST(page_id AS STRING) ELSE 'f' END AS new_etag, page_id % 17 = 16 AS lost,
  CASE page_id % 4 WHEN 1 THEN html || '<!-- new -->' WHEN 2 THEN replace(html, '<title>', '<title>New ') WHEN 3 THEN html || '<a href="/fresh/' || CAST(page_id AS STRING) || '">fresh</a>' ELSE html END AS html FROM pages""",
        "records": """
SELECT page_id AS pos, CASE WHEN page_id % 4 = 0 THEN CAST(NULL AS STRING) ELSE 'https://q.example/' || CAST(page_id % 60 AS STRING) END AS requested_url, 'https://q.example/' || CAST(page_id * 7 % 100 AS STRING) AS url FROM pages""",
        "sites": """
SELECT DISTINCT 's' || CAST(page_id % 6 AS STRING) AS site FROM pages""",
    }[name]


NEEDS = {"queues": ["frontier"], "crawls": ["frontier"], "outcomes": ["frontier"], "claims": ["states"], "given": ["states", "claims"]}


def views(spark: SparkSession, sf_dir: str) -> None:
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    views(spark, sf_dir)
    for n in NEEDS.get(name, []):
        spark.sql(_text(n, SPARK)).createOrReplaceTempView(n)
    return spark.sql(_text(name, SPARK))


def duck(*names: str) -> str:
    """The relations as the beginning of a WITH list, without the keyword."""
    all_names = list(dict.fromkeys(x for n in names for x in [*NEEDS.get(n, []), n]))
    return ",\n".join(f"{n} AS ({_text(n, DUCK)})" for n in all_names)
