import gzip

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gossamer.functions import html, robust, urls
from gossamer.operators import discovery, egress
from gossamer.operators.change import RecrawlPolicy


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column.alias("v")).first()["v"]


def test_canonical_url(spark):
    assert one(spark, urls.canonical(F.col("u")), u="HTTPS://EXAMPLE.com:443/path?b=2&a=1#x") == "https://example.com/path?b=2&a=1"
    assert one(spark, urls.canonical(urls.resolve(F.col("b"), F.col("r"))), b="https://example.com/start", r="/next") == "https://example.com/next"
    for bad in ("file:///etc/passwd", "https://user:secret@example.com/", "http://a..b/", "http://h:70000/", "nothing"):
        assert one(spark, urls.canonical(F.col("u")), u=bad) is None


def test_same_host_and_origin(spark):
    assert one(spark, urls.same_host(F.lit("http://A.example:8080/x"), F.lit("https://a.example/")))
    assert one(spark, urls.same_origin(F.lit("https://a.example/"), F.lit("https://a.example:443/x")))
    assert not one(spark, urls.same_origin(F.lit("http://a.example/"), F.lit("https://a.example/")))


HOSTS = st.from_regex(r"[a-zA-Z0-9\-]{1,8}(\.[a-zA-Z0-9]{1,5}){0,2}\.?", fullmatch=True)
URLS = st.builds(
    lambda s, u, h, p, path, q, f: f"{s}://{u}{h}{p}{path}{q}{f}", st.sampled_from(["http", "HTTPS", "ftp", "Http"]), st.sampled_from(["", "", "", "u@", "u:p@"]), HOSTS, st.sampled_from(["", ":80", ":443", ":8080", ":", ":99999", ":x"]),
    st.sampled_from(["", "/", "/a;b=1", "/A b/%20", "/a/../b", "//x"]), st.sampled_from(["", "?", "?b=2&a=1", "?q=?"]), st.sampled_from(["", "#", "#f?x"]),
)


@settings(max_examples=6, deadline=None)
@given(st.lists(URLS, min_size=30, max_size=60))
def test_canonical_url_of_columns_and_of_texts_agree(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "u string")
    for u, got in df.select("u", urls.canonical(F.col("u"))).collect():
        assert got == robust.canonical_url(u), u


def test_robust_urls(spark):
    assert one(spark, robust.join_any(F.lit("https://h.example/a/b/c"), F.lit("../d?x#y"))) == "https://h.example/a/d?x"
    assert one(spark, robust.canonical_any(F.lit("http://Bücher.example/"))) == "http://xn--bcher-kva.example/"


def test_references_against_a_base():
    for ref, want in {"": "http://a/b/c/d;p?q", "g": "http://a/b/c/g", "./g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g/", "?y": "http://a/b/c/d;p?y", "#s": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "..": "http://a/b/", "../../../g": "http://a/g", "g/../h?x=/../y": "http://a/b/c/h?x=/../y", "/./g": "http://a/g", "HTTP://B:80/x/../y": "http://b/x/../y", "mailto:x": None, "http://u@h/": None, "http://[::1": None}.items():
        assert robust.canonical_url(ref, "http://a/b/c/d;p?q#f") == want, ref
    assert robust.canonical_url("g", "nothing") is None and robust.canonical_url("http://faß.ÉXAMPLE。com./") == "http://fass.xn--xample-9ua.com/"


def test_public_ipv6():
    for address, want in {"2606:4700::1111": True, "[2606:4700::1111]": True, "::1": False, "::": False, "fe80::1%eth0": False, "fd00::1": False, "2001:db8::1": False, "2001:4:112::7": True, "2001:4::7": False, "::ffff:10.0.0.1": False, "::ffff:8.8.8.8": True, "2002:808:808::": False, "x": None, "1.2.3": None}.items():
        assert robust.public_ipv6(address) is want, address


def test_headers(spark):
    h = F.create_map(F.lit("ETag"), F.lit(' "v1" '), F.lit("LAST-MODIFIED"), F.lit("Mon"))
    assert tuple(one(spark, urls.validators(h))) == ('"v1"', "Mon")
    assert one(spark, urls.conditional_headers(F.lit("e"), F.lit(None).cast("string"))) == {"If-None-Match": "e"}


PAGE = """<html><head><title> A &amp; B </title><link rel="Canonical" href="/p#x"><meta property="og:title" content="T"><meta property="og:image" content="1"><meta property="og:image" content="2">
<script type="application/ld+json; charset=utf-8">{"@type": "Product"}</script><script type="application/ld+json">{broken</script></head><body><a href="/p#one">1</a><a href="mailto:x@y">m</a><a href="/p">2</a></body></html>"""


def test_evidence(spark):
    e = one(spark, html.evidence(F.col("h"), F.lit("https://shop.example/x")), h=PAGE)
    assert e["title"] == "A & B" and e["links"] == ["https://shop.example/p"] and e["canonical_url"] == "https://shop.example/p"
    assert e["open_graph"] == {"og:title": ["T"], "og:image": ["1", "2"]} and e["malformed_json_ld"] == 1
    r = one(spark, robust.page_any(F.col("h"), F.lit("https://shop.example/x")), h=PAGE)
    assert (r["title"], r["links"], r["canonical_url"], r["n_json_ld"], r["malformed_json_ld"]) == ("A & B", e["links"], e["canonical_url"], 1, 1)


def test_rendering(spark):
    shell = '<div id="root"></div><noscript>Please enable JavaScript</noscript>' + "<script src='x'></script>" * 3
    r = one(spark, html.rendering(F.col("h")), h=shell)
    assert r["requires_browser"] and r["reasons"] == ["very-little-visible-content", "client-app-root", "javascript-required-message", "script-heavy-shell"]
    assert not one(spark, html.rendering(F.col("h")), h=f"<article>{'word ' * 100}</article><div id='root'></div>")["requires_browser"]


def test_gunzip_is_bounded(spark):
    packed = gzip.compress(b"x" * 101)
    df = spark.createDataFrame([(packed,), (b"none",), (None,)], "b binary")
    assert [r[0] for r in df.select(robust.gunzip(F.col("b"), 100)).collect()] == [None, None, None]
    assert [r[0] for r in df.select(robust.gunzip(F.col("b"), 101)).collect()] == [b"x" * 101, None, None]


def test_discovery_documents(spark):
    s = one(spark, discovery.sitemap(F.col("b"), F.lit("https://s.example/m.xml")), b="<urlset><url><loc>/a#1</loc></url><url><loc>/a</loc></url><url><loc>/b</loc></url></urlset>")
    assert (s["kind"], s["urls"]) == ("urlset", ["https://s.example/a", "https://s.example/b"])
    f = one(spark, discovery.feed(F.col("b"), F.lit("https://s.example/f")), b='<feed><entry><link rel="self" href="/s"/><link rel="alternate" href="/e"/></entry></feed>')
    assert (f["kind"], f["urls"]) == ("feed-atom", ["https://s.example/e"])
    assert one(spark, discovery.robots_sitemaps(F.col("b"), F.lit("https://s.example/robots.txt")), b="SITEMAP: /a.xml # c\nsitemap: https://x.example/b.xml") == ["https://s.example/a.xml", "https://x.example/b.xml"]
    assert one(spark, discovery.unsafe_xml(F.col("b")), b="<!DOCTYPE x><urlset/>")


def test_addresses(spark):
    check = lambda a: one(spark, egress.public_address(F.col("a")), a=a)
    assert [check(a) for a in ("127.0.0.1", "169.254.169.254", "10.1.1.1", "[::1]", "8.8.8.8", "2606:4700::1111")] == [False, False, False, False, True, True]
    dns = spark.createDataFrame([("a.example", ["10.0.0.1", "8.8.8.8"]), ("b.example", ["8.8.8.8"])], "host string, addresses array<string>")
    targets = spark.createDataFrame([("http://a.example/",), ("http://b.example/",), ("http://localhost/",), ("http://none.example/",)], "url string")
    assert {r["url"]: r["allowed"] for r in egress.allowed(targets, dns).collect()} == {"http://a.example/": False, "http://b.example/": True, "http://localhost/": False, "http://none.example/": False}


@pytest.mark.parametrize(
    "kind, previous, expected",
    [("new", None, 100), ("unchanged", 100, 200), ("not_modified", 400, 800), ("not_modified", 800, 800), ("semantic_changed", 800, 10), ("representation_changed", 800, 100), ("representation_changed", 50, 50)],
)
def test_intervals(spark, kind, previous, expected):
    p = RecrawlPolicy(10.0, 100.0, 800.0, 2.0)
    assert one(spark, p.next_interval(F.lit(kind), F.lit(previous).cast("double"))) == expected


def test_policy_is_validated():
    with pytest.raises(ValueError):
        RecrawlPolicy(min_interval=0)
