"""Evidence from HTML with regular expressions: the native tier.

It reads well-formed markup with quoted attributes as the pages of a crawl
mostly have it; gossamer.functions.robust parses what a browser would accept.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gossamer.functions import urls

# fixed values: prefixes of links that lead nowhere, marks of client-side apps, phrases that ask for JavaScript
SKIPPED = ("#", "javascript:", "mailto:", "tel:")
APP_ROOT = r"(?is)<[a-z][^>]*(\sid=\"(root|app|__next)\"|\sdata-reactroot|\sdata-v-app)"
JS_PHRASES = ("enable javascript", "javascript is required", "javascript required", "requires javascript", "please turn on javascript")
CONTENT = ("main", "article", "h1", "h2", "h3", "p", "li", "button", "label", "td", "th")


def unescape(text: Column) -> Column:
    """The entities that markup can't do without; `&` last, and its semicolon may be missing."""
    for name, c in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("copy", "©"), ("middot", "·"), ("nbsp", " ")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(c))
    return F.regexp_replace(text, "&amp;?", "&")


def attribute(tag: Column, name: str) -> Column:
    return F.regexp_extract(tag, rf'(?is)\s{name}="([^"]*)"', 1)


def tags(html: Column, pattern: str) -> Column:
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(0))


def title(html: Column) -> Column:
    """The first title's text; null without a title, empty if it is empty."""
    return F.when(html.rlike(r"(?is)<title[^>]*>.*?</title>"), F.trim(unescape(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))))


def links(html: Column, base: Column) -> Column:
    """Canonical targets of the page's links, each once, in order of first occurrence."""
    hrefs = F.regexp_extract_all(html, F.lit(r'(?is)<a\s[^>]*?href="([^"]*)"'), F.lit(1))
    led = F.filter(hrefs, lambda h: (h != "") & ~_any(F.startswith(h, F.lit(p)) for p in SKIPPED))
    return F.array_distinct(F.filter(F.transform(led, lambda h: urls.canonical(urls.resolve(base, unescape(h)))), lambda u: u.isNotNull()))


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def canonical_link(html: Column, base: Column) -> Column:
    """Of the first link tag whose rel has the word canonical; an unusable one ends the search."""
    rel = F.filter(tags(html, r"(?is)<link\s[^>]*>"), lambda t: F.array_contains(F.split(F.lower(attribute(t, "rel")), r"\s+"), "canonical") & (attribute(t, "href") != ""))
    return urls.canonical(urls.resolve(base, unescape(attribute(F.get(rel, F.lit(0)), "href"))))


def json_ld(html: Column) -> Column:
    """The texts of JSON-LD scripts that aren't blank."""
    scripts = tags(html, r"(?is)<script\s[^>]*>.*?</script>")
    ld = F.filter(scripts, lambda s: F.trim(F.lower(F.regexp_extract(attribute(F.regexp_extract(s, r"(?is)^(<script\s[^>]*>)", 1), "type"), "^([^;]*)", 1))) == "application/ld+json")
    return F.filter(F.transform(ld, lambda s: F.trim(F.regexp_extract(s, r"(?is)^<script\s[^>]*>(.*)</script>$", 1))), lambda s: s != "")


def json_ld_counts(html: Column) -> Column:
    found = json_ld(html)
    broken = F.size(F.filter(found, lambda s: F.try_parse_json(s).isNull()))
    return F.struct((F.size(found) - broken).cast("long").alias("payloads"), broken.cast("long").alias("malformed"))


def open_graph(html: Column) -> Column:
    """Map of og: property to its contents, in order."""
    metas = F.transform(tags(html, r"(?is)<meta\s[^>]*>"), lambda t: F.struct(F.lower(F.trim(attribute(t, "property"))).alias("k"), F.trim(unescape(attribute(t, "content"))).alias("v")))
    good = F.filter(metas, lambda m: m.k.startswith("og:") & (m.v != ""))
    keys = F.array_distinct(F.transform(good, lambda m: m.k))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.transform(F.filter(good, lambda m: m.k == k), lambda m: m.v)))


def visible_length(html: Column) -> Column:
    """Length of the text of content tags, joined by blanks; a tag inside another counts for both. Tags of one name don't nest."""
    total, parts = F.lit(0), F.lit(0)
    for name in CONTENT:
        inner = F.regexp_extract_all(html, F.lit(rf"(?is)<{name}(?:\s[^>]*)?>(.*?)(?:</{name}>|$)"), F.lit(1))
        texts = F.filter(F.transform(inner, text_of), lambda t: t != "")
        total = total + F.aggregate(texts, F.lit(0), lambda a, t: a + F.length(t))
        parts = parts + F.size(texts)
    return total + F.greatest(parts - 1, F.lit(0))


def text_of(html: Column) -> Column:
    """Text between tags, runs joined by one blank."""
    bare = html
    for hidden in (r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"(?s)<!--.*?-->"):
        bare = F.regexp_replace(bare, hidden, " ")
    return F.trim(F.regexp_replace(unescape(F.regexp_replace(bare, r"(?s)<[^>]*>", " ")), r"\s+", " "))


def rendering(html: Column) -> Column:
    """Whether a page needs a browser: score, reasons in order, and what they rest on."""
    length = visible_length(html)
    scripts = F.size(tags(html, r"(?i)<script[\s>]"))
    noscript = F.lower(F.array_join(F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<noscript[^>]*>(.*?)</noscript>"), F.lit(1)), text_of), " "))
    checks = [
        (length < 80, 2, "very-little-visible-content"), ((length >= 80) & (length < 200), 1, "little-visible-content"), (html.rlike(APP_ROOT), 2, "client-app-root"),
        (_any(noscript.contains(p) for p in JS_PHRASES), 3, "javascript-required-message"), (scripts >= 3, 1, "script-heavy-shell"), (length >= 300, -3, "meaningful-server-rendered-content"),
    ]
    score = sum((F.when(c, F.lit(n)).otherwise(F.lit(0)) for c, n, _ in checks), F.lit(0))
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(r)) for c, _, r in checks]))
    return F.struct(((score >= 4) & (length < 300)).alias("requires_browser"), score.cast("long").alias("score"), length.cast("long").alias("visible_text_length"), scripts.cast("long").alias("script_count"), reasons.alias("reasons"))


def evidence(html: Column, base: Column) -> Column:
    return urls.let(F.struct(html.alias("h"), base.alias("b")), lambda x: _evidence(x.h, x.b))


def _evidence(html: Column, base: Column) -> Column:
    counts = json_ld_counts(html)
    return F.struct(title(html).alias("title"), links(html, base).alias("links"), canonical_link(html, base).alias("canonical_url"), json_ld(html).alias("json_ld"), counts["malformed"].alias("malformed_json_ld"), open_graph(html).alias("open_graph"))
