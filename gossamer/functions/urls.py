"""URL expressions: built-in regular expressions and string functions only.

Each takes and gives Columns; what is not a usable http(s) URL gives null. A
host that isn't ASCII, or a reference with dot segments, is left to the Arrow
functions of gossamer.functions.robust.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*):(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
#: Labels of 1 to 63 characters between dots, as IDNA asks of ASCII hosts.
LABELS = r"^[^.]{1,63}(\.[^.]{1,63})*$"
DOT_SEGMENT = r"(^|/)\.\.?(/|$)"


def cleaned(url: Column) -> Column:
    """Without leading blanks and controls, and without tabs and line ends anywhere."""
    return F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")


def part(url: Column, k: int) -> Column:
    return F.regexp_extract(cleaned(url), PARTS, k)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f names it; plain expressions would repeat it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def parts(url: Column) -> Column:
    """Struct s (scheme), n (netloc), p (path), q (query), h (host, lower case, without closing dots), o (port as written)."""

    def hosted(x: Column) -> Column:
        bracketed = x.n.startswith("[")
        host = F.when(bracketed, F.regexp_extract(x.n, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_extract(x.n, r"^([^:]*)", 1))
        port = F.when(bracketed, F.regexp_extract(x.n, r"^\[[^\]]*\]:(.*)$", 1)).otherwise(F.regexp_extract(x.n, r"^[^:]*:(.*)$", 1))
        return F.struct(x.s.alias("s"), x.n.alias("n"), x.p.alias("p"), x.q.alias("q"), F.regexp_replace(F.lower(host), r"\.+$", "").alias("h"), port.alias("o"))

    split = lambda u: F.struct(F.lower(F.regexp_extract(u, PARTS, 1)).alias("s"), *[F.regexp_extract(u, PARTS, k).alias(n) for k, n in ((2, "n"), (3, "p"), (4, "q"))])
    return let(cleaned(url), lambda u: let(split(u), hosted))


def _usable(x: Column) -> Column:
    fine = x.s.isin("http", "https") & ~x.n.contains("@") & (F.length(x.h) > 0) & (x.h.contains(":") | x.h.rlike(LABELS))
    return fine & ((x.o == "") | (x.o.rlike("^[0-9]{1,9}$") & (x.o.try_cast("int") <= 65535)))


def usable(url: Column) -> Column:
    return let(parts(url), _usable)


def _default_port(x: Column) -> Column:
    return F.when(x.s == "https", F.lit(443)).otherwise(F.lit(80))


def canonical(url: Column) -> Column:
    """Scheme and host in lower case, no default port, no fragment, `/` for an empty path; the query as it is."""

    def made(x: Column) -> Column:
        shown = F.when(x.h.contains(":"), F.concat(F.lit("["), x.h, F.lit("]"))).otherwise(x.h)
        port = x.o.try_cast("int")
        suffix = F.when((x.o == "") | (port == _default_port(x)), F.lit("")).otherwise(F.concat(F.lit(":"), port.cast("string")))
        whole = F.concat(x.s, F.lit("://"), shown, suffix, F.when(x.p == "", F.lit("/")).otherwise(x.p), F.when(x.q == "", F.lit("")).otherwise(F.concat(F.lit("?"), x.q)))
        return F.when(_usable(x), whole)

    return let(parts(url), made)


def host(url: Column) -> Column:
    return let(parts(url), lambda x: F.when((F.length(x.h) > 0) & (x.h.contains(":") | x.h.rlike(LABELS)), x.h))


def same_host(a: Column, b: Column) -> Column:
    return host(a) == host(b)


def same_origin(a: Column, b: Column) -> Column:
    port = lambda x: F.when(x.o == "", _default_port(x)).otherwise(x.o.try_cast("int"))
    named = lambda x: F.when((F.length(x.h) > 0) & (x.h.contains(":") | x.h.rlike(LABELS)), x.h)
    return let(F.struct(parts(a).alias("a"), parts(b).alias("b")), lambda z: (z.a.s == z.b.s) & (named(z.a) == named(z.b)) & (port(z.a) == port(z.b)))


def origin(url: Column) -> Column:
    return F.concat(part(url, 1), F.lit("://"), part(url, 2))


def resolve(base: Column, ref: Column) -> Column:
    """ref against base, for references without dot segments."""
    x = F.struct(*[part(base, k).alias(n) for k, n in ((1, "s"), (2, "n"), (3, "p"), (4, "q"))], base.alias("b"), ref.alias("r"))

    def made(x: Column) -> Column:
        at = F.concat(x.s, F.lit("://"), x.n)
        path = F.when(x.p == "", F.lit("/")).otherwise(x.p)
        return (
            F.when(x.r == "", x.b)
            .when(x.r.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), x.r)
            .when(x.r.startswith("//"), F.concat(x.s, F.lit(":"), x.r))
            .when(x.r.startswith("/"), F.concat(at, x.r))
            .when(x.r.startswith("?"), F.concat(at, path, x.r))
            .when(x.r.startswith("#"), F.concat(at, path, F.when(x.q == "", F.lit("")).otherwise(F.concat(F.lit("?"), x.q)), x.r))
            .otherwise(F.concat(at, F.regexp_replace(path, "[^/]*$", ""), x.r))
        )

    return let(x, made)


def safe_join(base: Column, ref: Column) -> Column:
    """The canonical URL that a reference means; null if blank or unusable."""
    return let(F.trim(ref), lambda bare: F.when(bare != "", canonical(resolve(base, bare))))


def valid_crawl_id(value: Column) -> Column:
    return value.rlike(r"^[A-Za-z0-9][A-Za-z0-9._\-]{0,127}$")


def new_crawl_id() -> Column:
    return F.concat(F.lit("cr_"), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 16))


def crawl_hash_tag(crawl_id: Column) -> Column:
    return F.substring(F.sha2(crawl_id, 256), 1, 24)


def content_length(value: Column) -> Column:
    """A header's number of bytes; null if it is none or negative. Python's int() is the model: sign, blanks, single underscores."""
    bare = F.regexp_replace(value, r"^\s+|\s+$", "")
    number = F.when(bare.rlike(r"^[+\-]?[0-9]+(_[0-9]+)*$"), F.replace(bare, F.lit("_"), F.lit("")).try_cast("bigint"))
    return F.when(number >= 0, number)


def header(headers: Column, name: str) -> Column:
    """A header by its name in lower case, trimmed; null if it is absent or blank."""
    low = F.transform_keys(headers, lambda k, _: F.lower(k))
    return F.nullif(F.trim(F.element_at(low, name)), F.lit(""))


def validators(headers: Column) -> Column:
    return F.struct(header(headers, "etag").alias("etag"), header(headers, "last-modified").alias("last_modified"))


def conditional_headers(etag: Column, last_modified: Column) -> Column:
    return F.map_filter(F.create_map(F.lit("If-None-Match"), etag, F.lit("If-Modified-Since"), last_modified), lambda _, v: v.isNotNull())


def proxy_parts(url: Column) -> Column:
    """Scheme, host, port and decoded credentials of a proxy URL."""
    netloc = part(url, 2)
    user = F.regexp_extract(netloc, r"^(.*)@", 1)
    at = F.regexp_extract(netloc, r"([^@]*)$", 1)
    decoded = lambda c: F.nullif(F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), F.lit(""))
    return F.struct(
        F.lower(part(url, 1)).alias("scheme"), F.lower(F.regexp_extract(at, r"^(\[[^\]]*\]|[^:]*)", 1)).alias("host"), F.regexp_extract(at, r":([0-9]+)$", 1).try_cast("int").alias("port"),
        decoded(F.regexp_extract(user, r"^([^:]*)", 1)).alias("username"), decoded(F.regexp_extract(user, r"^[^:]*:(.*)$", 1)).alias("password"),
    )
