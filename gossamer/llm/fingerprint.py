"""Document fingerprints: bottom-k sketches of word-shingle hashes, in DataFrame functions only.

A text's words are what blanks, tabs and line ends part; a shingle is five
words in a row (all words, if there are fewer), its hash the first 48 bits of
its MD5. The sketch is the k smallest distinct hashes, ascending, as
hexadecimal strings; a sketch of fewer than k hashes holds them all, and then
every estimate is exact. The sketch of a union is the k smallest of the
sketches together, so sketches of parts merge in any order.

Null text counts as empty. An empty text has no shingles and an empty sketch;
two empty sketches are alike (1.0), an empty and another aren't (0.0). Equal
texts have equal fingerprints. Repeated rows stay rows of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gossamer.llm._common import text_or_empty

WORDS = 5
K = 128
DIGITS = 12
_GAPS = "[ \\t\\n\\r\\f]+"
#: Rows of a run of neighbouring ids that one window partition sorts, and how many such runs there are at most.
RUN_ROWS, MOST_RUNS = 512, 65_536


def words(text: Column) -> Column:
    return F.filter(F.split(text, _GAPS), lambda w: w != "")


def hashes(text: Column, n: int = WORDS) -> Column:
    """The hashes of a text's shingles, in their order."""
    digest = lambda s: F.substring(F.md5(s), 1, DIGITS)
    w = words(text)
    return F.transform(
        F.array(w), lambda x: F.when(F.size(x) >= n, F.transform(F.sequence(F.lit(1), F.size(x) - (n - 1)), lambda i: digest(F.array_join(F.slice(x, i, n), " ")))).when(F.size(x) > 0, F.array(digest(F.array_join(x, " ")))).otherwise(F.array().cast("array<string>"))
    )[0]


def sketch(text: Column, k: int = K, n: int = WORDS) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes(text, n))), 1, k)


def merge(*sketches: Column, k: int = K) -> Column:
    """The sketch of the union of what the sketches were made from."""
    return F.slice(F.sort_array(F.array_distinct(F.concat(*sketches))), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimates the Jaccard similarity: the share of the union's sketch that both have."""
    both = F.array_intersect(a, b)
    union = merge(a, b, k=k)
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(union, both)) / F.size(union))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimates the share of a's shingles that b has too; 1.0 for an empty a."""
    union = merge(a, b, k=k)
    own = F.array_intersect(union, a)
    return F.when(F.size(own) == 0, F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(F.size(F.array_intersect(own, b)) / F.size(own))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimates how many distinct shingles there are: exact below k."""
    largest = F.conv(F.element_at(a, -1), 16, 10).cast("double") / F.lit(float(16**DIGITS))
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(float(k - 1)) / largest)


def as_text(a: Column) -> Column:
    return F.array_join(a, "")


def from_text(fingerprint: Column) -> Column:
    n = (F.length(fingerprint) / DIGITS).cast("int")
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(fingerprint, (i - 1) * DIGITS + 1, F.lit(DIGITS))))


def merge_parts(parts: DataFrame, keys: list[str], sketch_col: str = "sketch", k: int = K, salts: int = 32) -> DataFrame:
    """A sketch for each key from the sketches of its parts; a key with many parts is cut by salts first. Keys without hashes have no row."""
    rows = parts.select(*keys, F.explode(sketch_col).alias("__h")).distinct()
    for by in ([*keys, F.pmod(F.crc32("__h"), F.lit(salts))], keys):
        rows = rows.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy("__h"))).where(F.col("__r") <= k)
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list("__h")).alias(sketch_col))


def with_next(docs: DataFrame, doc_id: str, text: str, name: str) -> DataFrame:
    """Adds each row's next text in ascending doc_id (null ids first, equal ids by text); after the last comes the first.

    Ids are cut at quantiles into runs, each sorted on its own; the first row
    of a run is also put at the end of the run before it, so one exchange does
    and no task sees all rows.
    """
    order = F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63)))
    n, least = docs.agg(F.count("*"), F.min(order)).first()
    runs = max(1, min(MOST_RUNS, -(-n // RUN_ROWS)))
    cuts = docs.agg(F.percentile_approx(order, [i / runs for i in range(1, runs)], min(1_000_000, max(10_000, 10 * runs)))).first()[0] if runs > 1 else []
    starts = sorted({x for x in [least, *(cuts or [])] if x is not None}) or [0]
    at = F.lit(0)
    if len(starts) > 1:
        # binary search: the last start that is not beyond the id
        held = F.array(*[F.lit(x).cast("long") for x in starts]) if len(starts) <= 512 else F.split(F.lit(",".join(map(str, starts))), ",").cast("array<long>")
        step = lambda acc, _: F.when(F.get(F.col("__starts"), F.floor((acc.lo + acc.hi + 1) / 2).cast("int")) <= F.col("__order"), F.struct(F.floor((acc.lo + acc.hi + 1) / 2).cast("int").alias("lo"), acc.hi.alias("hi"))).otherwise(F.struct(acc.lo.alias("lo"), F.greatest(acc.lo, F.floor((acc.lo + acc.hi + 1) / 2).cast("int") - 1).alias("hi")))
        rounds = F.sequence(F.lit(1), F.lit(len(starts).bit_length() + 1))
        at = F.aggregate(rounds, F.struct(F.lit(0).alias("lo"), F.lit(len(starts) - 1).alias("hi")), step, lambda acc: acc.lo)
        docs = docs.withColumn("__starts", held)
    rows = docs.withColumn("__order", order).withColumn("__run", at)
    first = F.col("__order") == (F.get(F.col("__starts"), F.col("__run")) if len(starts) > 1 else F.lit(starts[0]))
    place = lambda run, extra: F.struct(run.cast("int").alias("run"), F.lit(extra).alias("extra"))
    rows = rows.withColumn("__at", F.explode(F.when(first, F.array(place(F.col("__run"), False), place(F.pmod(F.col("__run") - 1, F.lit(len(starts))), True))).otherwise(F.array(place(F.col("__run"), False)))))
    rows = rows.drop("__starts", "__run").withColumn("__run", F.col("__at.run")).withColumn("__extra", F.col("__at.extra")).drop("__at")
    return rows.withColumn(name, F.lead(text).over(run_window(text)))


def run_window(text: str):
    return Window.partitionBy("__run").orderBy("__extra", "__order", text)


def edited_likeness(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """Each text's fingerprint beside that of its edited text and how alike they, and it and the next text, are.

    The edited text has the last quarter of its code points (rounded down)
    replaced by the first as many of the next text, or all of it.
    """
    rows = with_next(docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text")), "doc_id", "text", "__next")
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("__edited", F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("__next", F.lit(1), quarter)))
    rows = rows.withColumn("__own", sketch(F.col("text"), k)).withColumn("__next_own", F.lead("__own").over(run_window("text"))).where(~F.col("__extra"))
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("__edited"), 256).alias("edited_sha256"), "__own", "__next_own", sketch(F.col("__edited"), k).alias("__changed"))
    return rows.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("__own")).alias("fingerprint"), as_text(F.col("__changed")).alias("edited_fingerprint"), resemblance(F.col("__own"), F.col("__changed"), k).alias("near_edited"), resemblance(F.col("__own"), F.col("__next_own"), k).alias("near_next"))


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id NULLS FIRST, text), first_value(text) OVER (ORDER BY doc_id NULLS FIRST, text)) AS nx FROM d),
e AS (SELECT doc_id, text, nx, substr(text, 1, length(text) - length(text) // 4) || substr(nx, 1, length(text) // 4) AS ed FROM n),
w AS (SELECT *, list_filter(string_split_regex(text, '[ \\t\\n\\r\\f]+'), lambda x: x <> '') AS wt, list_filter(string_split_regex(ed, '[ \\t\\n\\r\\f]+'), lambda x: x <> '') AS we, list_filter(string_split_regex(nx, '[ \\t\\n\\r\\f]+'), lambda x: x <> '') AS wn FROM e),
h AS (SELECT *,
  CASE WHEN len(wt) >= {WORDS} THEN list_transform(range(1, len(wt) - {WORDS - 2}), lambda i: substr(md5(array_to_string(wt[i:i + {WORDS - 1}], ' ')), 1, {DIGITS})) WHEN len(wt) > 0 THEN [substr(md5(array_to_string(wt, ' ')), 1, {DIGITS})] ELSE [] END AS ht,
  CASE WHEN len(we) >= {WORDS} THEN list_transform(range(1, len(we) - {WORDS - 2}), lambda i: substr(md5(array_to_string(we[i:i + {WORDS - 1}], ' ')), 1, {DIGITS})) WHEN len(we) > 0 THEN [substr(md5(array_to_string(we, ' ')), 1, {DIGITS})] ELSE [] END AS he,
  CASE WHEN len(wn) >= {WORDS} THEN list_transform(range(1, len(wn) - {WORDS - 2}), lambda i: substr(md5(array_to_string(wn[i:i + {WORDS - 1}], ' ')), 1, {DIGITS})) WHEN len(wn) > 0 THEN [substr(md5(array_to_string(wn, ' ')), 1, {DIGITS})] ELSE [] END AS hn FROM w),
s AS (SELECT doc_id, text, ed, list_sort(list_distinct(ht))[1:{K}] AS a, list_sort(list_distinct(he))[1:{K}] AS b, list_sort(list_distinct(hn))[1:{K}] AS c FROM h),
u AS (SELECT *, list_sort(list_distinct(list_concat(a, b)))[1:{K}] AS ab, list_sort(list_distinct(list_concat(a, c)))[1:{K}] AS ac FROM s)
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(ed) AS edited_sha256, array_to_string(a, '') AS fingerprint, array_to_string(b, '') AS edited_fingerprint,
  CASE WHEN len(ab) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(ab, list_intersect(a, b)))::DOUBLE / len(ab) END AS near_edited,
  CASE WHEN len(ac) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(ac, list_intersect(a, c)))::DOUBLE / len(ac) END AS near_next
FROM u
"""
