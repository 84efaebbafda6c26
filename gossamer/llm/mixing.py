"""Mixing sources to target weights by temperature, in DataFrame functions only.

A source's weight is its share of the tokens to the power alpha, normalised.
alpha lies in [0, 1] on a grid of 2^-20 and is found by bisection, five
halvings to a job: either the smallest alpha at which no source is repeated
more than max_repetition times, or the largest at which the weights' entropy
(nats) is at least target_entropy. If no alpha reaches the target, the end of
the range that comes nearest is taken (1, resp. 0).

The budget (by default all tokens there are) is then dealt by weight. A source
gives whole epochs of its documents as long as they fit; for the rest its
documents are cut into hash blocks, the blocks put in a hash order, and taken
until the budget is met: whole blocks, and of the block where it is met the
documents in their hash order whose predecessors don't meet it yet. So a
source overshoots its budget by less than one document.

Tokens are words between blanks; null text has none. A null source is a source
of its own. A source without tokens has no weight and gives one copy of its
documents, which costs nothing. Repeated rows count each. Rows of equal doc_id
share a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gossamer.llm._common import text_or_empty, written
from gossamer.llm.fingerprint import words

GRID = 1 << 20
BLOCK_ROWS = 256
#: Digits of a block's place in the order that its range has: running sums are taken over 16 ** RANGE ranges, then within each.
RANGE = 3
SEED = "mix-1"
MAX_REPETITION = 1.25


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def _hash(doc_id: Column, first: int) -> Column:
    """15 hexadecimal digits of the id's seeded MD5 as a long."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), first, 15), 16, 10).cast("long")


def _block_order(block: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{SEED}/"), block.cast("string")))


def exponent(sources: DataFrame, *, budget: float, max_repetition: float | None = None, target_entropy: float | None = None) -> float:
    """alpha for sources with the columns tokens (more than 0) and n, how many sources have so many."""
    if (max_repetition is None) == (target_entropy is None):
        raise ValueError("give either max_repetition or target_entropy")
    total = sources.agg(F.sum(F.col("tokens") * F.col("n"))).first()[0]
    if not total:
        return 1.0
    rows = sources.select((F.col("tokens") / F.lit(float(total))).alias("share"), "n")

    def judged(points: list[int]) -> dict[int, bool]:
        """Whether each point is on the far side, where repetition is low resp. entropy too low."""
        a = F.col("i") / F.lit(float(GRID))
        each = rows.select("share", "n", F.explode(F.array(*[F.lit(p) for p in points])).alias("i"))
        z = F.sum(F.pow("share", a) * F.col("n"))
        if max_repetition is not None:
            far = (F.max(F.pow("share", a - 1)) / z * F.lit(budget / total)) <= F.lit(max_repetition)
        else:
            far = (F.log(z) - F.first(a) * F.sum(F.pow("share", a) * F.log("share") * F.col("n")) / z) < F.lit(target_entropy)
        return {r["i"]: r["far"] for r in each.groupBy("i").agg(far.alias("far")).collect()}

    low, high = -1, GRID + 1  # low is near, high is far
    while high - low > 1:
        points = sorted({low + (high - low) * k // 32 for k in range(1, 32)} - {low, high}) or [low + 1]
        side = judged([max(0, min(GRID, p)) for p in points])
        far = [p for p in points if side[max(0, min(GRID, p))]]
        near = [p for p in points if not side[max(0, min(GRID, p))]]
        high, low = min(far, default=high), max([p for p in near if not far or p < min(far)], default=low)
    return min(1.0, high / GRID) if max_repetition is not None else max(0, low) / GRID


def mix(docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", text: str = "text", budget: float | None = None, max_repetition: float | None = MAX_REPETITION, target_entropy: float | None = None) -> DataFrame:
    """Adds n_tokens, weight (of the source) and copies: how many times the mixture has the document.

    Columns of these names are replaced; names that begin with two underscores are the operator's own.
    """
    held = docs.drop("n_tokens", "weight", "copies").withColumn("n_tokens", n_words(text_or_empty(text)))
    n = docs.count()
    blocks = max(1, -(-n // BLOCK_ROWS))
    key = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))
    block = F.pmod(_hash(F.col(doc_id), 1), F.lit(blocks))
    held = held.withColumn("__source", key).withColumn("__block", block)
    by_block = written(held.groupBy("__source", "__block").agg(F.sum("n_tokens").alias("tokens")), "mix-blocks")
    by_source = by_block.groupBy("__source").agg(F.sum("tokens").alias("total"))
    same = written(by_source.where("total > 0").groupBy(F.col("total").alias("tokens")).agg(F.count("*").alias("n")), "mix-sources")
    said = same.agg(F.sum(F.col("tokens") * F.col("n"))).first()[0] or 0
    budget = float(said if budget is None else budget)
    alpha = exponent(same, budget=budget, max_repetition=max_repetition, target_entropy=target_entropy)
    z = same.agg(F.sum(F.pow(F.col("tokens") / F.lit(float(said or 1)), F.lit(alpha)) * F.col("n"))).first()[0] or 1.0
    weight = F.when(F.col("total") > 0, F.pow(F.col("total") / F.lit(float(said or 1)), F.lit(alpha)) / F.lit(z)).otherwise(F.lit(0.0))
    own = F.floor(weight * F.lit(budget) + 0.5).cast("long")
    plan = by_source.select("__source", weight.alias("__weight"), F.when(F.col("total") > 0, F.floor(own / F.col("total"))).otherwise(F.lit(1)).cast("long").alias("__epochs"), F.when(F.col("total") > 0, own % F.col("total")).otherwise(F.lit(0)).cast("long").alias("rest"))
    # what a source has before each block in its order: before the block's range, and within the range
    placed = by_block.withColumn("__place", _block_order(F.col("__block"))).withColumn("__range", F.substring("__place", 1, RANGE))
    earlier = lambda keys, *order: F.coalesce(F.sum("tokens").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = placed.groupBy("__source", "__range").agg(F.sum("tokens").alias("tokens")).select("__source", "__range", earlier(["__source"], "__range").alias("__first"))
    placed = placed.join(ranges, ["__source", "__range"]).withColumn("__before", F.col("__first") + earlier(["__source", "__range"], "__place", "__block"))
    table = placed.join(plan, "__source").select("__source", "__block", "__weight", "__epochs", (F.col("rest") - F.col("__before")).alias("__left"))
    # the join and the window below need the same exchange
    within = Window.partitionBy("__source", "__block").orderBy("__in", doc_id, text).rowsBetween(Window.unboundedPreceding, -1)
    rows = held.join(table, ["__source", "__block"]).withColumn("__in", _hash(F.col(doc_id), 16))
    rows = rows.withColumn("__sofar", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    rows = rows.withColumn("weight", F.col("__weight")).withColumn("copies", F.col("__epochs") + (F.col("__sofar") < F.col("__left")).cast("long"))
    return rows.select(*[c for c in docs.columns if c not in ("n_tokens", "weight", "copies")], "n_tokens", "weight", "copies")


def realise(docs: DataFrame, **how) -> DataFrame:
    """The mixture itself: each document as many times as it has copies, and epoch from 0; a training order is by (epoch, a hash of both)."""
    rows = mix(docs, **how).where("copies > 0")
    return rows.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))


def oracle_sql(docs: str = "documents") -> str:
    """copies by DuckDB; the tokens, hashes and grid are the same."""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(text, '') AS text, len(list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\r\\f]+'), lambda x: x <> ''))::BIGINT AS n_tokens, coalesce('s' || source, 'n') AS k,
    ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h1, ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 16, 15))::BIGINT AS h2 FROM {docs}),
nb AS (SELECT greatest(1, (count(*) + {BLOCK_ROWS - 1}) // {BLOCK_ROWS}) AS nb FROM d),
b AS (SELECT *, h1 % nb AS blk FROM d, nb),
g AS (SELECT k, blk, sum(n_tokens)::BIGINT AS tokens FROM b GROUP BY ALL),
s AS (SELECT k, sum(tokens)::BIGINT AS total FROM g GROUP BY k),
t AS (SELECT sum(total)::DOUBLE AS t FROM s),
r(lo, hi) AS (SELECT -1::BIGINT, {GRID + 1}::BIGINT UNION ALL
  SELECT CASE WHEN far THEN lo ELSE mid END, CASE WHEN far THEN mid ELSE hi END FROM (
    SELECT lo, hi, (lo + hi) // 2 AS mid, (SELECT max(pow(total / t, greatest(0, least({GRID}, (lo + hi) // 2)) / {GRID}.0::DOUBLE - 1)) / sum(pow(total / t, greatest(0, least({GRID}, (lo + hi) // 2)) / {GRID}.0::DOUBLE)) FROM s, t WHERE total > 0) <= {MAX_REPETITION} AS far FROM r WHERE hi - lo > 1)),
a AS (SELECT least(1.0, min(hi) / {GRID}.0::DOUBLE) AS alpha FROM r),
z AS (SELECT sum(pow(total / t, alpha)) AS z FROM s, t, a WHERE total > 0),
w AS (SELECT k, total, CASE WHEN total > 0 THEN pow(total / t, alpha) / z ELSE 0 END AS weight, t FROM s, t, a, z),
p AS (SELECT k, weight, CASE WHEN total > 0 THEN floor(weight * t + 0.5)::BIGINT // total ELSE 1 END AS epochs, CASE WHEN total > 0 THEN floor(weight * t + 0.5)::BIGINT % total ELSE 0 END AS rest FROM w),
o AS (SELECT k, blk, coalesce(sum(tokens) OVER (PARTITION BY k ORDER BY md5('{SEED}/' || blk::VARCHAR), blk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g),
q AS (SELECT b.doc_id, b.source, b.text, b.n_tokens, p.weight, p.epochs, p.rest - o.before AS room,
  coalesce(sum(b.n_tokens) OVER (PARTITION BY b.k, b.blk ORDER BY h2, b.doc_id, b.text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sofar FROM b JOIN o USING (k, blk) JOIN p ON p.k = b.k)
"""


ORACLE_SQL = oracle_sql() + "SELECT doc_id, source, n_tokens, round(weight, 9) AS weight, (epochs + CASE WHEN sofar < room THEN 1 ELSE 0 END)::BIGINT AS copies FROM q"
