"""Line dedup by winnowing over line hashes.

A document is the sequence of its lines (cut at line feeds, compared as they
are, without white space at either end). A run of at least RUN lines that also
begins earlier, in a document of smaller id or further up in the same one, is
deleted; the first occurrence stays. Shorter repeats stay: single lines recur
in clean text.

1. Each GRAM lines in a row have a hash; of every WINDOW hashes in a row the
   least (leftmost, if tied) is a fingerprint. A run of RUN = WINDOW + GRAM - 1
   lines has all its hashes in one window, so equal runs have a fingerprint in
   common, at the same place.
2. Only fingerprints that occur again are joined. For each the runs that it
   stands for, that is the lines around it on both sides, are compared with
   those of its other occurrences by 128-bit hashes; a run that has begun
   earlier marks its lines. Runs that overlap make up the whole match, however
   far it extends.
3. Documents lose their marked lines; lines left are joined by line feeds again.

Null text stays null and has no lines here. A null id is smaller than any
other. Rows of equal id are told apart by their text and in that order; rows
that are equal in both are treated alike, as one document. The order of
columns and all other columns stay, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gossamer.llm._common import session, slices, tidy, unused, written

GRAM, WINDOW = 2, 2
RUN = WINDOW + GRAM - 1


def fingerprints(lines: list[str], gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """Places and hashes of a document's fingerprints, and the first and last run (by its first line) that each stands for."""
    run = window + gram - 1
    if len(lines) < run:
        return np.empty(0, np.int64), [], np.empty(0, np.int64), np.empty(0, np.int64)
    own = [hashlib.blake2b(x.strip().encode(), digest_size=16).digest() for x in lines]
    h = [hashlib.blake2b(b"".join(own[i : i + gram]), digest_size=16).digest() for i in range(len(own) - gram + 1)]
    least = [min(range(i, i + window), key=lambda j: (h[j], j)) for i in range(len(h) - window + 1)]
    p = np.array(least)
    first = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))
    last = np.append(first[1:], len(p)) - 1
    return p[first], [h[i] for i in p[first]], first, last


def _key(doc_id: Column, text: Column) -> list[Column]:
    return [doc_id.cast("long").alias("__id"), F.unhex(F.substring(F.sha2(text, 256), 1, 32)).alias("__text")]


def repeated_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """__id, __text (a hash), gone: the numbers of the lines to delete, for documents that have any."""
    session(docs)
    run = window + gram - 1

    def winnow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in slices(batch)):
            out: dict[str, list] = {k: [] for k in ("__id", "__text", "h", "at", "run", "start")}
            for i, key, t in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                lines = t.split("\n")
                p, h, first, last = fingerprints(lines, gram, window)
                for place, own, a, b in zip(p.tolist(), h, first.tolist(), last.tolist(), strict=True):
                    out["__id"].append(i)
                    out["__text"].append(key)
                    out["h"].append(own)
                    # the run that starts k lines before the fingerprint, for k from the farthest on
                    out["run"].append([hashlib.blake2b("\n".join(x.strip() for x in lines[s : s + run]).encode(), digest_size=16, salt=b"run").digest() for s in range(a, b + 1)])
                    out["at"].append(place)
                    out["start"].append(a)
            kinds = {"__id": pa.int64(), "__text": pa.binary(), "h": pa.binary(), "at": pa.int32(), "run": pa.list_(pa.binary()), "start": pa.int32()}
            yield pa.RecordBatch.from_arrays([pa.array(out[k], kinds[k]) for k in kinds], names=list(kinds))

    rows = docs.where(F.col(text).isNotNull()).select(*_key(F.col(doc_id), F.col(text)), F.col(text).cast("string").alias("text"))
    # no run fits into fewer lines; split stops at so many
    marks = written(rows.where(F.size(F.split("text", "\n", run)) >= run).mapInArrow(tidy(winnow), "__id long, __text binary, h binary, at int, run array<binary>, start int"), "fingerprints")
    # what is joined to a key that many rows may have is written first: then Spark can split that key's rows
    again = written(marks.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "again")
    place = F.struct(F.coalesce("__id", F.lit(-(2**63))).alias("i"), F.col("__text").alias("t"), F.col("p"))
    runs = written(marks.join(again, "h").select("__id", "__text", F.posexplode("run").alias("k", "run"), "start").select("__id", "__text", "run", (F.col("start") + F.col("k")).alias("p")), "runs")
    first = written(runs.groupBy("run").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("run", "first"), "first")
    later = runs.join(first, "run").where(place > F.col("first"))
    lines = later.select("__id", "__text", F.explode(F.sequence(F.col("p"), F.col("p") + run - 1)).alias("line"))
    return lines.groupBy("__id", "__text").agg(F.sort_array(F.collect_set("line")).alias("gone"))


def remove_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", gram: int = GRAM, window: int = WINDOW, report: bool = False) -> DataFrame:
    """docs without the repeated runs; with report also n_lines and n_removed (0 for null text), which replace columns of these names."""
    own_id, own_text, gid, gtext, gone = unused(docs, "id", "text_hash", "gone_id", "gone_text", "gone_lines")
    found = repeated_lines(docs, doc_id=doc_id, text=text, gram=gram, window=window).select(F.col("__id").alias(gid), F.col("__text").alias(gtext), F.col("gone").alias(gone))
    i, t = _key(F.col(doc_id), F.coalesce(F.col(text).cast("string"), F.lit("")))
    rows = docs.withColumns({own_id: i, own_text: t})
    rows = rows.join(found, (F.col(own_text) == F.col(gtext)) & F.col(own_id).eqNullSafe(F.col(gid)) & F.col(text).isNotNull(), "left")
    lines = F.split(F.col(text), "\n", -1)
    # the numbers that stay come from one pass over both lists; the lambda binds the lines, so that they are split once
    kept = F.transform(F.array(lines), lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(gone)), lambda k: F.get(x, k)))[0]
    new = F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    more = {"n_lines": F.coalesce(F.size(lines), F.lit(0)).cast("long"), "n_removed": F.coalesce(F.size(gone), F.lit(0)).cast("long")} if report else {}
    kinds = dict(docs.dtypes)
    out = [new.cast(kinds[text]).alias(text) if c == text else F.col(c) for c in docs.columns if c not in more]
    return rows.select(*out, *[F.when(F.col(text).isNull(), F.lit(0).cast("long")).otherwise(c).alias(k) for k, c in more.items()])


def oracle_sql(docs: str = "documents", gram: int = GRAM, window: int = WINDOW) -> str:
    """The same by DuckDB, over all runs instead of fingerprints: CTEs up to kept(r, doc_id, text, kept, n_lines, n_removed)."""
    run = window + gram - 1
    blanks = " || ".join(f"chr({c})" for c in range(0x3001) if chr(c).isspace())
    return f"""
{docs}_d AS (SELECT row_number() OVER () AS r, dense_rank() OVER (ORDER BY doc_id NULLS FIRST, substr(sha256(text), 1, 32)) AS o, doc_id, text, string_split(text, chr(10)) AS ls FROM {docs}),
{docs}_l AS (SELECT r, o, unnest(ls) AS x, unnest(range(0, len(ls))) AS p FROM {docs}_d WHERE text IS NOT NULL),
{docs}_t AS (SELECT r, o, p, [{', '.join(f'lead(trim(x, {blanks}), {k}) OVER (PARTITION BY r ORDER BY p)' if k else f'trim(x, {blanks})' for k in range(run))}] AS g, lead(x, {run - 1}) OVER (PARTITION BY r ORDER BY p) IS NOT NULL AS whole FROM {docs}_l),
{docs}_f AS (SELECT r, p, (o, p) > min((o, p)) OVER (PARTITION BY g) AS later FROM {docs}_t WHERE whole),
{docs}_x AS (SELECT DISTINCT r, p + k AS p FROM {docs}_f, range(0, {run}) AS s(k) WHERE later),
{docs}_k AS (SELECT l.r, string_agg(l.x, chr(10) ORDER BY l.p) FILTER (x2.r IS NULL) AS kept, count(*) AS n_lines, count(x2.r) AS n_removed FROM {docs}_l l LEFT JOIN {docs}_x x2 ON x2.r = l.r AND x2.p = l.p GROUP BY l.r),
{docs}_kept AS (SELECT d.r, d.doc_id, d.text, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.kept, '') END AS kept, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed FROM {docs}_d d LEFT JOIN {docs}_k k USING (r))"""


ORACLE_SQL = f"WITH {oracle_sql()} SELECT doc_id, n_lines::BIGINT AS n_lines, n_removed::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents_kept"
