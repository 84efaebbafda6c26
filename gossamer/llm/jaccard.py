"""Near-duplicate join on word shingles: a chosen-path join, then exact checks.

A document is the set of its shingles (WORDS words in a row, split at white
space; all words, if there are fewer). Two documents are linked if the Jaccard
similarity of their sets is at least the threshold.

1. Documents of equal text are one class, told by 128 bits of SHA-256.
2. A class's set is embedded as SKETCH minhash tokens. In each run a path
   starts at the root; at each step it goes on with every token that a hash of
   path and token picks, with chance 1 / (threshold x SKETCH), so a pair at the
   threshold is expected to share one path on every level. Classes on the same path
   are a bucket. Buckets of more than LEAF classes are split again on further
   tokens; smaller ones are compared by brute force on the tokens' low bytes.
   Before a bucket is split, classes alike to one of a few pivots that are alike
   themselves are connected by them and leave it. By the triangle inequality
   only what lies within twice the distance that counts as alike from such a
   pivot can be alike to them: that is compared with the whole bucket and leaves
   it too, if it is little enough; otherwise the whole bucket is split.
   Runs repeat until a pair at the threshold is missed by all with a chance
   below 1 - recall, even if all its buckets are so large that it must share a
   path down to DEPTH. What is still too large at DEPTH is compared in blocks,
   each pair of blocks once.
3. Pairs whose estimate is not far below the threshold connect into clusters;
   a task hands on a spanning forest of what its buckets connect, not all pairs.
4. Within a cluster pairs are compared exactly, on the sets of 64-bit shingle
   hashes. A cluster beyond BLOCK classes or BLOCK_BYTES of hashes is cut by the
   size of the sets, into steps of 1 / threshold: linked sets lie in one step or
   in neighbours. A step is cut into blocks, and pairs of blocks are compared.
   That also finds pairs that every run has missed, if both are in one cluster.

A class id is the smallest doc_id of a connected component of links, a
document's links are all other documents that it is linked with, copies among
them. A document without a word has no shingle and is linked with its copies
only. Null text counts as empty. Null ids never are class ids; a component
without any id has a null class id. Repeated rows are copies.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gossamer.llm._common import chunks, session, slices, text_or_empty, tidy, unused, written
from gossamer.llm._components import components

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.999
SKETCH, LEAF, DEPTH, BLOCK = 128, 96, 4, 512
BLOCK_BYTES = 4_000_000
#: Picked of a large bucket, at random by hash.
PIVOTS = 8
#: Of the bitmap that is broadcast before texts are moved: 533,000 rows of 16 bytes at most.
FILTER_BITS = 1 << 25
#: A task remembers what it has connected of so many classes.
FOREST = 200_000
_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(1, 2**63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, SKETCH, dtype=np.uint64)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[str], n: int = WORDS) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, ascending."""
    split = [t.split() for t in texts]
    flat = [w for x in split for w in x]
    h = pd.util.hash_array(np.array(flat, object), categorize=False).astype(np.uint64) if flat else np.empty(0, np.uint64)
    if len(h) >= n:
        runs = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            runs = mix(runs * _M1 + h[k : len(h) - n + 1 + k])
    out, at = [], 0
    for x in split:
        if len(x) >= n:
            out.append(np.unique(runs[at : at + len(x) - n + 1]))
        elif x:
            s = np.uint64(len(x))
            for v in h[at : at + len(x)]:
                s = mix(np.array([s ^ v], np.uint64) * _M1)[0]
            out.append(np.array([s], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
        at += len(x)
    return out


def minhash(s: np.ndarray) -> np.ndarray:
    least = np.full(SKETCH, 2**64 - 1, np.uint64)
    for at in range(0, len(s), 4096):
        least = np.minimum(least, (s[at : at + 4096, None] * _A + _B).min(axis=0))
    return (least >> np.uint64(32)).astype(np.uint32)


def runs_needed(recall: float = RECALL, depth: int = 2) -> int:
    """A pair at the threshold shares a path of one run down to depth with the chance that a Poisson(1) branching lives so long."""
    live = 1.0
    for _ in range(depth):
        live = 1 - math.exp(-live)
    return math.ceil(math.log(1 - recall) / math.log(1 - live))


def next_paths(path: np.ndarray, sketch: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For rows of (path, sketch): the number of the row and the longer path, for each token picked."""
    token = (np.arange(SKETCH, dtype=np.uint64) << np.uint64(32)) | sketch.astype(np.uint64)
    h = mix((token * _M2) ^ mix(path)[:, None])
    row, col = np.nonzero(h < np.uint64(int(2**64 / (threshold * SKETCH))))
    return row, mix(h[row, col] ^ _M1)


def text_key(text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def classes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n_words: int = WORDS) -> DataFrame:
    """t (which text), n (how many documents), rep (their smallest id), sketch, low (its low bytes); sketch is null without words."""
    session(docs)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, sk, low = [], [], []
            for part in chunks(batch.column(1)):
                for x, s in zip(part, shingles(part, n_words), strict=True):
                    t.append(hashlib.sha256(x.encode()).digest()[:16])
                    v = minhash(s) if len(s) else None
                    sk.append(None if v is None else v.tobytes())
                    low.append(None if v is None else v.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(t, pa.binary()), pa.array(sk, pa.binary()), pa.array(low, pa.binary())], names=["id", "t", "sketch", "low"])

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), text_or_empty(text).alias("text")).mapInArrow(tidy(sign), "id long, t binary, sketch binary, low binary")
    return written(rows.groupBy("t").agg(F.count("*").alias("n"), F.min("id").alias("rep"), F.any_value("sketch").alias("sketch"), F.any_value("low").alias("low")), "classes")


def _paths(rows: DataFrame, threshold: float, roots: np.ndarray | None = None) -> DataFrame:
    """key, t for rows of t, sketch and, unless they start at the roots, keys: all paths that t is on and that go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in slices(batch)):
            t = part.column(0)
            sk = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint32).reshape(-1, SKETCH)
            every = np.arange(len(sk))
            if roots is not None:
                starts = [(every, np.full(len(sk), r, np.uint64)) for r in roots]
            else:
                held = part.column(2)
                starts = [(np.repeat(every, held.value_lengths().to_numpy()), held.flatten().to_numpy().view(np.uint64))]
            for of, start in starts:
                row, key = next_paths(start, sk[of], threshold)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), t.take(pa.array(of[row]))], names=["key", "t"])

    return rows.select("t", "sketch", *([] if roots is not None else ["keys"])).mapInArrow(tidy(run), "key long, t binary")


class Forest:
    """Joins nodes; join says whether they weren't connected yet. Beyond FOREST nodes it forgets."""

    def __init__(self, most: int = FOREST):
        self.most = most
        self.up: dict[bytes, bytes] = {}

    def root(self, x: bytes) -> bytes:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    def join(self, a: bytes, b: bytes) -> bool:
        if len(self.up) >= self.most:
            self.up = {}
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _stars(lists: DataFrame, least: float) -> DataFrame:
    """Edges a, b from rows of part (0 or 1), t, low gathered in lists: what is alike, each component of a task by a tree; with both parts, across them only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for batch in batches:
            a, b = [], []
            for members in (x for part in slices(batch.column(0), 16) for x in part.to_pylist()):
                if len(members) < 2:
                    continue
                t = [m["t"] for m in members]
                s = np.frombuffer(b"".join(m["low"] for m in members), np.uint8).reshape(-1, SKETCH)
                part = np.array([m["part"] for m in members])
                like = np.zeros((len(t), len(t)), bool)
                for i in range(len(t)):
                    like[i] = ((s == s[i]).mean(axis=1) - 1 / 256) / (255 / 256) >= least
                if part.any():
                    like &= part[:, None] != part
                for i, r in enumerate(local_roots(like)):
                    if i != r and forest.join(t[i], t[r]):
                        a.append(t[i])
                        b.append(t[r])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return lists.mapInArrow(tidy(run), "a binary, b binary")


def local_roots(like: np.ndarray) -> np.ndarray:
    """The least member of each one's component."""
    root = np.arange(len(like))
    while True:
        new = np.where(like | np.eye(len(like), dtype=bool), root, len(like)).min(axis=1) if len(like) else root
        new = new[new] if len(new) else new
        if (new == root).all():
            return root
        root = new


def _settled(large: DataFrame, held: DataFrame, least: float, depth: int) -> tuple[DataFrame, list[DataFrame]]:
    """Rows (key, t, n) of large buckets that must be split on, and edges a, b that stand for all likenesses of the others, and of those left with the others."""
    seen = large.join(held.select("t", "low"), "t")
    own = F.pmod(F.xxhash64("t"), F.ceil(F.col("n") / BLOCK)).cast("int").alias("block")
    # each block picks its own, so that a bucket's rows are moved once
    pick = [F.min_by(F.struct("t", "low"), F.xxhash64("t", F.lit(k))) for k in range(PIVOTS)]
    blocks = written(seen.groupBy("key", own).agg(F.collect_list(F.struct("t", "low")).alias("members"), F.array(*pick).alias("picks")), f"blocks-{depth}")
    best = [F.min_by(F.col("picks")[k], F.xxhash64(F.col("picks")[k]["t"], F.lit(k))) for k in range(PIVOTS)]
    pivots = written(blocks.groupBy("key").agg(F.array(*best).alias("pivots")), f"pivots-{depth}")
    bytes_of = lambda rows: np.frombuffer(b"".join(x["low"] for x in rows), np.uint8).reshape(-1, SKETCH)
    # the share of equal bytes of what is alike, and of what may be alike to something that is alike to a pivot
    alike = least * 255 / 256 + 1 / 256 - 1e-9
    near = 1 - 2 * (1 - alike)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for row in (x for batch in batches for cut in slices(batch, 4) for x in cut.to_pylist()):
            members, pivot = row["members"], list({x["t"]: x for x in row["pivots"]}.values())
            p, s = bytes_of(pivot), bytes_of(members)
            root = local_roots((p[:, None, :] == p).mean(axis=2) >= alike)
            group = np.flatnonzero(root == np.bincount(root).argmax())
            share = np.stack([(s == p[k]).mean(axis=1) for k in group], axis=1)
            most, of = share.max(axis=1), group[share.argmax(axis=1)]
            out = [(None, x, y, 0, 0) for x, y in ((pivot[j]["t"], pivot[k]["t"]) for j in group for k in group if j < k and (p[j] == p[k]).mean() >= alike) if forest.join(x, y)]
            for m, share_, k in zip(members, most, of, strict=True):
                if share_ < alike:
                    out.append((row["key"], m["t"], m["low"], 1 if share_ >= near else 2, 1))
                elif m["t"] != (to := pivot[k]["t"]) and forest.join(m["t"], to):
                    out.append((None, m["t"], to, 0, 0))
            out.append((row["key"], None, None, 3, int((most >= alike).sum())))
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int64()), strict=True)], names=["key", "a", "b", "kind", "rows"])

    # kind: 0 an edge, 1 beside the pivots' group, 2 far from it, 3 the number of a block's rows in it
    told = written(blocks.join(pivots, "key").select("key", "members", "pivots").mapInArrow(tidy(part), "key long, a binary, b binary, kind int, rows long"), f"parted-{depth}")
    rows = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("rows")).otherwise(0))
    counts = told.where("kind > 0").groupBy("key").agg(rows(3).alias("group"), rows(1).alias("beside"), rows(2).alias("far"))
    # at most BLOCK comparisons for each class that is spared the splitting
    done = (F.col("group") > 1) & (F.col("beside") * (F.col("group") + F.col("beside") + F.col("far")) <= BLOCK * F.col("group"))
    verdict = written(counts.select("key", "far", done.alias("done")), f"verdict-{depth}")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for row in (x for batch in batches for cut in slices(batch, 4) for x in cut.to_pylist()):
            members, s, found = row["members"], bytes_of(row["members"]), []
            for x, low in zip(row["beside"], bytes_of(row["beside"]), strict=True):
                found += [(x["t"], members[k]["t"]) for k in np.flatnonzero((s == low).mean(axis=1) >= alike) if forest.join(x["t"], members[k]["t"])]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.binary()), pa.array([x for _, x in found], pa.binary())], names=["a", "b"])

    beside = told.where("kind = 1").join(verdict.where("done"), "key").groupBy("key").agg(F.collect_list(F.struct(F.col("a").alias("t"), F.col("b").alias("low"))).alias("beside"))
    met = blocks.join(written(beside, f"beside-{depth}"), "key").select("members", "beside").mapInArrow(tidy(across), "a binary, b binary")
    far = told.where("kind = 2").join(verdict.where("done and far > 1"), "key").select("key", F.col("a").alias("t"), F.col("far").alias("n"))
    rest = large.join(verdict.where("not done"), "key").select("key", "t", "n").unionByName(far)
    return written(rest, f"rest-{depth}"), [told.where("kind = 0").select("a", "b"), written(met, f"met-{depth}")]


def _grid(rows: DataFrame, group: str, n: Column, block: int) -> DataFrame:
    """Repeats rows of a group for each pair of blocks (i <= j) that their block is in; part says on which side."""
    blocks = F.ceil(n / block).cast("int")
    own = F.pmod(F.xxhash64("t"), blocks).cast("int")
    rows = rows.withColumn("__blocks", blocks).withColumn("__own", own)
    other = F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)).alias("__other")
    rows = rows.select("*", other)
    return rows.select("*", F.least("__own", "__other").alias("i"), F.greatest("__own", "__other").alias("j"), (F.col("__own") > F.col("__other")).cast("int").alias("part")).drop("__blocks", "__own", "__other")


def candidates(held: DataFrame, *, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """node, root: clusters of classes that may have links."""
    has = held.where("sketch is not null")
    least = threshold - 3.5 * math.sqrt(threshold * (1 - threshold) / SKETCH)
    rows = _paths(has, threshold, roots=np.arange(1, runs_needed(recall, DEPTH) + 1, dtype=np.uint64))
    edges = []
    for depth in range(1, DEPTH + 1):
        rows = written(rows, f"paths-{depth}", gather=depth == 1)
        # written before it is joined, so that Spark can split the rows of a large bucket
        size = written(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), f"sizes-{depth}")
        live = written(rows.join(size, "key"), f"live-{depth}")
        small = live.where(F.col("n") <= LEAF).groupBy("key").agg(F.sort_array(F.collect_list("t")).alias("ts"))
        # the same list of classes from several paths is compared once
        lists = small.select(F.xxhash64("ts").alias("key"), F.explode("ts").alias("t")).distinct()
        leaf = lists.join(held.select("t", "low"), "t").groupBy("key").agg(F.collect_list(F.struct(F.lit(0).alias("part"), "t", "low")).alias("members"))
        edges.append(written(_stars(leaf.select("members"), least), f"leaves-{depth}"))
        large = live.where(F.col("n") > LEAF)
        if not large.head(1):
            break
        large, more = _settled(large, held, least, depth)
        edges += more
        if not large.head(1):
            break
        if depth == DEPTH:
            cut = _grid(large.join(held.select("t", "low"), "t"), "key", F.col("n"), BLOCK)
            blocks = cut.groupBy("key", "i", "j").agg(F.collect_list(F.struct("part", "t", "low")).alias("members"))
            edges.append(_stars(blocks.select("members"), least))
        else:
            # a class's sketch is moved once, not once for each of its paths, of which a run has few
            on = large.groupBy("t").agg(F.collect_list("key").alias("keys"))
            rows = _paths(on.join(held.select("t", "sketch"), "t"), threshold)
    found = edges[0]
    for x in edges[1:]:
        found = found.unionByName(x)
    return written(components(found), "clusters")


def _cells(rows: DataFrame, threshold: float) -> DataFrame:
    """Rows of cluster, t, shingles, dealt to cells of pairs of blocks that may hold links, so that each pair of rows meets once at most.

    A cell is (cluster, lo, i, hi, j): block i of step lo against block j of
    step hi, which is lo or lo + 1; part is 1 for rows of the second block of a
    cell of two. whole: the cell is all of the cluster.
    """
    size = F.octet_length("shingles")
    clusters = rows.groupBy("cluster").agg((F.count("*") <= BLOCK).alias("few"), (F.sum(size) <= BLOCK_BYTES).alias("light")).select("cluster", (F.col("few") & F.col("light")).alias("whole"))
    # a little more than 1 / threshold, so that rounding never parts neighbours
    step = F.floor(F.log(F.greatest(size / 8, F.lit(1.0))) / F.lit(math.log(1 / threshold) * (1 + 1e-9))).cast("int")
    rows = rows.join(written(clusters, "whole"), "cluster").withColumn("step", F.when(F.col("whole"), F.lit(0)).otherwise(step))
    steps = written(rows.groupBy("cluster", "step").agg(F.count("*").alias("c"), F.sum(size).alias("b"), F.first("whole").alias("whole")).select("cluster", "step", F.when(F.col("whole"), F.lit(1)).otherwise(F.greatest(F.ceil(F.col("c") / BLOCK), F.ceil(F.col("b") / BLOCK_BYTES)).cast("int")).alias("blocks")), "steps")
    beside = lambda k, name: steps.select("cluster", (F.col("step") + k).alias("step"), F.col("blocks").alias(name))
    around = written(steps.join(beside(1, "below"), ["cluster", "step"], "left").join(beside(-1, "above"), ["cluster", "step"], "left"), "around")
    rows = rows.join(around, ["cluster", "step"]).withColumn("own", F.pmod(F.xxhash64("t"), F.col("blocks")).cast("int"))
    cell = lambda lo, i, hi, j, part: F.struct(lo.alias("lo"), i.cast("int").alias("i"), hi.alias("hi"), j.cast("int").alias("j"), part.cast("int").alias("part"))
    up_to = lambda n, make: F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), make)).otherwise(F.array())
    own, at = F.col("own"), F.col("step")
    same = up_to(F.col("blocks"), lambda k: cell(at, F.least(own, k), at, F.greatest(own, k), own > k))
    below = up_to(F.coalesce("below", F.lit(0)), lambda k: cell(at - 1, k, at, own, F.lit(1)))
    above = up_to(F.coalesce("above", F.lit(0)), lambda k: cell(at, own, at + 1, k, F.lit(0)))
    return rows.select("t", "cluster", "n", "whole", "shingles", F.explode(F.concat(same, below, above)).alias("cell")).select("t", "cluster", "n", "whole", "shingles", "cell.*")


def _compare(threshold: float):
    def links(table: pa.Table) -> pa.Table:
        """Of one cell: each class's linked documents and the least class that it reaches here."""
        t, n = table["t"].to_pylist(), table["n"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
        part = table["part"].to_numpy()
        size = np.array([len(s) for s in sets], np.int64)
        inter = intersections(sets)
        like = inter >= threshold * (size[:, None] + size - inter) - 1e-9
        np.fill_diagonal(like, False)
        if table["i"][0] != table["j"][0] or table["lo"][0] != table["hi"][0]:
            like &= part[:, None] != part
        root = local_roots(like)
        return pa.table({"t": pa.array(t, pa.binary()), "links": pa.array((like * n).sum(axis=1).astype(np.int64)), "root": pa.array([t[r] for r in root], pa.binary()), "whole": table["whole"]})

    return links


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sets share: products of incidence rows, so many columns at a time."""
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    own = np.repeat(np.arange(len(sets)), size)
    _, col, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    keep = shared[col]
    col, own = number[col[keep]], own[keep]
    order = np.argsort(col, kind="stable")
    col, own = col[order], own[order]
    out = np.zeros((len(sets), len(sets)))
    width = 4096
    for at in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(col, [at, at + width])
        m = np.zeros((len(sets), width), np.float32)
        m[own[lo:hi], col[lo:hi] - at] = 1
        out += m @ m.T
    out = np.rint(out).astype(np.int64)
    np.fill_diagonal(out, size)
    return out


def _only(rows: DataFrame, member: DataFrame, key: list[Column]) -> DataFrame:
    """rows that may have one of member's keys: a bitmap of hashed keys, at most FILTER_BITS, is broadcast, so that few other rows are moved.

    A larger member table than the bitmap serves lets more rows through; the join that follows decides.
    """
    n = member.count()
    bits = min(FILTER_BITS, max(1 << 12, 1 << (32 * max(n, 1)).bit_length()))
    place = F.pmod(F.xxhash64(*key), F.lit(bits))
    words = member.select(place.alias("p")).groupBy(F.floor(F.col("p") / 63).alias("__word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 63 as int))")).alias("__mask"))
    own = rows.withColumn("__p", place).withColumn("__word", F.floor(F.col("__p") / 63))
    return own.join(F.broadcast(words), "__word").where(F.expr("shiftright(__mask, cast(__p % 63 as int)) & 1 = 1")).drop("__word", "__mask", "__p")


def link_classes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n_words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """For each distinct text: t, n, root (least t of its component), class_id, links (of documents with other texts)."""
    held = classes(docs, doc_id=doc_id, text=text, n_words=n_words)
    cluster = candidates(held, threshold=threshold, recall=recall)
    member = cluster.join(held.select(F.col("t").alias("node"), "n", "rep"), "node").select(F.col("node").alias("t"), F.col("root").alias("cluster"), "n", F.col("rep").alias("id"))
    member = written(member, "members")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [s.tobytes() for part in chunks(batch.column(3)) for s in shingles(part, n_words)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(got, pa.binary())], names=["t", "cluster", "n", "shingles"])

    own = docs.select(F.col(doc_id).cast("long").alias("id"), text_or_empty(text).alias("text")).withColumn("t", text_key(F.col("text")))
    own = _only(own, member, [F.col("t"), F.col("id")])
    of = member.withColumnsRenamed({"t": "__t", "id": "__id"})
    texts = own.join(of, (F.col("t") == F.col("__t")) & F.col("id").eqNullSafe(F.col("__id"))).select("t", "cluster", "n", "text")
    found = written(texts.mapInArrow(tidy(sets), "t binary, cluster binary, n long, shingles binary").dropDuplicates(["t"]), "shingles")
    compared = _cells(found, threshold).groupBy("cluster", "lo", "i", "hi", "j").applyInArrow(_compare(threshold), "t binary, links long, root binary, whole boolean")
    linked = written(compared, "links")
    # a cluster that was compared in one piece has its components already
    root = linked.where("whole").select(F.col("t").alias("node"), "root")
    parts = linked.where("not whole").select(F.col("t").alias("a"), F.col("root").alias("b"))
    if parts.head(1):
        root = root.unionByName(components(parts))
    links = linked.groupBy("t").agg(F.sum("links").alias("links"))
    out = held.select("t", "n", "rep").join(links, "t", "left").join(root.withColumnRenamed("node", "t"), "t", "left")
    out = written(out.select("t", "n", "rep", F.coalesce("root", "t").alias("root"), F.coalesce("links", F.lit(0)).cast("long").alias("links")), "linked")
    return out.join(out.groupBy("root").agg(F.min("rep").alias("class_id")), "root").select("t", "n", "root", "class_id", "links")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """doc_id, class_id, n_links: a row for each row of docs."""
    found = link_classes(docs, doc_id=doc_id, text=text, **how)
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_key(text_or_empty(text)).alias("t"))
    return own.join(found, "t").select("doc_id", "class_id", (F.col("links") + F.col("n") - 1).alias("n_links"))


def one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of docs that stay if each class keeps one document, that of the class id. All columns stay, whatever their names."""
    t, root, least, r = unused(docs, "t", "root", "class", "r")
    found = link_classes(docs, doc_id=doc_id, text=text, **how).select(F.col("t").alias(t), F.col("root").alias(root), F.col("class_id").alias(least))
    rows = docs.withColumn(t, text_key(text_or_empty(text))).join(found, t).where(F.col(doc_id).cast("long").eqNullSafe(F.col(least)))
    first = Window.partitionBy(root).orderBy(t, *[F.col(c).cast("string") for c in docs.columns if c not in (doc_id, text)])
    return rows.withColumn(r, F.row_number().over(first)).where(F.col(r) == 1).select(*docs.columns)
