"""Suffix-array removal of byte strings that repeat across documents.

Each byte is removed that lies in a string of LENGTH bytes which also starts
in a document of smaller id. Strings are judged on the input.

A suffix array of all suffixes would move many times the corpus, so it is
sparse. A window of LENGTH bytes is represented by the suffix at its anchor:
the leftmost place of the least hash among its GRAM-byte strings. Equal
windows have equal anchors, so windows that repeat meet in the same place, and
only one suffix in about eighteen is looked at.

1. Texts are packed into compressed pieces in the shared folder, with their anchors.
2. Shared grams: each piece sends its distinct anchor grams (truncated hashes)
   to hash buckets, which answer with a bit for each: other documents have it.
   A false bit costs time only.
3. Suffixes whose leading gram is shared are range-partitioned by their leading
   bytes, with splitters sampled from the shared suffixes of LOOKED pieces. A
   bucket sorts its suffixes by multikey quicksort (eight bytes are a
   character), takes the common prefix of neighbours, sorts the bytes before
   the anchors, read backwards, in the same way, and so has, for each place of
   a window around the anchor, the classes of equal windows and the smallest
   document of each. Bytes decide, not hashes. A gram that a splitter starts
   with may lie on both sides of that boundary; its windows are compared across
   buckets, byte by byte in hash buckets.
4. The answers, a bit for each window, go back to the pieces, which cut.

Equal contexts of a piece are sent once, so a gram that a third of all
documents share gives a bucket at most an entry for each piece and context.
Nothing is broadcast but the splitters, of which LOOKED x SAMPLES / 8 is the
most; a range that is larger than a bucket by then is cut by a hash of the
leading gram, which equal windows share.

Null text counts as empty; a null id is smaller than any other; documents of
equal id are not smaller than each other. A repeated row is a row of its own.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.llm._common import partitions, session, slices, text_or_empty, tidy, written

LENGTH, GRAM = 50, 16
SPAN = LENGTH - GRAM + 1  # gram places in a window
LEFT, ROW = SPAN - 1, SPAN - 1 + LENGTH
PIECE_BYTES, BUCKET_BYTES = 6_000_000, 16_000_000
SEGMENT = 1 << 20  # windows looked at together
LOOKED, SAMPLES = 64, 256  # pieces whose suffixes are sampled, and how many of each
SMALL = 2048  # suffixes that are sorted by whole characters at once
NO_ID = -(2**63)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def gram_hashes(b: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each GRAM bytes in a row, or of those that start at some places."""
    if len(b) < GRAM:
        return np.empty(0, np.uint64)
    w = np.ndarray(len(b) - 7, "<u8", np.ascontiguousarray(b).data, strides=(1,))  # the eight bytes from each place on
    first, second = (w[: len(b) - GRAM + 1], w[8:]) if at is None else (w[at], w[at + 8])
    h = first * _M1
    h ^= h >> np.uint64(29)
    h += second
    h *= _M2
    h ^= h >> np.uint64(32)
    h *= _M1
    return h ^ (h >> np.uint64(31))


def least_of(a: np.ndarray, w: int) -> np.ndarray:
    n = 1
    while n * 2 <= w:
        a = np.minimum(a[:-n], a[n:])
        n *= 2
    return np.minimum(a[: -(w - n)], a[w - n :]) if n < w else a


def anchors(b: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts one after the other: anchor places, ascending, and the nearest and farthest start (as a distance to the left) of the windows that each stands for."""
    doc = np.repeat(np.arange(len(ends)), np.diff(np.concatenate(([0], ends))))
    found = []
    for at in range(0, max(0, len(b) - LENGTH + 1), SEGMENT):
        part = b[at : at + SEGMENT + LENGTH - 1]
        h = gram_hashes(part)
        place = np.arange(len(h), dtype=np.uint64)
        least = least_of(((h >> np.uint64(24)) << np.uint64(24)) | place, SPAN)
        starts = np.flatnonzero(doc[at : at + len(least)] == doc[at + LENGTH - 1 : at + LENGTH - 1 + len(least)])
        if not len(starts):
            continue
        p = (least[starts] & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))
        last = np.append(first[1:], len(p)) - 1
        found.append((p[first] + at, p[first] - starts[last], p[first] - starts[first]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))  # type: ignore[return-value]


def contexts(b: np.ndarray, p: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """The bytes that the anchors' windows cover, a row each: LEFT columns before the anchor, LENGTH from it on, zero where no window reaches."""
    padded = np.concatenate((np.zeros(LEFT, np.uint8), b, np.zeros(LENGTH, np.uint8)))
    rows = np.lib.stride_tricks.sliding_window_view(padded, ROW)[p].copy()
    col = np.arange(ROW)
    rows[(col < (LEFT - far)[:, None]) | (col >= (LEFT + LENGTH - near)[:, None])] = 0
    return rows


def row_hashes(rows: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    h = np.zeros(len(rows), np.uint64)
    for w in wide.view(np.uint64).T:
        h = (h ^ w) * _M1
        h ^= h >> np.uint64(32)
    return h


def characters(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of eight-byte characters that sort alike."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    return wide.view(">u8").astype(np.uint64)


def multikey_sort(rows: np.ndarray) -> np.ndarray:
    """The order of rows by their bytes, by multikey quicksort.

    A range of rows that agree before a character is parted into those below,
    at and above a pivot there; those at it go on with the next character.
    Ranges of SMALL rows at most are sorted together in the end.
    """
    chars = characters(rows)
    order, todo, small = np.arange(len(rows)), [(0, len(rows), 0)], []
    while todo:
        lo, hi, k = todo.pop()
        if k == chars.shape[1] or hi - lo < 2:
            continue
        if hi - lo <= SMALL:
            small.append((lo, hi))
            continue
        own = order[lo:hi]
        c = chars[own, k]
        some = np.sort(c[:: max(1, len(c) // 63)])
        pivot = some[len(some) // 2]
        below, above = c < pivot, c > pivot
        parts = own[below], own[~(below | above)], own[above]
        order[lo:hi] = np.concatenate(parts)
        first, last = lo + len(parts[0]), hi - len(parts[2])
        todo += [(lo, first, k), (first, last, k + 1), (last, hi, k)]
    if small:
        _sort_ranges(chars, order, sorted(small))
    return order


def _sort_ranges(chars: np.ndarray, order: np.ndarray, ranges: list[tuple[int, int]]) -> None:
    """Sorts each range of order, one character after the other: only ties go on to the next."""
    lo, hi = np.array(ranges).T
    group = np.repeat(np.arange(len(lo)), hi - lo)
    at = np.arange(len(group)) + np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo)
    for k in range(chars.shape[1]):
        own = order[at]
        c = chars[own, k]
        turn = np.lexsort((c, group))
        order[at] = own[turn]
        c = c[turn]
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (c[1:] != c[:-1])))
        tied = ~new
        tied[:-1] |= ~new[1:]
        if not tied.any():
            return
        at, group = at[tied], np.cumsum(new)[tied]


def common(rows: np.ndarray) -> np.ndarray:
    """How many leading bytes each row shares with the one before; 0 for the first."""
    differs = rows[1:] != rows[:-1]
    return np.concatenate(([0], np.where(differs.any(axis=1), differs.argmax(axis=1), rows.shape[1])))[: len(rows)]


def smaller_elsewhere(rows: np.ndarray, near: np.ndarray, far: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each suffix a mask: bit k, if the window that starts k bytes before the anchor occurs in a smaller document."""
    order = multikey_sort(rows[:, LEFT:])
    rows, near, far, doc = rows[order], near[order], far[order], doc[order]
    lcp = common(rows[:, LEFT:])
    before = np.ascontiguousarray(rows[:, :LEFT][:, ::-1])
    by_left = multikey_sort(before)
    left_lcp, left = common(before[by_left]), np.empty(len(rows), np.int64)
    mask = np.zeros(len(rows), np.uint64)
    for k in range(SPAN):
        at = np.flatnonzero((near <= k) & (k <= far))
        if len(at) < 2:
            continue
        left[by_left] = np.cumsum(left_lcp < k)
        key = np.cumsum(lcp < LENGTH - k)[at] * (len(rows) + 1) + left[at]
        mask[at] |= _beyond_least(key, doc[at]) << np.uint64(k)
    out = np.empty(len(rows), np.uint64)
    out[order] = mask
    return out


def _beyond_least(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """1 where the same key has a smaller document."""
    order = np.argsort(key, kind="stable")
    s = key[order]
    first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    least = np.minimum.reduceat(doc[order], first)
    out = np.empty(len(key), np.uint64)
    out[order] = doc[order] > np.repeat(least, np.diff(np.append(first, len(s))))
    return out


def pack(x: bytes) -> bytes:
    return zstandard.compress(x, 3)


def unpack(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(x), kind)


class Piece:
    """Some whole texts and what of them is compared."""

    def __init__(self, ids: np.ndarray, ends: np.ndarray, data: np.ndarray, held: np.ndarray):
        self.ids, self.ends, self.data = ids, ends, data
        n = len(held) // 6
        self.p = np.cumsum(held[: 4 * n].view(np.uint32), dtype=np.int64)
        self.near, self.far = held[4 * n : 5 * n].astype(np.int64), held[5 * n :].astype(np.int64)
        self.gram = gram_hashes(data, self.p)
        self.doc = np.searchsorted(ends, self.p, side="right")
        self.grams, self.of = np.unique(self.gram, return_inverse=True)

    def many(self) -> np.ndarray:
        """Which grams two documents of this piece have."""
        if not len(self.grams):
            return np.empty(0, bool)
        order = np.argsort(self.of, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], np.diff(self.of[order]) > 0)))
        d = self.ids[self.doc[order]]
        return np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)

    def cuts(self, buckets: int) -> np.ndarray:
        """Where the sorted grams' buckets begin and end."""
        b = ((self.grams >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        return np.searchsorted(b, np.arange(buckets + 1, dtype=np.uint64))

    def suffixes(self, shared: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of anchors with a shared gram: their numbers; then the distinct contexts (rows, near, far, smallest id, gram) and which each anchor has."""
        at = np.flatnonzero(shared[self.of]) if len(self.p) else np.empty(0, np.int64)
        rows = contexts(self.data, self.p[at], self.near[at], self.far[at])
        whole = np.concatenate((rows, self.near[at, None].astype(np.uint8), self.far[at, None].astype(np.uint8)), axis=1)
        _, first, of = np.unique(row_hashes(whole), return_index=True, return_inverse=True)
        if (whole != whole[first][of]).any():  # two contexts of one hash
            _, first, of = np.unique(whole, axis=0, return_index=True, return_inverse=True)
        least = np.full(len(first), 2**63 - 1, np.int64)
        np.minimum.at(least, of, self.ids[self.doc[at]])
        return at, rows[first], self.near[at][first], self.far[at][first], least, self.gram[at][first], of

    def windows(self, rows: np.ndarray, near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All windows of contexts: context, place and bytes."""
        of = np.repeat(np.arange(len(rows)), far - near + 1)
        k = np.arange(len(of)) - np.repeat(np.cumsum(far - near + 1) - (far - near + 1), far - near + 1) + np.repeat(near, far - near + 1)
        return of, k, np.lib.stride_tricks.sliding_window_view(rows, LENGTH, axis=1)[of, LEFT - k] if len(of) else np.empty((0, LENGTH), np.uint8)


def pieces(rows: Iterator[pa.RecordBatch], piece_bytes: int) -> Iterator[pa.RecordBatch]:
    ids, texts, size = [], [], 0

    def one() -> pa.RecordBatch:
        ends = np.cumsum(np.array([len(t) for t in texts], np.int64))
        data = np.frombuffer(b"".join(texts), np.uint8)
        p, near, far = anchors(data, ends)
        held = np.diff(p, prepend=0).astype(np.uint32).tobytes() + near.astype(np.uint8).tobytes() + far.astype(np.uint8).tobytes()
        return pa.RecordBatch.from_pydict({"size": [len(data)], "ids": [pack(np.array(ids, np.int64).tobytes())], "ends": [pack(ends.tobytes())], "data": [pack(data.tobytes())], "anchors": [pack(held)]})

    for part in (x for batch in rows for x in slices(batch)):
        for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            ids.append(NO_ID if i is None else i)
            texts.append((t or "").encode())
            size += len(texts[-1])
            if size >= piece_bytes or len(ids) >= 100_000:
                yield one()
                ids, texts, size = [], [], 0
    if ids:
        yield one()


PIECE = "size long, ids binary, ends binary, data binary, anchors binary"
HELD = ["piece", "ids", "ends", "data", "anchors"]


def opened(row: dict) -> Piece:
    return Piece(unpack(row["ids"], np.int64), unpack(row["ends"], np.int64), unpack(row["data"], np.uint8), unpack(row["anchors"], np.uint8))


def shared_bits(piece: Piece, answers: list[dict], buckets: int) -> np.ndarray:
    """Which of a piece's grams other documents have; an answer counts the piece's own documents too."""
    cuts, out = piece.cuts(buckets), np.zeros(len(piece.grams), bool)
    for a in answers or ():
        lo, hi = cuts[a["bucket"]], cuts[a["bucket"] + 1]
        out[lo:hi] = np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=hi - lo).astype(bool)
    return out


def splitters_of(looked: list, n: int, bucket_bytes: int, least: int) -> tuple[np.ndarray, int]:
    """The splitters, and by how many hashes of the leading gram each range between them is cut.

    looked: for some of the n pieces, how many suffixes it has and a sample of them.
    """
    total = sum(r["n"] for r in looked) * n / max(1, len(looked))
    buckets = max(1, math.ceil(total * (ROW + 10) / bucket_bytes), least)
    parts = [np.frombuffer(r["sample"], f"S{LENGTH}") for r in looked if r["n"]]
    if not parts:
        return np.empty(0, f"S{LENGTH}"), buckets
    sample, weight = np.concatenate(parts), np.concatenate([np.full(len(x), r["n"] / len(x)) for x, r in zip(parts, (r for r in looked if r["n"]), strict=True)])
    ranges = max(1, min(buckets, len(sample) // 8))
    order = np.argsort(sample, kind="stable")
    upto = np.cumsum(weight[order])
    cut = np.searchsorted(upto, upto[-1] * np.arange(1, ranges) / ranges)
    return np.unique(sample[order][np.minimum(cut, len(sample) - 1)]), -(-buckets // ranges)


class Routes:
    """Where a piece's suffixes go: bucket (-1 for grams at a boundary), and those grams' windows with their buckets."""

    def __init__(self, piece: Piece, shared: np.ndarray, splitters: np.ndarray, cut: int):
        self.at, self.rows, self.near, self.far, self.least, gram, self.of = piece.suffixes(shared)
        suffix = np.ascontiguousarray(self.rows[:, LEFT:]).view(f"S{LENGTH}").ravel() if len(self.rows) else np.empty(0, f"S{LENGTH}")
        buckets = (len(splitters) + 1) * cut
        bucket = np.searchsorted(splitters, suffix, side="right") * cut + ((gram >> np.uint64(20)) % np.uint64(cut)).astype(np.int64)
        edge = np.isin(suffix.astype(f"S{GRAM}"), np.unique(splitters.astype(f"S{GRAM}")))
        of, self.w_k, self.w_bytes = piece.windows(self.rows[edge], self.near[edge], self.far[edge])
        self.w_of = np.flatnonzero(edge)[of]
        self.w_bucket = ((row_hashes(self.w_bytes) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64) + buckets
        self.bucket = np.where(edge, -1, bucket)

    @staticmethod
    def runs(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each bucket from 0 on, and which have it, in their order."""
        order = np.argsort(bucket, kind="stable")
        found, first = np.unique(bucket[order], return_index=True)
        for b, i, j in zip(found.tolist(), first.tolist(), [*first[1:].tolist(), len(order)], strict=False):
            if b >= 0:
                yield b, order[i:j]


def covered(n: int, starts: np.ndarray) -> np.ndarray:
    """Which of n bytes lie in a window that starts at one of these places."""
    hit = np.zeros(n + LENGTH, np.int32)
    hit[starts + LENGTH - 1] = 1
    so_far = np.concatenate(([0], np.cumsum(hit, dtype=np.int32)))
    return so_far[LENGTH : LENGTH + n] > so_far[:n]


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", keep_text: bool = False, piece_bytes: int = PIECE_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with keep_text the remaining bytes as kept (binary)."""
    spark = session(docs)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    held = written(rows.mapInArrow(tidy(lambda x: pieces(x, piece_bytes)), PIECE).withColumn("piece", F.monotonically_increasing_id()), "pieces")
    n, size = held.agg(F.count("*"), F.sum("size")).first()
    least = min(n or 1, partitions(spark))
    hashed = max(1, -(-(size or 0) // bucket_bytes), least)

    def ask_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each_row(batches):
            piece = opened(row)
            cuts, many = piece.cuts(hashed), piece.many()
            low = (piece.grams & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            has = np.flatnonzero(np.diff(cuts))
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(has.tolist(), pa.int32()), "piece": pa.array([row["piece"]] * len(has), pa.int64()), "grams": pa.array([low[cuts[b] : cuts[b + 1]].tobytes() for b in has], pa.binary()), "many": pa.array([np.packbits(many[cuts[b] : cuts[b + 1]]).tobytes() for b in has], pa.binary())})

    def answer_grams(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint32) for x in table["grams"].to_pylist()]
        many = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(p)) for x, p in zip(table["many"].to_pylist(), parts, strict=True)])
        flat = np.concatenate(parts)
        order = np.argsort(flat, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], flat[order][1:] != flat[order][:-1])))
        n = np.diff(np.append(first, len(flat)))
        hit = (n > 1) | (np.maximum.reduceat(many[order], first) > 0)
        out = np.empty(len(flat), bool)
        out[order] = np.repeat(hit, n)
        return pa.table({"bucket": table["bucket"], "piece": table["piece"], "bits": pa.array([np.packbits(x).tobytes() for x in np.split(out, np.cumsum([len(p) for p in parts])[:-1])], pa.binary())})

    asked = held.select(*HELD).mapInArrow(tidy(ask_grams), "bucket int, piece long, grams binary, many binary")
    bits = written(asked.groupBy("bucket").applyInArrow(answer_grams, "bucket int, piece long, bits binary").groupBy("piece").agg(F.collect_list(F.struct("bucket", "bits")).alias("answers")), "shared-grams")
    known = held.select(*HELD).join(bits, "piece", "left")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each_row(batches):
            piece = opened(row)
            suffixes = np.ascontiguousarray(piece.suffixes(shared_bits(piece, row["answers"], hashed))[1][:, LEFT:])
            some = suffixes[np.arange(min(len(suffixes), SAMPLES)) * len(suffixes) // SAMPLES if len(suffixes) > SAMPLES else slice(None)]
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(suffixes)], pa.int64()), "sample": pa.array([some.tobytes()], pa.binary())})

    some = known.where(F.pmod(F.xxhash64("piece"), F.lit(-(-(n or 1) // LOOKED))) == 0)
    splitters, cut = splitters_of(some.mapInArrow(tidy(look), "n long, sample binary").collect(), n or 1, bucket_bytes, least)
    buckets = (len(splitters) + 1) * cut

    def ask_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each_row(batches):
            piece = opened(row)
            to = Routes(piece, shared_bits(piece, row["answers"], hashed), splitters, cut)
            at_bucket, entries = [], []
            for b, at in to.runs(to.bucket):
                entry = np.concatenate((to.rows[at], to.near[at, None].astype(np.uint8), to.far[at, None].astype(np.uint8)), axis=1)
                at_bucket.append(b)
                entries.append(pack(to.least[at].tobytes() + entry.tobytes()))
            for b, at in to.runs(to.w_bucket):
                at_bucket.append(b)
                entries.append(pack(to.least[to.w_of[at]].tobytes() + to.w_bytes[at].tobytes()))
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(at_bucket, pa.int32()), "piece": pa.array([row["piece"]] * len(at_bucket), pa.int64()), "entries": pa.array(entries, pa.binary())})

    def answer_windows(table: pa.Table) -> pa.Table:
        edge = table["bucket"][0].as_py() >= buckets
        width = LENGTH if edge else ROW + 2
        parts = [zstandard.decompress(x) for x in table["entries"].to_pylist()]
        sizes = [len(x) // (width + 8) for x in parts]
        doc = np.concatenate([np.frombuffer(x, np.int64, n) for x, n in zip(parts, sizes, strict=True)])
        e = np.concatenate([np.frombuffer(x, np.uint8, offset=8 * n).reshape(-1, width) for x, n in zip(parts, sizes, strict=True)])
        del parts
        if edge:
            order = multikey_sort(e)
            number = np.empty(len(e), np.int64)
            number[order] = np.cumsum(common(e[order]) < LENGTH)
            cuts = [np.packbits(x.astype(bool)).tobytes() for x in np.split(_beyond_least(number, doc), np.cumsum(sizes)[:-1])]
        else:
            got = smaller_elsewhere(e[:, :ROW], e[:, ROW].astype(np.int64), e[:, ROW + 1].astype(np.int64), doc)
            cuts = [pack(x.tobytes()) for x in np.split(got, np.cumsum(sizes)[:-1])]
        return pa.table({"bucket": table["bucket"], "piece": table["piece"], "masks": pa.array(cuts, pa.binary())})

    windows = known.mapInArrow(tidy(ask_windows), "bucket int, piece long, entries binary")
    masks = written(windows.groupBy("bucket").applyInArrow(answer_windows, "bucket int, piece long, masks binary").groupBy("piece").agg(F.collect_list(F.struct("bucket", "masks")).alias("masks")), "repeats")

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each_row(batches):
            piece = opened(row)
            to = Routes(piece, shared_bits(piece, row["answers"], hashed), splitters, cut)
            answers = {a["bucket"]: a["masks"] for a in row["masks"] or ()}
            mask = np.zeros(len(to.rows), np.uint64)
            for b, at in to.runs(to.bucket):
                mask[at] = unpack(answers[b], np.uint64)
            for b, at in to.runs(to.w_bucket):
                hit = at[np.unpackbits(np.frombuffer(answers[b], np.uint8), count=len(at)).astype(bool)]
                np.bitwise_or.at(mask, to.w_of[hit], np.uint64(1) << to.w_k[hit].astype(np.uint64))
            whole = ((np.uint64(1) << (to.far + 1).astype(np.uint64)) - np.uint64(1)) & ~((np.uint64(1) << to.near.astype(np.uint64)) - np.uint64(1))
            own = np.where(piece.ids[piece.doc[to.at]] > to.least[to.of], whole[to.of], mask[to.of]) if len(to.at) else np.empty(0, np.uint64)
            p = piece.p[to.at]
            gone = covered(len(piece.data), np.concatenate([p[(own >> np.uint64(k)) & np.uint64(1) == 1] - k for k in range(SPAN)]))
            yield cut_texts(piece, gone, keep_text)

    return known.join(masks, "piece", "left").mapInArrow(tidy(removed), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text)


def each_row(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One at a time: a piece's binary columns are large."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def cut_texts(piece: Piece, gone: np.ndarray, keep_text: bool) -> pa.RecordBatch:
    starts = np.concatenate(([0], piece.ends))
    first = gone & ~np.concatenate(([False], gone[:-1])) if len(gone) else gone
    head = starts[:-1][(starts[:-1] < len(gone)) & (np.diff(starts) > 0)]
    first[head] |= gone[head]
    so_far, spans = (np.concatenate(([0], np.cumsum(x, dtype=np.int32))) for x in (gone, first))
    left = [piece.data[a:b][~gone[a:b]].tobytes() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
    out = {"doc_id": pa.array([None if i == NO_ID else i for i in piece.ids.tolist()], pa.int64()), "n_bytes": pa.array(np.diff(starts)), "n_removed": pa.array(np.diff(so_far[starts]).astype(np.int64)), "n_spans": pa.array(np.diff(spans[starts]).astype(np.int64)), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in left])}
    return pa.RecordBatch.from_pydict(out | ({"kept": pa.array(left, pa.binary())} if keep_text else {}))


#: Windows are told by the 128 bits of their MD5, as all windows of LENGTH bytes beside each other are too much to sort.
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, {NO_ID + 1}) AS o, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT r, o, unnest(range(0, length(x) // 2 - {LENGTH - 1})) AS i, x FROM d WHERE length(x) >= {2 * LENGTH}),
h AS MATERIALIZED (SELECT r, o, i, md5_number(substr(x, 2 * i + 1, {2 * LENGTH})) AS w FROM p),
f AS (SELECT w, min(o) AS least FROM h GROUP BY w HAVING min(o) < max(o)),
c AS (SELECT r, i, i + {LENGTH} AS j FROM h JOIN f USING (w) WHERE o > least),
s AS (SELECT r, i, j, CASE WHEN i <= lag(j) OVER (PARTITION BY r ORDER BY i) THEN 0 ELSE 1 END AS new FROM c),
g AS (SELECT r, i, j, sum(new) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM s),
u AS (SELECT r, run, min(i) AS i, max(j) AS j FROM g GROUP BY r, run),
k AS (SELECT r, i, j, coalesce(lag(j) OVER (PARTITION BY r ORDER BY i), 0) AS prev FROM u),
t AS (SELECT k.r, sum(j - i)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans, string_agg(substr(x, 2 * prev + 1, 2 * (i - prev)), '' ORDER BY i) || substr(any_value(x), 2 * max(j) + 1) AS kept FROM k JOIN d ON d.r = k.r GROUP BY k.r)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM d LEFT JOIN t USING (r)
"""
