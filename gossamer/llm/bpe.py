"""Byte-level BPE encoding and decoding with a public tokenizer's vocabulary file.

Words of a chunk of texts are encoded together: the symbols of all words lie
in one flat array, and each round merges, in every word at once, the pair of
lowest rank, which is found by binary search over the sorted pair keys. Words
that are longer than LONG_WORD symbols would need a round for nearly every
rank, so they are merged with a heap instead, to the same ids.

Null text counts as empty. Empty text has no ids and decodes to empty text.
Rows are independent: repeated ids or texts each give their own row, and a
null doc_id stays null.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.llm._common import chunks, session, slices, text_or_empty, tidy

LONG_WORD = 4096
#: Words that a worker remembers; beyond it, it forgets all of them and starts anew.
CACHE_WORDS = 300_000
NONE = np.int32(2**31 - 1)
#: The public pre-tokenizer pattern; \s is written as the Unicode property, as Python's \s has four controls more.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Codec:
    """Encodes and decodes lists of texts; holds the vocabulary and a bounded memory of words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        vocab, letters = said["model"]["vocab"], byte_letters()
        of_letter = {c: b for b, c in enumerate(letters)}
        added = {x["content"]: x["id"] for x in said.get("added_tokens", [])}
        self.special = added
        self.special_at = regex.compile("|".join(regex.escape(x) for x in sorted(added, key=len, reverse=True))) if added else None
        self.words = regex.compile(PATTERN)
        self.of_byte = np.array([vocab[c] for c in letters], np.int32)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in said["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        keys = (left << 32) | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of = keys[order], order.astype(np.int32)
        size = max([*vocab.values(), *added.values()]) + 1
        as_bytes = [b""] * size
        for t, i in vocab.items():
            as_bytes[i] = bytes(of_letter[c] for c in t)
        for t, i in added.items():
            as_bytes[i] = t.encode()
        self.token_len = np.array([len(b) for b in as_bytes], np.int64)
        self.token_at = np.concatenate(([0], np.cumsum(self.token_len)))[:-1]
        self.pool = np.frombuffer(b"".join(as_bytes), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.code: dict[str, int] = {}
        self.ids = np.empty(0, np.int32)  # of all known words, one after the other
        self.ids_at = np.empty(0, np.int64)
        self.ids_len = np.empty(0, np.int64)
        self.ids_text: list[str] = []

    # -- merging

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair; NONE if it is never merged."""
        key = (a.astype(np.int64) << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], NONE)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and how many each word has."""
        long = [i for i, w in enumerate(words) if len(w) > LONG_WORD]
        flat, of = self.merge_rounds([b"" if len(w) > LONG_WORD else w for w in words] if long else words)
        sizes = np.bincount(of, minlength=len(words))
        if long:
            parts, at, ends = [], 0, np.cumsum(sizes)
            for i in long:
                parts += [flat[at : ends[i]], one := self.merge_long(words[i])]
                at, sizes[i] = ends[i], len(one)
            flat = np.concatenate([*parts, flat[at:]])
        return flat, sizes

    def merge_rounds(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        s = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        w = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        r = np.full(len(s), NONE, np.int32)
        if len(s) > 1:
            pair = np.flatnonzero(w[:-1] == w[1:])
            r[pair] = self.ranks(s[pair], s[pair + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(s):
            first = np.empty(len(w), bool)
            first[0] = True
            np.not_equal(w[1:], w[:-1], out=first[1:])
            starts = np.flatnonzero(first)
            least = np.minimum.reduceat(r, starts)
            lengths = np.diff(np.append(starts, len(s)))
            if (over := least == NONE).any():
                gone = np.repeat(over, lengths)
                done.append((s[gone], w[gone]))
                s, w, r = s[~gone], w[~gone], r[~gone]
                least, lengths = least[~over], lengths[~over]
                if not len(s):
                    break
            hit = r == np.repeat(least, lengths)
            at = np.flatnonzero(hit)
            # in a run of neighbouring hits (a pair of equal symbols) every other one merges, from the left
            new_run = np.empty(len(at), bool)
            new_run[0] = True
            np.greater(at[1:] - at[:-1], 1, out=new_run[1:])
            run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run_start) % 2 == 0]
            s[at] = self.made[r[at]]
            keep = np.ones(len(s), bool)
            keep[at + 1] = False
            to = np.cumsum(keep) - 1
            s, w, r, at = s[keep], w[keep], r[keep], to[at]
            again = np.zeros(len(s), bool)
            again[at] = True
            again[at[at > 0] - 1] = True
            r[again] = NONE
            stale = np.flatnonzero(again[:-1])
            stale = stale[w[stale] == w[stale + 1]]
            r[stale] = self.ranks(s[stale], s[stale + 1])
        flat = np.concatenate([x for x, _ in done]) if done else np.empty(0, np.int32)
        of = np.concatenate([x for _, x in done]) if done else np.empty(0, np.int32)
        order = np.argsort(of, kind="stable")
        return flat[order], of[order]

    def merge_long(self, word: bytes) -> np.ndarray:
        """One word, by a heap of (rank, place) over a linked list."""
        s = self.of_byte[np.frombuffer(word, np.uint8)].tolist()
        n = len(s)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.ranks(np.array(s[:-1], np.int32), np.array(s[1:], np.int32)).tolist()
        heap = [(r, i, s[i], s[i + 1]) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)
        table = {(int(k) >> 32, int(k) & 0xFFFFFFFF): int(r) for k, r in zip(self.keys, self.rank_of, strict=True)}
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if s[i] != a or j >= n or s[j] != b:
                continue
            s[i], s[j] = int(self.made[r]), -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (q := table.get((s[x], s[y]))) is not None:
                    heapq.heappush(heap, (q, x, s[x], s[y]))
        return np.array([x for x in s if x >= 0], np.int32)

    # -- texts

    def learn(self, words: set[str]) -> None:
        new = [x for x in words if x not in self.code]
        if len(self.code) + len(new) > CACHE_WORDS and self.code:
            self.forget()
            new = list(words)
        if new:
            flat, sizes = self.merge([x.encode("utf-8") for x in new])
            self.remember(new, flat, sizes)

    def remember(self, words: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        ends = np.cumsum(sizes)
        said, cut = list(map(str, flat.tolist())), [0, *ends.tolist()]
        self.code.update(zip(words, range(len(self.ids_text), len(self.ids_text) + len(words)), strict=True))
        self.ids_text.extend([",".join(said[a:b]) for a, b in zip(cut, cut[1:], strict=False)])
        self.ids_at = np.concatenate((self.ids_at, len(self.ids) + ends - sizes))
        self.ids_len = np.concatenate((self.ids_len, sizes))
        self.ids = np.concatenate((self.ids, flat))

    def parts(self, text: str) -> list[str]:
        """The words of a text, each special token's string as one of them."""
        if self.special_at is None or not self.special_at.search(text):
            return self.words.findall(text)
        out: list[str] = []
        at = 0
        for m in self.special_at.finditer(text):
            out += self.words.findall(text, at, m.start()) if m.start() > at else []
            out.append(m[0])
            at = m.end()
        return out + (self.words.findall(text, at) if at < len(text) else [])

    def codes(self, texts: list[str]) -> list[list[int]]:
        """For each text, the numbers of its words in what this codec remembers now."""
        split = [self.parts(t) for t in texts]
        known: set[str] = set()
        for x in split:
            known.update(x)
        self.learn(known - self.special.keys())
        if new := [t for t in self.special if t not in self.code]:
            self.remember(new, np.array([self.special[t] for t in new], np.int32), np.ones(len(new), np.int64))
        of = self.code.__getitem__
        return [list(map(of, x)) for x in split]

    def gather(self, codes: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each text has."""
        words = np.fromiter((k for x in codes for k in x), np.int64, sum(map(len, codes)))
        sizes = self.ids_len[words]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.ids[np.repeat(self.ids_at[words] - (ends - sizes), sizes) + np.arange(total)]
        upto = np.concatenate(([0], ends))[np.cumsum([0, *map(len, codes)])]
        return flat, np.diff(upto)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        flat, sizes = self.gather(self.codes(texts))
        return np.split(flat, np.cumsum(sizes)[:-1])

    def decode_bytes(self, flat: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The bytes of each run of ids; sizes: how many ids each run has."""
        lens = self.token_len[flat]
        ends = np.cumsum(lens)
        where = np.repeat(self.token_at[flat] - (ends - lens), lens) + np.arange(int(ends[-1]) if len(ends) else 0)
        whole = self.pool[where].tobytes()
        cut = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(sizes)))]
        return [whole[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]

    def decode(self, runs: list[np.ndarray]) -> list[str]:
        flat = np.concatenate(runs) if runs else np.empty(0, np.int32)
        if len(flat) and (flat.min() < 0 or flat.max() >= len(self.token_len)):
            raise ValueError("an id is not in the vocabulary")
        return [b.decode("utf-8", "replace") for b in self.decode_bytes(flat, np.array([len(x) for x in runs], np.int64))]


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """This process's codec for a vocabulary file."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(docs: DataFrame, path: str, *, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds (or replaces) the column ids: array<int>."""
    session(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            got = [x for part in chunks(batch.column(0)) for x in c.encode(part)]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.list_(pa.int32()))], names=["v"])

    return _with(docs, text_or_empty(text), run, "array<int>", ids)


def decode(docs: DataFrame, path: str, *, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds (or replaces) the column text: the ids' bytes as UTF-8, U+FFFD where they aren't. Null ids: empty text."""
    session(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            runs = [np.array(x or (), np.int32) for part in slices(batch.column(0)) for x in part.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(c.decode(runs), pa.string())], names=["v"])

    return _with(docs, F.col(ids).cast("array<int>"), run, "string", text)


def _with(docs: DataFrame, value, run, kind: str, name: str) -> DataFrame:
    """docs with one more column, made from value batch by batch."""
    udf = F.arrow_udf(tidy(lambda batches: (x.column(0) for x in run(pa.RecordBatch.from_arrays([b], names=["v"]) for b in batches))), kind, F.ArrowUDFType.SCALAR_ITER)
    return docs.withColumn(name, udf(value))


def digests(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and if asked for ids: a row for each row of docs, encoded and decoded in one pass."""
    session(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            n, ids_sha, text_sha, ids = [], [], [], []
            for part in chunks(batch.column(1)):
                got = c.codes(part)
                flat, sizes = c.gather(got)
                said = c.ids_text.__getitem__
                ids_sha += [hashlib.sha256(",".join(map(said, x)).encode()).hexdigest() for x in got]
                text_sha += [hashlib.sha256(b.decode("utf-8", "replace").encode()).hexdigest() for b in c.decode_bytes(flat, sizes)]
                n += sizes.tolist()
                ids.append(flat)
            out = {"doc_id": batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())}
            if with_ids:
                ends = np.cumsum([0, *n]).astype(np.int32)
                out["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *ids]).astype(np.int32)))
            yield pa.RecordBatch.from_pydict(out)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
