"""BPE, language identification, toxicity, licenses."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gossamer.llm import bpe, langid, licenses, queries, toxicity
from gossamer.llm._words import Memory

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"
CASES = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x"), (4, "word " * 40_000), (5, "\x00\n\t   ")]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.VOCABULARY)


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(queries.VOCABULARY)


PIECES = ["a", "the", " ", "  ", "\n", "\t", "'s", "'ll", "é", "ß", "漢", "😀", "1", "９", "\x1c", "\x85", "!!", "<|endoftext|>", "<|end", "\xa0", "ing", "’", "_"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=40).map("".join) | st.text(max_size=40))
def test_ids_and_round_trip_are_the_librarys(codec, library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    got = codec.encode([text])[0]
    assert got.tolist() == ids
    assert codec.decode([got]) == [library.decode(ids, skip_special_tokens=False)]


def test_any_ids_decode_like_the_library(codec, library):
    rng = random.Random(3)
    runs = [np.array([rng.randrange(50_257) for _ in range(6)], np.int32) for _ in range(300)]
    assert codec.decode(runs) == [library.decode(r.tolist(), skip_special_tokens=False) for r in runs]
    with pytest.raises(ValueError):
        codec.decode([np.array([50_257], np.int32)])


def test_long_words_merge_alike(codec, library, monkeypatch):
    words = ["a" * 9000, "ab" * 300, "".join(random.Random(1).choice("abcdefgh") for _ in range(3000))]
    ids = [library.encode(w, add_special_tokens=False).ids for w in words]
    assert [x.tolist() for x in codec.encode(words)] == ids
    monkeypatch.setattr(bpe, "LONG_WORD", 2)
    codec.forget()
    assert [x.tolist() for x in codec.encode(words)] == ids
    codec.forget()


def test_bpe_rows(spark, library):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in CASES], "doc_id long, text string, n_tokens string")
    got = bpe.digests(docs, queries.VOCABULARY, with_ids=True).collect()
    assert len(got) == len(CASES)
    want = sorted((str(i), library.encode(t or "", add_special_tokens=False).ids) for i, t in CASES)
    assert sorted((str(r["doc_id"]), r["ids"]) for r in got) == want
    assert all(r["ids_sha256"] == hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest() and r["n_tokens"] == len(r["ids"]) for r in got)
    both = bpe.decode(bpe.encode(docs, queries.VOCABULARY), queries.VOCABULARY)
    assert all(r["decoded"] == (r["text"] or "") and r["n_tokens"] == "clash" for r in both.collect())
    assert bpe.digests(docs.limit(0), queries.VOCABULARY).count() == 0


def test_profile_distance_by_hand():
    p = langid.Profiles(["x", "y"], np.array([1, 2, 3]), np.array([[0, 2], [1, 0], [3, 1]]), 3)
    assert p.distances(np.array([2, 9, 1])).tolist() == [1 + 3 + 2, 0 + 3 + 0]


def test_grams_of_words():
    flat, size = langid.grams(["ab", "1", "a-b"])
    said = [tuple(chr(x) for x in (g >> 42 & 0x1FFFFF, g >> 21 & 0x1FFFFF, g & 0x1FFFFF) if x) for g in flat.tolist()]
    assert size.tolist() == [7, 0, 8] and ("a",) in said and (" ", "a", "b") in said and ("a", "b", " ") in said


def test_languages_of_held_out_documents(spark):
    got = queries.op4_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in got)


def test_language_cases(spark):
    train = spark.createDataFrame([(1, "the cat and the hat", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "x", None), (1, "the cat and the hat", "en")], "doc_id long, text string, lang string")
    p = langid.fit(train)
    assert p.langs == ["de", "en"]
    docs = spark.createDataFrame([(i, t, "old") for i, t in CASES] + [(9, "die und der", "old"), (10, "12 !!", "old")], "doc_id long, text string, lang_pred string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs, p).collect()}
    assert got[1] == got[2] == got[5] == got[10] == ("und", 0.0) and got[9][0] == "de"
    none = langid.predict(docs, langid.fit(train.limit(0)))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}
    assert langid.predict(docs.limit(0), p).count() == 0


def test_word_bags():
    flat, size = toxicity.bag(["abc", "ABC".lower(), "!!", ""])
    assert size.tolist()[:2] == [3 + 2 + 1 + 1, 7] and size.tolist()[2:] == [0, 0] and (flat[:7] == flat[7:14]).all()


def test_toxicity_of_held_out_documents(spark):
    got = queries.op9_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").collect()
    hit = sum(r["predicted"] and r["toxic"] for r in got)
    assert hit >= 0.7 * sum(r["toxic"] for r in got) and hit >= 0.7 * sum(r["predicted"] for r in got)


def test_toxicity_cases(spark):
    rows = [(i, "you stupid fool" if i % 2 else "a fine good day", i % 2) for i in range(40)]
    known = spark.createDataFrame([*rows, (99, "x", None), (98, "y", 7), (None, "z", 1)], "doc_id long, text string, toxic int")
    model = toxicity.fit(known, known.select("doc_id", "toxic"))
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in CASES] + [(9, "stupidd fool", 1.0), (10, "fine day", 1.0)], "doc_id long, text string, score double")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert got[9] > 0.5 > got[10] and all(0 <= s <= 1 for s in got.values())
    one = toxicity.fit(known, known.where("doc_id % 2 = 0 and doc_id < 90"))
    assert max(r["score"] for r in toxicity.score(docs, one).collect()) < 0.01
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_forgetting_words_changes_nothing():
    split = [[f"w{k % 7}" for k in range(30)], [f"v{k}" for k in range(30)]]
    a, b = Memory(toxicity.bag, 10**6), Memory(toxicity.bag, 3)
    for x in split:
        for m in (a, b):
            m.got = m.values(m.codes([x])[0])
        assert all((p == q).all() for p, q in zip(a.got, b.got, strict=True))


def test_patience():
    assert licenses.ascending([3, 1, 2, 5, 4]) in ([1, 2, 3], [1, 2, 4])
    assert licenses.align("a b c d".split(), "x a b y d z".split()) == [(0, 1), (1, 2), (3, 4)]
    assert licenses.align([], ["a"]) == []


def by_every_stretch(text, template, least):
    """Whether a stretch placed by any word, not only by rare ones, reaches the coverage."""
    t, w = licenses.words(template), licenses.words(text)
    n = len(t)
    shifts = {q - p for q, x in enumerate(w) for p, y in enumerate(t) if x == y}
    return any(len(licenses.align(t, w[max(0, d - room) : max(0, d + n + room)])) >= least * n - 1e-9 for d in shifts for room in (0, n // 4, n))


def test_scan_finds_what_every_stretch_finds(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()[:60]
    rng = random.Random(2)
    mit = licenses.words(licenses.TEMPLATES["MIT"])
    texts = [r["text"] for r in docs] + [" ".join(w for w in mit if rng.random() > 0.1) for _ in range(4)] + ["noise " * 30 + "licensed, under the very Apache License; version 2.0 " * 2]
    rows = list(enumerate(texts))
    got = {(r["doc_id"], r["license"]) for r in licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    short = [(i, t) for i, t in rows if len(licenses.words(t)) < 600]
    want = {(i, name) for i, t in short for name, x in licenses.TEMPLATES.items() if by_every_stretch(t, x, licenses.LEAST)}
    assert want == {(i, n) for i, n in got if i in dict(short)} and (64, "Apache-2.0") in got
    assert sum(n == "MIT" for _, n in got) == 4


def test_scan_cases(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in CASES] + [(None, "ALL rights\nreserved", "clash")] * 2, "doc_id long, text string, license string")
    assert [tuple(r) for r in licenses.scan(docs).collect()] == [(None, "all-rights-reserved", 1.0, 3, 0, 2)] * 2
    assert licenses.scan(docs.limit(0)).count() == 0
    assert licenses.scan(docs.where(F.col("doc_id") == 3), templates={"x": "a b", "empty": "!"}).count() == 2


def found(spark, texts):
    got = [set() for _ in texts]
    for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect():
        got[r["doc_id"]].add(r["license"])
    return got


def test_siblings_are_told_apart(spark):
    gnu = "This work is licensed under the GNU {} License, version {}"
    other = ["Licensed under CC BY 4.0", "Licensed under CC BY-SA 4.0", "Licensed under CC BY-NC-SA 4.0", "Licensed under CC BY-NC 3.0", gnu.format("General Public", "2"), gnu.format("Lesser General Public", "3"), gnu.format("Library General Public", "3"), gnu.format("General Public", "2, see section 3"), "Licensed under the Eclipse License, Version 2.0"]
    for t, got in zip(other, found(spark, [f"before {t} after it" for t in other]), strict=True):
        assert not got & {"CC-BY-NC-4.0", "GPL-3.0", "Apache-2.0"}, t
    own = [gnu.format("General Public", "3"), "Licensed under CC BY-NC 4.0", "It is licensed, under the Apache License; version 2.0", f"{gnu.format('General Public', '2')}. {gnu.format('General Public', '3')}"]
    for name, got in zip(["GPL-3.0", "CC-BY-NC-4.0", "Apache-2.0", "GPL-3.0"], found(spark, own), strict=True):
        assert name in got


def test_common_licenses_are_found(spark):
    free = "This {} is free software: you can redistribute it and/or modify it under the terms of the GNU {} License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
    bsd = licenses._BSD_2 + "{}" + licenses._DISCLAIMER
    want = [
        ("Released under the MIT License.", "MIT-notice"), ("This project is licensed under the terms of the MIT license", "MIT-notice"), ("SPDX-License-Identifier: MIT", "MIT-spdx"),
        ("Licensed under the GNU General Public License, version 2", "GPL-2.0"), ("Distributed under GPLv3", "GPL-3.0"), ("under the GNU Lesser General Public License v. 2.1", "LGPL-2.1"),
        (free.format("program", "General Public", "3"), "GPL-3.0-header"), (free.format("program", "General Public", "2"), "GPL-2.0-header"), (free.format("library", "Lesser General Public", "2.1"), "LGPL-2.1-header"), (free.format("program", "Affero General Public", "3"), "AGPL-3.0-header"),
        ("Licensed under CC BY 4.0", "CC-BY-4.0"), ("licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0"), ("Licensed under CC BY-NC 4.0", "CC-BY-NC-4.0"),
        (bsd.format(""), "BSD-2-Clause-text"), (bsd.format(licenses._BSD_3), "BSD-3-Clause-text"), ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "MPL-2.0-header"), ("SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0-or-later-spdx"),
        ("Released under the 3-Clause BSD License", "BSD-3-Clause"), ("Licensed under the Eclipse Public License 2.0", "EPL-2.0"),
    ]
    told = ("GPL", "LGPL", "AGPL", "CC-", "BSD-", "MPL", "EPL")
    for (text, name), got in zip(want, found(spark, [f"word {t} word" for t, _ in want]), strict=True):
        assert name in got, (text, got)
        if name.endswith(("-header", "-text")) or name.startswith("CC"):
            own = name.removesuffix("-header").removesuffix("-text")
            assert all(x.startswith(own) for x in got if x.startswith(told)), (text, got)


def test_scores_equal_a_plain_version():
    """The mean over distinct words of the means over their n-grams, one by one."""
    rng = np.random.default_rng(4)
    model = toxicity.Model(rng.normal(size=toxicity.BUCKETS), -0.4)
    mask = 2**64 - 1

    def buckets(word):
        import pandas as pd

        bare = word.strip(toxicity._ENDS)
        if not bare:
            return []
        marked, out = f"<{bare}>".encode(), []
        for n in (3, 4, 5):
            for i in range(len(marked) - n + 1):
                h = n
                for b in marked[i : i + n]:
                    h = ((h ^ b) * int(toxicity._MIX)) & mask
                    h ^= h >> 29
                out.append(h >> 48)
        return [*out, int(pd.util.hash_array(np.array([bare], object), categorize=False)[0]) >> 48]

    texts = ["You stupid, STUPID fool!", "", "a b a", "!!", "größe x " * 50]
    want = []
    for t in texts:
        means = [np.mean([model.bucket[b] for b in own]) for w in set(t.lower().split()) if (own := buckets(w))]
        want.append(1 / (1 + np.exp(-(np.mean(means) if means else 0.0) - model.bias)))
    assert np.allclose(model.scores(texts, Memory(model.word_logits)), want, rtol=1e-9)
