"""Line dedup, Jaccard join, substrings, fingerprints."""

import random

import duckdb
import numpy as np
import pytest

from gossamer.llm import fingerprint, jaccard, lines, queries, substrings
from gossamer.llm._components import components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def duck(spark, sql, docs):
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    said = con.execute(sql)
    return [d[0] for d in said.description], sorted((tuple(r) for r in said.fetchall()), key=str)


def collected(df, names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


# -- lines


def line_docs():
    rng = random.Random(4)
    pool = [f"line {k}" for k in range(6)] + ["", " line 1 "]
    rows = [(k, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 14)))) for k in range(60)]
    return [*rows, (3, "line 1\nline 2\nline 3\nline 4"), (None, "line 1\nline 2\nline 3"), (None, None), (70, None), (71, ""), (72, "x\n" * 3000)]


@pytest.mark.parametrize("gram, window", [(2, 2), (1, 1), (1, 3), (3, 2)])
def test_lines_equal_sql_over_all_runs(spark, gram, window):
    docs = spark.createDataFrame(line_docs(), DOCS)
    sql = f"WITH {lines.oracle_sql('documents', gram, window)} SELECT doc_id, kept, n_lines::BIGINT AS n_lines, n_removed::BIGINT AS n_removed FROM documents_kept"
    names, want = duck(spark, sql, docs)
    got = lines.remove_lines(docs, gram=gram, window=window, report=True)
    assert collected(got.withColumnRenamed("text", "kept"), names) == want


def test_equal_runs_share_a_fingerprint():
    rng = random.Random(8)
    run = [f"r{k}" for k in range(lines.RUN)]
    for _ in range(50):
        a = [f"a{rng.random()}" for _ in range(rng.randint(0, 4))] + run + [f"a{rng.random()}" for _ in range(rng.randint(0, 4))]
        b = [f"b{rng.random()}" for _ in range(rng.randint(0, 4))] + run + [f"b{rng.random()}" for _ in range(rng.randint(0, 4))]
        assert set(lines.fingerprints(a)[1]) & set(lines.fingerprints(b)[1])


def test_line_cases(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc\nd", 7, "x"), (2, "z\na\nb\nc", 8, "y"), (2, "z\na\nb\nc", 8, "y")], "doc_id long, text string, gone long, n_lines string")
    got = lines.remove_lines(docs)
    assert got.columns == docs.columns and collected(got, ["doc_id", "text", "gone", "n_lines"]) == [(1, "a\nb\nc\nd", 7, "x"), (2, "z", 8, "y"), (2, "z", 8, "y")]
    assert lines.remove_lines(docs.limit(0)).count() == 0


# -- components and the Jaccard join


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(501, 600)] + [(7, 7)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingle_sets(rows):
    out = []
    for i, t in rows:
        w = (t or "").split()
        out.append((i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []), t or ""))
    return out


def brute_classes(rows, threshold=0.8):
    s = shingle_sets(rows)
    root, links = list(range(len(s))), [0] * len(s)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(s)):
        for b in range(a + 1, len(s)):
            inter = len(s[a][1] & s[b][1])
            union = len(s[a][1] | s[b][1])
            if s[a][2] == s[b][2] or (union and inter >= threshold * union - 1e-9):
                links[a], links[b] = links[a] + 1, links[b] + 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    ids = {}
    for k in range(len(s)):
        ids.setdefault(find(k), []).append(s[k][0])
    least = {k: min((i for i in v if i is not None), default=None) for k, v in ids.items()}
    return sorted(((s[k][0], least[find(k)], links[k]) for k in range(len(s))), key=str)


def near_rows(n_groups=12, seed=3):
    """Groups of copies with single words changed, so that similarities lie on both sides of the threshold."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n_groups):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([4, 12, 60, 200]))]
        for _ in range(rng.randint(1, 8)):
            x = list(base)
            for _ in range(rng.randint(0, 4)):
                x[rng.randrange(len(x))] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(x)))
    return rows


def test_classes_and_links_equal_brute_force(spark):
    rows = [*near_rows(), (900, None), (901, ""), (902, " \n"), (None, "only one without an id here"), (805, "one two three"), (806, "one two three"), (806, "one two three")]
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, t string")
    got = collected(jaccard.near_duplicates(docs), ["doc_id", "class_id", "n_links"])
    assert got == brute_classes(rows)
    kept = jaccard.one_of_each(docs).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == sorted({str(c) for _, c, _ in got}) and jaccard.one_of_each(docs).columns == docs.columns
    assert jaccard.near_duplicates(docs.limit(0)).count() == 0


def test_recall_over_the_table(spark):
    """Links found over whole documents against all pairs: 0.95 of them at least, no wrong one, and no class too large."""
    sf = "/root/testdata/sf0.01"
    want = {i: (c, n) for i, c, n in brute_classes([tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()])}
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in queries.op7_jaccard_join(spark, sf).collect()}
    assert got.keys() == want.keys()
    assert all(got[i][1] <= n for i, (_, n) in want.items()) and sum(n for _, n in got.values()) >= 0.95 * sum(n for _, n in want.values()) > 0
    assert all(want[c][0] == want[i][0] for i, (c, _) in got.items())


def test_large_groups_are_compared_in_blocks(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(70):
        x = list(base)
        for _ in range(rng.randint(0, 5)):
            x[rng.randrange(120)] = f"n{rng.randrange(10**6)}"
        rows.append((k, " ".join(x)))
    monkeypatch.setattr(jaccard, "LEAF", 4)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "DEPTH", 2)
    assert collected(jaccard.near_duplicates(spark.createDataFrame(rows, DOCS)), ["doc_id", "class_id", "n_links"]) == brute_classes(rows)


def test_runs_reach_the_recall_at_every_depth(spark, monkeypatch):
    """A pair is missed by all runs with less than 0.001, however deep its buckets are split."""
    live = 1.0
    for _ in range(jaccard.DEPTH):
        live = 1 - np.exp(-live)
    used = []
    paths = jaccard._paths
    monkeypatch.setattr(jaccard, "_paths", lambda rows, threshold, roots=None: (used.append(roots), paths(rows, threshold, roots))[1])
    jaccard.candidates(jaccard.classes(spark.createDataFrame(near_rows(2), DOCS))).count()
    assert (1 - live) ** len(used[0]) < 1 - jaccard.RECALL


def test_intersections():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 50)).astype(np.uint64)) for _ in range(20)]
    assert (jaccard.intersections(sets) == [[len(np.intersect1d(a, b)) for b in sets] for a in sets]).all()


# -- substrings


def brute_repeats(rows):
    first = {}
    for i, t in rows:
        b, o = (t or "").encode(), -(2**63) if i is None else i
        for k in range(len(b) - 49):
            first[b[k : k + 50]] = min(o, first.get(b[k : k + 50], o))
    out = []
    for i, t in rows:
        b, o = (t or "").encode(), -(2**63) if i is None else i
        gone = [False] * len(b)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < o:
                gone[k : k + 50] = [True] * 50
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out, key=str)


def repeat_rows(seed=6):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    passages = [" ".join(word() for _ in range(n)) for n in (8, 12, 13, 30, 60)]
    rows = []
    for k in range(70):
        parts = [rng.choice(passages) if rng.random() < 0.4 else " ".join(word() for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(0, 6))]
        rows.append((k, rng.choice(["", " ", "x"]).join(parts)))
    return [*rows, *rows[:4], (100, rows[5][1]), (101, "ab" * 300), (102, "ab" * 200), (None, passages[4]), (103, None), (104, "q" * 49), (105, "q" * 50), (106, "q" * 51), (107, "\x00" * 120), (108, "\x00" * 60)]


@pytest.mark.parametrize("piece, bucket", [(6_000_000, 16_000_000), (700, 1500)])
def test_repeats_equal_brute_force(spark, piece, bucket):
    rows = repeat_rows()
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_removed int").repartition(3)
    got = substrings.remove_repeats(docs, keep_text=True, piece_bytes=piece, bucket_bytes=bucket)
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got.collect()), key=str) == brute_repeats(rows)


def test_repeats_of_nothing(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_multikey_sort_is_the_order_of_bytes():
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 2, (300, 20)).astype(np.uint8)
    order = substrings.multikey_sort(rows)
    assert [rows[i].tobytes() for i in order] == sorted(r.tobytes() for r in rows)


def test_multikey_sort_of_large_ranges(monkeypatch):
    rng = np.random.default_rng(5)
    rows = np.concatenate((rng.integers(0, 2, (400, 20)), np.tile(rng.integers(0, 3, (1, 20)), (150, 1)), rng.integers(0, 256, (200, 20)))).astype(np.uint8)
    for small in (2, 40):
        monkeypatch.setattr(substrings, "SMALL", small)
        order = substrings.multikey_sort(rows)
        assert sorted(order.tolist()) == list(range(750)) and [rows[i].tobytes() for i in order] == sorted(r.tobytes() for r in rows)


def test_repeats_equal_sql(spark):
    rows = repeat_rows(11)
    docs = spark.createDataFrame(rows, DOCS)
    names, want = duck(spark, substrings.ORACLE_SQL, docs)
    assert collected(substrings.remove_repeats(docs), names) == want


def test_long_texts_are_cut_into_segments(monkeypatch):
    data = np.frombuffer("".join(random.Random(1).choice("ab") for _ in range(900)).encode(), np.uint8)
    ends = np.array([400, 400, 900])
    whole = substrings.anchors(data, ends)
    monkeypatch.setattr(substrings, "SEGMENT", 64)
    windows = lambda x: sorted((int(p) - k, int(p)) for p, a, b in zip(*x, strict=True) for k in range(a, b + 1))
    assert windows(substrings.anchors(data, ends)) == windows(whole)
    assert [w for w, _ in windows(whole)] == [k for k in range(900 - 49) if k + 49 < 400 or k >= 400]


# -- fingerprints


def test_fingerprints_equal_sql(spark):
    rows = [*near_rows(5), (200, None), (201, ""), (202, "one"), (202, "one"), (None, "no id"), (203, "word " * 20_000)]
    docs = spark.createDataFrame(rows, DOCS)
    names, want = duck(spark, fingerprint.ORACLE_SQL, docs)
    assert collected(fingerprint.edited_likeness(docs), names) == want
    assert fingerprint.edited_likeness(docs.limit(0)).count() == 0
    (one,) = fingerprint.edited_likeness(docs.where("doc_id = 0")).collect()
    assert one["near_next"] == 1.0


def test_next_text_across_runs(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "RUN_ROWS", 3)
    rows = [(k * 7 % 101, f"t{k}") for k in range(90)]
    got = {r["doc_id"]: r["nx"] for r in fingerprint.with_next(spark.createDataFrame(rows, DOCS), "doc_id", "text", "nx").where("not __extra").collect()}
    order = sorted(rows)
    assert got == {a[0]: b[1] for a, b in zip(order, order[1:] + order[:1], strict=True)}


def test_sketches_merge_and_estimate(spark):
    from pyspark.sql import functions as F

    words = [f"w{k}" for k in range(3000)]
    a, b = " ".join(words[:2000]), " ".join(words[1000:])
    df = spark.createDataFrame([(a, b)], "a string, b string").select(fingerprint.sketch(F.col("a")).alias("a"), fingerprint.sketch(F.col("b")).alias("b"))
    r = df.select(fingerprint.resemblance(F.col("a"), F.col("b")).alias("j"), fingerprint.containment(F.col("a"), F.col("b")).alias("c"), fingerprint.distinct_shingles(F.col("a")).alias("n"), fingerprint.from_text(fingerprint.as_text(F.col("a"))).alias("same"), "a", fingerprint.merge(F.col("a"), F.col("b")).alias("m")).first()
    assert abs(r["j"] - 1 / 3) < 0.13 and abs(r["c"] - 0.5) < 0.2 and abs(r["n"] - 1996) < 600 and r["same"] == r["a"]
    parts = df.select(F.explode(F.array("a", "b")).alias("sketch")).withColumn("k", F.lit(1))
    assert fingerprint.merge_parts(parts, ["k"]).first()["sketch"] == r["m"]


def test_a_large_group_of_near_copies_is_not_split(spark, monkeypatch):
    """Its classes go on with fewer paths than there are classes, whatever shares its buckets, and no link is lost."""
    rng = random.Random(12)
    base, other = [[f"{c}{k}" for k in range(150)] for c in "wv"]
    rows = []
    for k in range(150):
        x = base[:] if k < 120 else base[: 10 * (k - 120)] + other[10 * (k - 120) :] if k < 136 else other[:]
        for _ in range(rng.randint(0, 3)):
            x[rng.randrange(150)] = f"n{rng.randrange(10**6)}"
        rows.append((k, " ".join(x)))
    made, run = [], jaccard.written

    def spied(df, name, **how):
        out = run(df, name, **how)
        if name.startswith("paths-") and name != "paths-1":
            made.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "LEAF", 16)
    monkeypatch.setattr(jaccard, "BLOCK", 32)
    monkeypatch.setattr(jaccard, "written", spied)
    assert collected(jaccard.near_duplicates(spark.createDataFrame(rows, DOCS)), ["doc_id", "class_id", "n_links"]) == brute_classes(rows)
    assert sum(made) < len(rows)
