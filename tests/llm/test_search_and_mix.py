"""Nearest neighbours, mixing, the pipeline."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gossamer.llm import ann, langid, mixing, queries

SF = "/root/testdata/sf0.001"


def brute(rows, k=10):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q in {i for i, _ in good if i % 100 == 0}:
        best = {}
        for i, v in good:
            for j, w in good:
                if j == q and i != q and len(v) == len(w):
                    best[i] = min(best.get(i, math.inf), float(np.sqrt(((v - w) ** 2).sum())))
        out[q] = sorted((d, i) for i, d in best.items())[:k]
    return {q: v for q, v in out.items() if v}


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def vectors():
    rng = random.Random(5)
    rows = [(k, [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)]) for k in range(350)]
    return [*rows, *rows[:5], (100, [9.0, 9.0, 9.0, 9.0]), (17, [8.0, 9.0, 9.0, 9.0]), (400, None), (500, [0.0] * 4), (501, [None, 1.0, 1.0, 1.0]), (502, [float("nan"), 1.0, 1.0, 1.0]), (503, [float("inf"), 1.0, 1.0, 1.0]), (504, []), (600, [1.0, 2.0]), (601, [1.0, 3.0]), (None, [1.0] * 4)]


@pytest.mark.parametrize("shard, block", [(8192, 1024), (40, 2)])
def test_factor_one_is_exact(spark, shard, block):
    df = spark.createDataFrame([(i, v, 1) for i, v in vectors()], "vec_id long, embedding array<double>, score int")
    got = found(ann.nearest(df, F.col("vec_id") % 100 == 0, factor=1.0, shard_rows=shard, block_rows=block))
    want = brute(vectors())
    assert got.keys() == want.keys()
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]]
        assert np.allclose([d for d, _ in got[q]], [d for d, _ in want[q]], rtol=1e-15)


def test_recall_of_the_query(spark):
    got = found(queries.op2_nearest_neighbours(spark, "/root/testdata/sf0.1"))
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.1/embeddings.parquet'")
    want = {(q, i) for q, _, i, _ in con.execute(ann.brute_force_sql()).fetchall()}
    assert len({(q, i) for q, v in got.items() for _, i in v} & want) >= 0.9 * len(want)


def test_nothing_is_broadcast(spark):
    df = spark.createDataFrame(vectors()[:350], "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("vec_id") % 100 == 0, shard_rows=40, block_rows=2)
    assert got.collect() and "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_no_vectors(spark):
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


def mix_rows():
    rng = random.Random(2)
    rows = [(k, rng.choice(["a"] * 6 + ["b", "b", "c", None]), "w " * rng.randint(0, 40)) for k in range(900)]
    return [*rows, rows[3], rows[3], (None, "c", "x y"), (901, "", "one two"), (902, "void", ""), (903, "void", None), (904, "c", "w " * 3000)]


def test_mixture_equals_sql(spark):
    docs = spark.createDataFrame(mix_rows(), "doc_id long, source string, text string")
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = sorted((tuple(r) for r in con.execute(mixing.ORACLE_SQL).fetchall()), key=str)
    got = mixing.mix(docs).select("doc_id", "source", "n_tokens", F.round("weight", 9).alias("weight"), "copies")
    assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_budgets_are_met(spark):
    docs = spark.createDataFrame(mix_rows(), "doc_id long, source string, text string").withColumn("epochs", F.lit("clash"))
    rows = mixing.mix(docs, budget=60_000.0, max_repetition=None, target_entropy=1.2).groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("got"), F.first("weight").alias("weight"), F.max("n_tokens").alias("largest")).collect()
    for r in rows:
        assert r["weight"] * 60_000 - 1 <= r["got"] <= r["weight"] * 60_000 + r["largest"] + 1
    entropy = -sum(r["weight"] * math.log(r["weight"]) for r in rows if r["weight"])
    assert 1.2 <= entropy < 1.201
    assert mixing.mix(docs).columns == ["doc_id", "source", "text", "epochs", "n_tokens", "weight", "copies"]
    assert mixing.mix(docs.limit(0)).count() == 0


def test_repetition_limit(spark):
    s = spark.createDataFrame([(900, 1), (50, 2)], "tokens long, n long")
    a = mixing.exponent(s, budget=1000.0, max_repetition=2.0)
    rep = lambda x: (0.05 ** (x - 1)) / (0.9**x + 2 * 0.05**x)
    assert rep(a) <= 2.0 < rep(a - 2 / mixing.GRID)
    assert mixing.exponent(s, budget=10_000.0, max_repetition=2.0) == 1.0
    with pytest.raises(ValueError):
        mixing.exponent(s, budget=1.0)


def test_realised_copies(spark):
    docs = spark.createDataFrame(mix_rows(), "doc_id long, source string, text string")
    n = mixing.mix(docs, budget=30_000.0).agg(F.sum("copies")).first()[0]
    assert mixing.realise(docs, budget=30_000.0).count() == n


def test_stages_on_cases(spark):
    rows = [(1, "the cat sat on the mat and so on", "en", "s", 30), (2, None, None, None, None), (3, "", "en", "s", 0), (4, "12 34", "de", "t", 5), (1, "the cat sat on the mat and so on", "en", "s", 30), (None, "der hund und die katze im haus", "de", None, 31)]
    for part in (rows, []):
        docs = spark.createDataFrame(part, "doc_id long, text string, lang string, source string, n_chars long")
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            out.collect()
            if stage is not corpus_pipeline.tokens:
                assert out.dtypes == docs.dtypes
                docs = out


def test_pipeline_equals_brute_force(spark):
    """Each stage held against a plain version on its own input."""
    from test_dedup import brute_classes, duck

    from gossamer.llm import lines

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    run = dict(corpus_pipeline.STAGES)
    kept = run["language_id"](spark, docs, SF)
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {r["doc_id"] for r in docs.collect() if r["text"] and any(ch.isalpha() for ch in r["text"])}
    kept = spark.createDataFrame(kept.collect(), kept.schema)
    less = run["line_dedup"](spark, kept, SF)
    _, want = duck(spark, f"WITH {lines.oracle_sql()} SELECT doc_id, kept FROM documents_kept", kept.select("doc_id", "text"))
    assert sorted((tuple(r) for r in less.select("doc_id", "text").collect()), key=str) == want
    less = spark.createDataFrame(less.collect(), less.schema)
    one = run["near_duplicates"](spark, less, SF)
    assert {r["doc_id"] for r in one.collect()} == {c for _, c, _ in brute_classes([(r["doc_id"], r["text"]) for r in less.collect()])}
    one = spark.createDataFrame(one.collect(), one.schema)
    _, want = duck(spark, mixing.ORACLE_SQL, one.select("doc_id", "source", "text"))
    mixed = run["source_mix"](spark, one, SF)
    n = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert n == {r[0]: r[4] for r in want if r[4]}
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.VOCABULARY)
    texts = {r["doc_id"]: r["text"] for r in mixed.collect()}
    assert all(r["ids"] == t.encode(texts[r["doc_id"]], add_special_tokens=False).ids for r in run["bpe_tokens"](spark, mixed, SF).collect())
    assert langid.UND == "und"


def test_unknown_languages_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    planted = ["Съешь же ещё этих мягких французских булок, да выпей чаю", "漢字仮名交じり文の例です", "qzx jkq wvx zzkq xqj pfg vbkq zxw qjk xvq wzk " * 3, "Hyvää huomenta kaikille ystäville Suomessa tänään ja huomenna myös", "12 34 !!"]
    rows = docs.limit(len(planted)).collect()
    fields = [{**r.asDict(), "doc_id": 10**6 + k, "text": t, "lang": None, "n_chars": len(t)} for k, (r, t) in enumerate(zip(rows, planted, strict=True))]
    kept = corpus_pipeline.language_id(spark, docs.unionByName(spark.createDataFrame([tuple(f[c] for c in docs.columns) for f in fields], docs.schema)), SF)
    got = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert not got & {10**6 + k for k in range(len(planted))}
    assert got == {r["doc_id"] for r in docs.select("doc_id", "text").collect() if r["text"] and any(ch.isalpha() for ch in r["text"])}
