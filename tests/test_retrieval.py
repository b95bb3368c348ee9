import os
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tonarm.functions.vectors import l2_normalize
from tonarm.operators import retrieval

DIR = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")
@pytest.mark.parametrize("name", ["batch_shortlist_hundredth", "batch_recommend_hundredth", "batch_shortlist", "batch_recommend"])
def test_all_prompts_in_blocks(spark, monkeypatch, name):
    monkeypatch.setattr(retrieval, "PROMPTS", 2)  # several blocks of prompts and of vectors
    monkeypatch.setattr(retrieval, "CELL", 150)
    monkeypatch.setattr(retrieval, "VECTORS", 40)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{DIR}/embeddings.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    got = [tuple(r) for r in entry.queries()[name](spark, DIR).select(want.columns).collect()]
    assert sorted(got) == sorted(want.fetchall())
    prompts = {r[0] for r in con.sql("SELECT vec_id FROM embeddings WHERE vec_id % 100 = 0").fetchall()}
    assert {r[0] for r in got} == prompts and len(prompts) > 2


def test_prompts_without_answers(spark, monkeypatch):
    """Null and repeated ids, null vectors, prompts and vectors of other sizes; no prompt at all."""
    monkeypatch.setattr(retrieval, "PROMPTS", 1)
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [1.0, 1.0])], "index long, embedding array<float>")
    schema = "prompt_id long, embedding array<float>"
    prompts = spark.createDataFrame([(7, [1.0, 0.1, 5.0]), (7, [1.0, 0.1, 5.0]), (7, [2.0, 0.0]), (8, None), (None, [1.0, 0.0]), (9, [2.0])], schema)
    got = {(r["prompt_id"], r["rank"]): r["index"] for r in retrieval.batch_shortlist(corpus, prompts, 2).collect()}
    assert got == {(7, 1): 1, (7, 2): 4, (9, 1): 1, (9, 2): 4}
    none = spark.createDataFrame([], schema)
    assert retrieval.batch_shortlist(corpus, none).count() == 0 and retrieval.batch_recommend(corpus, corpus, none, none).count() == 0
    meta = spark.createDataFrame([(1, "x")], "index long, caption string")
    got = retrieval.recommend(corpus, corpus, prompts.where("prompt_id = 9"), prompts.where("prompt_id = 9"), meta, top=2, n=4).orderBy("rank").collect()
    assert [(r["index"], r["caption"]) for r in got] == [(1, "x"), (4, None)]


def test_block_join_of_ties(spark, monkeypatch):
    """Many equal scores, vectors of several sizes, more prompts than a block: against all pairs by hand."""
    monkeypatch.setattr(retrieval, "PROMPTS", 3)
    monkeypatch.setattr(retrieval, "CELL", 11)
    monkeypatch.setattr(retrieval, "VECTORS", 4)
    rng = np.random.default_rng(1)
    vectors = {i: rng.integers(-1, 2, 3 + i % 3).astype(float) for i in range(70)}
    asked = {1000 + i: rng.integers(-1, 2, 4).astype(float) for i in range(10)}
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()] + [(500, None)], "index long, embedding array<double>").repartition(3)
    prompts = spark.createDataFrame([(i, v.tolist()) for i, v in asked.items()], "prompt_id long, embedding array<float>")
    unit = lambda v: v / max(np.linalg.norm(v), 1e-12)
    want = {}
    for p, q in asked.items():
        scored = sorted((-round(float(unit(np.r_[q, 0.0][: len(v)]) @ unit(v)), 9), i) for i, v in vectors.items())
        want[p] = [-s for s, _ in scored[:6]]
    got = {}
    for r in retrieval.batch_shortlist(corpus, prompts, 6).orderBy("prompt_id", "rank").collect():
        got.setdefault(r["prompt_id"], []).append(round(r["score"], 9))
    assert got == want


def test_prompts_stay_off_the_driver(spark, tmp_path, monkeypatch):
    """However many blocks of prompts there are, the plan scans the corpus once and broadcasts nothing."""
    monkeypatch.setattr(retrieval, "PROMPTS", 2)
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)], "index long, embedding array<float>")
    df.write.parquet(str(tmp_path / "v"))
    corpus = spark.read.parquet(str(tmp_path / "v"))
    plan = retrieval.batch_shortlist(corpus, df.where("index % 5 = 0").withColumnRenamed("index", "prompt_id"), 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "Broadcast" not in plan


def test_normalize_is_linear(spark):
    """Eight times the numbers take about eight times as long, not 64 times."""
    took = {}
    for size in (64, 512):
        df = spark.range(2_000, numPartitions=1).select(F.transform(F.sequence(F.lit(1), F.lit(size)), lambda x: (x + F.col("id")).cast("float")).alias("v"))
        for _ in range(2):  # the first run compiles
            began = time.perf_counter()
            df.select(l2_normalize(F.col("v"))).write.format("noop").mode("overwrite").save()
            took[size] = time.perf_counter() - began
    assert took[512] < 30 * max(took[64], 0.1)


def test_meta_index(spark):
    from tonarm.operators.catalogue import meta_index

    df = spark.createDataFrame([(i % 50 if i % 7 else None, str(i)) for i in range(500)], "k long, v string").repartition(5)
    rows = meta_index(df, "k").orderBy("index").collect()
    assert [r["index"] for r in rows] == list(range(500))
    want = sorted(((i % 50 if i % 7 else None, str(i)) for i in range(500)), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert [(r["k"], r["v"]) for r in rows] == want
    assert meta_index(df.limit(0), "k").count() == 0
