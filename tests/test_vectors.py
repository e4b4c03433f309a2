"""Vector cells: recall against exact search, exactness with all cells probed, appended vectors, pruning of cells."""

import numpy as np
from pyspark.sql import functions as F

from provisio.operators import vectors
from provisio.operators.retrieval import vector_top_k_batch

SF = "/root/testdata/sf0.1"


def test_recall_and_exactness(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("id"), "embedding")
    ix = vectors.VectorIndex(spark, f"file://{tmp_path}/v")
    late = F.pmod(F.xxhash64("id"), F.lit(10)) == 0
    assert ix.add(rows.where(~late), batch=("load", 0)) == 1
    assert ix.add(rows.where(late), batch=("load", 1)) == 2 and ix.add(rows, batch=("load", 1)) == 2
    queries = rows.where("CAST(id AS INT) % 50 = 0").select(F.col("id").cast("long").alias("question_id"), "embedding")
    exact = vector_top_k_batch(rows, queries, 10, "id", question="question_id").select("question_id", "id", F.round("score", 9).alias("score"))
    all_cells = ix.top(queries, 10, probes=vectors.CELLS).select("question_id", "id", F.round("score", 9).alias("score"))
    assert {tuple(r) for r in all_cells.collect()} == {tuple(r) for r in exact.collect()}
    got = vectors.recall(ix.top(queries, 10), exact, 10).first()
    assert got.queries == 40 and got.recall >= 0.9
    one = ix.top(queries.limit(1), 3, probes=1)
    assert one.count() <= 3 and 1 <= ix.manifest()["probes"] <= vectors.CELLS


def test_odd_vectors(spark, tmp_path):
    ix = vectors.VectorIndex(spark, f"file://{tmp_path}/v")
    df = lambda rows: spark.createDataFrame(rows, "id string, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "question_id long, embedding array<float>")
    assert ix.top(q, 3).count() == 0
    ix.add(df([("x", None)]))
    assert ix.top(q, 3).count() == 0
    ix.add(df([("zero", [0.0, 0.0]), ("a", [2.0, 0.0]), ("b", [2.0, 0.0]), ("c", [0.0, -1.0])]))
    assert [(r.id, r.score) for r in ix.top(q, 2).where("question_id = 1").orderBy("rank").collect()] == [("a", 1.0), ("b", 1.0)]
    assert np.isclose([r.score for r in ix.top(q, 9).where("question_id = 2").collect()], 0).all()
