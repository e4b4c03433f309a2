"""Whitening against a plain eigendecomposition in exact sums."""

import math
import random

import numpy as np

from provisio.llm import whitening

SF = "/root/testdata/sf0.001"


def whole(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def check(spark, rows, df, got=None):
    """rows: (key, vector)"""
    kept = [(k, [math.floor(64 * c) + 1_000_000 for c in v]) for k, v in rows if whole(v)]
    d = max(len(x) for _, x in kept)
    kept = [(k, x + [1_000_000] * (d - len(x))) for k, x in kept]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[n * a - s for a, s in zip(x, sums, strict=True)] for x in fit], object).astype(float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    got = got or whitening.whiten(df).collect()
    k = min(16, d)
    assert len(got) == len(kept) * k
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    signs = {}
    for key, x in kept:
        y = [n * a - s for a, s in zip(x, sums, strict=True)]
        for c in range(k):
            options = by[key, c + 1]
            r = next(o for o in options if o.deviation == sum(v * v for v in y))
            assert r.n == n
            if values[c] <= 1e-12 * max(values[0], 1e-300):
                assert r.whitened is None and r.explained == 0
                continue
            assert abs(r.explained - values[c] / values.sum()) <= 1e-9 * values[c] / values.sum()
            assert r.identity_error < 1e-9
            gap = min([abs(values[c] - values[o]) for o in range(d) if o != c], default=1) / values[0]
            if gap > 1e-4:
                want = np.array(y, float) / n @ vectors[:, c] / math.sqrt(values[c])
                if abs(want) > 1e-3:
                    assert signs.setdefault(c, r.whitened * want > 0) == (r.whitened * want > 0)
                assert abs(abs(r.whitened) - abs(want)) < 1e-9
    return got


def frame(spark, rows, parts=7):
    return spark.createDataFrame([(k, v, 1, "x") for k, v in rows], "vec_id long, embedding array<float>, component int, x string").repartition(parts)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check(spark, rows, None, whitening.op12_embedding_whitening(spark, SF).collect())


def test_nulls_repeats_lengths_and_flat_directions(spark):
    rng = random.Random(2)
    rows = []
    for k in range(300):
        a, b = rng.gauss(0, 1), rng.gauss(0, 0.3)
        rows.append((k, [float(np.float32(v)) for v in (a, b, a, 0.5, a + b)]))  # two directions at most, but for rounding
    hot = rows[0][1]
    rows += [(1000 + k, hot) for k in range(150)] + [(None, hot), (3, rows[3][1]), (2000, [1.0, None, 2.0]), (2001, None), (2002, [math.nan] * 5), (2003, [math.inf, 0.0]), (2004, [0.25, -0.25]), (2005, [])]
    check(spark, rows, frame(spark, rows))


def test_few_rows(spark):
    same = [(k, [0.5, 1.0, 2.0]) for k in range(5)]
    got = whitening.whiten(frame(spark, same)).collect()
    assert len(got) == 15 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got} == {(1, 0, None, 0.0, None)}
    check(spark, [(1, [0.0, 1.0]), (2, [1.0, 1.0])], frame(spark, [(1, [0.0, 1.0]), (2, [1.0, 1.0])]))
    for rows in ([], [(1, None)], [(1, [])]):
        empty = whitening.whiten(frame(spark, rows))
        assert empty.count() == 0 and len(empty.columns) == 7


def test_many_partitions_are_combined_in_steps(spark):
    rng = np.random.default_rng(8)
    rows = [(k, (rng.normal(size=20) * np.linspace(1, 5, 20)).tolist()) for k in range(900)]
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check(spark, [(k, [float(np.float32(c)) for c in v]) for k, v in rows], frame(spark, rows, 40))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_large_entries(spark):
    rows = [(k, [float(np.float32(c)) for c in (1e9 * k, -3e15 if k % 2 else 2e15, 0.1)]) for k in range(40)]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert len(got) == 120 and all(r.deviation is None or r.deviation > 0 for r in got) and {r.n for r in got} == {40}


def test_secular_roots_at_close_poles():
    rng = np.random.default_rng(1)
    for trial in range(200):
        m = int(rng.integers(1, 30))
        d = np.sort(rng.choice([1.0, 1e-6, 1e3], m) * rng.random(m))
        if m > 2:
            d[1] = d[0] * (1 + 1e-15)
        values, vectors = d.copy(), np.linalg.qr(rng.normal(size=(m, m)))[0]
        u = rng.normal(size=m) * rng.choice([1e-9, 1.0, 1e4], m)
        want = vectors @ np.diag(values) @ vectors.T + np.outer(u, u)
        values, vectors = whitening.rank_one(values, vectors, u)
        assert np.abs(vectors @ np.diag(values) @ vectors.T - want).max() <= 1e-13 * max(np.abs(want).max(), 1e-300), trial
        assert np.abs(vectors.T @ vectors - np.eye(m)).max() < 1e-13
