"""Clusters, graphs, resampling and transport against brute force."""

from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from stationlake.operators import clusters, graph, resampling
from stationlake.plans.components import components


def test_components_of_a_long_path(spark):
    nodes = spark.range(60)
    edges = spark.range(49).selectExpr("id as a", "id + 1 as b").union(spark.sql("select 55L as a, 55L as b"))
    got = {r.id: r.component for r in components(nodes, edges).collect()}
    assert got == {i: 0 if i < 50 else i for i in range(60)}


def points(spark, xs):
    return spark.createDataFrame([(f"{i:03d}", 48.0 + y / 111_194.9, 2.0 + x / (111_194.9 * 0.66913)) for i, (x, y) in enumerate(xs)], "station_id string, lat double, lon double")


def test_density_clusters(spark):
    rng = np.random.default_rng(1)
    xs = [(rng.normal() * 60 + 3000 * (i % 3), rng.normal() * 60) for i in range(60)] + [(9000, 9000)]
    got = {r.station_id: r.cluster for r in clusters.cluster_density(points(spark, xs)).collect()}
    assert got["060"] is None and len(got) == 61
    for i in range(60):
        assert got[f"{i:03d}"] == got[f"{i % 3:03d}"] is not None
    assert len(set(got.values())) == 4


def test_spectral_and_profile_clusters(spark):
    rng = np.random.default_rng(2)
    info = points(spark, [(rng.uniform(0, 300) + 1500 * (i % 2), rng.uniform(0, 300)) for i in range(40)])
    got = {r.station_id: r.cluster for r in clusters.cluster_spectral(info, k=2, n_neighbors=25).collect()}
    assert len(got) == 40
    rows = [(str(i), *(float(np.sin(h / 4 + (i % 2) * 3) + rng.normal() * 0.05) for h in range(24))) for i in range(30)]
    profiles = spark.createDataFrame(rows, "station_id string, " + ", ".join(f"h{h:02d} double" for h in range(24)))
    for method in ("kmeans", "gmm"):
        out = {r.station_id: r.cluster for r in clusters.cluster_profiles(profiles, method=method, k=None if method == "kmeans" else 2).collect()}
        assert len({out[str(i)] for i in range(0, 30, 2)}) == len({out[str(i)] for i in range(1, 30, 2)}) == 1 and out["0"] != out["1"]
    assert clusters.cluster_profiles(profiles.limit(0)).count() == 0


def test_graph_signals(spark):
    rng = np.random.default_rng(3)
    info = points(spark, rng.uniform(0, 3000, (30, 2)).tolist())
    edges = graph.knn_adjacency(info, k=5).cache()
    both = {(r.a_id, r.b_id): r.weight for r in edges.collect()}
    assert all(both[b, a] == w for (a, b), w in both.items())
    lap = graph.normalized_laplacian(edges)
    m = np.zeros((30, 30))
    for r in lap.collect():
        m[int(r.a_id), int(r.b_id)] = r.value
    values = np.linalg.eigvalsh(m)
    basis = graph.low_freq_basis(lap, 4).cache()
    v = np.zeros((30, 4))
    for r in basis.collect():
        v[int(r.id), r.component - 1] = r.value
    assert m @ v == pytest.approx(v * values[1:5], abs=1e-9)
    y = graph.band_limited_signal(lap, r2_target=0.7, n_low=4)
    assert graph.spectral_r2(y, basis).first().r2 == pytest.approx(0.7, abs=0.1)
    moved = graph.permute_signal(y).collect()
    assert sorted(round(r.y, 9) for r in moved) == sorted(round(r.y, 9) for r in y.collect())


def test_transport_equals_assignment():
    rng = np.random.default_rng(4)
    for _ in range(20):
        c = rng.uniform(0, 1, (5, 5))
        best = min(sum(c[i, p[i]] for i in range(5)) for p in permutations(range(5)))
        assert resampling.transport_cost(c, np.ones(5), np.ones(5)) == pytest.approx(best)
    a, b = rng.dirichlet(np.ones(12)), rng.dirichlet(np.ones(12))
    x = np.arange(12.0)
    assert resampling.transport_cost(np.abs(x[:, None] - x), a, b) == pytest.approx(np.abs(np.cumsum(a - b)).sum())


def test_tension_and_bootstrap(spark):
    p = spark.sql("select 's' as system_id, * from values ('a', 48.0D, 2.0D, 10), ('b', 48.1D, 2.0D, 0) as t(station_id, lat, lon, num_bikes_available)").withColumn("fetched_at", F.lit("2026-01-01").cast("timestamp"))
    target = spark.sql("select * from values ('a', 5D), ('b', 5D) as t(station_id, target)")
    for by in (("system_id",), ()):
        assert resampling.rebalancing_tension(p, target=target, by=by).first().bike_km == pytest.approx(5 * 6371 * np.radians(0.1))
    s = spark.range(100).select(F.lit("s").alias("k"), (F.col("id") % 5 + 1).cast("double").alias("x"), "id")
    row = resampling.block_bootstrap(s, "x", by=("k",), order="id", n_boot=200, seed=1).first()
    assert row.estimate == 3 and row.ci_lo <= 3 <= row.ci_hi
    assert resampling.block_bootstrap(s.withColumn("x", F.lit(None).cast("double")), "x", by=("k",), order="id").first().estimate is None
    x = np.sin(np.arange(50) / 5)
    d = x - x.mean()
    total = 0.0
    for k in range(1, 50):
        r = d[k:] @ d[:-k] / (d @ d)
        if r <= 0:
            break
        total += r
    assert resampling.sample_size(x) == pytest.approx(max(50 / (1 + 2 * total), 1))
    assert resampling.effective_sample_size(s, "x", by=("k",), order="id").first().n == 100
