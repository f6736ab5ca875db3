"""What larger tables brought up: results that do not hang on the order of rows, whole results without limits of size."""

import os
import time
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stationlake.operators import clusters, frames, graph, kernels, resampling, service, spatial


def test_asof_join_of_rows_in_changing_order(spark):
    def dealt(batches):  # as a shuffle that is read twice
        for pdf in batches:
            yield pdf.sample(frac=1, random_state=int.from_bytes(os.urandom(4), "little"))

    start = datetime(2024, 1, 1)
    p = pd.DataFrame({"station_id": [f"s{i}" for i in range(300)], "fetched_at": [start + timedelta(minutes=13 * i) for i in range(300)]})
    left = spark.createDataFrame(p, "station_id string, fetched_at timestamp").coalesce(1).mapInPandas(dealt, "station_id string, fetched_at timestamp")
    right = spark.createDataFrame([(start + timedelta(hours=h), h) for h in range(80)], "observed_at timestamp, n int")
    got = frames.join_exogenous(left, right).collect()
    assert len(got) == 300
    for r in got:
        assert abs((r.observed_at - r.fetched_at).total_seconds()) <= 1800


def test_profiles_do_not_hang_on_the_order_of_rows(spark):
    rows = [("s", "a", datetime(2024, 1, 1 + i, 7), b, 10 - b, 10) for i, b in enumerate([1, 2, 3, 1, 2, 7, 9, 3, 3, 6, 1, 2])]
    make = lambda x: service.diurnal_profiles(spark.createDataFrame(x, "system_id string, station_id string, fetched_at timestamp, num_bikes_available long, num_docks_available long, capacity long").coalesce(1)).first().h07
    assert len({make(sorted(rows, key=lambda r: (r[3] * k) % 11)) for k in range(1, 11)}) == 1


def test_profiles_add_up_in_order_of_time(spark):
    rng = np.random.default_rng(4)
    rows = [("s", f"{i:02d}", datetime(2024, 1, 1 + d, 7), int(rng.integers(0, 8)), 0, 7 + i % 23) for i in range(40) for d in range(20)]
    want = {f"{i:02d}": 0.0 for i in range(40)}
    for r in rows:
        want[r[1]] += r[3] / r[5]
    rng.shuffle(rows)
    got = service.diurnal_profiles(spark.createDataFrame([(str(a), str(b), c, int(d), int(e), int(f)) for a, b, c, d, e, f in rows], "system_id string, station_id string, fetched_at timestamp, num_bikes_available long, num_docks_available long, capacity long")).collect()
    assert {r.station_id: r.h07 for r in got} == {k: v / 20 for k, v in want.items()}  # to the last digit


def pairs_made(df) -> int:
    """Rows that the joins of a frame's plan put out; the plan runs once."""
    df.collect()
    nodes, total = [df._jdf.queryExecution().executedPlan()], 0
    while nodes:
        node = nodes.pop()
        node = node.executedPlan() if node.nodeName() == "AdaptiveSparkPlan" else node.plan() if "QueryStage" in node.nodeName() else node
        if "Join" in node.nodeName():
            total += node.metrics().apply("numOutputRows").value()
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_catchments_join_places(spark):
    info = spark.range(600).selectExpr("cast(id as string) as station_id", "48D + id % 3 / 1000D as lat", "2D as lon", "id % 7 as capacity")
    demand = spark.range(600).selectExpr("id as demand_id", "48.0005D + id % 2 / 1000D as lat", "2D as lon", "cast(id % 5 as double) as population")
    got = spatial.two_step_fca(info, demand)
    assert pairs_made(got) < 10_000  # 360,000 pairs of a station and a demand point
    s, d = info.toPandas(), demand.toPandas()
    away = np.abs(s.lat.to_numpy()[:, None] - d.lat.to_numpy()) * 6371000 * np.pi / 180
    w = np.where(away <= 800, np.exp(-((away / (800 / 3)) ** 2) / 2), 0)
    want = (s.capacity.to_numpy() / (w @ d.population.to_numpy())) @ w
    assert [r.accessibility for r in got.orderBy("demand_id").collect()] == pytest.approx(want.tolist())


def test_density_clusters_join_places(spark):
    info = spark.range(900).selectExpr("cast(1000 + id as string) as station_id", "48D + id % 3 / 500D as lat", "2D as lon").union(spark.sql("select 'lone', 49D, 2D"))
    made = []
    join = clusters.range_join
    with pytest.MonkeyPatch.context() as m:
        m.setattr(clusters, "range_join", lambda *a, **b: made.append(join(*a, **b)) or made[-1])
        got = {r.station_id: r.cluster for r in clusters.cluster_density(info).collect()}
    assert [got[str(1000 + i)] for i in range(900)] == ["1000"] * 900 and got["lone"] is None
    assert sum(x.count() for x in made) < 100  # 810,000 pairs of stations


def test_local_moran_of_a_large_inventory(spark):
    info = spark.range(60_000).selectExpr("'s' as system_id", "cast(id as string) as station_id", "48D + id % 3000 % 60 / 100D as lat", "2D + floor(id % 3000 / 60) / 100D as lon", "cast(id % 3000 % 60 < 30 as double) as v")
    got = kernels.local_moran_inference(info, "v", k=4, permutations=99).groupBy("cluster_type").count().collect()
    assert {r.cluster_type for r in got} >= {"HH", "LL"} and sum(r["count"] for r in got) == 60_000


def test_nearest_numbers_by_boxes():
    rng = np.random.default_rng(0)
    for places in (2500, 100):
        at = rng.uniform(0, 0.3, (places, 2))[rng.integers(0, places, 2500)]
        la, lo = np.radians(48 + at[:, 0]), np.radians(2 + at[:, 1])
        xyz = np.stack((np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)), 1)
        d = ((xyz[:, None] - xyz[None]) ** 2).sum(2)
        np.fill_diagonal(d, np.inf)
        assert (kernels.neighbour_numbers(48 + at[:, 0], 2 + at[:, 1], 4) == np.argsort(d, axis=1, kind="stable")[:, :4]).all()


def test_hierarchy_of_a_large_inventory():
    rng = np.random.default_rng(1)
    centre = np.arange(5500) % 3
    at = np.stack((48 + centre * 0.2, 2 + centre * 0.3), 1) + rng.normal(0, 0.004, (5500, 2))
    info = pd.DataFrame({"lat": at[:, 0], "lon": at[:, 1]})
    label = clusters.hierarchy_labels(info.lat.to_numpy(), info.lon.to_numpy(), 500)
    main = [np.bincount(label[centre == c] + 1).argmax() for c in range(3)]
    assert len(set(main)) == 3 and 0 not in main


def laplacian_of(n, edges):
    degree = np.bincount(np.ravel(edges), minlength=n)
    both = [(a, b) for x, y in edges for a, b in ((x, y), (y, x))]
    return pd.DataFrame([(a, b, -1 / np.sqrt(degree[a] * degree[b])) for a, b in both] + [(i, i, 1.0) for i in range(n)], columns=["a_id", "b_id", "value"])


def test_smoothest_components_of_large_and_split_graphs(spark, monkeypatch):
    split = laplacian_of(6000, [(i, i + 1) for i in range(0, 6000, 2)])
    got = graph.low_freq_basis(spark.createDataFrame(split), 2).where("value <> 0").collect()
    assert {(r.id, r.component) for r in got} == {(2, 1), (3, 1), (4, 2), (5, 2)}
    monkeypatch.setattr(graph, "MAX_NODES", 100)
    ring = laplacian_of(300, [(i, (i + s) % 300) for s in range(1, 5) for i in range(300)])  # one part, above MAX_NODES
    _, found = graph._low(ring, 3)
    v = np.stack([x[np.argsort(own)] for own, x in found[1:]])
    at = np.arange(300) * 2 * np.pi / 300
    wave = np.stack((np.sin(at), np.cos(at))) * np.sqrt(2 / 300)
    assert (v @ wave.T) @ (wave @ v.T) == pytest.approx(np.eye(2), abs=1e-6)
def test_rewiring_of_a_large_graph(spark):
    edges = spark.range(1_000_001).selectExpr("id as a_id", "(id + 1) % 1000001 as b_id", "1D as weight")
    got = kernels.degree_preserving_rewire(edges, n_swaps=500_000)
    assert got.groupBy("a_id").count().where("count <> 2").isEmpty() and got.distinct().count() == 2_000_002




def rows_sent(df) -> int:
    """Rows that the shuffles of a frame's plan put out; the plan runs once."""
    df.collect()
    nodes, total = [df._jdf.queryExecution().executedPlan()], 0
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            nodes.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            nodes.append(node.plan())
        elif node.nodeName() == "Exchange":
            total += node.metrics().apply("shuffleRecordsWritten").value()
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    return total


def copied_series(spark, copies):
    """Bins of copies of three stations and a flat one, and what pandas gives for pairs of the three."""
    x = {"a": [1, 2, 2, 5, 3, 9], "b": [2, 1, 4, 4, 6, 5], "c": [9, 7, 7, 1, 2, 0]}
    rows = [(f"{k}{i:03d}", h, float(v)) for k, s in (x | {"flat": [4] * 6}).items() for i in range(copies) for h, v in enumerate(s)]
    return spark.createDataFrame(rows, "station_id string, b long, x double"), pd.DataFrame(x)


def check_copies(spark, method, want):
    bins, x = copied_series(spark, 150)
    got = kernels.pair_correlations(bins, method, 3)
    assert rows_sent(got) < 1000  # 3600 readings, dealt to pairs of blocks
    out = got.toPandas()
    assert len(out) == 450 * 449 // 2 == len(out[["station_a", "station_b"]].drop_duplicates()) and (out.station_a < out.station_b).all() and (out.n_overlap == 6).all()
    for (a, b), part in out.groupby([out.station_a.str[0], out.station_b.str[0]]):
        assert part["corr"].to_numpy() == pytest.approx(want(x[a].to_numpy(), x[b].to_numpy())), (a, b)


def test_synchrony_correlates_equal_series_once(spark):
    check_copies(spark, "pearson", lambda x, y: np.corrcoef(x, y)[0, 1])


def test_synchrony_by_rank_correlates_equal_series_once(spark):
    check_copies(spark, "spearman", lambda x, y: np.corrcoef(pd.Series(x).rank(), pd.Series(y).rank())[0, 1])


def test_synchrony_by_concordance_correlates_equal_series_once(spark):
    sign = lambda v: np.sign(v[:, None] - v)
    check_copies(spark, "kendall", lambda x, y: (sign(x) * sign(y)).sum() / np.sqrt((sign(x) ** 2).sum() * (sign(y) ** 2).sum()))


def test_tension_counts_a_place_once(spark):
    p = spark.sql("select 's' as system_id, cast(id as string) as station_id, 48D + id % 3 / 10D as lat, 2D as lon, cast(id % 3 = 0 as long) * 2 as num_bikes_available, timestamp '2026-01-01' as fetched_at from range(300)")
    target = p.selectExpr("station_id", "cast(num_bikes_available = 0 and lat > 48.15D as double) as target")
    got = resampling.rebalancing_tension(p, target=target)
    assert rows_sent(got) < 1500  # rows of one snapshot's stations go into few of its places
    assert got.first().bike_km == pytest.approx(200 * 6371 * np.radians(0.2))


def test_transport_between_many_places():
    rng = np.random.default_rng(3)
    a, b = rng.dirichlet(np.ones(150)), rng.dirichlet(np.ones(1500))
    x, y = rng.uniform(0, 9e3, 150), rng.uniform(0, 9e3, 1500)
    at = np.concatenate((x, y))
    order = np.argsort(at)
    want = np.abs(np.cumsum(np.concatenate((a, -b))[order]))[:-1] @ np.diff(at[order])
    began = time.process_time()
    assert resampling.transport_cost(np.abs(x[:, None] - y), a, b) == pytest.approx(want)
    assert time.process_time() - began < 30  # minutes by paths for each unit


def test_warped_clusters_of_many_courses(spark):
    names = [f"h{h:02d}" for h in range(24)]
    x = np.random.default_rng(0).normal(0, 0.1, (40, 24)) + np.array([np.sin(np.arange(24) / (2 + i % 2)) for i in range(40)])
    one = pd.DataFrame(x, columns=names).assign(system_id="s", station_id=[f"{i:02d}" for i in range(40)])
    many = pd.concat([one.assign(station_id=one.station_id + f"-{c:03d}") for c in range(110)])  # 4400 rows
    label = clusters.medoids(clusters.warped(((x.T - x.mean(1)) / x.std(1)).T), 2)[0]
    got = clusters.cluster_profiles(spark.createDataFrame(many), k=2, method="dtw").toPandas()
    assert len(got) == 4400 and [got[got.station_id.str[:2] == f"{i:02d}"].cluster.unique().tolist() for i in range(40)] == [[c] for c in label]


def test_warped_clusters_leave_no_task_all_courses(spark):
    names = [f"h{h:02d}" for h in range(24)]
    rng = np.random.default_rng(6)
    kind = np.arange(3000) % 3
    shape = np.stack([np.exp(-((np.arange(24) - at) ** 2) / 6) for at in (8, 16)])
    x = np.stack((shape[0], shape[0] + shape[1], -shape[1]))[kind] + rng.normal(0, 0.05, (3000, 24))
    many = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(system_id="s", station_id=[f"{i:04d}" for i in range(3000)]))
    got = clusters.cluster_profiles(many, k=3, method="dtw")
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    label = got.orderBy("station_id").toPandas().cluster.to_numpy()
    assert [len(set(label[kind == c])) for c in range(3)] == [1, 1, 1] and len(set(label)) == 3


def test_means_along_ways_of_steps():
    rng = np.random.default_rng(7)
    x, c, weight = rng.normal(size=(6, 5)), rng.normal(size=5), rng.uniform(1, 2, 6)
    want = np.zeros((2, 5))
    for row, w in zip(x, weight):
        best = {(0, 0): ((row[0] - c[0]) ** 2, [(0, 0)])}
        for i in range(5):
            for j in range(5):
                if i or j:
                    d, way = min((best[p] for p in ((i - 1, j - 1), (i - 1, j), (i, j - 1)) if p in best), key=lambda b: b[0])
                    best[i, j] = d + (row[i] - c[j]) ** 2, [*way, (i, j)]
        for i, j in best[4, 4][1]:
            want[:, j] += w * row[i], w
    assert clusters._pulled(x, weight, c) == pytest.approx(want)
    assert clusters._distances(x, x) == pytest.approx(clusters.warped(x) ** 2)
