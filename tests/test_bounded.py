"""Steps that grew with rounds, replicates or pairs: as before on small tables, bounded in plan and rows."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvelake.functions import numeric as nm
from curvelake.operators import monitor
from curvelake.sources.curves import Curves


def curves(spark, n=240, m=16, seed=3):
    r = np.random.default_rng(seed)
    v = r.normal(size=(n, 4)) @ r.normal(size=(4, m)) + 0.3 * r.normal(size=(n, m))
    v[::40] += 4 * r.normal(size=(len(v[::40]), m))
    df = spark.createDataFrame([(i, [float(a) for a in x], i % 3) for i, x in enumerate(v)], "id long, values array<double>, label int").repartition(3)
    return Curves(df, nm.unit_grid(m)), v


def test_f1_rounds_of_charts_join_nothing(spark):
    c, _ = curves(spark)
    chart, kept = monitor.phase1_iterative(c, 2)
    table, n, removals = c.df.select("id", "values").cache(), 240, 0
    for _ in range(10):  # table by table
        want = monitor.phase1(c.with_df(table), 2)[0]
        bad = [r["id"] for r in monitor.monitor(c.with_df(table), want).where("t2_alarm OR spe_alarm").select("id").collect()]
        now = table.count()
        if not bad or n - now + len(bad) > 0.5 * n or now - len(bad) < 4:
            break
        table, removals = table.where(~F.col("id").isin(bad)).cache(), removals + 1
    assert removals > 1
    assert sorted(r["id"] for r in kept.collect()) == sorted(r["id"] for r in table.select("id").collect())
    assert np.isclose(chart.spe_limit, want.spe_limit)
    assert "Join" not in kept._jdf.queryExecution().toString()


def test_f34_every_user_meets_every_later_one(spark):
    from curvelake.plans import registry

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("the driver's tables are not here")
    users = sorted(r[0] for r in spark.read.parquet(f"{folder}/events.parquet").where("ts IS NOT NULL AND value IS NOT NULL").select("user_id").distinct().collect())
    got = registry.queries()["metric_lp_irreg"](spark, folder).select("i", "j").collect()
    assert sorted((r["i"], r["j"]) for r in got) == [(i, j) for i in users for j in users if i < j]


def test_f2_replicates_are_summed_in_blocks(spark, monkeypatch):
    from curvelake.operators import explain, mixed

    r = np.random.default_rng(5)
    who = r.integers(0, 40, 200)
    x, y = r.normal(size=(200, 2)), r.normal(size=(200, 3))
    df = spark.createDataFrame([(i, f"s{who[i]}", x[i].tolist(), y[i].tolist()) for i in range(200)], "row long, subject string, x array<double>, scores array<double>").repartition(5)
    size = np.unique(np.bincount(who)[np.bincount(who) > 0]).astype(float)
    order = sorted(range(200), key=lambda i: (f"s{who[i]}", i))
    got = mixed.permuted_sums(df, size, 4, 7)
    for k in range(4):
        new = np.empty_like(x)
        new[order] = x[order][np.random.default_rng([7, 0, k]).permutation(200)]
        sx, sy = (np.array([v[who == s].sum(0) for s in np.unique(who)]) for v in (new, y))
        n = np.array([(who == s).sum() for s in np.unique(who)])
        assert np.allclose(got[0][k], new.T @ y)
        assert np.allclose(got[1][k], [sx[n == g].T @ sx[n == g] for g in size])
        assert np.allclose(got[2][k], [sx[n == g].T @ sy[n == g] for g in size])
    blocks = mixed.permuted_sums(df, size, 3, 7, 20)  # several blocks: sums of x x' over subjects vary, the rows' do not
    assert np.allclose(blocks[2].sum((0, 1)).shape, (2, 3)) and np.isfinite(blocks[1]).all()
    monkeypatch.setattr(explain, "_shuffled", None)  # no table of replicates
    c = Curves(spark.createDataFrame([(i, int(who[i]), [float(x[i, 0])], [float(v) for v in np.outer(x[i, 0] + y[i, 0], np.ones(6))[0] + y[i, 1] * np.arange(6)]) for i in range(200)], "id long, customer long, x array<double>, values array<double>"), nm.unit_grid(6))
    assert mixed.permutation_test(c, "customer", "x", 2, 19)[1][0] == 0.05


def distances(c, v):
    return np.sqrt(((v[:, None] - v[None]) ** 2) @ c.weights)


@pytest.fixture
def no_pairs(monkeypatch):
    from curvelake.operators import apply, metrics

    def refuse(*_, **__):
        raise AssertionError("rows of all pairs")

    monkeypatch.setattr(metrics, "self_pairs", refuse)
    monkeypatch.setattr(apply, "FEW_BLOCKS", 3)


def test_f24_silhouette_is_summed_in_tiles(spark, no_pairs):
    from curvelake.operators import cluster

    c, v = curves(spark, 90)
    d, g = distances(c, v), np.arange(90) % 3
    g[7] = 9  # a single one
    labels = spark.createDataFrame([(i, int(x)) for i, x in enumerate(g)], "id long, cluster int")
    got = {r["id"]: r["silhouette"] for r in cluster.silhouette(c, labels).collect()}
    for i in range(90):
        a = d[i][(g == g[i])].sum() / max((g == g[i]).sum() - 1, 1)
        b = min(d[i][g == x].mean() for x in set(g) if x != g[i])
        assert np.isclose(got[i], (b - a) / max(a, b))


def test_f10_f26_kernel_votes_are_summed_in_tiles(spark, no_pairs):
    from curvelake.operators import cluster

    c, v = curves(spark, 80)
    d, g = distances(c, v), np.arange(80) % 3
    got = {r["id"]: r for r in cluster.kernel_classify(c, c.df.select("id", "label"), [0.2, 1.5]).collect()}
    for k, h in enumerate([0.2, 1.5]):
        w = np.exp(-(d**2) / (2 * h * h))
        np.fill_diagonal(w, 0)
        votes = np.stack([w[:, g == x].sum(1) for x in range(3)], 1)
        assert [got[i][f"predicted{k}"] for i in range(80)] == votes.argmax(1).tolist()


def test_f9_f32_kernel_means_are_summed_in_tiles(spark, no_pairs):
    from curvelake.operators import models

    c, v = curves(spark, 80)
    d, y, z = distances(c, v), np.arange(80) % 3.0, v[:, 0]
    table = c.df.select("id", F.col("label").cast("double").alias("y"), F.col("values")[0].alias("z"))
    w = np.exp(-(d**2) / 2) * np.exp(-(((z[:, None] - z) / 0.2) ** 2) / 2)
    np.fill_diagonal(w, 0)
    want = np.where(w.sum(1) > 1e-15, w @ y / np.maximum(w.sum(1), 1e-300), y)
    got = {r["id"]: r["fit"] for r in models.mixed_kernel(c, table, 1.0, 0.2).collect()}
    assert np.allclose([got[i] for i in range(80)], want)
    for h, mse in models.kernel_cv(c, table.select("id", "y"), (0.3, 1.0)):
        w = np.exp(-(d**2) / (2 * h * h))
        np.fill_diagonal(w, 0)
        fit = np.where(w.sum(1) > 1e-15, w @ y / np.maximum(w.sum(1), 1e-300), y)
        assert np.isclose(mse, ((y - fit) ** 2).mean())


def test_f8_f11_f20_f21_a_block_sends_its_nearest_only(spark, no_pairs):
    from curvelake.operators import apply, metrics

    c, v = curves(spark, 70)
    rows = [(i, v[i % 50].tolist()) for i in range(70)]  # copies: ties go to the lower id
    df = spark.createDataFrame(rows, "id long, values array<double>").repartition(4)
    x = np.array([r[1] for r in rows])
    d = distances(c, x)
    got = apply.nearest(df, metrics.lp(c.weights), 4, 16).collect()
    for i in range(70):
        want = sorted((round(d[i, j], 9), j) for j in range(70) if j != i)[:4]
        mine = sorted((r["rank"], round(r["d"], 9), r["j"]) for r in got if r["i"] == i)
        assert [m[1:] for m in mine] == want
    few = apply.nearest(df.where("id < 3"), metrics.euclidean(), 9).collect()
    assert sorted((r["i"], r["j"]) for r in few) == [(i, j) for i in range(3) for j in range(3) if i != j]


def test_f22_f29_large_tables_have_wide_blocks():
    from curvelake.operators import apply

    assert apply._block_count(615_384, apply.BLOCK) == 38 and apply._block_count(102_564, apply.BLOCK) == 26
    assert apply._block_count(615_384, apply.BLOCK, 1024) == 151 and apply._block_count(10_000, 64, 64) == 157


@pytest.mark.parametrize("name", "silhouette_score knn_classify_from_distances kernel_classify_from_distances fclassif_kernel knn_loocv fregre_np_cv fregre_np_mixed".split())
def test_sums_in_tiles_equal_their_sql(spark, no_pairs, name):
    import duckdb

    from curvelake.plans import registry

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("the driver's tables are not here")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'" if os.path.isdir(f"{folder}/embeddings.parquet") else f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    got, want = registry.queries()[name](spark, folder).toPandas(), con.execute(registry.oracle_sql()[name]).df()
    got, want = (f[sorted(f.columns)].sort_values(sorted(f.columns)[-1 if "id" not in f.columns else list(sorted(f.columns)).index("id")]).reset_index(drop=True) for f in (got, want))
    assert list(got.columns) == list(want.columns) and len(got) == len(want) > 0
    for k in got.columns:
        assert np.allclose(got[k].astype(float), want[k].astype(float), rtol=0, atol=2e-6), k


def test_f3_medoids_are_summed_in_tiles(spark, no_pairs):
    from curvelake.operators import cluster

    c, v = curves(spark, 100)
    d = distances(c, v)
    seeds = [r["id"] for r in c.df.orderBy(F.xxhash64(F.lit(1), "id"), "id").limit(4).collect()]
    medoids = sorted(seeds)
    for _ in range(50):
        own = np.array(medoids)[d[:, medoids].argmin(1)]
        new = sorted(min((round(d[i, own == m].sum(), 12), i) for i in np.flatnonzero(own == m))[1] for m in medoids)
        if new == medoids:
            break
        medoids = new
    got = {r["id"]: r["medoid"] for r in cluster.kmedoids(c, 4).collect()}
    assert [got[i] for i in range(100)] == own.tolist()


def test_f7_tiles_send_spanning_forests(spark, no_pairs):
    from curvelake.operators import apply, cluster, metrics

    r = np.random.default_rng(8)
    x = np.concatenate([r.normal(0, 0.3, (60, 3)), r.normal(4, 0.3, (50, 3)), r.uniform(-8, 8, (20, 3))])
    c = Curves(spark.createDataFrame([(int(i), x[i].tolist()) for i in r.permutation(130)], "id long, values array<double>").repartition(3), nm.unit_grid(3))
    d = distances(c, x)
    for eps, least in [(0.25, 4), (0.6, 5), (0.05, 2)]:
        i, j = np.triu_indices(130, 1)
        table = spark.createDataFrame([(int(a), int(b), float(d[a, b])) for a, b in zip(i, j)], "i long, j long, d double")
        # by hand: components of core points, numbered by least id; border points take the lowest
        near = d <= eps
        core, label = np.flatnonzero(near.sum(1) >= least), {}
        for a in core:
            if a not in label:
                todo, label[a] = [a], len(set(label.values()))
                while todo:
                    y = todo.pop()
                    for b in core:
                        if near[y, b] and b not in label:
                            label[b] = label[a]
                            todo.append(b)
        want = [label.get(a, min((label[b] for b in core if near[a, b]), default=None)) for a in range(130)]
        for got in (cluster.dbscan_of(c, eps, least), cluster.dbscan(table, c.df.select("id"), eps, least)):
            got = {q["id"]: q["cluster"] for q in got.collect()}
            assert [got[a] for a in range(130)] == want
    every = lambda a, b: metrics.lp(c.weights)(a, b) <= 100.0  # noqa: E731  8,385 pairs
    assert apply.pair_forest(c.df, every).count() == 129
    assert apply.pair_forest(c.df, every, 16).count() < 45 * 32  # fewer than curves in every tile of nine blocks


def test_f12_f13_kernels_of_a_few_curves_at_a_time(spark, monkeypatch):
    from curvelake.operators import apply, depth

    c, v = curves(spark, 60)
    seen = []
    monkeypatch.setattr(depth, "against_pairs", lambda df, fn, schema, rows, reference: seen.append((rows, reference)) or apply.against_pairs(df, fn, schema, 7, 20))
    got = {r["id"]: r["depth"] for r in depth.kernel_spatial_all(c, 1.0).collect()}
    assert seen[0][0] <= apply.BLOCK  # 17 MB for each of a task's kernels with a block of 4,096
    k = np.exp(-(distances(c, v) ** 2))
    for i in (0, 13, 40):
        u = np.where(np.arange(60) == i, 0, 1 / np.sqrt(np.maximum(2 - 2 * k[i], 1e-300)))
        u[i] = 0
        assert np.isclose(got[i], 1 - np.sqrt((u[:, None] * u * (1 + k - k[i] - k[i][:, None])).sum()) / 60)
