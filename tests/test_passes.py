"""How often a table is computed, and kernels over several rows at once."""

import numpy as np
import pytest

from curvelake.functions import numeric as nm
from curvelake.operators import apply, elastic, metrics, selection
from curvelake.sources.curves import Curves


@pytest.mark.parametrize("fit", [elastic.warp_statistics, elastic.horizontal_fpca])
def test_f41_f43_f44_warps_are_computed_once(spark, fit):
    t = nm.unit_grid(9)
    seen = spark.sparkContext.accumulator(0)

    def warp(v):
        seen.add(len(v))
        return np.array([t ** (1 + x[0] / 8) for x in v])

    df = spark.createDataFrame([(i, [float(i)]) for i in range(6)], "id long, values array<double>").repartition(3)
    fit(apply.per_curve(df, warp, "warp array<double>"), t)
    assert seen.value <= 12  # once to see that they are few, once to hold them


def test_f33_irregular_distances_of_one_curve_and_many(spark):
    r = np.random.default_rng(4)
    rows = []
    for i in range(60):
        n = int(r.integers(1, 9))
        rows += [(i, float(x), float(y)) for x, y in zip(np.round(r.uniform(i % 7, 10, n), 1), r.normal(size=n))]
        rows.append((i, rows[-1][1], 0.5))  # two values at one time
    p = metrics.sorted_points(spark.createDataFrame(rows, "id long, t double, v double")).cache()
    of = {q["id"]: (np.array(q["t"]), np.array(q["v"])) for q in p.collect()}
    got = {(q["i"], q["j"]): q["d"] for q in metrics.cross_irregular(p.where("id % 5 = 0"), p).collect()}
    assert set(got) == {(i, j) for i in range(0, 60, 5) for j in range(i + 1, 60)}
    for k, d in got.items():
        assert np.isclose(d, metrics.lp_irregular(*of[k[0]], *of[k[1]]), rtol=1e-12, equal_nan=True)
    t, v = (np.concatenate([of[i][k] for i in range(60)]) for k in (0, 1))
    first = np.cumsum([0, *(len(of[i][0]) for i in range(60))])
    one = metrics.lp_irregular_many(*of[9], t, v, first, 1.0)
    assert np.allclose(one, [metrics.lp_irregular(*of[9], *of[i], 1.0) for i in range(60)], rtol=1e-12, equal_nan=True)


def test_f38_predictors_are_summed_twice(spark):
    r, grid, seen = np.random.default_rng(5), nm.unit_grid(6), spark.sparkContext.accumulator(0)
    df = spark.createDataFrame([(i, float(r.normal()), r.normal(size=6).tolist()) for i in range(40)], "id long, y double, values array<double>").repartition(3)

    def same(v):
        seen.add(len(v))
        return v

    c = [Curves(apply.per_curve(df.select("id", "y", "values"), same, "v array<double>").withColumnRenamed("v", "values"), grid) for _ in range(3)]
    selection.select(c, "y", 2)
    assert seen.value <= 2 * 3 * 40
    once = selection.scores(selection.gathered(c, "y"), [grid] * 3, 2)
    seen.value = 0
    for how in ("lasso", "scad", "mcp"):
        one, other = selection.select(once, how=how), selection.select(c, "y", 2, how=how)
        assert np.allclose(np.concatenate(one.coef), np.concatenate(other.coef)) and one.lam == other.lam
    assert seen.value <= 3 * 2 * 3 * 40  # the sums at hand read nothing


def test_f38_variable_selection_reads_its_tables_twice(spark, monkeypatch):
    from curvelake.plans import registry

    passes, added = [], apply._added
    monkeypatch.setattr(apply, "_added", lambda *a: passes.append(1) or added(*a))
    assert registry.queries()["variable_selection"](spark, "/root/testdata/sf0.001").count() == 15
    assert len(passes) <= 2


def test_f39_smoothed_curves_are_computed_once_and_apart(spark, monkeypatch):
    from curvelake.plans import others, shaped

    seen, r = spark.sparkContext.accumulator(0), np.random.default_rng(6)
    rows = [(i, np.sin(shaped.T / 9 + r.uniform(-0.5, 0.5)).tolist()) for i in range(6)]

    def same(v):
        seen.add(len(v))
        return v

    def smoothed(spark, d):
        df = spark.createDataFrame(rows, "id long, values array<double>")
        return Curves(apply.per_curve(df, same, "v array<double>").withColumnRenamed("v", "values"), shaped.T)

    monkeypatch.setattr(shaped, "_smoothed", smoothed)
    monkeypatch.setattr(others, "_smoothed", smoothed)
    plan = shaped._aligned(spark, "")
    assert plan.count() == 6 and seen.value == 6
    want = elastic.align_to(smoothed(spark, ""), np.mean([v for _, v in rows], 0), band=shaped.BAND)
    for a, b in zip(plan.orderBy("id").collect(), want.orderBy("id").collect(), strict=True):
        assert a["values"] == rows[a["id"]][1] and np.allclose(a["warp"], b["warp"]) and np.allclose(a["aligned"], b["aligned"])
