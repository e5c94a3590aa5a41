"""Statistical process monitoring of curves: charts, limits, run rules, sequential statistics."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvelake.functions import special
from curvelake.operators.apply import held, matrix, numbered, order_statistics, per_curve, sums
from curvelake.operators.reduce import Fpca, fpca
from curvelake.sources.curves import Curves


@dataclass
class Chart:
    model: Fpca
    t2_limit: float
    spe_limit: float
    alpha: float


def statistics(c: Curves, model: Fpca, floor: float = 0.0) -> DataFrame:
    """All columns but values, with scores, t2 and spe (Simpson-weighted squared residual)."""
    lam = np.maximum(model.eigenvalues, floor) if floor else model.eigenvalues
    if (lam <= 0).any():
        raise ValueError("an eigenvalue is not positive")

    def kernel(v):
        s = model.project(v)
        return s, (s**2 / lam).sum(1), (v - model.rebuild(s)) ** 2 @ model.weights

    return per_curve(c.df, kernel, "scores array<double>, t2 double, spe double")


def t2_limit(alpha: float, k: int) -> float:
    return special.chi2_quantile(1 - alpha, k)


def spe_limit(mean: float, variance: float, alpha: float) -> float:
    """a chi2(1 - alpha, ceil b) with a = var / 2 mean, b = 2 mean^2 / var."""
    return variance / (2 * mean) * special.chi2_quantile(1 - alpha, math.ceil(2 * mean * mean / variance))


def spe_fit(stats: DataFrame) -> DataFrame:
    """Moments of SPE, and the excess kurtosis against that of the matched chi-square, 12 / b."""
    m = stats.agg(F.avg("spe").alias("mean"), F.var_samp("spe").alias("variance"), F.kurtosis("spe").alias("kurtosis"))
    return m.withColumn("expected", 12 / (2 * F.col("mean") * F.col("mean") / F.col("variance")))


def phase1(c: Curves, k: int = 3, alpha: float = 0.05, tuning: float = 0.5, seed: int = 42) -> tuple[Chart, DataFrame]:
    """A split by hashed id: one part fits the components, the other gives the SPE limit.
    (chart, statistics of the calibration part)"""
    share = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1_000_000)) / 1_000_000
    model = fpca(c.with_df(c.df.where(share < tuning)), k)
    stats = statistics(c.with_df(c.df.where(share >= tuning)), model)
    m = stats.agg(F.avg("spe").alias("m"), F.var_samp("spe").alias("v")).first()
    return Chart(model, t2_limit(alpha, len(model.singular)), spe_limit(m["m"], m["v"], alpha), alpha), stats


def monitor(c: Curves, chart: Chart) -> DataFrame:
    s = statistics(c, chart.model)
    return s.withColumn("t2_alarm", F.col("t2") > chart.t2_limit).withColumn("spe_alarm", F.col("spe") > chart.spe_limit)


def phase1_iterative(c: Curves, k: int = 3, alpha: float = 0.05, rounds: int = 10, budget: float = 0.5, seed: int = 42) -> tuple[Chart, DataFrame]:
    """Charts rebuilt without alarms until none is flagged, the removal budget would be
    exceeded, or fewer than four curves would stay: (chart, ids kept).

    The curves kept are those that no chart so far flags, so a round's plan is one kernel over
    the table, whatever the number of rounds, and only charts come to the driver.
    """
    passed: list[Chart] = []
    with held(c.df.select("id", "values")) as df:
        n = df.count()
        for _ in range(rounds):
            kept = unflagged(df, passed)
            chart, _ = phase1(c.with_df(kept), k, alpha, seed=seed)
            now, bad = sums(kept, lambda v, chart=chart: [np.array([len(v), flagged(v, chart).sum()])], ["values"])[0]
            if not bad or n - now + bad > budget * n or now - bad < 4:
                break
            passed.append(chart)
    return chart, unflagged(c.df.select("id", "values"), passed).select("id")


def flagged(v: np.ndarray, chart: Chart) -> np.ndarray:
    """Whether a curve's T2 or SPE is above its limit, or no number."""
    m = chart.model
    s = m.project(v)
    return ~(((s**2 / m.eigenvalues).sum(1) <= chart.t2_limit) & ((v - m.rebuild(s)) ** 2 @ m.weights <= chart.spe_limit))


def unflagged(df: DataFrame, charts: list[Chart]) -> DataFrame:
    """The rows (id, values) that none of the charts flags."""
    charts = list(charts)

    def run(batches):
        for batch in batches:
            for chart in charts:
                if batch.num_rows:
                    batch = batch.filter(pa.array(~flagged(matrix(batch.column("values")), chart)))
            yield batch

    return df.mapInArrow(run, df.schema) if charts else df


def robust_limit(stats: DataFrame, column: str, alpha: float = 0.05, how: str = "empirical", n_boot: int = 200, seed: int = 1) -> float:
    """Upper limit of a statistic: sorted[ceil(p n) - 1], the median of bootstrap quantiles, or a
    kernel density root. Bootstrap and kernel forms take a sample of 10000 values at most."""
    p = 1 - alpha
    if how == "empirical":
        return order_statistics(stats, column, [math.ceil(p * stats.count()) - 1])[0]
    x = np.sort([r[0] for r in stats.orderBy(F.xxhash64("id")).select(column).limit(10_000).collect()])
    if how == "bootstrap":
        q = [np.sort(np.random.default_rng(seed + b).choice(x, len(x)))[math.ceil(p * len(x)) - 1] for b in range(n_boot)]
        return float(np.median(q))
    if how == "kde":
        h = 1.06 * x.std(ddof=1) * len(x) ** -0.2
        return special.inverse(lambda u: float(np.mean([special.normal_cdf((u - y) / h) for y in x])), p, float(x.min()), float(x.max()))
    raise ValueError(f"no limit {how}")


def t2_by_component(stats: DataFrame, model: Fpca) -> DataFrame:
    lam = [float(x) for x in model.eigenvalues]
    return stats.withColumn("contributions", F.zip_with("scores", F.lit(lam), lambda s, v: s * s / v))


def significant_components(stats: DataFrame, model: Fpca, alpha: float = 0.05) -> DataFrame:
    limit = special.chi2_quantile(1 - alpha / len(model.singular), 1)
    return t2_by_component(stats, model).withColumn("significant", F.transform("contributions", lambda x: x > limit))


def choose_components(eigenvalues, how: str = "variance", share: float = 0.95) -> int:
    e = np.asarray(eigenvalues, float)
    if how == "variance":
        return int(np.searchsorted(np.cumsum(e) / e.sum(), share - 1e-12) + 1)
    if how == "kaiser":
        return max(1, int((e > e.mean()).sum()))
    if how == "elbow":
        return int(np.argmax(np.diff(e, 2)) + 1) if len(e) > 2 else len(e)
    raise ValueError(f"no rule {how}")


def partial(values, seen: int, model: Fpca, how: str = "blup", noise: float = 1e-6) -> np.ndarray:
    """Scores of a curve of which the first ``seen`` points are known."""
    phi, lam = model.loadings[:seen], model.eigenvalues
    r = np.asarray(values[:seen]) - model.mean[:seen]
    if how == "blup":
        return lam * (phi.T @ np.linalg.solve(phi * lam @ phi.T + noise * np.eye(seen), r))
    if how == "projection":
        return np.linalg.lstsq(phi, r, rcond=None)[0]
    return r * model.weights[:seen] @ phi  # zero pad


# ---- run rules; rows (t, v) in the order of t ----


def run_rules(df: DataFrame, center: float, sigma: float, rules: tuple[str, ...] = ("WE1", "WE2", "WE3", "WE4"), order: str = "t", by: str | None = None) -> DataFrame:
    """(rule, start): each window that violates a rule, by the order of its first point."""
    part = Window.partitionBy(by if by else F.lit(0)).orderBy(order)
    z = (F.col("v") - center) / sigma
    rows = df.withColumn("z", z).withColumn("up", F.col("v") > F.lag("v").over(part)).withColumn("down", F.col("v") < F.lag("v").over(part))

    def ahead(k: int):
        return part.rowsBetween(0, k - 1)

    def count(cond: Column, k: int) -> Column:
        return F.when(F.count("*").over(ahead(k)) == k, F.sum(F.when(cond, 1).otherwise(0)).over(ahead(k)))

    def steps(name: str, k: int) -> Column:
        """Steps of a kind among the k - 1 that follow a point."""
        return F.when(F.count("*").over(ahead(k)) == k, F.sum(F.when(F.col(name), 1).otherwise(0)).over(part.rowsBetween(1, k - 1)))

    turn = (F.col("up") & F.lag("down").over(part)) | (F.col("down") & F.lag("up").over(part))
    rows = rows.withColumn("turn", turn)
    tests = {
        "WE1": F.abs("z") > 3,
        "WE2": F.greatest(count(F.col("z") > 2, 3), count(F.col("z") < -2, 3)) >= 2,
        "WE3": F.greatest(count(F.col("z") > 1, 5), count(F.col("z") < -1, 5)) >= 4,
        "WE4": F.greatest(count(F.col("z") > 0, 8), count(F.col("z") < 0, 8)) >= 8,
        "Nelson5": F.greatest(steps("up", 6), steps("down", 6)) >= 5,
        "Nelson6": F.when(F.count("*").over(ahead(14)) == 14, F.sum(F.when(F.col("turn"), 1).otherwise(0)).over(part.rowsBetween(2, 13)) >= 12),
        "Nelson7": count(F.abs("z") <= 1, 15) >= 15,
    }
    unknown = set(rules) - set(tests)
    if unknown:
        raise ValueError(f"no rules {sorted(unknown)}")
    hit = F.array_compact(F.array(*[F.when(F.coalesce(tests[r], F.lit(False)), F.lit(r)) for r in rules]))
    keep = [F.col(by)] if by else []
    return rows.withColumn("_hit", hit).select(*keep, F.col(order).alias("start"), F.explode("_hit").alias("rule"))


# ---- sequential statistics: a group's rows in order, one pass ----


def ewma_state(z, s, lam: float):
    return lam * s + (1 - lam) * z


def mewma_step(z, s, lam: float, eig, t: int, exact: bool):
    z = ewma_state(z, s, lam)
    f = lam / (2 - lam) * (1 - (1 - lam) ** (2 * t) if exact else 1)
    return z, float((z**2 / (eig * f)).sum())


def amewma_step(z, s, last: float, var, eig, low: float, high: float, eta: float):
    """Adaptive weight from the last step's error; its covariance follows exactly."""
    z = ewma_state(z, s, last)
    var = last**2 + (1 - last) ** 2 * var
    t2 = float((z**2 / (eig * var)).sum())
    error = float(np.sqrt(((s - z) ** 2 / eig).mean()))
    return z, min(high, max(low, eta * error)), var, t2


def mcusum_step(c, s, k: float, eig):
    """Crosier's rule: the sum shrinks towards zero by k in the metric of the eigenvalues."""
    y = c + s
    size = math.sqrt(float((y**2 / eig).sum()))
    c = np.zeros_like(y) if size <= k else y * (1 - k / size)
    return c, math.sqrt(float((c**2 / eig).sum()))


def cusum_step(hi, lo, s, k: float, eig):
    u = s / np.sqrt(eig)
    hi, lo = np.maximum(0, hi + u - k), np.maximum(0, lo - u - k)
    return hi, lo, float(max(hi.max(), lo.max()))


#: Rows of a series that one task carries on; a chunk's state is a few numbers.
CHUNK = 50_000


def charted(stats: DataFrame, eig, how: str = "mewma", limit: float = math.inf, order: str = "id", lam: float = 0.2, k: float = 0.5, exact: bool = False, chunk: int = CHUNK) -> DataFrame:
    """order, statistic, alarm of one series of scores, whatever its length: moving averages
    (ewma, mewma) and cumulative sums without restarts (cusum).

    Both are compositions of simple maps, a scaling with a shift or a shift with a floor, so a
    chunk of rows is one such map.  Rows are numbered by buckets, each chunk becomes its map,
    the maps (a row for every ``chunk`` rows) give the state that each chunk starts from, and
    every chunk then goes on from its own.
    """
    import pandas as pd

    if how not in ("ewma", "mewma", "cusum"):
        raise ValueError(f"no composition for {how}")
    eig = np.asarray(eig, float)
    d, moving = len(eig), how != "cusum"
    rows = numbered(stats.select(F.col(order).alias("_o"), F.col(order).cast("double").alias("_v"), "scores"), "_v", "_o", name="t")
    rows = rows.select(F.floor((F.col("t") - 1) / chunk).cast("long").alias("chunk"), "t", "_o", "scores").persist()

    def walk(scores, state):
        """States after each row, from a start: averages, or upper and lower sums."""
        out = np.empty((len(scores), len(state)))
        for i, s in enumerate(scores):
            if moving:
                state = ewma_state(state, s, lam)
            else:
                u = s / np.sqrt(eig)
                state = np.maximum(0, state + np.concatenate([u, -u]) - k)
            out[i] = state
        return out

    def as_map(pdf):
        """(scale, shift, floor): the state after the chunk is max(floor, scale x start + shift)."""
        scores = np.stack(pdf.sort_values("t")["scores"].to_numpy())
        if moving:
            scale, shift, floor = (1 - lam) ** len(scores), walk(scores, np.zeros(d))[-1], np.full(d, -np.inf)
        else:
            u = scores / np.sqrt(eig)
            both = np.hstack([u, -u]) - k
            scale, shift, floor = 1.0, both.sum(0), walk(scores, np.zeros(2 * d))[-1]
        return pd.DataFrame({"chunk": [int(pdf["chunk"].iloc[0])], "scale": [scale], "shift": [shift], "floor": [floor]})

    def starts(pdf):
        state, out = np.zeros(d if moving else 2 * d), []
        pdf = pdf.sort_values("chunk")
        for scale, shift, floor in zip(pdf["scale"], pdf["shift"], pdf["floor"], strict=True):
            out.append(state)
            state = np.maximum(np.asarray(floor), scale * state + np.asarray(shift))
        return pd.DataFrame({"chunk": pdf["chunk"], "start": out})

    def go_on(pdf):
        pdf = pdf.sort_values("t")
        states = walk(np.stack(pdf["scores"].to_numpy()), np.array(pdf["start"].iloc[0]))
        if moving:
            t = pdf["t"].to_numpy()[:, None]
            f = lam / (2 - lam) * ((1 - (1 - lam) ** (2 * t)) if exact else 1)
            stat = (states**2 / (eig * f)).sum(1)
        else:
            stat = states.max(1)
        return pd.DataFrame({"_o": pdf["_o"], "statistic": stat})

    maps = rows.groupBy("chunk").applyInPandas(as_map, "chunk long, scale double, shift array<double>, floor array<double>")
    begun = maps.groupBy(F.lit(0).alias("_g")).applyInPandas(starts, "chunk long, start array<double>")  # a row for every chunk of rows
    out = rows.join(begun, "chunk").groupBy("chunk").applyInPandas(go_on, f"_o {dict(stats.dtypes)[order]}, statistic double")
    return out.select(F.col("_o").alias(order), "statistic", (F.col("statistic") > limit).alias("alarm"))


def sequential(stats: DataFrame, eig, how: str = "mewma", limit: float = math.inf, by: str | None = None, order: str = "id", restart: bool = False, **p) -> DataFrame:
    """order, statistic, alarm for each group's rows in order (one group without ``by``)."""
    import pandas as pd

    eig = np.asarray(eig, float)

    def run(pdf):
        pdf = pdf.sort_values(order)
        d = len(eig)
        z, hi, lo, c, lam, var, t, out = np.zeros(d), np.zeros(d), np.zeros(d), np.zeros(d), p.get("low", 0.05), 0.0, 0, []
        for s in pdf["scores"]:
            s, t = np.asarray(s, float), t + 1
            if how in ("ewma", "mewma"):
                z, stat = mewma_step(z, s, p.get("lam", 0.2), eig, t, p.get("exact", False))
            elif how == "amewma":
                z, lam, var, stat = amewma_step(z, s, lam, var, eig, p.get("low", 0.05), p.get("high", 0.95), p.get("eta", 0.3))
            elif how == "mcusum":
                c, stat = mcusum_step(c, s, p.get("k", 0.5), eig)
            elif how == "cusum":
                hi, lo, stat = cusum_step(hi, lo, s, p.get("k", 0.5), eig)
            else:
                raise ValueError(f"no statistic {how}")
            out.append(stat)
            if restart and stat > limit:
                z, hi, lo, c, t = np.zeros(d), np.zeros(d), np.zeros(d), np.zeros(d), 0
        got = pd.DataFrame({order: pdf[order], "statistic": out})
        got["alarm"] = got["statistic"] > limit
        if by:
            got.insert(0, by, pdf[by])
        return got

    kinds = dict(stats.dtypes)
    schema = (f"{by} {kinds[by]}, " if by else "") + f"{order} {kinds[order]}, statistic double, alarm boolean"
    return stats.groupBy(by if by else F.lit(0).alias("_g")).applyInPandas(run, schema)


def run_length(spark, limit: float, eig, shift=None, lam: float = 1.0, reps: int = 1000, longest: int = 10_000, seed: int = 1) -> float:
    """Mean run length of a T2 chart (lam 1) or its EWMA, by simulation with a seed per replicate."""
    import pandas as pd

    eig = np.asarray(eig, float)
    mu = np.zeros(len(eig)) if shift is None else np.asarray(shift, float)

    def one(b: int) -> int:
        r, z = np.random.default_rng(seed + b), np.zeros(len(eig))
        for t in range(1, longest + 1):
            z, stat = mewma_step(z, mu + r.standard_normal(len(eig)) * np.sqrt(eig), lam, eig, t, lam == 1.0)
            if stat > limit:
                return t
        return longest

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"n": [one(int(b)) for b in pdf["id"]]})

    return spark.range(reps).mapInPandas(run, "n long").agg(F.avg("n")).first()[0]


def spe_by_variable(parts: list[Curves], rebuilt: list[DataFrame]) -> DataFrame:
    """id, spe0, spe1, ...: integrated squared residuals of each variable."""
    out = None
    for k, (c, r) in enumerate(zip(parts, rebuilt, strict=True)):
        both = c.df.select("id", "values").join(r.select("id", F.col("values").alias("fit")), "id").withColumn("e", F.zip_with("values", "fit", lambda a, b: a - b))
        own = per_curve(both.select("id", "e"), lambda e, w=c.weights: e**2 @ w, f"spe{k} double", values="e")
        out = own if out is None else out.join(own, "id")
    return out
