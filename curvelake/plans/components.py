"""SQL of principal components and of models on their scores, and the queries it proves.

Components come from the weighted scatter matrix raised to the 4,096th power by repeated
squaring: its rows are then the leading vector, which is taken out before the next one.
Least squares on scores needs no matrix, as scores are uncorrelated; other models iterate
weighted normal equations, solved by elimination column by column.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from curvelake.operators import monitor, reduce, regress
from curvelake.plans.basics import named
from curvelake.plans.registry import _C, _WEIGHTS, EMB, _z, curve_rows, rounded, rows

SQUARINGS, STEPS = 12, 16


def components(k: int) -> str:
    """CTEs: l (pos, l1..lk: loadings), ev (e1..ek: eigenvalues of the scatter), mu (pos, m) and
    x (id, label, s1..sk: scores) of the curves c."""
    out = [_C, _WEIGHTS, "mu AS MATERIALIZED (SELECT pos, avg(v) AS m FROM c GROUP BY pos)", "z AS MATERIALIZED (SELECT id, pos, (v - m) * sqrt(w) AS z FROM c JOIN mu USING (pos) JOIN w USING (pos))", "m1 AS MATERIALIZED (SELECT a.pos AS i, b.pos AS j, sum(a.z * b.z) AS v FROM z a JOIN z b USING (id) GROUP BY a.pos, b.pos)"]
    for n in range(1, k + 1):
        last = f"m{n}"
        for s in range(SQUARINGS):
            out.append(f"q{n}_{s} AS MATERIALIZED (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM {last} a JOIN {last} b ON a.j = b.i GROUP BY a.i, b.j)")
            out.append(f"p{n}_{s} AS MATERIALIZED (SELECT i, j, v / (SELECT sum(v) FROM q{n}_{s} WHERE i = j) AS v FROM q{n}_{s})")
            last = f"p{n}_{s}"
        out.append(f"u{n} AS MATERIALIZED (SELECT i, v / sqrt(sum(v * v) OVER ()) AS v FROM {last} WHERE j = (SELECT arg_max(i, v) FROM {last} WHERE i = j))")
        out.append(f"v{n} AS MATERIALIZED (SELECT i, v * (SELECT sign(arg_max(v, abs(v))) FROM u{n}) AS v FROM u{n})")
        out.append(f"e{n} AS MATERIALIZED (SELECT sum(a.v * m{n}.v * b.v) AS e FROM m{n} JOIN v{n} a ON a.i = m{n}.i JOIN v{n} b ON b.i = m{n}.j)")
        out.append(f"m{n + 1} AS MATERIALIZED (SELECT m{n}.i, m{n}.j, m{n}.v - e * a.v * b.v AS v FROM m{n} JOIN v{n} a ON a.i = m{n}.i JOIN v{n} b ON b.i = m{n}.j, e{n})")
    some = range(1, k + 1)
    out.append("l AS MATERIALIZED (SELECT w.pos, " + ", ".join(f"v{n}.v / sqrt(w) AS l{n}" for n in some) + " FROM w " + " ".join(f"JOIN v{n} ON v{n}.i = w.pos" for n in some) + ")")
    out.append("ev AS MATERIALIZED (SELECT " + ", ".join(f"e{n}.e AS e{n}" for n in some) + " FROM " + ", ".join(f"e{n}" for n in some) + ")")
    out.append("x AS MATERIALIZED (SELECT id, any_value(label) AS label, " + ", ".join(f"sum((v - m) * w * l{n}) AS s{n}" for n in some) + " FROM c JOIN mu USING (pos) JOIN w USING (pos) JOIN l USING (pos) GROUP BY id)")
    return ",\n".join(out)


def solved(p: int, source: str) -> str:
    """SELECT of x0..x(p-1) from a row of symmetric a{i}_{j} (i <= j) and b{i}."""
    at = lambda i, j: f"a{min(i, j)}_{max(i, j)}"
    sql = source
    for k in range(p - 1):
        kept = [at(i, j) for i in range(k + 1) for j in range(i, p)] + [f"b{i}" for i in range(k + 1)]
        new = [f"{at(i, j)} - {at(k, i)} * {at(k, j)} / {at(k, k)} AS {at(i, j)}" for i in range(k + 1, p) for j in range(i, p)] + [f"b{i} - {at(k, i)} * b{k} / {at(k, k)} AS b{i}" for i in range(k + 1, p)]
        sql = f"(SELECT {', '.join(kept + new)} FROM {sql})"
    for k in range(p - 1, -1, -1):
        sql = f"(SELECT *, (b{k}{''.join(f' - {at(k, j)} * x{j}' for j in range(k + 1, p))}) / {at(k, k)} AS x{k} FROM {sql})"
    return f"SELECT {', '.join(f'x{k}' for k in range(p))} FROM {sql}"


def least_squares(k: int, y: str) -> str:
    """CTE co (c0: intercept, c1..ck) of y on centred, uncorrelated scores."""
    return f"co AS MATERIALIZED (SELECT avg({y}) AS c0, " + ", ".join(f"sum(s{n} * {y}) / sum(s{n} * s{n}) AS c{n}" for n in range(1, k + 1)) + " FROM x)"


#: Of each family: the mean of the predictor e, its derivative and the variance in the mean m.
FAMILIES = {"binomial": ("1 / (1 + exp(-e))", "m * (1 - m)", "m * (1 - m)"), "poisson": ("exp(greatest(least(e, 30), -30))", "m", "m")}


def reweighted(k: int, y: str, family: str) -> str:
    """CTE co of a generalised linear model by iteratively reweighted least squares."""
    mean, slope, variance = FAMILIES[family]
    p = k + 1
    term = ["1"] + [f"s{n}" for n in range(1, p)]
    out = ["o0 AS MATERIALIZED (SELECT " + ", ".join(f"0.0::DOUBLE AS x{i}" for i in range(p)) + ")"]
    for s in range(1, STEPS + 1):
        eta = " + ".join(f"x{i} * {t}" for i, t in enumerate(term))
        sums = ", ".join([f"sum(w * {term[i]} * {term[j]}){' + 1e-10' if i == j else ''} AS a{i}_{j}" for i in range(p) for j in range(i, p)] + [f"sum(w * {term[i]} * (e + (y - m) / d)) AS b{i}" for i in range(p)])
        out.append(f"n{s} AS MATERIALIZED (SELECT {sums} FROM (SELECT *, d * d / greatest({variance}, 1e-10) AS w FROM (SELECT *, greatest({slope}, 1e-10) AS d FROM (SELECT *, {mean} AS m FROM (SELECT x.*, {y} AS y, {eta} AS e FROM x, o{s - 1})))))")
        out.append(f"o{s} AS MATERIALIZED ({solved(p, f'n{s}')})")
    out.append("co AS MATERIALIZED (SELECT " + ", ".join(f"x{i} AS c{i}" for i in range(p)) + f" FROM o{STEPS})")
    return ",\n".join(out)


def _line(k: int) -> str:
    return "c0 + " + " + ".join(f"c{n} * s{n}" for n in range(1, k + 1))


def _listed(df, column: str, *keep: str):
    return rounded(df.select("id", *keep, F.posexplode(column).alias("k", "value")))


def _scores_sql(k: int) -> str:
    return f"WITH {components(k)} " + " UNION ALL ".join(f"SELECT id, {n - 1}::INT AS k, {_z(f's{n}')} AS value FROM x" for n in range(1, k + 1))


def _fit(c, y: str, how: str, k: int):
    model = regress.linear(c, y, k) if how == "linear" else regress.glm(c, y, how, k)
    return model.predict(c)


def _binary(spark, d):
    c = EMB(spark, d)
    return c.with_df(c.df.withColumn("y", (F.col("label") < 5).cast("double")))


named("fpca_scores", _scores_sql(5), lambda spark, d: (lambda c: _listed(reduce.scores(c, reduce.fpca(c, 5)), "scores"))(EMB(spark, d)))
named("fpca_loadings", f"WITH {components(3)} SELECT pos::INT AS pos, {_z('m')} AS mean, " + ", ".join(f"{_z(f'l{n}')} AS pc{n}" for n in (1, 2, 3)) + " FROM l JOIN mu USING (pos)", lambda spark, d: (lambda m: curve_rows(spark, m.mean, *m.loadings.T, names=("mean", "pc1", "pc2", "pc3")))(reduce.fpca(EMB(spark, d), 3)))
named("fpca_reconstruct", f"WITH {components(5)} SELECT id, pos::INT AS k, {_z('m + ' + ' + '.join(f's{n} * l{n}' for n in range(1, 6)))} AS value FROM x, l JOIN mu USING (pos)", lambda spark, d: (lambda c, m: _listed(reduce.reconstruct(reduce.scores(c, m), m), "values"))(*(lambda c: (c, reduce.fpca(c, 5)))(EMB(spark, d))))
named("fregre_lm", f"WITH {components(4)}, {least_squares(4, 'label')} SELECT id, label, {_z(_line(4))} AS fit FROM x, co", lambda spark, d: (lambda c: rounded(_fit(c, "label", "linear", 4).select("id", "label", "fit")))(EMB(spark, d)))
named("functional_logistic", f"WITH {components(4)}, {reweighted(4, '(label < 5)::INT', 'binomial')} SELECT id, (label < 5)::DOUBLE AS y, {_z(f'1 / (1 + exp(-({_line(4)})))')} AS fit FROM x, co", lambda spark, d: rounded(_fit(_binary(spark, d), "y", "binomial", 4).select("id", "y", "fit")))
named("functional_poisson", f"WITH {components(3)}, {reweighted(3, 'label', 'poisson')} SELECT id, label, {_z(f'exp({_line(3)})')} AS fit FROM x, co", lambda spark, d: rounded(_fit(EMB(spark, d), "label", "poisson", 3).select("id", "label", "fit")))

# ---- charts of the scores in the order of ids ----

_SERIES = f"{components(3)}, y AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) AS t, s1 / sqrt(e1 / (n - 1)) AS u1, s2 / sqrt(e2 / (n - 1)) AS u2, s3 / sqrt(e3 / (n - 1)) AS u3 FROM x, ev, (SELECT count(*) AS n FROM x))"
_Z = ", ".join(f"sum(0.2 * pow(0.8, a.t - b.t) * b.u{j}) AS z{j}" for j in (1, 2, 3))


def _averages(factor: str) -> str:
    return f"WITH {_SERIES}, q AS (SELECT a.id, any_value(a.t) AS t, {_Z} FROM y a JOIN y b ON b.t <= a.t GROUP BY a.id), r AS (SELECT id, (z1 * z1 + z2 * z2 + z3 * z3) / (0.2 / 1.8 * {factor}) AS s FROM q) SELECT id, {_z('s')} AS statistic, s > {monitor.t2_limit(0.01, 3)!r} AS alarm FROM r"


_U = " UNION ALL ".join(f"SELECT id, t, {sign}u{j} - 0.5 AS u, {j} AS j, '{sign}' AS sign FROM y" for j in (1, 2, 3) for sign in ("", "-"))
_SUMS = f"WITH {_SERIES}, u AS ({_U}), p AS (SELECT *, sum(u) OVER (PARTITION BY j, sign ORDER BY t) AS p FROM u), c AS (SELECT id, p - least(0, min(p) OVER (PARTITION BY j, sign ORDER BY t)) AS c FROM p), r AS (SELECT id, max(c) AS s FROM c GROUP BY id) SELECT id, {_z('s')} AS statistic, s > {monitor.t2_limit(0.01, 3)!r} AS alarm FROM r".replace("c AS (SELECT id, p -", "cs AS (SELECT id, p -").replace("FROM c GROUP BY id) SELECT id, round(s", "FROM cs GROUP BY id) SELECT id, round(s")


def _chart(spark, d, how: str, **options):
    c = EMB(spark, d)
    m = reduce.fpca(c, 3)
    return rounded(monitor.charted(monitor.statistics(c, m).select("id", "scores"), m.eigenvalues, how, monitor.t2_limit(0.01, 3), **options))


named("spm_ewma_monitor", _averages("1"), lambda spark, d: _chart(spark, d, "ewma"))
named("spm_mewma_monitor", _averages("(1 - pow(0.8, 2 * t))"), lambda spark, d: _chart(spark, d, "mewma", exact=True))
named("spm_cusum_monitor", _SUMS, lambda spark, d: _chart(spark, d, "cusum"))
