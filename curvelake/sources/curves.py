"""Curve tables: wide rows (id, values) on one grid, long rows (id, pos, v), irregular rows (id, t, v).

The grid is a driver-side array beside the table, never a column of it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvelake.functions.numeric import as_grid, covariance_kernel, eigenfunctions, eigenvalues, simpson_weights, unit_grid


@dataclass
class Curves:
    """A table of curves: df has id (bigint), values (array<double>) and perhaps others."""

    df: DataFrame
    grid: np.ndarray

    def __post_init__(self):
        self.grid = as_grid(self.grid)

    def __getstate__(self):
        """What goes to executors inside a kernel: the grid, never the table."""
        return {"df": None, "grid": self.grid}

    @property
    def weights(self) -> np.ndarray:
        return simpson_weights(self.grid)

    def long(self) -> DataFrame:
        return self.df.select("id", F.posexplode("values").alias("pos", "v"))

    def with_df(self, df: DataFrame) -> Curves:
        return Curves(df, self.grid)


def from_long(df: DataFrame, grid) -> Curves:
    """Wide curves of long rows (id, pos, v); a curve's points are bounded by the grid."""
    wide = df.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("values"))
    return Curves(wide, grid)


def select_columns(c: Curves, positions) -> Curves:
    keep = sorted(positions)
    return Curves(c.df.withColumn("values", F.array(*[F.col("values")[int(k)] for k in keep])), c.grid[keep])


def invalid(c: Curves) -> DataFrame:
    """The curves without one value for each grid point, or with a null or NaN."""
    return c.df.where(F.col("values").isNull() | (F.size("values") != len(c.grid)) | F.exists("values", lambda x: x.isNull() | F.isnan(x)))


def validate(c: Curves) -> None:
    """Raises ValueError unless every curve has one value for each grid point and none is null or NaN."""
    if not invalid(c).isEmpty():
        raise ValueError(f"curves need {len(c.grid)} finite values each")


# ---- the driver's tables as curves ----


def embeddings(spark: SparkSession, sf_dir: str) -> Curves:
    """Each embedding is a curve on a unit grid; its label stays."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    df = df.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("values"), F.col("label").cast("int").alias("label"))
    return Curves(df, unit_grid(EMBEDDING_POINTS))


EMBEDDING_POINTS = 64
FIRST_YEAR, MONTHS = 1995, 80


def nation_revenue(spark: SparkSession, sf_dir: str) -> Curves:
    """Monthly revenue of each customer nation, 80 months from January 1995."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    pos = (F.year("o_orderdate") - FIRST_YEAR) * 12 + F.month("o_orderdate") - 1
    rows = o.select("o_custkey", "o_totalprice", pos.alias("pos")).where(F.col("pos").between(0, MONTHS - 1))
    sums = rows.join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").cast("long").alias("id"), "pos").agg(F.sum("o_totalprice").alias("v"))
    full = sums.select("id").distinct().withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(MONTHS - 1))))
    return from_long(full.join(sums, ["id", "pos"], "left").withColumn("v", F.coalesce("v", F.lit(0.0))), np.arange(MONTHS, dtype=float))


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Irregular curves: (id, t, v), t in days since the first of January 2024."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    t = (F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 86_400_000_000
    return e.select(F.col("user_id").cast("long").alias("id"), t.alias("t"), F.col("value").cast("double").alias("v")).where("t IS NOT NULL AND v IS NOT NULL")


# ---- synthetic sources: every row draws from its own seed ----


def _drawn(spark: SparkSession, n: int, grid, draw, seed: int, partitions: int | None = None) -> Curves:
    import pandas as pd

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "values": [draw(np.random.default_rng(seed + int(i))) for i in pdf["id"]]})

    return Curves(spark.range(0, n, 1, partitions).mapInPandas(run, "id long, values array<double>"), grid)


def karhunen_loeve(spark, n: int, grid, components: int = 5, family: str = "fourier", decay: str = "linear", seed: int = 1) -> Curves:
    """n curves of scores with the family's variances times its eigenfunctions."""
    grid = as_grid(grid)
    phi, sd = eigenfunctions(grid, components, family), np.sqrt(eigenvalues(components, decay))
    return _drawn(spark, n, grid, lambda r: phi @ (sd * r.standard_normal(components)), seed)


def gaussian_process(spark, n: int, grid, kind: str = "gaussian", length: float = 0.2, variance: float = 1.0, seed: int = 1) -> Curves:
    grid = as_grid(grid)
    root = np.linalg.cholesky(covariance_kernel(grid, grid, kind, length, variance) + 1e-8 * variance * np.eye(len(grid)))
    return _drawn(spark, n, grid, lambda r: root @ r.standard_normal(len(grid)), seed)


def add_noise(c: Curves, sd: float, by_curve: bool = False, seed: int = 1) -> Curves:
    """Gaussian noise at every point, or one offset for each curve; seeded by id."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            rng = [np.random.default_rng(seed + int(i)) for i in pdf["id"]]
            pdf["values"] = [np.asarray(v) + sd * r.standard_normal(1 if by_curve else len(v)) for r, v in zip(rng, pdf["values"], strict=True)]
            yield pd.DataFrame(pdf)

    return c.with_df(c.df.mapInPandas(run, c.df.schema))
