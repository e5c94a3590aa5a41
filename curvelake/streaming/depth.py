"""Streaming depth and charts: a frozen reference scores any stream without state; charts keep
the last vector of each stream as state."""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvelake.operators.apply import per_curve
from curvelake.sources.curves import Curves


def sorted_reference(c: Curves) -> np.ndarray:
    """(curves, points): the sorted values of every grid position of a reference table."""
    return np.sort(np.array([r["values"] for r in c.df.orderBy("id").select("values").collect()]), 0)


def depth_against(df: DataFrame, reference: np.ndarray, method: str = "fm", scale: bool = False) -> DataFrame:
    """id and depth of each curve of a batch or streaming table against a sorted reference."""
    n, m = reference.shape

    def kernel(v):
        le = np.stack([np.searchsorted(reference[:, k], v[:, k], "right") for k in range(m)], 1)
        lt = np.stack([np.searchsorted(reference[:, k], v[:, k], "left") for k in range(m)], 1)
        if method == "fm":
            f = le / n
            return np.minimum(f, 1 - f).mean(1) * (2 if scale else 1)
        if method == "mbd":
            pairs = lambda x: x * (x - 1) / 2
            return 1 - ((pairs(lt) + pairs(n - le)) / pairs(n)).mean(1) if n > 1 else np.zeros(len(v))
        raise ValueError(f"no streaming depth {method}")

    return per_curve(df.select("id", "values"), kernel, "depth double")


def assemble(events: DataFrame, width: str, points: int, late: str = "1 hour", key: str = "user_id", time: str = "ts", value: str = "value") -> DataFrame:
    """Curves of windows of events: mean value in ``points`` equal parts of each window. Rows that
    come later than ``late`` behind the newest are dropped by the watermark."""
    e = events.withWatermark(time, late)
    w = F.window(time, width)
    span = F.unix_micros(w["end"]) - F.unix_micros(w["start"])
    pos = F.floor((F.unix_micros(time) - F.unix_micros(w["start"])) * points / span).cast("int")
    sums = [F.sum(F.when(F.col("pos") == k, F.col("v"))).alias(f"s{k}") for k in range(points)]
    counts = [F.count(F.when(F.col("pos") == k, F.col("v"))).alias(f"n{k}") for k in range(points)]
    rows = e.select(F.col(key).alias("key"), time, F.col(value).cast("double").alias("v"), pos.alias("pos"))
    got = rows.groupBy("key", F.window(time, width).alias("w")).agg(*sums, *counts)
    values = F.array(*[F.coalesce(F.col(f"s{k}") / F.nullif(F.col(f"n{k}"), F.lit(0)), F.lit(0.0)) for k in range(points)])
    return got.select("key", F.col("w.start").alias("start"), values.alias("values"))


def chart_stream(scored: DataFrame, eig, how: str = "mewma", limit: float = math.inf, key: str = "key", **p) -> DataFrame:
    """key, n, statistic, alarm for each arriving score vector; the state is one vector a key."""
    import pandas as pd

    from curvelake.operators import monitor as mon

    eig = np.asarray(eig, float)

    def step(group, batches, state):
        d = len(eig)
        kept = json.loads(state.get[0]) if state.exists else {"t": 0, "z": [0.0] * d, "hi": [0.0] * d, "lo": [0.0] * d}
        z, hi, lo = (np.array(kept[x]) for x in ("z", "hi", "lo"))
        t, out = kept["t"], []
        for pdf in batches:
            for s in pdf["scores"]:
                t += 1
                if how == "mewma":
                    z, stat = mon.mewma_step(z, np.asarray(s), p.get("lam", 0.2), eig, t, p.get("exact", False))
                elif how == "mcusum":
                    z, stat = mon.mcusum_step(z, np.asarray(s), p.get("k", 0.5), eig)
                else:
                    hi, lo, stat = mon.cusum_step(hi, lo, np.asarray(s), p.get("k", 0.5), eig)
                out.append((group[0], t, stat, stat > limit))
        state.update((json.dumps({"t": t, "z": list(z), "hi": list(hi), "lo": list(lo)}),))
        yield pd.DataFrame(out, columns=[key, "n", "statistic", "alarm"])

    kind = dict(scored.dtypes)[key]
    return scored.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n long, statistic double, alarm boolean", "state string", "append", "NoTimeout")
