"""Logistic life-cycle fits, many series at once: one small task per series of yearly totals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIT_SCHEMA = (
    "series string, success boolean, k double, r double, tm double, r_squared double, rmse double, "
    "aic double, bic double, growth_duration double, peak_annual double, last_year int, last_cumulative double"
)


def _least_squares(f, jac, p, low, high, steps: int = 10_000):
    """Damped Gauss-Newton inside a box; returns the best point found."""
    low, high = np.asarray(low, float), np.asarray(high, float)
    p = np.clip(np.asarray(p, float), low, high)
    scale = np.maximum(np.abs(p), 1e-3)
    lam = 1e-3
    res = f(p)
    cost = res @ res
    for _ in range(steps):
        j = jac(p) * scale
        g = j.T @ res
        # a coordinate on its bound with an outward gradient is held fixed for this step
        free = ~(((p <= low) & (g > 0)) | ((p >= high) & (g < 0)))
        if not free.any():
            break
        a = j[:, free].T @ j[:, free]
        moved = False
        while lam < 1e12:
            step = np.zeros(len(p))
            step[free] = np.linalg.solve(a + lam * np.diag(np.diag(a) + 1e-12), -g[free])
            q = np.clip(p + step * scale, low, high)
            new = f(q)
            new_cost = new @ new
            if new_cost < cost:
                gain = cost - new_cost
                p, res, cost, lam, moved = q, new, new_cost, max(lam / 10, 1e-12), True
                break
            lam *= 10
        if not moved or gain <= 1e-15 * max(cost, 1e-300):
            break
    return p, cost


def _logistic(t, k, r, tm):
    return k / (1 + np.exp(np.clip(-r * (t - tm), -700, 700)))


def fit_logistic(pdf: pd.DataFrame) -> pd.DataFrame:
    """Bounded least squares of K / (1 + exp(-r (t - tm))) on one cumulative series."""
    pdf = pdf.sort_values("year")
    t, y = pdf["year"].to_numpy(float), pdf["cumulative"].to_numpy(float)
    head = {"series": pdf["series"].iloc[0], "last_year": int(t[-1]), "last_cumulative": y[-1]}
    n = len(t)
    if n < 5 or y[-1] <= 0:
        return pd.DataFrame([{**head, "success": False}]).reindex(columns=[c.split()[0] for c in FIT_SCHEMA.split(", ")])
    size = y[-1]

    def f(p):
        return _logistic(t, p[0] * size, p[1], p[2]) - y

    def jac(p):
        s = _logistic(t, 1.0, p[1], p[2])
        d = s * (1 - s) * p[0] * size
        return np.column_stack([s * size, d * (t - p[2]), -d * p[1]])

    low, high = [1.0, 0.001, t[0]], [10.0, 2.0, t[-1] + 50]
    best = None
    # several starts, because the box has flat corners
    for k0, r0, m0 in ((1.5, 0.1, t[n // 2]), (1.5, 0.5, t[n // 2]), (3.0, 0.2, t[-1]), (1.05, 0.8, t[n // 2])):
        cand = _least_squares(f, jac, [k0, r0, m0], low, high)
        if best is None or cand[1] < best[1]:
            best = cand
    (k, r, tm), ss = best
    k *= size
    tot = float(((y - y.mean()) ** 2).sum())
    fit_ok = ss > 0 and n > 3
    loglik = -n / 2 * np.log(ss / n) if fit_ok else np.nan
    row = {
        **head, "success": True, "k": k, "r": r, "tm": tm,
        "r_squared": 1 - ss / tot if tot > 0 else 0.0, "rmse": np.sqrt(ss / n),
        "aic": 6 - 2 * loglik, "bic": 3 * np.log(n) - 2 * loglik,
        "growth_duration": 2 * np.log(9) / r, "peak_annual": k * r / 4,
    }
    return pd.DataFrame([row])[[c.split()[0] for c in FIT_SCHEMA.split(", ")]]


def fit_exponential(pdf: pd.DataFrame) -> pd.DataFrame:
    """Least squares of a * exp(b * (t - t0)) on the yearly documents of one series."""
    pdf = pdf.sort_values("year")
    t, y = pdf["year"].to_numpy(float), pdf["docs"].to_numpy(float)
    if len(t) < 3:
        return pd.DataFrame({"a": [np.nan], "b": [np.nan], "x0": [np.nan]})
    u = t - t[0]

    def f(p):
        return p[0] * np.exp(np.clip(p[1] * u, -50, 50)) - y

    def jac(p):
        e = np.exp(np.clip(p[1] * u, -50, 50))
        return np.column_stack([e, p[0] * u * e])

    (a, b), _ = _least_squares(f, jac, [max(y[0], 1e-3), 0.1], [-np.inf, -np.inf], [np.inf, np.inf], 5000)
    return pd.DataFrame({"a": [a], "b": [b], "x0": [t[0]]})


def cumulative_series(series: DataFrame, value: str = "docs") -> DataFrame:
    """``(series, year, cumulative)``; a series that never falls is taken as cumulative already."""
    w = Window.partitionBy("series").orderBy("year")
    step = series.withColumn("_d", (F.col(value) < F.lag(value).over(w)).cast("int"))
    whole = Window.partitionBy("series")
    total = F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return step.select(
        "series", "year",
        F.when(F.coalesce(F.max("_d").over(whole), F.lit(0)) == 1, total).otherwise(F.col(value)).cast("double").alias("cumulative"),
    )


def life_cycle(series: DataFrame, value: str = "docs") -> DataFrame:
    """One fitted row per ``series`` of ``(series, year, value)``, with fit quality, progress and phase."""
    fits = cumulative_series(series, value).groupBy("series").applyInPandas(fit_logistic, FIT_SCHEMA)
    r2, progress = F.col("r_squared"), F.col("last_cumulative") / F.col("k") * 100
    return fits.withColumns({
        "progress_pct": progress,
        "quality": F.when(r2 >= 0.95, "Excellent").when(r2 >= 0.85, "Good").when(r2 >= 0.7, "Moderate").otherwise("Poor"),
        "phase": F.when(progress < 10, "emerging").when(progress < 50, "growth").when(progress < 90, "maturity").otherwise("saturation"),
    })


def parameters(fits: DataFrame) -> DataFrame:
    """``(series, parameter, value)``."""
    names = ("k", "tm", "r", "r_squared", "rmse", "aic", "bic", "growth_duration", "peak_annual")
    pairs = F.array(*[F.struct(F.lit(c).alias("parameter"), F.col(c).alias("value")) for c in names])
    return fits.filter("success").select("series", F.explode(pairs).alias("p")).select("series", "p.*")


def milestones(fits: DataFrame) -> DataFrame:
    """Year at which 10, 25, 50, 75, 90 and 99 percent of the saturation level is reached."""
    pct = F.explode(F.array(*[F.lit(p) for p in (10, 25, 50, 75, 90, 99)]))
    rows = fits.filter("success").select("series", "r", "tm", pct.alias("percent"))
    share = F.col("percent") / 100
    return rows.select("series", "percent", (F.col("tm") + F.ln(share / (1 - share)) / F.col("r")).alias("year"))


def curve(t: Column) -> tuple[Column, Column]:
    """Cumulative and annual value of a fitted row at ``t``."""
    e = F.exp(-F.col("r") * (t - F.col("tm")))
    return F.col("k") / (1 + e), F.col("k") * F.col("r") * e / ((1 + e) * (1 + e))


def forecast(fits: DataFrame, horizon: int = 10, years: list[int] | None = None) -> DataFrame:
    """``(series, year, cumulative, annual)`` for the next ``horizon`` years or for chosen ones."""
    span = F.array(*[F.lit(y) for y in years]) if years else F.sequence(F.col("last_year"), F.col("last_year") + horizon)
    rows = fits.filter("success").select("series", "k", "r", "tm", F.explode(span).alias("year"))
    cum, ann = curve(F.col("year"))
    return rows.select("series", "year", cum.alias("cumulative"), ann.alias("annual"))
