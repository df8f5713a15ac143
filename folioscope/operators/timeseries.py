"""Yearly series: trends, growth, forecasts, windows, life cycles, bursts, cited years."""

from __future__ import annotations

import math
from collections.abc import Iterator
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.longform import long


def calendar(df: DataFrame, first: int | None = None, last: int | None = None, year: str = "year") -> DataFrame:
    """(year): every year from the first to the last."""
    lo = F.lit(first) if first is not None else F.min(year)
    hi = F.lit(last) if last is not None else F.max(year)
    return df.agg(lo.alias("lo"), hi.alias("hi")).where("lo IS NOT NULL").select(F.explode(F.sequence("lo", "hi")).alias("year"))


def trend(df: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """(year, count, cumulative, growth in percent), years without documents too."""
    counts = df.groupBy("year").agg(F.count("*").alias("count"))
    t = calendar(df, first, last).join(counts, "year", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    w = Window.orderBy("year")  # a row for each year
    before = F.lag("count").over(w)
    return t.select("year", "count", F.sum("count").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cumulative"), F.when(before > 0, (F.col("count") - before) / before * 100).alias("growth"))


def citation_evolution(df: DataFrame) -> DataFrame:
    return df.groupBy("year").agg(F.count("*").alias("n_docs"), F.sum("cited_by").alias("citations"), F.avg("cited_by").alias("mean"), F.percentile("cited_by", 0.5).alias("median"), F.max("cited_by").alias("max"))


def growth_rates(series: DataFrame) -> DataFrame:
    """Year-on-year growth (a count of 0 before counts as 1), trailing mean of three years and its growth."""
    w = Window.orderBy("year")
    before = F.lag("count").over(w)
    t = series.select("year", "count", ((F.col("count") - before) / F.greatest(before, F.lit(1)) * 100).alias("yoy"), F.when(F.row_number().over(w) >= 3, F.avg("count").over(w.rowsBetween(-2, 0))).alias("mean3"))
    prior = F.lag("mean3").over(w)
    return t.withColumn("mean3_growth", F.when(prior > 0, (F.col("mean3") - prior) / prior * 100))


def cagr(series: DataFrame) -> DataFrame:
    """One row: compound growth from the first to the last year, in percent."""
    t = series.agg(F.min("year").alias("a"), F.max("year").alias("b"), F.min_by("count", "year").alias("x"), F.max_by("count", "year").alias("y"))
    return t.select("a", "b", F.when((F.col("x") > 0) & (F.col("b") > F.col("a")), (F.pow(F.col("y") / F.col("x"), 1 / (F.col("b") - F.col("a"))) - 1) * 100).alias("cagr"))


def forecast(series: DataFrame, years: int = 5, log: bool = False) -> DataFrame:
    """(year, predicted, low, high) by least squares (of the logarithm), with 1.96 deviations of the residuals; not below 0."""
    y = F.log(F.greatest(F.col("count"), F.lit(1)).cast("double")) if log else F.col("count").cast("double")
    t = series.select(F.col("year").cast("double").alias("x"), y.alias("y"))
    fit = t.agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"), F.sqrt(F.greatest(F.lit(0.0), (F.regr_syy("y", "x") - F.regr_slope("y", "x") * F.regr_sxy("y", "x")) / F.count("*"))).alias("sd"), F.max("x").alias("last"))
    out = fit.select("a", "b", "sd", F.explode(F.sequence(F.col("last").cast("int") + 1, F.col("last").cast("int") + years)).alias("year"))
    mid = F.col("a") + F.col("b") * F.col("year")
    value = (lambda c: F.greatest(F.lit(0.0), F.exp(c) if log else c))
    return out.select("year", value(mid).alias("predicted"), value(mid - 1.96 * F.col("sd")).alias("low"), value(mid + 1.96 * F.col("sd")).alias("high"))


def doubling_time(series: DataFrame) -> DataFrame:
    """One row: years until the cumulative count is twice that of the first year, between years in proportion."""
    w = Window.orderBy("year")
    t = series.withColumns({"first": F.first("cumulative").over(w), "start": F.first("year").over(w), "prev": F.lag("cumulative").over(w), "py": F.lag("year").over(w)})
    hit = t.where((F.col("cumulative") >= 2 * F.col("first")) & F.col("prev").isNotNull())
    at = F.col("py") + (2 * F.col("first") - F.col("prev")) / (F.col("cumulative") - F.col("prev")) * (F.col("year") - F.col("py")) - F.col("start")
    return hit.agg(F.min_by(at, "year").alias("doubling_time"))


def half_life(df: DataFrame, now: int) -> DataFrame:
    """One row: the least age by which documents that young have half of all citations."""
    by = df.groupBy((F.lit(now) - F.col("year")).alias("age")).agg(F.sum("cited_by").alias("c"))
    t = by.withColumn("run", F.sum("c").over(Window.orderBy("age").rowsBetween(Window.unboundedPreceding, 0)))
    return t.where(F.col("run") * 2 >= by.select(F.sum("c")).scalar()).agg(F.min("age").alias("half_life"))


def changes(series: DataFrame, sensitivity: float = 1.5) -> DataFrame:
    """(year, change, z, direction) where the first difference is more than sensitivity deviations from the mean difference."""
    t = series.withColumn("change", F.col("count") - F.lag("count").over(Window.orderBy("year"))).where("change IS NOT NULL")
    stats = t.agg(F.avg("change").alias("m"), F.stddev_pop("change").alias("s"))
    z = (F.col("change") - stats.select("m").scalar()) / stats.select("s").scalar()
    return t.select("year", "change", z.alias("z")).where(F.abs("z") > sensitivity).withColumn("direction", F.when(F.col("z") > 0, "increase").otherwise("decrease"))


def windows(df: DataFrame, size: int = 5, kind: str = "fixed", step: int = 1, year: str = "year") -> DataFrame:
    """df with start and stop of each window a row is in: fixed windows tumble from the first year (the last may be cut), sliding ones are whole."""
    lo, hi = df.select(F.min(year)).scalar(), df.select(F.max(year)).scalar()
    if kind == "fixed":
        start = lo + F.floor((F.col(year) - lo) / size).cast("int") * size
        return df.where(F.col(year).isNotNull()).withColumn("start", start).withColumn("stop", F.least(F.col("start") + size - 1, hi))
    starts = F.sequence(F.col(year) - (size - 1), F.col(year))
    t = df.where(F.col(year).isNotNull()).withColumn("start", F.explode(starts)).withColumns({"_lo": lo, "_hi": hi})
    whole = (F.col("start") >= F.col("_lo")) & (F.col("start") + (size - 1) <= F.col("_hi")) & (F.pmod(F.col("start") - F.col("_lo"), F.lit(step)) == 0)
    return t.where(whole).drop("_lo", "_hi").withColumn("stop", F.col("start") + size - 1)


def mann_kendall(series: DataFrame, value: str = "value") -> DataFrame:
    """One row: S, its variance with ties, z, Kendall's tau and Sen's slope of yearly values (some hundred rows at most)."""
    a, b = series.select(F.col("year").alias("x"), F.col(value).alias("u")), series.select(F.col("year").alias("y"), F.col(value).alias("v"))
    p = a.join(b, F.col("x") < F.col("y")).agg(F.sum(F.signum(F.col("v") - F.col("u"))).alias("s"), F.percentile((F.col("v") - F.col("u")) / (F.col("y") - F.col("x")), 0.5).alias("slope"))
    ties = series.groupBy(value).agg(F.count("*").alias("t"))
    n = series.select(F.count("*")).scalar()
    t = F.col("t")
    var = ties.agg(F.sum(t * (t - 1) * (2 * t + 5)).alias("x")).scalar()
    out = p.withColumn("variance", (n * (n - 1) * (2 * n + 5) - var) / 18)
    s = F.col("s")
    z = F.when(s > 0, (s - 1) / F.sqrt("variance")).when(s < 0, (s + 1) / F.sqrt("variance")).otherwise(0.0)
    return out.select("s", "variance", z.alias("z"), (s / (n * (n - 1) / 2)).alias("tau"), "slope")


def item_slopes(df: DataFrame, column: str, lookback: int, now: int) -> DataFrame:
    """(item, total, mean, slope, recent) of yearly counts in the last lookback years, years without the item as 0: emerging and hot topics."""
    rows = long(df, column, ["doc_id", "year"]).where(F.col("year").between(now - lookback + 1, now))
    per = rows.groupBy("item", "year").agg(F.count("*").alias("k"))
    x = F.col("year") - (now - lookback + 1)
    n = lookback
    sx, sxx = n * (n - 1) / 2, n * (n - 1) * (2 * n - 1) / 6
    out = per.groupBy("item").agg(F.sum("k").alias("total"), F.sum(x * F.col("k")).alias("sxy"), F.coalesce(F.sum(F.when(F.col("year") == now, F.col("k"))), F.lit(0)).alias("recent"))
    slope = (n * F.col("sxy") - sx * F.col("total")) / (n * sxx - sx * sx) if n > 1 else F.lit(0.0)
    return out.select("item", "total", (F.col("total") / n).alias("mean"), slope.alias("slope"), "recent").withColumn("score", F.col("slope") / (F.col("mean") + 1))


def spectrogram(years: DataFrame, first: int = 1900) -> DataFrame:
    """(year, n, deviation) of cited years (a column year): count and its distance from the median of the five years around, missing years as 0."""
    counts = years.where(F.col("year") >= first).groupBy("year").agg(F.count("*").alias("n"))
    t = calendar(counts).join(counts, "year", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    around = F.percentile("n", 0.5).over(Window.orderBy("year").rowsBetween(-2, 2))
    return t.select("year", "n", (F.col("n") - around).alias("deviation"))


def _least_squares(f: Callable, x: np.ndarray, y: np.ndarray, start: list[float], rounds: int = 200) -> tuple[np.ndarray, float]:
    """Levenberg-Marquardt with numeric derivatives; parameters and residual sum of squares."""
    p, damp = np.array(start, float), 1e-2
    r = y - f(x, *p)
    for _ in range(rounds):
        h = 1e-6 * np.maximum(np.abs(p), 1e-3)
        jac = np.stack([(f(x, *(p + np.eye(len(p))[i] * h[i])) - f(x, *p)) / h[i] for i in range(len(p))], 1)
        a, g = jac.T @ jac, jac.T @ r
        try:
            d = np.linalg.solve(a + damp * np.diag(np.diag(a) + 1e-12), g)
        except np.linalg.LinAlgError:
            break
        new = y - f(x, *(p + d))
        if np.isfinite(new).all() and (new**2).sum() < (r**2).sum():
            done = (r**2).sum() - (new**2).sum() < 1e-12 * (1 + (r**2).sum())
            p, r, damp = p + d, new, damp / 3
            if done:
                break
        else:
            damp *= 4
            if damp > 1e12:
                break
    return p, float((r**2).sum())


MODELS = {
    "linear": (lambda x, a, b: a + b * x, lambda x, y: [y[0], (y[-1] - y[0]) / max(1.0, x[-1] - x[0])]),
    "exponential": (lambda x, a, b: a * np.exp(np.clip(b * x, -50, 50)), lambda x, y: [max(y[0], 1.0), 0.1]),
    "power": (lambda x, a, b: a * np.power(x + 1, np.clip(b, -20, 20)), lambda x, y: [max(y[0], 1.0), 1.0]),
    "logistic": (lambda x, k, r, m: k / (1 + np.exp(np.clip(-r * (x - m), -50, 50))), lambda x, y: [max(y) * 1.5, 0.3, (x[0] + x[-1]) / 2]),
}


def growth_models(series: DataFrame, value: str = "count", years: int = 5) -> DataFrame:
    """(model, parameters, sse, r2, aic, best, forecast) of linear, exponential, power and logistic growth. The series has a row for each year, so one task fits."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("year")
        x, y = (pdf["year"] - pdf["year"].min()).to_numpy(float), pdf["v"].to_numpy(float)
        rows = []
        for name, (f, start) in MODELS.items():
            p, sse = _least_squares(f, x, y, start(x, y))
            n = len(x)
            aic = n * math.log(max(sse / n, 1e-12)) + 2 * len(p)
            rows.append((name, [float(v) for v in p], sse, 1 - sse / max(((y - y.mean()) ** 2).sum(), 1e-12), aic, [float(max(0.0, v)) for v in f(x[-1] + np.arange(1, years + 1), *p)]))
        best = min(r[4] for r in rows)
        return pd.DataFrame([(*r[:5], r[4] == best, r[5]) for r in rows], columns=["model", "parameters", "sse", "r2", "aic", "best", "forecast"])

    one = series.select(F.lit(1).alias("g"), "year", F.col(value).cast("double").alias("v"))
    return one.groupBy("g").applyInPandas(run, "model string, parameters array<double>, sse double, r2 double, aic double, best boolean, forecast array<double>")


def life_cycle(series: DataFrame) -> DataFrame:
    """One row: saturation, rate and midpoint of the logistic curve of the cumulative count, progress and phase (thresholds 0.1, 0.5, 0.9)."""
    first = series.agg(F.min("year").alias("y"), F.max("cumulative").alias("now"))
    fit = growth_models(series, "cumulative").where("model = 'logistic'").select(F.col("parameters")[0].alias("saturation"), F.col("parameters")[1].alias("rate"), F.col("parameters")[2].alias("mid"), "r2")
    out = fit.select("*", first.select("y").scalar().alias("y"), first.select("now").scalar().alias("now")).withColumns({"mid_year": F.col("mid") + F.col("y"), "progress": F.col("now") / F.col("saturation")})
    p = F.col("progress")
    return out.withColumn("phase", F.when(p < 0.1, "emergence").when(p < 0.5, "growth").when(p < 0.9, "maturity").otherwise("saturation")).select("saturation", "rate", "mid_year", "progress", "phase", "r2")


def bursts(df: DataFrame, column: str, s: float = 2.0, gamma: float = 1.0) -> DataFrame:
    """(item, start, stop, weight): Kleinberg's two-state bursts of an item's yearly share; exact counts, no jitter."""
    per = long(df, column, ["doc_id", "year"]).groupBy("item", "year").agg(F.count("*").cast("double").alias("r"))
    every = df.groupBy("year").agg(F.count("*").cast("double").alias("d"))
    totals = sorted((r["year"], r["d"]) for r in every.collect() if r["year"] is not None)  # a number for each year

    years, d = [y for y, _ in totals], np.array([v for _, v in totals])
    place = {y: i for i, y in enumerate(years)}
    up = gamma * math.log(len(years) + 1)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:  # many items at a time, a matrix of items and years
            n = len(pdf)
            r = np.zeros((n, len(years)))
            for k, got in enumerate(pdf["got"]):
                for y, v in got:
                    r[k, place[y]] = v
            p0 = np.clip(r.sum(1) / d.sum(), 1e-12, 0.9999)
            p1 = np.minimum(0.9999, p0 * s)
            cost = np.stack([-(r * np.log(p)[:, None] + (d - r) * np.log(1 - p)[:, None]) for p in (p0, p1)])
            best, back = np.stack([np.zeros(n), np.full(n, up)]), []
            for t in range(len(years)):
                go = np.stack([best, np.stack([best[0] + up, best[1]])])  # go[to, from]
                pick = go.argmin(1)
                best = np.take_along_axis(go, pick[:, None], 1)[:, 0] + cost[:, :, t]
                back.append(pick)
            states = np.zeros((n, len(years)), int)
            state = best.argmin(0)
            for t in range(len(years) - 1, -1, -1):
                states[:, t] = state
                state = back[t][state, np.arange(n)]
            gain, out = cost[0] - cost[1], []
            for k in np.flatnonzero(states.any(1)):
                edge = np.flatnonzero(np.diff(np.concatenate([[0], states[k], [0]])))
                out += [(pdf["item"].iloc[k], years[a], years[b - 1], float(gain[k, a:b].sum())) for a, b in zip(edge[::2], edge[1::2], strict=True)]
            yield pd.DataFrame(out, columns=["item", "start", "stop", "weight"])

    kind = per.schema["item"].dataType.simpleString()
    lists = per.where("year IS NOT NULL").groupBy("item").agg(F.collect_list(F.struct("year", "r")).alias("got"))
    return lists.select("item", F.transform("got", lambda x: F.array(x["year"].cast("double"), x["r"])).alias("got")).mapInPandas(run, f"item {kind}, start int, stop int, weight double")
