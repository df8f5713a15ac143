"""Statistical tests and fits. Statistics are aggregates in the engine; p-values are computed from the few numbers that these give."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import distributions as dist
from folioscope.operators.longform import average_rank, running


def descriptives(df: DataFrame, value: str, by: str | None = None) -> DataFrame:
    """n, mean, sd (sample), se, median, quartiles, extremes, population skewness and kurtosis (excess), by group."""
    x = F.col(value).cast("double")
    keys = [by] if by else []
    t = df.where(x.isNotNull()).withColumn("_x", x)
    # moments around the mean: a second look at the same rows keeps their digits
    mean = F.avg("_x").over(Window.partitionBy(*keys)) if keys else t.select(F.avg("_x")).scalar()
    t = t.withColumn("_d", F.col("_x") - mean)
    n = F.count("*")
    m2, m3, m4 = (F.avg(F.pow("_d", F.lit(k))) for k in (2, 3, 4))
    return t.groupBy(*keys).agg(
        n.alias("n"), F.avg("_x").alias("mean"), F.stddev_samp("_x").alias("sd"), (F.stddev_samp("_x") / F.sqrt(n)).alias("se"), F.percentile("_x", 0.5).alias("median"), F.percentile("_x", 0.25).alias("q1"), F.percentile("_x", 0.75).alias("q3"),
        F.min("_x").alias("min"), F.max("_x").alias("max"), F.when(m2 > 0, m3 / F.pow(m2, F.lit(1.5))).alias("skewness"), F.when(m2 > 0, m4 / (m2 * m2) - 3).alias("kurtosis"),
    )


def crosstab(df: DataFrame, row: str, col: str) -> DataFrame:
    """(row, col, n, expected, residual, row_share, col_share, total_share) of every cell seen; totals by GROUPING SETS rather than second scans."""
    cells = df.where(F.col(row).isNotNull() & F.col(col).isNotNull()).groupBy(F.col(row).cast("string").alias("row"), F.col(col).cast("string").alias("col")).agg(F.count("*").alias("n"))
    t = cells.withColumns({"_r": F.sum("n").over(Window.partitionBy("row")), "_c": F.sum("n").over(Window.partitionBy("col"))})
    total = cells.select(F.sum("n")).scalar()
    n, expected = F.col("n"), F.col("_r") * F.col("_c") / total
    return t.select("row", "col", "n", expected.alias("expected"), ((n - expected) / F.sqrt(expected)).alias("residual"), (n / F.col("_r")).alias("row_share"), (n / F.col("_c")).alias("col_share"), (n / total).alias("total_share"))


def crosstab_margins(df: DataFrame, row: str, col: str) -> DataFrame:
    """(row, col, n) with totals, where row or col is 'Total'."""
    t = df.where(F.col(row).isNotNull() & F.col(col).isNotNull()).select(F.col(row).cast("string").alias("row"), F.col(col).cast("string").alias("col"))
    return t.cube("row", "col").agg(F.count("*").alias("n")).select(F.coalesce("row", F.lit("Total")).alias("row"), F.coalesce("col", F.lit("Total")).alias("col"), "n")


def chi_square(df: DataFrame, row: str, col: str) -> DataFrame:
    """One row: chi2, dof, n, Cramer's V and contingency coefficient. Cells not seen count their expectation: chi2 = N (sum n^2 / (r c) - 1)."""
    t = crosstab(df, row, col)
    out = t.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n") / F.col("expected")).alias("s"), F.countDistinct("row").alias("r"), F.countDistinct("col").alias("c"))
    chi2 = F.col("s") - F.col("n")
    k = F.least("r", "c") - 1
    return out.select("n", chi2.alias("chi2"), ((F.col("r") - 1) * (F.col("c") - 1)).alias("dof"), F.when(k > 0, F.sqrt(F.greatest(F.lit(0.0), chi2) / (F.col("n") * k))).alias("cramers_v"), F.sqrt(chi2 / (chi2 + F.col("n"))).alias("contingency"))


def chi_square_test(df: DataFrame, row: str, col: str) -> dict:
    """chi_square with its p-value; for 2 x 2 tables Fisher's exact p too."""
    r = chi_square(df, row, col).first().asDict()
    r["p"] = dist.chi2_sf(r["chi2"], r["dof"]) if r["dof"] else 1.0
    if r["dof"] == 1:
        cells = {(x["row"], x["col"]): x["n"] for x in crosstab(df, row, col).collect()}
        rows, cols = sorted({k[0] for k in cells}), sorted({k[1] for k in cells})
        r["fisher_p"] = dist.fisher_exact(*(cells.get((a, b), 0) for a in rows for b in cols))
    return r


def correlations(df: DataFrame, columns: list[str], method: str = "pearson") -> DataFrame:
    """(a, b, r, n) of every pair of columns, over rows where both are known; spearman: of mean ranks."""
    out = None
    for i, a in enumerate(columns):
        for b in columns[i + 1 :]:
            t = df.select(F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
            if method == "spearman":
                t = mean_ranks(mean_ranks(t, "x", "rx"), "y", "ry", of=t).select(F.col("rx").alias("x"), F.col("ry").alias("y"))
            one = t.agg(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr("x", "y").alias("r"), F.count("*").alias("n"))
            out = one if out is None else out.union(one)
    return out


def mean_ranks(df: DataFrame, value: str, name: str, of: DataFrame | None = None) -> DataFrame:
    """Mean ranks over the whole frame, by a histogram of the values, itself added up in a distributed sort: no task sees all of it.
    of: a simpler frame with the same values, to make the histogram from."""
    hist = running((df if of is None else of).groupBy(value).agg(F.count("*").alias("_k")), [F.col(value)], {"_upto": "_k"})
    ranks = hist.select(F.col(value).alias("_v"), (F.col("_upto") - F.col("_k") + (F.col("_k") + 1) / 2).alias(name), F.col("_k").alias(f"{name}_ties"))
    return df.join(ranks, F.col(value) == F.col("_v")).drop("_v")


def kendall(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: tau-b of two columns with few distinct pairs of values, by joining the distinct pairs with their counts."""
    cells = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("k"))
    a, b = cells.select(*(F.col(c).alias(f"{c}1") for c in ("x", "y", "k"))), cells.select(*(F.col(c).alias(f"{c}2") for c in ("x", "y", "k")))
    s = a.join(b, F.col("x1") < F.col("x2")).agg(F.sum(F.signum(F.col("y2") - F.col("y1")) * F.col("k1") * F.col("k2")).alias("s"))
    n = cells.agg(F.sum("k").alias("n"))
    ties = lambda c: cells.groupBy(c).agg(F.sum("k").alias("t")).agg(F.sum(F.col("t") * (F.col("t") - 1) / 2).alias("u"))
    n0 = F.col("n") * (F.col("n") - 1) / 2
    return s.select("s", n.select("n").scalar().alias("n"), ties("x").select("u").scalar().alias("tx"), ties("y").select("u").scalar().alias("ty")).select((F.col("s") / F.sqrt((n0 - F.col("tx")) * (n0 - F.col("ty")))).alias("tau_b"), "n")


def strength(r):
    """A label of the size of a correlation."""
    x = F.abs(r)
    return F.when(x < 0.1, "negligible").when(x < 0.3, "weak").when(x < 0.5, "moderate").when(x < 0.7, "strong").otherwise("very strong")


def anova(df: DataFrame, value: str, by: str) -> DataFrame:
    """One row: F, degrees of freedom, eta squared of a one-way analysis of variance."""
    t = df.where(F.col(value).isNotNull() & F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    n, k = F.sum("n"), F.count("*")
    grand = F.sum(F.col("n") * F.col("m")) / n
    between = F.sum(F.col("n") * F.col("m") * F.col("m")) - n * grand * grand
    within = F.sum((F.col("n") - 1) * F.coalesce("v", F.lit(0.0)))
    out = t.agg(between.alias("b"), within.alias("w"), (k - 1).alias("df_between"), (n - k).alias("df_within"))
    f = (F.col("b") / F.col("df_between")) / (F.col("w") / F.col("df_within"))
    return out.select(f.alias("f"), "df_between", "df_within", (F.col("b") / (F.col("b") + F.col("w"))).alias("eta_squared"))


def levene(df: DataFrame, value: str, by: str) -> DataFrame:
    """One row: the median-centred Levene statistic, an analysis of variance of the distances from the group's median."""
    mid = df.groupBy(by).agg(F.percentile(value, 0.5).alias("_m"))
    return anova(df.join(mid, by).withColumn("_z", F.abs(F.col(value) - F.col("_m"))), "_z", by)


def kruskal(df: DataFrame, value: str, by: str) -> DataFrame:
    """One row: H with tie correction, groups, n and epsilon squared."""
    t = mean_ranks(df.where(F.col(value).isNotNull() & F.col(by).isNotNull()).select(by, F.col(value).cast("double").alias("x")), "x", "r")
    n = t.select(F.count("*")).scalar()
    ties = t.groupBy("x").agg(F.count("*").cast("double").alias("k")).agg(F.sum(F.pow("k", F.lit(3)) - F.col("k")).alias("t")).scalar()
    g = t.groupBy(by).agg(F.count("*").alias("k"), F.sum("r").alias("s"))
    nd = n.cast("double")
    h = (12 / (nd * (nd + 1)) * F.sum(F.col("s") * F.col("s") / F.col("k")) - 3 * (nd + 1)) / (1 - ties / (nd * nd * nd - nd))
    out = g.agg(h.alias("h"), F.count("*").alias("k"), F.sum("k").alias("n"))
    return out.select("h", "k", "n", F.greatest(F.lit(0.0), (F.col("h") - F.col("k") + 1) / (F.col("n") - F.col("k"))).alias("epsilon_squared"))


def mann_whitney(df: DataFrame, value: str, by: str, a: str, b: str) -> DataFrame:
    """One row: U of the first group, z with tie correction, and the rank-biserial correlation."""
    t = mean_ranks(df.where(F.col(by).isin(a, b) & F.col(value).isNotNull()).select(F.col(by).alias("g"), F.col(value).cast("double").alias("x")), "x", "r")
    ties = t.groupBy("x").agg(F.count("*").cast("double").alias("k")).agg(F.sum(F.pow("k", F.lit(3)) - F.col("k"))).scalar()
    out = t.agg(F.sum((F.col("g") == a).cast("double")).alias("n1"), F.sum((F.col("g") == b).cast("double")).alias("n2"), F.sum(F.when(F.col("g") == a, F.col("r"))).alias("s"), F.max(ties).alias("ties"))
    n1, n2 = F.col("n1"), F.col("n2")
    u, n = F.col("s") - n1 * (n1 + 1) / 2, n1 + n2
    var = n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1)))
    return out.select("n1", "n2", u.alias("u"), ((u - n1 * n2 / 2) / F.sqrt(var)).alias("z"), F.abs(1 - 2 * u / (n1 * n2)).alias("rank_biserial"))


def pairwise_t(df: DataFrame, value: str, by: str, equal_var: bool = True) -> DataFrame:
    """(a, b, t, dof, cohens_d) of every pair of groups: a join of the groups' few summary rows."""
    g = df.where(F.col(value).isNotNull() & F.col(by).isNotNull()).groupBy(F.col(by).cast("string").alias("g")).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    a, b = g.select(*(F.col(c).alias(f"{c}1") for c in ("g", "n", "m", "v"))), g.select(*(F.col(c).alias(f"{c}2") for c in ("g", "n", "m", "v")))
    n1, n2, v1, v2 = (F.col(c) for c in ("n1", "n2", "v1", "v2"))
    pooled = ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)
    diff = F.col("m1") - F.col("m2")
    if equal_var:
        t, dof = diff / F.sqrt(pooled * (1 / n1 + 1 / n2)), (n1 + n2 - 2).cast("double")
    else:
        s = v1 / n1 + v2 / n2
        t, dof = diff / F.sqrt(s), s * s / (v1 * v1 / (n1 * n1 * (n1 - 1)) + v2 * v2 / (n2 * n2 * (n2 - 1)))
    return a.join(b, F.col("g1") < F.col("g2")).select(F.col("g1").alias("a"), F.col("g2").alias("b"), t.alias("t"), dof.alias("dof"), (F.abs(diff) / F.sqrt(pooled)).alias("cohens_d"))


def compare_means(df: DataFrame, value: str, by: str, alpha: float = 0.05) -> dict:
    """Chooses by homogeneity and number of groups between t or Welch, ANOVA or Kruskal-Wallis; pairwise p-values are multiplied by the number of pairs."""
    lev = levene(df, value, by).first()
    equal = dist.f_sf(lev["f"], lev["df_between"], lev["df_within"]) >= alpha if lev["f"] is not None else True
    pairs = [r.asDict() for r in pairwise_t(df, value, by, equal).collect()]  # a row for each pair of groups
    for r in pairs:
        r["p"] = min(1.0, dist.t_sf2(r["t"], r["dof"]) * len(pairs)) if r["t"] is not None else None
    if len(pairs) == 1:
        return {"test": "t" if equal else "welch", "statistic": pairs[0]["t"], "p": pairs[0]["p"], "pairs": pairs}
    if equal:
        r = anova(df, value, by).first()
        return {"test": "anova", "statistic": r["f"], "p": dist.f_sf(r["f"], r["df_between"], r["df_within"]), "effect": r["eta_squared"], "pairs": pairs}
    r = kruskal(df, value, by).first()
    return {"test": "kruskal", "statistic": r["h"], "p": dist.chi2_sf(r["h"], r["k"] - 1), "effect": r["epsilon_squared"], "pairs": pairs}


def goodness_of_fit(observed: DataFrame, reference: DataFrame) -> DataFrame:
    """One row: chi2 of counts against reference counts, scaled to the same total, over the categories of both; (category, n) each."""
    t = observed.select("category", F.col("n").alias("o")).join(reference.select("category", F.col("n").alias("r")), "category")
    total = t.agg(F.sum("o").alias("o"), F.sum("r").alias("r"))
    e = F.col("r") * total.select("o").scalar() / total.select("r").scalar()
    return t.agg(F.sum((F.col("o") - e) * (F.col("o") - e) / e).alias("chi2"), (F.count("*") - 1).alias("dof"), F.avg((e < 5).cast("double")).alias("small_share"))


def representation(observed: DataFrame, reference: DataFrame, threshold: float = 1.0) -> DataFrame:
    """(category, n, share, reference_share, difference, relative, class): shares over the categories of both, in percent."""
    t = observed.select("category", F.col("n").alias("o")).join(reference.select("category", F.col("n").alias("r")), "category")
    o = 100 * F.col("o") / t.select(F.sum("o")).scalar()
    r = 100 * F.col("r") / t.select(F.sum("r")).scalar()
    d = o - r
    return t.select("category", F.col("o").alias("n"), o.alias("share"), r.alias("reference_share"), d.alias("difference"), F.when(r > 0, d / r * 100).alias("relative"), F.when(d > threshold, "over").when(d < -threshold, "under").otherwise("proportional").alias("class"))


def fit_distributions(df: DataFrame, value: str) -> DataFrame:
    """(family, parameters, log_likelihood, aic, bic) of lognormal, exponential, power law and geometric, by closed forms over positive values."""
    x = F.col(value).cast("double")
    pos = df.where(x > 0).select(x.alias("x"))
    s = pos.agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.log("x")).alias("l"), F.var_pop(F.log("x")).alias("vl"), F.avg("x").alias("m"), F.var_pop("x").alias("v"), F.min("x").alias("lo"))
    n, total, logs, m = (F.col(c) for c in ("n", "s", "l", "m"))
    sd = F.sqrt("vl")
    alpha = 1 + n / (logs - n * F.log("lo"))
    rows = [
        ("lognormal", F.array(logs / n, sd), -logs - n / 2 * (F.log(2 * math.pi * F.col("vl")) + 1), 2),
        ("exponential", F.array(1 / m), -n * F.log(m) - n, 1),
        ("power", F.array(alpha), n * F.log((alpha - 1) / F.col("lo")) - alpha * (logs - n * F.log("lo")), 1),
        ("geometric", F.array(1 / m), n * F.log(1 / m) + (total - n) * F.log(1 - 1 / m), 1),
    ]
    parts = [s.select(F.lit(name).alias("family"), p.alias("parameters"), ll.alias("log_likelihood"), (2 * k - 2 * ll).alias("aic"), (k * F.log(n) - 2 * ll).alias("bic")) for name, p, ll, k in rows]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def bootstrap(df: DataFrame, value: str, rounds: int = 1000, seed: int = 42) -> DataFrame:
    """One row: mean and 95 % interval by Poisson bootstrap: every row is drawn a Poisson(1) number of times in each round, inside its task."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        import pyspark

        rng = np.random.default_rng([seed, pyspark.TaskContext.get().partitionId()])
        total, weight = np.zeros(rounds), np.zeros(rounds)
        for b in batches:
            x = np.asarray(b.column(0))
            for part in np.array_split(x, max(1, len(x) // 2000)):
                w = rng.poisson(1.0, (rounds, len(part)))
                total += w @ part
                weight += w.sum(1)
        yield pa.RecordBatch.from_arrays([pa.array(range(rounds), pa.int32()), pa.array(total), pa.array(weight)], ["i", "t", "w"])

    x = df.select(F.col(value).cast("double").alias("x")).where("x IS NOT NULL")
    means = x.mapInArrow(run, "i int, t double, w double").groupBy("i").agg((F.sum("t") / F.sum("w")).alias("m"))
    return means.agg(F.avg("m").alias("mean"), F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))


def collaboration(df: DataFrame) -> DataFrame:
    """One row: collaboration index (mean authors), degree (share of documents by several) and coefficient (1 - mean of 1 / authors)."""
    k = F.size("authors")
    t = df.where(k > 0)
    return t.agg(F.count("*").alias("documents"), F.avg(k).alias("index"), F.avg((k > 1).cast("double")).alias("degree"), (1 - F.avg(1 / k)).alias("coefficient"))


def team_sizes(df: DataFrame) -> DataFrame:
    """(authors, documents, share)."""
    t = df.where(F.size("authors") > 0)
    return t.groupBy(F.size("authors").alias("authors")).agg(F.count("*").alias("documents")).withColumn("share", F.col("documents") / t.select(F.count("*")).scalar())


def percentile_ranks(df: DataFrame, value: str, within: list[str]) -> DataFrame:
    """Mean-rank percentiles of a value within groups."""
    return df.withColumn("percentile", average_rank(value, within) / F.count("*").over(Window.partitionBy(*within)) * 100)


def ks_normal(df: DataFrame, value: str) -> DataFrame:
    """One row: n, mean, sd and the Kolmogorov-Smirnov distance to the normal distribution of that mean and deviation, over a histogram of the distinct values.
    The normal distribution function is Abramowitz and Stegun's approximation 7.1.26 (error below 1.5e-7)."""
    x = df.select(F.col(value).cast("double").alias("x")).where("x IS NOT NULL")
    hist = running(x.groupBy("x").agg(F.count("*").alias("k")), [F.col("x")], {"run": "k"})
    run = F.col("run")
    one = x.agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.stddev_samp("x").alias("s"))
    n, m, s = (one.select(c).scalar() for c in ("n", "m", "s"))
    t = hist.select(((F.col("x") - m) / s / math.sqrt(2)).alias("z"), (run / n).alias("high"), ((run - F.col("k")) / n).alias("low"), n.alias("n"), m.alias("mean"), s.alias("sd"))
    a = F.abs("z")
    u = 1 / (1 + 0.3275911 * a)
    erf = 1 - ((((1.061405429 * u - 1.453152027) * u + 1.421413741) * u - 0.284496736) * u + 0.254829592) * u * F.exp(-a * a)
    cdf = 0.5 * (1 + F.signum("z") * erf)
    return t.agg(F.max("n").alias("n"), F.max("mean").alias("mean"), F.max("sd").alias("sd"), F.max(F.greatest(F.abs(F.col("high") - cdf), F.abs(F.col("low") - cdf))).alias("distance"))


def jarque_bera(df: DataFrame, value: str, by: str | None = None) -> DataFrame:
    """(by, n, statistic): n / 6 * (skewness^2 + kurtosis^2 / 4)."""
    d = descriptives(df, value, by)
    return d.select(*([by] if by else []), "n", (F.col("n") / 6 * (F.col("skewness") * F.col("skewness") + F.col("kurtosis") * F.col("kurtosis") / 4)).alias("statistic"))


def _digamma(x: float) -> float:
    out = 0.0
    while x < 6:
        out -= 1 / x
        x += 1
    f = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f / 252))


def fit_shapes(df: DataFrame, value: str, rounds: int = 60) -> DataFrame:
    """(family, parameters, log_likelihood, aic) of gamma, Weibull and negative binomial over positive values. The likelihoods need sums only: a histogram of the
    values is made once, and each round of the Weibull search is an aggregate over it."""
    x = F.col(value).cast("double")
    hist = df.where(x > 0).groupBy(x.alias("x")).agg(F.count("*").cast("double").alias("k")).persist()
    s = hist.agg(F.sum("k").alias("n"), (F.sum(F.col("k") * F.col("x")) / F.sum("k")).alias("m"), (F.sum(F.col("k") * F.log("x")) / F.sum("k")).alias("l"), (F.sum(F.col("k") * F.col("x") * F.col("x")) / F.sum("k")).alias("q")).first()
    n, m, log_mean, var = s["n"], s["m"], s["l"], s["q"] - s["m"] ** 2
    lo, hi = 1e-3, 1e3
    for _ in range(rounds):  # log a - digamma(a) falls in a
        a = math.sqrt(lo * hi)
        lo, hi = (a, hi) if math.log(a) - _digamma(a) > math.log(m) - log_mean else (lo, a)
    gamma = n * ((a - 1) * log_mean - a - a * math.log(m / a) - math.lgamma(a))
    lo, hi = 1e-2, 50.0
    for _ in range(25):
        c = math.sqrt(lo * hi)
        p = F.col("k") * F.pow(F.col("x") / m, F.lit(c))
        r = hist.agg(F.sum(p).alias("a"), F.sum(p * F.log(F.col("x"))).alias("b")).first()
        lo, hi = (c, hi) if r["b"] / r["a"] - 1 / c - log_mean < 0 else (lo, c)
    scale = m * (r["a"] / n) ** (1 / c)
    weibull = n * (math.log(c) - c * math.log(scale) + (c - 1) * log_mean) - r["a"] * (m / scale) ** c
    rows = [("gamma", [a, m / a], gamma, 2), ("weibull", [c, scale], weibull, 2)]
    if var > m:
        size = m * m / (var - m)
        # ln C(x + r - 1, x) by Stirling's series in the engine
        lg = lambda z: (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z)
        ll = hist.agg(F.sum(F.col("k") * (lg(F.col("x") + size) - lg(F.col("x") + 1) + F.col("x") * math.log(m / (m + size))))).first()[0] + n * (size * math.log(size / (m + size)) - math.lgamma(size))
        rows.append(("negative binomial", [size, size / (m + size)], ll, 2))
    hist.unpersist()
    return df.sparkSession.createDataFrame([(f, [float(v) for v in p], float(ll), 2.0 * k - 2 * float(ll)) for f, p, ll, k in rows], "family string, parameters array<double>, log_likelihood double, aic double")


def normality(df: DataFrame, value: str) -> dict:
    """Shapiro-Wilk for up to 5000 values, else the Kolmogorov-Smirnov distance with its asymptotic p-value."""
    x = df.select(F.col(value).cast("double").alias("x")).where("x IS NOT NULL")
    some = [r[0] for r in x.limit(5001).collect()]
    if len(some) <= 5000:
        w, p = dist.shapiro_wilk(some)
        return {"test": "shapiro-wilk", "statistic": w, "p": p, "n": len(some)}
    r = ks_normal(df, value).first()
    z = r["distance"] * math.sqrt(r["n"])
    p = min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * (k * z) ** 2) for k in range(1, 101))))
    return {"test": "kolmogorov-smirnov", "statistic": r["distance"], "p": p, "n": r["n"]}


def alexander_govern(df: DataFrame, value: str, by: str) -> DataFrame:
    """One row: the Alexander-Govern statistic (equal means, unequal variances), chi-square with groups - 1 degrees of freedom. Groups of one row are left out."""
    g = df.where(F.col(value).isNotNull() & F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n"), F.avg(value).alias("m"), (F.var_samp(value) / F.count("*")).alias("v")).where("n > 1 AND v > 0")
    total = g.select(F.sum(1 / F.col("v"))).scalar()
    mean = g.select(F.sum(F.col("m") / F.col("v"))).scalar() / total
    t, nu = (F.col("m") - mean) / F.sqrt("v"), F.col("n") - 1
    a = nu - 0.5
    b, c = 48 * a * a, F.sqrt(a * F.log(1 + t * t / nu))
    c3, c5, c7 = (F.pow(c, F.lit(k)) for k in (3, 5, 7))
    z = c + (c3 + 3 * c) / b - (4 * c7 + 33 * c5 + 240 * c3 + 855 * c) / (10 * b * b + 8 * b * F.pow(c, F.lit(4)) + 1000 * b)
    return g.agg(F.sum(z * z).alias("statistic"), (F.count("*") - 1).alias("dof"))
