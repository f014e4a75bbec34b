"""Regressions and spatial statistics: Spark reduces rows to moments, the driver solves systems of a few columns."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def moments(df: DataFrame, columns: list[str], *by: str) -> DataFrame:
    """Number of rows and all sums of products of the columns (as an array, upper triangle), one grouped pass. Rows with
    a null are left out."""
    full = df.dropna(subset=columns)
    pairs = [F.sum(F.col(a) * F.col(b)).alias(f"m{i}") for i, (a, b) in enumerate((columns[i], columns[j]) for i in range(len(columns)) for j in range(i, len(columns)))]
    out = full.groupBy(*by).agg(F.count("*").alias("n"), *pairs)
    return out.select(*by, "n", F.array(*[F.col(f"m{i}") for i in range(len(pairs))]).alias("moments"))


def matrix(values: list[float], p: int) -> np.ndarray:
    out = np.zeros((p, p))
    out[np.triu_indices(p)] = values
    return out + np.triu(out, 1).T


def t_tail(t: float, df: float) -> float:
    """Two-sided tail of Student's t by the continued fraction of the incomplete beta function."""
    if not math.isfinite(t) or df <= 0:
        return float("nan")
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))

    def fraction(a: float, b: float, x: float) -> float:
        c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
        h = d
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 / (1 + num * d), 1 + num / c
                h *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return h

    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation, by Student's t with n - 2 degrees of freedom; for tables of one row per group."""

    def tails(r: pd.Series, n: pd.Series) -> pd.Series:
        t = lambda r, d: math.inf if abs(r) >= 1 else r * math.sqrt(d / (1 - r * r))
        p = lambda r, n: None if pd.isna(r) or n < 3 else 0.0 if abs(r) >= 1 else t_tail(t(r, n - 2), n - 2)
        return pd.Series([p(a, b) for a, b in zip(r, n)], dtype="float64")

    return F.pandas_udf(tails, T.DoubleType())(r, n)


def normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def least_squares(n: int, m: np.ndarray) -> dict:
    """From the moments of (X..., y): coefficients, standard errors, sigma, log-likelihood, AIC (sigma counts)."""
    xx, xy, yy = m[:-1, :-1], m[:-1, -1], m[-1, -1]
    beta = np.linalg.solve(xx, xy)
    p = len(beta)
    rss = max(float(yy - beta @ xy), 0.0)
    s2 = rss / max(n - p, 1)
    se = np.sqrt(np.maximum(np.diag(np.linalg.inv(xx)) * s2, 0))
    loglik = -n / 2 * (math.log(2 * math.pi) + math.log(max(rss, 1e-300) / n) + 1)
    t = beta / np.where(se > 0, se, np.nan)
    return {"beta": beta, "se": se, "t": t, "p": np.array([t_tail(v, n - p) for v in t]), "sigma": math.sqrt(s2), "rss": rss, "loglik": loglik, "aic": 2 * (p + 1) - 2 * loglik}


def fit_groups(df: DataFrame, y: str, x: list[str], *by: str) -> DataFrame:
    """Least squares in every group at once; the design has an intercept. One row per group and term."""
    design = ["intercept", *x]
    rows = []
    for r in moments(df.withColumn("intercept", F.lit(1.0)), [*design, y], *by).collect():  # one row per group
        fit = least_squares(r.n, matrix(r.moments, len(design) + 1))
        rows += [(*[r[b] for b in by], term, float(fit["beta"][k]), float(fit["se"][k]), float(fit["p"][k]), r.n, fit["loglik"], fit["aic"]) for k, term in enumerate(design)]
    kinds = [f"{b} {dict(df.dtypes)[b]}" for b in by]
    return df.sparkSession.createDataFrame(rows, ", ".join([*kinds, "term string", "estimate double", "std_error double", "p_value double", "n long", "loglik double", "aic double"]))


def fit_scenarios(df: DataFrame, scenarios: dict[str, tuple[Column, str, list[str]]], measures: list[str]) -> DataFrame:
    """Least squares of every scenario (rows kept, outcome, controls) and measure: scenario, measure, n, estimate,
    std_error, p_value. Each row goes to the scenarios that keep it, and one grouped pass sums the moments of all
    columns of a scenario; the models of its measures are blocks of that matrix."""
    outcomes = sorted({y for _, y, _ in scenarios.values()})
    controls = sorted({c for _, _, cs in scenarios.values() for c in cs})
    columns = ["intercept", *controls, *measures, *outcomes]
    kept = F.filter(F.array(*[F.when(keep, F.lit(name)) for name, (keep, _, _) in scenarios.items()]), lambda s: s.isNotNull())
    long = df.withColumn("intercept", F.lit(1.0)).select(F.explode(kept).alias("scenario"), *columns)
    rows = []
    for r in moments(long, columns, "scenario").collect():  # one row per scenario
        full = matrix(r.moments, len(columns))
        _, y, own = scenarios[r.scenario]
        for measure in measures:
            at = [columns.index(c) for c in ("intercept", *own, measure, y)]
            fit = least_squares(r.n, full[np.ix_(at, at)])
            rows.append((r.scenario, measure, r.n, float(fit["beta"][-1]), float(fit["se"][-1]), float(fit["p"][-1])))
    return df.sparkSession.createDataFrame(rows, "scenario string, measure string, n long, estimate double, std_error double, p_value double")


def linear(beta: np.ndarray, x: list[str]) -> Column:
    out = F.lit(float(beta[0]))
    for b, c in zip(beta[1:], x):
        out = out + float(b) * F.col(c)
    return out


def hc3(df: DataFrame, y: str, x: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and HC3 covariance: a second pass sums x x' e^2 / (1 - h)^2, with leverage as column arithmetic."""
    design = ["intercept", *x]
    full = df.withColumn("intercept", F.lit(1.0)).dropna(subset=[*x, y])
    r = moments(full, [*design, y]).first()
    m = matrix(r.moments, len(design) + 1)
    fit, inv = least_squares(r.n, m), np.linalg.inv(m[:-1, :-1])
    leverage = F.lit(0.0)
    for a, ca in enumerate(design):
        for b, cb in enumerate(design):
            leverage = leverage + float(inv[a, b]) * F.col(ca) * F.col(cb)
    e = (F.col(y) - linear(fit["beta"], x)) / (1 - leverage)
    meat = moments(full.select(*[(F.col(c) * e).alias(c) for c in design]), design).first()
    return fit["beta"], inv @ matrix(meat.moments, len(design)) @ inv


def vif(df: DataFrame, x: list[str]) -> dict[str, float]:
    """Diagonal of the inverse correlation matrix, from one pass."""
    r = moments(df.withColumn("intercept", F.lit(1.0)), ["intercept", *x]).first()
    m = matrix(r.moments, len(x) + 1)
    cov = m[1:, 1:] / r.n - np.outer(m[0, 1:], m[0, 1:]) / r.n**2
    sd = np.sqrt(np.diag(cov))
    return dict(zip(x, np.diag(np.linalg.inv(cov / np.outer(sd, sd))).tolist()))


def weights(neighbours: DataFrame) -> DataFrame:
    """i, j, w with rows that sum to one."""
    n = neighbours.groupBy("i").agg(F.count("*").alias("n"))
    return neighbours.join(n, "i").select("i", "j", (1.0 / F.col("n")).alias("w"))


def lag(values: DataFrame, w: DataFrame, *columns: str) -> DataFrame:
    """values: id, columns -> id and the weighted mean of the neighbours' values."""
    near = w.join(values.withColumnRenamed("id", "j"), "j")
    return near.groupBy(F.col("i").alias("id")).agg(*[F.sum(F.col("w") * F.col(c)).alias(f"lag_{c}") for c in columns])


def morans_i(values: DataFrame, w: DataFrame, column: str) -> dict[str, float]:
    """Moran's I with its mean and variance under randomisation, from a few sums; S1 by a full join of W with itself."""
    mean = values.agg(F.avg(column)).first()[0]
    z = values.select("id", (F.col(column) - mean).alias("z"))
    s = z.agg(F.count("*").alias("n"), F.sum(F.col("z") ** 2).alias("z2"), F.sum(F.col("z") ** 4).alias("z4")).first()
    cross = w.join(z.withColumnRenamed("id", "i").withColumnRenamed("z", "zi"), "i").join(z.withColumnRenamed("id", "j").withColumnRenamed("z", "zj"), "j").agg(F.sum(F.col("w") * F.col("zi") * F.col("zj"))).first()[0]
    back = w.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("w").alias("wb"))
    s1 = w.join(back, ["i", "j"], "full").agg(F.sum((F.coalesce("w", F.lit(0.0)) + F.coalesce("wb", F.lit(0.0))) ** 2)).first()[0] / 2
    rows, cols = w.groupBy(F.col("i").alias("id")).agg(F.sum("w").alias("r")), w.groupBy(F.col("j").alias("id")).agg(F.sum("w").alias("c"))
    s2 = rows.join(cols, "id", "full").agg(F.sum((F.coalesce("r", F.lit(0.0)) + F.coalesce("c", F.lit(0.0))) ** 2)).first()[0]
    s0 = w.agg(F.sum("w")).first()[0]
    n, i, e = s.n, s.n / s0 * cross / s.z2, -1 / (s.n - 1)
    b2 = n * s.z4 / s.z2**2
    var = (n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * s0 * s0) - b2 * ((n * n - n) * s1 - 2 * n * s2 + 6 * s0 * s0)) / ((n - 1) * (n - 2) * (n - 3) * s0 * s0) - e * e
    return {"i": i, "expected": e, "variance": var, "p": normal_tail((i - e) / math.sqrt(var))}


def residual_moran(df: DataFrame, w: DataFrame, y: str, x: list[str]) -> dict[str, float]:
    """Moran's I of least-squares residuals, with mean and variance that know the design (Cliff and Ord): all traces come
    from sums of products of X, WX and W'X and of W with itself."""
    design = ["intercept", *x]
    full = df.withColumn("intercept", F.lit(1.0))
    r = moments(full, [*design, y]).first()
    m, p = matrix(r.moments, len(design) + 1), len(design)
    fit, inv = least_squares(r.n, m), np.linalg.inv(m[:-1, :-1])
    res = full.select("id", (F.col(y) - linear(fit["beta"], x)).alias("e"))
    e2 = fit["rss"]
    both = w.join(res.withColumnRenamed("id", "i").withColumnRenamed("e", "ei"), "i").join(res.withColumnRenamed("id", "j").withColumnRenamed("e", "ej"), "j")
    s0, cross = w.agg(F.sum("w")).first()[0], both.agg(F.sum(F.col("w") * F.col("ei") * F.col("ej"))).first()[0]
    # the symmetric part of W, whose quadratic form is the same
    half = w.select("i", "j", (F.col("w") / 2).alias("w"))
    sym = half.unionByName(half.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")).groupBy("i", "j").agg(F.sum("w").alias("w"))
    lagged = full.select("id", *design).join(lag(full.select("id", *design), sym, *design), "id", "left").fillna(0.0)
    g = matrix(moments(lagged, [*design, *[f"lag_{c}" for c in design]]).first().moments, 2 * p)
    xsx, xssx = g[:p, p:], g[p:, p:]
    tr_ss = sym.agg(F.sum(F.col("w") ** 2)).first()[0]
    a = inv @ xsx
    n, k = r.n, r.n - p
    tr1 = -np.trace(a)
    tr2 = tr_ss - 2 * np.trace(inv @ xssx) + np.trace(a @ a)
    e = n / s0 * tr1 / k
    var = (n / s0) ** 2 * 2 * (tr2 - tr1 * tr1 / k) / (k * (k + 2))
    i = n / s0 * cross / e2
    return {"i": i, "expected": float(e), "variance": float(var), "p": normal_tail((i - e) / math.sqrt(var))}


#: Sites up to which the eigenvalues of W are taken; probes and powers beyond.
DENSE, PROBES, POWERS = 2000, 64, 40


def traces(w: DataFrame, order: int = POWERS, probes: int = PROBES) -> list[float]:
    """tr(W^k) for k = 1..order by Hutchinson's estimate: W is joined with ``probes`` vectors of signs once a round, so
    that a round costs edges x probes however dense the power is. Signs come from the ids' hashes."""
    from tidemark.operators.graph import Rounds

    sign = lambda k: (1 - 2 * F.pmod(F.xxhash64("id", F.lit(k)), F.lit(2))).cast("double")
    ids = w.select(F.col("i").alias("id")).union(w.select("j")).distinct()
    rounds, out = Rounds(w.sparkSession, "probes"), []
    now = rounds.put(ids.select("id", *[sign(k).alias(f"u{k}") for k in range(probes)]))
    for _ in range(order):
        step = w.join(now.withColumnRenamed("id", "j"), "j").groupBy(F.col("i").alias("id"))
        now = rounds.put(step.agg(*[F.sum(F.col("w") * F.col(f"u{k}")).alias(f"u{k}") for k in range(probes)]))
        total = F.lit(0.0)
        for k in range(probes):
            total = total + sign(k) * F.col(f"u{k}")
        out.append((now.agg(F.sum(total)).first()[0] or 0.0) / probes)
    return out


class Spectrum:
    """ln det(I - rho W) and the mean diagonal of its inverse, for a row-standardised W.

    Up to DENSE sites (checked) from the eigenvalues, exactly. Beyond, from estimated traces: later ones count as 1 each,
    the part of the one unit eigenvalue, which the logarithm closes; what is left out is at most n |rho|^(POWERS + 1)
    times the POWERS + 1st power of the second eigenvalue, over POWERS (1 - |rho|)."""

    def __init__(self, w: DataFrame, dense: int = DENSE):
        ids = w.select(F.col("i").alias("id")).union(w.select("j")).distinct()
        self.n = ids.count()
        self.values = self.traces = None
        if self.n <= dense:
            rows = w.select("i", "j", "w").toPandas()  # at most dense sites with their few neighbours
            place = {v: k for k, v in enumerate(sorted({*rows.i, *rows.j}))}
            full = np.zeros((self.n, self.n))
            np.add.at(full, (rows.i.map(place).to_numpy(), rows.j.map(place).to_numpy()), rows.w.to_numpy())
            self.values = np.linalg.eigvals(full)
        else:
            self.traces = traces(w)

    def log_det(self, rho: float) -> float:
        if self.values is not None:
            return float(np.log(np.abs(1 - rho * self.values)).sum())
        return -sum(rho**j * (t - 1) / j for j, t in enumerate(self.traces, 1)) + math.log1p(-rho)

    def direct(self, rho: float) -> float:
        if self.values is not None:
            return float((1 / (1 - rho * self.values)).real.mean())
        powers = sum(rho**j * (t - 1) for j, t in enumerate(self.traces, 1))
        return 1 + (powers + rho / (1 - rho)) / self.n


def golden(f, low: float, high: float, rounds: int = 80) -> float:
    g = (math.sqrt(5) - 1) / 2
    a, b = low, high
    c, d = b - g * (b - a), a + g * (b - a)
    fc, fd = f(c), f(d)
    for _ in range(rounds):
        if fc > fd:
            b, d, fd = d, c, fc
            c = b - g * (b - a)
            fc = f(c)
        else:
            a, c, fc = c, d, fd
            d = a + g * (b - a)
            fd = f(d)
    return (a + b) / 2


def lag_fit(m: np.ndarray, n: int, spectrum: Spectrum) -> dict:
    """y = rho W y + X b by concentrated likelihood, from the moments of (X, y, Wy)."""
    p = len(m) - 2
    inv = np.linalg.inv(m[:p, :p])

    def at(rho: float) -> tuple[float, np.ndarray, float]:
        xy = m[:p, p] - rho * m[:p, p + 1]
        yy = m[p, p] - 2 * rho * m[p, p + 1] + rho * rho * m[p + 1, p + 1]
        beta = inv @ xy
        s2 = max(yy - xy @ beta, 1e-300) / n
        return -n / 2 * (math.log(2 * math.pi * s2) + 1) + spectrum.log_det(rho), beta, s2

    rho = golden(lambda v: at(v)[0], -0.99, 0.99)
    h = 1e-4
    info = -(at(rho + h)[0] - 2 * at(rho)[0] + at(rho - h)[0]) / h**2
    loglik, beta, s2 = at(rho)
    se_rho = 1 / math.sqrt(info) if info > 0 else float("nan")
    return {"rho": rho, "se_rho": se_rho, "p_rho": normal_tail(rho / se_rho), "beta": beta, "se": np.sqrt(np.diag(inv) * s2), "loglik": loglik, "aic": 2 * (p + 2) - 2 * loglik}


def spatial_lag_model(df: DataFrame, w: DataFrame, y: str, x: list[str], spectrum: Spectrum | None = None) -> dict:
    """The lag model of a table; moments of (X, y, Wy) and the spectrum of W are all that it needs."""
    design = ["intercept", *x]
    full = df.withColumn("intercept", F.lit(1.0))
    r = moments(full.join(lag(full.select("id", y), w, y), "id"), [*design, y, f"lag_{y}"]).first()
    spectrum = spectrum or Spectrum(w)
    fit = lag_fit(matrix(r.moments, len(design) + 2), r.n, spectrum)
    direct, total = spectrum.direct(fit["rho"]), 1 / (1 - fit["rho"])
    return fit | {"impacts": {c: {"direct": b * direct, "total": b * total, "indirect": b * (total - direct)} for c, b in zip(x, fit["beta"][1:].tolist())}}


def error_fit(m: np.ndarray, n: int, spectrum: Spectrum) -> dict:
    """y = X b + u, u = lambda W u + e, from the moments of (X, y, WX, Wy), which are quadratic in lambda."""
    q = len(m) // 2

    def at(lam: float) -> tuple[float, np.ndarray, float, np.ndarray]:
        g = m[:q, :q] - lam * (m[:q, q:] + m[q:, :q]) + lam * lam * m[q:, q:]
        inv = np.linalg.inv(g[:-1, :-1])
        beta = inv @ g[:-1, -1]
        s2 = max(g[-1, -1] - g[:-1, -1] @ beta, 1e-300) / n
        return -n / 2 * (math.log(2 * math.pi * s2) + 1) + spectrum.log_det(lam), beta, s2, inv

    lam = golden(lambda v: at(v)[0], -0.99, 0.99)
    loglik, beta, s2, inv = at(lam)
    return {"lambda": lam, "beta": beta, "se": np.sqrt(np.diag(inv) * s2), "loglik": loglik, "aic": 2 * (q + 1) - 2 * loglik}


def spatial_error_model(df: DataFrame, w: DataFrame, y: str, x: list[str], spectrum: Spectrum | None = None) -> dict:
    """The error model of a table."""
    names = ["intercept", *x, y]
    full = df.withColumn("intercept", F.lit(1.0))
    both = full.join(lag(full.select("id", *names), w, *names), "id")
    r = moments(both, [*names, *[f"lag_{c}" for c in names]]).first()
    return error_fit(matrix(r.moments, 2 * len(names)), r.n, spectrum or Spectrum(w))


def choose_family(candidates: DataFrame) -> DataFrame:
    """outcome, family, aic, moran_p -> the family used: plain least squares if its residuals are clean (p >= .05), else
    the spatial family of least AIC that is clean, else the least AIC."""
    rank = F.when((F.col("family") == "ols") & (F.col("moran_p") >= 0.05), 0).when((F.col("family") != "ols") & (F.col("moran_p") >= 0.05), 1).otherwise(2)
    return candidates.groupBy("outcome").agg(F.min(F.struct(rank.alias("rank"), "aic", "family")).alias("b")).select("outcome", "b.family", "b.aic")


#: Sites of which the kernel's eigenvectors are taken; those of more sites are extended from that many.
KNOTS = 2000


def _site_sums(full: DataFrame, site: str, columns: list[str]) -> tuple[DataFrame, list[str]]:
    """One row per site, as a table: its number of rows (size) and the sums of the columns."""
    from tidemark.operators.graph import written

    names = [f"s{k}" for k in range(len(columns))]
    return written(full.groupBy(site).agg(F.count("*").alias("size"), *[F.sum(c).alias(s) for c, s in zip(columns, names)]), "sites"), names


def _skewness(residuals: DataFrame) -> float:
    """Third central moment over the cube of the sample sd."""
    r = residuals.agg(F.count("residual").alias("n"), F.skewness("residual").alias("g")).first()
    return float("nan") if r.n < 2 or r.g is None else r.g * ((r.n - 1) / r.n) ** 1.5


def mixed_model(df: DataFrame, y: str, x: list[str], site: str) -> dict:
    """Random intercept by site, REML. V^-1 has a closed form per site: X'V^-1X = sum of X_j'X_j - theta / (1 + n_j theta)
    s_j s_j'. The factor depends on n_j alone, so the profile over the variance ratio needs the sums of s_j s_j' of all
    sites of one size: one row per number of rows that a site has reaches the driver. ``blup`` (site, blup) and
    ``residuals`` (the rows of df with residual) stay tables."""
    design = ["intercept", *x]
    full = df.withColumn("intercept", F.lit(1.0)).dropna(subset=[*x, y])
    p = len(design)
    sites, names = _site_sums(full, site, [*design, y])
    alike = moments(sites, names, "size").collect()  # one row per size
    r = moments(full, [*design, y]).first()
    m, n = matrix(r.moments, p + 1), r.n
    cross = np.array([matrix(row.moments, p + 1) for row in alike])
    size, count = np.array([row["size"] for row in alike], float), np.array([row.n for row in alike], float)

    def at(theta: float) -> tuple[float, np.ndarray, float, np.ndarray]:
        g = m - np.tensordot(theta / (1 + size * theta), cross, 1)
        inv = np.linalg.inv(g[:p, :p])
        beta = inv @ g[:p, p]
        rss = max(g[p, p] - beta @ g[:p, p], 1e-300)
        s2 = rss / (n - p)
        loglik = -0.5 * ((n - p) * (math.log(2 * math.pi * s2) + 1) + count @ np.log1p(size * theta) + np.linalg.slogdet(g[:p, :p])[1])
        return loglik, beta, s2, inv

    theta = math.exp(golden(lambda v: at(math.exp(v))[0], -12, 8))
    if at(0.0)[0] >= at(theta)[0]:
        theta = 0.0
    loglik, beta, s2, inv = at(theta)
    se = np.sqrt(np.diag(inv) * s2)
    rest = F.col(names[p])
    for b, c in zip(beta, names):
        rest = rest - float(b) * F.col(c)
    blup = sites.select(site, (theta / (1 + F.col("size") * theta) * rest).alias("blup"))
    residuals = full.join(blup, site).withColumn("residual", F.col(y) - linear(beta, x) - F.col("blup")).select(*df.columns, "residual")
    k = p + 2
    return {
        "term": design, "beta": beta, "se": se, "p": np.array([normal_tail(b / e) if e > 0 else float("nan") for b, e in zip(beta, se)]), "sigma2": s2, "site_variance": theta * s2, "icc": theta / (1 + theta), "loglik": loglik,
        "aic": 2 * k - 2 * loglik, "bic": k * math.log(n) - 2 * loglik, "n": n, "blup": blup, "residuals": residuals, "residual_skewness": _skewness(residuals),
    }


def longest_tree_edge(xy: np.ndarray) -> float:
    """Longest edge of the minimum spanning tree of the knots (Prim: a few numbers per knot)."""
    near, longest = np.full(len(xy), np.inf), 0.0
    todo, at = np.ones(len(xy), bool), 0
    for _ in range(len(xy) - 1):
        todo[at] = False
        near = np.minimum(near, np.hypot(*(xy - xy[at]).T))
        at = int(np.where(todo, near, np.inf).argmin())
        longest = max(longest, float(near[at]))
    return longest


def moran_basis(points: DataFrame, most: int = 200, knots: int = KNOTS) -> tuple[DataFrame, np.ndarray]:
    """Eigenvectors of the double-centred kernel exp(-d / r) of the sites with positive values: id, e (array); the values.

    The driver solves the kernel of at most ``knots`` sites (a sample by the ids' hashes, if there are more); tasks extend
    the vectors to all sites from their kernel towards the knots (Nystroem). For knots that formula gives back the vector
    itself, so up to ``knots`` sites the result is exact; r is the longest tree edge of the knots."""
    chosen = points.select("id", "x", "y").orderBy(F.xxhash64("id"), "id").limit(knots).collect()  # a bounded sample
    ids, xy = np.array([c.id for c in chosen]), np.array([(c.x, c.y) for c in chosen], float).reshape(-1, 2)
    reach = max(longest_tree_edge(xy), 1e-12)

    def kernel(of: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        k = np.exp(-np.hypot(x[:, None] - xy[None, :, 0], y[:, None] - xy[None, :, 1]) / reach)
        return np.where(of[:, None] == ids[None, :], 0.0, k)

    k = kernel(ids, xy[:, 0], xy[:, 1])
    by_knot, mean = k.mean(axis=0), k.mean()
    values, vectors = np.linalg.eigh(k - by_knot - k.mean(axis=1)[:, None] + mean)
    order = np.argsort(-values)[: min(most, len(values))]
    order = order[values[order] > 1e-8]
    values = values[order]
    onto = vectors[:, order] / values * math.sqrt(len(ids) / max(points.count(), 1))

    def extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), 1000):
                part = batch.iloc[a : a + 1000]
                k = kernel(part.id.to_numpy(), part.x.to_numpy(float), part.y.to_numpy(float))
                yield pd.DataFrame({"id": part.id, "e": list((k - by_knot - k.mean(axis=1)[:, None] + mean) @ onto)})

    return points.select("id", "x", "y").mapInPandas(extend, f"id {dict(points.dtypes)['id']}, e array<double>"), values


def _products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """size, u (array) -> size, count, sums: the sum of u u' of the sites of one size, upper triangle, of one partition."""
    found: dict[int, tuple[int, np.ndarray]] = {}
    for batch in batches:
        for size, part in batch.groupby("size"):
            u = np.stack(part.u.to_numpy())
            n, old = found.get(size, (0, 0.0))
            found[size] = n + len(u), old + u.T @ u
    if found:
        yield pd.DataFrame({"size": list(found), "count": [n for n, _ in found.values()], "sums": [m[np.triu_indices(len(m))] for _, m in found.values()]})


def _added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial sums of ``_products`` added up, one row after the other."""
    found: dict[int, tuple[int, np.ndarray]] = {}
    for batch in batches:
        for size, count, sums in zip(batch["size"], batch["count"], batch["sums"]):
            n, old = found.get(size, (0, 0.0))
            found[size] = n + count, old + np.asarray(sums)
    if found:
        yield pd.DataFrame({"size": list(found), "count": [n for n, _ in found.values()], "sums": [m for _, m in found.values()]})


def filtered_mixed_model(df: DataFrame, points: DataFrame, y: str, x: list[str], site: str, most: int = 200, knots: int = KNOTS) -> dict:
    """Random effects eigenvector filtering: y = X b + E g + site intercept + e, var(g_k) ~ value_k ** alpha, by REML.

    E is constant within a site and the site intercept has the closed form of ``mixed_model``, so what the search over
    three variance parameters needs of all sites of one size is the sum of u u', u = (E_j, sums of X and y): tasks sum it,
    and one row per size of a site reaches the driver, where coordinate steps solve systems of as many columns as there
    are eigenvectors. ``site_effect`` (site, effect) and ``residuals`` (the rows of df with residual) stay tables."""
    from tidemark.operators.graph import written

    basis, values = moran_basis(points, most, knots)
    design = ["intercept", *x]
    full = df.withColumn("intercept", F.lit(1.0)).dropna(subset=[*x, y]).join(points.select(F.col("id").alias(site)), site, "left_semi")
    p, q = len(design), len(values)
    sums, names = _site_sums(full, site, [*design, y])
    sites = written(sums.join(basis.withColumnRenamed("id", site), site).withColumn("u", F.concat("e", F.array(*names))), "filtered")
    kinds = "size long, count long, sums array<double>"
    alike = sites.select("size", "u").mapInPandas(_products, kinds).repartition("size").mapInPandas(_added, kinds).collect()  # one row per size
    cross = np.array([matrix(row.sums, q + p + 1).ravel() for row in alike])
    size, count = np.array([row["size"] for row in alike], float), np.array([row["count"] for row in alike], float)
    r = moments(full, [*design, y]).first()
    m, n = matrix(r.moments, p + 1), r.n

    @lru_cache(maxsize=4)  # steps along the other two parameters leave these sums as they are
    def weighted(log_own: float) -> tuple[np.ndarray, ...]:
        own = max(math.exp(log_own), 1e-12)
        less = 1 / (1 + size * own)
        total = lambda w: (w @ cross).reshape(q + p + 1, q + p + 1)
        by_size, once = total(size * less), total(less)
        return by_size[:q, :q], once[:q, q:], own * once[q:, q:], less

    def at(theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, float, np.ndarray]:
        spread = np.maximum(np.exp(theta[0]) * (values / values.sum()) ** math.exp(theta[1]) * q, 1e-12)
        ee, zs, ss, less = weighted(float(theta[2]))
        h = ee + np.diag(1 / spread)
        hi = np.linalg.solve(h, zs)
        g = m - ss - zs.T @ hi
        inv = np.linalg.inv(g[:p, :p])
        beta = inv @ g[:p, p]
        s2 = max(g[p, p] - beta @ g[:p, p], 1e-300) / (n - p)
        loglik = -0.5 * ((n - p) * (math.log(2 * math.pi * s2) + 1) + np.linalg.slogdet(h)[1] + np.log(spread).sum() - count @ np.log(less) + np.linalg.slogdet(g[:p, :p])[1])
        return loglik, beta, hi[:, p] - hi[:, :p] @ beta, s2, inv

    theta = np.array([-1.0, 0.0, -1.0])
    for _ in range(6):
        for k, (low, high) in enumerate(((-10.0, 6.0), (-4.0, 2.0), (-10.0, 6.0))):

            def along(v: float, k: int = k) -> float:
                t = theta.copy()
                t[k] = v
                return at(t)[0]

            theta[k] = golden(along, low, high, 30)
    loglik, beta, g, s2, inv = at(theta)
    own = max(math.exp(theta[2]), 1e-12)
    smooth = F.aggregate(F.zip_with("e", F.lit(g.tolist()).cast("array<double>"), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    rest = F.col(names[p])
    for b, c in zip(beta, names):
        rest = rest - float(b) * F.col(c)
    effect = sites.withColumn("smooth", smooth).select(site, (F.col("smooth") + own / (1 + F.col("size") * own) * (rest - F.col("size") * F.col("smooth"))).alias("effect"))
    residuals = full.join(effect, site).withColumn("residual", F.col(y) - linear(beta, x) - F.col("effect")).select(*df.columns, "residual")
    se = np.sqrt(np.diag(inv) * s2)
    return {"term": design, "beta": beta, "se": se, "p": np.array([normal_tail(b / e_) for b, e_ in zip(beta, se)]), "sigma2": s2, "loglik": loglik, "vectors": q, "theta": theta, "site_effect": effect, "residuals": residuals, "n": n}
