"""Model fits: likelihoods by aggregation, information criteria, bounded least squares on spectra."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelweave.scratch import Scratch

LN10 = math.log(10.0)


# ---- curves: f(V) = V dN/dlogV --------------------------------------------------------------------------------
#: Slopes of the models with given slopes (minus gamma below the break, minus beta above it).
GAMMA_FIXED, BETA_FIXED = 0.0, -4.0 / 9.0
#: Fixed value: least model value whose logarithm is taken.
FLOOR = 1e-30


def power_law(x: Column, a: float, alpha: float) -> Column:
    return F.lit(a) * F.pow(x, F.lit(alpha))


def broken_power_law(x: Column, a: float, log_v0: float, gamma: float, beta: float, log_cut: float, m: float, sharpness: float = 1.0) -> Column:
    """Power law of slope -gamma below 10**log_v0 and -beta above, with an exponential cut-off of small V.

    ``sharpness`` 1 is the plain double power law, others widen or narrow the break; the cut-off is
    exp(-(10**log_cut / V)**m).
    """
    r = x / F.lit(10.0**log_v0)
    bend = F.pow(F.lit(1.0) + F.pow(r, F.lit(sharpness)), F.lit((gamma - beta) / sharpness))
    return F.lit(a) * F.pow(r, F.lit(-gamma)) * bend * F.exp(-F.pow(F.lit(10.0**log_cut) / x, F.lit(m)))


def log_floor(x: Column) -> Column:
    return F.log10(F.greatest(x, F.lit(FLOOR)))


def log10_broken(u: np.ndarray, log_v0: float, gamma: float, beta: float, log_cut: float, m: float, sharpness: float = 1.0) -> np.ndarray:
    """log10 of ``broken_power_law`` of unit amplitude at V = 10**u."""
    r = u - log_v0
    bend = np.logaddexp(0, sharpness * r * LN10) * (gamma - beta) / sharpness / LN10
    return bend - gamma * r - np.minimum(10 ** np.minimum((log_cut - u) * m, 300), 1e300) / LN10


# ---- truncated power law in log10 V: one aggregate serves every exponent ---------------------------------------
def powerlaw_statistics(df: DataFrame, col: str, cuts: list[float]) -> DataFrame:
    """``cut, n, sum_log, lo, hi`` of log10 of the values above each cut (strict); cuts without values are absent."""
    x = F.col(col).cast("double")
    many = df.where(x > min(cuts)).select(x.alias("v_"), F.explode(F.array(*(F.lit(float(c)) for c in cuts))).alias("cut")).where("v_ > cut")
    y = F.log10("v_")
    return many.groupBy("cut").agg(F.count("*").alias("n"), F.sum(y).alias("sum_log"), F.min(y).alias("lo"), F.max(y).alias("hi"))


def powerlaw_nll(alpha: Column | float, n: Column = F.col, s: Column = F.col) -> Column:  # type: ignore[assignment]
    """Negative log likelihood of density ~ 10**(alpha y) on [lo, hi], from the statistics' columns."""
    a = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    c = a * F.lit(LN10)
    norm = F.when(F.abs(a) < 1e-8, F.log(F.col("hi") - F.col("lo"))).otherwise(F.log((F.exp(c * F.col("hi")) - F.exp(c * F.col("lo"))) / c))
    return F.col("n") * norm - c * F.col("sum_log")


def nll_value(alpha: float, n: int, s: float, lo: float, hi: float) -> float:
    c = alpha * LN10
    norm = math.log(hi - lo) if abs(alpha) < 1e-8 else math.log((math.exp(c * hi) - math.exp(c * lo)) / c)
    return n * norm - c * s


def golden_section(f: Callable[[float], float], a: float, b: float, tol: float = 1e-8) -> float:
    """Minimiser of a unimodal function on [a, b]."""
    g = (math.sqrt(5) - 1) / 2
    c, d = b - g * (b - a), a + g * (b - a)
    fc, fd = f(c), f(d)
    while b - a > tol:
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - g * (b - a)
            fc = f(c)
        else:
            a, c, fc = c, d, fd
            d = a + g * (b - a)
            fd = f(d)
    return (a + b) / 2


def vmin_sweep(df: DataFrame, col: str, cuts: list[float], least: int = 20) -> DataFrame:
    """Best slope alpha of V dN/dlogV in (-2, 2) per cut with at least ``least`` values above it, against slope 0.

    ``cut, n, alpha, nll, nll_zipf, aic, bic, delta_aic`` (slope 0 minus free slope). The density of log10 V has
    the exponent alpha - 1.
    """
    rows = []
    for r in sorted(powerlaw_statistics(df, col, cuts).where(f"n >= {least} AND hi > lo").collect()):
        f = lambda a, r=r: nll_value(a - 1, r["n"], r["sum_log"], r["lo"], r["hi"])
        a = golden_section(f, -2, 2)
        rows.append((float(r["cut"]), int(r["n"]), a, f(a), f(0.0), 2 + 2 * f(a), math.log(r["n"]) + 2 * f(a), 2 * f(0.0) - 2 - 2 * f(a)))
    return df.sparkSession.createDataFrame(rows, "cut double, n bigint, alpha double, nll double, nll_zipf double, aic double, bic double, delta_aic double")


# ---- broken power law by maximum likelihood -----------------------------------------------------------------------
#: Points of the trapezoid rule that normalises a density.
GRID = 2001
#: Bounds of log10 V0, gamma, beta, log10 Vcut.
DPL_LOWER, DPL_UPPER = (0.0, -3.0, -3.0, -2.0), (12.0, 3.0, 3.0, 10.0)


def dpl_log_density(y: np.ndarray, log_v0: float, gamma: float, beta: float, log_cut: float, m: float = 2.0) -> np.ndarray:
    """Unnormalised natural logarithm of the density of y = log10 V, f(V) / V."""
    return LN10 * (log10_broken(y, log_v0, gamma, beta, log_cut, m) - y)


def dpl_nll(params: np.ndarray, y: np.ndarray, w: np.ndarray, lo: float | None = None, hi: float | None = None) -> float:
    """Negative log likelihood of values ``y`` of multiplicity ``w`` on [lo, hi]; ``params`` in the order of the bounds."""
    g = np.linspace(y.min() if lo is None else lo, y.max() if hi is None else hi, GRID)
    ld = dpl_log_density(g, *params)
    norm = np.log(np.trapezoid(np.exp(ld - ld.max()), g)) + ld.max()
    return float(w.sum() * norm - (w * dpl_log_density(y, *params)).sum())


def dpl_nll_table(df: DataFrame, col: str, settings: list[tuple[float, float, float, float]], m: float = 2.0) -> DataFrame:
    """``log_v0, gamma, beta, log_cut, n, nll`` of all values at given parameters, by one aggregation for all of them.

    Nothing but sums over the values is needed besides the normalisation, which takes their least and greatest only.
    """
    x = F.col(col).cast("double")
    rows = df.where(x > 0)
    sums = [F.sum(F.log(broken_power_law(x, 1.0, v0, g, b, cut, m)) - F.log(x)).alias(f"s{i}") for i, (v0, g, b, cut) in enumerate(settings)]
    r = rows.agg(F.count("*").alias("n"), F.min(F.log10(x)).alias("lo"), F.max(F.log10(x)).alias("hi"), *sums).first()
    out = []
    if r["n"] and r["hi"] > r["lo"]:
        g = np.linspace(r["lo"], r["hi"], GRID)
        for i, p in enumerate(settings):
            ld = dpl_log_density(g, *p, m)
            out.append((*map(float, p), r["n"], r["n"] * float(np.log(np.trapezoid(np.exp(ld - ld.max()), g)) + ld.max()) - r[f"s{i}"]))
    return df.sparkSession.createDataFrame(out, "log_v0 double, gamma double, beta double, log_cut double, n bigint, nll double")


def nelder_mead(f: Callable[[np.ndarray], float], start: np.ndarray, lower: np.ndarray, upper: np.ndarray, steps: int = 400) -> tuple[np.ndarray, float]:
    """Bounded simplex search (points are clipped into the box)."""
    clip = lambda p: np.clip(p, lower, upper)
    size, start = len(start), np.asarray(start, float)
    pts = [clip(start)] + [clip(start + np.eye(size)[i] * 0.15 * (upper - lower)[i]) for i in range(size)]
    val = [f(p) for p in pts]
    for _ in range(steps):
        order = np.argsort(val)
        pts, val = [pts[i] for i in order], [val[i] for i in order]
        if abs(val[-1] - val[0]) < 1e-10 * (1 + abs(val[0])):
            break
        mid = np.mean(pts[:-1], axis=0)
        new = clip(2 * mid - pts[-1])
        fn = f(new)
        if fn < val[0]:
            far = clip(3 * mid - 2 * pts[-1])
            ff = f(far)
            new, fn = (far, ff) if ff < fn else (new, fn)
        elif fn >= val[-2]:
            new = clip(0.5 * (mid + pts[-1]))
            fn = f(new)
            if fn >= val[-1]:
                pts = [pts[0]] + [clip(0.5 * (pts[0] + p)) for p in pts[1:]]
                val = [val[0]] + [f(p) for p in pts[1:]]
                continue
        pts[-1], val[-1] = new, fn
    i = int(np.argmin(val))
    return pts[i], val[i]


def log_histogram(df: DataFrame, col: str, digits: int = 4) -> DataFrame:
    """``y, w``: log10 of the positive values in steps of 10**-digits, and how many there are: at most some 10**digits
    rows a decade, however many values."""
    return df.where(F.col(col) > 0).groupBy(F.round(F.log10(F.col(col).cast("double")), digits).alias("y")).agg(F.count("*").alias("w"))


def _best_dpl(y: np.ndarray, w: np.ndarray, fixed: bool) -> tuple[np.ndarray, float]:
    lower, upper = np.array(DPL_LOWER), np.array(DPL_UPPER)
    starts = [(v0, cut) for v0 in np.quantile(y, (0.3, 0.6, 0.9)) for cut in (-1.0, float(y.min()))]
    if fixed:
        full = lambda q: np.array([q[0], GAMMA_FIXED, BETA_FIXED, q[1]])
        fits = [nelder_mead(lambda q: dpl_nll(full(q), y, w), np.array(s), lower[[0, 3]], upper[[0, 3]]) for s in starts]
        q, v = min(fits, key=lambda x: x[1])
        return full(q), v
    fits = [nelder_mead(lambda q: dpl_nll(q, y, w), np.array([v0, g, b, cut]), lower, upper) for v0, cut in starts for g, b in ((-0.5, -0.3), (0.3, 1.0))]
    return min(fits, key=lambda x: x[1])


class ExactLikelihood:
    """Negative log likelihood of the broken power law over all positive values of a column, unrounded.

    A call takes any number of settings (rows in the order of the bounds) and is one aggregation over the values, written
    once as log10 (``rows``: ``y, w``; equal values are one row of weight ``w``, so sizes that are counts of cells cost their
    distinct values); only sums come back. The normalisation takes their least and greatest.
    """

    def __init__(self, df: DataFrame, col: str, scratch: Scratch | None = None):
        x = F.col(col).cast("double")
        scratch = scratch or Scratch(df.sparkSession, "likelihood")
        self.rows = scratch.keep(df.where((x > 0) & (x < float("inf"))).groupBy(F.log10(x).alias("y")).agg(F.count("*").alias("w")), "values")
        r = self.rows.agg(F.sum("w"), F.min("y"), F.max("y")).first()
        self.n, self.lo, self.hi = r[0] or 0, r[1], r[2]

    def __call__(self, settings: np.ndarray) -> np.ndarray:
        settings = np.atleast_2d(np.asarray(settings, float))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(settings))
            for b in batches:
                y, w = b.column(0).to_numpy(), b.column(1).to_numpy()
                total += [(w * dpl_log_density(y, *p)).sum() for p in settings]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(settings)), pa.int32()), pa.array(total)], names=["s", "total"])

        sums = self.rows.mapInArrow(run, "s int, total double").groupBy("s").agg(F.sum("total").alias("total")).collect()
        grid = np.linspace(self.lo, self.hi, GRID)
        out = np.empty(len(settings))
        for r in sums:
            ld = dpl_log_density(grid, *settings[r["s"]])
            out[r["s"]] = self.n * (np.log(np.trapezoid(np.exp(ld - ld.max()), grid)) + ld.max()) - r["total"]
        return out


def newton_in_box(f: Callable[[np.ndarray], np.ndarray], start: np.ndarray, lower: np.ndarray, upper: np.ndarray, steps: int = 12, h: float = 1e-3) -> tuple[np.ndarray, float]:
    """Least value of ``f`` (rows of points to values) near ``start``, inside the box: Newton steps from a difference
    stencil, all of whose points are one call, then steps of several lengths, again one call. Coordinates at a bound
    that the value would leave stay there. Never worse than the start."""
    d = len(start)
    at = np.clip(np.asarray(start, float), lower, upper)
    value = float(f(at[None])[0])
    unit = np.eye(d) * h
    pairs = [(i, j) for i in range(d) for j in range(i + 1, d)]
    for _ in range(steps):
        middle = np.clip(at, lower + h, upper - h)
        points = [middle, *(middle + s * unit[i] for i in range(d) for s in (1, -1)), *(middle + s * unit[i] + t * unit[j] for i, j in pairs for s in (1, -1) for t in (1, -1))]
        v = f(np.array(points))
        up, down = v[1 : 2 * d + 1 : 2], v[2 : 2 * d + 1 : 2]
        grad, hess = (up - down) / (2 * h), np.diag((up - 2 * v[0] + down) / h**2)
        for m, (i, j) in enumerate(pairs):
            q = v[2 * d + 1 + 4 * m :][:4]
            hess[i, j] = hess[j, i] = (q[0] - q[1] - q[2] + q[3]) / (4 * h * h)
        free = ~(((at <= lower + h) & (grad > 0)) | ((at >= upper - h) & (grad < 0)))
        step = np.zeros(d)
        if free.any():
            size, axes = np.linalg.eigh(hess[np.ix_(free, free)])
            size = np.maximum(np.abs(size), 1e-6 * max(np.abs(size).max(), 1e-12))
            step[free] = -axes @ ((axes.T @ grad[free]) / size)
        held = np.where(free, at, np.where(grad > 0, lower, upper))
        tries = np.array([np.clip(held + t * step, lower, upper) for t in (0, 2, 1, 0.5, 0.2, 0.05, 0.01, 0.001)])
        found = f(tries)
        best = int(found.argmin())
        gain = value - float(found[best])
        if gain > 0:
            at, value = tries[best], float(found[best])
        if gain <= 1e-10 * (1 + abs(value)):
            break
    return at, value


def model_table(df: DataFrame, col: str, digits: int = 4) -> DataFrame:
    """Maximum likelihood fits of five models of the size distribution, best first.

    ``model, k, n, log_v0, gamma, beta, log_cut, nll, aic, bic, delta_aic``; models: ``power_law`` (free slope, given
    as -gamma), ``zipf`` (slope 0), ``power_law_49`` (slope 4/9), ``double_power_law``, ``double_power_law_fixed``
    (slopes 0 and 4/9, where only the break and the cut-off are free). The search over several starts works on the
    histogram in steps of 10**-digits of log10 (fewer than three of them give no rows); what it finds is then taken to
    the optimum of the likelihood of all values as they are (``ExactLikelihood``), and the figures are that one's.
    """
    rows = sorted(map(tuple, log_histogram(df, col, digits).collect()))
    out = []
    if len(rows) >= 3:
        y, w = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], float)
        exact = ExactLikelihood(df, col)
        n, lo, hi = exact.n, exact.lo, exact.hi
        s = float(exact.rows.agg(F.sum(F.col("y") * F.col("w"))).first()[0])
        line = lambda a: nll_value(a - 1, n, s, lo, hi)
        alpha = golden_section(line, -2, 2)
        lower, upper = np.array(DPL_LOWER), np.array(DPL_UPPER)
        given, _ = _best_dpl(y, w, True)
        slopes = lambda q: np.column_stack([q[:, 0], np.full((len(q), 2), (GAMMA_FIXED, BETA_FIXED)), q[:, 1]])
        two, given_nll = newton_in_box(lambda q: exact(slopes(q)), given[[0, 3]], lower[[0, 3]], upper[[0, 3]])
        given = slopes(two[None])[0]
        # the free model holds the other: it starts from the better of the two
        starts = np.array([_best_dpl(y, w, False)[0], given])
        free, free_nll = newton_in_box(exact, starts[int(exact(starts).argmin())], lower, upper)
        fits = [("power_law", 1, (None, -alpha, None, None), line(alpha)), ("zipf", 0, (None, 0.0, None, None), line(0.0)), ("power_law_49", 0, (None, BETA_FIXED, None, None), line(-BETA_FIXED)),
                ("double_power_law", 4, tuple(map(float, free)), free_nll), ("double_power_law_fixed", 2, tuple(map(float, given)), given_nll)]
        least = min(2 * k + 2 * v for _, k, _, v in fits)
        out = sorted(((name, k, n, *q, v, 2 * k + 2 * v, k * math.log(n) + 2 * v, 2 * k + 2 * v - least) for name, k, q, v in fits), key=lambda r: r[8])
    return df.sparkSession.createDataFrame(out, "model string, k int, n bigint, log_v0 double, gamma double, beta double, log_cut double, nll double, aic double, bic double, delta_aic double")


# ---- bounded non-linear least squares on a spectrum ---------------------------------------------------------------
def levenberg_marquardt(f: Callable[[np.ndarray, np.ndarray], np.ndarray], x: np.ndarray, y: np.ndarray, start: list[float], lower: list[float], upper: list[float], steps: int = 200) -> np.ndarray:
    p, lo, hi, lam = np.array(start, float), np.array(lower, float), np.array(upper, float), 1e-2
    rss = lambda q: float(((y - f(x, q)) ** 2).sum())
    best = rss(p)
    for _ in range(steps):
        h = 1e-6 * np.maximum(np.abs(p), 1e-3)
        jac = np.stack([(f(x, p + np.eye(len(p))[i] * h[i]) - f(x, p - np.eye(len(p))[i] * h[i])) / (2 * h[i]) for i in range(len(p))], 1)
        a, g = jac.T @ jac, jac.T @ (y - f(x, p))
        q = np.clip(p + np.linalg.solve(a + lam * (np.diag(np.diag(a)) + 1e-12 * np.eye(len(p))), g), lo, hi)
        new = rss(q)
        if new < best:
            done = best - new < 1e-12 * (1 + best)
            p, best, lam = q, new, lam / 3
            if done:
                break
        else:
            lam *= 4
            if lam > 1e12:
                break
    return p


#: Points of a spectrum that a fit takes to the driver; a spectrum has as many as it has bins.
MOST_POINTS = 10_000


def _curves(u: np.ndarray, v: np.ndarray) -> dict[str, tuple]:
    """name -> (log10 model of (log10 V, parameters), start, lower, upper); the first parameter is log10 of the amplitude."""
    a, v0, cut = float(np.median(v)), float(np.clip(np.median(u), 0, 12)), float(np.clip(u.min(), 1, 10))
    g, b = GAMMA_FIXED, BETA_FIXED
    return {
        "double_power_law": (lambda x, p: p[0] + log10_broken(x, *p[1:6]), [a, v0, -0.5, -0.4, cut, 2.0], [-300, 0, -3, -3, 1, 0.1], [300, 12, 3, -0.25, 10, 10]),
        "double_power_law_fixed": (lambda x, p: p[0] + log10_broken(x, p[1], g, b, p[2], p[3]), [a, v0, cut, 2.0], [-300, 0, 1, 0.1], [300, 12, 10, 10]),
        "power_law_49": (lambda x, p: p[0] - b * x, [0.0], [-300], [300]),
        "power_law": (lambda x, p: p[0] + p[1] * x, [0.0, 0.5], [-300, -2], [300, 2]),
        "zipf": (lambda x, p: p[0] + 0 * x, [a], [-300], [300]),
        "beuermann_fixed": (lambda x, p: p[0] + log10_broken(x, p[1], g, b, p[3], p[4], p[2]), [a, v0, 1.0, cut, 2.0], [-300, 0, 0.1, 1, 0.1], [300, 12, 50, 10, 10]),
        "beuermann": (lambda x, p: p[0] + log10_broken(x, p[1], p[2], p[3], p[5], p[6], p[4]), [a, v0, -0.5, -0.4, 1.0, cut, 2.0], [-300, 0, -3, -3, 0.1, 1, 0.1], [300, 12, 3, -0.25, 50, 10, 10]),
    }


def rss_table(spectrum: DataFrame, x: str, y: str, curves: dict[str, tuple[Column, int]], ranges: list[tuple[float, float]]) -> DataFrame:
    """Residuals of given curves (columns of model values, with their number of parameters) in log10, by range of x.

    ``model, lo, hi, n, rss, aic`` for the positive points in each range (lo, hi]; AIC = n ln(RSS / n) + 2 k. One
    aggregation for all curves and ranges.
    """
    pts = spectrum.where((F.col(x) > 0) & (F.col(y) > 0))
    off = {name: log_floor(F.col(y).cast("double")) - log_floor(c) for name, (c, _) in curves.items()}
    cells = [F.struct(F.lit(name).alias("model"), F.lit(k).alias("k"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"), (off[name] * off[name]).alias("r")) for name, (_, k) in curves.items() for lo, hi in ranges]
    rows = pts.select(F.col(x).alias("x_"), F.inline(F.array(*cells))).where("x_ > lo AND x_ <= hi").groupBy("model", "k", "lo", "hi").agg(F.count("*").alias("n"), F.sum("r").alias("rss"))
    return rows.withColumn("aic", F.col("n") * F.log(F.greatest("rss", F.lit(1e-300)) / F.col("n")) + 2 * F.col("k")).drop("k")


def fit_curves(spectrum: DataFrame, x: str, y: str) -> DataFrame:
    """Fit every curve to the positive points of a spectrum, in log10.

    Returns ``model, k, n, rss, aic, delta_aic, params``, best first (params: log10 amplitude, then as in ``_curves``);
    AIC = n ln(RSS / n) + 2 k. More than ``MOST_POINTS`` points are an error: bin them first.
    """
    pts = sorted((float(r[0]), float(r[1])) for r in spectrum.where((F.col(x) > 0) & (F.col(y) > 0)).select(x, y).limit(MOST_POINTS + 1).collect())
    if len(pts) > MOST_POINTS:
        raise ValueError(f"more than {MOST_POINTS} points to fit")
    rows = []
    if len(pts) >= 2:
        u, v = (np.log10([p[i] for p in pts]) for i in (0, 1))
        for name, (f, start, lower, upper) in _curves(u, v).items():
            if len(pts) <= len(start):
                continue
            floored = lambda t, p, f=f: np.maximum(f(t, p), math.log10(FLOOR))
            p = levenberg_marquardt(floored, u, v, start, lower, upper)
            rss = float(((v - floored(u, p)) ** 2).sum())
            rows.append((name, len(start), len(pts), rss, len(pts) * math.log(max(rss, 1e-300) / len(pts)) + 2 * len(start), [float(t) for t in p]))
    low = min((r[4] for r in rows), default=0.0)
    rows = sorted(((*r[:5], r[4] - low, r[5]) for r in rows), key=lambda r: r[4])
    return spectrum.sparkSession.createDataFrame(rows, "model string, k int, n int, rss double, aic double, delta_aic double, params array<double>")


# ---- snapshots -----------------------------------------------------------------------------------------------------
def bins_all_any(spectra: DataFrame, by: str, n_snapshots: int) -> DataFrame:
    """Per bin: whether all, or any, snapshots have a positive value there."""
    return spectra.groupBy("bin").agg((F.count_if(F.col("spectrum") > 0) == n_snapshots).alias("in_all"), F.bool_or(F.col("spectrum") > 0).alias("in_any"))


def bin_mean_std(spectra: DataFrame, n_snapshots: int, value: str = "spectrum") -> DataFrame:
    """Mean and population deviation over all snapshots of each bin that some snapshot has; a snapshot without the bin
    counts as zero. ``n`` is the number of snapshots that have it."""
    mean, square = F.sum(value) / n_snapshots, F.sum(F.col(value) * F.col(value)) / n_snapshots
    return spectra.groupBy("bin").agg(mean.alias("mean"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("std"), F.count_if(F.col(value) > 0).cast("bigint").alias("n"))


def anchor_target(largest: float) -> float:
    """Fixed rule: log10 V of the anchor is 5, or half a decade below the largest size."""
    return min(5.0, math.log10(largest) - 0.5)


def anchor_normalise(spectra: DataFrame, by: str, target: float, n_snapshots: int) -> DataFrame:
    """Divide each snapshot's spectrum by its value in the anchor bin: of the bins valid in all snapshots (else
    in any), the one whose log10 midpoint is nearest to ``target`` (ties: the smaller bin)."""
    flags = bins_all_any(spectra, by, n_snapshots)
    mids = spectra.select("bin", F.log10("mid").alias("c")).distinct().join(flags, "bin")
    ranked = mids.where("in_any").agg(F.min(F.struct((~F.col("in_all")).alias("z"), F.abs(F.col("c") - target).alias("d"), "bin")).alias("m")).select(F.col("m.bin").alias("anchor"))
    at = spectra.join(F.broadcast(ranked), F.col("bin") == F.col("anchor")).select(by, F.col("spectrum").alias("at_"), "anchor")
    return spectra.join(at, by).where("at_ > 0").select(by, "bin", "anchor", (F.col("spectrum") / F.col("at_")).alias("normalised"))
