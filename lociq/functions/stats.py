"""Statistics without external libraries: tests, corrections, densities, thresholds, change points, clusters."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def fisher_greater(a: int, b: int, c: int, d: int) -> float:
    """One-tailed exact test of [[a, b], [c, d]]: the chance of a table with at least a in the first cell."""
    r1, r2, c1 = a + b, c + d, a + c
    if min(a, b, c, d) < 0 or r1 + r2 == 0:
        return 1.0
    lg = math.lgamma
    base = lg(r1 + 1) + lg(r2 + 1) + lg(c1 + 1) + lg(r1 + r2 - c1 + 1) - lg(r1 + r2 + 1)
    tail = (math.exp(base - lg(x + 1) - lg(r1 - x + 1) - lg(c1 - x + 1) - lg(r2 - c1 + x + 1)) for x in range(a, min(r1, c1) + 1))
    return min(1.0, math.fsum(tail))


def fisher(df: DataFrame, a: str, b: str, c: str, d: str, out: str = "p") -> DataFrame:
    @F.pandas_udf("double")
    def test(w: pd.Series, x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        known: dict = {}
        values = []
        for t in zip(w.astype(int), x.astype(int), y.astype(int), z.astype(int), strict=True):
            if t not in known:
                known[t] = fisher_greater(*t)
            values.append(known[t])
        return pd.Series(values)

    return df.withColumn(out, test(a, b, c, d))


#: Stretches of p that the scan over ranks is split into.
P_BINS = 4096


def benjamini_hochberg(df: DataFrame, p: str = "p", by: list[str] | None = None, out: str = "q") -> DataFrame:
    """min over larger p of p * n / rank, at most 1. Equal p share a row in the scan, which keeps it short.

    Without ``by`` all tests are one family. The scan is split by stretches of p: what one needs of the others is the
    number of tests below it and the least value above. Tests without a p count, rank last and have 1.
    """
    keys = by or []
    value = F.col(p).cast("double")
    place = F.when(value.isNull(), F.lit(1 << 62)).when(F.isnan(value), F.lit((1 << 62) - 1)).otherwise(F.floor(value * P_BINS))
    counts = df.groupBy(*keys, p).agg(F.count("*").alias("__c")).withColumn("__bin", place)
    all_, one = W.partitionBy(*keys), W.partitionBy(*keys, "__bin")
    so_far, before = (W.unboundedPreceding, 0), (W.unboundedPreceding, -1)
    below = counts.groupBy(*keys, "__bin").agg(F.sum("__c").alias("__in")).select(
        *keys, "__bin", F.coalesce(F.sum("__in").over(all_.orderBy("__bin").rowsBetween(*before)), F.lit(0)).alias("__below"), F.sum("__in").over(all_).alias("__n"),
    )
    rank = F.col("__below") + F.sum("__c").over(one.orderBy(F.asc_nulls_last(p)).rowsBetween(*so_far))
    ranked = _null_safe(counts, below, [*keys, "__bin"]).withColumn("__raw", F.col(p) * F.col("__n") / rank)
    above = ranked.groupBy(*keys, "__bin").agg(F.min("__raw").alias("__in")).select(
        *keys, "__bin", F.min("__in").over(all_.orderBy(F.desc("__bin")).rowsBetween(*before)).alias("__above"),
    )
    # down from the largest: a frame that ends at the last row is scanned anew for each of its rows
    least = F.min("__raw").over(one.orderBy(F.desc_nulls_first(p)).rowsBetween(*so_far))
    q = _null_safe(ranked, above, [*keys, "__bin"]).select(*keys, p, F.least(least, "__above", F.lit(1.0)).alias(out))
    return _null_safe(df, q, [*keys, p])


def _null_safe(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join in which keys that are null are equal."""
    right = other.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return df.join(right, on).drop(*[f"__r_{k}" for k in keys])


def _beta_tail(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_tail(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    total = d
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d or tiny)
            c = 1 + step / c or tiny
            total *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * total


def t_tail(t: float, df: float) -> float:
    """Chance of a Student t above t."""
    tail = 0.5 * _beta_tail(df / 2, 0.5, df / (df + t * t))
    return tail if t >= 0 else 1 - tail


def f_critical(alpha: float, d1: float, d2: float) -> float:
    """The value that F exceeds with chance alpha, by bisection."""
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        if 1 - _beta_tail(d1 / 2, d2 / 2, d1 * mid / (d1 * mid + d2)) > alpha:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def _p_of_t(t: Column, df: Column) -> Column:
    @F.pandas_udf("double")
    def tail(x: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([t_tail(a, b) if a == a and b == b and b > 0 else None for a, b in zip(x, n, strict=True)])

    return tail(t, df)


def welch(df: DataFrame, by: list[str], group: str, value: str, one, two) -> DataFrame:
    """by, t, df, p: is the mean of group ``one`` greater than that of ``two``? Moments are pre-aggregated."""
    m = lambda g, f: f(F.when(F.col(group) == g, F.col(value)))
    s = df.groupBy(*by).agg(*[m(g, f).alias(f"{n}{i}") for i, g in ((1, one), (2, two)) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    e1, e2 = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    t = (F.col("m1") - F.col("m2")) / F.sqrt(e1 + e2)
    free = (e1 + e2) ** 2 / (e1**2 / (F.col("n1") - 1) + e2**2 / (F.col("n2") - 1))
    return s.where("n1 > 1 and n2 > 1 and v1 + v2 > 0").select(*by, t.alias("t"), free.alias("df")).withColumn("p", _p_of_t(F.col("t"), F.col("df")))


def paired_t(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    d = F.col(a) - F.col(b)
    s = df.groupBy(*by).agg(F.avg(d).alias("m"), F.stddev_samp(d).alias("s"), F.count(d).alias("n")).where("n > 1 and s > 0")
    return s.select(*by, (F.col("m") / (F.col("s") / F.sqrt("n"))).alias("t"), (F.col("n") - 1).cast("double").alias("df")).withColumn("p", _p_of_t(F.col("t"), F.col("df")))


def _ranked(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """With __r: the mean rank of equal values, found over distinct values."""
    c = df.groupBy(*by, value).agg(F.count("*").alias("__c"))
    upto = F.sum("__c").over(W.partitionBy(*by).orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    return df.join(c.withColumn("__r", upto - (F.col("__c") - 1) / 2).withColumn("__tie", F.col("__c") ** 3 - F.col("__c")), [*by, value])


def kruskal(df: DataFrame, by: list[str], group: str, value: str) -> DataFrame:
    """by, h, groups: the statistic, corrected for ties."""
    r = _ranked(df, by, value)
    g = r.groupBy(*by, group).agg(F.sum("__r").alias("s"), F.count("*").alias("n"))
    t = r.select(*by, value, "__tie").distinct().groupBy(*by).agg(F.sum("__tie").alias("ties"))
    h = g.groupBy(*by).agg(F.sum(F.col("s") ** 2 / F.col("n")).alias("q"), F.sum("n").alias("N"), F.count("*").alias("groups")).join(t, by)
    n = F.col("N")
    value_ = (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.col("ties") / (n**3 - n))
    return h.where("N > 1 and ties < N * N * N - N").select(*by, value_.alias("h"), "groups")


def wilcoxon(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """by, w, z: signed ranks of the differences that aren't zero, and the normal approximation."""
    d = df.withColumn("__d", F.col(a) - F.col(b)).where("__d <> 0").withColumn("__a", F.abs("__d"))
    r = _ranked(d, by, "__a").groupBy(*by).agg(F.sum(F.when(F.col("__d") > 0, F.col("__r")).otherwise(0.0)).alias("w"), F.count("*").alias("n"))
    n = F.col("n")
    return r.select(*by, "w", ((F.col("w") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24)).alias("z"))


def zscores(df: DataFrame, by: list[str], value: str, eps: float | None = None) -> DataFrame:
    """With z over ``by``; a deviation of 0 counts as 1, or eps is added."""
    s = df.groupBy(*by).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    spread = F.col("__s") + eps if eps is not None else F.when(F.col("__s") == 0, 1.0).otherwise(F.col("__s"))
    return df.join(s, by).withColumn("z", (F.col(value) - F.col("__m")) / spread).drop("__m", "__s")


def histogram(df: DataFrame, by: list[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """by, bin, n, density over all rows in range; the last bin holds its upper edge."""
    width = (high - low) / bins
    rows = df.where((F.col(value) >= low) & (F.col(value) <= high)).withColumn("bin", F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)))
    total = rows.agg(F.count("*").alias("__t"))
    return rows.groupBy(*by, "bin").agg(F.count("*").alias("n")).join(F.broadcast(total)).withColumn("density", F.col("n") / (F.col("__t") * width)).drop("__t")


def kde(df: DataFrame, value: str, grid: list[float]) -> DataFrame:
    """x, density: Gaussian kernels with Silverman's bandwidth. The grid is a literal, so each task sums its own rows."""
    s = df.agg(F.stddev_samp(value).alias("s"), F.percentile(value, 0.75).alias("q3"), F.percentile(value, 0.25).alias("q1"), F.count(value).alias("n")).first()
    if not s["n"] or s["n"] < 2:
        return df.sparkSession.createDataFrame([], "x double, density double")
    spread = min(x for x in (s["s"], (s["q3"] - s["q1"]) / 1.34) if x > 0) if max(s["s"], s["q3"] - s["q1"]) > 0 else 1.0
    h = 0.9 * spread * s["n"] ** -0.2
    x = df.where(F.col(value).isNotNull()).select(value, F.explode(F.array(*[F.lit(float(g)) for g in grid])).alias("x"))
    u = (F.col("x") - F.col(value)) / h
    return x.groupBy("x").agg((F.sum(F.exp(-u * u / 2)) / (s["n"] * h * math.sqrt(2 * math.pi))).alias("density"))


def otsu(df: DataFrame, value: str) -> DataFrame:
    """threshold, score: the cut between distinct values with the greatest variance between classes."""
    c = df.groupBy(value).agg(F.count("*").alias("n"))
    upto = W.orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    everything = W.partitionBy()
    v = F.col(value)
    s = c.select(v.alias("v"), F.sum("n").over(upto).alias("n0"), F.sum(v * F.col("n")).over(upto).alias("s0"), F.sum("n").over(everything).alias("n1"), F.sum(v * F.col("n")).over(everything).alias("s1"))
    score = F.col("n0") * (F.col("n1") - F.col("n0")) * (F.col("s0") / F.col("n0") - (F.col("s1") - F.col("s0")) / (F.col("n1") - F.col("n0"))) ** 2 / F.col("n1") ** 2
    return s.where("n0 < n1").withColumn("score", score).orderBy(F.desc("score"), "v").limit(1).select(F.col("v").alias("threshold"), "score")


def fences(df: DataFrame, by: list[str], value: str, iqr: float = 0.5, mad: float = 3.0) -> DataFrame:
    """by, q1, q3, median, mad, fence: the smaller of the upper IQR and MAD fences."""
    q = df.groupBy(*by).agg(F.percentile(value, 0.25).alias("q1"), F.percentile(value, 0.75).alias("q3"), F.percentile(value, 0.5).alias("median"))
    d = df.join(q, by).groupBy(*by).agg(F.percentile(F.abs(F.col(value) - F.col("median")), 0.5).alias("mad"))
    fence = F.least(F.col("q3") + iqr * (F.col("q3") - F.col("q1")), F.col("median") + mad * 1.4826 * F.col("mad"))
    return q.join(d, by).withColumn("fence", fence)


def gap_fence(df: DataFrame, by: list[str], value: str, least: float) -> DataFrame:
    """by, fence: the value before the first gap of at least ``least`` above the median."""
    rows = df.select(*by, value).distinct()
    m = df.groupBy(*by).agg(F.percentile(value, 0.5).alias("__m"))
    nxt = F.lead(value).over(W.partitionBy(*by).orderBy(value))
    return rows.withColumn("__next", nxt).join(m, by).where((F.col(value) >= F.col("__m")) & (F.col("__next") - F.col(value) >= least)).groupBy(*by).agg(F.min(value).alias("fence"))


def change_point(df: DataFrame, group: str, value: str, low: float, high: float, step: float) -> DataFrame:
    """k, sse over a grid: group 1 rows at or above k and group 2 rows below it are wrong. Counts are by grid cell, so the
    scan over the grid sees cells, not rows."""
    n = int(round((high - low) / step)) + 1
    cell = F.least(F.greatest(F.floor(F.round((F.col(value) - low) / step, 6)) + 1, F.lit(0)), F.lit(n))  # cells of k <= value
    c = df.groupBy(cell.alias("cell")).agg(F.count(F.when(F.col(group) == 1, 1)).alias("a"), F.count(F.when(F.col(group) == 2, 1)).alias("b"))
    every = df.sparkSession.range(0, n + 1).select(F.col("id").alias("cell")).join(c, "cell", "left").na.fill(0)
    upto = W.orderBy("cell").rowsBetween(W.unboundedPreceding, 0)
    s = every.select("cell", F.sum("b").over(upto).alias("b"), (F.sum("a").over(W.partitionBy()) - F.sum("a").over(upto)).alias("a"))
    return s.where(F.col("cell") < n).select(F.round(low + F.col("cell") * step, 9).alias("k"), (F.col("a") + F.col("b")).alias("sse"))


def kmeans_labels(matrix: np.ndarray, k: int, seed: int = 1, rounds: int = 100) -> np.ndarray:
    """Labels of the rows of a small matrix (tens of chromosomes), k-means++ starts."""
    rng = np.random.default_rng(seed)
    centre = matrix[[int(rng.integers(len(matrix)))]]
    while len(centre) < k:
        d = ((matrix[:, None] - centre[None]) ** 2).sum(-1).min(1)
        centre = np.vstack((centre, matrix[rng.choice(len(matrix), p=d / d.sum())] if d.sum() > 0 else matrix[len(centre) % len(matrix)]))
    for _ in range(rounds):
        label = ((matrix[:, None] - centre[None]) ** 2).sum(-1).argmin(1)
        new = np.array([matrix[label == j].mean(0) if (label == j).any() else centre[j] for j in range(k)])
        if np.allclose(new, centre):
            break
        centre = new
    return label


def matched_labels(reference: np.ndarray, labels: np.ndarray, k: int) -> np.ndarray:
    """labels renamed to agree most with the reference: over all permutations for k up to 7, else greedily."""
    from itertools import permutations

    table = np.array([[(labels == i) @ (reference == j).astype(int) for j in range(k)] for i in range(k)])
    if k <= 7:
        best = max(permutations(range(k)), key=lambda p: sum(table[i, p[i]] for i in range(k)))
    else:
        best, free = [0] * k, set(range(k))
        for i in np.argsort(-table.max(1)):
            best[i] = max(free, key=lambda j: table[i, j])
            free.remove(best[i])
    return np.array([best[x] for x in labels])


def bootstrap_stability(matrix: np.ndarray, k: int, rounds: int = 100, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Labels, and the share of column resamples in which each row keeps its label."""
    base, rng = kmeans_labels(matrix, k, seed), np.random.default_rng(seed)
    kept = np.zeros(len(matrix))
    for r in range(rounds):
        at = rng.integers(0, matrix.shape[1], matrix.shape[1])
        kept += matched_labels(base, kmeans_labels(matrix[:, at], k, seed + r), k) == base
    return base, kept / rounds
