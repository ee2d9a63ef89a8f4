"""Hypothesis tests as grouped aggregates over mid-ranks."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidewater.operators.ranks import join_groups, mid_ranks, prefix_totals
from tidewater.sources.work import materialize


@F.pandas_udf(DoubleType())
def two_sided_normal(z: pd.Series) -> pd.Series:
    """Two-sided p-value of a standard normal statistic."""
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2)), na_action="ignore")


def _upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function, by series or continued fraction."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


@F.pandas_udf(DoubleType())
def chi_square_upper(x: pd.Series, df: pd.Series) -> pd.Series:
    """Upper tail of the chi-square distribution."""
    return pd.Series([None if pd.isna(v) or pd.isna(k) or k <= 0 else _upper_gamma(k / 2, v / 2) for v, k in zip(x, df, strict=True)], dtype="float64")


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        top = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + top * d or 1e-300)
        c = 1 + top / c or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


@F.pandas_udf(DoubleType())
def two_sided_t(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p-value of Student's t."""
    return pd.Series([None if pd.isna(v) or pd.isna(k) or k <= 0 else _incomplete_beta(k / 2, 0.5, k / (k + v * v)) for v, k in zip(t, df, strict=True)], dtype="float64")


def rank_sum(df: DataFrame, group: list[str], sample: str, value: str) -> DataFrame:
    """Two samples (sample 1 and 0) per group: rank sum, z without tie correction, U and z with tie and continuity correction."""
    at = prefix_totals(df.filter(F.col(value).isNotNull()), group, value, {"n1": F.sum(F.col(sample).cast("long")), "n": F.count(F.lit(1))})
    mid = F.col("before_n") + (F.col("n") + 1) / 2
    sums = at.groupBy(*group).agg(F.sum(F.col("n1") * mid).alias("w"), F.sum("n1").alias("n_1"), (F.sum("n") - F.sum("n1")).alias("n_0"), F.sum(F.col("n") * F.col("n") * F.col("n") - F.col("n")).alias("ties"))
    a, b = F.col("n_1").cast("double"), F.col("n_0").cast("double")
    n, product = a + b, F.nullif(a * b, F.lit(0.0))
    plain = (F.col("w") - a * (n + 1) / 2) / F.sqrt(product * (n + 1) / 12)
    u = F.col("w") - a * (a + 1) / 2
    sd = F.sqrt(product / 12 * ((n + 1) - F.col("ties") / F.nullif(n * (n - 1), F.lit(0.0))))
    far = F.abs(u - a * b / 2) - F.lit(0.5)
    return sums.select(*group, "n_1", "n_0", "w", plain.alias("z"), u.alias("u"), (far / F.nullif(sd, F.lit(0.0))).alias("z_tied"))


def signed_rank(df: DataFrame, group: list[str], difference: str) -> DataFrame:
    """Wilcoxon signed-rank test of paired differences; zero differences are left out. No difference left: null z."""
    kept = df.filter(F.col(difference) != 0).withColumn("__size", F.abs(F.col(difference)))
    ranked = mid_ranks(kept, group, "__size")
    sums = ranked.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col(difference) > 0, F.col("mid_rank")).otherwise(0.0)).alias("w_plus"), F.sum(F.col("tied") * F.col("tied") - 1).alias("ties"))
    n = F.col("n").cast("double")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    return sums.select(*group, "n", "w_plus", F.least("w_plus", n * (n + 1) / 2 - F.col("w_plus")).alias("w"), ((F.col("w_plus") - n * (n + 1) / 4) / F.nullif(sd, F.lit(0.0))).alias("z"))


def signed_rank_tail(doubled_ranks: Sequence[int], doubled_w: int) -> float:
    """Two-sided exact p-value of a sum of positive ranks, given all ranks (doubled, so that mid-ranks are whole).

    Under the null hypothesis each rank counts with probability one half. The distribution of the sum comes from adding
    one rank after another to an array of counts; ties are in the ranks themselves.
    """
    total = sum(doubled_ranks)
    ways = [0] * (total + 1)
    ways[0] = 1
    top = 0
    for r in doubled_ranks:
        for s in range(top, -1, -1):
            ways[s + r] += ways[s]
        top += r
    low, high = sum(ways[: doubled_w + 1]), sum(ways[doubled_w:])
    return min(1.0, 2 * min(low, high) / (1 << len(doubled_ranks)))


@F.pandas_udf(DoubleType())
def exact_signed_rank(ranks: pd.Series, w_plus: pd.Series) -> pd.Series:
    """Exact p-values from the mid-ranks of the differences and the sum of the positive ones; null ranks give null."""
    return pd.Series([None if r is None else signed_rank_tail([round(2 * x) for x in r], round(2 * w)) for r, w in zip(ranks, w_plus, strict=True)], dtype="float64")


def signed_rank_pairs(df: DataFrame, group: list[str], block: list[str], level: str, value: str, exact_upto: int = 50) -> DataFrame:
    """Signed-rank tests of all pairs of levels within each group, paired by `block` (one row for a block and level).

    A row for each group and pair: level_a < level_b, n (differences that aren't 0), w_plus, z, exact and p_value. With up
    to `exact_upto` differences the p-value is exact, over it that of z. A pair whose differences are all 0 has p 1. Blocks
    in which one of the levels, or its value, is missing don't count for the pair; pairs that no block has are left out.
    """
    cells = df.filter(F.col(value).isNotNull() & F.col(level).isNotNull()).select(*group, *block, F.struct(F.col(level).alias("l"), F.col(value).alias("v")).alias("c"))
    lists = cells.groupBy(*group, *block).agg(F.array_sort(F.collect_list("c")).alias("all"))  # a value for each level
    pairs = F.flatten(F.transform("all", lambda a, i: F.transform(F.slice("all", i + 2, F.size("all")), lambda b: F.struct(a["l"].alias("level_a"), b["l"].alias("level_b"), (a["v"] - b["v"]).alias("d")))))
    rows = materialize(lists.select(*group, F.explode(pairs).alias("p")).select(*group, "p.*"), "level_pairs")
    by = [*group, "level_a", "level_b"]
    tested = materialize(signed_rank(rows, by, "d"), "pair_tests")
    few = join_groups(rows.filter("d <> 0").withColumn("__size", F.abs("d")), tested.filter(F.col("n") <= exact_upto).select(*by), by)
    ranks = mid_ranks(few, by, "__size").groupBy(*by).agg(F.collect_list("mid_rank").alias("__ranks"))  # at most exact_upto
    out = join_groups(join_groups(rows.select(*by).distinct(), tested, by, "left"), ranks, by, "left")
    n, exact = F.coalesce("n", F.lit(0).cast("long")), F.coalesce(F.col("n") <= exact_upto, F.lit(True))
    p = F.when(F.col("n").isNull(), 1.0).when(exact, exact_signed_rank("__ranks", "w_plus")).otherwise(two_sided_normal("z"))
    return out.select(*by, n.alias("n"), F.coalesce("w_plus", F.lit(0.0)).alias("w_plus"), "z", exact.alias("exact"), p.alias("p_value"))


def kruskal_wallis(df: DataFrame, group: list[str], sample: str, value: str) -> DataFrame:
    """H with tie correction, and its degrees of freedom."""
    ranked = mid_ranks(df, group, value)
    per_sample = ranked.groupBy(*group, sample).agg(F.sum("mid_rank").alias("r"), F.count(F.lit(1)).alias("n"), F.sum(F.col("tied") * F.col("tied") - 1).alias("ties"))
    sums = per_sample.groupBy(*group).agg(F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"), F.sum("n").cast("double").alias("n"), F.sum("ties").alias("ties"), (F.count(F.lit(1)) - 1).alias("df"))
    n = F.col("n")
    h = (12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / F.nullif(1 - F.col("ties") / (n * n * n - n), F.lit(0.0))
    return sums.select(*group, h.alias("h"), "df")


def friedman(df: DataFrame, block: str, treatment: str, value: str) -> DataFrame:
    """Friedman's chi-square with tie correction over complete blocks; a block has a row per treatment."""
    in_block, upto = Window.partitionBy(block), Window.partitionBy(block).orderBy(value)
    ranked = df.withColumn("__tied", F.count(F.lit(1)).over(Window.partitionBy(block, value))).withColumn("__rank", F.rank().over(upto) + (F.col("__tied") - 1) / 2).withColumn("__k", F.count(F.lit(1)).over(in_block))
    sums = ranked.groupBy(treatment).agg(F.sum("__rank").alias("r"), F.count(F.lit(1)).alias("n"), F.sum(F.col("__tied") * F.col("__tied") - 1).alias("ties"), F.max("__k").alias("k"))
    total = sums.agg(F.sum(F.col("r") * F.col("r")).alias("s"), F.max("n").cast("double").alias("n"), F.sum("ties").alias("ties"), F.max("k").cast("double").alias("k"))
    n, k = F.col("n"), F.col("k")
    c = 1 - F.col("ties") / (n * k * (k * k - 1))
    return total.select(((12 / (n * k * (k + 1)) * F.col("s") - 3 * n * (k + 1)) / F.nullif(c, F.lit(0.0))).alias("chi2"), (k - 1).cast("long").alias("df"))


def bonferroni(p: Column, group: list[str], capped: bool = True) -> Column:
    """p times the number of tests in the group."""
    out = p * F.count(p).over(Window.partitionBy(*group))
    return F.least(out, F.lit(1.0)) if capped else out


def harmonic(m: Column) -> Column:
    """1 + 1/2 + ... + 1/m: summed up to 1000, then by the Euler-Maclaurin series, whose error is below 1e-14 there."""
    few = F.aggregate(F.sequence(F.lit(1).cast("long"), F.least(m, F.lit(1000).cast("long"))), F.lit(0.0), lambda s, i: s + 1 / i)
    x = m.cast("double")
    return F.when(m <= 1000, few).otherwise(F.log(x) + 0.5772156649015329 + 1 / (2 * x) - 1 / (12 * x * x))


def benjamini_yekutieli(df: DataFrame, group: list[str], p: str, adjusted: str = "p_by") -> DataFrame:
    """Benjamini-Yekutieli adjusted p-values within groups of tests.

    The least value of all greater p-values is taken over bins and then within a bin, so that no family is one task.
    """
    at = prefix_totals(df.filter(F.col(p).isNotNull()), group, p, {"n": F.count(F.lit(1))}, keep_bin="bin")
    whole = at.groupBy(*group).agg(F.sum("n").alias("m")).withColumn("h", harmonic(F.col("m")))
    raw = join_groups(at, whole, group).withColumn("__raw", F.col(p) * F.col("m") * F.col("h") / (F.col("before_n") + F.col("n")))
    bins = Window.partitionBy(*group).orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, -1)
    later = raw.groupBy(*group, "bin").agg(F.min("__raw").alias("__least")).select(*group, "bin", F.min("__least").over(bins).alias("__later"))
    in_bin = Window.partitionBy(*group, "bin").orderBy(F.col(p)).rowsBetween(0, Window.unboundedFollowing)
    done = join_groups(raw.withColumn("__here", F.min("__raw").over(in_bin)), later, [*group, "bin"])
    done = done.select(*group, p, F.least("__here", "__later", F.lit(1.0)).alias(adjusted))
    return join_groups(df, done, [*group, p], "left")


def placements(df: DataFrame, group: list[str], label: str, score: str) -> DataFrame:
    """Each row with its DeLong placement: the share of the other class it is ordered right against, ties one half."""
    at = prefix_totals(df, group, score, {"pos": F.sum(F.col(label).cast("long")), "neg": F.sum(1 - F.col(label).cast("long"))})
    whole = at.groupBy(*group).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    at = join_groups(at, whole, group)
    over_neg = (F.col("before_neg") + F.col("neg") / 2) / F.nullif(F.col("n_neg"), F.lit(0))
    under_pos = (F.col("n_pos") - F.col("before_pos") - F.col("pos") / 2) / F.nullif(F.col("n_pos"), F.lit(0))
    at = at.select(*group, score, over_neg.alias("__v10"), under_pos.alias("__v01"))
    return join_groups(df, at, [*group, score]).withColumn("placement", F.when(F.col(label) == 1, F.col("__v10")).otherwise(F.col("__v01"))).drop("__v10", "__v01")


def delong_paired(df: DataFrame, group: list[str], key: str, label: str, method: str, score: str, one: str, two: str) -> DataFrame:
    """DeLong's test of two methods' AUCs on the keys that have both: aucs, z of the difference."""
    both = df.filter(F.col(method).isin(one, two))
    wide = both.groupBy(*group, key).agg(F.max(label).alias("y"), F.max(F.when(F.col(method) == one, F.col(score))).alias("s1"), F.max(F.when(F.col(method) == two, F.col(score))).alias("s2")).filter("s1 is not null and s2 is not null")
    first = placements(wide, group, "y", "s1").withColumnRenamed("placement", "v1")
    second = placements(wide.select(*group, key, "y", "s2"), group, "y", "s2").select(*group, key, F.col("placement").alias("v2"))
    by_class = join_groups(first, second, [*group, key]).groupBy(*group, "y").agg(F.count(F.lit(1)).alias("n"), F.avg("v1").alias("a1"), F.avg("v2").alias("a2"), (F.var_samp("v1") + F.var_samp("v2") - 2 * F.covar_samp("v1", "v2")).alias("s"))
    out = by_class.groupBy(*group).agg(F.max(F.when(F.col("y") == 1, F.col("a1"))).alias("auc_1"), F.max(F.when(F.col("y") == 1, F.col("a2"))).alias("auc_2"), F.sum(F.col("s") / F.col("n")).alias("variance"))
    return out.withColumn("z", (F.col("auc_1") - F.col("auc_2")) / F.nullif(F.sqrt("variance"), F.lit(0.0)))


def delong_unpaired(df: DataFrame, group: list[str], label: str, score: str, arm: str, one: str, two: str) -> DataFrame:
    """The same for two disjoint sets of rows, told apart by `arm`; their variances add."""
    kept = df.filter(F.col(arm).isin(one, two))
    by_class = placements(kept, [*group, arm], label, score).groupBy(*group, arm, label).agg(F.count(F.lit(1)).alias("n"), F.avg("placement").alias("a"), F.var_samp("placement").alias("s"))
    per_arm = by_class.groupBy(*group, arm).agg(F.max(F.when(F.col(label) == 1, F.col("a"))).alias("auc"), F.sum(F.col("s") / F.col("n")).alias("v"))
    out = per_arm.groupBy(*group).agg(F.max(F.when(F.col(arm) == one, F.col("auc"))).alias("auc_1"), F.max(F.when(F.col(arm) == two, F.col("auc"))).alias("auc_2"), F.sum("v").alias("variance"))
    return out.withColumn("z", (F.col("auc_1") - F.col("auc_2")) / F.nullif(F.sqrt("variance"), F.lit(0.0)))


def density_on_grid(df: DataFrame, group: list[str], value: str, points: int = 50) -> DataFrame:
    """Gaussian kernel density (Scott's bandwidth) on an even grid over each group's range, scaled to a peak of 1.

    Rows are reduced to distinct values with counts first; a grid has `points` rows per group.
    """
    counted = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    span = df.groupBy(*group).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), (F.stddev_samp(value) * F.pow(F.count(F.lit(1)).cast("double"), F.lit(-0.2))).alias("h"))
    grid = span.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("step") / (points - 1))
    near = join_groups(grid, counted, group).withColumn("k", F.col("n") * F.exp(-F.pow((F.col("x") - F.col(value)) / F.nullif(F.col("h"), F.lit(0.0)), F.lit(2.0)) / 2))
    out = near.groupBy(*group, "step", "x").agg(F.sum("k").alias("k"))
    return out.withColumn("density", F.col("k") / F.max("k").over(Window.partitionBy(*group))).drop("k")


def auc_sample_size(prevalence: Column, auc: float = 0.75, width: float = 0.1, z: float = 1.959963984540054) -> Column:
    """Smallest n whose Hanley-McNeil confidence interval for the AUC is at most `width` wide, in closed form.

    var = (A + (n1 - 1) B + (n0 - 1) C) / (n1 n0) with A = auc (1 - auc), B = q1 - auc^2, C = q2 - auc^2; with
    n1 = p n and n0 = (1 - p) n the bound is a quadratic in n.
    """
    q1, q2 = auc / (2 - auc), 2 * auc * auc / (1 + auc)
    a, b, c = auc * (1 - auc), q1 - auc * auc, q2 - auc * auc
    limit = (width / 2 / z) ** 2
    p = prevalence
    x, y, w = limit * p * (1 - p), -(p * b + (1 - p) * c), F.lit(-(a - b - c))
    return F.ceil((-y + F.sqrt(y * y - 4 * x * w)) / (2 * F.nullif(x, F.lit(0.0)))).cast("long")
