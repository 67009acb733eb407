"""Rank statistics as relational expressions.

Moments come from sums, so that every aggregate combines on the map side; scores are small integers, whose sums are exact
in doubles. Degenerate cases (no rows, no variance) give null.
"""

import functools
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sample_stddev(x: Column) -> Column:
    """Standard deviation with n - 1, from sums; null for fewer than two values."""
    n, s, q = F.count(x), F.sum(x.cast("double")), F.sum((x * x).cast("double"))
    return F.when(n > 1, F.sqrt(F.greatest(F.try_divide(n * q - s * s, n * (n - 1)), F.lit(0.0))))


def pearson(x: Column, y: Column) -> Column:
    """Correlation from sums over rows where both are present; null without variance."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    n = F.count(x)
    sx, sy, sxx, syy, sxy = F.sum(x), F.sum(y), F.sum(x * x), F.sum(y * y), F.sum(x * y)
    return F.try_divide(n * sxy - sx * sy, F.sqrt(F.greatest(n * sxx - sx * sx, F.lit(0.0)) * F.greatest(n * syy - sy * sy, F.lit(0.0))))


def average_ranks(df: DataFrame, group: list[str], value: str, rank: str) -> DataFrame:
    """Adds the average rank of `value` within the group.

    Ranks are found on the counts of distinct values and joined back, so no window holds a whole group of rows: a
    group's window has one row per distinct value.
    """
    counts = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("__gw_n"))
    below = F.sum("__gw_n").over(Window.partitionBy(*group).orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    ranks = counts.select(*group, value, (F.coalesce(below, F.lit(0)) + (F.col("__gw_n") + 1) / 2).alias(rank))
    return df.join(ranks, [*group, value])


def signed_rank_sums(diffs: DataFrame, group: list[str]) -> DataFrame:
    """Per group of differences: n effective, R+, R-, W and the tie term sum(t^3 - t), from counts of distinct differences."""
    counts = diffs.where("diff <> 0").groupBy(*group, "diff").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy(*group, F.abs("diff").alias("a")).agg(F.sum("n").alias("t"), F.sum(F.when(F.col("diff") > 0, F.col("n")).otherwise(0)).alias("up"))
    below = F.coalesce(F.sum("t").over(Window.partitionBy(*group).orderBy("a").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = sizes.withColumn("r", below + (F.col("t") + 1) / 2)
    return ranked.groupBy(*group).agg(
        F.sum("t").alias("n_efetivo"),
        F.sum(F.col("r") * F.col("up")).alias("r_mais"),
        F.sum(F.col("r") * (F.col("t") - F.col("up"))).alias("r_menos"),
        F.sum((F.col("t") * F.col("t") * F.col("t") - F.col("t")).cast("double")).alias("empate_termo"),
    ).withColumn("w", F.least("r_mais", "r_menos"))


def wilcoxon_z(n: Column, w: Column, ties: Column) -> Column:
    """Normal score with tie correction and without continuity correction."""
    n = n.cast("double")
    return F.try_divide(w - n * (n + 1) / 4, F.sqrt(F.greatest(n * (n + 1) * (2 * n + 1) / 24 - ties / 48, F.lit(0.0))))


#: Up to so many untied differences the distribution of W is enumerated exactly.
EXACT_N = 50


@functools.cache
def _signed_rank_counts(n: int) -> tuple[int, ...]:
    """How many sign patterns of ranks 1..n give each value of R+."""
    counts = [1]
    for r in range(1, n + 1):
        new = counts + [0] * r
        for k, c in enumerate(counts):
            new[k + r] += c
        counts = new
    return tuple(counts)


def exact_p(n: int, w: float) -> float:
    """Two-sided P(W <= w) of the signed-rank statistic without ties."""
    return min(1.0, 2 * sum(_signed_rank_counts(n)[: int(w) + 1]) / 2**n)


@F.pandas_udf(T.DoubleType())
def wilcoxon_p(n: pd.Series, w: pd.Series, ties: pd.Series, zeros: pd.Series, z: pd.Series) -> pd.Series:
    """Exact for few differences without ties and zeros, else by the normal score."""

    def one(n, w, t, zero, z):
        if w is None or w != w or n != n:
            return None
        if n <= EXACT_N and t == 0 and zero == 0:
            return exact_p(int(n), w)
        return None if z is None or z != z else math.erfc(abs(z) / math.sqrt(2))

    return pd.Series([one(*r) for r in zip(n, w, ties, zeros, z)], dtype=float)


def benjamini_hochberg(df: DataFrame, p: str, family: list[str], out: str) -> DataFrame:
    """Adds the step-up adjusted p within each family; null p stay null and do not count.

    A family holds one row per test (judge by component), so its window is as small as the number of tests.
    """
    tests = Window.partitionBy(*family)
    rows = df.withColumn("__gw_m", F.count(p).over(tests)).withColumn("__gw_k", F.row_number().over(tests.orderBy(F.col(p).asc_nulls_last())))
    rows = rows.withColumn("__gw_raw", F.col(p) * F.col("__gw_m") / F.col("__gw_k"))
    down = tests.orderBy(F.col(p).asc_nulls_last(), "__gw_k").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return rows.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min("__gw_raw").over(down)))).drop("__gw_m", "__gw_k", "__gw_raw")


def wilcoxon_by_component(diffs: DataFrame) -> DataFrame:
    """Per judge and component: pairs, ties, effective n, median difference, W, z, p, adjusted p and its mark."""
    group = ["juiz", "componente"]
    base = diffs.groupBy(*group).agg(F.count(F.lit(1)).alias("n_pareado"), F.count_if(F.col("diff") == 0).alias("n_empates"), F.median("diff").alias("mediana_diferenca"))
    sums = signed_rank_sums(diffs, group)
    rows = base.join(sums, group, "left").withColumn("z", wilcoxon_z(F.col("n_efetivo"), F.col("w"), F.col("empate_termo"))).withColumn("p_valor", wilcoxon_p("n_efetivo", "w", "empate_termo", "n_empates", "z"))
    rows = benjamini_hochberg(rows, "p_valor", ["juiz"], "p_valor_bh")
    return rows.select(
        *group, "n_pareado", "n_empates", (F.col("n_empates") * 100.0 / F.col("n_pareado")).alias("proporcao_empates_percentual"), F.coalesce("n_efetivo", F.lit(0)).alias("n_efetivo_teste"),
        "mediana_diferenca", F.col("w").alias("estatistica_w"), "z", "p_valor", "p_valor_bh", (F.col("p_valor_bh") < 0.05).alias("significativo_bh_0.05"),
    )


def significance_mark(p: Column) -> Column:
    """'*' below 0.05, else ''; null gives ''."""
    return F.when(p < 0.05, "*").otherwise("")


def rank_biserial(diffs: DataFrame, group: list[str]) -> DataFrame:
    """(R+ - R-) / (R+ + R-) per group; null when every pair is tied."""
    keys = diffs.select(*group).distinct()
    return keys.join(signed_rank_sums(diffs, group), group, "left").select(*group, F.try_divide(F.col("r_mais") - F.col("r_menos"), F.col("r_mais") + F.col("r_menos")).alias("r_rank_biserial"))


def spearman(df: DataFrame, group: list[str], x: str, y: str, out: str) -> DataFrame:
    """Correlation of average ranks per group."""
    ranked = average_ranks(average_ranks(df, group, x, "__gw_rx"), group, y, "__gw_ry")
    return ranked.groupBy(*group).agg(pearson(F.col("__gw_rx"), F.col("__gw_ry")).alias(out))


def cohen_kappa(a: Column, b: Column, classes: list) -> Column:
    """Observed and chance agreement of two labels over fixed classes."""
    po = F.avg((a == b).cast("double"))
    pe = sum((F.avg((a == c).cast("double")) * F.avg((b == c).cast("double")) for c in classes), F.lit(0.0))
    return F.try_divide(po - pe, 1 - pe)


def fleiss_kappa(labels: DataFrame, group: list[str], item: list[str], label: str) -> DataFrame:
    """Fleiss' kappa per group over items rated by equally many raters; items with fewer than two ratings are left out."""
    counts = labels.groupBy(*group, *item, label).agg(F.count(F.lit(1)).alias("n"))
    items = counts.groupBy(*group, *item).agg(F.sum("n").alias("k"), F.sum(F.col("n") * (F.col("n") - 1)).alias("same")).where("k > 1")
    agreement = items.groupBy(*group).agg(F.avg(F.col("same") / (F.col("k") * (F.col("k") - 1))).alias("p_obs"), F.sum("k").alias("total"))
    shares = counts.join(items.select(*group, *item), [*group, *item], "left_semi").groupBy(*group, label).agg(F.sum("n").alias("n"))
    chance = shares.join(agreement, group).groupBy(*group).agg(F.sum((F.col("n") / F.col("total")) * (F.col("n") / F.col("total"))).alias("p_exp"))
    return agreement.join(chance, group).select(*group, "p_obs", "p_exp", F.try_divide(F.col("p_obs") - F.col("p_exp"), 1 - F.col("p_exp")).alias("kappa_fleiss"))
