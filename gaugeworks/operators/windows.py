"""Quartiles and their movement between the scenarios."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .facts import WITH, WITHOUT


def score_quartiles(long: DataFrame) -> DataFrame:
    """Adds `quartil` 1..4 of a score by its average percent rank within judge, component and scenario.

    Ranks are found on counts of distinct scores, of which a group has a handful, not on rows.
    """
    group = ["juiz", "componente", "cenario"]
    counts = long.groupBy(*group, "nota").agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy(*group)
    below = F.coalesce(F.sum("k").over(w.orderBy("nota").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pct = (below + (F.col("k") + 1) / 2) / F.sum("k").over(w)
    bins = counts.select(*group, "nota", F.least(F.greatest(F.ceil(pct * 4), F.lit(1)), F.lit(4)).cast("int").alias("quartil"))
    return long.join(bins, [*group, "nota"])


def quartile_migration(long: DataFrame) -> DataFrame:
    """Per complete pair: both quartiles, their difference, whether the scores tie and whether the pair diverges by two or more."""
    q = score_quartiles(long)
    at = lambda c, v: F.avg(F.when(F.col("cenario") == c, F.col(v)))
    rows = q.groupBy("juiz", "componente", "tool_uid").agg(at(WITHOUT, "quartil").alias("quartil_description_only"), at(WITH, "quartil").alias("quartil_with_source"), at(WITHOUT, "nota").alias("sem"), at(WITH, "nota").alias("com"))
    rows = rows.where("sem is not null and com is not null").withColumn("diff_quartil", F.col("quartil_with_source") - F.col("quartil_description_only")).withColumn("empate", F.col("sem") == F.col("com"))
    return rows.select("juiz", "componente", "tool_uid", "quartil_description_only", "quartil_with_source", "diff_quartil", "empate", (~F.col("empate") & (F.abs("diff_quartil") >= 2)).alias("diverge"))


def migration_summary(migration: DataFrame) -> DataFrame:
    d = F.col("diff_quartil")
    return migration.groupBy("juiz", "componente").agg(
        F.count(F.lit(1)).alias("n_pares"), F.count_if("empate").alias("n_empates"), F.count_if(~F.col("empate") & (F.abs(d) == 1)).alias("n_migrou_1_faixa"),
        F.count_if("diverge").alias("n_diverge"), F.count_if(F.col("diverge") & (d > 0)).alias("n_diverge_subiu"), F.count_if(F.col("diverge") & (d < 0)).alias("n_diverge_desceu"),
    )


def _band(x: Column, cuts: Column) -> Column:
    return F.when(x <= cuts[0], 1).when(x <= cuts[1], 2).when(x <= cuts[2], 3).otherwise(4)


def cut_point_transition(diffs: DataFrame) -> DataFrame:
    """The other quartile method: bands by the cut points of the scores without source; shares kept, up and down."""
    group = ["juiz", "componente"]
    cuts = diffs.groupBy(*group).agg(F.percentile("sem", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("cuts"))
    rows = diffs.join(cuts, group).withColumn("a", _band(F.col("sem"), F.col("cuts"))).withColumn("b", _band(F.col("com"), F.col("cuts")))
    share = lambda c: F.count_if(c) * 100.0 / F.count(F.lit(1))
    return rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), share(F.col("a") == F.col("b")).alias("pct_manteve"), share(F.col("b") > F.col("a")).alias("pct_subiu"), share(F.col("b") < F.col("a")).alias("pct_desceu")
    )


def untied_divergences(diffs: DataFrame) -> DataFrame:
    return diffs.where("diff <> 0").select("juiz", "componente", "tool_uid", F.col("diff").alias("diff_nota"), (F.col("diff") > 0).alias("subiu"))


def divergence_summary(untied: DataFrame) -> DataFrame:
    return untied.groupBy("juiz", "componente").agg(F.count(F.lit(1)).alias("n_diverge"), F.count_if("subiu").alias("n_diverge_subiu"), F.count_if(~F.col("subiu")).alias("n_diverge_desceu"))
