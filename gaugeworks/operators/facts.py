"""The long fact table of scores and its paired form."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dedup import active_version, dedupe_evaluations

COMPONENTS = ["purpose", "guidelines", "limitations", "parameter_explanation", "length_completeness", "examples"]
WITHOUT, WITH = "description_only", "with_source"


def current_evaluations(evaluations: DataFrame, excluded_judges: tuple[str, ...] = ()) -> DataFrame:
    """Deduplicated rows of the active version, without excluded judges."""
    rows = evaluations.where(~F.col("judge.id").isin(*excluded_judges)) if excluded_judges else evaluations
    return active_version(dedupe_evaluations(rows), rows)


def scores_long(current: DataFrame) -> DataFrame:
    """tool_uid, cenario, juiz, linguagem, componente, nota: one row per score of an ok row; a null score gives none."""
    cells = F.array(*(F.struct(F.lit(c).alias("componente"), F.col(f"scores.{c}.score").alias("nota")) for c in COMPONENTS))
    return (
        current.where("status = 'ok'")
        .select(F.col("tool_key").alias("tool_uid"), F.col("scenario").alias("cenario"), F.col("judge.id").alias("juiz"), F.col("repo.primary_language").alias("linguagem"), F.explode(cells).alias("c"))
        .select("tool_uid", "cenario", "juiz", "linguagem", "c.componente", "c.nota")
        .where("nota is not null")
    )


def paired(long: DataFrame) -> DataFrame:
    """juiz, componente, tool_uid, sem, com: mean score without and with source, null where there is none."""
    return long.groupBy("juiz", "componente", "tool_uid").agg(
        F.avg(F.when(F.col("cenario") == WITHOUT, F.col("nota"))).alias("sem"), F.avg(F.when(F.col("cenario") == WITH, F.col("nota"))).alias("com")
    )


def differences(long: DataFrame) -> DataFrame:
    """Complete pairs with `diff` = with source minus without."""
    return paired(long).where("sem is not null and com is not null").withColumn("diff", F.col("com") - F.col("sem"))
