"""Deduplication of candidates and evaluations.

Windows of `row_number() = 1` are pruned before their shuffle (WindowGroupLimit), so a key with very many rows sends one
row per task. Null keys form one key; ties are broken by the input order column, so results are deterministic.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import tool_key

NO_VERSION = "(sem versão)"


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("__gw_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__gw_n = 1").drop("__gw_n")


def dedupe_candidates(candidates: DataFrame) -> DataFrame:
    """By id: the first record in seq order, with the matched signals of all records in first-seen order."""
    rows = candidates.select("id", "seq", "matched_signals")
    # One entry per (id, signal) before the lists are built, so a list is as long as the id has signals, not records.
    each = rows.select("id", "seq", F.posexplode("matched_signals").alias("pos", "signal")).groupBy("id", "signal").agg(F.min(F.struct("seq", "pos")).alias("at"))
    signals = each.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "signal"))), lambda x: x["signal"]).alias("all_signals"))
    first = first_by(candidates, ["id"], F.col("seq"))
    joined = first.alias("f").join(signals.alias("s"), F.col("f.id").eqNullSafe(F.col("s.id")), "left")
    return joined.select(*(F.col(f"f.{c}") if c != "matched_signals" else F.coalesce("s.all_signals", F.array().cast("array<string>")).alias(c) for c in first.columns))


def status_rank(status: Column) -> Column:
    return F.when(status.isin("ok", "refused"), 2).when(status == "error", 1).otherwise(0)


def with_tool_key(evaluations: DataFrame) -> DataFrame:
    return evaluations.withColumn("tool_key", tool_key(F.col("tool_uid"), F.col("tool.name")))


def dedupe_evaluations(evaluations: DataFrame) -> DataFrame:
    """Per tool key, scenario, prompt version and judge: the best status, then the latest, then the last in the input."""
    rows = with_tool_key(evaluations).withColumn("__gw_judge", F.col("judge.id"))
    kept = first_by(rows, ["tool_key", "scenario", "prompt_version", "__gw_judge"], status_rank(F.col("status")).desc(), F.coalesce("evaluated_at", F.lit("")).desc(), F.col("eval_id").desc())
    return kept.drop("__gw_judge")


def repair_evaluations(evaluations: DataFrame) -> DataFrame:
    """The opposite policy: uids shared by several tool names get the name appended; then the earliest per uid, scenario and judge."""
    names = evaluations.groupBy("tool_uid").agg((F.min("tool.name") != F.max("tool.name")).alias("shared"))
    # Null uids form one key of their own, which nothing is appended to.
    shared = names.where("shared").select(F.col("tool_uid").alias("__gw_uid"), "shared")
    rows = evaluations.join(shared, F.col("tool_uid") == F.col("__gw_uid"), "left").drop("__gw_uid").withColumn("tool_uid", F.when(F.col("shared"), F.concat_ws("::", "tool_uid", "tool.name")).otherwise(F.col("tool_uid"))).drop("shared")
    kept = first_by(rows.withColumn("__gw_judge", F.col("judge.id")), ["tool_uid", "scenario", "__gw_judge"], F.coalesce("evaluated_at", F.lit("")).asc(), F.col("eval_id").asc())
    return kept.drop("__gw_judge")


def rebuild_checkpoint(evaluations: DataFrame) -> DataFrame:
    """tool_uid, scenario, judge, status: the last status of each key in input order."""
    return evaluations.groupBy("tool_uid", "scenario", F.col("judge.id").alias("judge")).agg(F.max_by("status", "eval_id").alias("status"))


def version_of(df: DataFrame) -> Column:
    return F.coalesce(F.col("prompt_version"), F.lit(NO_VERSION))


def active_version(evaluations: DataFrame, versions: DataFrame | None = None) -> DataFrame:
    """Rows of the lexicographically last prompt version; null versions count as '(sem versão)'.

    `versions` may name a cheaper frame with the same versions, such as the rows before deduplication. Distinct versions
    are found by hash first, so the maximum is taken over a handful of strings.
    """
    source = evaluations if versions is None else versions
    last = source.select(version_of(source).alias("v")).distinct().select(F.max("v").alias("v")).scalar()
    return evaluations.where(version_of(evaluations) == last)


def purge_version(evaluations: DataFrame, version: str) -> DataFrame:
    """Without the rows of a prompt version."""
    return evaluations.where(~F.col("prompt_version").eqNullSafe(version))


def dedupe_report(evaluations: DataFrame) -> DataFrame:
    """One row: lines before and after deduplication, how many went, and how many of the kept are errors."""
    kept = dedupe_evaluations(evaluations).agg(F.count(F.lit(1)).alias("linhas_unicas"), F.count_if(F.col("status") == "error").alias("ainda_com_erro"))
    return kept.select(F.lit(evaluations.select(F.count(F.lit(1)).alias("n")).scalar()).alias("linhas"), "linhas_unicas", "ainda_com_erro").withColumn("removidas", F.col("linhas") - F.col("linhas_unicas"))


def not_yet_processed(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not among the done ones; a null key is equal to a null key."""
    d = done.select(*(F.col(k).alias(f"__gw_{k}") for k in keys)).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__gw_{k}"))
    return rows.join(d, same, "left_anti")
