"""Per-key results without hot reducers: multi-level tree aggregation.

A plain `groupBy(key)` sends every map task's partial of a key to one reducer. Built-in partial aggregation already
keeps a hot key down to one partial per map task, but at thousands of tasks that reducer still receives thousands of
partials of each hot key while the others idle. Here the input chunks (the fixed-size input splits) are the leaves of a
tree. Round r merges the states of at most `fan_in` neighbouring nodes of a key, so a reducer gets at most `fan_in`
partials of a key in each of the ceil(log(chunks) / log(fan_in)) rounds, and no round moves raw rows.

Defined results: a null key forms its own group unless `keep_null_keys` is false; an empty table gives no rows; nulls in
a measure are left out of its sum, minimum and maximum, and counted by `count` specs only when their expression is not
null; repeated rows and ties count each time; the working columns have reserved names with a `__gw_` prefix, so other
columns of the input, whatever their names, cannot clash.
"""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MERGE = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
_LEAF = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class Measure:
    """A state of constant size: `kind` is sum, count, min or max of `value`."""

    name: str
    kind: str
    value: Column


def rounds_for(chunks: int, fan_in: int) -> int:
    """Merge rounds needed until one node is left (at least one)."""
    n, left = 1, -(-max(1, chunks) // fan_in)
    while left > 1:
        left, n = -(-left // fan_in), n + 1
    return n


#: More input partitions than any plan has; it bounds the rounds where the size of a plan is unknown.
MOST_CHUNKS = 1 << 20


def estimated_chunks(df: DataFrame) -> int:
    """Input partitions by the plan's estimated size, which is huge where it is unknown."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = int(df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return max(1, min(MOST_CHUNKS, -(-size // split)))


def tree_aggregate(df: DataFrame, keys: Sequence[str], measures: Sequence[Measure], fan_in: int = 16, keep_null_keys: bool = True, chunks: int | None = None) -> DataFrame:
    """One row per key with the merged measures; see the module docstring.

    `chunks` is the number of input partitions; without it, it is estimated from the plan's size, which runs no job. It
    only sets the number of rounds: the last round merges by key alone, so a wrong number costs a round or some fan-in,
    never a row.
    """
    if fan_in < 2:
        raise ValueError("fan_in must be at least 2")
    chunks = estimated_chunks(df) if chunks is None else chunks
    state = df.select(*keys, *(m.value.alias(f"__gw_{m.name}") for m in measures))
    if not keep_null_keys:
        for k in keys:
            state = state.where(F.col(k).isNotNull())
    # Leaves: the map-side hash aggregate of this first exchange combines each chunk locally.
    rounds, combine = rounds_for(chunks, fan_in), _LEAF
    node = F.spark_partition_id()
    for r in range(1, rounds + 1):
        last = r == rounds
        state = state if last else state.withColumn("__gw_node", F.floor(node / F.lit(fan_in)).cast("int"))
        state = state.groupBy(*keys, *([] if last else ["__gw_node"])).agg(*(combine[m.kind](f"__gw_{m.name}").alias(f"__gw_{m.name}") for m in measures))
        combine, node = _MERGE, F.col("__gw_node")
    return state.select(*keys, *(F.col(f"__gw_{m.name}").alias(m.name) for m in measures))


def normalised_key(c: Column) -> Column:
    """Lower case without surrounding white space; null stays null."""
    return F.lower(F.regexp_replace(c, r"^[\s ]+|[\s ]+$", ""))


def key_results(evaluations: DataFrame, fan_in: int = 16, chunks: int | None = None) -> DataFrame:
    """Results per repository and per language of an evaluations table, in one pass over it.

    Columns: key_kind ('repo' or 'language'), key_value, n_rows, share (of all rows, null keys included), n_ok,
    n_scored, mean_score, min_score, max_score, score_1..score_5, output_tokens. Both kinds come from one scan: each row
    is expanded to its two keys before the map-side combine, so only states are shuffled.
    """
    score = F.col("scores.purpose.score")
    flat = evaluations.select(
        normalised_key(F.col("repo.name_with_owner")).alias("__gw_repo"), normalised_key(F.col("repo.primary_language")).alias("__gw_language"), "status",
        F.when(score.between(1, 5), score).alias("valid"), F.col("usage.output_tokens").cast("long").alias("output_tokens"),
    )
    # unpivot expands each row before the map-side combine; unlike a generator over structs it keeps nested pruning of the scan.
    wide = flat.unpivot(["status", "valid", "output_tokens"], ["__gw_repo", "__gw_language"], "key_kind", "key_value").withColumn("key_kind", F.substring("key_kind", 6, 20))
    measures = [
        Measure("n_rows", "count", F.lit(1)),
        Measure("n_ok", "sum", F.when(F.col("status") == "ok", 1).otherwise(0).cast("long")),
        Measure("n_scored", "count", F.col("valid")),
        Measure("score_sum", "sum", F.col("valid").cast("long")),
        Measure("min_score", "min", F.col("valid")),
        Measure("max_score", "max", F.col("valid")),
        *(Measure(f"score_{k}", "sum", F.when(F.col("valid") == k, 1).otherwise(0).cast("long")) for k in range(1, 6)),
        Measure("output_tokens", "sum", F.col("output_tokens")),
    ]
    states = tree_aggregate(wide, ["key_kind", "key_value"], measures, fan_in, keep_null_keys=False, chunks=chunks)
    total = evaluations.select(F.count(F.lit(1)).alias("n")).scalar()
    return states.select(
        "key_kind",
        "key_value",
        "n_rows",
        (F.col("n_rows") / total).alias("share"),
        "n_ok",
        "n_scored",
        F.try_divide(F.col("score_sum"), F.col("n_scored")).alias("mean_score"),
        "min_score",
        "max_score",
        *(f"score_{k}" for k in range(1, 6)),
        "output_tokens",
    )


def hot_keys(evaluations: DataFrame, min_share: float = 0.05, fan_in: int = 16) -> DataFrame:
    """key_kind, key_value of the keys that hold at least `min_share` of all rows."""
    return key_results(evaluations, fan_in).where(F.col("share") >= min_share).select("key_kind", "key_value")
