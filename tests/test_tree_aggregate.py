from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gaugeworks.operators.tree_aggregate import Measure, hot_keys, key_results, rounds_for, tree_aggregate

EVAL = "repo struct<name_with_owner:string,primary_language:string>, status string, scores struct<purpose:struct<score:int>>, usage struct<output_tokens:int>, extra string, key_kind string"


def test_rounds():
    assert [rounds_for(n, 4) for n in (0, 1, 4, 5, 16, 17, 65)] == [1, 1, 1, 2, 2, 3, 4]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["hot", "a", "b", None]), st.one_of(st.none(), st.integers(-5, 5))), max_size=60), st.integers(1, 9), st.integers(2, 4), st.sampled_from([1, 9]))
def test_equals_plain_aggregation(spark, rows, parts, fan_in, told):
    df = spark.createDataFrame(rows, "k string, v int").repartition(parts)
    got = tree_aggregate(df, ["k"], [Measure("n", "count", F.lit(1)), Measure("s", "sum", F.col("v")), Measure("lo", "min", F.col("v")), Measure("hi", "max", F.col("v"))], fan_in, chunks=told)
    want = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_every_round_merges_at_most_fan_in(spark):
    df = spark.range(1000).repartition(40).withColumn("k", F.lit("one"))
    plan = tree_aggregate(df, ["k"], [Measure("n", "count", F.lit(1))], 4, chunks=40)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 3  # 40 chunks -> 10 -> 3 -> 1 nodes


def test_spellings_nulls_and_clashing_columns(spark):
    row = lambda r, l, s=3: ((r, l), "ok", ((s,),), (1,), "x", "mine")
    df = spark.createDataFrame([row(" A/B ", "Go"), row("a/b", "go", 9), row(None, None, None), row("c/d", "Rust")], EVAL)
    out = {(r.key_kind, r.key_value): r for r in key_results(df).collect()}
    assert set(out) == {("repo", "a/b"), ("repo", "c/d"), ("language", "go"), ("language", "rust")}
    assert out["repo", "a/b"].n_rows == 2 and out["repo", "a/b"].n_scored == 1 and out["repo", "a/b"].share == 0.5
    assert Counter(r.key_kind for r in hot_keys(df, 0.5).collect()) == {"repo": 1, "language": 1}


def test_empty(spark):
    assert key_results(spark.createDataFrame([], EVAL)).collect() == []
