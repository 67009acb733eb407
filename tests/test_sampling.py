from collections import Counter

from pyspark.sql import functions as F

from gaugeworks.operators import sampling


def frame(spark, rows):
    return spark.createDataFrame(rows, "key string, stratum string, repo string, components array<string>")


def test_greedy_prefers_new_repositories_and_keeps(spark):
    rows = [(f"k{i}", "a" if i < 20 else "b", f"r{i % 4}", ["x" if i % 2 else "y"]) for i in range(26)] + [("k0", "a", "r0", ["z"]), (None, "a", "r", []), ("n", None, "r", [])]
    got = sampling.greedy_stratified_sample(frame(spark, rows), 8, 3, ("k5",)).collect()
    assert Counter(r.stratum for r in got) == {"a": 4, "b": 4} and "k5" in {r.key for r in got}
    repos = Counter(f"r{int(r.key[1:]) % 4}" for r in got)
    assert max(repos.values()) - min(repos.values()) <= 1
    assert [tuple(r) for r in got] == [tuple(r) for r in sampling.greedy_stratified_sample(frame(spark, rows).repartition(5), 8, 3, ("k5",)).collect()]


def test_greedy_small_and_empty(spark):
    assert sampling.greedy_stratified_sample(frame(spark, [("k", "a", None, None)]), 5).count() == 1
    assert sampling.greedy_stratified_sample(frame(spark, []), 5).count() == 0


def test_backfill_asks_for_the_deficit_only(spark):
    pool = spark.createDataFrame([(f"k{i:02}", i) for i in range(20)], "id string, rank int")
    asked = []

    def process(df):
        asked.append(df.count())
        return df.where("rank % 2 = 1")

    got, rounds = sampling.run_until_target(pool, "id", [F.col("rank")], 4, process)
    assert sorted(got) == ["k01", "k03", "k05", "k07"] and asked[0] == 4 and rounds == len(asked)
    got, _ = sampling.run_until_target(pool, "id", [F.col("rank")], 30, process)
    assert len(got) == 10
