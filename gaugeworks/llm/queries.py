"""Queries of this folder's operators: name -> function of (spark, sf_dir)."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from . import code_docs, consensus, leakage, mixing, pair_defects, toxicity

#: Judges an item needs for p1_found.
MIN_JUDGES = 5


def _p1(spark: SparkSession, d: str):
    model, lists = consensus.fit(consensus.votes_of(read_table(spark, d, "evaluations")))
    return model, consensus.consensus(lists, model)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _p1(spark, d)[1].where(F.col("n_judges") >= MIN_JUDGES).select("tool_uid", "scenario", "score")


def p1_consensus(spark: SparkSession, d: str) -> DataFrame:
    return _p1(spark, d)[1]


def p1_annotators(spark: SparkSession, d: str) -> DataFrame:
    return consensus.annotator_reliability(spark, _p1(spark, d)[0])


def p1_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Votes, mean vote and share of agreeing pairs of judges per item."""
    by = consensus.votes_of(read_table(spark, d, "evaluations")).groupBy(*consensus.ITEM, "score").agg(F.count(F.lit(1)).alias("n"))
    item = by.groupBy(*consensus.ITEM).agg(F.sum("n").alias("n_judges"), F.sum(F.col("n") * F.col("score")).alias("total"), F.sum(F.col("n") * (F.col("n") - 1)).alias("same"))
    n = F.col("n_judges")
    return item.select(*consensus.ITEM, "n_judges", (F.col("total") / n).alias("mean_score"), F.try_divide(F.col("same"), n * (n - 1)).alias("agreement"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return pair_defects.found(read_table(spark, d, "evaluations"))


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rows and defects per judge."""
    return pair_defects.judged(read_table(spark, d, "evaluations")).groupBy("judge").agg(F.count(F.lit(1)).alias("n_rows"), *(F.count_if(F.col("defect") == k).alias(f"n_{k}") for k in pair_defects.DEFECTS))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return code_docs.found(read_table(spark, d, "source_files"))


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    return code_docs.documented_functions(read_table(spark, d, "source_files"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(read_table(spark, d, "documents"), read_table(spark, d, "eval_items"))


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Documents that each item leaked into."""
    items = read_table(spark, d, "eval_items").select("item_id")
    return items.join(p7_found(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents")), "item_id", "left").select("item_id", F.coalesce("n_documents", F.lit(0)).alias("n_documents"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The selection: documents with their copies."""
    return mixing.mix(read_table(spark, d, "documents"), read_table(spark, d, "mix_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = read_table(spark, d, "mix_targets")
    selected, counts, _ = mixing.mix(read_table(spark, d, "documents"), targets)
    return mixing.share_report(selected, counts, targets)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.found(read_table(spark, d, "documents"))


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    documents = read_table(spark, d, "documents")
    return toxicity.score_documents(documents, toxicity.fit_on(documents))


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.rates_by_source(read_table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_consensus, p1_annotators, p1_agreement, p3_found, p3_rates, p4_found, p4_pairs, p7_found, p7_items, p8_mix, p8_shares, p9_found, p9_scores, p9_rates)}

ORACLE = {
    "p1_agreement": """
        WITH votes AS (
          SELECT tool_uid, scenario, judge.id AS judge, arg_max(scores.purpose.score, (ingested_at, eval_id)) AS score
          FROM evaluations
          WHERE status = 'ok' AND scores.purpose.score BETWEEN 1 AND 5 AND tool_uid IS NOT NULL AND scenario IS NOT NULL AND judge.id IS NOT NULL
          GROUP BY ALL),
        hist AS (SELECT tool_uid, scenario, score, count(*) AS n FROM votes GROUP BY ALL)
        SELECT tool_uid, scenario, sum(n)::BIGINT AS n_judges, sum(n * score)::DOUBLE / sum(n) AS mean_score,
               CASE WHEN sum(n) > 1 THEN sum(n * (n - 1))::DOUBLE / (sum(n) * (sum(n) - 1)) END AS agreement
        FROM hist GROUP BY ALL""",
}
