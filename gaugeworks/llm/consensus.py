"""Consensus from several annotators' labels by a community confusion model (variational Bayes).

Each annotator belongs to one of a few communities with a shared confusion matrix. An annotator's own matrix has a
Dirichlet prior around the community's, so annotators with few labels are held near their community and those with many
speak for themselves. Coordinate updates of the variational posterior:

  items        q(true class) from the expected log confusion of the item's annotators (distributed)
  annotators   expected counts (annotator, true class, label), summed on the cluster; then Dirichlet posteriors
  communities  responsibilities from the Dirichlet-multinomial evidence of each annotator; pooled mean matrices

An iteration is one pass over the compact vote lists with one small aggregation; only (annotators x classes) rows reach
the driver, and the number of annotators is checked against MAX_ANNOTATORS, which bounds the parameters each task gets.

Defined results: rows whose status is not ok, whose score is null or outside 1..5 or whose tool, scenario or judge is
null give no vote; of several votes of a judge for an item the latest counts (by time of ingestion, then eval_id), so
repeated rows change nothing; ties of the posterior go to the lower score; an empty table gives empty results.
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLASSES = 5
#: Parameters per annotator are CLASSES x CLASSES doubles, so a task gets at most 4 MB.
MAX_ANNOTATORS = 20_000
ITEM = ["tool_uid", "scenario"]


def votes_of(evaluations: DataFrame) -> DataFrame:
    """tool_uid, scenario, judge, score: one vote per judge and item."""
    score = F.col("scores.purpose.score")
    rows = evaluations.where((F.col("status") == "ok") & score.between(1, CLASSES)).select(*ITEM, F.col("judge.id").alias("judge"), F.struct("ingested_at", "eval_id", score.alias("score")).alias("at"))
    return rows.dropna(subset=[*ITEM, "judge"]).groupBy(*ITEM, "judge").agg(F.max("at").alias("at")).select(*ITEM, "judge", F.col("at.score").alias("score"))


@dataclass(frozen=True)
class Model:
    """Fitted parameters: annotators in order, their labels' counts, expected log confusion (annotator, class, label), and so on."""

    annotators: list[str]
    log_confusion: np.ndarray
    log_prior: np.ndarray
    counts: np.ndarray
    community: np.ndarray
    iterations: int


def _digamma(x: np.ndarray) -> np.ndarray:
    """Recurrence up to 6, then the asymptotic series."""
    x = np.array(x, float)
    out = np.zeros_like(x)
    for _ in range(6):
        small = x < 6
        out[small] -= 1 / x[small]
        x[small] += 1
    inv = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - inv * (1 / 12 - inv * (1 / 120 - inv / 252))


_lgamma = np.vectorize(math.lgamma, otypes=[float])


def _posteriors(codes: np.ndarray, offsets: np.ndarray, by_code: np.ndarray, log_prior: np.ndarray) -> np.ndarray:
    """(items x classes) posterior of vote lists: codes are annotator * CLASSES + label."""
    sums = np.zeros((len(offsets) - 1, CLASSES))
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for k in range(CLASSES):
        sums[:, k] = np.bincount(owner, by_code[codes, k], minlength=len(sums)) + log_prior[k]
    sums -= sums.max(axis=1, keepdims=True)
    p = np.exp(sums)
    return p / p.sum(axis=1, keepdims=True)


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), (offsets - offsets[0]).astype(np.int64)


def _expected_counts(votes: DataFrame, by_code: np.ndarray, log_prior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected (code x class) counts and class totals under the current posterior."""
    size = len(by_code)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals, any_rows = np.zeros((size, CLASSES)), np.zeros(CLASSES), False
        for b in batches:
            if b.num_rows:
                any_rows = True
                codes, offsets = _lists(b.column("codes"))
                p = _posteriors(codes, offsets, by_code, log_prior)
                owner = np.repeat(np.arange(len(p)), np.diff(offsets))
                for k in range(CLASSES):
                    counts[:, k] += np.bincount(codes, p[owner, k], minlength=size)
                totals += p.sum(axis=0)
        if any_rows:
            used = np.flatnonzero(counts.any(axis=1))
            rows = np.vstack([counts[used], totals])
            yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), *(pa.array(rows[:, k]) for k in range(CLASSES))], names=["code", *(f"c{k}" for k in range(CLASSES))])

    schema = "code long, " + ", ".join(f"c{k} double" for k in range(CLASSES))
    got = votes.select("codes").mapInArrow(run, schema).groupBy("code").agg(*(F.sum(f"c{k}").alias(f"c{k}") for k in range(CLASSES))).collect()
    counts, totals = np.zeros((size, CLASSES)), np.zeros(CLASSES)
    for r in got:
        if r.code < 0:
            totals += np.array(r[1:])
        else:
            counts[r.code] = r[1:]
    return counts, totals


def _vote_lists(votes: DataFrame, annotators: list[str]) -> DataFrame:
    """tool_uid, scenario, codes: the votes of an item as integers."""
    spark: SparkSession = votes.sparkSession
    # The list of annotators is bounded (MAX_ANNOTATORS, checked by the caller), so the votes stay where they are.
    index = F.broadcast(spark.createDataFrame([(a, i) for i, a in enumerate(annotators)], "judge string, j int"))
    coded = votes.join(index, "judge").select(*ITEM, (F.col("j") * CLASSES + F.col("score") - 1).cast("int").alias("code"))
    return coded.groupBy(*ITEM).agg(F.array_sort(F.collect_list("code")).alias("codes"))


def fit(votes: DataFrame, communities: int = 4, strength: float = 20.0, max_iterations: int = 30, tolerance: float = 1e-4) -> tuple[Model, DataFrame]:
    """The fitted model and the persisted vote lists it was fitted on.

    `strength` is the number of pseudo labels per true class with which a community holds its annotators.
    """
    names = votes.select("judge").distinct().limit(MAX_ANNOTATORS + 1).collect()
    if len(names) > MAX_ANNOTATORS:
        raise ValueError(f"more than {MAX_ANNOTATORS} annotators")
    annotators = sorted(r.judge for r in names)
    lists = _vote_lists(votes, annotators).persist(StorageLevel.MEMORY_AND_DISK)
    j = len(annotators)
    m = max(1, min(communities, j))
    # First posterior: every annotator is right with probability 0.6 and near misses are likelier than far ones.
    near = np.exp(-1.2 * np.abs(np.subtract.outer(np.arange(CLASSES), np.arange(CLASSES))))
    near /= near.sum(axis=1, keepdims=True)
    log_confusion = np.tile(np.log(near), (j, 1, 1))
    log_prior = np.full(CLASSES, -math.log(CLASSES))
    share = None
    counts, done = np.zeros((j, CLASSES, CLASSES)), 0
    for done in range(1, max_iterations + 1):  # noqa: B007
        if not j:
            break
        raw, totals = _expected_counts(lists, log_confusion.transpose(0, 2, 1).reshape(j * CLASSES, CLASSES), log_prior)
        counts = raw.reshape(j, CLASSES, CLASSES).transpose(0, 2, 1)  # annotator, true class, label
        if share is None:  # communities start as bands of equal size by the share of labels on the diagonal
            right = np.einsum("jkk->j", counts) / np.maximum(counts.sum(axis=(1, 2)), 1e-9)
            band = np.argsort(np.argsort(right, kind="stable"), kind="stable") * m // max(1, j)
            share = np.full((j, m), 0.1 / m)
            share[np.arange(j), band] += 0.9
        pooled = np.einsum("jm,jkl->mkl", share, counts) + near  # one pseudo label per class, nearer labels likelier
        mean = pooled / pooled.sum(axis=2, keepdims=True)
        weight = _digamma(1 + share.sum(axis=0)) - _digamma(m + j)
        prior = strength * mean  # communities x class x label
        evidence = np.zeros((j, m))
        for c in range(m):
            a = prior[c][None]
            evidence[:, c] = (_lgamma(a + counts).sum(axis=(1, 2)) - _lgamma(a).sum()) - (_lgamma(strength + counts.sum(axis=2)) - _lgamma(np.full(CLASSES, strength))).sum(axis=1)
        logit = evidence + weight
        share = np.exp(logit - logit.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        post = np.einsum("jm,mkl->jkl", share, prior) + counts
        new = _digamma(post) - _digamma(post.sum(axis=2, keepdims=True))
        log_prior = _digamma(1 + totals) - _digamma(CLASSES + totals.sum())
        change = np.abs(np.exp(new) - np.exp(log_confusion)).max()
        log_confusion = new
        if change < tolerance:
            break
    return Model(annotators, log_confusion, log_prior, counts, share.argmax(axis=1) if share is not None else np.zeros(0, int), done), lists


def consensus(lists: DataFrame, model: Model) -> DataFrame:
    """tool_uid, scenario, score, confidence, agreement, n_judges of every item.

    `agreement` is the share of pairs of judges with the same score (null for one judge); `confidence` the posterior of `score`.
    """
    by_code, log_prior = model.log_confusion.transpose(0, 2, 1).reshape(-1, CLASSES), model.log_prior

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            codes, offsets = _lists(b.column("codes"))
            p = _posteriors(codes, offsets, by_code, log_prior)
            n = np.diff(offsets)
            owner = np.repeat(np.arange(b.num_rows), n)
            same = np.zeros(b.num_rows)
            for k in range(CLASSES):
                c = np.bincount(owner, codes % CLASSES == k, minlength=b.num_rows)
                same += c * (c - 1)
            pairs = n * (n - 1)
            best = p.argmax(axis=1)
            yield pa.RecordBatch.from_arrays(
                [b.column("tool_uid"), b.column("scenario"), pa.array((best + 1).astype(np.int32)), pa.array(p[np.arange(len(p)), best]), pa.array(np.divide(same, pairs, out=np.zeros(len(n)), where=pairs > 0), mask=pairs == 0), pa.array(n.astype(np.int32))],
                names=["tool_uid", "scenario", "score", "confidence", "agreement", "n_judges"],
            )

    return lists.select(*ITEM, "codes").mapInArrow(run, "tool_uid string, scenario string, score int, confidence double, agreement double, n_judges int")


def annotator_reliability(spark: SparkSession, model: Model) -> DataFrame:
    """judge, n_votes, reliability (probability of the true score, classes weighted by their share), bias (mean label minus true score), community."""
    rows = []
    if model.annotators:
        p = np.exp(model.log_confusion)
        p /= p.sum(axis=2, keepdims=True)
        share = np.exp(model.log_prior) / np.exp(model.log_prior).sum()
        levels = np.arange(1, CLASSES + 1)
        right = np.einsum("jkk,k->j", p, share)
        bias = np.einsum("jkl,l,k->j", p, levels, share) - share @ levels
        votes = model.counts.sum(axis=(1, 2))
        rows = [(a, int(round(votes[i])), float(right[i]), float(bias[i]), int(model.community[i])) for i, a in enumerate(model.annotators)]
    return spark.createDataFrame(rows, "judge string, n_votes long, reliability double, bias double, community int")
