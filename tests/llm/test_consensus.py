import datetime
import random

import numpy as np
import oracle

from gaugeworks.llm import consensus, queries

EVAL = "eval_id long, tool_uid string, scenario string, judge struct<id:string>, status string, scores struct<purpose:struct<score:int>>, ingested_at timestamp, score int, codes string"


def frame(spark, votes):
    at = datetime.datetime(2030, 1, 1)
    rows = []
    for i, v in enumerate(votes):
        tool, judge, score, status, day = (*v, "ok", 0)[:5] if len(v) == 3 else v
        rows.append((i, tool, "s", (judge,), status, ((score,),), at + datetime.timedelta(days=day), 9, "mine"))
    return spark.createDataFrame(rows, EVAL)


def simulate(n=400, seed=1):
    rng = random.Random(seed)
    truth, votes = {}, []
    for i in range(n):
        z = truth[f"t{i}"] = rng.choices([1, 2, 3, 4, 5], [7, 13, 22, 33, 25])[0]
        for j, kind in enumerate(["good", "good", "good", "harsh", "random", "constant", "fair"]):
            if rng.random() < 0.8:
                s = {"good": z if rng.random() < 0.8 else rng.randint(1, 5), "fair": z if rng.random() < 0.6 else rng.randint(1, 5), "harsh": max(1, z - (rng.random() < 0.7)), "random": rng.randint(1, 5), "constant": 4}[kind]
                votes.append((f"t{i}", f"{kind}{j}", s))
        if rng.random() < 0.1:
            votes.append((f"t{i}", "rare", z))
    return truth, votes


def run(spark, df):
    model, lists = consensus.fit(consensus.votes_of(df))
    return model, {r.tool_uid: r for r in consensus.consensus(lists, model).collect()}


def test_recovers_truth_better_than_majority(spark):
    truth, votes = simulate()
    model, got = run(spark, frame(spark, votes))
    right = np.mean([got[t].score == z for t, z in truth.items() if t in got])
    by = {}
    for t, _j, s in votes:
        by.setdefault(t, []).append(s)
    majority = np.mean([max(sorted(set(by[t])), key=by[t].count) == z for t, z in truth.items() if t in by])
    assert right > 0.9 and right > majority + 0.03
    rel = {r.judge: r for r in consensus.annotator_reliability(spark, model).collect()}
    assert rel["good0"].reliability > 0.75 > rel["random4"].reliability and rel["harsh3"].bias < -0.4
    assert rel["rare"].reliability > 0.4  # few labels: held near a community, not at chance


def test_posterior_equals_brute_force():
    rng = np.random.default_rng(0)
    by_code = np.log(rng.dirichlet(np.ones(5), 15))
    prior = np.log(rng.dirichlet(np.ones(5)))
    codes, offsets = np.array([0, 3, 7, 14]), np.array([0, 3, 4])
    p = consensus._posteriors(codes, offsets, by_code, prior)
    for i, (a, b) in enumerate(zip(offsets, offsets[1:])):
        raw = np.array([np.exp(prior[k]) * np.prod([np.exp(by_code[c, k]) for c in codes[a:b]]) for k in range(5)])
        assert np.allclose(p[i], raw / raw.sum())


def test_votes_dedupe_and_bad_rows(spark):
    df = frame(spark, [("t", "a", 1, "ok", 0), ("t", "a", 5, "ok", 3), ("t", "b", 9, "ok", 0), ("t", "c", None, "ok", 0), ("t", "d", 3, "error", 0), (None, "e", 3, "ok", 0), ("t", None, 3, "ok", 0), ("t", "a", 5, "ok", 3)])
    assert [(r.judge, r.score) for r in consensus.votes_of(df).collect()] == [("a", 5)]


def test_one_judge_and_empty(spark):
    model, got = run(spark, frame(spark, [("t", "a", 4)]))
    assert got["t"].n_judges == 1 and got["t"].agreement is None
    model, got = run(spark, frame(spark, []))
    assert got == {} and consensus.annotator_reliability(spark, model).collect() == []


def test_digamma():
    assert np.allclose(consensus._digamma(np.array([1.0, 0.5, 10.0])), [-0.5772156649, -1.9635100260, 2.2517525890])


def test_agreement_sql(spark, sf):
    assert oracle.differences(spark, oracle.connect(sf), queries.QUERIES["p1_agreement"], queries.ORACLE["p1_agreement"], sf) in ("", "close")


def test_found_columns(spark, sf):
    df = queries.QUERIES["p1_found"](spark, sf)
    assert df.columns == ["tool_uid", "scenario", "score"]
    assert all(1 <= r.score <= 5 for r in df.collect())
