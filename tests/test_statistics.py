import itertools
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gaugeworks.operators import dedup, facts, judges, statistics, windows


def test_benjamini_hochberg_by_hand(spark):
    df = spark.createDataFrame([("f", 1, 0.01), ("f", 2, 0.04), ("f", 3, 0.03), ("f", 4, 0.20), ("f", 5, 0.50), ("f", 6, None)], "f string, i int, p double")
    got = {r.i: r.q for r in statistics.benjamini_hochberg(df, "p", ["f"], "q").collect()}
    assert [round(got[i], 4) for i in range(1, 6)] == [0.05, 0.0667, 0.0667, 0.25, 0.5] and got[6] is None


def ranks(xs):
    return [sum(y < x for y in xs) + (sum(y == x for y in xs) + 1) / 2 for x in xs]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-4, 4), min_size=1, max_size=30))
def test_signed_ranks_equal_brute_force(spark, diffs):
    df = spark.createDataFrame([("j", "c", float(d)) for d in diffs], "juiz string, componente string, diff double")
    real = [d for d in diffs if d]
    row = statistics.wilcoxon_by_component(df).collect()[0]
    assert row.n_pareado == len(diffs) and row.n_empates == len(diffs) - len(real) and row.n_efetivo_teste == len(real)
    if not real:
        assert row.estatistica_w is None and row.p_valor is None
        return
    rk = ranks([abs(d) for d in real])
    up, down = sum(r for r, d in zip(rk, real) if d > 0), sum(r for r, d in zip(rk, real) if d < 0)
    assert row.estatistica_w == min(up, down)
    n = len(real)
    ties = sum(t**3 - t for t in (sum(abs(x) == v for x in real) for v in {abs(x) for x in real}))
    var = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    z = (min(up, down) - n * (n + 1) / 4) / math.sqrt(var)
    exact = ties == 0 and len(real) == len(diffs)
    assert row.z == pytest.approx(z) and row.p_valor == pytest.approx(statistics.exact_p(n, min(up, down)) if exact else math.erfc(abs(z) / math.sqrt(2)))
    assert statistics.rank_biserial(df, ["juiz"]).collect()[0].r_rank_biserial == pytest.approx((up - down) / (up + down))


def test_spearman_and_degenerate_cases(spark):
    xs, ys = [1, 2, 2, 5, 9], [3, 1, 4, 4, 8]
    df = spark.createDataFrame([("g", float(x), float(y)) for x, y in zip(xs, ys)], "g string, x double, y double")
    rx, ry = ranks(xs), ranks(ys)
    mx, my = sum(rx) / 5, sum(ry) / 5
    want = sum((a - mx) * (b - my) for a, b in zip(rx, ry)) / math.sqrt(sum((a - mx) ** 2 for a in rx) * sum((b - my) ** 2 for b in ry))
    assert statistics.spearman(df, ["g"], "x", "y", "rho").collect()[0].rho == pytest.approx(want)
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert flat.agg(statistics.pearson(F.col("x"), F.col("y")).alias("r")).collect()[0].r is None
    assert flat.limit(0).agg(statistics.sample_stddev(F.col("x")).alias("s")).collect()[0].s is None


def test_kappas_by_hand(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (0, 1), (0, 0)], "a int, b int")
    assert df.agg(statistics.cohen_kappa(F.col("a"), F.col("b"), [0, 1]).alias("k")).collect()[0].k == pytest.approx(0.5)
    rows = [("g", i, l) for i, ls in enumerate([(0, 0), (1, 1), (0, 1), (1, 1)]) for l in ls]
    k = statistics.fleiss_kappa(spark.createDataFrame(rows, "g string, i int, l int"), ["g"], ["i"], "l").collect()[0]
    assert k.p_obs == pytest.approx(0.75) and k.p_exp == pytest.approx((3 / 8) ** 2 + (5 / 8) ** 2)


def long_frame(spark, rows):
    return spark.createDataFrame(rows, "tool_uid string, cenario string, juiz string, linguagem string, componente string, nota int")


def test_quartiles_equal_definition(spark):
    notes = [1, 1, 2, 3, 3, 3, 4, 5, 5, 5]
    df = long_frame(spark, [(f"t{i}", facts.WITH, "j", None, "purpose", n) for i, n in enumerate(notes)])
    got = {r.tool_uid: r.quartil for r in windows.score_quartiles(df).collect()}
    assert got == {f"t{i}": math.ceil(4 * r / len(notes)) for i, r in enumerate(ranks(notes))}


def test_consensus_is_division(spark):
    rows = []
    for t, j, (a, b) in itertools.chain([("x", "j1", (1, 2)), ("x", "j2", (5, 3)), ("y", "j1", (1, 1)), ("y", "j2", (1, 4)), ("z", "j1", (2, 5))]):
        rows += [(t, facts.WITHOUT, j, None, "purpose", a), (t, facts.WITH, j, None, "purpose", b)]
    got = judges.consensus_changes(facts.differences(long_frame(spark, rows))).collect()
    assert {(r.tool_uid, r.juiz, r.mesma_direcao) for r in got} == {("x", "j1", False), ("x", "j2", False)}


def test_upper_median(spark):
    df = long_frame(spark, [("t", facts.WITH, "j", None, "purpose", n) for n in (1, 2, 4, 5)])
    assert judges.component_histogram(df).collect()[0].mediana_superior == 4


def test_dedupe_candidates_order_and_null_id(spark):
    df = spark.createDataFrame([("a", 2, ["s2", "s1"]), ("a", 1, ["s1", "s3"]), (None, 3, ["x"]), ("b", 4, None)], "id string, seq long, matched_signals array<string>")
    got = {r.id: (r.seq, r.matched_signals) for r in dedup.dedupe_candidates(df).collect()}
    assert got == {"a": (1, ["s1", "s3", "s2"]), None: (3, ["x"]), "b": (4, [])}


def test_empty_fact_tables(spark):
    e = long_frame(spark, [])
    d = facts.differences(e)
    for df in (judges.score_summary(e), windows.quartile_migration(e), judges.judge_agreement(e), statistics.wilcoxon_by_component(d), judges.judge_statistics(d), judges.consensus_changes(d), windows.cut_point_transition(d)):
        assert df.collect() == []


def test_exact_p_equals_enumeration(spark):
    for n in (1, 3, 6):
        for w in range(n * (n + 1) // 2 + 1):
            hits = sum(sum(r for r, s in zip(range(1, n + 1), signs) if s) <= w for signs in itertools.product((0, 1), repeat=n))
            assert statistics.exact_p(n, w) == pytest.approx(min(1.0, 2 * hits / 2**n))
    df = spark.createDataFrame([("j", "c", float(d)) for d in (1, 2, 3, -4, 5)], "juiz string, componente string, diff double")
    assert statistics.wilcoxon_by_component(df).collect()[0].p_valor == pytest.approx(statistics.exact_p(5, 4))


def test_agreement_equals_brute_force(spark):
    """Common tools, consensus, correlations and kappas over three judges, one of whom misses a tool."""
    import random

    from gaugeworks.operators import judges

    rng = random.Random(2)
    rows = [(j, c, t, a := rng.randint(1, 5), b := rng.randint(1, 5), b - a) for t in range(30) for j in ("x", "y", "z") if (t, j) != (3, "z") for c in ("purpose", "examples")]
    df = spark.createDataFrame([(j, c, f"t{t}", float(a), float(b), float(d)) for j, c, t, a, b, d in rows], "juiz string, componente string, tool_uid string, sem double, com double, diff double")
    common = [r for r in rows if r[2] != 3]
    assert judges.common_tools(df).count() == len(common)
    by = {}
    for j, c, t, *_rest, d in common:
        by.setdefault((t, c), {})[j] = d
    full = {k for k, v in by.items() if all(v.values())}
    assert {(int(r.tool_uid[1:]), r.componente) for r in judges.consensus_subset(df).collect()} == full
    sign = lambda d: (d > 0) - (d < 0)
    table = {(r.componente, r.par): r for r in judges.agreement_table(df).collect()}
    assert len(table) == 3 * 4
    items = [{j: sign(d) for j, d in v.items()} for (t, c), v in by.items()]
    po = sum(i["x"] == i["y"] for i in items) / len(items)
    pe = sum(sum(i["x"] == k for i in items) * sum(i["y"] == k for i in items) for k in (-1, 0, 1)) / len(items) ** 2
    r = table["geral", "x x y"]
    assert r.n_itens == len(items) == 58 and abs(r.po - po) < 1e-12 and abs(r.pe - pe) < 1e-12 and abs(r.kappa - (po - pe) / (1 - pe)) < 1e-12
    counts = [[sum(v == k for v in i.values()) for k in (-1, 0, 1)] for i in items]
    fo = sum(sum(n * (n - 1) for n in c) / 6 for c in counts) / len(counts)
    fe = sum((sum(c[k] for c in counts) / (3 * len(counts))) ** 2 for k in range(3))
    r = table["geral", judges.ALL_JUDGES]
    assert abs(r.po - fo) < 1e-12 and abs(r.kappa - (fo - fe) / (1 - fe)) < 1e-12
    out = {(r.juiz_a, r.juiz_b): r for r in judges.consensus_correlation(judges.consensus_subset(df)).collect()}
    same = [(by[k]["x"] > 0) == (by[k]["y"] > 0) for k in full]
    assert out["x", "y"].n_pares == len(full) and abs(out["x", "y"].pct_mesmo_sentido - 100 * sum(same) / len(same)) < 1e-9
