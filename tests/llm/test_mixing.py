import random

from gaugeworks.llm import mixing as m

DOCS = "doc_id long, source string, text string, tokens string, copies string"


def frames(spark, docs, targets):
    return spark.createDataFrame([(i, s, t, "mine", "mine") for i, (s, t) in enumerate(docs)], DOCS), spark.createDataFrame(targets, "source_name string, target_share double, max_repeats int")


def sample(n=600, seed=1):
    rng = random.Random(seed)
    return [(rng.choices(["a", " B ", "c", None, "other"], [60, 20, 5, 5, 10])[0], " ".join(["word"] * rng.randint(1, 60))) for _ in range(n)]


def test_shares_caps_and_whole_report(spark):
    docs, targets = frames(spark, sample(), [("a", 0.3, 1), ("b", 0.4, 3), ("c", 0.2, 4), ("none", 0.1, 2)])
    selected, counts, _ = m.mix(docs, targets)
    rows = {r.source_name: r for r in m.share_report(selected, counts, targets).collect()}
    assert set(rows) == {"a", "b", "c", "none"} and rows["none"].actual_share == 0
    for s, want in (("a", 0.3 / 0.9), ("b", 0.4 / 0.9), ("c", 0.2 / 0.9)):
        assert abs(rows[s].actual_share - want) < 0.03 and rows[s].max_copies <= rows[s].max_repeats
    assert rows["c"].max_copies == 4  # the scarce source is repeated up to its cap
    assert selected.where("source_name in ('other') or source_name is null").count() == 0


def test_threshold_meets_tokens_to_one_document(spark):
    docs, targets = frames(spark, sample(2000, 2), [("a", 0.5, 1), ("b", 0.5, 1)])
    counts = m.token_counts(docs).cache()
    total = counts.where("source_name = 'a'").selectExpr("sum(tokens) s").collect()[0].s
    for part in (0.1, 0.5, 0.99):
        limit = m._thresholds(counts, {"a": total * part})["a"]
        got = counts.where((m._position() < limit) & (counts["source_name"] == "a")).selectExpr("coalesce(sum(tokens), 0) s").collect()[0].s
        assert abs(got - total * part) <= 60


def test_newton_solves_the_dual(spark):
    docs, targets = frames(spark, sample(300, 3), [("a", 0.1, 9), ("b", 0.2, 9), ("c", 0.7, 9)])
    counts = m.token_counts(docs).cache()
    rates, tokens = m.solve_rates(counts, {"a": (0.1, 9), "b": (0.2, 9), "c": (0.7, 9)})
    total = sum(rates[s] * tokens[s] for s in rates)
    for s, w in (("a", 0.1), ("b", 0.2), ("c", 0.7)):
        assert abs(rates[s] * tokens[s] / total - w) < 1e-9


def test_exact_token_counts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = ["hello world", "", None, "<|endoftext|> is text", "é" * 3000]
    docs, _ = frames(spark, [("a", t) for t in texts], [("a", 1.0, 1)])
    t = Tokenizer.from_file(str(public_tokenizers.path(m.VOCABULARY)))
    t.encode_special_tokens = True
    got = {r.doc_id: r.tokens for r in m.token_counts(docs).collect()}
    assert got == {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x in enumerate(texts)}


def test_ties_repeats_and_empty(spark):
    docs, targets = frames(spark, [("a", "x y")] * 7 + [("b", "x y")] * 3 + [("b", None), ("b", "")], [("a", 0.5, 1), ("b", 0.5, 2), (None, 0.1, 1)])
    selected, counts, _ = m.mix(docs, targets)
    assert selected.where("tokens = 0").count() == 0 and selected.where("source_name = 'b'").selectExpr("sum(copies) s").collect()[0].s == 6
    for d, t in ((docs.limit(0), targets), (docs, targets.limit(0)), (docs.where("text is null"), targets)):
        selected, counts, _ = m.mix(d, t)
        assert selected.collect() == []
        m.share_report(selected, counts, t).collect()


def test_same_on_every_run(spark):
    docs, targets = frames(spark, sample(200, 5), [("a", 0.5, 1), ("b", 0.5, 2)])
    one = sorted(tuple(r) for r in m.mix(docs, targets)[0].collect())
    assert one == sorted(tuple(r) for r in m.mix(docs.repartition(7), targets)[0].collect())
