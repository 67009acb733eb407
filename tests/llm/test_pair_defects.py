import random

import pytest

from gaugeworks.llm import pair_defects as p
from gaugeworks.llm import pair_grammar as g
from gaugeworks.sources.tables import read_table

EVAL = "eval_id long, status string, scores struct<purpose:struct<reasoning:string>>, tool struct<description:string>, judge struct<id:string>, defect string, reasoning string"


@pytest.fixture(scope="module")
def fitted(spark):
    pairs = p.pairs_of(read_table(spark, "/root/testdata/sf0.01", "evaluations"))
    endings = p.count_endings(pairs)
    counts = p.Endings({r.key: (r.hits, r.uses) for r in endings.collect()})
    return p.fit_on(pairs, endings, 1200), counts, endings


def judge(fitted, rows):
    detector, counts, _ = fitted
    return detector.defects(rows, [counts.rates(r) for r, _ in rows])


D = "Copies one savings account and reports its opening balance. The audit step is honoured unless `dry_run` is set. Nothing is written while `offline` is true."


def test_kinds(fitted):
    cases = {
        "empty": [None, "", "  \n", "-", "\u200b", "{}", "no rationale given"],
        "copy": [D, '"' + D + '"', "Description: " + D, D.replace(". ", ".\n"), D[:110]],
        "refusal": ["I am afraid judging this tool is not something my policy lets me do.", "I AM SORRY, BUT I WON'T RATE `dry_run`.", "As an assistant I must refuse to score content of this kind."],
        "foreign": ["Der Zweck ist klar benannt, aber die Grenzen fehlen.", "目的が明確ではありません。", "La descripción no dice cuándo conviene usar la herramienta."],
        "truncated": ["The purpose is stated twice in different words, which is", "The description clearly states that the tool copies the savings account, so its pur", "Only the name hints at the purpose; the text..."],
        None: ["Purpose is clear and specific", "Well stated.", "The description clearly states that the tool copies the savings account, so its purpose is easy to grasp.", 'The phrase "unless `dry_run` is set" carries the aim.', "I cannot tell from the text when to call it, so the score is low."],
    }
    for want, texts in cases.items():
        assert judge(fitted, [(x, D) for x in texts]) == [want] * len(texts), want


def test_only_the_own_description_is_a_copy(fitted):
    assert judge(fitted, [("The description clearly states that the tool copies the savings account, so its purpose is easy to grasp.", None)]) == [None]
    assert judge(fitted, [(D, "Lists all savings plans of a given branch office, sorted by age and name.")]) != ["copy"]


def test_training_sentences_are_not_those_of_the_tables(spark):
    """No refusal of six words or more, and no foreign statement, that the grammar makes stands in the tables."""
    rng = random.Random(1)
    squash = lambda x: " ".join(p.words(x))
    made = {squash(g.expand(q, rng, ["zz_tool"], ["zz matter"])) for q in g.REFUSALS for _ in range(40)} | {squash(g.foreign(k, rng, ["zz_tool"])) for k in g.LANGUAGES if k not in ("zh", "ja", "th") for _ in range(40)}
    made = {m for m in made if len(m.split()) >= 6}
    text = "\n".join(squash(r.t or "") for r in read_table(spark, "/root/testdata/sf0.1", "evaluations").selectExpr("scores.purpose.reasoning as t").distinct().collect())
    assert len(made) > 900 and [m for m in made if m in text] == []


def test_table(spark, fitted):
    detector, _, endings = fitted
    j = ("a",)
    rows = [(1, "ok", ((None,),), (D,), j, "m", "m"), (2, "error", ((None,),), (D,), j, "m", "m"), (3, "ok", None, (None,), j, "m", "m"), (4, "ok", (("Well stated.",),), (None,), j, "m", "m"), (5, "ok", ((D,),), (D,), None, "m", "m"), (5, "ok", ((D,),), (D,), j, "m", "m"), (6, "ok", (("Clear purpose. " * 20_000,),), ("x " * 50_000,), j, "m", "m")]
    run = lambda rows: p.judge_pairs(p.pairs_of(spark.createDataFrame(rows, EVAL)), detector, endings)
    got = sorted((r.eval_id, r.defect or "") for r in run(rows).collect())
    assert got == [(1, "empty"), (3, "empty"), (4, ""), (5, "copy"), (5, "copy"), (6, "")]
    assert run([]).collect() == []
    assert p.found(spark.createDataFrame([], EVAL)).collect() == []


def test_endings_equal_one_pass(spark):
    texts = ["It is clear and specific", "One. Two words here.", None, "", "It is clear but", "It is clear and specific"]
    got = p.count_endings(spark.createDataFrame([(t,) for t in texts], "reasoning string").repartition(3))
    want: dict = {}
    for t in texts:
        p._count(t, want)
    assert {r.key: [r.hits, r.uses] for r in got.collect()} == want


def test_counts_beyond_32_bits(spark):
    big = spark.createDataFrame([(k, 3 << 31, 5 << 31) for k in p.end_keys("It is clear but")], "key long, hits long, uses long")
    rows = spark.createDataFrame([(1, "It is clear but", "d"), (1, "It is clear but", "d"), (2, "Done.", "d"), (3, None, "d")], "eval_id long, reasoning string, description string")
    got = sorted((r.eval_id, r.end_rate and round(r.end_rate, 3), r.bare_rate and round(r.bare_rate, 3)) for r in p.with_rates(rows, big).collect())
    assert got == [(1, 0.6, 0.6), (1, 0.6, 0.6), (2, None, None), (3, None, None)]


def test_cut_and_copied_rows(spark, fitted):
    """Responses that end in a stop, cut by a rule of their own: inside the last third, at a word or within one."""
    rng = random.Random(11)
    rows = [(r.reasoning, r.description) for r in p.pairs_of(read_table(spark, "/root/testdata/sf0.1", "evaluations")).where("pmod(hash(eval_id), 20) = 7").collect() if r.reasoning and r.reasoning.endswith(".") and len(r.reasoning) > 60 and r.description]
    cut = [(r[: rng.randrange(2 * len(r) // 3, len(r) - 6)].rstrip(" .,;"), d) for r, d in rows]
    copies = [(d, d) for _r, d in rows if len(d.split()) > 6]
    assert sum(x == "truncated" for x in judge(fitted, cut)) > 0.8 * len(cut)
    assert sum(x == "copy" for x in judge(fitted, copies)) > 0.95 * len(copies)
