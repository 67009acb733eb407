"""Aggregates, agreement and consensus of judges over the fact table.

Missing keys: languages that are null are left out of counts by language, but percentages divide by all rows. Empty
tables give empty results.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import statistics as st
from .facts import COMPONENTS, WITH, WITHOUT


def share(part: Column, whole: Column) -> Column:
    return F.try_divide(part * F.lit(100.0), whole)


def status_by_judge(current: DataFrame) -> DataFrame:
    """juiz, cenario, ok, refused, error, total (of the three) and the share of ok; null where the total is 0."""
    n = lambda s: F.count_if(F.col("status") == s)
    rows = current.groupBy(F.col("judge.id").alias("juiz"), F.col("scenario").alias("cenario")).agg(n("ok").alias("ok"), n("refused").alias("refused"), n("error").alias("error"))
    total = F.col("ok") + F.col("refused") + F.col("error")
    return rows.withColumn("total", total).withColumn("taxa_ok_percentual", share(F.col("ok"), F.col("total")))


def score_summary(long: DataFrame, keys: tuple[str, ...] = ("juiz", "cenario", "componente")) -> DataFrame:
    """Mean, median, standard deviation (n - 1) and count."""
    x = F.col("nota")
    return long.groupBy(*keys).agg(F.avg(x).alias("media"), F.median(x).alias("mediana"), st.sample_stddev(x).alias("desvio_padrao"), F.count(x).alias("n"))


def scenario_comparison(long: DataFrame) -> DataFrame:
    at = lambda c: F.avg(F.when(F.col("cenario") == c, F.col("nota")))
    means = long.groupBy("juiz", "componente").agg(at(WITHOUT).alias("media_description_only"), at(WITH).alias("media_with_source"))
    pairs = (
        long.groupBy("juiz", "componente", "tool_uid")
        .agg((F.count_if(F.col("cenario") == WITHOUT) > 0).alias("a"), (F.count_if(F.col("cenario") == WITH) > 0).alias("b"))
        .groupBy("juiz", "componente")
        .agg(F.count_if(F.col("a") & F.col("b")).alias("n_pareado"))
    )
    return means.join(pairs, ["juiz", "componente"]).select("juiz", "componente", "media_description_only", "media_with_source", (F.col("media_with_source") - F.col("media_description_only")).alias("delta_with_source_menos_description_only"), "n_pareado")


def coverage_by_tool(long: DataFrame) -> DataFrame:
    """tool_uid, juizes: the judges, in order, that scored the tool in both scenarios."""
    both = long.groupBy("tool_uid", "juiz").agg(F.count_if(F.col("cenario") == WITHOUT).alias("a"), F.count_if(F.col("cenario") == WITH).alias("b")).where("a > 0 and b > 0")
    return both.groupBy("tool_uid").agg(F.array_join(F.array_sort(F.collect_list("juiz")), ",").alias("juizes"), F.count(F.lit(1)).alias("n_juizes"))


def coverage_histogram(long: DataFrame) -> DataFrame:
    return coverage_by_tool(long).groupBy("n_juizes").agg(F.count(F.lit(1)).alias("n_tools"))


def consensus_changes(diffs: DataFrame) -> DataFrame:
    """Changed pairs of every tool and component whose every judge (two at least) changed: relational division."""
    both = diffs.groupBy("tool_uid", "componente").agg(F.count(F.lit(1)).alias("n_juizes"), F.bool_and(F.col("diff") != 0).alias("todos"), F.bool_and(F.col("diff") > 0).alias("up"), F.bool_and(F.col("diff") < 0).alias("down"))
    full = both.where("todos and n_juizes >= 2").select("tool_uid", "componente", "n_juizes", (F.col("up") | F.col("down")).alias("mesma_direcao"))
    return diffs.join(full, ["tool_uid", "componente"]).select("tool_uid", "componente", "juiz", F.col("diff").alias("diff_nota"), (F.col("diff") > 0).alias("subiu"), "n_juizes", "mesma_direcao")


def consensus_summary(changes: DataFrame) -> DataFrame:
    one = changes.select("tool_uid", "componente", "n_juizes", "mesma_direcao").distinct()
    return one.groupBy("componente").agg(F.count(F.lit(1)).alias("n_tools_consenso"), F.count_if("mesma_direcao").alias("n_tools_mesma_direcao"), F.avg("n_juizes").alias("media_juizes_por_consenso"))


def judge_agreement(long: DataFrame) -> DataFrame:
    """Pearson and mean absolute difference of each pair of judges over tool, scenario and component.

    The pairs of a cell come from its list of judges (one score each), so a cell gives judges choose two rows.
    """
    cells = long.groupBy("tool_uid", "cenario", "componente", "juiz").agg(F.avg("nota").alias("nota"))
    a, b = cells.select("tool_uid", "cenario", "componente", F.col("juiz").alias("juiz_a"), F.col("nota").alias("x")), cells.select("tool_uid", "cenario", "componente", F.col("juiz").alias("juiz_b"), F.col("nota").alias("y"))
    pairs = a.join(b, ["tool_uid", "cenario", "componente"]).where("juiz_a < juiz_b")
    return pairs.groupBy("juiz_a", "juiz_b").agg(F.count(F.lit(1)).alias("n_comparacoes"), st.pearson(F.col("x"), F.col("y")).alias("correlacao_pearson"), F.avg(F.abs(F.col("x") - F.col("y"))).alias("diferenca_media_absoluta"))


def latency_by_judge(current: DataFrame, by_scenario: bool = False) -> DataFrame:
    """Means of tokens and latency and the median latency of ok rows, per judge (and scenario)."""
    keys = [F.col("judge.id").alias("juiz"), *([F.col("scenario").alias("cenario")] if by_scenario else [])]
    ms = F.col("latency_ms").cast("decimal(20,3)")
    return current.where("status = 'ok'").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("avaliacoes"), F.avg("usage.input_tokens").alias("media_input_tokens"), F.avg("usage.output_tokens").alias("media_output_tokens"), F.avg("usage.cache_read_input_tokens").alias("media_cache_read_tokens"),
        F.try_divide(F.sum(ms).cast("double"), F.count(ms)).alias("media_latencia_ms"), F.median("latency_ms").alias("mediana_latencia_ms"),
    )


def median_effective_difference(diffs: DataFrame) -> DataFrame:
    return diffs.where("diff <> 0").groupBy("juiz", "componente").agg(F.median("diff").alias("mediana_diferenca_efetiva"))


def scores_by_language(long: DataFrame) -> DataFrame:
    return long.where("linguagem is not null").groupBy("linguagem").agg(F.avg("nota").alias("nota_media"), F.count(F.lit(1)).alias("n"))


def version_summary(evaluations: DataFrame) -> DataFrame:
    """Rows per prompt version and judge, with the active version marked."""
    from .dedup import version_of

    v = version_of(evaluations)
    last = evaluations.select(F.max(v).alias("v")).scalar()
    return evaluations.groupBy(v.alias("versao"), F.col("judge.id").alias("juiz")).agg(F.count(F.lit(1)).alias("n")).withColumn("ativa", F.col("versao") == last)


def five_numbers(long: DataFrame, keys: tuple[str, ...] = ("componente", "cenario")) -> DataFrame:
    """Box plot data: minimum, quartiles, maximum, mean and count."""
    p = F.percentile("nota", F.array(*(F.lit(q) for q in (0.0, 0.25, 0.5, 0.75, 1.0))))
    rows = long.groupBy(*keys).agg(p.alias("p"), F.avg("nota").alias("media"), F.count("nota").alias("n"))
    return rows.select(*keys, *(F.col("p")[i].alias(n) for i, n in enumerate(("minimo", "q1", "mediana", "q3", "maximo"))), "media", "n")


def tukey_outliers(long: DataFrame, keys: tuple[str, ...] = ("componente", "cenario")) -> DataFrame:
    """Rows beyond 1.5 interquartile ranges, counted per key and score."""
    box = five_numbers(long, keys).select(*keys, (F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).alias("lo"), (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("hi"))
    return long.join(box, list(keys)).where("nota < lo or nota > hi").groupBy(*keys, "nota").agg(F.count(F.lit(1)).alias("n"))


def tool_means(long: DataFrame) -> DataFrame:
    """Means of means: components within judge and scenario, judges within scenario, scenarios within tool."""
    a = long.groupBy("tool_uid", "cenario", "juiz").agg(F.avg("nota").alias("m"))
    b = a.groupBy("tool_uid", "cenario").agg(F.avg("m").alias("m"), F.count(F.lit(1)).alias("n_juizes"))
    return b.groupBy("tool_uid").agg(F.avg("m").alias("media_geral"), F.max(F.when(F.col("cenario") == WITHOUT, F.col("m"))).alias("media_description_only"), F.max(F.when(F.col("cenario") == WITH, F.col("m"))).alias("media_with_source"), F.max("n_juizes").alias("n_juizes"))


def dashboard_totals(current: DataFrame, low_n: int = 30) -> DataFrame:
    """Per judge: rows, ok, distinct tools, and whether there are few."""
    rows = current.groupBy(F.col("judge.id").alias("juiz")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "ok").alias("ok"), F.countDistinct("tool_key").alias("tools"))
    return rows.withColumn("n_baixo", F.col("ok") < low_n)


def component_histogram(long: DataFrame, keys: tuple[str, ...] = ("componente",)) -> DataFrame:
    """Count, mean, deviation, extremes, the upper median and the counts of scores 1..5.

    The upper median is the element at n // 2 of the sorted scores: a discrete percentile, never interpolated.
    """
    x = F.col("nota")
    ordered = long.groupBy(*keys, "nota").agg(F.count(F.lit(1)).alias("k"))
    from pyspark.sql import Window

    w = Window.partitionBy(*keys)
    upto = F.sum("k").over(w.orderBy("nota").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    upper = ordered.select(*keys, "nota", upto.alias("upto"), F.sum("k").over(w).alias("total")).where(F.col("upto") > F.floor(F.col("total") / 2)).groupBy(*keys).agg(F.min("nota").alias("mediana_superior"))
    rows = long.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("media"), st.sample_stddev(x).alias("desvio_padrao"), F.min(x).alias("minimo"), F.max(x).alias("maximo"), *(F.count_if(x == k).alias(f"n_{k}") for k in range(1, 6)))
    return rows.join(upper, list(keys))


def judge_statistics(diffs: DataFrame) -> DataFrame:
    """Means, delta, shares down, tied and up, number different, rank-biserial effect, Wilcoxon p and adjusted p per judge and component."""
    g = ["juiz", "componente"]
    n = F.count(F.lit(1))
    rows = diffs.groupBy(*g).agg(
        n.alias("n_pareado"), F.avg("sem").alias("media_sem_codigo"), F.avg("com").alias("media_com_codigo"), F.avg("diff").alias("delta"),
        share(F.count_if(F.col("diff") < 0), n).alias("pct_diminuiu"), share(F.count_if(F.col("diff") == 0), n).alias("pct_empatou"), share(F.count_if(F.col("diff") > 0), n).alias("pct_aumentou"), F.count_if(F.col("diff") != 0).alias("n_diferentes"),
    )
    tests = st.wilcoxon_by_component(diffs).select(*g, "p_valor", "p_valor_bh")
    return rows.join(st.rank_biserial(diffs, g), g).join(tests, g)


def study_judges(diffs: DataFrame, n: int = 3) -> DataFrame:
    """The pairs of the n judges with most complete pairs (names break ties): the judges of a comparison.

    They are checkpointed: a comparison reads these narrow rows many times, the evaluations once.
    """
    from ..session import ensure_checkpoint_dir

    ensure_checkpoint_dir(diffs.sparkSession)
    diffs = diffs.checkpoint()
    best = diffs.groupBy("juiz").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("k"), "juiz").limit(n)
    return diffs.join(best, "juiz", "left_semi").checkpoint()


def common_tools(diffs: DataFrame) -> DataFrame:
    """Pairs of the tools that every judge of the table has: division by the number of judges, tool by tool."""
    judges = diffs.select(F.countDistinct("juiz").alias("n")).scalar()
    full = diffs.groupBy("tool_uid").agg(F.countDistinct("juiz").alias("k")).where(F.col("k") == judges)
    return diffs.join(full, "tool_uid", "left_semi")


def mean_change_on_common_tools(diffs: DataFrame) -> DataFrame:
    return common_tools(diffs).groupBy("juiz").agg(*(F.avg(F.when(F.col("componente") == c, F.col("diff"))).alias(c) for c in COMPONENTS))


def mean_over_judges(diffs: DataFrame) -> DataFrame:
    return diffs.groupBy("componente", "tool_uid").agg(F.avg("sem").alias("sem_codigo"), F.avg("com").alias("com_codigo"), F.count(F.lit(1)).alias("n_juizes"))


def melt_means(means: DataFrame) -> DataFrame:
    return means.unpivot(["componente", "tool_uid"], ["sem_codigo", "com_codigo"], "condicao", "nota")


def judge_pairs(diffs: DataFrame) -> DataFrame:
    """Complete pairs side by side for each pair of judges."""
    a = diffs.select("tool_uid", "componente", F.col("juiz").alias("juiz_a"), F.col("sem").alias("sem_a"), F.col("com").alias("com_a"), F.col("diff").alias("diff_a"))
    b = diffs.select("tool_uid", "componente", F.col("juiz").alias("juiz_b"), F.col("sem").alias("sem_b"), F.col("com").alias("com_b"), F.col("diff").alias("diff_b"))
    return a.join(b, ["tool_uid", "componente"]).where("juiz_a < juiz_b")


#: The component that stands for all of them stacked, and the measures of a pair of judges.
OVERALL = "geral"
MEASURES = {"S": ("sem_a", "sem_b"), "C": ("com_a", "com_b"), "D": ("diff_a", "diff_b")}


def _with_overall(rows: DataFrame) -> DataFrame:
    """Each row once for its component and once for all components stacked."""
    return rows.withColumn("componente", F.explode(F.array("componente", F.lit(OVERALL))))


def _long_measures(pairs: DataFrame) -> DataFrame:
    cells = F.array(*(F.struct(F.lit(k).alias("medida"), F.col(a).alias("x"), F.col(b).alias("y")) for k, (a, b) in MEASURES.items()))
    return pairs.select("juiz_a", "juiz_b", "componente", "tool_uid", F.explode(cells).alias("c")).select("juiz_a", "juiz_b", "componente", "tool_uid", "c.*")


def judge_correlations(pairs: DataFrame) -> DataFrame:
    """juiz_a, juiz_b, medida (S, C, D), componente (and all stacked), n_tools, spearman; of pairs on common tools.

    All measures are ranked in one pass over the rows in long form.
    """
    g = ["juiz_a", "juiz_b", "medida", "componente"]
    tools = pairs.groupBy("juiz_a", "juiz_b").agg(F.countDistinct("tool_uid").alias("n_tools"))
    return st.spearman(_long_measures(_with_overall(pairs)), g, "x", "y", "spearman").join(tools, ["juiz_a", "juiz_b"])


def consensus_subset(diffs: DataFrame) -> DataFrame:
    """Pairs of the tools and components, on the common tools, whose score every judge changed."""
    sub = common_tools(diffs)
    judges = diffs.select(F.countDistinct("juiz").alias("n")).scalar()
    keys = sub.groupBy("tool_uid", "componente").agg(F.count_if(F.col("diff") != 0).alias("k")).where(F.col("k") == judges)
    return sub.join(keys, ["tool_uid", "componente"], "left_semi")


def consensus_correlation(consensus: DataFrame) -> DataFrame:
    """Per pair of judges over the consensus, components stacked: n_pares, n_tools, Spearman of S, C and D, share moved the same way."""
    pairs = judge_pairs(consensus)
    g = ["juiz_a", "juiz_b"]
    rho = st.spearman(_long_measures(pairs), [*g, "medida"], "x", "y", "rho").groupBy(*g).agg(*(F.max(F.when(F.col("medida") == k, F.col("rho"))).alias(f"rho_{k}") for k in MEASURES))
    n = F.count(F.lit(1))
    rows = pairs.groupBy(*g).agg(n.alias("n_pares"), F.countDistinct("tool_uid").alias("n_tools"), share(F.count_if((F.col("diff_a") > 0) == (F.col("diff_b") > 0)), n).alias("pct_mesmo_sentido"))
    return rows.join(rho, g)


#: The row of all judges together in the agreement table.
ALL_JUDGES = "todos (Fleiss)"


def agreement_table(diffs: DataFrame) -> DataFrame:
    """componente (and all stacked), par, n_itens, rho_S, rho_C, po, pe, kappa on the common tools; one row a pair, one for all judges."""
    sub = common_tools(diffs)
    pairs = _with_overall(judge_pairs(sub))
    g = ["juiz_a", "juiz_b", "componente"]
    labels = pairs.select(*g, F.signum("diff_a").alias("a"), F.signum("diff_b").alias("b"))
    a, b = F.col("a"), F.col("b")
    chance = sum((F.avg((a == c).cast("double")) * F.avg((b == c).cast("double")) for c in (-1.0, 0.0, 1.0)), F.lit(0.0))
    kappa = labels.groupBy(*g).agg(F.count(F.lit(1)).alias("n_itens"), F.avg((a == b).cast("double")).alias("po"), chance.alias("pe"))
    rho = st.spearman(_long_measures(pairs).where("medida <> 'D'"), [*g, "medida"], "x", "y", "rho").groupBy(*g).agg(*(F.max(F.when(F.col("medida") == k, F.col("rho"))).alias(f"rho_{k}") for k in ("S", "C")))
    one = kappa.join(rho, g).select("componente", F.concat_ws(" x ", "juiz_a", "juiz_b").alias("par"), "n_itens", "rho_S", "rho_C", "po", "pe", F.try_divide(F.col("po") - F.col("pe"), 1 - F.col("pe")).alias("kappa"))
    # An item of the overall row is a tool and a component, so the component stays part of the item. Fleiss' kappa is over
    # items that every judge scored; a null score leaves an item to the pairs that have it.
    judges = diffs.select(F.countDistinct("juiz").alias("n")).scalar()
    complete = sub.groupBy("tool_uid", "componente").agg(F.countDistinct("juiz").alias("k")).where(F.col("k") == judges)
    signs = sub.join(complete, ["tool_uid", "componente"], "left_semi").select(F.col("componente").alias("item_componente"), "tool_uid", F.signum("diff").alias("sinal"), F.explode(F.array("componente", F.lit(OVERALL))).alias("componente"))
    fleiss = st.fleiss_kappa(signs, ["componente"], ["tool_uid", "item_componente"], "sinal")
    items = signs.groupBy("componente").agg(F.countDistinct("tool_uid", "item_componente").alias("n_itens"))
    none = F.lit(None).cast("double")
    every = fleiss.join(items, "componente").select("componente", F.lit(ALL_JUDGES).alias("par"), "n_itens", none.alias("rho_S"), none.alias("rho_C"), F.col("p_obs").alias("po"), F.col("p_exp").alias("pe"), F.col("kappa_fleiss").alias("kappa"))
    return one.unionByName(every)


def grouped_summary(long: DataFrame) -> DataFrame:
    """Mean and count by judge, scenario, component, judge and scenario, and over all, in one grouping-sets pass ('*' for all)."""
    j, c, k = F.col("juiz"), F.col("cenario"), F.col("componente")
    rows = long.groupingSets([[j], [c], [k], [j, c], []], "juiz", "cenario", "componente").agg(F.avg("nota").alias("media"), F.count(F.lit(1)).alias("n"))
    return rows.select(*(F.coalesce(x, F.lit("*")).alias(x) for x in ("juiz", "cenario", "componente")), "media", "n")


def tools_by_mean(current: DataFrame) -> DataFrame:
    """All tools by mean score, highest first; tools without a score come last."""
    from .facts import scores_long

    tools = current.select(F.col("tool_key").alias("tool_uid")).distinct()
    means = scores_long(current).groupBy("tool_uid").agg(F.avg("nota").alias("m"))
    return tools.join(means, "tool_uid", "left").orderBy(F.desc_nulls_last("m"), "tool_uid")


def component_ranking(long: DataFrame) -> DataFrame:
    """Components by mean within each scenario; the window is over a handful of aggregated rows."""
    from pyspark.sql import Window

    means = long.groupBy("componente", "cenario").agg(F.avg("nota").alias("media"), F.count(F.lit(1)).alias("n"))
    return means.withColumn("posicao", F.rank().over(Window.partitionBy("cenario").orderBy(F.desc("media"), "componente")))


#: The slice of a breakdown that holds all judges.
EVERY_JUDGE = "todos"


def breakdown(long: DataFrame) -> DataFrame:
    """fatia (a judge, or all), componente, label, media, sd (0 for one score), n, the mean of each scenario, box plot data and, of single judges, the paired test.

    A paired test over several judges has no meaning, so the slice of all has none. All slices come from one pass.
    """
    rows = long.withColumn("fatia", F.explode(F.array("juiz", F.lit(EVERY_JUDGE))))
    g = ["fatia", "componente"]
    at = lambda c: F.avg(F.when(F.col("cenario") == c, F.col("nota")))
    means = rows.groupBy(*g).agg(F.avg("nota").alias("media"), F.coalesce(st.sample_stddev(F.col("nota")), F.lit(0.0)).alias("sd"), F.count("nota").alias("n"), at(WITHOUT).alias("media_description_only"), at(WITH).alias("media_with_source"))
    box = five_numbers(rows, ("fatia", "componente")).select(*g, "minimo", "q1", "mediana", "q3", "maximo")
    from .facts import differences

    tests = st.wilcoxon_by_component(differences(long)).select(F.col("juiz").alias("fatia"), "componente", "n_pareado", "proporcao_empates_percentual", "p_valor", "p_valor_bh", F.coalesce("`significativo_bh_0.05`", F.lit(False)).alias("significativo"))
    return labelled(means.join(box, g).join(tests, g, "left"))


def evaluations_of_consensus(current: DataFrame) -> DataFrame:
    """tool_uid, tool_name, avaliacoes of the tools of the consensus: per judge and scenario its provider and the scores of the components it changed.

    Judges with one scenario, or without a change, are left out. Lists are as long as a tool has judges.
    """
    from .facts import differences, scores_long

    d = differences(scores_long(current))
    tools = consensus_changes(d).select("tool_uid").distinct()
    changed = d.where("diff <> 0").groupBy("tool_uid", "juiz").agg(F.array_sort(F.collect_set("componente")).alias("mudaram"))
    own = current.where("status = 'ok'").select(F.col("tool_key").alias("tool_uid"), F.col("judge.id").alias("juiz"), F.col("judge.provider").alias("provider"), "scenario", F.col("tool.name").alias("tool_name"), "eval_id", F.struct(*(F.col(f"scores.{c}").alias(c) for c in COMPONENTS)).alias("s"))
    cells = F.create_map(*(x for c in COMPONENTS for x in (F.lit(c), F.struct(F.col(f"s.{c}.score").alias("score"), F.col(f"s.{c}.reasoning").alias("reasoning")))))
    rows = own.join(changed, ["tool_uid", "juiz"]).join(tools, "tool_uid", "left_semi")
    kept = rows.select("tool_uid", "tool_name", "eval_id", F.struct("juiz", "scenario", "provider", F.transform("mudaram", lambda c: F.struct(c.alias("componente"), F.element_at(cells, c)["score"].alias("score"), F.element_at(cells, c)["reasoning"].alias("reasoning"))).alias("scores")).alias("a"))
    return kept.groupBy("tool_uid").agg(F.min_by("tool_name", F.struct("a.juiz", "a.scenario", "eval_id")).alias("tool_name"), F.array_sort(F.collect_list("a")).alias("avaliacoes"))


def grouped_evaluations(current: DataFrame) -> DataFrame:
    """tool_key and its judges, for tools with more than one judge."""
    return current.groupBy("tool_key").agg(F.array_join(F.array_sort(F.collect_set("judge.id")), ",").alias("juizes"), F.countDistinct("judge.id").alias("n_juizes"), F.count(F.lit(1)).alias("n")).where("n_juizes > 1")


def changed_components(current: DataFrame) -> DataFrame:
    """Per tool and judge: the components whose score differs between the scenarios, and the sum of absolute differences (sorted by it by callers)."""
    from .facts import differences, scores_long

    d = differences(scores_long(current)).where("diff <> 0")
    return d.groupBy("tool_uid", "juiz").agg(F.array_join(F.array_sort(F.collect_set("componente")), ",").alias("componentes"), F.sum(F.abs("diff")).alias("diferenca_total"))


#: Reason categories and the substrings that name them.
REASONS = {
    "tool_sem_parametro": ["takes no input parameter", "accepts no input parameter", "no parameter roles to explain", "exposes no user-facing parameter", "no user-facing parameter", "vacuously satisfied", "empty input schema"],
    "omissao_parametros": ["parameter", "argument"],
    "omissao_funcionalidades": ["other supported", "additional mode", "also filters", "also performs", "also allows", "also supports", "also returns", "related tools such as", "differs from", "grouping semantics", "selection mode", "fuzzy", "side effect", "broader workflow", "versus other", "versus alternatives", "how this differs"],
    "omissao_saidas": ["return value", "return format", "return shape", "returned fields", "returned match", "what is returned", "no return value", "output schema", "returned format", "return structure", "what a returned", "what the returned", "result represents", "outcome beyond", "is returned", "are returned", "what fields", "returned list", "result shape", "returned user"],
    "omissao_limitacoes": ["error", "exception", "raise", "constraint", "edge case", "corner case", "fails to", "fail for", "failure mode", "may fail", "rate limit", "credential", "caveat", "required integration", "permission"],
    "contradicao": ["contradict", "inconsisten", "mismatch", "does not match", "does not align", "conflicts with", "diverges from", "misleading", "not implemented", "actually does", "actually performs", "the code reveals", "the implementation shows", "does not correspond"],
}
#: The second of these never stands beside the first.
REASON_EXCLUSION = ("tool_sem_parametro", "omissao_parametros")
NO_REASON = "sem_achado_no_codigo"


def reasons_of(text: Column) -> Column:
    """Categories whose substrings stand in the lower-case text; a fallback where there is none."""
    t = F.lower(F.coalesce(text, F.lit("")))
    hit = lambda k: F.exists(F.array(*(F.lit(w) for w in REASONS[k])), lambda w: t.contains(w))
    first, second = REASON_EXCLUSION
    found = F.array_compact(F.array(*(F.when(hit(k) & (~hit(first) if k == second else F.lit(True)), F.lit(k)) for k in REASONS)))
    return F.when(F.size(found) == 0, F.array(F.lit(NO_REASON))).otherwise(found)


def change_reasons(current: DataFrame) -> DataFrame:
    """juiz, componente, tool_uid, motivo, diff_nota, subiu: reasons of each untied pair from the reasoning with source."""
    from .facts import differences, scores_long

    texts = F.array(*(F.struct(F.lit(c).alias("componente"), F.col(f"scores.{c}.reasoning").alias("texto")) for c in COMPONENTS))
    reasoning = current.where((F.col("status") == "ok") & (F.col("scenario") == WITH)).select(F.col("judge.id").alias("juiz"), F.col("tool_key").alias("tool_uid"), F.explode(texts).alias("t")).select("juiz", "tool_uid", "t.componente", "t.texto")
    d = differences(scores_long(current)).where("diff <> 0")
    rows = d.join(reasoning, ["juiz", "componente", "tool_uid"], "left")
    return rows.select("juiz", "componente", "tool_uid", F.explode(reasons_of(F.col("texto"))).alias("motivo"), F.col("diff").alias("diff_nota"), (F.col("diff") > 0).alias("subiu"))


def reason_summary(reasons: DataFrame, keys: tuple[str, ...] = ("juiz", "componente", "motivo")) -> DataFrame:
    n = F.count(F.lit(1))
    return reasons.groupBy(*keys).agg(n.alias("ocorrencias"), F.count_if("subiu").alias("n_subiu"), F.count_if(~F.col("subiu")).alias("n_desceu"), share(F.count_if("subiu"), n).alias("pct_subiu"))


def top_divergences(migration: DataFrame, diffs: DataFrame, current: DataFrame) -> DataFrame:
    """All diverging pairs, largest quartile and score differences first, with the reasonings of both scenarios side by side."""
    g = ["juiz", "componente", "tool_uid"]
    rows = migration.where("diverge").join(diffs.select(*g, "diff"), g)
    texts = F.array(*(F.struct(F.lit(c).alias("componente"), F.col(f"scores.{c}.reasoning").alias("texto")) for c in COMPONENTS))
    own = current.where("status = 'ok'").select(F.col("judge.id").alias("juiz"), F.col("tool_key").alias("tool_uid"), "scenario", F.explode(texts).alias("t")).select("juiz", "tool_uid", "scenario", "t.*")
    side = lambda s: F.max(F.when(F.col("scenario") == s, F.col("texto")))
    both = own.join(rows.select(*g), g, "left_semi").groupBy(*g).agg(side(WITHOUT).alias("texto_sem"), side(WITH).alias("texto_com"))
    return rows.join(both, g, "left").select(*g, "diff_quartil", "diff", "texto_sem", "texto_com").orderBy(F.abs("diff_quartil").desc(), F.abs("diff").desc(), *g)


def nested_consensus(changes: DataFrame, metadata: DataFrame) -> DataFrame:
    """Per tool and component of the consensus: its judges as structs in order of name, the sum of absolute changes, and the tool's first-seen name (inner)."""
    per_judge = F.array_sort(F.collect_list(F.struct("juiz", "diff_nota", "subiu")))
    rows = changes.groupBy("tool_uid", "componente").agg(per_judge.alias("juizes"), F.count(F.lit(1)).alias("n_juizes"), F.sum(F.abs("diff_nota")).alias("soma_abs"))
    first = metadata.groupBy(F.col("tool_key").alias("tool_uid")).agg(F.min_by("tool.name", "eval_id").alias("nome"), F.min_by("repo.name_with_owner", "eval_id").alias("repositorio"))
    return rows.join(first, "tool_uid")


def scores_by_component(current: DataFrame) -> DataFrame:
    """eval_id and a map from component to score of every ok row."""
    cells = F.array(*(F.struct(F.lit(c), F.col(f"scores.{c}.score")) for c in COMPONENTS))
    return current.where("status = 'ok'").select("eval_id", F.map_from_entries(cells).alias("notas"))


#: Names of the components as reports show them.
COMPONENT_LABELS = {"purpose": "Purpose", "guidelines": "Guidelines", "limitations": "Limitations", "parameter_explanation": "Parameter Explanation", "length_completeness": "Length & Completeness", "examples": "Examples"}


def labelled(rows: DataFrame) -> DataFrame:
    """With the component's label; numbers that are not numbers become null."""
    label = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in COMPONENT_LABELS.items() for x in kv)), F.col("componente")), F.col("componente"))
    kinds = dict(rows.dtypes)
    return rows.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in rows.columns), label.alias("componente_label"))
