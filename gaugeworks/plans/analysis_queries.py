"""Analysis queries over the evaluations table and their SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys
from ..operators import dedup, facts, judges, statistics, windows
from ..sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_KEY = "CASE WHEN tool.name IS NULL THEN tool_uid WHEN ends_with(tool_uid, '::' || tool.name) THEN tool_uid ELSE tool_uid || '::' || tool.name END"
_CELLS = ", ".join(f"{{'componente': '{c}', 'nota': scores.{c}.score}}" for c in facts.COMPONENTS)
BASE = f"""
WITH k AS (SELECT *, {_KEY} AS tool_key FROM evaluations),
ded AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tool_key, scenario, prompt_version, judge.id
          ORDER BY CASE WHEN status IN ('ok', 'refused') THEN 2 WHEN status = 'error' THEN 1 ELSE 0 END DESC, coalesce(evaluated_at, '') DESC, eval_id DESC) AS rn FROM k) WHERE rn = 1),
act AS (SELECT * FROM ded WHERE coalesce(prompt_version, '(sem versão)') = (SELECT max(coalesce(prompt_version, '(sem versão)')) FROM ded)),
cells AS (SELECT tool_key AS tool_uid, scenario AS cenario, judge.id AS juiz, repo.primary_language AS linguagem, unnest([{_CELLS}]) AS c FROM act WHERE status = 'ok'),
long AS (SELECT tool_uid, cenario, juiz, linguagem, c.componente AS componente, c.nota AS nota FROM cells WHERE c.nota IS NOT NULL),
pares AS (SELECT juiz, componente, tool_uid, avg(nota) FILTER (WHERE cenario = 'description_only') AS sem, avg(nota) FILTER (WHERE cenario = 'with_source') AS com FROM long GROUP BY ALL),
dif AS (SELECT *, com - sem AS diff FROM pares WHERE sem IS NOT NULL AND com IS NOT NULL),
sinal AS (SELECT juiz, componente, abs(diff) AS a, diff FROM dif WHERE diff <> 0),
tam AS (SELECT juiz, componente, a, count(*) AS t, count(*) FILTER (WHERE diff > 0) AS up FROM sinal GROUP BY ALL),
pos AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY juiz, componente ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2 AS r FROM tam),
soma AS (SELECT juiz, componente, sum(t)::BIGINT AS n_efetivo, sum(r * up) AS r_mais, sum(r * (t - up)) AS r_menos, sum((t * t * t - t)::DOUBLE) AS termo FROM pos GROUP BY ALL),
cont AS (SELECT juiz, componente, cenario, nota, count(*) AS k FROM long GROUP BY ALL),
faixa AS (SELECT juiz, componente, cenario, nota, least(greatest(ceil(4 * ((coalesce(sum(k) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (k + 1) / 2) / sum(k) OVER (PARTITION BY juiz, componente, cenario))), 1), 4)::INTEGER AS quartil
          FROM cont WINDOW w AS (PARTITION BY juiz, componente, cenario ORDER BY nota)),
mig0 AS (SELECT juiz, componente, tool_uid, avg(quartil) FILTER (WHERE cenario = 'description_only') AS quartil_description_only, avg(quartil) FILTER (WHERE cenario = 'with_source') AS quartil_with_source,
          avg(nota) FILTER (WHERE cenario = 'description_only') AS sem, avg(nota) FILTER (WHERE cenario = 'with_source') AS com FROM long JOIN faixa USING (juiz, componente, cenario, nota) GROUP BY ALL),
mig AS (SELECT juiz, componente, tool_uid, quartil_description_only, quartil_with_source, quartil_with_source - quartil_description_only AS diff_quartil, sem = com AS empate,
          sem <> com AND abs(quartil_with_source - quartil_description_only) >= 2 AS diverge FROM mig0 WHERE sem IS NOT NULL AND com IS NOT NULL),
div AS (SELECT tool_uid, componente, count(*) AS n_juizes, bool_and(diff <> 0) AS todos, bool_and(diff > 0) OR bool_and(diff < 0) AS mesma FROM dif GROUP BY ALL),
cons AS (SELECT tool_uid, componente, juiz, diff AS diff_nota, diff > 0 AS subiu, n_juizes, mesma AS mesma_direcao FROM dif JOIN div USING (tool_uid, componente) WHERE todos AND n_juizes >= 2),
est AS (SELECT * FROM dif SEMI JOIN (SELECT juiz FROM dif GROUP BY juiz ORDER BY count(*) DESC, juiz LIMIT 3) t USING (juiz)),
com AS (SELECT * FROM est SEMI JOIN (SELECT tool_uid FROM est GROUP BY tool_uid HAVING count(DISTINCT juiz) = (SELECT count(DISTINCT juiz) FROM est)) t USING (tool_uid)),
unan AS (SELECT * FROM com SEMI JOIN (SELECT tool_uid, componente FROM com WHERE diff <> 0 GROUP BY ALL HAVING count(DISTINCT juiz) = (SELECT count(DISTINCT juiz) FROM est)) t USING (tool_uid, componente)),
jp AS (SELECT a.tool_uid, a.componente, a.juiz AS juiz_a, b.juiz AS juiz_b, a.sem AS sem_a, b.sem AS sem_b, a.com AS com_a, b.com AS com_b, a.diff AS diff_a, b.diff AS diff_b FROM dif a JOIN dif b USING (tool_uid, componente) WHERE a.juiz < b.juiz)
"""
_STD = "CASE WHEN count(nota) > 1 THEN sqrt(greatest((count(nota) * sum((nota * nota)::DOUBLE) - sum(nota::DOUBLE) * sum(nota::DOUBLE)) / nullif(count(nota) * (count(nota) - 1), 0), 0.0)) END"


def _pearson(x: str, y: str) -> str:
    n, sx, sy = f"count({x})", f"sum({x}::DOUBLE)", f"sum({y}::DOUBLE)"
    return f"({n} * sum({x}::DOUBLE * {y}) - {sx} * {sy}) / nullif(sqrt(greatest({n} * sum({x}::DOUBLE * {x}) - {sx} * {sx}, 0.0) * greatest({n} * sum({y}::DOUBLE * {y}) - {sy} * {sy}, 0.0)), 0)"


def _current(spark: SparkSession, d: str) -> DataFrame:
    return facts.current_evaluations(read_table(spark, d, "evaluations"))


def _long(spark: SparkSession, d: str) -> DataFrame:
    return facts.scores_long(_current(spark, d))


def _diffs(spark: SparkSession, d: str) -> DataFrame:
    return facts.differences(_long(spark, d))


def _study(spark: SparkSession, d: str) -> DataFrame:
    return judges.study_judges(_diffs(spark, d))


_LABEL = "CASE ft.componente WHEN 'length_completeness' THEN 'Length & Completeness' WHEN 'parameter_explanation' THEN 'Parameter Explanation' ELSE upper(ft.componente[1]) || ft.componente[2:] END"


def _query(name: str, sql: str | None = None):
    """Registers a query with its SQL after the common table expressions."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = BASE + sql
        return f

    return add


_query("ded02_dedupe_evaluations", "SELECT eval_id, tool_key, scenario, prompt_version, judge.id AS judge_id, status FROM ded")(
    lambda s, d: dedup.dedupe_evaluations(read_table(s, d, "evaluations")).select("eval_id", "tool_key", "scenario", "prompt_version", F.col("judge.id").alias("judge_id"), "status")
)
_query(
    "ded03_repair_evaluations",
    """, nm AS (SELECT tool_uid, min(tool.name) <> max(tool.name) AS shared FROM evaluations GROUP BY ALL),
    rp AS (SELECT e.eval_id, e.scenario, e.judge.id AS judge_id, e.evaluated_at, CASE WHEN shared THEN concat_ws('::', e.tool_uid, e.tool.name) ELSE e.tool_uid END AS tool_uid FROM evaluations e LEFT JOIN nm ON e.tool_uid = nm.tool_uid)
    SELECT eval_id, tool_uid, scenario, judge_id FROM (SELECT *, row_number() OVER (PARTITION BY tool_uid, scenario, judge_id ORDER BY coalesce(evaluated_at, ''), eval_id) AS n FROM rp) WHERE n = 1""",
)(lambda s, d: dedup.repair_evaluations(read_table(s, d, "evaluations")).select("eval_id", "tool_uid", "scenario", F.col("judge.id").alias("judge_id")))
_query("ded04_rebuild_checkpoint", "SELECT tool_uid, scenario, judge.id AS judge, arg_max(status, eval_id) AS status FROM evaluations GROUP BY ALL")(lambda s, d: dedup.rebuild_checkpoint(read_table(s, d, "evaluations")))
_query("flt03_excluded_judges", "SELECT judge.id AS juiz, count(*) AS n FROM evaluations WHERE judge.id NOT IN (SELECT judge_id FROM judges WHERE NOT enabled) GROUP BY ALL")(
    lambda s, d: read_table(s, d, "evaluations").select(F.col("judge.id").alias("juiz")).join(read_table(s, d, "judges").where("not enabled").select(F.col("judge_id").alias("juiz")), "juiz", "left_anti").groupBy("juiz").agg(F.count(F.lit(1)).alias("n"))
)
_query("flt08_active_version", "SELECT eval_id, prompt_version FROM act")(lambda s, d: _current(s, d).select("eval_id", "prompt_version"))
_query("flt09_purge_version", "SELECT coalesce(prompt_version, '-') AS v, count(*) AS n FROM evaluations WHERE prompt_version IS DISTINCT FROM 'v3' GROUP BY ALL")(
    lambda s, d: dedup.purge_version(read_table(s, d, "evaluations"), "v3").groupBy(F.coalesce("prompt_version", F.lit("-")).alias("v")).agg(F.count(F.lit(1)).alias("n"))
)
_query("flt12_changed_components", "SELECT tool_uid, juiz, string_agg(componente, ',' ORDER BY componente) AS componentes, sum(abs(diff)) AS diferenca_total FROM dif WHERE diff <> 0 GROUP BY ALL")(lambda s, d: judges.changed_components(_current(s, d)))
_query("flt16_tools_by_total_difference", "SELECT tool_uid, count(DISTINCT juiz) AS n_juizes, sum(abs(diff)) AS total FROM dif WHERE diff <> 0 GROUP BY ALL")(
    lambda s, d: _diffs(s, d).where("diff <> 0").groupBy("tool_uid").agg(F.countDistinct("juiz").alias("n_juizes"), F.sum(F.abs("diff")).alias("total"))
)
_query("flt18_scores_of_one_judge", "SELECT tool_uid, componente, cenario, nota FROM long WHERE juiz = (SELECT min(juiz) FROM long)")(
    lambda s, d: (lambda x: x.where(F.col("juiz") == x.select(F.min("juiz").alias("j")).scalar()).select("tool_uid", "componente", "cenario", "nota"))(_long(s, d))
)
_query("flt19_scores_long", "SELECT tool_uid, cenario, juiz, linguagem, componente, nota FROM long")(_long)
_query("jn01_paired_scores", "SELECT juiz, componente, tool_uid, sem, com FROM pares")(lambda s, d: facts.paired(_long(s, d)))
_query("jn02_complete_pairs", "SELECT juiz, componente, tool_uid, sem, com, diff FROM dif")(_diffs)
_query("jn11_common_tools", "SELECT juiz, componente, tool_uid FROM com")(lambda s, d: judges.common_tools(_study(s, d)).select("juiz", "componente", "tool_uid"))
_query("jn13_consensus_changes", "SELECT tool_uid, componente, juiz, diff_nota, subiu, n_juizes, mesma_direcao FROM cons")(lambda s, d: judges.consensus_changes(_diffs(s, d)))
_query("jn14_consensus_subset", "SELECT juiz, componente, tool_uid, diff FROM unan")(lambda s, d: judges.consensus_subset(_study(s, d)).select("juiz", "componente", "tool_uid", "diff"))
_query("jn15_judge_pairs", "SELECT juiz_a, juiz_b, count(*) AS n FROM jp GROUP BY ALL")(lambda s, d: judges.judge_pairs(_diffs(s, d)).groupBy("juiz_a", "juiz_b").agg(F.count(F.lit(1)).alias("n")))


#: Written out apart from the operator: the six categories as alternations.
_REASON_SQL = {
    "tool_sem_parametro": "(takes|accepts) no input parameter|no parameter roles to explain|(exposes )?no user-facing parameter|vacuously satisfied|empty input schema",
    "omissao_parametros": "parameter|argument",
    "omissao_funcionalidades": "other supported|additional mode|also (filters|performs|allows|supports|returns)|related tools such as|differs from|grouping semantics|selection mode|fuzzy|side effect|broader workflow|versus (other|alternatives)|how this differs",
    "omissao_saidas": "return (value|format|shape|structure)|returned (fields|match|format|list|user)|what is returned|no return value|output schema|what (a|the) returned|result (represents|shape)|outcome beyond|(is|are) returned|what fields",
    "omissao_limitacoes": "error|exception|raise|constraint|(edge|corner) case|fails to|fail for|failure mode|may fail|rate limit|credential|caveat|required integration|permission",
    "contradicao": "contradict|inconsisten|mismatch|does not (match|align|correspond)|conflicts with|diverges from|misleading|not implemented|actually (does|performs)|the code reveals|the implementation shows",
}


def _reason_sql() -> str:
    def hit(k: str) -> str:
        own = f"regexp_matches(t, '{_REASON_SQL[k]}')"
        return own + f" AND NOT regexp_matches(t, '{_REASON_SQL['tool_sem_parametro']}')" if k == "omissao_parametros" else own

    listed = ", ".join(f"CASE WHEN {hit(k)} THEN '{k}' END" for k in _REASON_SQL)
    texts = ", ".join(f"{{'componente': '{c}', 'texto': scores.{c}.reasoning}}" for c in facts.COMPONENTS)
    return f""", tx AS (SELECT judge.id AS juiz, tool_key AS tool_uid, unnest([{texts}]) AS t FROM act WHERE status = 'ok' AND scenario = 'with_source'),
    jt AS (SELECT d.juiz, d.componente, d.tool_uid, d.diff, lower(coalesce(x.t.texto, '')) AS t FROM dif d LEFT JOIN tx x ON d.juiz = x.juiz AND d.tool_uid = x.tool_uid AND d.componente = x.t.componente WHERE d.diff <> 0),
    ct AS (SELECT *, list_filter([{listed}], lambda x: x IS NOT NULL) AS achados FROM jt),
    mot AS (SELECT juiz, componente, tool_uid, unnest(CASE WHEN len(achados) = 0 THEN ['sem_achado_no_codigo'] ELSE achados END) AS motivo, diff AS diff_nota, diff > 0 AS subiu FROM ct)"""


_query("jn16_jn18_change_reasons", _reason_sql() + "SELECT juiz, componente, tool_uid, motivo, diff_nota, subiu FROM mot")(lambda s, d: judges.change_reasons(_current(s, d)))
_SUM = "count(*) AS ocorrencias, count(*) FILTER (WHERE subiu) AS n_subiu, count(*) FILTER (WHERE NOT subiu) AS n_desceu, count(*) FILTER (WHERE subiu) * 100.0::DOUBLE / count(*) AS pct_subiu"
_query("agg25_reason_summary", _reason_sql() + f"SELECT juiz, componente, motivo, {_SUM} FROM mot GROUP BY ALL")(lambda s, d: judges.reason_summary(judges.change_reasons(_current(s, d))))
_query("agg35_reasons_over_judges", _reason_sql() + f"SELECT componente, motivo, {_SUM} FROM mot GROUP BY ALL")(lambda s, d: judges.reason_summary(judges.change_reasons(_current(s, d)), ("componente", "motivo")))
_query("jn23_tools_of_several_judges", "SELECT tool_key, string_agg(DISTINCT judge.id, ',' ORDER BY judge.id) AS juizes, count(DISTINCT judge.id) AS n_juizes, count(*) AS n FROM act GROUP BY ALL HAVING count(DISTINCT judge.id) > 1")(lambda s, d: judges.grouped_evaluations(_current(s, d)))
_query(
    "jn27_top_divergences",
    f""", tx AS (SELECT judge.id AS juiz, tool_key AS tool_uid, scenario, unnest([{", ".join(f"{{'componente': '{c}', 'texto': scores.{c}.reasoning}}" for c in facts.COMPONENTS)}]) AS t FROM act WHERE status = 'ok'),
    ts AS (SELECT juiz, tool_uid, t.componente AS componente, max(t.texto) FILTER (WHERE scenario = 'description_only') AS texto_sem, max(t.texto) FILTER (WHERE scenario = 'with_source') AS texto_com FROM tx GROUP BY ALL)
    SELECT juiz, componente, tool_uid, diff_quartil, diff, texto_sem, texto_com FROM mig JOIN dif USING (juiz, componente, tool_uid) LEFT JOIN ts USING (juiz, componente, tool_uid) WHERE diverge""",
)(lambda s, d: (lambda cur: (lambda x: judges.top_divergences(windows.quartile_migration(x), facts.differences(x), cur))(facts.scores_long(cur)))(_current(s, d)))
_query(
    "jn28_nested_consensus",
    """, u AS (SELECT tool_uid, componente, n_juizes, soma_abs, nome, repositorio, j.juiz AS juiz, j.diff_nota AS diff_nota, j.subiu AS subiu FROM
    (SELECT c.*, m.nome, m.repositorio, unnest(c.juizes) AS j FROM (SELECT tool_uid, componente, list({'juiz': juiz, 'diff_nota': diff_nota, 'subiu': subiu} ORDER BY juiz) AS juizes, count(*) AS n_juizes, sum(abs(diff_nota)) AS soma_abs FROM cons GROUP BY ALL) c
    JOIN (SELECT tool_key AS tool_uid, arg_min(tool.name, eval_id) AS nome, arg_min(repo.name_with_owner, eval_id) AS repositorio FROM act GROUP BY ALL) m USING (tool_uid))) SELECT * FROM u""",
)(lambda s, d: (lambda cur: judges.nested_consensus(judges.consensus_changes(facts.differences(facts.scores_long(cur))), cur))(_current(s, d)).select("tool_uid", "componente", "n_juizes", "soma_abs", "nome", "repositorio", F.explode("juizes").alias("j")).select("tool_uid", "componente", "n_juizes", "soma_abs", "nome", "repositorio", "j.*"))
_query(
    "agg17_status_por_juiz",
    """SELECT *, ok * 100.0::DOUBLE / nullif(total, 0) AS taxa_ok_percentual FROM (SELECT judge.id AS juiz, scenario AS cenario, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'refused') AS refused,
    count(*) FILTER (WHERE status = 'error') AS error, count(*) FILTER (WHERE status IN ('ok', 'refused', 'error')) AS total FROM act GROUP BY ALL)""",
)(lambda s, d: judges.status_by_judge(_current(s, d)))
_query("agg18_notas_por_componente", f"SELECT juiz, cenario, componente, avg(nota) AS media, median(nota)::DOUBLE AS mediana, {_STD} AS desvio_padrao, count(nota) AS n FROM long GROUP BY ALL")(lambda s, d: judges.score_summary(_long(s, d)))
_query(
    "agg19_comparacao_cenarios",
    """SELECT a.juiz, a.componente, a.media_description_only, a.media_with_source, a.media_with_source - a.media_description_only AS delta_with_source_menos_description_only, b.n_pareado FROM
    (SELECT juiz, componente, avg(nota) FILTER (WHERE cenario = 'description_only') AS media_description_only, avg(nota) FILTER (WHERE cenario = 'with_source') AS media_with_source FROM long GROUP BY ALL) a
    JOIN (SELECT juiz, componente, count(*) FILTER (WHERE sem IS NOT NULL AND com IS NOT NULL) AS n_pareado FROM pares GROUP BY ALL) b USING (juiz, componente)""",
)(lambda s, d: judges.scenario_comparison(_long(s, d)))
_query(
    "agg20_migracao_resumo",
    """SELECT juiz, componente, count(*) AS n_pares, count(*) FILTER (WHERE empate) AS n_empates, count(*) FILTER (WHERE NOT empate AND abs(diff_quartil) = 1) AS n_migrou_1_faixa, count(*) FILTER (WHERE diverge) AS n_diverge,
    count(*) FILTER (WHERE diverge AND diff_quartil > 0) AS n_diverge_subiu, count(*) FILTER (WHERE diverge AND diff_quartil < 0) AS n_diverge_desceu FROM mig GROUP BY ALL""",
)(lambda s, d: windows.migration_summary(windows.quartile_migration(_long(s, d))))
_query("agg21_divergencias_resumo", "SELECT juiz, componente, count(*) AS n_diverge, count(*) FILTER (WHERE diff > 0) AS n_diverge_subiu, count(*) FILTER (WHERE diff < 0) AS n_diverge_desceu FROM dif WHERE diff <> 0 GROUP BY ALL")(lambda s, d: windows.divergence_summary(windows.untied_divergences(_diffs(s, d))))
_COV = "SELECT tool_uid, string_agg(juiz, ',' ORDER BY juiz) AS juizes, count(*) AS n_juizes FROM (SELECT tool_uid, juiz FROM long GROUP BY ALL HAVING bool_or(cenario = 'description_only') AND bool_or(cenario = 'with_source')) GROUP BY ALL"
_query("agg22_cobertura_por_tool", _COV)(lambda s, d: judges.coverage_by_tool(_long(s, d)))
_query("agg23_cobertura_histograma", f"SELECT n_juizes, count(*) AS n_tools FROM ({_COV}) GROUP BY ALL")(lambda s, d: judges.coverage_histogram(_long(s, d)))
_query("agg24_consenso_resumo", "SELECT componente, count(*) AS n_tools_consenso, count(*) FILTER (WHERE mesma) AS n_tools_mesma_direcao, avg(n_juizes) AS media_juizes_por_consenso FROM div WHERE todos AND n_juizes >= 2 GROUP BY ALL")(lambda s, d: judges.consensus_summary(judges.consensus_changes(_diffs(s, d))))
_query(
    "agg26_concordancia",
    f""", ce AS (SELECT tool_uid, cenario, componente, juiz, avg(nota) AS nota FROM long GROUP BY ALL), pr AS (SELECT a.juiz AS juiz_a, b.juiz AS juiz_b, a.nota AS x, b.nota AS y FROM ce a JOIN ce b USING (tool_uid, cenario, componente) WHERE a.juiz < b.juiz)
    SELECT juiz_a, juiz_b, count(*) AS n_comparacoes, {_pearson("x", "y")} AS correlacao_pearson, avg(abs(x - y)) AS diferenca_media_absoluta FROM pr GROUP BY ALL""",
)(lambda s, d: judges.judge_agreement(_long(s, d)))
_LAT = """count(*) AS avaliacoes, avg(usage.input_tokens) AS media_input_tokens, avg(usage.output_tokens) AS media_output_tokens, avg(usage.cache_read_input_tokens) AS media_cache_read_tokens,
    sum(latency_ms::DECIMAL(20, 3))::DOUBLE / nullif(count(latency_ms), 0) AS media_latencia_ms, median(latency_ms) AS mediana_latencia_ms FROM act WHERE status = 'ok' GROUP BY ALL"""
_query("agg28_latencia_por_juiz", f"SELECT judge.id AS juiz, {_LAT}")(lambda s, d: judges.latency_by_judge(_current(s, d)))
_query("agg29_latencia_por_juiz_e_cenario", f"SELECT judge.id AS juiz, scenario AS cenario, {_LAT}")(lambda s, d: judges.latency_by_judge(_current(s, d), True))
_query("agg30_mediana_efetiva", "SELECT juiz, componente, median(diff) AS mediana_diferenca_efetiva FROM dif WHERE diff <> 0 GROUP BY ALL")(lambda s, d: judges.median_effective_difference(_diffs(s, d)))
_query("agg31_notas_por_linguagem", "SELECT linguagem, avg(nota) AS nota_media, count(*) AS n FROM long WHERE linguagem IS NOT NULL GROUP BY ALL")(lambda s, d: judges.scores_by_language(_long(s, d)))
_query("agg33_versoes", "SELECT coalesce(prompt_version, '(sem versão)') AS versao, judge.id AS juiz, count(*) AS n, coalesce(prompt_version, '(sem versão)') = (SELECT max(coalesce(prompt_version, '(sem versão)')) FROM evaluations) AS ativa FROM evaluations GROUP BY ALL")(lambda s, d: judges.version_summary(read_table(s, d, "evaluations")))
_BOX = "SELECT componente, cenario, min(nota)::DOUBLE AS minimo, quantile_cont(nota, 0.25)::DOUBLE AS q1, quantile_cont(nota, 0.5)::DOUBLE AS mediana, quantile_cont(nota, 0.75)::DOUBLE AS q3, max(nota)::DOUBLE AS maximo, avg(nota) AS media, count(nota) AS n FROM long GROUP BY ALL"
_query("agg34_boxplot", _BOX)(lambda s, d: judges.five_numbers(_long(s, d)))
_query("snk13_outliers", f", bx AS ({_BOX}) SELECT l.componente, l.cenario, l.nota, count(*) AS n FROM long l JOIN bx USING (componente, cenario) WHERE l.nota < q1 - 1.5 * (q3 - q1) OR l.nota > q3 + 1.5 * (q3 - q1) GROUP BY ALL")(lambda s, d: judges.tukey_outliers(_long(s, d)))
_query(
    "agg36_medias_por_tool",
    """, a AS (SELECT tool_uid, cenario, juiz, avg(nota) AS m FROM long GROUP BY ALL), b AS (SELECT tool_uid, cenario, avg(m) AS m, count(*) AS n_juizes FROM a GROUP BY ALL)
    SELECT tool_uid, round(avg(m), 9) AS media_geral, round(max(m) FILTER (WHERE cenario = 'description_only'), 9) AS media_description_only, round(max(m) FILTER (WHERE cenario = 'with_source'), 9) AS media_with_source, max(n_juizes) AS n_juizes FROM b GROUP BY ALL""",
)(lambda s, d: judges.tool_means(_long(s, d)).select("tool_uid", *(F.round(c, 9).alias(c) for c in ("media_geral", "media_description_only", "media_with_source")), "n_juizes"))
_query("agg37_totais", "SELECT judge.id AS juiz, count(*) AS total, count(*) FILTER (WHERE status = 'ok') AS ok, count(DISTINCT tool_key) AS tools, count(*) FILTER (WHERE status = 'ok') < 30 AS n_baixo FROM act GROUP BY ALL")(lambda s, d: judges.dashboard_totals(_current(s, d)))


def _hist(keys: str) -> str:
    return f"""SELECT {keys}, count(nota) AS n, avg(nota) AS media, {_STD} AS desvio_padrao, min(nota) AS minimo, max(nota) AS maximo, {", ".join(f"count(*) FILTER (WHERE nota = {k}) AS n_{k}" for k in range(1, 6))},
    list_sort(list(nota))[(count(nota) // 2 + 1)::BIGINT] AS mediana_superior FROM long GROUP BY ALL"""


_query("agg38_por_componente", _hist("componente"))(lambda s, d: judges.component_histogram(_long(s, d)))
for _n, _k in (("agg39_por_cenario", "cenario"), ("agg39_por_juiz", "juiz")):
    _query(_n, _hist(f"{_k}, componente"))(lambda s, d, k=_k: judges.component_histogram(_long(s, d), (k, "componente")))
_query("agg39_por_linguagem", _hist("linguagem, componente").replace("FROM long", "FROM long WHERE linguagem IS NOT NULL"))(lambda s, d: judges.component_histogram(_long(s, d).where("linguagem is not null"), ("linguagem", "componente")))
_EF = "SELECT juiz, componente, (r_mais - r_menos) / nullif(r_mais + r_menos, 0) AS r_rank_biserial FROM (SELECT DISTINCT juiz, componente FROM dif) LEFT JOIN soma USING (juiz, componente)"
_query("agg42_robustez", f"SELECT juiz, {', '.join(f"avg(diff) FILTER (WHERE componente = '{c}') AS {c}" for c in facts.COMPONENTS)} FROM com GROUP BY ALL")(lambda s, d: judges.mean_change_on_common_tools(_study(s, d)))
_MOJ = "SELECT componente, tool_uid, avg(sem) AS sem_codigo, avg(com) AS com_codigo, count(*) AS n_juizes FROM dif GROUP BY ALL"
_query("agg43_media_dos_juizes", _MOJ)(lambda s, d: judges.mean_over_judges(_diffs(s, d)))
_query("agg44_formato_longo", f"SELECT componente, tool_uid, condicao, nota FROM ({_MOJ}) UNPIVOT INCLUDE NULLS (nota FOR condicao IN (sem_codigo, com_codigo))")(lambda s, d: judges.melt_means(judges.mean_over_judges(_diffs(s, d)).select("componente", "tool_uid", "sem_codigo", "com_codigo")))
_query("agg48_boxplot_so_mudancas", _BOX.replace("FROM long", "FROM long SEMI JOIN (SELECT * FROM dif WHERE diff <> 0) USING (juiz, componente, tool_uid)"))(
    lambda s, d: (lambda x: judges.five_numbers(x.join(facts.differences(x).where("diff <> 0"), ["juiz", "componente", "tool_uid"], "left_semi")))(_long(s, d))
)
_query("win01_quartis", "SELECT juiz, componente, cenario, nota, quartil FROM faixa")(lambda s, d: windows.score_quartiles(_long(s, d)).select("juiz", "componente", "cenario", "nota", "quartil").distinct())
_query("win02_migracao", "SELECT * FROM mig")(lambda s, d: windows.quartile_migration(_long(s, d)))
_query("win03_divergencias", "SELECT juiz, componente, tool_uid, diff AS diff_nota, diff > 0 AS subiu FROM dif WHERE diff <> 0")(lambda s, d: windows.untied_divergences(_diffs(s, d)))
_B = "CASE WHEN {x} <= c[1] THEN 1 WHEN {x} <= c[2] THEN 2 WHEN {x} <= c[3] THEN 3 ELSE 4 END"
_query(
    "win04_transicao",
    f""", cp AS (SELECT juiz, componente, quantile_cont(sem, [0.25, 0.5, 0.75]) AS c FROM dif GROUP BY ALL), bd AS (SELECT juiz, componente, {_B.format(x="sem")} AS a, {_B.format(x="com")} AS b FROM dif JOIN cp USING (juiz, componente))
    SELECT juiz, componente, count(*) AS n, count(*) FILTER (WHERE a = b) * 100.0::DOUBLE / count(*) AS pct_manteve, count(*) FILTER (WHERE b > a) * 100.0::DOUBLE / count(*) AS pct_subiu, count(*) FILTER (WHERE b < a) * 100.0::DOUBLE / count(*) AS pct_desceu FROM bd GROUP BY ALL""",
)(lambda s, d: windows.cut_point_transition(_diffs(s, d)))
_query(
    "win05_transicao_media",
    f""", me AS ({_MOJ}), cp AS (SELECT componente, quantile_cont(sem_codigo, [0.25, 0.5, 0.75]) AS c FROM me GROUP BY ALL), bd AS (SELECT componente, {_B.format(x="sem_codigo")} AS a, {_B.format(x="com_codigo")} AS b FROM me JOIN cp USING (componente))
    SELECT 'media' AS juiz, componente, count(*) AS n, count(*) FILTER (WHERE a = b) * 100.0::DOUBLE / count(*) AS pct_manteve, count(*) FILTER (WHERE b > a) * 100.0::DOUBLE / count(*) AS pct_subiu, count(*) FILTER (WHERE b < a) * 100.0::DOUBLE / count(*) AS pct_desceu FROM bd GROUP BY ALL""",
)(lambda s, d: windows.cut_point_transition(judges.mean_over_judges(_diffs(s, d)).select(F.lit("media").alias("juiz"), "componente", F.col("sem_codigo").alias("sem"), F.col("com_codigo").alias("com"))))
_Z = "(least(r_mais, r_menos) - n_efetivo::DOUBLE * (n_efetivo + 1) / 4) / nullif(sqrt(greatest(n_efetivo::DOUBLE * (n_efetivo + 1) * (2 * n_efetivo + 1) / 24 - termo / 48, 0.0)), 0)"
#: erfc by the series of positive terms of exp(x^2) erf(x); p of few differences without ties and zeros by counting sign patterns.
_WILCOXON = """wz AS (SELECT *, {z} AS z FROM (SELECT juiz, componente, count(*) AS n_pareado, count(*) FILTER (WHERE diff = 0) AS n_empates, median(diff) AS mediana_diferenca FROM {pairs} GROUP BY ALL) LEFT JOIN {sums} USING (juiz, componente)),
    wp AS (SELECT *, CASE WHEN n_efetivo IS NULL THEN NULL WHEN n_efetivo <= 16 AND termo = 0 AND n_empates = 0 THEN
        least(1.0, 2.0 * len(list_filter(range(0, 1 << n_efetivo), lambda b: coalesce(list_sum(list_transform(range(0, n_efetivo), lambda k: ((b >> k) & 1) * (k + 1))), 0) <= least(r_mais, r_menos))) / (1 << n_efetivo))
      WHEN z = 0 THEN 1.0 ELSE greatest(0.0, 1 - 2 / sqrt(pi()) * exp(-z * z / 2) * list_sum(list_transform(range(0, 400), lambda k: exp((2 * k + 1) * ln(abs(z) / sqrt(2.0)) + (2 * k + 1) * ln(2.0) - lgamma(2.0 * k + 3) + lgamma(k + 2.0))))) END AS p FROM wz),
    wr AS (SELECT *, count(p) OVER (PARTITION BY juiz) AS m, row_number() OVER (PARTITION BY juiz ORDER BY p NULLS LAST) AS k FROM wp),
    wb AS (SELECT *, CASE WHEN p IS NOT NULL THEN least(1.0, min(p * m / k) OVER (PARTITION BY juiz ORDER BY p NULLS LAST, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) END AS p_bh FROM wr)"""
_WCOLS = "juiz, componente, n_pareado, n_empates, n_empates * 100.0::DOUBLE / n_pareado AS proporcao_empates_percentual, coalesce(n_efetivo, 0) AS n_efetivo_teste, mediana_diferenca, least(r_mais, r_menos) AS estatistica_w, round(z, 9) AS z, round(p, 7) AS p_valor, round(p_bh, 7) AS p_valor_bh"
_rounded_tests = lambda x: x.select("juiz", "componente", "n_pareado", "n_empates", "proporcao_empates_percentual", "n_efetivo_teste", "mediana_diferenca", "estatistica_w", F.round("z", 9).alias("z"), F.round("p_valor", 7).alias("p_valor"), F.round("p_valor_bh", 7).alias("p_valor_bh"))
_query("stat01_wilcoxon", ", " + _WILCOXON.format(z=_Z, pairs="dif", sums="soma") + f" SELECT {_WCOLS} FROM wb")(lambda s, d: _rounded_tests(statistics.wilcoxon_by_component(_diffs(s, d))))
_MDIF = f""", mdif AS (SELECT 'media' AS juiz, componente, com_codigo - sem_codigo AS diff FROM ({_MOJ})),
    mtam AS (SELECT juiz, componente, abs(diff) AS a, count(*) AS t, count(*) FILTER (WHERE diff > 0) AS up FROM mdif WHERE diff <> 0 GROUP BY ALL),
    mpos AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY juiz, componente ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2 AS r FROM mtam),
    msoma AS (SELECT juiz, componente, sum(t)::BIGINT AS n_efetivo, sum(r * up) AS r_mais, sum(r * (t - up)) AS r_menos, sum((t * t * t - t)::DOUBLE) AS termo FROM mpos GROUP BY ALL), """
_query("stat02_wilcoxon_media", _MDIF + _WILCOXON.format(z=_Z, pairs="mdif", sums="msoma") + f" SELECT {_WCOLS} FROM wb")(
    lambda s, d: _rounded_tests(statistics.wilcoxon_by_component(judges.mean_over_judges(_diffs(s, d)).select(F.lit("media").alias("juiz"), "componente", (F.col("com_codigo") - F.col("sem_codigo")).alias("diff"))))
)
_query("stat11_marcas", ", " + _WILCOXON.format(z=_Z, pairs="dif", sums="soma") + " SELECT juiz, componente, CASE WHEN p < 0.05 THEN '*' ELSE '' END AS marca FROM wb")(lambda s, d: statistics.wilcoxon_by_component(_diffs(s, d)).select("juiz", "componente", statistics.significance_mark(F.col("p_valor")).alias("marca")))
_query(
    "agg41_estatisticas",
    ", " + _WILCOXON.format(z=_Z, pairs="dif", sums="soma") + f""" SELECT * FROM (SELECT juiz, componente, count(*) AS n_pareado, avg(sem) AS media_sem_codigo, avg(com) AS media_com_codigo, avg(diff) AS delta, count(*) FILTER (WHERE diff < 0) * 100.0::DOUBLE / count(*) AS pct_diminuiu,
    count(*) FILTER (WHERE diff = 0) * 100.0::DOUBLE / count(*) AS pct_empatou, count(*) FILTER (WHERE diff > 0) * 100.0::DOUBLE / count(*) AS pct_aumentou, count(*) FILTER (WHERE diff <> 0) AS n_diferentes FROM dif GROUP BY ALL) JOIN ({_EF}) USING (juiz, componente)
    JOIN (SELECT juiz, componente, round(p, 7) AS p_valor, round(p_bh, 7) AS p_valor_bh FROM wb) USING (juiz, componente)""",
)(lambda s, d: judges.judge_statistics(_diffs(s, d)).withColumn("p_valor", F.round("p_valor", 7)).withColumn("p_valor_bh", F.round("p_valor_bh", 7)))
_BH = """, p AS (SELECT judge.id AS juiz, scenario AS cenario, count(*) FILTER (WHERE status = 'ok')::DOUBLE / count(*) AS p FROM act GROUP BY ALL),
    rk AS (SELECT *, count(p) OVER (PARTITION BY cenario) AS m, row_number() OVER (PARTITION BY cenario ORDER BY p, juiz) AS k FROM p)
    SELECT juiz, cenario, p, least(1.0, min(p * m / k) OVER (PARTITION BY cenario ORDER BY p, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS p_bh FROM rk"""
_query("stat03_benjamini_hochberg", _BH)(
    lambda s, d: statistics.benjamini_hochberg(_current(s, d).groupBy(F.col("judge.id").alias("juiz"), F.col("scenario").alias("cenario")).agg((F.count_if(F.col("status") == "ok") / F.count(F.lit(1))).alias("p")), "p", ["cenario"], "p_bh")
)
_query("stat04_rank_biserial", _EF)(lambda s, d: statistics.rank_biserial(_diffs(s, d), ["juiz", "componente"]))


_LONG3 = """jc AS (SELECT a.tool_uid, a.componente AS origem, unnest([a.componente, 'geral']) AS componente, a.juiz AS juiz_a, b.juiz AS juiz_b, a.sem AS sem_a, b.sem AS sem_b, a.com AS com_a, b.com AS com_b, a.diff AS diff_a, b.diff AS diff_b FROM {source} a JOIN {source} b USING (tool_uid, componente) WHERE a.juiz < b.juiz),
    lm AS (SELECT juiz_a, juiz_b, componente, tool_uid, unnest([{{'m': 'S', 'x': sem_a, 'y': sem_b}}, {{'m': 'C', 'x': com_a, 'y': com_b}}, {{'m': 'D', 'x': diff_a, 'y': diff_b}}]) AS c FROM jc),
    rk AS (SELECT juiz_a, juiz_b, componente, c.m AS medida, rank() OVER (PARTITION BY juiz_a, juiz_b, componente, c.m ORDER BY c.x) + (count(*) OVER (PARTITION BY juiz_a, juiz_b, componente, c.m, c.x) - 1) / 2 AS rx,
           rank() OVER (PARTITION BY juiz_a, juiz_b, componente, c.m ORDER BY c.y) + (count(*) OVER (PARTITION BY juiz_a, juiz_b, componente, c.m, c.y) - 1) / 2 AS ry FROM lm),
    sp AS (SELECT juiz_a, juiz_b, componente, medida, round({rho}, 9) AS rho FROM rk GROUP BY ALL)"""
_COM3 = ", " + _LONG3.format(source="com", rho=_pearson("rx", "ry"))
_query("stat05_spearman", _COM3 + " SELECT juiz_a, juiz_b, medida, componente, rho AS spearman, n_tools FROM sp JOIN (SELECT juiz_a, juiz_b, count(DISTINCT tool_uid) AS n_tools FROM jc GROUP BY ALL) USING (juiz_a, juiz_b)")(
    lambda s, d: judges.judge_correlations(judges.judge_pairs(judges.common_tools(_study(s, d)))).withColumn("spearman", F.round("spearman", 9))
)
_query(
    "stat06_spearman_consenso",
    ", " + _LONG3.format(source="unan", rho=_pearson("rx", "ry")) + """, g AS (SELECT * FROM sp WHERE componente = 'geral')
    SELECT juiz_a, juiz_b, n_pares, n_tools, pct_mesmo_sentido, (SELECT rho FROM g WHERE g.juiz_a = q.juiz_a AND g.juiz_b = q.juiz_b AND medida = 'S') AS rho_S, (SELECT rho FROM g WHERE g.juiz_a = q.juiz_a AND g.juiz_b = q.juiz_b AND medida = 'C') AS rho_C,
           (SELECT rho FROM g WHERE g.juiz_a = q.juiz_a AND g.juiz_b = q.juiz_b AND medida = 'D') AS "rho_D"
    FROM (SELECT juiz_a, juiz_b, count(*) AS n_pares, count(DISTINCT tool_uid) AS n_tools, count(*) FILTER (WHERE (diff_a > 0) = (diff_b > 0)) * 100.0::DOUBLE / count(*) AS pct_mesmo_sentido FROM jc WHERE componente = 'geral' GROUP BY ALL) q""",
)(lambda s, d: judges.consensus_correlation(judges.consensus_subset(_study(s, d))).select("juiz_a", "juiz_b", "n_pares", "n_tools", "pct_mesmo_sentido", *(F.round(f"rho_{k}", 9).alias(f"rho_{k}") for k in "SCD")))
_PE = " + ".join(f"avg((sign(diff_a) = {c})::INTEGER) * avg((sign(diff_b) = {c})::INTEGER)" for c in (-1, 0, 1))
_AGREE = _COM3 + f""", ck AS (SELECT componente, juiz_a || ' x ' || juiz_b AS par, juiz_a, juiz_b, count(*) AS n_itens, avg((sign(diff_a) = sign(diff_b))::INTEGER) AS po, {_PE} AS pe FROM jc GROUP BY ALL),
    lb AS (SELECT unnest([componente, 'geral']) AS componente, componente AS origem, tool_uid, sign(diff) AS s FROM com SEMI JOIN (SELECT tool_uid, componente FROM com GROUP BY ALL HAVING count(DISTINCT juiz) = (SELECT count(DISTINCT juiz) FROM est)) f USING (tool_uid, componente)), ct AS (SELECT componente, origem, tool_uid, s, count(*) AS n FROM lb GROUP BY ALL),
    it AS (SELECT componente, origem, tool_uid, sum(n) AS k, sum(n * (n - 1)) AS same FROM ct GROUP BY ALL), ag AS (SELECT componente, count(*) AS n_itens, avg(same::DOUBLE / (k * (k - 1))) AS po, sum(k) AS total FROM it GROUP BY ALL),
    ex AS (SELECT componente, sum((n::DOUBLE / total) * (n::DOUBLE / total)) AS pe FROM (SELECT componente, s, sum(n) AS n FROM ct GROUP BY ALL) JOIN ag USING (componente) GROUP BY ALL),
    ta AS (SELECT ck.componente, par, n_itens, s.rho AS "rho_S", c.rho AS "rho_C", po, pe FROM ck JOIN sp s ON s.juiz_a = ck.juiz_a AND s.juiz_b = ck.juiz_b AND s.componente = ck.componente AND s.medida = 'S' JOIN sp c ON c.juiz_a = ck.juiz_a AND c.juiz_b = ck.juiz_b AND c.componente = ck.componente AND c.medida = 'C'
           UNION ALL SELECT componente, 'todos (Fleiss)', n_itens, NULL, NULL, po, pe FROM ag JOIN ex USING (componente)),
    tb AS (SELECT componente, par, n_itens, "rho_S", "rho_C", round(po, 9) AS po, round(pe, 9) AS pe, round((po - pe) / nullif(1 - pe, 0), 9) AS kappa FROM ta)"""
_agreement = lambda s, d: judges.agreement_table(_study(s, d)).select("componente", "par", "n_itens", *(F.round(c, 9).alias(c) for c in ("rho_S", "rho_C", "po", "pe", "kappa")))
_query("stat09_concordancia", _AGREE + " SELECT * FROM tb")(_agreement)
_query("stat07_cohen_kappa", _AGREE + " SELECT componente, par, n_itens, po, pe, kappa FROM tb WHERE par <> 'todos (Fleiss)'")(lambda s, d: _agreement(s, d).where(F.col("par") != judges.ALL_JUDGES).select("componente", "par", "n_itens", "po", "pe", "kappa"))
_query("stat08_fleiss_kappa", _AGREE + " SELECT componente, n_itens, po, pe, kappa FROM tb WHERE par = 'todos (Fleiss)'")(lambda s, d: _agreement(s, d).where(F.col("par") == judges.ALL_JUDGES).select("componente", "n_itens", "po", "pe", "kappa"))
_query("smp04_shards", f"SELECT shard, count(*) AS n FROM (SELECT (('0x' || substr(sha256(tool_uid), 1, 8))::UBIGINT::HUGEINT * 0 + list_reduce(list_transform(range(1, 65), lambda i: (instr('0123456789abcdef', substr(sha256(tool_uid), i, 1)) - 1)::BIGINT), lambda a, x: (a * 16 + x) % 7))::BIGINT AS shard FROM (SELECT DISTINCT tool_uid FROM evaluations)) GROUP BY ALL".replace("(('0x' || substr(sha256(tool_uid), 1, 8))::UBIGINT::HUGEINT * 0 + ", "("))(
    lambda s, d: read_table(s, d, "evaluations").select("tool_uid").distinct().select(keys.shard_for(F.col("tool_uid"), 7).alias("shard")).groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
)
_query(
    "jn09_pending_work",
    """, done AS (SELECT DISTINCT tool_uid, scenario, judge.id AS judge FROM evaluations WHERE status IN ('ok', 'refused')),
    work AS (SELECT t.tool_uid, s.scenario, j.judge_id AS judge FROM (SELECT DISTINCT tool_uid FROM tools) t, (VALUES ('description_only'), ('with_source')) s(scenario), judges j WHERE j.enabled)
    SELECT judge, scenario, count(*) AS n FROM work ANTI JOIN done USING (tool_uid, scenario, judge) GROUP BY ALL""",
)(lambda s, d: pending_work(read_table(s, d, "tools"), read_table(s, d, "judges").where("enabled"), read_table(s, d, "evaluations")).groupBy("judge", "scenario").agg(F.count(F.lit(1)).alias("n")))
_query("dt01_peak_window", "SELECT judge.id AS juiz, count(*) FILTER (WHERE isodow(ts) < 6 AND ((hour(ts) BETWEEN 1 AND 3) OR (hour(ts) BETWEEN 6 AND 9))) AS pico, count(*) AS n FROM (SELECT *, ingested_at AT TIME ZONE 'UTC' AS ts FROM evaluations) GROUP BY ALL")(
    lambda s, d: read_table(s, d, "evaluations").groupBy(F.col("judge.id").alias("juiz")).agg(F.count_if(keys.in_peak_window(F.col("ingested_at"))).alias("pico"), F.count(F.lit(1)).alias("n"))
)


_query(
    "agg40_resumo_geral",
    "SELECT coalesce(juiz, '*') AS juiz, coalesce(cenario, '*') AS cenario, coalesce(componente, '*') AS componente, avg(nota) AS media, count(*) AS n FROM long GROUP BY GROUPING SETS ((juiz), (cenario), (componente), (juiz, cenario), ())",
)(lambda s, d: judges.grouped_summary(_long(s, d)))
_query("srt05_tools_por_media", "SELECT tool_uid, m FROM (SELECT t.tool_uid, avg(l.nota) AS m FROM (SELECT DISTINCT tool_key AS tool_uid FROM act) t LEFT JOIN long l USING (tool_uid) GROUP BY ALL) ")(
    lambda s, d: (lambda cur: judges.tools_by_mean(cur))(_current(s, d))
)
_query(
    "srt06_consenso_ordenado",
    "SELECT tool_uid, componente, n_juizes, soma_abs FROM (SELECT tool_uid, componente, count(*) AS n_juizes, sum(abs(diff_nota)) AS soma_abs FROM cons GROUP BY ALL) ",
)(
    lambda s, d: judges.consensus_changes(_diffs(s, d)).groupBy("tool_uid", "componente").agg(F.count(F.lit(1)).alias("n_juizes"), F.sum(F.abs("diff_nota")).alias("soma_abs")).orderBy(F.desc("n_juizes"), F.desc("soma_abs"), "tool_uid", "componente")
)
_query("agg32_desdobramento", "SELECT componente, cenario, media, n, rank() OVER (PARTITION BY cenario ORDER BY media DESC, componente) AS posicao FROM (SELECT componente, cenario, avg(nota) AS media, count(*) AS n FROM long GROUP BY ALL)")(lambda s, d: judges.component_ranking(_long(s, d)))
_query("flt20_failed_tools", "SELECT DISTINCT tool_uid FROM evaluations WHERE status IN ('error', 'timeout') EXCEPT SELECT tool_uid FROM evaluations WHERE status = 'ok'")(
    lambda s, d: (lambda e: e.where("status in ('error', 'timeout')").select("tool_uid").subtract(e.where("status = 'ok'").select("tool_uid")))(read_table(s, d, "evaluations"))
)
_query("set03_judges_of_both_scenarios", "SELECT judge.id AS juiz FROM evaluations WHERE scenario = 'description_only' INTERSECT SELECT judge.id FROM evaluations WHERE scenario = 'with_source'")(
    lambda s, d: (lambda e: e.where(F.col("scenario") == facts.WITHOUT).select(F.col("judge.id").alias("juiz")).intersect(e.where(F.col("scenario") == facts.WITH).select(F.col("judge.id").alias("juiz"))))(read_table(s, d, "evaluations"))
)
_query(
    "jn17_first_seen_metadata",
    "SELECT tool_key, arg_min(tool.name, eval_id) AS nome, arg_min(repo.name_with_owner, eval_id) AS repositorio FROM k WHERE tool.name IS NOT NULL AND repo.name_with_owner IS NOT NULL GROUP BY ALL",
)(lambda s, d: dedup.with_tool_key(read_table(s, d, "evaluations")).where("tool.name is not null and repo.name_with_owner is not null").groupBy("tool_key").agg(F.min_by("tool.name", "eval_id").alias("nome"), F.min_by("repo.name_with_owner", "eval_id").alias("repositorio")))


_query(
    "agg32_desdobramento_por_juiz",
    ", " + _WILCOXON.format(z=_Z, pairs="dif", sums="soma") + f""", ft AS (SELECT *, unnest([juiz, 'todos']) AS fatia FROM long)
    SELECT fatia, componente, {_LABEL} AS componente_label, avg(nota) AS media, coalesce({_STD}, 0.0) AS sd, count(nota) AS n, avg(nota) FILTER (WHERE cenario = 'description_only') AS media_description_only, avg(nota) FILTER (WHERE cenario = 'with_source') AS media_with_source,
      min(nota)::DOUBLE AS minimo, quantile_cont(nota, 0.25)::DOUBLE AS q1, quantile_cont(nota, 0.5)::DOUBLE AS mediana, quantile_cont(nota, 0.75)::DOUBLE AS q3, max(nota)::DOUBLE AS maximo,
      any_value(w.n_pareado) AS n_pareado, any_value(w.n_empates * 100.0::DOUBLE / w.n_pareado) AS proporcao_empates_percentual, round(any_value(w.p), 7) AS p_valor, round(any_value(w.p_bh), 7) AS p_valor_bh, any_value(CASE WHEN w.juiz IS NOT NULL THEN coalesce(w.p_bh < 0.05, false) END) AS significativo
    FROM ft LEFT JOIN wb w ON w.juiz = ft.fatia AND w.componente = ft.componente GROUP BY fatia, ft.componente""".replace("SELECT fatia, componente,", "SELECT fatia, ft.componente AS componente,"),
)(lambda s, d: judges.breakdown(_long(s, d)).withColumn("p_valor", F.round("p_valor", 7)).withColumn("p_valor_bh", F.round("p_valor_bh", 7)))
_query(
    "evl15_consenso_detalhado",
    f""", mu AS (SELECT tool_uid, juiz, list(componente) AS mudaram FROM dif WHERE diff <> 0 GROUP BY ALL),
    av AS (SELECT tool_key AS tool_uid, judge.id AS juiz, judge.provider AS provider, scenario, unnest([{", ".join(f"{{'componente': '{c}', 'score': scores.{c}.score, 'reasoning': scores.{c}.reasoning}}" for c in facts.COMPONENTS)}]) AS c FROM act WHERE status = 'ok')
    SELECT a.tool_uid, a.juiz, scenario, provider, c.componente AS componente, c.score AS score, c.reasoning AS reasoning FROM av a JOIN mu USING (tool_uid, juiz) WHERE list_contains(mudaram, c.componente) AND a.tool_uid IN (SELECT tool_uid FROM cons)""",
)(lambda s, d: judges.evaluations_of_consensus(_current(s, d)).select("tool_uid", F.explode("avaliacoes").alias("a")).select("tool_uid", "a.juiz", "a.scenario", "a.provider", F.explode("a.scores").alias("c")).select("tool_uid", "juiz", "scenario", "provider", "c.*"))
_query("agg47_consenso_rotulado", "SELECT componente, count(*) AS n_tools_consenso, count(*) FILTER (WHERE mesma) AS n_tools_mesma_direcao, avg(n_juizes) AS media_juizes_por_consenso,  " + _LABEL.replace("ft.", "") + " AS componente_label FROM div WHERE todos AND n_juizes >= 2 GROUP BY ALL")(
    lambda s, d: judges.labelled(judges.consensus_summary(judges.consensus_changes(_diffs(s, d))))
)
_query("arr03_notas_por_componente", f"SELECT eval_id, u.k AS componente, u.v AS nota FROM (SELECT eval_id, unnest([{', '.join(f"{{'k': '{c}', 'v': scores.{c}.score}}" for c in facts.COMPONENTS)}]) AS u FROM act WHERE status = 'ok')")(
    lambda s, d: judges.scores_by_component(_current(s, d)).select("eval_id", F.explode("notas").alias("componente", "nota"))
)
_query("flt24_dedupe_report", "SELECT (SELECT count(*) FROM evaluations) AS linhas, count(*) AS linhas_unicas, count(*) FILTER (WHERE status = 'error') AS ainda_com_erro, (SELECT count(*) FROM evaluations) - count(*) AS removidas FROM ded")(lambda s, d: dedup.dedupe_report(read_table(s, d, "evaluations")))
_query("jn24_not_yet_processed", "SELECT eval_id FROM evaluations WHERE coalesce(tool_uid, '?') NOT IN (SELECT coalesce(tool_uid, '?') FROM evaluations WHERE status = 'refused')")(
    lambda s, d: (lambda e: dedup.not_yet_processed(e, e.where("status = 'refused'"), ["tool_uid"]).select("eval_id"))(read_table(s, d, "evaluations"))
)
_query("mth02_arredondado", "SELECT eval_id, round_even(latency_ms, 3) AS latency_ms, usage.input_tokens AS input_tokens FROM evaluations")(
    lambda s, d: keys.rounded(read_table(s, d, "evaluations").select("eval_id", "latency_ms", "usage")).select("eval_id", "latency_ms", F.col("usage.input_tokens").alias("input_tokens"))
)


def pending_work(tools: DataFrame, judges_table: DataFrame, evaluations: DataFrame) -> DataFrame:
    """tool_uid, scenario, judge still to be evaluated: each tool's work list (exploded from the small judge table), minus what is done."""
    plan = judges_table.agg(F.collect_list("judge_id").alias("judges")).scalar()
    work = tools.select("tool_uid").distinct().select("tool_uid", F.explode(plan).alias("judge")).withColumn("scenario", F.explode(F.array(F.lit(facts.WITHOUT), F.lit(facts.WITH))))
    done = evaluations.where(F.col("status").isin("ok", "refused")).select("tool_uid", "scenario", F.col("judge.id").alias("judge"))
    return work.join(done, ["tool_uid", "scenario", "judge"], "left_anti")
