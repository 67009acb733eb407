"""Queries over candidates, tools and source files and their SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys
from ..operators import corpus, dedup, nested_flatten
from ..sources import records
from ..sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

LANGUAGES = ["Python", "TypeScript", "JavaScript", "Go", "Java", "C#", "Rust", "Ruby"]
_L = ", ".join(f"'{x}'" for x in LANGUAGES)
BASE = f"""WITH uni AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS n FROM candidates) WHERE n = 1),
pool AS (SELECT * FROM uni WHERE NOT is_fork AND stargazer_count >= 100 AND primary_language IN ({_L})),
sel AS (SELECT * FROM pool ORDER BY stargazer_count DESC, seq LIMIT 50)
"""


def _query(name: str, sql: str | None = None, base: str = BASE):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = base + sql
        return f

    return add


def _unique(s, d):
    return dedup.dedupe_candidates(read_table(s, d, "candidates"))


def _pool(s, d):
    return corpus.filter_and_rank(dedup.first_by(read_table(s, d, "candidates"), ["id"], F.col("seq")), LANGUAGES)


def _selected(s, d):
    return _pool(s, d).limit(50)


_query(
    "ded01_dedupe_candidates",
    """, e AS (SELECT id, seq, unnest(matched_signals) AS s, generate_subscripts(matched_signals, 1) AS p FROM candidates), m AS (SELECT id, s, min((seq, p)) AS onde FROM e GROUP BY ALL),
    j AS (SELECT id, string_agg(s, ',' ORDER BY onde) AS signals FROM m GROUP BY ALL) SELECT u.id, u.seq, u.name_with_owner, u.stargazer_count, coalesce(j.signals, '') AS signals FROM uni u LEFT JOIN j ON u.id IS NOT DISTINCT FROM j.id""",
)(lambda s, d: _unique(s, d).select("id", "seq", "name_with_owner", "stargazer_count", F.array_join("matched_signals", ",").alias("signals")))
_query("flt01_filter_and_rank", "SELECT id, stargazer_count, primary_language, seq FROM pool")(lambda s, d: _pool(s, d).select("id", "stargazer_count", "primary_language", "seq"))
_query("flt02_no_forks", "SELECT count(*) AS n FROM uni WHERE NOT is_fork AND name_with_owner IS NOT NULL")(lambda s, d: dedup.first_by(read_table(s, d, "candidates"), ["id"], F.col("seq")).where("not is_fork and name_with_owner is not null").agg(F.count(F.lit(1)).alias("n")))
_query("srt01_top_n", "SELECT id, name_with_owner, stargazer_count FROM sel")(lambda s, d: _selected(s, d).select("id", "name_with_owner", "stargazer_count"))
_query("srt03_rank_by_signals", ", t AS (SELECT id, name_with_owner, len(list_distinct(flatten(list(matched_signals)))) AS n FROM candidates WHERE name_with_owner IS NOT NULL GROUP BY ALL) SELECT name_with_owner, n FROM t ")(
    lambda s, d: read_table(s, d, "candidates").where("name_with_owner is not null").select("id", "name_with_owner", F.explode("matched_signals").alias("x")).groupBy("id", "name_with_owner").agg(F.countDistinct("x").alias("n")).orderBy(F.desc("n"), "name_with_owner").select("name_with_owner", "n")
)
_query("agg01_repos_por_linguagem", "SELECT primary_language AS linguagem, count(*) AS repositorios, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM sel) AS percentual FROM sel WHERE primary_language IS NOT NULL GROUP BY ALL")(lambda s, d: corpus.count_by(_selected(s, d), F.col("primary_language"), "linguagem", "repositorios"))
_query(
    "agg05_funil_coleta",
    """, t AS (SELECT '1_bruto' AS etapa, (SELECT count(*) FROM candidates) AS repositorios UNION ALL SELECT '2_unico', (SELECT count(DISTINCT id) FROM candidates) UNION ALL SELECT '3_elegivel', (SELECT count(*) FROM pool) UNION ALL SELECT '4_selecionado', (SELECT count(*) FROM sel))
    SELECT etapa, repositorios, repositorios * 100.0::DOUBLE / (SELECT count(*) FROM candidates) AS percentual_do_bruto FROM t""",
)(lambda s, d: corpus.collection_funnel(read_table(s, d, "candidates"), _pool(s, d), _selected(s, d)))
_query("agg06_candidatos_por_fonte", "SELECT split_part(x, ':', 1) AS fonte, count(*) AS candidatos, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM candidates) AS percentual FROM (SELECT unnest(matched_signals) AS x FROM candidates) GROUP BY ALL")(lambda s, d: corpus.candidates_by_source(read_table(s, d, "candidates")))
_query(
    "agg08_media_tools_por_server",
    """, a AS (SELECT coalesce(primary_language, 'Total') AS linguagem, count(DISTINCT name_with_owner) AS s FROM sel WHERE primary_language IS NOT NULL GROUP BY GROUPING SETS ((primary_language), ())),
    b AS (SELECT coalesce(l, 'Total') AS linguagem, count(DISTINCT r) AS c, count(*) AS t FROM (SELECT repo.primary_language AS l, repo.name_with_owner AS r FROM tools) WHERE l IS NOT NULL GROUP BY GROUPING SETS ((l), ()))
    SELECT linguagem, coalesce(s, 0) AS repositorios_selecionados, coalesce(c, 0) AS repositorios_com_tools, coalesce(t, 0) AS tools_total, coalesce(t, 0)::DOUBLE / nullif(coalesce(s, 0), 0) AS media_tools_por_repo_selecionado,
    coalesce(t, 0)::DOUBLE / nullif(coalesce(c, 0), 0) AS media_tools_por_repo_com_tools FROM a FULL JOIN b USING (linguagem)""",
)(lambda s, d: corpus.tools_per_server(_selected(s, d), read_table(s, d, "tools")))
_query(
    "agg09_taxa_cobertura",
    """, r AS (SELECT DISTINCT primary_language AS linguagem, name_with_owner FROM sel WHERE primary_language IS NOT NULL), h AS (SELECT DISTINCT repo.name_with_owner AS name_with_owner FROM tools)
    SELECT linguagem, count(*) AS repositorios_selecionados, count(h.name_with_owner) AS repositorios_com_tools, count(*) - count(h.name_with_owner) AS repositorios_sem_tools, count(h.name_with_owner) * 100.0::DOUBLE / count(*) AS taxa_cobertura_percentual FROM r LEFT JOIN h USING (name_with_owner) GROUP BY ALL""",
)(lambda s, d: corpus.coverage_by_language(_selected(s, d), read_table(s, d, "tools")))
_query("agg02_tools_por_linguagem", "SELECT repo.primary_language AS linguagem, count(*) AS tools, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM tools) AS percentual FROM tools WHERE repo.primary_language IS NOT NULL GROUP BY ALL", "")(lambda s, d: corpus.count_by(read_table(s, d, "tools"), F.col("repo.primary_language"), "linguagem", "tools"))
_query("agg03_sdk_pattern", "SELECT tool.sdk_pattern AS sdk_pattern, count(*) AS tools, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM tools) AS percentual FROM tools WHERE tool.sdk_pattern IS NOT NULL GROUP BY ALL", "")(lambda s, d: corpus.count_by(read_table(s, d, "tools"), F.col("tool.sdk_pattern"), "sdk_pattern", "tools"))
_query("agg04_profundidade", "SELECT tool.call_graph_depth AS profundidade, count(*) AS tools, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM tools) AS percentual FROM tools WHERE tool.call_graph_depth IS NOT NULL GROUP BY ALL", "")(lambda s, d: corpus.count_by(read_table(s, d, "tools"), F.col("tool.call_graph_depth"), "profundidade", "tools"))
_query("agg10_call_graph_resolucao")(lambda s, d: corpus.call_resolution(nested_flatten.call_graph_nodes(read_table(s, d, "tools"))))
_query("agg11_descricoes_literais", "SELECT coalesce(l, 'Total') AS linguagem, count(*) FILTER (WHERE x) AS descricoes_literais, count(*) AS tools_total, count(*) FILTER (WHERE x) * 100.0::DOUBLE / count(*) AS taxa_literal_percentual FROM (SELECT repo.primary_language AS l, coalesce(tool.description_is_literal, false) AS x FROM tools) WHERE l IS NOT NULL GROUP BY GROUPING SETS ((l), ())", "")(lambda s, d: corpus.literal_descriptions(read_table(s, d, "tools")))
_query("agg12_tools_por_repo", "SELECT repo.name_with_owner AS repositorio, count(*) AS tools FROM tools WHERE repo.name_with_owner IS NOT NULL GROUP BY ALL", "")(lambda s, d: read_table(s, d, "tools").where("repo.name_with_owner is not null").groupBy(F.col("repo.name_with_owner").alias("repositorio")).agg(F.count(F.lit(1)).alias("tools")))


def _dist(x: str, name: str, table: str) -> str:
    return f"""SELECT unnest(['minimo', 'p25', 'mediana', 'p75', 'maximo', 'media']) AS estatistica, unnest([trunc(min(x)), trunc(quantile_cont(x, 0.25)), trunc(quantile_cont(x, 0.5)), trunc(quantile_cont(x, 0.75)), trunc(max(x)), trunc(avg(x))])::BIGINT AS {name}
    FROM (SELECT {x}::DOUBLE AS x FROM {table}) WHERE x IS NOT NULL"""


_query("agg13_estrelas", _dist("stargazer_count", "estrelas", "sel"))(lambda s, d: corpus.distribution(_selected(s, d), F.col("stargazer_count"), "estrelas"))
_query("agg14_loc", _dist("tool.loc", "loc", "tools"), "")(lambda s, d: corpus.distribution(read_table(s, d, "tools"), F.col("tool.loc"), "loc"))
_query("agg15_complexidade", _dist("tool.cyclomatic_complexity", "complexidade_ciclomatica", "tools WHERE tool.cyclomatic_complexity > 0"), "")(lambda s, d: corpus.distribution(corpus.computed_complexity(read_table(s, d, "tools")), F.col("tool.cyclomatic_complexity"), "complexidade_ciclomatica"))
_query(
    "agg16_correlacao_loc_complexidade",
    """WITH o AS (SELECT tool.loc::DOUBLE AS x, tool.cyclomatic_complexity::DOUBLE AS y FROM tools WHERE tool.cyclomatic_complexity > 0 AND tool.loc > 0),
    r AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM o)
    SELECT unnest(['pearson', 'spearman', 'pearson_log', 'pct_cc_1']) AS metrica, unnest([round(corr(x, y), 9), round(corr(rx, ry), 9), round(corr(ln(x), ln(y)), 9), round(count(*) FILTER (WHERE y = 1) * 100.0::DOUBLE / count(*), 9)]) AS valor FROM r""",
    "",
)(lambda s, d: corpus.loc_complexity_correlation(read_table(s, d, "tools")).select("metrica", F.round("valor", 9).alias("valor")))
_query("srt02_top_repos", "SELECT repo.name_with_owner AS repositorio, count(*) AS tools, arg_max(repo.primary_language, row_id) AS linguagem, arg_max(repo.stargazer_count, row_id) AS estrelas, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM tools) AS percentual_do_total FROM tools WHERE repo.name_with_owner IS NOT NULL GROUP BY ALL ORDER BY tools DESC, repositorio LIMIT 15", "")(lambda s, d: corpus.top_repositories(read_table(s, d, "tools")))
_query("snk12_log_bins", "WITH x AS (SELECT ln(tool.loc::DOUBLE) AS x FROM tools WHERE tool.loc > 0), m AS (SELECT min(x) AS lo, max(x) AS hi FROM x) SELECT least(floor((x - lo) / (hi - lo) * 12) + 1, 12)::INTEGER AS faixa, count(*) AS n FROM x, m GROUP BY ALL", "")(lambda s, d: corpus.log_bins(read_table(s, d, "tools").where("tool.loc > 0"), F.col("tool.loc"), 12))
_query(
    "smp01_alocacao",
    """WITH z AS (SELECT repo.primary_language AS stratum, count(*) AS size FROM tools WHERE repo.primary_language IS NOT NULL GROUP BY ALL), k AS (SELECT count(*) AS k FROM z), r AS (SELECT *, row_number() OVER (ORDER BY size DESC, stratum) AS rk FROM z, k)
    SELECT stratum, size, least(size, least(floor(100 / k), size) + CASE WHEN rk <= 100 - floor(100 / k) * k THEN 1 ELSE 0 END)::BIGINT AS alocado FROM r""",
    "",
)(lambda s, d: corpus.stratum_allocation(read_table(s, d, "tools").where("repo.primary_language is not null").groupBy(F.col("repo.primary_language").alias("stratum")).agg(F.count(F.lit(1)).alias("size")), 100))
_query("smp03_amostra")(lambda s, d: corpus.random_sample(read_table(s, d, "tools").select("row_id", "tool_uid"), "row_id", 20, 7))
_query("flt05_min_tools", "SELECT row_id FROM tools WHERE repo.name_with_owner IN (SELECT repo.name_with_owner FROM tools GROUP BY ALL HAVING count(*) >= 5)", "")(lambda s, d: corpus.repos_with_min_tools(read_table(s, d, "tools"), 5).select("row_id"))
_query("flt10_repo_status", "SELECT repo.name_with_owner AS repositorio, count(*) AS tools, CASE WHEN count(*) >= 5 THEN 'qualificado' ELSE 'desqualificado' END AS situacao FROM tools WHERE repo.name_with_owner IS NOT NULL GROUP BY ALL", "")(
    lambda s, d: read_table(s, d, "tools").where("repo.name_with_owner is not null").groupBy(F.col("repo.name_with_owner").alias("repositorio")).agg(F.count(F.lit(1)).alias("tools")).withColumn("situacao", F.when(F.col("tools") >= 5, "qualificado").otherwise("desqualificado"))
)
_query("jn08_assemble", "SELECT t.row_id, u.id AS repo_id, u.stargazer_count FROM tools t JOIN uni u ON t.repo.name_with_owner = u.name_with_owner")(
    lambda s, d: read_table(s, d, "tools").select("row_id", F.col("repo.name_with_owner").alias("name_with_owner")).join(dedup.first_by(read_table(s, d, "candidates"), ["id"], F.col("seq")).select("name_with_owner", F.col("id").alias("repo_id"), "stargazer_count"), "name_with_owner").select("row_id", "repo_id", "stargazer_count")
)
_query("jn10_backfill", "SELECT id, stargazer_count FROM pool WHERE id NOT IN (SELECT id FROM sel) ORDER BY stargazer_count DESC, seq LIMIT 20")(
    lambda s, d: _pool(s, d).join(_selected(s, d).select("id"), "id", "left_anti").orderBy(F.desc("stargazer_count"), "seq").limit(20).select("id", "stargazer_count")
)
_query("jn25_orphans", "SELECT DISTINCT repo_name FROM source_files WHERE repo_name IS NOT NULL AND repo_name NOT IN (SELECT repo.name_with_owner FROM tools WHERE repo.name_with_owner IS NOT NULL)", "")(
    lambda s, d: read_table(s, d, "source_files").select("repo_name").where("repo_name is not null").distinct().join(read_table(s, d, "tools").select(F.col("repo.name_with_owner").alias("repo_name")).distinct(), "repo_name", "left_anti")
)
_query(
    "flt06_flt07_source_files",
    r"""SELECT file_id FROM source_files WHERE NOT regexp_matches(lower(file_path), '(^|/)(tests?|__tests__|specs?|testing|conformance-tests?|examples?|demos?|samples?|docs?|docs_src|documentation|node_modules|vendor|third_party|dist|build|out|\.venv|venv|\.git)/')
    AND NOT regexp_matches(lower(file_path), '\.(test|spec)\.(tsx?|jsx?|mjs|cjs)$') AND NOT regexp_matches(file_path, '(?i:(^|/)(test_[^/]*|[^/]*_test))\.py$')""",
    "",
)(lambda s, d: corpus.source_file_filter(read_table(s, d, "source_files")).select("file_id"))
_query(
    "ext02_effective_language",
    """SELECT *, CASE WHEN ts > js THEN 'TypeScript' ELSE 'JavaScript' END AS linguagem FROM (SELECT repo_name, count(*) FILTER (WHERE e IN ('ts', 'tsx')) AS ts, count(*) FILTER (WHERE e IN ('js', 'jsx', 'mjs', 'cjs')) AS js
    FROM (SELECT repo_name, lower(string_split(file_path, '.')[-1]) AS e FROM source_files WHERE repo_name IS NOT NULL) GROUP BY ALL) WHERE ts + js > 0""",
    "",
)(lambda s, d: corpus.effective_language(read_table(s, d, "source_files")))
_query(
    "str12_hsh01_source_snippets",
    """WITH b AS (SELECT repo_name, file_path, regexp_split_to_array(arg_min(body, file_id), '\\r?\\n') AS l FROM source_files GROUP BY ALL),
    t AS (SELECT row_id, tool.source_location.start_line AS a, tool.source_location.end_line AS z, l FROM tools LEFT JOIN b ON b.repo_name = tools.repo.name_with_owner AND b.file_path = tools.tool.source_location.file),
    s AS (SELECT row_id, CASE WHEN l IS NULL OR a IS NULL OR z IS NULL OR a < 1 THEN NULL ELSE array_to_string(l[a:z], chr(10)) END AS s FROM t)
    SELECT row_id, sha256(s) AS sha256, len(string_split(s, chr(10)))::INTEGER AS linhas FROM s""",
    "",
)(lambda s, d: corpus.source_snippets(read_table(s, d, "tools"), read_table(s, d, "source_files")))
_query(
    "str_functions",
    """SELECT row_id, split_part(tool_uid, '::', 1) AS repo, regexp_replace(repo.name_with_owner, '^([^/]*)/', '\\1__') AS slug, regexp_replace(tool_uid, '[^\\p{L}\\p{N}\\-_.]', '_', 'g') AS arquivo, CASE WHEN length(call_graph) > 200 THEN left(call_graph, 200) || chr(10) || '[truncated]' ELSE call_graph END AS cortado,
    regexp_extract(coalesce(call_graph, ''), '(?s)\\{.*\\}', 0) AS objeto FROM tools""",
    "",
)(
    lambda s, d: read_table(s, d, "tools").select(
        "row_id", keys.repo_of_uid(F.col("tool_uid")).alias("repo"), keys.slug_of_repo(F.col("repo.name_with_owner")).alias("slug"), keys.safe_file_name(F.col("tool_uid")).alias("arquivo"), keys.truncate_with_notice(F.col("call_graph"), 200).alias("cortado"), keys.first_json_object(F.coalesce("call_graph", F.lit(""))).alias("objeto")
    )
)
_query(
    "str01_tool_uid",
    """SELECT row_id, concat(repo.name_with_owner, '::', tool.qualified_name, '::', tool.source_location.file, ':', tool.source_location.start_line, CASE WHEN ends_with(tool.sdk_pattern, '_lowlevel') THEN '::' || tool.name ELSE '' END) AS uid FROM tools
    WHERE repo.name_with_owner IS NOT NULL AND tool.qualified_name IS NOT NULL AND tool.source_location.file IS NOT NULL AND tool.source_location.start_line IS NOT NULL AND tool.sdk_pattern IS NOT NULL AND tool.name IS NOT NULL""",
    "",
)(
    lambda s, d: read_table(s, d, "tools")
    .select("row_id", keys.tool_uid_for(F.col("repo.name_with_owner"), F.col("tool.qualified_name"), F.col("tool.source_location.file"), F.col("tool.source_location.start_line"), F.col("tool.name"), F.col("tool.sdk_pattern")).alias("uid"))
    .where("uid is not null")
)
_query("jsn02_score_validation", "SELECT eval_id FROM evaluations WHERE status = 'ok' AND NOT coalesce(" + " AND ".join(f"scores.{c}.score BETWEEN 1 AND 5" for c in ("purpose", "guidelines", "limitations", "parameter_explanation", "length_completeness", "examples")) + ", false)", "")(
    lambda s, d: read_table(s, d, "evaluations").where((F.col("status") == "ok") & ~F.coalesce(F.expr(" and ".join(f"scores.{c}.score between 1 and 5" for c in ("purpose", "guidelines", "limitations", "parameter_explanation", "length_completeness", "examples"))), F.lit(False))).select("eval_id")
)
_query("jsn01_raw_json", "SELECT record_no, json_extract_string(body, '$.tool_uid') AS tool_uid FROM raw_records WHERE json_valid(body) AND json_type(body) = 'OBJECT'", "")(
    lambda s, d: read_table(s, d, "raw_records").select("record_no", F.try_parse_json("body").alias("v")).where("v is not null and schema_of_variant(v) like 'OBJECT%'").select("record_no", F.try_variant_get("v", "$.tool_uid", "string").alias("tool_uid"))
)
_query("set04_repos_without_tools", "SELECT DISTINCT name_with_owner FROM candidates WHERE name_with_owner IS NOT NULL EXCEPT SELECT repo.name_with_owner FROM tools", "")(
    lambda s, d: read_table(s, d, "candidates").select("name_with_owner").where("name_with_owner is not null").subtract(read_table(s, d, "tools").select(F.col("repo.name_with_owner").alias("name_with_owner")))
)
_query(
    "jn19_source_sha",
    """WITH b AS (SELECT repo_name, file_path, regexp_split_to_array(arg_min(body, file_id), '\\r?\\n') AS l FROM source_files GROUP BY ALL),
    t AS (SELECT tool_uid, arg_min(sha256(CASE WHEN l IS NULL OR tool.source_location.start_line IS NULL OR tool.source_location.end_line IS NULL OR tool.source_location.start_line < 1 THEN NULL ELSE array_to_string(l[tool.source_location.start_line:tool.source_location.end_line], chr(10)) END), row_id) AS sha
          FROM tools LEFT JOIN b ON b.repo_name = tools.repo.name_with_owner AND b.file_path = tools.tool.source_location.file GROUP BY ALL)
    SELECT e.scenario, CASE WHEN e.source_code_sha256 IS NULL THEN 'sem hash' WHEN t.sha IS NULL THEN 'sem fonte' WHEN t.sha = e.source_code_sha256 THEN 'igual' ELSE 'diferente' END AS situacao, count(*) AS n FROM evaluations e LEFT JOIN t USING (tool_uid) GROUP BY ALL""",
    "",
)(lambda s, d: corpus.source_hash_check(read_table(s, d, "evaluations"), read_table(s, d, "tools"), read_table(s, d, "source_files")))


_query("flt15_retention", "SELECT repo.name_with_owner AS repositorio, count(*) AS n_tools FROM tools GROUP BY ALL HAVING count(*) < 4", "")(lambda s, d: corpus.below_minimum(read_table(s, d, "tools"), 4))
_query("flt15_retained_files", "SELECT file_id FROM source_files WHERE repo_name IS NULL OR repo_name NOT IN (SELECT repo.name_with_owner FROM tools WHERE repo.name_with_owner IS NOT NULL GROUP BY ALL HAVING count(*) < 4)", "")(
    lambda s, d: corpus.retain(read_table(s, d, "source_files"), read_table(s, d, "tools"), 4).select("file_id")
)
_query(
    "flt21_pending_extraction",
    "SELECT id FROM uni WHERE id IN (SELECT id FROM pool) AND id NOT IN (SELECT id FROM uni WHERE is_archived) AND name_with_owner NOT IN (SELECT repo.name_with_owner FROM tools WHERE repo.name_with_owner IS NOT NULL)",
)(lambda s, d: (lambda u: corpus.pending_extraction(u, _pool(s, d), u.where("is_archived"), read_table(s, d, "tools")).select("id"))(dedup.first_by(read_table(s, d, "candidates"), ["id"], F.col("seq"))))
_query(
    "flt13_base_records",
    """SELECT tool_uid, scenario, '1.0' AS schema_version, 'v9' AS prompt_version, repo.name_with_owner AS repositorio, tool.name AS nome, 'j' AS juiz, NULL::VARCHAR AS status, NULL::DOUBLE AS latency_ms FROM tools, (VALUES ('description_only'), ('with_source')) s(scenario)""",
    "",
)(lambda s, d: records.base_records(read_table(s, d, "tools"), "j", "p", "m", "v9").select("tool_uid", "scenario", "schema_version", "prompt_version", F.col("repo.name_with_owner").alias("repositorio"), F.col("tool.name").alias("nome"), F.col("judge.id").alias("juiz"), "status", "latency_ms"))


_query("str01_uid_kept", "SELECT row_id FROM tools WHERE tool_uid = concat(repo.name_with_owner, '::', tool.qualified_name, '::', tool.source_location.file, ':', tool.source_location.start_line) || CASE WHEN regexp_matches(tool.sdk_pattern, '^(python.list_tools|(type|java)script.set_request_handler)_lowlevel$') THEN '::' || tool.name ELSE '' END", "")(
    lambda s, d: read_table(s, d, "tools").where(F.col("tool_uid") == keys.tool_uid_for(F.col("repo.name_with_owner"), F.col("tool.qualified_name"), F.col("tool.source_location.file"), F.col("tool.source_location.start_line"), F.col("tool.name"), F.col("tool.sdk_pattern"))).select("row_id")
)
