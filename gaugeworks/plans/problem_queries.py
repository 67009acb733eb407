"""Queries of the core operators for skew, drift and nesting."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import nested_flatten, schema_drift, tree_aggregate
from ..sources.tables import read_table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return tree_aggregate.hot_keys(read_table(spark, d, "evaluations"))


def p2_results(spark: SparkSession, d: str) -> DataFrame:
    return tree_aggregate.key_results(read_table(spark, d, "evaluations"))


def p2_rounds(spark: SparkSession, d: str) -> DataFrame:
    """The same results from 300 chunks, which take three rounds."""
    return tree_aggregate.key_results(read_table(spark, d, "evaluations").repartition(300), chunks=300)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    raw = read_table(spark, d, "raw_records")
    return schema_drift.drift_report(schema_drift.ingest(raw), raw=raw)


def p5_table(spark: SparkSession, d: str) -> DataFrame:
    """All records in one consistent table."""
    raw = read_table(spark, d, "raw_records")
    rows = schema_drift.ingest(raw)
    return schema_drift.promote(rows, schema_drift.approved_paths(schema_drift.drift_report(rows, raw=raw)))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return nested_flatten.call_graph_links(read_table(spark, d, "tools"))


def p6_nodes(spark: SparkSession, d: str) -> DataFrame:
    return nested_flatten.call_graph_nodes(read_table(spark, d, "tools"))


def p6_locations(spark: SparkSession, d: str) -> DataFrame:
    return nested_flatten.location_table(read_table(spark, d, "tools"))


def p6_languages(spark: SparkSession, d: str) -> DataFrame:
    """Child table of the language lists of the collected repositories."""
    return nested_flatten.flatten_list_column(read_table(spark, d, "candidates"), ["seq"], "languages", "language")


QUERIES = {f.__name__: f for f in (p2_found, p2_results, p2_rounds, p5_found, p5_table, p6_found, p6_nodes, p6_locations, p6_languages)}

_P2 = """
    WITH k AS (
      SELECT 'repo' AS key_kind, regexp_replace(lower(repo.name_with_owner), '^\\s+|\\s+$', '', 'g') AS key_value, * FROM evaluations
      UNION ALL
      SELECT 'language', regexp_replace(lower(repo.primary_language), '^\\s+|\\s+$', '', 'g'), * FROM evaluations),
    v AS (SELECT *, CASE WHEN scores.purpose.score BETWEEN 1 AND 5 THEN scores.purpose.score END AS valid FROM k WHERE key_value IS NOT NULL)
    SELECT key_kind, key_value, count(*) AS n_rows, count(*)::DOUBLE / (SELECT count(*) FROM evaluations) AS share,
           count(*) FILTER (WHERE status = 'ok') AS n_ok, count(valid) AS n_scored, sum(valid)::DOUBLE / nullif(count(valid), 0) AS mean_score,
           min(valid) AS min_score, max(valid) AS max_score,
           count(*) FILTER (WHERE valid = 1) AS score_1, count(*) FILTER (WHERE valid = 2) AS score_2, count(*) FILTER (WHERE valid = 3) AS score_3,
           count(*) FILTER (WHERE valid = 4) AS score_4, count(*) FILTER (WHERE valid = 5) AS score_5, sum(usage.output_tokens)::BIGINT AS output_tokens
    FROM v GROUP BY key_kind, key_value"""

#: The report by recursion over JSON objects: leaves, kinds per file, changes, and renames by mutual best match.
_P5 = """
    WITH RECURSIVE lines AS (SELECT record_no, log_name, file_name, body::JSON AS j FROM raw_records WHERE json_valid(body) AND json_type(CASE WHEN json_valid(body) THEN body::JSON END) = 'OBJECT' AND log_name IS NOT NULL AND file_name IS NOT NULL),
    files AS (SELECT log_name, file_name, row_number() OVER (PARTITION BY log_name ORDER BY t, file_name) AS seq FROM (SELECT log_name, file_name, min(file_time) AS t FROM raw_records WHERE log_name IS NOT NULL AND file_name IS NOT NULL GROUP BY ALL)),
    tree AS (
      SELECT record_no, log_name, file_name, CASE WHEN json_type(j, '$.tool_uid') = 'VARCHAR' THEN j ->> '$.tool_uid' END AS tool, '' AS path, j FROM lines
      UNION ALL
      SELECT record_no, log_name, file_name, tool, CASE WHEN path = '' THEN k ELSE path || '.' || k END, json_extract(j, '$."' || k || '"')
      FROM (SELECT record_no, log_name, file_name, tool, path, j, unnest(json_keys(j)) AS k FROM tree WHERE json_type(j) = 'OBJECT')),
    facts AS (SELECT DISTINCT log_name, seq, tool, path, kind, coalesce(TRY_CAST(replace(v, ',', '') AS DOUBLE)::VARCHAR, v) AS value FROM (
      SELECT log_name, file_name, tool, path, CASE json_type(j) WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'float' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'NULL' THEN NULL ELSE 'integer' END AS kind, j ->> '$' AS v
      FROM tree WHERE json_type(j) <> 'OBJECT') JOIN files USING (log_name, file_name)),
    kinds AS (SELECT log_name, seq, path, coalesce(string_agg(DISTINCT kind, ',' ORDER BY kind), '') AS kinds FROM facts GROUP BY ALL),
    steps AS (SELECT a.log_name, a.seq, b.seq AS before, a.file_name FROM files a JOIN files b ON a.log_name = b.log_name AND b.seq = a.seq - 1),
    added AS (SELECT s.log_name, s.seq, s.file_name, k.path FROM steps s JOIN kinds k ON k.log_name = s.log_name AND k.seq = s.seq WHERE NOT EXISTS (SELECT 1 FROM kinds o WHERE o.log_name = s.log_name AND o.seq = s.before AND o.path = k.path)),
    removed AS (SELECT s.log_name, s.seq, s.file_name, k.path FROM steps s JOIN kinds k ON k.log_name = s.log_name AND k.seq = s.before WHERE NOT EXISTS (SELECT 1 FROM kinds o WHERE o.log_name = s.log_name AND o.seq = s.seq AND o.path = k.path)),
    retyped AS (SELECT s.log_name, s.file_name, k.path FROM steps s JOIN kinds k ON k.log_name = s.log_name AND k.seq = s.seq JOIN kinds o ON o.log_name = s.log_name AND o.seq = s.before AND o.path = k.path WHERE k.kinds <> '' AND o.kinds <> '' AND k.kinds <> o.kinds),
    vals AS (SELECT * FROM facts WHERE kind IS NOT NULL AND tool IS NOT NULL),
    old AS (SELECT r.log_name, r.seq, r.path AS old_path, v.tool, v.kind, v.value FROM removed r JOIN vals v ON v.log_name = r.log_name AND v.seq = r.seq - 1 AND v.path = r.path),
    new AS (SELECT r.log_name, r.seq, r.path AS new_path, v.tool, v.value FROM added r JOIN vals v ON v.log_name = r.log_name AND v.seq = r.seq AND v.path = r.path),
    same AS (SELECT log_name, seq, old_path, new_path, count(DISTINCT tool) AS same, count(DISTINCT value) AS n_values, bool_or(kind = 'boolean') AS is_boolean FROM old JOIN new USING (log_name, seq, tool, value) GROUP BY ALL),
    shared AS (SELECT o.log_name, o.seq, old_path, new_path, count(*) AS common FROM (SELECT DISTINCT log_name, seq, old_path, tool FROM old) o JOIN (SELECT DISTINCT log_name, seq, new_path, tool FROM new) n ON o.log_name = n.log_name AND o.seq = n.seq AND o.tool = n.tool GROUP BY ALL),
    cand AS (SELECT *, string_split(old_path, '.')[-1] = string_split(new_path, '.')[-1] AS leaf FROM same JOIN shared USING (log_name, seq, old_path, new_path) WHERE same >= 0.8 * common),
    fit AS (SELECT *, n_values > 1 OR leaf AS strong FROM cand WHERE n_values > 1 OR leaf OR NOT is_boolean),
    rival AS (SELECT *, count(*) OVER (PARTITION BY log_name, seq, old_path) = 1 AND count(*) OVER (PARTITION BY log_name, seq, new_path) = 1 AS alone FROM fit),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY log_name, seq, old_path ORDER BY same DESC, leaf DESC, new_path) AS a, row_number() OVER (PARTITION BY log_name, seq, new_path ORDER BY same DESC, leaf DESC, old_path) AS b FROM rival WHERE strong OR alone),
    renamed AS (SELECT log_name, seq, old_path, new_path FROM ranked WHERE a = 1 AND b = 1)
    SELECT log_name, file_name, 'renamed' AS change_kind, old_path, new_path FROM renamed JOIN files USING (log_name, seq)
    UNION ALL SELECT log_name, file_name, 'added', '', path FROM added x WHERE NOT EXISTS (SELECT 1 FROM renamed r WHERE r.log_name = x.log_name AND r.seq = x.seq AND r.new_path = x.path)
    UNION ALL SELECT log_name, file_name, 'removed', path, '' FROM removed x WHERE NOT EXISTS (SELECT 1 FROM renamed r WHERE r.log_name = x.log_name AND r.seq = x.seq AND r.old_path = x.path)
    UNION ALL SELECT log_name, file_name, 'retyped', path, path FROM retyped"""


def _held(x: str, times: int = 3) -> str:
    """SQL: JSON text in JSON strings as the JSON it holds, some levels deep; null where it holds none."""
    for _ in range(times):
        x = f"(CASE WHEN json_type({x}) = 'VARCHAR' THEN TRY_CAST(CASE WHEN json_valid({x} ->> '$') THEN {x} ->> '$' END AS JSON) ELSE {x} END)"
    return x


_INT = "CASE WHEN json_type(j, '$.{k}') IN ('UBIGINT', 'BIGINT', 'HUGEINT') THEN TRY_CAST(j ->> '$.{k}' AS BIGINT) END"
_BOOL = "CASE WHEN json_type(j, '$.{k}') = 'BOOLEAN' THEN (j ->> '$.{k}')::BOOLEAN END"
_TEXT = "CASE WHEN json_type(j, '$.{k}') = 'VARCHAR' THEN j ->> '$.{k}' END"
#: Every node with its path, by plain recursion over JSON.
_P6 = f"""
    WITH RECURSIVE texts AS (SELECT row_id, tool_uid, tool.source_location AS place, CASE WHEN json_valid(call_graph) THEN call_graph::JSON END AS j FROM tools),
    roots AS (SELECT row_id, tool_uid, {_held("j")} AS j FROM texts WHERE j IS NOT NULL),
    nodes AS (
      SELECT row_id, tool_uid, '0' AS node_path, NULL::VARCHAR AS parent_path, 0 AS position, 1 AS depth, j FROM roots WHERE json_type(j) = 'OBJECT'
      UNION ALL
      SELECT row_id, tool_uid, node_path || '.' || k, node_path, k::INTEGER, depth + 1, child FROM (
        SELECT row_id, tool_uid, node_path, depth, k, {_held("c")} AS child FROM (
          SELECT row_id, tool_uid, node_path, depth, k, json_extract(calls, '$[' || k || ']') AS c FROM (
            SELECT row_id, tool_uid, node_path, depth, calls, unnest(range(json_array_length(calls)::BIGINT)) AS k FROM (
              SELECT row_id, tool_uid, node_path, depth, CASE WHEN json_type(h) = 'OBJECT' THEN json_array(h) WHEN json_type(h) = 'ARRAY' THEN h END AS calls FROM (
                SELECT row_id, tool_uid, node_path, depth, {_held("json_extract(j, '$.calls')")} AS h FROM nodes))))) WHERE json_type(child) = 'OBJECT'),
    flat AS (SELECT row_id, tool_uid, node_path, parent_path, position, depth, {_INT.format(k="level")} AS level, {_BOOL.format(k="resolved")} AS resolved, {_BOOL.format(k="external")} AS external, {_BOOL.format(k="ambiguous")} AS ambiguous,
      {_TEXT.format(k="qualified_name")} AS qualified_name, {_TEXT.format(k="raw_call_text")} AS raw_call_text, {_held("json_extract(j, '$.source_location')")} AS l FROM nodes),
    full_nodes AS (SELECT * EXCLUDE (l, j), {_TEXT.format(k="file")} AS file, {_INT.format(k="start_line")} AS start_line, {_INT.format(k="end_line")} AS end_line, coalesce(json_type(j) = 'OBJECT', false) AS has_location FROM (SELECT *, l AS j FROM flat))
"""

ORACLE = {
    "p2_found": f"SELECT key_kind, key_value FROM ({_P2}) WHERE share >= 0.05",
    "p2_results": _P2,
    "p2_rounds": _P2,
    "p5_found": _P5,
    "p6_found": _P6 + "SELECT row_id, parent_path, node_path AS child_path FROM nodes WHERE parent_path IS NOT NULL",
    "p6_nodes": _P6 + "SELECT * FROM full_nodes",
    "p6_locations": _P6
    + """SELECT row_id, tool_uid, 'tool' AS owner_kind, NULL AS node_path, place.file AS file, place.start_line::BIGINT AS start_line, place.end_line::BIGINT AS end_line FROM texts WHERE place IS NOT NULL
        UNION ALL SELECT row_id, tool_uid, 'node', node_path, file, start_line, end_line FROM full_nodes WHERE has_location""",
    # Built on the same recursion; the query itself is among those of the corpus.
    "agg10_call_graph_resolucao": _P6
    + """SELECT CASE WHEN ambiguous THEN 'ambigua' WHEN resolved THEN 'resolvida' ELSE 'externa' END AS categoria, count(*) AS nos, count(*) FILTER (WHERE depth = 2) AS nivel_2, count(*) FILTER (WHERE depth = 3) AS nivel_3,
        count(*) * 100.0::DOUBLE / (SELECT count(*) FROM full_nodes WHERE depth > 1) AS percentual FROM full_nodes WHERE depth > 1 GROUP BY ALL""",
    "p6_languages": "SELECT seq, (unnest(range(len(languages))))::INTEGER AS position, unnest(languages) AS language FROM candidates",
}
