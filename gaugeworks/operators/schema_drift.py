"""Files whose schema drifts, read into one consistent table: rescue-column ingestion and a report of every change.

1. `ingest` enforces a target schema. A value goes to its typed column only if its JSON kind is the column's kind; every
   other value of the line (unknown path, other kind, null) is kept as JSON in `_rescued`, with its kind in
   `_rescued_kinds`, so nothing is lost and the shape of each line can be read back.
2. `drift_report` compares the paths of each file with those of the file before it in the same log.
3. `promote` approves rescued paths for target columns (renames found by the report, casts of other kinds) and replays
   the rescued values into the typed columns.

Defined results: lines that are no JSON object keep their row with `is_object` false and null columns, and add no path;
of a repeated key in an object the last counts; an empty object has no path; rows without a log or file name are
ingested but are in no file's report; files of equal time follow their names; repeated lines change nothing in the
report; an empty table gives an empty table and report. Path facts carry reserved names, so extra columns of the input
cannot clash with them.
"""

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

_TYPES = {"string": T.StringType(), "integer": T.LongType(), "float": T.DoubleType(), "boolean": T.BooleanType(), "array": T.StringType()}
_ARROW = {"string": pa.string(), "integer": pa.int64(), "float": pa.float64(), "boolean": pa.bool_(), "array": pa.string()}

#: The record formats of the project (evaluation and tool lines), path to JSON kind.
TARGET = {
    "schema_version": "string",
    "prompt_version": "string",
    "tool_uid": "string",
    "scenario": "string",
    "status": "string",
    "error_detail": "string",
    "source_code_sha256": "string",
    "latency_ms": "float",
    "evaluated_at": "string",
    "repo.name_with_owner": "string",
    "repo.stargazer_count": "integer",
    "repo.primary_language": "string",
    "tool.name": "string",
    "tool.qualified_name": "string",
    "tool.description": "string",
    "tool.description_is_literal": "boolean",
    "tool.sdk_pattern": "string",
    "tool.source_location.file": "string",
    "tool.source_location.start_line": "integer",
    "tool.source_location.end_line": "integer",
    "tool.loc": "integer",
    "tool.call_graph_depth": "integer",
    "tool.cyclomatic_complexity": "integer",
    "judge.id": "string",
    "judge.provider": "string",
    "judge.model_id": "string",
    "judge.raw_model_version": "string",
    "usage.input_tokens": "integer",
    "usage.output_tokens": "integer",
    "usage.cache_read_input_tokens": "integer",
    "extraction_meta.extracted_at": "string",
    "extraction_meta.extractor_version": "string",
    **{f"scores.{c}.{f}": k for c in ("purpose", "guidelines", "limitations", "parameter_explanation", "length_completeness", "examples") for f, k in (("score", "integer"), ("reasoning", "string"))},
}


def column_of(path: str) -> str:
    """The typed column of a target path."""
    return path.replace(".", "__")


def kind_of(v) -> str:
    """JSON kind: null, string, integer, float (written with a point or an exponent), boolean or array."""
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, int):
        return "integer"
    if isinstance(v, float):
        return "float"
    return "string" if isinstance(v, str) else "array"


def _no_constant(name: str):
    raise ValueError(name)


def parse_object(text) -> dict | None:
    """The JSON object of a line; None for everything else."""
    if text is None:
        return None
    try:
        v = json.loads(text, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return None
    return v if isinstance(v, dict) else None


def leaves(obj: dict) -> Iterator[tuple[str, object]]:
    """(path, value) of every value that is no object, without recursion."""
    stack = [("", obj)]
    while stack:
        prefix, o = stack.pop()
        for k, v in o.items():
            if isinstance(v, dict):
                stack.append((f"{prefix}{k}.", v))
            else:
                yield prefix + k, v


def _utf8(s: str) -> str:
    return s if s.isascii() else s.encode("utf-8", "replace").decode("utf-8")


#: Separates a path from a number, where a line holds the same path twice.
AGAIN = "\x01"

_KEEP = ["record_no", "log_name", "file_name", "file_time", "line_no"]


def ingest(raw: DataFrame, target: dict[str, str] = TARGET) -> DataFrame:
    """One row per line of `raw` (record_no, log_name, file_name, file_time, line_no, body) with typed and rescue columns."""
    schema = raw.select(*_KEEP).schema.add("is_object", "boolean")
    for p, k in target.items():
        schema = schema.add(column_of(p), _TYPES[k])
    schema = schema.add("_rescued", "string").add("_rescued_kinds", T.MapType(T.StringType(), T.StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            typed: dict[str, list] = {p: [None] * b.num_rows for p in target}
            is_object, rescued, kinds = [], [], []
            for i, text in enumerate(b.column("body").to_pylist()):
                obj = parse_object(text)
                is_object.append(obj is not None)
                rest, rest_kinds = {}, {}
                for p, v in leaves(obj) if obj is not None else ():
                    k = kind_of(v)
                    if target.get(p) == k and typed[p][i] is None and not (k == "integer" and not -(1 << 63) <= v < 1 << 63):
                        typed[p][i] = _utf8(v) if k == "string" else json.dumps(v) if k == "array" else v
                    else:
                        if p in rest:  # a key with a dot and a nested path of the same name: both are kept
                            p += f"{AGAIN}{len(rest)}"
                        rest[p], rest_kinds[_utf8(p)] = v, k
                rescued.append(_utf8(json.dumps(rest, ensure_ascii=False)) if rest else None)
                kinds.append(list(rest_kinds.items()))
            out = [b.column(k) for k in _KEEP] + [pa.array(is_object, pa.bool_())]
            out += [pa.array(typed[p], _ARROW[k]) for p, k in target.items()]
            out += [pa.array(rescued, pa.string()), pa.array(kinds, pa.map_(pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return raw.select(*_KEEP, "body").mapInArrow(run, schema)


def _rescued_map(c: str = "_rescued") -> Column:
    return F.from_json(F.col(c), "map<string,string>")


_KINDS = {"null": 0, "string": 1, "integer": 2, "float": 4, "boolean": 8, "array": 16}


def _path(key: Column) -> Column:
    return F.substring_index(key, AGAIN, 1)


def path_kinds(ingested: DataFrame, target: dict[str, str] = TARGET) -> DataFrame:
    """log_name, file_name, path, kinds: every path of every file with the set of its JSON kinds as bits (0: nulls only).

    Typed columns are one aggregate a column over the lines, spread out only per file; only rescued paths are exploded.
    """
    file = ["log_name", "file_name"]
    rows = ingested.where("is_object and log_name is not null and file_name is not null")
    seen = rows.groupBy(*file).agg(*(F.bool_or(F.col(column_of(p)).isNotNull()).alias(column_of(p)) for p in target))
    typed = seen.select(*file, F.explode(F.array_compact(F.array(*(F.when(F.col(column_of(p)), F.struct(F.lit(p).alias("path"), F.lit(_KINDS[k]).alias("kinds"))) for p, k in target.items())))).alias("f")).select(*file, "f.*")
    bit = F.element_at(F.create_map(*(x for k, n in _KINDS.items() for x in (F.lit(k), F.lit(n)))), F.col("kind"))
    rescued = rows.where(F.size("_rescued_kinds") > 0).select(*file, F.explode("_rescued_kinds").alias("key", "kind")).select(*file, _path(F.col("key")).alias("path"), bit.alias("kinds"))
    return typed.unionByName(rescued).groupBy(*file, "path").agg(F.bit_or("kinds").alias("kinds"))


def path_values(ingested: DataFrame, wanted: DataFrame, target: dict[str, str] = TARGET) -> DataFrame:
    """log_name, seq, tool, path, kind, value of the values that are not null of the `wanted` paths (log_name, file_name, seq, paths)."""
    tool = column_of("tool_uid")
    rows = ingested.where(F.col("is_object") & F.col(tool).isNotNull()).join(wanted, ["log_name", "file_name"])
    has = lambda p: F.array_contains("paths", p)
    typed = [F.when(F.col(column_of(p)).isNotNull() & has(F.lit(p)), F.struct(F.lit(p).alias("path"), F.lit(k).alias("kind"), F.col(column_of(p)).cast("string").alias("value"))) for p, k in target.items()]
    own = F.filter(F.map_entries("_rescued_kinds"), lambda e: (e["value"] != "null") & has(_path(e["key"])))
    rescued = F.transform(own, lambda e: F.struct(_path(e["key"]).alias("path"), e["value"].alias("kind"), F.element_at("_m", e["key"]).alias("value")))
    facts = F.concat(F.array_compact(F.array(*typed)), F.coalesce(rescued, F.array().cast("array<struct<path:string,kind:string,value:string>>")))
    return rows.withColumn("_m", _rescued_map()).select("log_name", "seq", F.col(tool).alias("tool"), F.explode(facts).alias("f")).select("log_name", "seq", "tool", "f.path", "f.kind", _short(_canonical(F.col("f.value"))).alias("value")).distinct()


def _canonical(value: Column) -> Column:
    """Equal for the same value in another kind: numbers by their value, with or without thousands commas."""
    number = F.regexp_replace(value, ",", "").try_cast("double")
    return F.coalesce(F.when(~F.isnan(number), number.cast("string")), value)


def file_order(rows: DataFrame) -> DataFrame:
    """log_name, file_name, seq: each named file with its place in its log by time (the name breaks ties)."""
    order = Window.partitionBy("log_name").orderBy("file_time", "file_name")
    named = rows.where("log_name is not null and file_name is not null")
    return named.groupBy("log_name", "file_name").agg(F.min("file_time").alias("file_time")).select("log_name", "file_name", F.row_number().over(order).alias("seq"))


def _short(value: Column) -> Column:
    """Long values by their digest, which keeps shuffles narrow."""
    return F.when(F.length(value) > 40, F.md5(value)).otherwise(value)


def drift_report(ingested: DataFrame, target: dict[str, str] = TARGET, min_match: float = 0.8, raw: DataFrame | None = None) -> DataFrame:
    """log_name, file_name, change_kind, old_path, new_path: the changes of each file against the one before it.

    A removed and an added path are one rename when at least `min_match` of the tools that have both carry on with the
    same value (compared across kinds); each path is in one rename at most, the one with most matching tools. A constant
    that goes on under another last name counts, whatever the number of tools, where neither path has another candidate;
    a constant boolean never does. Joins are on log, file, path and value, so no pair of unlike values is formed.

    Kinds are found per file first, by aggregates that combine where the lines lie; then only the values of paths that came
    or went are read. Lines meet the list of such paths of their file; files without any are left out. The small tables
    between (files, changes, those values, renames) are checkpointed.
    `raw` may name the rows the file order is read from without parsing.
    """
    ensure_checkpoint_dir(ingested.sparkSession)
    files = file_order(ingested if raw is None else raw).checkpoint()
    kind = F.col("kind")
    paths = path_kinds(ingested, target).join(files, ["log_name", "file_name"])
    # Each file's paths meet the next file's in one grouping: those of file s count as new in s and as old in s + 1.
    none = F.lit(None).cast("int")
    sides = paths.select("log_name", "path", F.explode(F.array(F.struct("seq", F.col("kinds").alias("new_kinds"), none.alias("old_kinds")), F.struct((F.col("seq") + 1).alias("seq"), none.alias("new_kinds"), F.col("kinds").alias("old_kinds")))).alias("s"))
    both = sides.select("log_name", "path", "s.*").groupBy("log_name", "seq", "path").agg(F.max("new_kinds").alias("new_kinds"), F.max("old_kinds").alias("old_kinds")).where("seq > 1")
    changes = (
        both.withColumn(
            "change_kind",
            F.when(F.col("old_kinds").isNull(), "added").when(F.col("new_kinds").isNull(), "removed").when((F.col("old_kinds") > 0) & (F.col("new_kinds") > 0) & (F.col("old_kinds") != F.col("new_kinds")), "retyped"),
        )
        .where("change_kind is not null")
        .join(files, ["log_name", "seq"])
        .select("log_name", "seq", "file_name", "path", "change_kind")
        .checkpoint()
    )
    gone = changes.where("change_kind = 'removed'").select("log_name", "seq", F.col("path").alias("old_path"))
    come = changes.where("change_kind = 'added'").select("log_name", "seq", F.col("path").alias("new_path"))
    # A removed path has its values in the file before. Only changes with a side to pair with can be renames.
    paired = gone.select("log_name", "seq").distinct().join(come.select("log_name", "seq").distinct(), ["log_name", "seq"])
    needed = gone.select("log_name", "seq", F.col("old_path").alias("path"), F.lit(1).alias("back")).unionByName(come.select("log_name", "seq", F.col("new_path").alias("path"), F.lit(0).alias("back"))).join(paired, ["log_name", "seq"], "left_semi")
    wanted = needed.select("log_name", (F.col("seq") - F.col("back")).alias("seq"), "path").groupBy("log_name", "seq").agg(F.collect_set("path").alias("paths")).join(files, ["log_name", "seq"])
    values = path_values(ingested, wanted, target).checkpoint()
    old = values.select("log_name", (F.col("seq") + 1).alias("seq"), F.col("path").alias("old_path"), "tool", "kind", "value").join(gone, ["log_name", "seq", "old_path"], "left_semi")
    new = values.select("log_name", "seq", F.col("path").alias("new_path"), "tool", "value").join(come, ["log_name", "seq", "new_path"], "left_semi")
    same = (
        old.join(new, ["log_name", "seq", "tool", "value"])
        .groupBy("log_name", "seq", "old_path", "new_path")
        .agg(F.countDistinct("tool").alias("same"), F.countDistinct("value").alias("n_values"), F.bool_or(kind == "boolean").alias("boolean"))
        .checkpoint()
    )
    common = (
        same.select("log_name", "seq", "old_path", "new_path")
        .join(old.select("log_name", "seq", "old_path", "tool").distinct(), ["log_name", "seq", "old_path"])
        .join(new.select("log_name", "seq", "new_path", "tool").distinct(), ["log_name", "seq", "new_path", "tool"])
        .groupBy("log_name", "seq", "old_path", "new_path")
        .agg(F.count(F.lit(1)).alias("common"))
    )
    leaf = lambda c: F.substring_index(F.col(c), ".", -1)
    strong = (F.col("n_values") > 1) | (leaf("old_path") == leaf("new_path"))
    rivals = lambda c: F.count(F.lit(1)).over(Window.partitionBy("log_name", "seq", c))
    pairs = (
        same.join(common, ["log_name", "seq", "old_path", "new_path"])
        .where((F.col("same") >= min_match * F.col("common")) & (strong | ~F.col("boolean")))
        .withColumn("only", (rivals("old_path") == 1) & (rivals("new_path") == 1))
        .where(strong | F.col("only"))
    )
    best = [F.desc("same"), (leaf("old_path") == leaf("new_path")).desc()]
    renames = (
        pairs.withColumn("a", F.row_number().over(Window.partitionBy("log_name", "seq", "old_path").orderBy(*best, "new_path")))
        .withColumn("b", F.row_number().over(Window.partitionBy("log_name", "seq", "new_path").orderBy(*best, "old_path")))
        .where("a = 1 and b = 1")
        .join(files, ["log_name", "seq"])
        .select("log_name", "seq", "file_name", "old_path", "new_path")
        .checkpoint()
    )
    used = renames.select("log_name", "seq", F.explode(F.array(F.struct(F.col("old_path").alias("path"), F.lit("removed").alias("change_kind")), F.struct(F.col("new_path").alias("path"), F.lit("added").alias("change_kind")))).alias("u")).select("log_name", "seq", "u.*")
    plain = changes.join(used, ["log_name", "seq", "path", "change_kind"], "left_anti").select(
        "log_name", "file_name", "change_kind", F.when(F.col("change_kind") == "added", "").otherwise(F.col("path")).alias("old_path"), F.when(F.col("change_kind") == "removed", "").otherwise(F.col("path")).alias("new_path")
    )
    return plain.unionByName(renames.select("log_name", "file_name", F.lit("renamed").alias("change_kind"), "old_path", "new_path"))


#: Distinct pairs of path names a schema may have been renamed through; far above any real schema, it bounds what is read to the driver.
MAX_RENAMES = 20_000


def approved_paths(report: DataFrame, target: dict[str, str] = TARGET) -> dict[str, list[str]]:
    """Target path -> the other paths its values were found under, following chains of renames.

    Only distinct pairs of names reach the driver; their number depends on the schema, not on the rows, and is checked.
    """
    pairs = report.where("change_kind = 'renamed'").select("old_path", "new_path").distinct().limit(MAX_RENAMES + 1).collect()
    if len(pairs) > MAX_RENAMES:
        raise ValueError(f"more than {MAX_RENAMES} distinct renames: paths are not a schema")
    links: dict[str, set[str]] = {}
    for r in pairs:
        links.setdefault(r.old_path, set()).add(r.new_path)
        links.setdefault(r.new_path, set()).add(r.old_path)
    out: dict[str, list[str]] = {}
    taken: set[str] = set()
    for t in target:
        seen, todo = {t}, [t]
        while todo:
            for q in sorted(links.get(todo.pop(), ())):
                if q not in seen and q not in target:
                    seen.add(q)
                    todo.append(q)
        out[t] = sorted(seen - {t} - taken)
        taken |= seen
    return out


def promote(ingested: DataFrame, approved: dict[str, list[str]], target: dict[str, str] = TARGET) -> DataFrame:
    """The consistent table: rescued values of approved paths, and castable values of the path itself, replayed into typed columns.

    `_rescued` keeps the original JSON; `_replayed` lists the paths whose values now have a typed column. A value that
    cannot be cast stays rescued only.
    """
    rows = ingested.withColumn("_m", _rescued_map())
    out, replayed = [], []
    for p, k in target.items():
        c, options = F.col(column_of(p)), []
        for q in [p, *approved.get(p, [])]:
            v = F.element_at("_m", F.lit(q))
            cast = v if k in ("string", "array") else F.regexp_replace(v, ",", "").try_cast("double").cast("long") if k == "integer" else F.regexp_replace(v, ",", "").try_cast(_TYPES[k])
            options.append(cast)
            replayed.append(F.when(c.isNull() & cast.isNotNull(), F.lit(q)))
        out.append(F.coalesce(c, *options).alias(column_of(p)))
    return rows.select(*_KEEP, "is_object", *out, "_rescued", F.array_distinct(F.array_compact(F.array(*replayed))).alias("_replayed"))
