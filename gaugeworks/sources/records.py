"""Explicit schemas and JSON Lines readers of the project's records; nothing is inferred."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.facts import COMPONENTS, WITH, WITHOUT

CANDIDATE = (
    "id string, name_with_owner string, url string, description string, stargazer_count int, fork_count int, is_fork boolean, is_archived boolean, pushed_at string, created_at string, primary_language string, "
    "languages array<string>, topics array<string>, default_branch string, default_branch_oid string, license_spdx_id string, matched_signals array<string>"
)
LOCATION = "struct<file:string,start_line:int,end_line:int>"
DATASET_ROW = (
    "schema_version string, repo struct<name_with_owner:string,stargazer_count:int,primary_language:string>, tool struct<name:string,qualified_name:string,description:string,description_is_literal:boolean,sdk_pattern:string,"
    f"source_location:{LOCATION},loc:int,call_graph_depth:int,cyclomatic_complexity:int>, call_graph string, extraction_meta struct<extracted_at:string,extractor_version:string>"
)
_SCORE = "struct<score:int,reasoning:string>"
SCORES = "struct<" + ",".join(f"{c}:{_SCORE}" for c in ("purpose", "guidelines", "limitations", "parameter_explanation", "length_completeness", "examples")) + ">"
EVALUATION = (
    "schema_version string, prompt_version string, tool_uid string, repo struct<name_with_owner:string,stargazer_count:int,primary_language:string>, tool struct<name:string,qualified_name:string,description:string>, scenario string, "
    f"judge struct<id:string,provider:string,model_id:string,raw_model_version:string>, status string, scores {SCORES}, error_detail string, source_code_sha256 string, "
    "usage struct<input_tokens:int,output_tokens:int,cache_read_input_tokens:int>, latency_ms double, evaluated_at string"
)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON Lines with a fixed schema; blank lines are skipped, unreadable ones give null columns."""
    return spark.read.schema(schema).json(path)


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, CANDIDATE)


def read_dataset(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Dataset rows; `limit` is the reader's feature of stopping early, after the first rows by tool."""
    rows = read_jsonl(spark, path, DATASET_ROW)
    return rows if limit is None else rows.orderBy("tool_uid").limit(limit)


def read_evaluations(spark: SparkSession, path: str, judge: str | None = None, excluded: tuple[str, ...] = ()) -> DataFrame:
    """All evaluation files of a folder, or one judge's, without excluded judges."""
    rows = read_jsonl(spark, path, EVALUATION)
    if judge is not None:
        rows = rows.where(F.col("judge.id") == judge)
    return rows.where(~F.col("judge.id").isin(*excluded)) if excluded else rows


def read_repo_metadata(spark: SparkSession, root: str) -> DataFrame:
    """Metadata files under a root, with the path each came from."""
    return spark.read.schema(CANDIDATE + ", commit_sha string, cloned_at string").option("recursiveFileLookup", True).option("pathGlobFilter", "repo_meta.json").option("multiLine", True).json(root).withColumn("path", F.col("_metadata.file_path"))


def read_source_files(spark: SparkSession, root: str, extensions: list[str]) -> DataFrame:
    """file_path, body of source files under a root, excluded directories and tests left out.

    Bytes that are no UTF-8 become U+FFFD, one for each maximal broken part; the rest of the body stays.
    """
    from ..operators.corpus import source_file_filter

    glob = "*.{" + ",".join(extensions) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    relative = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + root.rstrip("/").replace("file:", "") + "/", "")
    rows = files.select(relative.alias("file_path"), F.col("content"))
    return source_file_filter(rows).select("file_path", F.make_valid_utf8(F.col("content").cast("string")).alias("body"))


def base_records(tools: DataFrame, judge_id: str, provider: str, model_id: str, prompt_version: str) -> DataFrame:
    """An evaluation row for every tool and scenario with nulls for what a judge will fill in."""
    null = lambda t: F.lit(None).cast(t)
    scores = "struct<" + ",".join(f"{c}:struct<score:int,reasoning:string>" for c in COMPONENTS) + ">"
    return tools.withColumn("scenario", F.explode(F.array(F.lit(WITHOUT), F.lit(WITH)))).select(
        F.lit("1.0").alias("schema_version"), F.lit(prompt_version).alias("prompt_version"), "tool_uid",
        F.struct("repo.name_with_owner", "repo.stargazer_count", "repo.primary_language").alias("repo"), F.struct("tool.name", "tool.qualified_name", "tool.description").alias("tool"), "scenario",
        F.struct(F.lit(judge_id).alias("id"), F.lit(provider).alias("provider"), F.lit(model_id).alias("model_id"), null("string").alias("raw_model_version")).alias("judge"),
        null("string").alias("status"), null(scores).alias("scores"), null("string").alias("error_detail"), null("string").alias("source_code_sha256"),
        null("struct<input_tokens:int,output_tokens:int,cache_read_input_tokens:int>").alias("usage"), null("double").alias("latency_ms"), null("string").alias("evaluated_at"),
    )
