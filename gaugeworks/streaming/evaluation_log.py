"""The append-only evaluation log as a stream.

The log is read with an explicit schema and `availableNow`, so a run takes what is there and stops; the checkpoint keeps
what was read. Each micro-batch writes its own partition (by batch id), so a batch that is run again replaces itself and
the log is exact. Deduplication across batches uses a watermark on the time of ingestion; the exact rule (best status,
latest) is applied by the batch operator on read.
"""

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.dedup import first_by, status_rank


def read_log(spark: SparkSession, path: str, schema, fmt: str = "json", files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(path)


def checkpoint_path(root: str, query: str) -> str:
    """A checkpoint folder for the text of a query: a changed query starts anew instead of resuming stale state."""
    return f"{root}/{hashlib.sha256(query.encode()).hexdigest()[:16]}"


def append_batches(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Writes each micro-batch under its id, deduplicated within the batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        kept = first_by(batch.withColumn("__gw_judge", F.col("judge.id")), ["tool_uid", "scenario", "prompt_version", "__gw_judge"], status_rank(F.col("status")).desc(), F.coalesce("evaluated_at", F.lit("")).desc()).drop("__gw_judge")
        kept.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drop_duplicates_late(stream: DataFrame, keys: list[str], time: str = "ingested_at", delay: str = "3 days") -> DataFrame:
    """Each key once within the watermark; rows later than the delay may come again."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_status(stream: DataFrame, time: str = "ingested_at", size: str = "1 day", delay: str = "3 days") -> DataFrame:
    """Rows per status and window of time; windows close when the watermark has passed them."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, size), "status").agg(F.count(F.lit(1)).alias("n"))
