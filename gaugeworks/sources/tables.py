"""Reading the project's Parquet tables."""

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of the dataset folder; columns and filters are pushed into the scan by Catalyst."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
