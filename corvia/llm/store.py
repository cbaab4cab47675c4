"""Written tables of the library, and the given ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvia.sources.written import discard, materialise, shared_dir  # noqa: F401  for the operators


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
