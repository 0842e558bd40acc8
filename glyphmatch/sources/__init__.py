"""Reading tables: the parquet tables of a folder, with only the columns that are asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    found = spark.read.parquet(f"{folder}/{name}.parquet")
    return found.select(*columns) if columns else found
