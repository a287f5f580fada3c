"""Word lists in ``term count`` files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(term, count) of a space-separated frequency file; malformed lines are dropped."""
    return spark.read.csv(path, sep=" ", schema="term string, count long", mode="DROPMALFORMED").where("term is not null and count is not null")
