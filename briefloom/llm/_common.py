"""Reading tables; the shared scratch folder is that of the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.store import drop, drop_since, mark, scratch_dir, stored

__all__ = ["drop", "drop_since", "mark", "read", "scratch_dir", "stored"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
