"""Positions of rows within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Consecutive ids that are numbered together.
WIDTH = 1024
#: The column that says in which range a row is.
RANGE = "_range"


def in_ranges(df: DataFrame, group: str, by: str) -> DataFrame:
    """``df`` with each row's range, the rows of a range of a group together."""
    return df.withColumn(RANGE, F.floor(F.col(by) / WIDTH)).repartition(group, RANGE)


def numbered(df: DataFrame, group: str, by: str, name: str, groups: DataFrame | None = None) -> DataFrame:
    """``df`` with the 1-based position of each row in its group, by an integer that is unique in the group; only rows of
    ``groups`` (a column of them, none twice), if given.

    Ids are numbered within short ranges, and the ranges' sizes summed up: no task sorts a whole group.
    """
    ranged = df if RANGE in df.columns else df.withColumn(RANGE, F.floor(F.col(by) / WIDTH))
    sizes = ranged.groupBy(group, RANGE).agg(F.count("*").alias("_size"))
    sizes = sizes if groups is None else sizes.join(groups, group, "left_semi")
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.partitionBy(group).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_size")
    inside = F.row_number().over(Window.partitionBy(group, RANGE).orderBy(by))
    return ranged.withColumn("_inside", inside).join(before, [group, RANGE]).withColumn(name, (F.col("_inside") + F.col("_before")).cast("long")).drop(RANGE, "_inside", "_before")
