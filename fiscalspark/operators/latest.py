"""Latest row per key, and the loads that replace rows by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key with the largest order values (nulls least); of equal ones the largest row.

    One aggregation with partial results before the shuffle, so a key that is delivered very often costs one row a
    task. Null keys are keys like others; repeated rows count once; empty rows give none.
    """
    rest = [c for c in rows.columns if c not in keys and c not in order]
    best = F.max(F.struct(*order, *rest)).alias("_r")
    return rows.groupBy(*keys).agg(best).select(*[c if c in keys else F.col(f"_r.{c}").alias(c) for c in rows.columns])


def replace_by_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old without the keys that new brings, and new: the one load for partitions, tenders, grants, provisions and dates."""
    gone = new.select(*keys).distinct()
    match = [old[k].eqNullSafe(gone[k]) for k in keys]
    return old.join(gone, match, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_if_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old, and the rows of new whose key it lacks, one per key."""
    one = latest_by(new, keys, [])
    match = [one[k].eqNullSafe(old[k]) for k in keys]
    return old.unionByName(one.join(old.select(*keys), match, "left_anti"), allowMissingColumns=True)


def latest_block(rows: DataFrame, key: str, order: list[str], date: str) -> DataFrame:
    """Of each key the last run of consecutive rows with the same date: a photo is replaced by a later one as a whole.

    order gives the reading order of the rows. The run is numbered by a running count of date changes.
    """
    w = Window.partitionBy(key).orderBy(*order)
    block = F.sum(F.when(F.col(date).eqNullSafe(F.lag(date).over(w)) & F.lag(key).over(w).isNotNull(), 0).otherwise(1)).over(w)
    numbered = rows.withColumn("_block", block)
    top = F.max(F.struct(date, "_block")).over(Window.partitionBy(key))
    return numbered.withColumn("_top", top).where((F.col("_top._block") == F.col("_block")) & F.col("_top").getField(date).eqNullSafe(F.col(date))).drop("_block", "_top")
