"""Sums of money, guarded ratios, shares and robust statistics as Column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def money(c: Column | str) -> Column:
    """Sum of amounts that does not depend on the order of the rows; null if all are null."""
    x = F.col(c) if isinstance(c, str) else c
    return F.sum(x.cast("decimal(18,2)")).cast("double")


def ratio(a: Column | str, b: Column | str, times: float = 1.0) -> Column:
    """a / b, null where b is null or 0."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return F.lit(times) * x / F.nullif(y, F.lit(0.0))


def concentration(rows: DataFrame, group: list[str], supplier: str, amount: str, top: int = 5) -> DataFrame:
    """Suppliers, total, Herfindahl index (0 to 10000) and share of the ``top`` largest suppliers of each group.

    First sums by (group, supplier), so that a group with a large part of the rows is reduced before its windows;
    equal amounts are ranked by supplier, which changes no share.
    """
    base = rows.where(F.col(supplier).isNotNull() & (F.col(amount) > 0)).groupBy(*group, supplier).agg(money(amount).alias("imp"))
    w = Window.partitionBy(*group)
    ranked = base.withColumn("total", F.sum(F.col("imp").cast("decimal(18,2)")).over(w).cast("double")).withColumn("rn", F.row_number().over(w.orderBy(F.desc("imp"), supplier)))
    share = F.col("imp") / F.col("total")
    return ranked.groupBy(*group).agg(
        F.count("*").alias("n_adjudicatarios"),
        F.max("total").alias("importe_total"),
        F.round(10000 * F.sum(share * share), 0).alias("hhi"),
        F.round(100 * F.sum(F.when(F.col("rn") <= top, share).otherwise(0.0)), 1).alias("pct_top"),
    )


def median_mad(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """n, median and median absolute deviation of the values of each group; null values do not count."""
    v = rows.where(F.col(value).isNotNull())
    med = v.groupBy(*group).agg(F.count("*").alias("n"), F.median(value).alias("mediana"))
    dev = v.join(med, group).withColumn("_d", F.abs(F.col(value) - F.col("mediana")))
    return dev.groupBy(*group).agg(F.first("n").alias("n"), F.first("mediana").alias("mediana"), F.median("_d").alias("mad"))
