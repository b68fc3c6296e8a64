"""What changed between full snapshots: one aggregation over both sides' row hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fiscalspark.session import materialise, salted_join


def deliveries(rows: DataFrame) -> DataFrame:
    """(grp, num) with the latest delivery, the previous and the next num of the group.

    rows: grp, num, delivered. There is one row per snapshot, however large a snapshot is.
    """
    latest = rows.where("grp IS NOT NULL AND num IS NOT NULL").groupBy("grp", "num").agg(F.max("delivered").alias("delivered"))
    w = Window.partitionBy("grp").orderBy("num")
    return latest.withColumn("nxt", F.lead("num").over(w)).withColumn("first", F.lag("num").over(w).isNull())


def snapshot_changes(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Records added, removed or changed from each snapshot of a group to its next.

    rows: grp string, num int, delivered timestamp, the key columns and value string (null: not a proper value).
    Of several deliveries of a snapshot the latest counts alone; a snapshot that was not delivered is passed over;
    the first of a group is compared with none. A repeated row counts once; rows of one delivery and key with
    different values count by the largest. Null keys are keys like others. Result: grp, the keys, num (of
    the later snapshot) and cambio: 'alta', 'baja', or 'cambio' if both values are proper and differ. Empty rows give none.

    Every row is tagged as the new side of its own comparison and the old side of the next, and one aggregation by
    (grp, num, keys) classifies; its keys are as fine as the records, so no group or snapshot is hot.
    """
    d = materialise(deliveries(rows))
    own = salted_join(rows, d, ["grp", "num", "delivered"])
    sides = F.array(
        F.when(~F.col("first"), F.struct(F.col("num").alias("num"), F.lit(1).alias("new"))),
        F.when(F.col("nxt").isNotNull(), F.struct(F.col("nxt").alias("num"), F.lit(0).alias("new"))),
    )
    tagged = own.select("grp", *keys, value, F.explode(F.array_compact(sides)).alias("s"))
    new, old = F.col("s.new") == 1, F.col("s.new") == 0
    both = tagged.groupBy("grp", F.col("s.num").alias("num"), *keys).agg(
        F.max(F.when(new, 1)).alias("in_new"),
        F.max(F.when(old, 1)).alias("in_old"),
        F.max(F.when(new, F.col(value))).alias("v_new"),
        F.max(F.when(old, F.col(value))).alias("v_old"),
    )
    change = F.when(F.col("in_old").isNull(), "alta").when(F.col("in_new").isNull(), "baja").when(F.col("v_new") != F.col("v_old"), "cambio")
    return both.select("grp", *keys, "num", change.alias("cambio")).where("cambio IS NOT NULL")
