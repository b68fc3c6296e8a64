"""Attributes as known at event time: periodic as-known snapshots plus change logs, replayed for each event day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiscalspark.session import materialise, salted_join

STATE = "array<struct<ini:date,cap:date,vid:bigint,fin:date>>"


def change_log(versions: DataFrame) -> DataFrame:
    """One row per unit: its deliveries, (ini, cap, vid, fin), repeated rows once.

    versions: unit string, ini date, fin date, cap date, vid long. Rows without unit, ini or cap say nothing and
    are left out. Of deliveries that share (unit, ini, cap) the largest vid counts. A unit has at most one entry
    for each pair of days, so the list stays small whatever the number of rows.
    """
    one = (
        versions.where("unit IS NOT NULL AND ini IS NOT NULL AND cap IS NOT NULL")
        .groupBy("unit", "ini", "cap")
        .agg(F.max(F.struct("vid", "fin")).alias("v"))
        .select("unit", F.struct("ini", "cap", F.col("v.vid").alias("vid"), F.col("v.fin").alias("fin")).alias("e"))
    )
    return one.groupBy("unit").agg(F.collect_list("e").alias("log"))


def latest_by_version(log: Column) -> Column:
    """log without the deliveries that a later one of the same version replaces, latest version first."""
    ordered = F.reverse(F.array_sort(log))
    zero = F.struct(F.lit(None).cast("date").alias("ini"), F.array().cast(STATE).alias("kept"))
    return F.aggregate(
        ordered,
        zero,
        lambda a, x: F.struct(x["ini"].alias("ini"), F.when(a["ini"] == x["ini"], a["kept"]).otherwise(F.concat(a["kept"], F.array(x))).alias("kept")),
        lambda a: a["kept"],
    )


def snapshots(log: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted (unit, since): the state known before that day, and the changes of the period after it.

    wanted: unit string, since date, until date (first day of the next period).
    """
    return (
        wanted.join(log, "unit")
        .withColumn("state", latest_by_version(F.filter("log", lambda x: x["cap"] < F.col("since"))))
        .withColumn("changes", F.filter("log", lambda x: (x["cap"] >= F.col("since")) & (x["cap"] < F.col("until"))))
        .drop("log")
    )


def as_known(events: DataFrame, versions: DataFrame, period: str = "quarter") -> DataFrame:
    """Each event with the version of its unit that was valid, as far as was known, on the event's day.

    events: id string, unit string, day date. versions: as for change_log. Of each version the latest delivery
    up to the day counts; it is valid if ini <= day and (fin null or >= day); of several the latest ini. Result:
    id, vid; one row per event that has a version. Events without unit or day have none; a repeated event (id,
    unit, day) counts once. Other columns are ignored. Empty tables give no rows.

    The answer depends on (unit, day) only: distinct pairs are resolved first, joined to the snapshot that begins
    their period, and only the period's changes are replayed. Snapshots and answers are written once each. In the join back a
    (unit, day) with a large part of the events is split by salt.
    """
    e = events.where("id IS NOT NULL AND unit IS NOT NULL AND day IS NOT NULL").select("id", "unit", "day").distinct()
    pairs = e.select("unit", "day").distinct().withColumn("since", F.date_trunc(period, "day").cast("date"))
    step = {"month": "INTERVAL 1 MONTH", "quarter": "INTERVAL 3 MONTH", "year": "INTERVAL 1 YEAR"}[period]
    wanted = pairs.select("unit", "since").distinct().withColumn("until", F.expr(f"CAST(since + {step} AS DATE)"))
    snap = materialise(snapshots(change_log(versions), wanted))
    replayed = latest_by_version(F.concat("state", F.filter("changes", lambda x: x["cap"] <= F.col("day"))))
    valid = F.filter(replayed, lambda x: (x["ini"] <= F.col("day")) & (x["fin"].isNull() | (x["fin"] >= F.col("day"))))
    answers = pairs.join(snap, ["unit", "since"]).select("unit", "day", F.get(valid, F.lit(0))["vid"].alias("vid")).where("vid IS NOT NULL")
    return salted_join(e, materialise(answers), ["unit", "day"]).select("id", "vid")
