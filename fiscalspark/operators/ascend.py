"""Ascent along a hierarchy with validity in time: each distinct request climbs until it meets a target."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscalspark.session import materialise

#: Hops after which the climb stops; it also ends loops.
HOPS = 12


def nodes(versions: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per code: its versions, latest start first, and its target of each year.

    versions: code, parent, kind string, ini, fin date. targets: code, year int, target struct; the smallest target of a code
    and year counts. The lists of a code are bounded by the days and years there are.
    """
    v = versions.where("code IS NOT NULL").groupBy("code").agg(F.reverse(F.array_sort(F.collect_set(F.struct("ini", "fin", "parent", "kind")))).alias("versions"))
    t = targets.groupBy("code", "year").agg(F.min("target").alias("target")).groupBy("code").agg(F.collect_list(F.struct("year", "target")).alias("targets"))
    return v.join(t, "code", "full")


def ascend(requests: DataFrame, node: DataFrame, own: str, cut_every: int = 4) -> DataFrame:
    """requests (code, day, year) with end ('destino', 'propia', 'fin'), at (where it ended), known, covered and target.

    A code with a target in the year has arrived, before anything else is asked. Else its version valid on the day is
    needed (latest start of several; without day the open one); a version of a kind other than null or ``own`` ends the climb as
    'propia', a missing one or a root as 'fin'. Requests are taken once each, however many rows ask; every ``cut_every`` hops lineage is cut and
    only requests that are still on their way go on, none when all have arrived.
    """
    first = node.select(F.col("code"), F.col("versions").isNotNull().alias("known"))
    years = node.select(F.explode("targets").alias("t")).select(F.col("t.year").alias("year")).distinct().withColumn("covered", F.lit(True))
    state = requests.select("code", "day", "year").distinct().join(first, "code", "left").join(F.broadcast(years), "year", "left")
    kind = node.schema["targets"].dataType.elementType["target"].dataType
    state = state.select("code", "day", "year", F.coalesce("known", F.lit(False)).alias("known"), F.coalesce("covered", F.lit(False)).alias("covered"), F.col("code").alias("cur"), F.lit(None).cast("string").alias("end"), F.col("code").alias("at"), F.lit(None).cast(kind).alias("target"))
    side = materialise(node.select(F.col("code").alias("cur"), "versions", "targets"))
    done: list[DataFrame] = []
    for hop in range(HOPS):
        j = state.join(side, "cur", "left")
        hit = F.get(F.filter("targets", lambda x: x["year"] == F.col("year")), F.lit(0))["target"]
        valid = lambda x: F.when(F.col("day").isNull(), x["fin"].isNull()).otherwise((x["ini"] <= F.col("day")) & (x["fin"].isNull() | (x["fin"] >= F.col("day"))))
        ver = F.get(F.filter("versions", valid), F.lit(0))
        j = j.withColumn("hit", hit).withColumn("ver", ver)
        going = F.col("cur").isNotNull() & F.col("end").isNull()
        foreign = F.col("ver.kind").isNotNull() & (F.col("ver.kind") != own)
        up = F.when(F.col("ver.parent") != F.col("cur"), F.col("ver.parent"))
        end = F.when(F.col("hit").isNotNull(), "destino").when(F.col("ver").isNull(), "fin").when(foreign, "propia").when(up.isNull() | F.lit(hop == HOPS - 1), "fin")
        state = j.select(
            "code", "day", "year", "known", "covered",
            F.when(going & end.isNull(), up).alias("cur"),
            F.when(going, end).otherwise(F.col("end")).alias("end"),
            F.when(going, F.col("cur")).otherwise(F.col("at")).alias("at"),
            F.when(going & F.col("hit").isNotNull(), F.col("hit")).otherwise(F.col("target")).alias("target"),
        )
        if hop % cut_every == cut_every - 1:
            state = materialise(state)
            done.append(state.where("cur IS NULL"))
            state = state.where("cur IS NOT NULL")
            if state.isEmpty():
                break
    else:
        done.append(state)
    return reduce(DataFrame.unionByName, done).drop("cur")
