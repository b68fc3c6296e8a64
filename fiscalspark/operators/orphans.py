"""References to records that do not exist: range-partitioned sorted parents, binary search by Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscalspark.session import at_most, materialise, ship, width

#: A parent entry is packed as key * DAY_SPAN + day, days counted from DAY_ZERO days before 1970.
DAY_SPAN, DAY_ZERO = 1 << 22, 1 << 20
FOREVER = 1 << 40
RESULT = "tabla string, clave string, periodo string, motivo string"


def parent_arrays(parents: DataFrame, rows_per_range: int) -> tuple[DataFrame, list[int]]:
    """Sorted arrays of the parents, one row per key range, and the lower bounds of the ranges after the first.

    parents has key long, desde date (known from) and hasta date (deleted on, null = alive). Rows without key or
    desde are no parents. First each (key, desde) is reduced to its latest end, so that one key has at most one
    entry a day however often it was delivered. Ranges hold about ``rows_per_range`` entries each.
    """
    day = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date")).cast("long") + DAY_ZERO
    entries = (
        parents.where("key >= 0 AND desde IS NOT NULL")
        .select((F.col("key") * DAY_SPAN + day(F.col("desde"))).alias("code"), F.coalesce(day(F.col("hasta")), F.lit(FOREVER)).alias("until"))
        .groupBy("code")
        .agg(F.max("until").alias("until"))
    )
    bounds: list[int] = []
    if not at_most(entries, rows_per_range):
        n = entries.count() // rows_per_range + 1
        cuts = entries.select(F.floor(F.col("code") / DAY_SPAN).cast("double").alias("k")).approxQuantile("k", [i / n for i in range(1, n)], 0.1 / n)
        bounds = sorted({int(c) for c in cuts})
    key = F.floor(F.col("code") / DAY_SPAN).cast("long")
    arrays = (
        entries.withColumn("rng", range_of(key, bounds))
        .groupBy("rng")
        .agg(F.sort_array(F.collect_list(F.struct("code", "until"))).alias("e"))
        .select("rng", F.col("e.code").alias("codes"), F.col("e.until").alias("until"))
    )
    return arrays, bounds


def range_of(key, bounds: list[int]):
    """Number of the range that holds key."""
    if not bounds:
        return F.lit(0)
    # halved range by range, so that a key is compared log2(ranges) times
    mid = len(bounds) // 2
    return F.when(key < bounds[mid], range_of(key, bounds[:mid])).otherwise(F.lit(mid + 1) + range_of(key, bounds[mid + 1 :]))


def prefix_max(codes: np.ndarray, until: np.ndarray) -> np.ndarray:
    """Running maximum of until within each key of the sorted codes."""
    if not len(codes):
        return until
    key = codes // DAY_SPAN
    group = np.cumsum(np.r_[0, key[1:] != key[:-1]]).astype(np.int64)
    lift = group * (FOREVER * 2)
    return np.maximum.accumulate(until + lift) - lift


def probe(codes: np.ndarray, until: np.ndarray, key: np.ndarray, day: np.ndarray) -> np.ndarray:
    """For each reference 0 (alive), 1 (inexistente), 2 (borrada) or 3 (tardia)."""
    if not len(codes):
        return np.ones(len(key), np.int8)
    at = np.searchsorted(codes, key * DAY_SPAN + day, side="right") - 1
    hit = (at >= 0) & (codes[np.maximum(at, 0)] // DAY_SPAN == key)
    alive = hit & (until[np.maximum(at, 0)] > day)
    later = np.minimum(at + 1, len(codes) - 1)
    known = hit | (codes[later] // DAY_SPAN == key)
    return np.where(alive, 0, np.where(hit, 2, np.where(known, 3, 1))).astype(np.int8)


REASONS = pa.array(["", "inexistente", "borrada", "tardia"])


def misses(batch: pa.RecordBatch, codes: np.ndarray, until: np.ndarray) -> pa.RecordBatch:
    """The references of batch without living parent."""
    key = batch.column("key").to_numpy(zero_copy_only=False)
    day = batch.column("day").to_numpy(zero_copy_only=False)
    found = probe(codes, until, key, day)
    kept = pa.array(np.flatnonzero(found))
    cols = [batch.column(c).take(kept) for c in ("tabla", "clave", "periodo")]
    return pa.RecordBatch.from_arrays([*cols, REASONS.take(pa.array(found).take(kept))], names=["tabla", "clave", "periodo", "motivo"])


def orphan_references(refs: DataFrame, parents: DataFrame, rows_per_range: int = 200_000, broadcast_rows: int = 200_000) -> DataFrame:
    """References that had no living parent when they were captured, with the reason.

    refs: tabla, clave, periodo string, key long, c date; one row per delivery. A record (tabla, clave) counts by
    its earliest c; rows without clave, key or c are left out. parents: key long, desde date, hasta date.
    Keys must be below 2**40; a negative key is a reference that cannot exist. Result: tabla, clave, periodo,
    motivo ('inexistente', 'borrada', 'tardia'). Empty refs give no rows, empty parents only 'inexistente'.
    Other columns of either table, whatever their names, are ignored.

    Parents become sorted arrays by key range and references are probed by binary search, an Arrow batch at a
    time. Arrays of at most ``broadcast_rows`` entries (counted) go to every task; larger ones are sent by range and
    salt, so that a range or key which holds a large part of the references is split over many tasks; only such ranges are
    copied. There is one row a range to count and to broadcast.
    """
    spark = ship(refs.sparkSession)
    record = (
        refs.where("clave IS NOT NULL AND key IS NOT NULL AND c IS NOT NULL")
        .groupBy("tabla", "clave")
        .agg(F.min(F.struct("c", "periodo", "key")).alias("r"))
        .select("tabla", "clave", "r.periodo", "r.key", (F.datediff("r.c", F.lit("1970-01-01").cast("date")).cast("long") + DAY_ZERO).alias("day"))
    )
    arrays, bounds = parent_arrays(parents, rows_per_range)
    if not bounds and at_most(parents.select("key", "desde", "hasta").distinct(), broadcast_rows):
        row = arrays.first()
        codes = np.array(row.codes if row else [], np.int64)
        sent = spark.sparkContext.broadcast((codes, prefix_max(codes, np.array(row.until if row else [], np.int64))))

        def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield misses(b, *sent.value)

        return record.mapInArrow(mapped, RESULT)
    n = width(spark)
    ranged = record.withColumn("rng", range_of(F.col("key"), bounds))
    # a range that holds more references than a task should is read by several, each of which gets its parents; others by one
    counts = ranged.groupBy("rng").agg(F.count("*").alias("c"))
    each = max(1, (counts.agg(F.sum("c")).first()[0] or 0) // (2 * n))
    salts = materialise(counts.select("rng", F.least(F.lit(n), F.floor(F.col("c") / each) + 1).cast("int").alias("salts")))
    left = ranged.join(F.broadcast(salts), "rng").select("rng", F.pmod(F.xxhash64("tabla", "clave"), "salts").cast("int").alias("salt"), F.lit(1).alias("kind"), "tabla", "clave", "periodo", "key", "day", F.lit(None).cast("array<long>").alias("codes"), F.lit(None).cast("array<long>").alias("until"))
    right = arrays.join(F.broadcast(salts), "rng").select("rng", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), *[F.lit(None).cast(t).alias(c) for c, t in (("tabla", "string"), ("clave", "string"), ("periodo", "string"), ("key", "long"), ("day", "long"))], "codes", "until")
    placed = left.unionByName(right).repartition(n, "rng", "salt").sortWithinPartitions("rng", "salt", "kind")

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        codes, until, place = none, none, None
        for b in batches:
            where = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("rng", "salt", "kind")])
            cuts = [0, *(np.flatnonzero((np.diff(where) != 0).any(axis=0)) + 1), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if tuple(where[:2, lo]) != place:
                    place, codes, until = tuple(where[:2, lo]), none, none
                if where[2, lo] == 0:
                    codes = b.column("codes")[lo].values.to_numpy(zero_copy_only=False)
                    until = prefix_max(codes, b.column("until")[lo].values.to_numpy(zero_copy_only=False))
                else:
                    yield misses(b.slice(lo, hi - lo), codes, until)

    return placed.mapInArrow(streamed, RESULT)


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans by table, period and reason."""
    return found.groupBy("tabla", "periodo", "motivo").agg(F.count("*").alias("n"))
