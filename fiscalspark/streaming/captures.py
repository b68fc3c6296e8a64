"""Captures as streams (T-01 to T-06): files that arrive in a folder are loaded once each, newest state per key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fiscalspark.operators.latest import latest_by
from fiscalspark.store import REPLACED_BY, Warehouse


def replay(spark: SparkSession, folder: str, schema: StructType, warehouse: Warehouse, table: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None, newest_only: bool = False) -> None:
    """Load all files of folder that have not been loaded into table, a batch at a time, and stop.

    Within a batch the row captured last of each key counts, then the batch replaces its keys in the table. The
    checkpoint remembers the files, so a second run loads only new ones. With newest_only a capture that is not later than the
    last one loaded is passed over, as an update does; else a late capture is loaded like others.
    """
    key = REPLACED_BY[table]

    def load(batch: DataFrame, _: int) -> None:
        rows = prepare(batch) if prepare else batch
        old = warehouse.read(table)
        if newest_only and old is not None:
            last = old.agg(F.max("fecha_captura")).first()[0]
            rows = rows.where(F.col("fecha_captura") > F.lit(last)) if last is not None else rows
        if old is not None and not newest_only:
            kept = old.select(*rows.columns).join(rows.select(*key).distinct(), key, "left_semi")
            rows = latest_by(rows.unionByName(kept), row_key(table, rows), ["fecha_captura"])
        else:
            rows = latest_by(rows, row_key(table, rows), ["fecha_captura"])
        warehouse.load(table, rows)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def row_key(table: str, rows: DataFrame) -> list[str]:
    """Key of a row of the table, finer than the key that a load replaces."""
    return {
        "fact_ejecucion": [c for c in ("periodo", "fuente_cod", "seccion_cod", "servicio_cod", "programa_cod", "economica_cod", "provincia_cod") if c in rows.columns],
        "fact_contratos": [c for c in ("licitacion_id", "lote_id") if c in rows.columns],
    }.get(table, REPLACED_BY[table])


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Extra, not part of the batch engine: events by type in tumbling windows with a watermark for late rows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("desde"), "event_type", "n", "total")
