"""Session helpers shared by every operator: building a session, cutting lineage, sizing work."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "fiscalspark", cpus: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; on a cluster use the session that spark-submit gives."""
    n = cpus or os.cpu_count() or 4
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in the Python workers of the session, whatever their path; done once a context."""
    sc = spark.sparkContext
    if not getattr(sc, "_fiscalspark_shipped", False):
        root = Path(__file__).resolve().parent
        file = Path(tempfile.mkdtemp(prefix="fiscalspark-code-")) / "fiscalspark.zip"
        with zipfile.ZipFile(file, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(str(file))
        sc._fiscalspark_shipped = True
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: spark.checkpoint.dir where the cluster names one; an own folder only for a local session,
    whose machine is the whole cluster (tests)."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    folder = named or tempfile.mkdtemp(prefix="fiscalspark-checkpoint-")
    sc.setCheckpointDir(folder)
    return folder


def materialise(df: DataFrame) -> DataFrame:
    """Write df once to the shared checkpoint folder and read it from there: cuts lineage, survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like materialise, as a table in the shared checkpoint folder. For rounds that join a frame with itself: a checkpoint keeps the plan's
    estimate of its size, which such joins square each time until planning takes longer than the work; a table has its own size."""
    path = f"{checkpoint_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def width(spark: SparkSession) -> int:
    """Shuffle partitions of the session; the number of salts follows it."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores: a table of few small files would keep one core busy with work in
    Python. A table that has more files is left as it is, so what is moved here is small."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def spread_by(df: DataFrame, *cols: str) -> DataFrame:
    """df by the hash of the columns in as many partitions as the session shuffles into. The number is asked for by an expression
    of its own: a plain repartition by columns that df is grouped by already is dropped from the plan, and adaptive execution may
    then put small rows with much Python work before them into one task."""
    n = max(width(df.sparkSession), df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(n, F.xxhash64(*cols))


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; reads no more than rows + 1 of them."""
    return df.limit(rows + 1).count() <= rows


def fits(df: DataFrame, rows: int = 100_000, size: int = 64 << 20) -> bool:
    """Whether df has at most so many rows and bytes (as text), so that every task can hold it; reads no more than rows + 1 rows."""
    n, total = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()
    return n <= rows and total <= size


def hot_keys(df: DataFrame, on: list[str], parts: int) -> DataFrame | None:
    """Keys of df that hold more rows than one of ``parts`` tasks should have, None if there are none; at most 2 * parts of them. Null
    keys do not count. Keys are counted before the shuffle."""
    keyed = df.dropna(subset=on).select(*on)
    counts = keyed.groupBy(*on).agg(F.count("*").alias("_n"))
    total = keyed.count()
    found = counts.where(F.col("_n") > max(total // (2 * parts), 10_000)).drop("_n").collect()
    return df.sparkSession.createDataFrame(found, df.select(*on).schema) if found else None


def salted_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", broadcast_rows: int = 100_000, split: bool = True) -> DataFrame:
    """Equi-join that stays balanced when one key of ``big`` holds a large part of its rows.

    ``small`` is broadcast only if a count shows that it has at most ``broadcast_rows`` rows and 64 MB. Otherwise the keys of ``big``
    are counted, the rows of hot ones get a salt (hash of the whole row) and only their rows of ``small`` a copy per salt; all
    other keys are joined as they are; rows without key are spread. Without ``split`` no key is counted: for a ``big`` whose keys are few rows each or
    that costs too much to be read twice. ``how`` is inner, left or left_semi/left_anti seen from ``big``. Null keys match nothing.
    """
    if fits(small, broadcast_rows):
        return big.join(F.broadcast(small), on, how)
    n = min(32, width(big.sparkSession))
    hot = hot_keys(big, on, n) if split and n > 1 else None
    spread_out = F.pmod(F.xxhash64(*big.columns), F.lit(n)).cast("int")
    # rows without key meet nothing, so they can lie anywhere
    keyless = reduce(Column.__or__, [F.col(c).isNull() for c in on])
    if hot is None:
        left, right = big.withColumn("_salt", F.when(keyless, spread_out).otherwise(0)), small.withColumn("_salt", F.lit(0))
        return left.join(right, [*on, "_salt"], how).drop("_salt")
    marked = hot.withColumn("_hot", F.lit(True))
    left = big.join(F.broadcast(marked), on, "left").withColumn("_salt", F.when(F.col("_hot") | keyless, spread_out).otherwise(0)).drop("_hot")
    copies = F.when(F.col("_hot"), F.array(*[F.lit(i) for i in range(n)])).otherwise(F.array(F.lit(0)))
    right = small.join(F.broadcast(marked), on, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return left.join(right, [*on, "_salt"], how).drop("_salt")
