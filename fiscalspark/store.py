"""Versioned Parquet warehouse with one atomic commit over several tables (K-01 to K-16), ledger and manifests (K-21 to K-23)."""

from __future__ import annotations

import hashlib
import json
import os
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fiscalspark.files import Files, Taken
from fiscalspark.operators.latest import insert_if_absent, replace_by_key
from fiscalspark.tables import TABLES

POINTER = "_pointer"
#: Key by which a load replaces rows of each fact.
REPLACED_BY = {name: list(t.replaced_by) for name, t in TABLES.items() if t.replaced_by}


class RejectedLoad(RuntimeError):
    """A check failed on the staged tables; nothing was committed."""


class ConcurrentLoad(RuntimeError):
    """Another load was committed since this one began; nothing was committed."""


class Warehouse:
    """Tables as numbered Parquet folders and pointer files, of which the last names the folders of each table.

    A load writes new folders beside the old ones, runs its checks on them, and only then writes the next pointer in one
    step, which fails if another writer has done so; a failed check leaves all tables as they were, dimensions too. No path is
    ever overwritten while it is read. A table that is replaced by period and source has a folder for each of them, and a load
    writes only those that it brings.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)

    def _number(self) -> int:
        found = [int(n[2:-5]) for n in self.files.names(f"{self.root}/{POINTER}", folders=False) if n.startswith("v=") and n.endswith(".json")]
        return max(found, default=0)

    def versions(self) -> dict[str, list[str]]:
        """Folders of each table, relative to the root."""
        n = self._number()
        return json.loads(self.files.read(f"{self.root}/{POINTER}/v={n}.json")) if n else {}

    def read(self, table: str) -> DataFrame | None:
        return self._read(self.versions().get(table))

    def _read(self, folders: list[str] | None) -> DataFrame | None:
        return self.spark.read.parquet(*[f"{self.root}/{f}" for f in folders]) if folders else None

    def init(self) -> None:
        """K-01: every table of the registry, empty where it is not there yet."""
        now = self.versions()
        lacking = {n: self.spark.createDataFrame([], t.columns) for n, t in TABLES.items() if n not in now}
        if lacking:
            self.commit(lacking)

    def commit(self, staged: dict[str, DataFrame], checks: Callable[[dict[str, DataFrame]], list[str]] | None = None, parts: dict[str, list[str]] | None = None) -> dict[str, list[str]]:
        """Write the tables as new folders, check them, and point to them; RejectedLoad names the failed checks.

        Of a table in parts (columns) only the parts that are staged are written; the other folders stay as they are.
        """
        number = self._number() + 1
        now = self.versions()
        # two loads that run at once write folders of different names, so the one that loses touches nothing of the other
        folder = f"v={number}-{uuid.uuid4().hex[:12]}"
        new = dict(now)
        for name, df in staged.items():
            by = (parts or {}).get(name)
            if not by:
                new[name] = [f"{name}/{folder}"]
                df.write.mode("overwrite").parquet(f"{self.root}/{new[name][0]}")
                continue
            kept = {f.rsplit("/", 1)[0]: f for f in now.get(name, [])}
            for row in df.select(*by).distinct().collect():
                label = f"{name}/" + ",".join(f"{c}={row[c]}" for c in by)
                kept[label] = f"{label}/{folder}"
                same = [F.col(c).eqNullSafe(F.lit(row[c])) for c in by]
                one = df.where(same[0] if len(same) == 1 else same[0] & same[1])
                one.write.mode("overwrite").parquet(f"{self.root}/{kept[label]}")
            new[name] = [f for k, f in sorted(kept.items()) if "=" in k.rsplit("/", 1)[-1]]
        failed = checks({name: self._read(new[name]) for name in staged}) if checks else []
        if failed:
            raise RejectedLoad("; ".join(failed))
        try:
            self.files.write(f"{self.root}/{POINTER}/v={number}.json", json.dumps(new, sort_keys=True), new=True)
        except Taken as e:
            raise ConcurrentLoad(f"{self.root} was changed by another load") from e
        return new

    def load(self, table: str, batch: DataFrame, required: list[str] = (), checks: Callable[[dict[str, DataFrame]], list[str]] | None = None, dims: dict[str, tuple[DataFrame, list[str]]] | None = None, replaced: dict[str, tuple[DataFrame, list[str]]] | None = None) -> int:
        """K-04 to K-13: replace the batch's keys in table, add the dimension rows it brings, check, commit. An empty batch changes nothing.

        required: columns that the batch has to have. dims: name to (rows, key); rows whose key is there already are left out.
        replaced: name to (rows, key); rows take the place of those of their key.
        """
        lacking = [c for c in required if c not in batch.columns]
        if lacking:
            raise ValueError(f"{table}: the batch lacks {', '.join(lacking)}")
        n = batch.count()
        if not n:
            return 0
        parts = TABLES[table].parts if table in TABLES else ()
        old = self.read(table)
        staged = {table: batch if old is None or parts else replace_by_key(old, batch, REPLACED_BY[table])}
        for name, (rows, key) in (dims or {}).items():
            known = self.read(name)
            staged[name] = rows if known is None else insert_if_absent(known, rows, key)
        for name, (rows, key) in (replaced or {}).items():
            known = self.read(name)
            staged[name] = rows if known is None else replace_by_key(known, rows, key)
        self.commit(staged, checks, {table: list(parts)} if parts else None)
        return n

    def load_seed(self, table: str, rows: DataFrame) -> None:
        """K-02: rows of a seed take the place of those of their key; the others stay, facts may refer to them."""
        old = self.read(table)
        self.commit({table: rows if old is None else replace_by_key(old, rows, list(TABLES[table].key))})

    def pending(self, table: str, captures: list[str]) -> list[str]:
        """K-14: captures (names that sort by day) after the last one loaded; a late one is passed over, as update does."""
        old = self.read(table)
        last = None if old is None else old.agg(F.max(F.col("fecha_captura").cast("string"))).first()[0]
        return [c for c in sorted(captures) if last is None or c > last]


def month_check(required: list[str]) -> Callable[[dict[str, DataFrame]], list[str]]:
    """Checks of an execution load: key columns without value, more obligations of a service and month than its appropriation."""

    def check(tables: dict[str, DataFrame]) -> list[str]:
        f = tables["fact_ejecucion"]
        bad = []
        if not f.where(" OR ".join(f"{c} IS NULL" for c in required)).isEmpty():
            bad.append("null key")
        s = f.groupBy("periodo", "seccion_cod", "servicio_cod").agg(F.sum("orn").alias("o"), F.sum("credito_definitivo").alias("c"))
        if not s.where("o > c + 0.5").isEmpty():
            bad.append("more obligations than appropriation")
        return bad

    return check


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """K-21: SHA-256 of every file under path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def digest_of(spark: SparkSession, path: str) -> tuple[str, dict[str, str]]:
    """Digest over the files under path by name and content, and the hash of each; a capture has few files."""
    rows = sorted((os.path.basename(r.path), r.sha256) for r in file_hashes(spark, path).collect())
    return hashlib.sha256("".join(f"{n}\0{h}\n" for n, h in rows).encode()).hexdigest(), dict(rows)


def write_manifest(spark: SparkSession, path: str, target: str) -> str:
    """Manifest of a capture and its digest; writing it again is no change, another content under its name is an error."""
    digest, files = digest_of(spark, path)
    body, fs = json.dumps({"digest": digest, "files": files}, sort_keys=True), Files(spark)
    if fs.exists(target):
        if fs.read(target) != body:
            raise ValueError(f"{target} holds another capture")
        return digest
    fs.write(target, body, new=True)
    return digest


class Ledger:
    """K-23: attempts, failures and successes by source in a JSON file; a failure keeps the last success."""

    def __init__(self, path: str, spark: SparkSession | None = None):
        self.path, self.files = path, Files(spark or SparkSession.getActiveSession())

    def read(self) -> dict:
        return json.loads(self.files.read(self.path)) if self.files.exists(self.path) else {}

    def note(self, source: str, state: str, **more) -> None:
        all_ = self.read()
        stamp = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
        all_[source] = all_.get(source, {}) | {state: {"at": stamp} | more}
        self.files.write(self.path, json.dumps(all_, sort_keys=True))
