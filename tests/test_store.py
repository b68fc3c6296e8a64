from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fiscalspark.operators.latest import insert_if_absent, latest_block, latest_by, replace_by_key
from fiscalspark.store import Ledger, RejectedLoad, Warehouse, month_check, write_manifest
from fiscalspark.streaming.captures import replay, windowed_counts
from fiscalspark.validate import EXECUTION, GRANTS, violations

MONTH = "periodo string, fuente_cod string, seccion_cod string, servicio_cod string, programa_cod string, economica_cod string, credito_definitivo double, orn double, fecha_captura date"


def month(spark, period, orn, captured="2026-01-01"):
    return spark.createDataFrame([(period, "f", "01", "01", "911O", "22706", 120.0, orn, dt.date.fromisoformat(captured))], MONTH)


def content(df):
    return sorted((r.periodo, r.orn) for r in df.collect())


def test_load_is_idempotent_and_replaces_its_partition(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path))
    assert w.read("fact_ejecucion") is None
    for _ in range(2):
        assert w.load("fact_ejecucion", month(spark, "2026-01", 60.0)) == 1
    w.load("fact_ejecucion", month(spark, "2026-02", 70.0))
    w.load("fact_ejecucion", month(spark, "2026-01", 65.0))
    assert content(w.read("fact_ejecucion")) == [("2026-01", 65.0), ("2026-02", 70.0)]
    assert w.load("fact_ejecucion", month(spark, "2026-03", 1.0).limit(0)) == 0
    with pytest.raises(ValueError, match="lacks"):
        w.load("fact_ejecucion", month(spark, "2026-03", 1.0), required=["anclaje_tipo"])


def test_failed_check_leaves_everything_as_it_was(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path))
    dim = spark.createDataFrame([("01", "uno")], "seccion_cod string, nombre string")
    w.load("fact_ejecucion", month(spark, "2026-01", 60.0), dims={"dim": (dim, ["seccion_cod"])})
    before = w.versions()
    more = spark.createDataFrame([("02", "dos")], "seccion_cod string, nombre string")
    with pytest.raises(RejectedLoad):
        w.load("fact_ejecucion", month(spark, "2026-02", 60000.0), checks=month_check(["seccion_cod"]), dims={"dim": (more, ["seccion_cod"])})
    assert w.versions() == before
    assert content(w.read("fact_ejecucion")) == [("2026-01", 60.0)]
    assert w.read("dim").count() == 1
    assert w.pending("fact_ejecucion", ["2025-12-31", "2026-01-01", "2026-02-01"]) == ["2026-02-01"]


def test_replace_insert_latest(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int")
    new = spark.createDataFrame([("b", 5), ("c", 6), (None, 7)], "k string, v int")
    assert sorted(map(tuple, replace_by_key(old, new, ["k"]).collect()), key=repr) == sorted([("a", 1), ("b", 5), ("c", 6), (None, 7)], key=repr)
    assert sorted(map(tuple, insert_if_absent(old, new, ["k"]).collect()), key=repr) == sorted([("a", 1), ("b", 2), (None, 3), ("c", 6)], key=repr)
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "y"), ("a", None, "z"), (None, 1, "n")], "k string, o int, v string")
    assert sorted(((r.k, r.v) for r in latest_by(rows, ["k"], ["o"]).collect()), key=repr) == sorted([("a", "y"), (None, "n")], key=repr)
    assert latest_by(rows.limit(0), ["k"], ["o"]).collect() == []


def test_latest_block(spark):
    rows = spark.createDataFrame([("t", 1, "2024-01-01", "a"), ("t", 2, "2024-01-01", "b"), ("t", 3, "2024-02-01", "a"), ("t", 4, "2024-01-01", "z")], "k string, pos int, d string, lot string")
    got = latest_block(rows, "k", ["pos"], "d").collect()
    assert [(r.lot, r.d) for r in got] == [("a", "2024-02-01")]


def test_stream_replay_equals_batch(spark, tmp_path):
    src, schema = tmp_path / "in", month(spark, "2026-01", 1.0).schema
    w = Warehouse(spark, str(tmp_path / "wh"))
    month(spark, "2026-01", 60.0, "2026-02-01").write.parquet(str(src / "a"))
    args = (spark, str(src / "*"), schema, w, "fact_ejecucion", str(tmp_path / "cp"))
    replay(*args)
    month(spark, "2026-01", 61.0, "2026-03-01").unionByName(month(spark, "2026-02", 70.0, "2026-03-01")).coalesce(1).write.parquet(str(src / "b"))
    replay(*args)
    replay(*args)
    assert content(w.read("fact_ejecucion")) == [("2026-01", 61.0), ("2026-02", 70.0)]
    month(spark, "2026-02", 1.0, "2026-01-15").write.parquet(str(src / "late"))
    replay(*args)
    assert content(w.read("fact_ejecucion")) == [("2026-01", 61.0), ("2026-02", 70.0)]


def test_windowed_counts_on_a_stream(spark, tmp_path):
    ev = spark.createDataFrame([(dt.datetime(2024, 1, 1, h, 5), "click", 1.5) for h in (0, 0, 1)], "ts timestamp, event_type string, value double")
    ev.write.parquet(str(tmp_path / "e"))
    q = windowed_counts(spark.readStream.schema(ev.schema).parquet(str(tmp_path / "e"))).writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.table("w").collect()) == [1, 2]


def test_ledger_and_manifest(spark, tmp_path):
    led = Ledger(str(tmp_path / "l.json"))
    led.note("bdns", "exito", rows=3)
    led.note("bdns", "fallo", error="x")
    assert led.read()["bdns"]["exito"]["rows"] == 3
    (tmp_path / "cap").mkdir()
    (tmp_path / "cap" / "f.json").write_text("{}")
    first = write_manifest(spark, str(tmp_path / "cap"), str(tmp_path / "m.json"))
    assert write_manifest(spark, str(tmp_path / "cap"), str(tmp_path / "m.json")) == first
    (tmp_path / "cap" / "f.json").write_text("{1}")
    with pytest.raises(ValueError, match="another"):
        write_manifest(spark, str(tmp_path / "cap"), str(tmp_path / "m.json"))


def test_contracts_of_schemas(spark):
    good = month(spark, "2026-01", 1.0)
    assert violations(good, EXECUTION).collect() == []
    bad = good.withColumn("periodo", F.lit("2026-99")).withColumn("seccion_cod", F.lit(None).cast("string"))
    assert {(r.regla, r.columna, r.n) for r in violations(bad, EXECUTION).collect()} == {("forma", "periodo", 1), ("requerida", "seccion_cod", 1)}
    g = spark.createDataFrame([("1", "2026-01", "fisica"), ("1", "2026-01", "otra")], "concesion_id string, periodo string, beneficiario_tipo string")
    assert {(r.regla, r.n) for r in violations(g, GRANTS).collect()} == {("lista", 1), ("unica", 1)}
