"""Build and update of the warehouse from the raw folder (K-04 to K-16, K-19, Z-06).

raw/igae_mensual/<period>/…ANEXO I….xlsx, raw/placsp/<capture>/*.atom|zip, raw/bdns/<capture>/*.json,
raw/boe/<capture>/<day>/sumario*.xml and BOE-*.xml, raw/consejo_ministros/<capture>/**/*.html. A capture is named by its day.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fiscalspark.files import Files
from fiscalspark.plans import anchors, catalog, checks, resolve
from fiscalspark.session import materialise
from fiscalspark.sources import feeds, igae
from fiscalspark.store import Warehouse
from fiscalspark.tables import TABLES
from fiscalspark.validate import violations

#: Magnitudes that a source of execution covers, and the province of what is bound to none.
COVERS, NOWHERE = {"igae_anexo_i": "credito_inicial,credito_definitivo,orn"}, "NT"
SOURCES = ("placsp", "bdns", "boe", "consejo_ministros")
FACT = {"placsp": "fact_contratos", "bdns": "fact_subvenciones", "boe": "fact_boe_disposiciones", "consejo_ministros": "fact_acuerdos_cdm"}


class OrphanError(ValueError):
    """Facts stand under services that neither the seeds nor their own rows name."""


class ContractError(ValueError):
    """Rows are not what their table's contract asks for."""


def discover_periods(spark: SparkSession, raw: str) -> list[str]:
    """S-01: periods of the execution that are there, in order."""
    return [n for n in Files(spark).names(f"{raw}/igae_mensual", folders=True) if re.match(r"^\d{4}-\d{2}$", n)]


def discover_captures(spark: SparkSession, raw: str, source: str) -> list[str]:
    """S-01: captures of a source, in order of their days."""
    return [n for n in Files(spark).names(f"{raw}/{source}", folders=True) if re.match(r"^\d{4}-\d{2}-\d{2}$", n)]


def shaped(rows: DataFrame, table: str) -> DataFrame:
    """rows with the columns of the table, null where there is none; an error where its contract is broken."""
    schema = rows.sparkSession.createDataFrame([], TABLES[table].columns).schema
    out = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
    out = materialise(out)
    bad = violations(out, TABLES[table].contract).collect()
    if bad:
        raise ContractError(f"{table}: " + "; ".join(f"{r.regla} {r.columna} ({r.n})" for r in bad))
    return out


def derived_services(rows: DataFrame, known: DataFrame) -> DataFrame:
    """K-04: services of the rows (ejercicio, seccion_cod, servicio_cod, servicio_denominacion) that are not known, named by the smallest
    name they come with; OrphanError if one has none."""
    key = list(TABLES["dim_seccion_servicio"].key)
    new = materialise(rows.groupBy(*key).agg(F.min("servicio_denominacion").alias("servicio_denominacion")).join(known.select(*key).distinct(), key, "left_anti"))
    nameless = new.where("servicio_denominacion IS NULL").orderBy(*key).limit(20).collect()
    if nameless:
        raise OrphanError("no name for " + ", ".join(f"{r.ejercicio}/{r.seccion_cod}.{r.servicio_cod}" for r in nameless))
    return new.withColumn("seccion_denominacion", F.lit(None).cast("string")).withColumn("presupuesto", F.lit(None).cast("string")).withColumn("origen", F.lit("derivado_igae"))


def coherent(period: str):
    """Checks of a month's load: every rule of the engine that fails in the period, over the staged facts and services."""

    def check(tables: dict[str, DataFrame]) -> list[str]:
        g = checks.pools_of(tables["fact_ejecucion"].where(F.substring("periodo", 1, 4) == period[:4]), tables["dim_seccion_servicio"])
        return [f"{r.regla} {r.ambito}: {r.descuadres}" for r in checks.judged(g, [period]).where("estado = 'FAIL'").collect()]

    return check


def load_month(w: Warehouse, rows: DataFrame) -> int:
    """K-08: one period of one source: dimensions, facts in place of those of the period and source, labels of all facts, checks, one commit."""
    rows = materialise(rows.drop("path", "sheet", "pos"))
    cuts = rows.select("periodo", "fuente_cod").distinct().limit(3).collect()
    if len(cuts) != 1:
        raise ValueError(f"one period and source at a time: {[tuple(r) for r in cuts]}")
    period, source = cuts[0]
    year = int(period[:4])
    with_year = rows.withColumn("ejercicio", F.lit(year)).withColumn("provincia_cod", F.coalesce("provincia_cod", F.lit(NOWHERE))).withColumn("cobertura", F.lit(COVERS[source]))
    facts = shaped(with_year, "fact_ejecucion")
    services = w.read("dim_seccion_servicio")
    new = shaped(derived_services(with_year, services), "dim_seccion_servicio")
    label = services.where((F.col("ejercicio") == year) & (F.col("origen") == "seed_pge")).agg(F.min("presupuesto").alias("presupuesto"))
    months = label.select(F.lit(period).alias("periodo"), F.lit(year).alias("ejercicio"), F.lit(int(period[5:7])).alias("mes"), "presupuesto", F.last_day(F.lit(f"{period}-01").cast("date")).alias("fecha_fin"))
    programmes = facts.select("programa_cod", *[F.substring("programa_cod", 1, n).alias(c) for c, n in (("area", 1), ("politica", 2), ("grupo", 3))]).distinct()
    others = w.read("fact_ejecucion").where(~((F.col("periodo") == period) & (F.col("fuente_cod") == source)))
    labels = economics_of(others.unionByName(facts))
    dims = {"dim_seccion_servicio": (new, list(TABLES["dim_seccion_servicio"].key)), "dim_programa": (programmes, ["programa_cod"])}
    return w.load("fact_ejecucion", facts, checks=coherent(period), dims=dims, replaced={"dim_periodo": (months, ["periodo"]), "dim_economica": (labels, ["economica_cod"])})


def economics_of(facts: DataFrame) -> DataFrame:
    """K-06, K-07: economic codes and their two-digit ancestors, each with its most frequent label (the smallest of several)."""
    n = facts.where("aplicacion_denominacion IS NOT NULL").groupBy("economica_cod", "aplicacion_denominacion").agg(F.count("*").alias("n"))
    best = n.groupBy("economica_cod").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("aplicacion_denominacion").alias("l"))).alias("b")).select("economica_cod", F.col("b.l").alias("denominacion"))
    codes_ = facts.select("economica_cod").unionByName(facts.select(F.substring("economica_cod", 1, 2).alias("economica_cod"))).distinct()
    size = F.length("economica_cod")
    level = F.coalesce(*[F.when(size == k, v) for k, v in catalog.ECONOMIC_LEVEL.items()])
    return codes_.join(best, "economica_cod", "left").select("economica_cod", level.alias("nivel"), F.when(size > 1, F.substring("economica_cod", 1, 1)).alias("capitulo"), "denominacion")


def _targets(w: Warehouse) -> DataFrame:
    x = w.read("crosswalk").where("dir3_cod IS NOT NULL")
    return x.select(F.col("dir3_cod").alias("code"), F.col("ejercicio").alias("year"), F.struct("seccion_cod", "servicio_cod").alias("target"))


def _with_anchor(rows: DataFrame, w: Warehouse, key: list[str], code: str, day) -> DataFrame:
    """rows with the anchor of their unit (E-01)."""
    asked = rows.select(F.struct(*key).alias("id"), F.col(code).alias("code"), day.alias("day"), F.col("ejercicio").alias("year"))
    done = resolve.anchored_by(asked, w.read("dim_organica"), _targets(w)).select(*[F.col(f"id.{k}").alias(k) for k in key], "seccion_cod", "servicio_cod", "anclaje_dir3_cod", "anclaje_tipo", "anclaje_senal")
    return rows.join(done, key, "left")


def _by_section(rows: DataFrame, w: Warehouse, column: str) -> DataFrame:
    """rows with the section of the department that proposes (E-06)."""
    s = w.read("dim_seccion_servicio").where("seccion_denominacion IS NOT NULL").select(F.col("ejercicio").alias("y"), anchors.text.token_key("seccion_denominacion", "ministerio").alias("k"), "seccion_cod").where("k <> ''")
    index = s.groupBy("y", "k").agg(F.min("seccion_cod").alias("lo"), F.max("seccion_cod").alias("hi"))
    found = anchors.section_anchors(rows.select(F.col(column).alias("ministerio"), "ejercicio"), index).select(F.col("ministerio").alias("_m"), F.col("ejercicio").alias("_e"), "seccion_cod", "anclaje_tipo", "anclaje_senal")
    return rows.join(F.broadcast(found), rows[column].eqNullSafe(found["_m"]) & (rows["ejercicio"] == found["_e"]), "left").drop("_m", "_e")


def load_capture(w: Warehouse, raw: str, source: str, capture: str) -> int:
    """K-09 to K-12: one capture of a source: read, anchor, put in place of what it brings anew."""
    spark, path, table = w.spark, f"{raw}/{source}/{capture}", FACT[source]
    year = F.substring("periodo", 1, 4).cast("int")
    if source == "placsp":
        rows = feeds.read_contracts(spark, path, capture).withColumn("ejercicio", year)
        rows = _with_anchor(materialise(rows), w, ["licitacion_id", "lote_id"], "organo_dir3_cod", F.coalesce("fecha_adjudicacion", "fecha_actualizacion")).withColumn("fuente_cod", F.lit("placsp"))
    elif source == "bdns":
        rows = materialise(feeds.read_grants(spark, path, capture).withColumn("ejercicio", year))
        u = w.read("dim_organica").where("denominacion IS NOT NULL")
        form = anchors.text.normal("denominacion")
        units = u.where("fecha_fin IS NULL").select("dir3_cod", "ministerio_dir3_cod", "nivel_jerarquico", form.alias("un"), anchors.text.token_key("denominacion").alias("uk")).distinct()
        roots = u.where("nivel_jerarquico = 1").groupBy(form.alias("mn")).agg(F.min("dir3_cod").alias("mc"))
        state = anchors.text.normal("nivel1") == "estado"
        bodies = materialise(anchors.named_units(rows.where(state).select(F.col("nivel2").alias("level2"), F.col("nivel3").alias("level3")), units, roots).where("dir3_cod IS NOT NULL").select("level2", "level3", F.col("dir3_cod").alias("code")))
        coded = rows.withColumn("state", state).join(bodies, rows["nivel2"].eqNullSafe(bodies["level2"]) & (rows["nivel3"] == bodies["level3"]), "left").drop("level2", "level3").withColumn("code", F.when(F.col("state"), F.col("code")))
        rows = _with_anchor(coded, w, ["concesion_id"], "code", F.coalesce("fecha_concesion", "fecha_alta")).withColumn("fuente_cod", F.lit("bdns"))
        rows = rows.withColumn("anclaje_senal", F.when(~F.col("state"), "no_estatal").when(F.col("code").isNull(), "organo_no_resuelto").otherwise(F.col("anclaje_senal"))).withColumn("anclaje_tipo", F.when(~F.col("state"), "fuera_perimetro").otherwise(F.col("anclaje_tipo")))
    elif source == "boe":
        rows = _by_section(materialise(feeds.read_gazette(spark, (path, "sumario*.xml"), (path, "BOE-*.xml"), capture).withColumn("ejercicio", year)), w, "departamento")
    else:
        rows = _by_section(feeds.read_cabinet_capture(spark, f"{path}/*/*.html" if Files(spark).names(path, folders=True) else path, capture).withColumn("ejercicio", year), w, "ministerio")
    return w.load(table, shaped(rows, table))


def _loads(w: Warehouse, raw: str, periods: list[str], captures: dict[str, list[str]], captured: str | None) -> dict[str, int]:
    """Z-06: months, then captures of each source, oldest first, so that the newest wins."""
    done = {p: load_month(w, igae.read_month(w.spark, raw, p, captured or f"{p}-01")) for p in periods}
    for source, names in captures.items():
        for c in names:
            done[f"{source}@{c}"] = load_capture(w, raw, source, c)
    return done


def build(spark: SparkSession, raw: str, root: str, seeds: dict[str, DataFrame], captured: str | None = None) -> dict[str, int]:
    """K-15: everything anew from raw files and seeds, ascending. Returns the rows of each period and capture.

    The old warehouse is a product, not a source: it is removed. seeds: table to its rows.
    """
    Files(spark).remove(root)
    w = Warehouse(spark, root)
    w.init()
    for name, rows in seeds.items():
        w.load_seed(name, shaped(rows, name))
    return _loads(w, raw, discover_periods(spark, raw), {s: discover_captures(spark, raw, s) for s in SOURCES}, captured)


def update(spark: SparkSession, raw: str, root: str, seeds: dict[str, DataFrame], captured: str | None = None) -> dict[str, int]:
    """K-16: only periods that are not loaded and captures later than the last one loaded; a month that is there is never loaded again. Without
    warehouse it is a build."""
    w = Warehouse(spark, root)
    if not w.versions():
        return build(spark, raw, root, seeds, captured)
    for name, rows in seeds.items():
        w.load_seed(name, shaped(rows, name))
    loaded = {r.periodo for r in w.read("fact_ejecucion").where("fuente_cod = 'igae_anexo_i'").select("periodo").distinct().collect()}
    return _loads(w, raw, [p for p in discover_periods(spark, raw) if p not in loaded], {s: w.pending(FACT[s], discover_captures(spark, raw, s)) for s in SOURCES}, captured)


def read_seeds(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """S-26: seeds under folder, a CSV with header by table name."""
    fs = Files(spark)
    return {n: feeds.read_seed(spark, f"{folder}/{n}.csv", t.columns) for n, t in TABLES.items() if fs.exists(f"{folder}/{n}.csv")}


def write_seed(rows: DataFrame, path: str) -> None:
    """K-19: a seed as one CSV file with header, in the order of its columns; seeds are small reference lists."""
    rows.coalesce(1).write.mode("overwrite").csv(path, header=True)


def loaded_views(w: Warehouse, folder: str) -> str:
    """The warehouse's tables under the names that the queries read, as folder/<table>.parquet; returns the folder."""
    for name in w.versions():
        w.read(name).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return folder
