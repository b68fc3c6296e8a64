"""Queries p1 and p6 to p9 over the public-budget tables and texts, with the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fiscalspark.functions import codes
from fiscalspark.llm import canonical, encode, leakage, match, truncation
from fiscalspark.session import materialise, salted_join
from fiscalspark.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "organo_canonico")
    top = entries.where("nivel = 2").select(F.lit(0).cast("long").alias("grp"), F.col("organo_id").alias("ref"), F.col("denominacion").alias("name"), F.col("siglas").alias("short"), F.array().cast("array<string>").alias("remark"))
    parents = entries.where("nivel = 2").select(F.col("organo_id").alias("grp"), F.array_compact(F.array("denominacion", "siglas")).alias("remark"))
    below = entries.where("nivel = 3").select(F.col("padre_id").cast("long").alias("grp"), F.col("organo_id").alias("ref"), F.col("denominacion").alias("name"), F.col("siglas").alias("short")).join(parents, "grp")
    rows = table(spark, sf_dir, "fact_subvenciones").where("concesion_id IS NOT NULL AND (nivel2 IS NOT NULL OR nivel3 IS NOT NULL)")
    spelt2 = materialise(top.groupBy(F.col("name").alias("nivel2")).agg(F.min("ref").alias("exact2")))
    spelt3 = materialise(entries.where("nivel = 3").select(F.col("denominacion").alias("nivel3")).distinct().withColumn("exact3", F.lit(True)))
    # what people typed, each once: the names are looked up here, and the grants are read only for the result
    typed = materialise(rows.select("nivel2", "nivel3").distinct())
    zero = F.lit(0).cast("long").alias("grp")
    typed2 = typed.select("nivel2").distinct().join(spelt2, "nivel2", "left_anti")
    map2 = canonical.map_values(typed2.select(zero, F.col("nivel2").alias("value")), top).select(F.col("value").alias("nivel2"), F.col("ref").alias("ref2"))

    def read(df: DataFrame) -> DataFrame:
        known = salted_join(salted_join(df, spelt2, ["nivel2"], "left"), map2, ["nivel2"], "left").withColumn("org2", F.coalesce("exact2", "ref2", F.lit(0)))
        return salted_join(known, spelt3, ["nivel3"], "left")

    pairs = read(typed).where("exact3 IS NULL AND org2 > 0").select(F.col("org2").alias("grp"), F.col("nivel3").alias("value"))
    map3 = canonical.map_values(pairs, below).select(F.col("grp").alias("org2"), F.col("value").alias("nivel3"), F.col("ref").alias("ref3"))
    grants = rows.groupBy("concesion_id").agg(F.max(F.struct("fecha_captura", "nivel2", "nivel3")).alias("r")).select("concesion_id", "r.nivel2", "r.nivel3")
    known = read(grants)
    both = salted_join(known, map3, ["org2", "nivel3"], "left")
    out = F.array(
        F.when(F.col("nivel2").isNotNull() & F.col("exact2").isNull(), F.struct(F.lit("nivel2").alias("campo"), F.col("org2").alias("organo_id"))),
        F.when(F.col("nivel3").isNotNull() & F.col("exact3").isNull(), F.struct(F.lit("nivel3").alias("campo"), F.coalesce("ref3", F.lit(0)).alias("organo_id"))),
    )
    return both.select("concesion_id", F.explode(F.array_compact(out)).alias("o")).select("concesion_id", "o.campo", "o.organo_id")


def p1_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_found(spark, sf_dir).groupBy("campo").agg(F.count("*").alias("n"), F.count_if(F.col("organo_id") == 0).alias("sin_entrada"))


def service_matches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The cascade's result for all rows of the crosswalk, the solved ones once for each rule, and the solved rows (id, known)."""
    cross = table(spark, sf_dir, "crosswalk_servicio_dir3")
    rows = cross.select(F.col("cruce_id").alias("id"), F.col("servicio_denominacion").alias("a"), F.col("dir3_denominacion").alias("b"), F.col("seccion_denominacion").alias("section"), F.col("localidad").alias("town"))
    units = table(spark, sf_dir, "dim_organica").select(codes.dir3("dir3_cod").alias("u"), F.col("denominacion").alias("name"), F.col("ministerio_denominacion").alias("section"), F.col("localidad").alias("town"))
    labelled = cross.where("dir3_cod IS NOT NULL").groupBy(F.col("cruce_id").alias("id")).agg(F.max(codes.dir3("dir3_cod")).alias("known"))
    return materialise(match.cascade(rows, units, labelled)), labelled


#: Confidence that a rule of p6 must have: more than a rule without labelled row, which has 1/2.
LEAST = 0.6


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.matched(*service_matches(spark, sf_dir), LEAST).select(F.col("id").alias("cruce_id"), F.col("u").alias("dir3_cod"))


def p6_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.matched(*service_matches(spark, sf_dir), LEAST).select(F.col("id").alias("cruce_id"), F.col("u").alias("dir3_cod"), F.col("rule").alias("regla"), F.round("confidence", 6).alias("confianza"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return encode.encode_corpus(docs).select(F.col("id").alias("doc_id"), "ids")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "evaluacion"))


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "evaluacion").select("item_id", "conjunto")
    hits = p8_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("documentos"))
    return items.join(hits, "item_id", "left").select("item_id", "conjunto", F.coalesce("documentos", F.lit(0)).alias("documentos"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated(table(spark, sf_dir, "documents"))


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncation_rates(table(spark, sf_dir, "documents"))


def p6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of each rule: labelled rows that judge it, those it has right, its confidence, and the pending rows it resolves."""
    found, labelled = service_matches(spark, sf_dir)
    used = found.join(labelled.select("id"), "id", "left_anti").groupBy("rule").agg(F.count("*").alias("pendientes"))
    j = match.rule_precision(found, labelled).join(used, "rule", "full")
    return j.select(F.col("rule").alias("regla"), F.coalesce("n", F.lit(0)).alias("juzgadas"), F.coalesce("right", F.lit(0)).alias("acertadas"), F.round(F.coalesce("confidence", F.lit(0.5)), 6).alias("confianza"), F.coalesce("pendientes", F.lit(0)).alias("pendientes"))


QUERIES = {f.__name__: f for f in (p1_found, p1_unmatched, p6_found, p6_confidence, p6_rules, p7_ids, p8_found, p8_items, p9_found, p9_rates)}
SQL: dict[str, str] = {}
