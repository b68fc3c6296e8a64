"""Registry of the warehouse's tables (K-01): columns, key, what a load replaces, and the contract that its rows must meet (Q-01)."""

from __future__ import annotations

from dataclasses import dataclass

from fiscalspark.validate import ADDENDA, AGREEMENTS, CONTRACTS, EXECUTION, GRANTS, PROVISIONS, SERVICES, UNITS, Contract


@dataclass(frozen=True)
class Table:
    """columns as DDL, key, columns by which a load replaces rows, columns by which the table lies in folders of its own."""

    columns: str
    key: tuple[str, ...]
    replaced_by: tuple[str, ...] = ()
    parts: tuple[str, ...] = ()
    contract: Contract = Contract()


_ANCHOR = "seccion_cod string, servicio_cod string, anclaje_dir3_cod string, anclaje_tipo string, anclaje_senal string"
TABLES = {
    "dim_fuente": Table("fuente_cod string, nombre string, velocidad string, periodicidad string", ("fuente_cod",)),
    "dim_periodo": Table("periodo string, ejercicio int, mes int, presupuesto string, fecha_fin date", ("periodo",)),
    "dim_seccion_servicio": Table("ejercicio int, seccion_cod string, servicio_cod string, seccion_denominacion string, servicio_denominacion string, presupuesto string, origen string", ("ejercicio", "seccion_cod", "servicio_cod"), contract=SERVICES),
    "dim_organica": Table("dir3_cod string, denominacion string, dir3_padre_cod string, ministerio_dir3_cod string, ministerio_denominacion string, nivel_jerarquico int, nivel_organico string, nivel_organico_senal string, tipo_entidad string, estado string, fecha_inicio date, fecha_fin date", ("dir3_cod", "fecha_inicio"), contract=UNITS),
    "crosswalk": Table("ejercicio int, seccion_cod string, servicio_cod string, dir3_cod string, match_tipo string, match_detalle string", ("ejercicio", "seccion_cod", "servicio_cod", "dir3_cod"), contract=ADDENDA),
    "dim_programa": Table("programa_cod string, area string, politica string, grupo string", ("programa_cod",)),
    "dim_economica": Table("economica_cod string, nivel string, capitulo string, denominacion string", ("economica_cod",)),
    "fact_ejecucion": Table(
        "periodo string, fuente_cod string, ejercicio int, seccion_cod string, servicio_cod string, programa_cod string, economica_cod string, provincia_cod string, aplicacion_denominacion string, credito_inicial double, credito_definitivo double, modificaciones double, comprometido double, orn double, pagos double, cobertura string, fecha_captura date",
        ("periodo", "fuente_cod", "seccion_cod", "servicio_cod", "programa_cod", "economica_cod", "provincia_cod"), ("periodo", "fuente_cod"), ("periodo", "fuente_cod"), EXECUTION,
    ),
    "fact_contratos": Table(
        "licitacion_id string, lote_id string, fuente_cod string, periodo string, ejercicio int, es_cabecera_expediente boolean, expediente_id string, estado_cod string, organo_id string, organo_id_esquema string, organo_dir3_cod string, organo_denominacion string, " + _ANCHOR + ", tipo_contrato_cod string, procedimiento_cod string, cpv_cod string, presupuesto_sin_iva double, presupuesto_con_iva double, valor_estimado double, importe_adjudicacion double, num_ofertas string, resultado_cod string, adjudicatario_id string, adjudicatario_nombre string, adjudicatario_es_pyme boolean, fecha_adjudicacion date, fecha_formalizacion date, fecha_actualizacion date, fecha_captura date",
        ("licitacion_id", "lote_id"), ("licitacion_id",), contract=CONTRACTS,
    ),
    "fact_subvenciones": Table(
        "concesion_id string, fuente_cod string, periodo string, ejercicio int, concesion_cod string, convocatoria_id string, convocatoria_cod string, convocatoria_titulo string, nivel1 string, nivel2 string, nivel3 string, codigo_invente string, " + _ANCHOR + ", instrumento string, importe double, ayuda_equivalente double, beneficiario_id string, beneficiario_nif string, beneficiario_nombre string, beneficiario_tipo string, tiene_proyecto boolean, url_br string, fecha_concesion date, fecha_alta date, fecha_captura date",
        ("concesion_id",), ("concesion_id",), contract=GRANTS,
    ),
    "fact_boe_disposiciones": Table("identificador string, periodo string, ejercicio int, fecha date, seccion_boe string, departamento string, titulo string, tipo_disposicion string, bdns_id string, importe double, importe_confianza string, texto_bruto string, seccion_cod string, anclaje_tipo string, anclaje_senal string, fecha_captura date", ("identificador",), ("identificador",), contract=PROVISIONS),
    "fact_acuerdos_cdm": Table("acuerdo_id string, periodo string, ejercicio int, fecha date, ministerio string, descripcion string, tipo_acuerdo string, importe double, importe_confianza string, seccion_cod string, anclaje_tipo string, anclaje_senal string, fecha_captura date", ("acuerdo_id",), ("fecha",), contract=AGREEMENTS),
}
