"""Column functions over Spanish official texts: normal form, token keys, amounts and classes. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented letters and the letters they are compared as.
ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"
#: Short forms at the front of a normalised name.
FRONT = {r"^d ?g\b": "direccion general", r"^direccion gral\b": "direccion general", r"^s de e\b": "secretaria de estado", r"^s ?gral\b": "secretaria general"}
#: Words without meaning of their own in names.
STOPWORDS = ("a", "al", "de", "del", "e", "el", "en", "la", "las", "los", "para", "y")
#: A figure in Spanish notation, and the currency behind it.
FIGURE = r"(\d{1,3}(?:\.\d{3})+(?:,\d+)?|\d+(?:,\d+)?)"
CURRENCY = r"\s*(?:de\s+)?(?:euros|€)"
#: Where a figure stands, and how much it can be trusted, in order of precedence.
AMOUNTS = (
    (r"(?iu)(?:importe|cuant[ií]a|valor\s+estimado)[^.;]{0,120}?" + FIGURE + CURRENCY, "alta"),
    (r"(?iu)\(" + FIGURE + r"\s*(?:€|euros)\)", "alta"),
    (r"(?iu)" + FIGURE + CURRENCY, "media"),
)
#: Classes of gazette provisions by their normalised title, in order of precedence.
GAZETTE = (
    ("credito_extraordinario", r"creditos? extraordinario"),
    ("suplemento_credito", r"suplementos? de credito"),
    ("transferencia_credito", r"transferencias? de credito"),
    ("subvencion_directa", r"concesion directa de (una |la |unas |las )?subvencion"),
    ("convocatoria_subvencion", r"^extracto|se convocan? .{0,40}(subvencion|ayudas)|convocatoria de (subvencion|ayudas)"),
    ("modificacion_credito", r"(ampliacion|generacion|incorporacion) de credito|modificacion .{0,40}credito"),
)
#: Classes of cabinet agreements by their normalised text, in order of precedence.
CABINET = (
    ("credito_suplemento", r"credito extraordinario|suplemento de credito"),
    ("transferencia_credito", r"transferencias? de credito"),
    ("subvencion", r"subvencion|ayudas"),
    ("convenio", r"^convenio( |$)"),
    ("norma", r"^(real decreto|reales decretos|proyecto de ley|anteproyecto)"),
    ("autorizacion_gasto", r"^acuerdo.*(gasto|contrat|celebracion|adquisicion|compromisos)"),
)
#: Organic level by the front of the normalised name.
ORGANIC = (
    ("MINISTERIO", r"^ministerio\b|^presidencia del gobierno$"),
    ("SECRETARIA_ESTADO", r"^secretaria de estado\b"),
    ("SUBSECRETARIA", r"^subsecretaria\b"),
    ("DIRECCION_GENERAL", r"^direccion general\b"),
    ("ORGANISMO", r"^(agencia estatal|organismo autonomo|entidad publica empresarial|entidad estatal|consejo superior de|autoridad portuaria)\b"),
)


def normal(c: Column | str) -> Column:
    """F-01: small letters without accents or punctuation, single blanks, short forms at the front written out."""
    t = F.regexp_replace(F.lower(F.translate(F.coalesce(_col(c), F.lit("")), ACCENTED, PLAIN)), r"\p{M}+", "")
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))
    for pattern, full in FRONT.items():
        t = F.regexp_replace(t, pattern, full)
    return t


def token_key(c: Column | str, *more: str) -> Column:
    """F-02: the distinct meaningful words of a normalised text in order, as one key for equi-joins."""
    stop = F.array(*[F.lit(w) for w in (*STOPWORDS, *more)])
    return F.array_join(F.array_sort(F.array_except(F.split(normal(c), " "), stop)), " ")


def figure(c: Column) -> Column:
    """Number from Spanish notation."""
    return F.regexp_replace(F.replace(c, F.lit("."), F.lit("")), ",", ".").try_cast("double")


def amount(c: Column | str) -> Column:
    """F-03: struct of the amount in a text and how much it can be trusted ('alta', 'media', 'sin_importe')."""
    # an array of all three, so that each pattern is searched once however often the result is used
    found = F.array(*[F.struct(F.regexp_extract(_col(c), p, 1).alias("f"), F.lit(trust).alias("t")) for p, trust in AMOUNTS])
    first = F.get(F.filter(found, lambda x: x["f"] != ""), F.lit(0))
    return F.struct(figure(first["f"]).alias("importe"), F.coalesce(first["t"], F.lit("sin_importe")).alias("confianza"))


def first_class(n: Column, classes: tuple[tuple[str, str], ...], other: str) -> Column:
    """Name of the first class whose pattern the normalised text holds; the text is normalised once for all of them."""
    named = F.transform(F.array(n), lambda v: F.coalesce(*[F.when(v.rlike(p), name) for name, p in classes], F.lit(other)))
    return F.get(named, F.lit(0))


def gazette_class(title: Column | str, official: Column | None = None) -> Column:
    """F-04: class of a gazette provision; the official type 63 is a call unless a class before it holds."""
    n = normal(title)
    found = first_class(n, GAZETTE, "otro")
    if official is None:
        return found
    return F.when((official == "63") & found.isin("otro", "modificacion_credito"), "convocatoria_subvencion").otherwise(found)


def cabinet_class(text: Column | str, personnel: Column | None = None) -> Column:
    """F-05: class of a cabinet agreement; what stands in the block of personnel matters is that."""
    found = first_class(normal(text), CABINET, "otro")
    return found if personnel is None else F.when(personnel, "personal").otherwise(found)


def organic_level(name: Column | str, depth: Column | str) -> Column:
    """F-06: struct of the organic level of a unit and the signal that gave it."""
    by_name = F.coalesce(*[F.when(normal(name).rlike(p), level) for level, p in ORGANIC])
    by_depth = F.when(_col(depth) == 1, "MINISTERIO")
    signal = F.when(by_name.isNotNull(), "denominacion").when(by_depth.isNotNull(), "profundidad").otherwise("sin_senal")
    return F.struct(F.coalesce(by_name, by_depth, F.lit("OTRO")).alias("nivel"), signal.alias("senal"))


#: Shapes of the tax numbers of persons and of bodies.
PERSON = r"^\*+\w+\*+$|^\d{8}[A-Z]$|^[XYZ]\d{7}[A-Z]$"
BODY = r"^[A-HJNP-SUVW]\d{7}[0-9A-J]$"


def beneficiary(c: Column | str) -> Column:
    """F-07: struct of tax number, name and kind of a beneficiary; without a tax number in front all is the name."""
    t = F.nullif(F.trim(_col(c)), F.lit(""))
    token, rest = F.substring_index(t, " ", 1), F.nullif(F.trim(F.regexp_replace(t, r"^\S+", "")), F.lit(""))
    person, body = token.rlike(PERSON), token.rlike(BODY)
    return F.struct(F.when(person | body, token).alias("nif"), F.when(person | body, rest).otherwise(t).alias("nombre"), F.when(person, "fisica").when(body, "juridica").alias("tipo"))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
