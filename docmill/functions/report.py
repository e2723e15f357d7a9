"""Texts for readers: the synthesis report, narratives of single analyses, parsed result pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docmill.functions.text import or_empty

# The sections of a synthesis report, in order: kind, heading, field, most entries.
SECTIONS = [
    ("text", "\nRECOMENDACIÓN ESTRATÉGICA:\n", "recomendacion_estrategica", 0), ("winners", "\nESTRATEGIAS EXITOSAS:", "estrategias_exitosas", 5), ("losers", "\nESTRATEGIAS QUE FRACASARON:", "estrategias_fracasadas", 3),
    ("text", "\nPATRÓN DE CASOS FAVORABLES:\n", "patron_factico_favorable", 0), ("text", "\nPATRÓN DE CASOS DESFAVORABLES:\n", "patron_factico_desfavorable", 0), ("inline", "\nNORMAS CLAVE: ", "normas_clave", 10),
    ("list", "\nPRECEDENTES PARA CITAR:", "precedentes_para_citar", 8), ("list", "\nPRUEBA NECESARIA:", "prueba_necesaria", 5), ("list", "\nRIESGOS:", "riesgos", 5), ("list", "\nCONTRADICCIONES JURISPRUDENCIALES:", "contradicciones", 5),
    ("known", "\nESTIMACIÓN DE MONTOS: ", "rango_quantum", 0), ("known", "PATRÓN DE COSTAS: ", "patron_costas", 0), ("list", "\nDISIDENCIAS RELEVANTES:", "disidencias_relevantes", 3),
]

# Outcomes as a narrative calls them, and its lines in order: start, field, end, the values that are left out.
OUTCOME_WORDS = {"favorable": "FAVORABLE al actor", "desfavorable": "DESFAVORABLE al actor", "parcial": "PARCIALMENTE favorable"}
NARRATIVE = [
    ("Llegó al tribunal por: ", "via_procesal", ".", ()), ("\nHechos decisivos: ", "hechos_determinantes", "", ()), ("\nDoctrina aplicada: ", "doctrina_aplicada", ".", ()), ("\nNormas invocadas: ", "normas_citadas", ".", ()),
    ("Precedentes citados: ", "precedentes_citados", ".", ()), ("\nEstrategia de la parte ganadora: ", "estrategia", "", ()), ("Argumento que convenció al tribunal: ", "argumento_clave", "", ()), ("\nPor qué se resolvió así: ", "razon_resultado", "", ()),
    ("Prueba decisiva: ", "prueba_decisiva", "", ("N/D",)), ("Montos/costas: ", "quantum", "", ("N/D",)), ("Votación: ", "votos", "", ("N/D", "unánime")), ("\nRelevancia para el caso del cliente: ", "relevancia_cliente", "", ()),
]


def _percent(c: Column) -> Column:
    return F.concat(F.round(c, 0).cast("long").cast("string"), F.lit("%"))


def _section(kind: str, head: str, c: Column, most: int) -> Column:
    if kind in ("text", "known"):
        return F.when(~or_empty(c).isin("", "N/D") if kind == "known" else or_empty(c) != "", F.concat(F.lit(head), c))
    some = F.slice(c, 1, most)
    if kind == "inline":
        return F.when(F.size(c) > 0, F.concat(F.lit(head), F.array_join(some, ", ")))
    if kind == "list":
        line = lambda x: F.concat(F.lit("  • "), x)
    else:
        tail = lambda x: F.concat(F.lit(", "), x["frecuencia"].cast("string"), F.lit(" casos)")) if kind == "winners" else F.lit(")")
        line = lambda x: F.concat(F.lit("  • "), x["estrategia"], F.lit(" (éxito: "), _percent(x["tasa_exito"]), tail(x))
    return F.when(F.size(c) > 0, F.concat_ws("\n", F.lit(head), F.transform(some, line)))


def synthesis_report(columns: list[str]) -> Column:
    """The report of a synthesis row; sections whose column is absent or empty are left out."""
    have = set(columns)
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string") if c in have else F.lit("0")
    stats = F.lit(None).cast("string")
    if "total_analizados" in have:
        counts = F.concat(F.lit("  Favorables: "), n("favorables"), F.lit(" | Desfavorables: "), n("desfavorables"), F.lit(" | Parciales: "), n("parciales"), F.lit(" | Inadmisibles: "), n("inadmisibles"))
        chance = F.concat(F.lit("  Probabilidad favorable: "), _percent(F.coalesce(F.col("porcentaje_favorable"), F.lit(0.0)) if "porcentaje_favorable" in have else F.lit(0.0)))
        stats = F.when(F.col("total_analizados") > 0, F.concat_ws("\n", F.concat(F.lit("ESTADÍSTICAS: "), n("total_analizados"), F.lit(" fallos analizados")), counts, chance))
    text = F.concat_ws("\n", stats, *(_section(kind, head, F.col(c), most) for kind, head, c, most in SECTIONS if c in have))
    return F.when(text != "", text).otherwise("Síntesis completada.")


def narrative(schema: dict[str, str]) -> Column:
    """An analysis told in sentences. schema: the types of the row's columns by name."""
    label = F.lit("INADMISIBLE (no entró al fondo)")
    for k, v in OUTCOME_WORDS.items():
        label = F.when(F.col("resultado") == k, v).otherwise(label)
    show = lambda c: F.array_join(c, ", ") if schema[c].startswith("array") else or_empty(F.col(c))
    lines = [F.when(~F.coalesce(show(c), F.lit("")).isin("", *skip), F.concat(F.lit(head), show(c), F.lit(end))) for head, c, end, skip in NARRATIVE if c in schema]
    first = F.concat(F.lit('Analicé "'), or_empty(F.col("caratula")), F.lit('" ('), or_empty(F.col("tribunal")), F.lit(", "), or_empty(F.col("fecha")), F.lit(")."))
    return F.concat_ws("\n", first, F.concat(F.lit("\nResultado: "), label, F.lit(".")), *lines)


def options(html: Column) -> Column:
    """(id, name) of every option in a form."""
    get = lambda i: F.regexp_extract_all(html, F.lit(r'value="([^"]+)"[^>]*>([^<]+)'), F.lit(i))
    return F.arrays_zip(get(1).alias("id"), get(2).alias("name"))


def result_total(html: Column) -> Column:
    """The number of results a page names, dots as thousands; null without one."""
    return F.replace(F.regexp_extract(or_empty(html), r"(\d[\d.]*)\s*resultado", 1), F.lit("."), F.lit("")).try_cast("long")
