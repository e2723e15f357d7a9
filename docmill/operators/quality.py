"""Rule-based quality filter, gates and input validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions.text import legal_hits, or_empty, strip, words

READER_COST = 0.03
MIN_CHARS, MIN_WORDS = 15, 3


def noise_reason(text: Column) -> Column:
    """Why a text has no substance, or null. The first rule that holds gives the reason."""
    low, n = F.lower(or_empty(text)), F.length(or_empty(text))
    has = lambda *w: F.lit(False) if not w else (low.contains(w[0]) | has(*w[1:]) if w[1:] else low.contains(w[0]))
    told = lambda head, tail="": F.concat(F.lit(head + " ("), n.cast("string"), F.lit(" chars)" + tail))
    return (
        F.when(n < 500, told("texto muy corto"))
        .when(has("art. 280", "articulo 280", "artículo 280") & (n < 2000), told("art. 280 CPCCN", " - certiorari sin fundamentacion"))
        .when(has("desestimase", "desestímase") & (n < 1500), told("desestimacion breve"))
        .when(has("desistimiento", "dase por desistido") & (n < 1500), told("desistimiento"))
        .when(has("caducidad de instancia") & (n < 1500), told("caducidad de instancia"))
    )


def split_quality(df: DataFrame, text_col: str = "texto") -> tuple[DataFrame, DataFrame]:
    """(substantive rows, noise rows with noise_reason)."""
    told = df.withColumn("noise_reason", noise_reason(F.col(text_col)))
    return told.where("noise_reason IS NULL").drop("noise_reason"), told.where("noise_reason IS NOT NULL")


def auto_inadmissible(noise: DataFrame) -> DataFrame:
    """An analysis record for each filtered row (caratula, tribunal, fecha, texto, score, source_id, id), without a reader."""
    have = set(noise.columns)
    col = lambda n, other: F.coalesce(F.col(n).cast("string"), F.lit(other)) if n in have else F.lit(other)
    n = F.length(or_empty(F.col("texto"))).cast("string")
    why = F.concat(F.lit("Pre-filtrado automatico: texto de "), n, F.lit(" caracteres. Sin contenido sustantivo (ruido procesal: art. 280, desestimacion, desistimiento o caducidad). No se envio a agente lector."))
    none = F.array().cast("array<string>")
    blank = ["doctrina_aplicada", "hechos_determinantes", "prueba_decisiva", "quantum", "votos", "estrategia", "argumento_clave", "agent_thinking", "reasoning"]
    return noise.select(
        col("caratula", "N/D").alias("caratula"), col("tribunal", "N/D").alias("tribunal"), col("fecha", "N/D").alias("fecha"), F.lit("inadmisible").alias("resultado"), none.alias("normas_citadas"),
        none.alias("precedentes_citados"), F.lit("pre-filtrado automatico").alias("via_procesal"), *(F.lit("").alias(c) for c in blank), why.alias("razon_resultado"),
        F.lit("Ninguna - fallo sin contenido de fondo.").alias("relevancia_cliente"), (F.coalesce(F.col("score").cast("double"), F.lit(0.0)) if "score" in have else F.lit(0.0)).alias("score"),
        F.coalesce(*(F.col(c).cast("string") for c in ("source_id", "id") if c in have), F.lit("")).alias("source_id"), or_empty(F.col("texto")).alias("original_texto"), F.lit(True).alias("auto_filtered"),
    )


def saving(noise: DataFrame) -> DataFrame:
    return noise.agg(F.count("*").alias("n_skipped"), (F.count("*") * READER_COST).alias("saved_usd"))


def ingest_gate(df: DataFrame, text_col: str = "texto", source_col: str = "source", exempt: str = "csjn", least: int = 500) -> DataFrame:
    """Rows of the exempt source and rows whose text has `least` characters; a row without a source isn't exempt."""
    return df.where((F.coalesce(F.col(source_col), F.lit("")) == exempt) | (F.length(or_empty(F.col(text_col))) >= least))


def validate_input(df: DataFrame, text_col: str, ask: Column | None = None) -> DataFrame:
    """Adds verdict: too_short (under 15 characters), few_words (under 3), accepted (two legal words or more), else by `ask` (a model's yes or no; accepted without one)."""
    text = strip(or_empty(F.col(text_col)))
    other = F.when(ask, "accepted").otherwise("rejected") if ask is not None else F.lit("accepted")
    verdict = F.when(F.length(text) < MIN_CHARS, "too_short").when(words(text) < MIN_WORDS, "few_words").when(legal_hits(text) >= 2, "accepted").otherwise(other)
    return df.withColumn("verdict", verdict)
