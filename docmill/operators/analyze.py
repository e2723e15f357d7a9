"""Aggregates over analyses: outcomes, strategies, norms, contradictions, precedents, report texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions.text import or_empty, year_of

OUTCOMES = ("favorable", "desfavorable", "parcial", "inadmisible")


def _is(outcome: str) -> Column:
    return F.col("resultado") == outcome


def outcome_counts(df: DataFrame) -> DataFrame:
    """n and the number of each outcome, in one row; other outcomes count in n alone."""
    return df.agg(F.count("*").alias("n"), *(F.count_if(_is(o)).alias(o) for o in OUTCOMES))


def favourable_all(df: DataFrame) -> DataFrame:
    """Share of favourable outcomes among all, in percent; 0 without rows."""
    return df.agg(F.round(100.0 * F.count_if(_is("favorable")) / F.greatest(F.count("*"), F.lit(1)), 1).alias("porcentaje_favorable"))


def favourable_on_merits(df: DataFrame) -> DataFrame:
    """As favourable_all(), without inadmissible ones; null if none is left."""
    return df.agg(F.round(F.try_divide(100.0 * F.count_if(_is("favorable")), F.count_if(~_is("inadmisible"))), 1).alias("porcentaje_favorable"))


def top_per_outcome(df: DataFrame, favourable: int = 3, unfavourable: int = 2, chars: int = 3000) -> DataFrame:
    """The best-scored rulings of both outcomes with their text's start; ties by input_rank. Each task keeps its best before they meet."""
    order = Window.partitionBy("resultado").orderBy(F.desc("score"), "input_rank")
    most = max(favourable, unfavourable)
    top = df.where(F.col("resultado").isin("favorable", "desfavorable")).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    top = top.where(F.col("place") <= F.when(_is("favorable"), favourable).otherwise(unfavourable))
    return top.withColumn("texto", F.substring(or_empty(F.col("texto")), 1, chars))


def best_per_outcome(df: DataFrame, columns: list[str]) -> DataFrame:
    """For each outcome the columns of its best-scored row; ties go to the earliest."""
    best = F.max_by(F.struct(*columns), F.struct(F.col("score"), -F.col("input_rank")))
    return df.groupBy("resultado").agg(best.alias("best")).select("resultado", *(F.col(f"best.{c}").alias(c) for c in columns))


def strategies(df: DataFrame, norms: str = "normas_citadas", example: str = "caratula") -> DataFrame:
    """By procedural route and doctrine: frequency, success rate, norms, an example, and the rank among winners (from 50 % on, best first) or losers (worst first).

    Norms are made distinct, with a partial step, before a group's list is gathered, so it grows with the different norms alone; strategy_norms() gives them as rows.
    """
    keys = ["via_procesal", "doctrina_aplicada"]
    cited = df.select(*(F.col(c).alias(f"__{c}") for c in keys), F.explode(norms).alias("__norm")).where("__norm IS NOT NULL").distinct()
    cited = cited.groupBy(*(f"__{c}" for c in keys)).agg(F.array_sort(F.collect_list("__norm")).alias("leyes_asociadas"))
    grouped = df.groupBy(*keys).agg(
        F.count("*").alias("frecuencia"), F.round(F.avg(_is("favorable").cast("double")) * 100, 1).alias("tasa_exito"),
        F.max_by(example, F.struct("score", -F.col("input_rank"))).alias("caso_ejemplo"),
    )
    same = F.expr(" AND ".join(f"{c} <=> __{c}" for c in keys))
    found = grouped.join(cited, same, "left").select(*grouped.columns, F.coalesce("leyes_asociadas", F.array().cast("array<string>")).alias("leyes_asociadas"))
    out = found.withColumn("exitosa", F.col("tasa_exito") >= 50)
    by = [F.when(F.col("exitosa"), -F.col("tasa_exito")).otherwise(F.col("tasa_exito")), F.desc("frecuencia"), "via_procesal", "doctrina_aplicada"]
    return out.withColumn("puesto", F.row_number().over(Window.partitionBy("exitosa").orderBy(*by)))


def strategy_norms(df: DataFrame, norms: str = "normas_citadas") -> DataFrame:
    """The norms of each procedural route and doctrine, one a row, and how many rulings cite them; no list of a group is gathered."""
    cited = df.select("via_procesal", "doctrina_aplicada", F.explode(F.array_distinct(norms)).alias("norma"))
    return cited.groupBy("via_procesal", "doctrina_aplicada", "norma").agg(F.count("*").alias("n"))


def norm_frequency(df: DataFrame, norms: str = "normas_citadas", outcome: str = "favorable") -> DataFrame:
    """How often each norm is cited by rulings of the outcome."""
    return df.where(_is(outcome)).select(F.explode(F.array_distinct(norms)).alias("norma")).groupBy("norma").agg(F.count("*").alias("n"))


def contradictions(df: DataFrame, norms: str = "normas_citadas") -> DataFrame:
    """Norms that rulings of both opposite outcomes cite, with the number of either and of the pairs between them; no pair is formed."""
    cited = df.where(F.col("resultado").isin("favorable", "desfavorable")).select("resultado", F.explode(F.array_distinct(norms)).alias("norma"))
    counted = cited.groupBy("norma").agg(F.count_if(_is("favorable")).alias("favorables"), F.count_if(_is("desfavorable")).alias("desfavorables"))
    return counted.where("favorables > 0 AND desfavorables > 0").withColumn("pares", F.col("favorables") * F.col("desfavorables"))


def precedents(df: DataFrame, k: int, as_of_year: int, cited: str = "precedentes_citados", supreme: Column | None = None) -> DataFrame:
    """The k most weighty precedents: one point a citation, half a point more from a supreme court, up to a point more the nearer the citing year."""
    year = year_of(F.col("fecha"))
    recent = F.when((year > 1900) & (year <= as_of_year), F.greatest(F.lit(0.0), 1 - (as_of_year - year) / 30)).otherwise(0.0)
    weight = 1 + recent + F.when(supreme, 0.5).otherwise(0.0) if supreme is not None else 1 + recent
    rows = df.select(weight.alias("w"), F.explode(F.array_distinct(cited)).alias("precedente"))
    return rows.groupBy("precedente").agg(F.count("*").alias("citas"), F.round(F.sum("w"), 6).alias("peso")).orderBy(F.desc("peso"), F.desc("citas"), "precedente").limit(k)


def first_of(*names: str) -> Column:
    """The first of several list columns that isn't null."""
    return F.coalesce(*(F.col(n) for n in names))


def reader_context(df: DataFrame) -> DataFrame:
    """position, block: a numbered block for each analysis, as a synthesiser reads them. Rows stay apart; join their blocks only for a small selection."""
    known = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def show(name: str, other: str = "N/D") -> Column:
        return F.coalesce(F.col(name), F.lit(other)) if name in known else F.lit(other)

    def many(*names: str) -> Column:
        own = [n for n in names if n in known]
        return F.coalesce(F.nullif(F.array_join(first_of(*own), ", "), F.lit("")), F.lit("N/D")) if own else F.lit("N/D")

    # The labels of a block, in their order.
    fields = [
        ("Resultado", show("resultado")),
        ("Vía procesal", show("via_procesal")),
        ("Normas", many("normas_citadas", "leyes_citadas")),
        ("Precedentes", many("precedentes_citados")),
        ("Doctrina", show("doctrina_aplicada")),
        ("Hechos determinantes", show("hechos_determinantes")),
        ("Prueba decisiva", show("prueba_decisiva")),
        ("Quantum/costas", show("quantum")),
        ("Votos", show("votos")),
        ("Estrategia", show("estrategia", "")),
        ("Argumento clave", show("argumento_clave", "")),
        ("Razón resultado", show("razon_resultado", "")),
        ("Relevancia cliente", show("relevancia_cliente", "")),
    ]
    head = F.concat(F.lit("["), F.col("input_rank").cast("string"), F.lit("] "), F.concat_ws(" — ", show("caratula"), show("tribunal", ""), show("fecha", "")))
    return df.select(F.col("input_rank").alias("position"), F.concat_ws("\n  ", head, *(F.concat(F.lit(f"{n}: "), c) for n, c in fields)).alias("block"))


def key_texts(df: DataFrame, favourable: int = 3, unfavourable: int = 2, chars: int = 3000) -> DataFrame:
    """resultado, place, section: the texts of the best-scored rulings of both outcomes, each under its heading; rulings without a text have none."""
    top = top_per_outcome(df, favourable, unfavourable, chars).where("texto <> ''")
    head = F.concat(F.lit("\n\n--- FALLO COMPLETO ("), F.upper("resultado"), F.lit("): "), F.coalesce("caratula", F.lit("N/D")), F.lit(" ---\n"))
    return top.select("resultado", "place", F.concat(head, "texto", F.lit("\n")).alias("section"))


def fallback_synthesis(df: DataFrame) -> DataFrame:
    """One row: what a synthesis says where no synthesiser answered, from the counts alone."""
    share = F.round(100.0 * F.count_if(_is("favorable")) / F.greatest(F.count("*"), F.lit(1)), 1)
    none = F.array().cast("array<string>")
    told = F.concat(F.lit("De "), F.greatest(F.count("*"), F.lit(1)).cast("string"), F.lit(" fallos analizados, "), F.count_if(_is("favorable")).cast("string"), F.lit(" fueron favorables ("), share.cast("string"), F.lit("%)."))
    return df.agg(
        share.alias("porcentaje_favorable"),
        *(none.alias(n) for n in ("estrategias_exitosas", "estrategias_fracasadas", "leyes_clave")),
        F.array(F.lit("Error en síntesis — se muestran estadísticas básicas")).alias("riesgos"),
        told.alias("recomendacion_estrategica"),
    )


def drafting_context(hits: DataFrame, k: int = 5) -> DataFrame:
    """One row: the first k hits (input_rank, caratula, tribunal, fecha, resumen, cita_textual) as a numbered list, or a sentence that there are none."""
    line = F.concat(F.lit("\n"), F.col("input_rank").cast("string"), F.lit(". "), "caratula", F.lit(" ("), "tribunal", F.lit(", "), "fecha", F.lit(")\n   Resumen: "), "resumen", F.lit('\n   Cita: "'), "cita_textual", F.lit('"\n'))
    top = hits.orderBy("input_rank").limit(k).agg(F.array_sort(F.collect_list(F.struct("input_rank", line.alias("line")))).alias("x"))
    text = F.array_join(F.transform("x", lambda s: s["line"]), "")
    return top.select(F.coalesce(F.nullif(text, F.lit("")), F.lit("(No se encontró jurisprudencia específica. NO cites fallos inventados.)")).alias("contexto"))


def match_by_position(results: DataFrame, analyses: DataFrame) -> DataFrame:
    """Results (input_rank from 0) with the analysis of their index; analyses out of range or marked irrelevant fall out, a missing index counts as 0."""
    told = analyses.where(F.coalesce(F.col("relevante"), F.lit(True))).withColumn("__at", F.coalesce("index", F.lit(0)))
    return results.join(told, results["input_rank"] == told["__at"]).drop("__at")


def fallback_summary(hits: DataFrame) -> DataFrame:
    """Adds resumen (the summary's or the text's first 200 characters) and argumento (the title)."""
    start = lambda c: F.nullif(F.substring(or_empty(F.col(c)), 1, 200), F.lit(""))
    return hits.withColumn("resumen", F.coalesce(start("sumario"), start("texto"), F.lit(""))).withColumn("argumento", or_empty(F.col("caratula")))


#: The fields of a ruling's summary.
SUMMARY = "hechos string, cuestion_juridica string, argumentos_actor string, argumentos_demandado string, resolucion string, doctrina_aplicada string, articulos_citados array<string>"


def ruling_summary(df: DataFrame, answer: Column) -> DataFrame:
    """Adds summary, the fields of SUMMARY read from a summariser's answer in JSON; an answer that is null or no JSON object gives a summary that says so, fields that are missing are empty."""
    read = F.from_json(answer, SUMMARY)
    good = F.coalesce(F.schema_of_variant(F.try_parse_json(answer)).startswith("OBJECT"), F.lit(False))
    texts = [c.split()[0] for c in SUMMARY.split(", ")[:-1]]
    fields = [F.when(good, F.coalesce(read[c], F.lit(""))).otherwise("Error al procesar el fallo" if c == "hechos" else "").alias(c) for c in texts]
    cited = F.when(good, read["articulos_citados"])
    return df.withColumn("summary", F.struct(*fields, F.coalesce(cited, F.array().cast("array<string>")).alias("articulos_citados")))
