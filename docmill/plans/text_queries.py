"""Queries of the text functions, normalisation, chunks and stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions import text as X
from docmill.operators import analyze, normalize, quality, store, usage
from docmill.plans.registry import query
from docmill.session import table


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents under the names of the document schema; source and lang stand for court and subject."""
    none = F.array().cast("array<string>")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"), "doc_id", "source", F.col("doc_id").cast("string").alias("source_id"), F.col("text").alias("texto"),
        F.when(F.col("doc_id") % 2 == 0, F.substring("text", 1, 80)).otherwise("").alias("sumario"), F.substring("text", 1, 40).alias("caratula"), F.col("source").alias("tribunal"), F.col("lang").alias("materia"),
        F.slice(F.split(F.substring("text", 1, 200), " "), 1, 12).alias("voces"), F.lit("").alias("sobre"), none.alias("normas"), F.lit("").alias("fecha"),
    )


CORPUS_SQL = """corpus AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, source, text AS texto, CASE WHEN doc_id % 2 = 0 THEN substr(text, 1, 80) ELSE '' END AS sumario, substr(text, 1, 40) AS caratula,
    source AS tribunal, lang AS materia, list_slice(string_split(substr(text, 1, 200), ' '), 1, 12) AS voces FROM documents)"""


@query("SELECT doc_id, substr(sha256('doc:' || CAST(doc_id AS VARCHAR)), 1, 16) AS sha16 FROM documents")
def doc_id_sha16(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.sha_id("doc", F.col("doc_id").cast("string")).alias("sha16"))


@query("SELECT doc_id, length(text) AS n FROM documents WHERE length(text) >= 100")
def min_length_gate(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.length("text") >= 100).select("doc_id", F.length("text").cast("long").alias("n"))


@query("SELECT doc_id FROM documents WHERE source = 'src1' OR length(text) >= 500")
def ingest_length_gate(spark, sf_dir):
    return quality.ingest_gate(table(spark, sf_dir, "documents"), "text", exempt="src1").select("doc_id")


@query("""SELECT p_partkey, CASE WHEN contains(lower(p_name), 'laboral') OR contains(lower(p_name), 'trabajo') THEN 'laboral' WHEN contains(lower(p_name), 'civil') THEN 'civil' WHEN contains(lower(p_name), 'penal') THEN 'penal'
  WHEN contains(lower(p_name), 'comercial') THEN 'comercial' WHEN contains(lower(p_name), 'familia') THEN 'familia' WHEN contains(lower(p_name), 'contencioso') THEN 'contencioso administrativo' ELSE '' END AS materia
  FROM (SELECT p_partkey, p_type || CASE p_partkey % 8 WHEN 0 THEN ' Trabajo y Civil' WHEN 1 THEN ' PENAL' WHEN 2 THEN ' comercial familia' WHEN 3 THEN ' Contencioso' ELSE '' END AS p_name FROM part)""")
def materia_ladder(spark, sf_dir):
    tag = F.when(F.col("p_partkey") % 8 == 0, " Trabajo y Civil").when(F.col("p_partkey") % 8 == 1, " PENAL").when(F.col("p_partkey") % 8 == 2, " comercial familia").when(F.col("p_partkey") % 8 == 3, " Contencioso").otherwise("")
    return table(spark, sf_dir, "part").select("p_partkey", X.subject_of(F.lit(""), F.concat("p_type", tag)).alias("materia"))


@query("""SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(replace(p_name, ' ', ' - '), ' - '), lambda x: trim(x)), lambda x: x <> ''), '|') AS voces FROM part""")
def voces_split(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(X.split_list(F.replace("p_name", F.lit(" "), F.lit(" - ")), " - "), "|").alias("voces"))


@query(f"""WITH {CORPUS_SQL} SELECT doc_id, concat_ws(' | ', 'Carátula: ' || nullif(caratula, ''), 'Materia: ' || nullif(materia, ''), 'Voces: ' || nullif(array_to_string(voces[1:10], ', '), ''), 'Tribunal: ' || nullif(tribunal, ''),
  substr(CASE WHEN length(sumario) > 50 THEN sumario ELSE texto END, 1, 3000)) AS embedding_text FROM corpus""")
def embedding_text(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", X.embedding_text(*(F.col(c) for c in ("caratula", "materia", "voces", "tribunal", "sobre", "sumario", "texto"))).alias("embedding_text"))


@query(f"""WITH {CORPUS_SQL} SELECT id, substr(texto, 1, 5000) AS document, substr(sumario, 1, 2000) AS sumario, array_to_string(voces[1:10], ', ') AS voces, source, tribunal, caratula, materia FROM corpus""")
def embed_payload_projection(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    for c in ("jurisdiccion", "provincia", "tipo_documento", "actor", "demandado"):
        docs = docs.withColumn(c, F.lit(""))
    out = store.payload(docs.withColumn("chunk_index", F.lit(0)).withColumn("total_chunks", F.lit(1)))
    return out.select("id", "document", "sumario", "voces", "source", "tribunal", "caratula", "materia")


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', ' ', 'gs'), '<style[^>]*>.*?</style>', ' ', 'gs'),
  '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&[a-z]+;', ' ', 'g'), '&#[0-9]+;', '', 'g'), '\s+', ' ', 'g')) AS body FROM pages""")
def clean_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.clean_html(F.col("html")).alias("body"))


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace('[[p]]' || text || '[[/p]]  [[r uuid:x1]] [[P]]', '\[\[/?[a-z]+(?:\s[^\]]*?)?\]\]', '', 'g'), '\s+', ' ', 'g')) AS body FROM documents""")
def clean_markup(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.clean_markup(F.concat(F.lit("[[p]]"), "text", F.lit("[[/p]]  [[r uuid:x1]] [[P]]"))).alias("body"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS fecha, strftime(o_orderdate, '%Y-%m-%d') AS iso, CAST(year(o_orderdate) AS INTEGER) AS anio FROM orders""")
def extract_fecha(spark, sf_dir):
    line = F.concat(F.lit("En la ciudad, a "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(" se resuelve 9999"))
    found = table(spark, sf_dir, "orders").select("o_orderkey", X.date_text_of(line).alias("fecha"))
    return found.select("o_orderkey", "fecha", X.iso_date(F.col("fecha")).alias("iso"), X.year_of(X.iso_date(F.col("fecha"))).alias("anio"))


@query("""SELECT p.page_id, CAST(len(regexp_extract_all(html, 'href="[^"]*"')) AS INTEGER) AS n_links FROM pages p""")
def link_counts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_count("html", F.lit('href="[^"]*"')).alias("n_links"))


@query("""SELECT 'https://example.org/d/sentencia-SGU-' || h || '.pdf' AS pdf_url, h AS uuid, 'CIV 12345/2020' AS expediente, 'Sala ' || page_id AS tribunal, 'A c/ B' AS caratula, '2021-04-03' AS fecha
  FROM (SELECT page_id, lpad(lower(to_hex(page_id)), 8, 'a') AS h FROM pages)""")
def result_block_parse(spark, sf_dir):
    """Blocks made of page ids, as result pages list them."""
    block = F.concat(F.lit('<a href="/d/sentencia-SGU-'), F.lpad(F.lower(F.hex("page_id")), 8, "a"), F.lit('.pdf">x</a> Tribunal: Sala '), F.col("page_id"), F.lit("<br>CIV 12345/2020 Carátula: A c/ B<br>Fecha sentencia: 03/04/2021"))
    return normalize.parse_result_blocks(table(spark, sf_dir, "pages").select(block.alias("html")))


@query("""WITH ends AS (SELECT user_id, CAST(max(ts) AS DATE) AS e FROM events WHERE user_id IS NOT NULL GROUP BY user_id)
  SELECT strftime(CAST(m AS DATE), '%Y-%m-%d') AS m_start, strftime(least(last_day(CAST(m AS DATE)), e), '%Y-%m-%d') AS m_end FROM ends, LATERAL (SELECT unnest(generate_series(TIMESTAMP '2013-09-01', date_trunc('month', e)::TIMESTAMP, INTERVAL 1 MONTH)) AS m)""")
def month_ranges(spark, sf_dir):
    """The months to ask for, up to the day of each user's last event."""
    ends = table(spark, sf_dir, "events").where("user_id IS NOT NULL").groupBy("user_id").agg(F.date_format(F.max("ts"), "yyyy-MM-dd").alias("end"))
    return normalize.month_ranges(ends.select("end")).select(F.col("m_start").cast("string").alias("m_start"), F.col("m_end").cast("string").alias("m_end"))


@query("SELECT source AS id, text AS texto, doc_id AS line FROM documents WHERE text <> '' QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) = 1")
def fulltext_store_first_wins(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("id"), F.col("text").alias("texto"), F.col("doc_id").alias("line"))
    return store.fulltext_store(docs, order=("line",))


@query("""SELECT CAST(doc_id AS VARCHAR) || '_c' || CAST(doc_id % 3 AS VARCHAR) AS id, CASE WHEN lang = 'fr' OR length(text) <= least(length(text), 300) THEN substr(text, 1, 300) ELSE text END AS texto FROM documents""")
def fulltext_enrich(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    hits = docs.select(F.concat_ws("_c", "doc_id", F.col("doc_id") % 3).alias("id"), F.substring("text", 1, 300).alias("texto"))
    full = docs.where("lang <> 'fr'").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("texto"))
    return store.enrich(hits, full)


@query(f"""WITH {CORPUS_SQL} SELECT id AS doc_id, caratula, substr(texto || ' ' || sumario, 1, 2000) AS texto, tribunal, materia FROM corpus""")
def fts_index_rows(spark, sf_dir):
    return store.index_rows(corpus(spark, sf_dir), 2000)


_NOISE_SQL = """CASE WHEN length(text) < 500 THEN 'texto muy corto (' || length(text) || ' chars)'
  WHEN regexp_matches(lower(text), 'art\\. 280|art[ií]culo 280') AND length(text) < 2000 THEN 'art. 280 CPCCN (' || length(text) || ' chars) - certiorari sin fundamentacion'
  WHEN regexp_matches(lower(text), 'desest[ií]mase') AND length(text) < 1500 THEN 'desestimacion breve (' || length(text) || ' chars)'
  WHEN regexp_matches(lower(text), 'desistimiento|dase por desistido') AND length(text) < 1500 THEN 'desistimiento (' || length(text) || ' chars)'
  WHEN contains(lower(text), 'caducidad de instancia') AND length(text) < 1500 THEN 'caducidad de instancia (' || length(text) || ' chars)' END"""


@query(f"SELECT doc_id, {_NOISE_SQL} AS noise_reason FROM documents")
def quality_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", quality.noise_reason(F.col("text")).alias("noise_reason"))


_RULES = ["art. 280", "desestímase", "dase por desistido", "caducidad de instancia", "x"]


@query("""WITH t AS (SELECT doc_id, text || ' ' || (['ART. 280', 'Desestímase', 'dase por desistido', 'caducidad de instancia', 'x'])[doc_id % 5 + 1] AS t FROM documents),
  r AS (SELECT CASE WHEN length(t) < 500 THEN 1 WHEN doc_id % 5 = 0 AND length(t) < 2000 THEN 2 WHEN doc_id % 5 = 1 AND length(t) < 1500 THEN 3 WHEN doc_id % 5 = 2 AND length(t) < 1500 THEN 4 WHEN doc_id % 5 = 3 AND length(t) < 1500 THEN 5 ELSE 0 END AS k FROM t)
  SELECT (['substantive', 'texto muy corto', 'art. 280 CPCCN', 'desestimacion breve', 'desistimiento', 'caducidad de instancia'])[k + 1] AS reason, count(*) AS n FROM r GROUP BY k""")
def quality_split_counts(spark, sf_dir):
    mark = F.element_at(F.array(*(F.lit(x) for x in ("ART. 280", "Desestímase", "dase por desistido", "caducidad de instancia", "x"))), (F.col("doc_id") % 5 + 1).cast("int"))
    reason = quality.noise_reason(F.concat_ws(" ", "text", mark))
    return table(spark, sf_dir, "documents").groupBy(F.coalesce(F.regexp_extract(reason, r"^([^(]+) \(", 1), F.lit("substantive")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"""SELECT CAST(doc_id AS VARCHAR) AS source_id, 'inadmisible' AS resultado, 'Pre-filtrado automatico: texto de ' || length(text) || ' caracteres. Sin contenido sustantivo (ruido procesal: art. 280, desestimacion, desistimiento o caducidad). No se envio a agente lector.' AS razon_resultado
  FROM documents WHERE ({_NOISE_SQL}) IS NOT NULL""")
def auto_inadmissible(spark, sf_dir):
    _, noise = quality.split_quality(corpus(spark, sf_dir))
    return quality.auto_inadmissible(noise).select("source_id", "resultado", "razon_resultado")


@query(r"""SELECT item_id, CASE WHEN length(t) < 15 THEN 'too_short' WHEN len(regexp_split_to_array(t, '\s+')) < 3 THEN 'few_words' ELSE 'accepted' END AS verdict
  FROM (SELECT item_id, trim(text) AS t FROM benchmark)""")
def input_validation(spark, sf_dir):
    return quality.validate_input(table(spark, sf_dir, "benchmark"), "text").select("item_id", "verdict")


@query("""SELECT event_id, json_extract_string(props, '$.k') AS page FROM events""")
def fenced_json_parse(spark, sf_dir):
    fenced = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(X.fenced_json(fenced), "$.k").alias("page"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type || '|x' WHEN 1 THEN event_type ELSE '' END AS items FROM events""")
def ensure_list(spark, sf_dir):
    kind = F.col("event_id") % 4
    raw = F.when(kind == 0, F.to_json(F.array("event_type", F.lit("x")))).when(kind == 1, F.to_json(F.named_struct(F.lit("v"), "event_type"))).when(kind == 2, F.lit('{"v": "N/D"}')).otherwise(F.lit('{"v": null}'))
    v = F.try_parse_json(F.when(kind == 0, F.concat(F.lit('{"v": '), raw, F.lit("}"))).otherwise(raw))
    value = F.try_variant_get(v, "$.v", "variant")
    shape = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(X.ensure_list(shape, F.try_variant_get(v, "$.v", "array<string>"), F.try_variant_get(v, "$.v", "string")), "|").alias("items"))


_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


@query(rf"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN sha256({_STRIP.format("text")}) ELSE sha256('') END AS why, CASE doc_id % 3 WHEN 0 THEN lang WHEN 1 THEN '</razonamiento>' || source ELSE source END AS rest FROM documents""")
def reasoning_split(spark, sf_dir):
    """Texts as the reasoning before an answer; of every third an opening tag is missing, and of the next one both are."""
    tagged = F.concat(F.lit("x<razonamiento>"), "text", F.lit("</razonamiento>"), "lang")
    c = F.when(F.col("doc_id") % 3 == 0, tagged).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("</razonamiento>"), "source")).otherwise(F.col("source"))
    rows = table(spark, sf_dir, "documents").select("doc_id", c.alias("answer"))
    return rows.select("doc_id", F.sha2(X.reasoning_of(F.col("answer")), 256).alias("why"), X.after_reasoning(F.col("answer")).alias("rest"))


@query("SELECT o_orderkey, CAST(CAST(round(o_totalprice / 1e4) AS INTEGER) AS VARCHAR) || '%' AS label FROM orders")
def percent_labels(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", X.percent_label(F.col("o_totalprice").cast("double"), 1e6).alias("label"))


@query(f"WITH {CORPUS_SQL} SELECT id, coalesce(nullif(substr(sumario, 1, 200), ''), substr(texto, 1, 200)) AS resumen, caratula AS argumento FROM corpus")
def raw_summaries(spark, sf_dir):
    """What stands for summaries where no summariser answered."""
    return analyze.fallback_summary(corpus(spark, sf_dir)).select("id", "resumen", "argumento")


@query("SELECT doc_id, 'Caso: ' || substr(text, 1, 60) AS title FROM documents")
def item_titles(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", usage.item_title("Caso: ", F.col("text"), 60).alias("title"))
