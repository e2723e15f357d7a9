"""Queries of raw records: their normalisation, JSON lines, result pages and the texts told about them. The records are made of the driver's tables, in every shape that a source has."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docmill.functions import report
from docmill.functions import text as X
from docmill.operators import analyze, chunk, normalize, usage
from docmill.plans.analytics_queries import _A, _analyses
from docmill.plans.registry import query
from docmill.plans.text_queries import _STRIP
from docmill.session import scratch_path, table
from docmill.sources import jsonl


def _by(n: int, *values: Column) -> Column:
    """The value for the remainder of doc_id by n."""
    return F.element_at(F.array(*values), (F.col("doc_id") % n + 1).cast("int"))


def _json(c: Column) -> Column:
    """A text as JSON."""
    listed = F.to_json(F.array(c))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _fill(pattern: str, **values: Column) -> Column:
    """The pattern with <name> replaced by the value as JSON."""
    parts: list[Column] = []
    for i, piece in enumerate(pattern.replace(">", "<").split("<")):
        parts.append(_json(values[piece]) if i % 2 else F.lit(piece))
    return F.concat(*parts)


@query(rf"""WITH r AS (SELECT doc_id, lang, source, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN {_STRIP.format("text")} ELSE lang || ', ' || text END AS body,
    CASE WHEN doc_id % 2 = 0 THEN 'i' ELSE 'g' END || doc_id AS source_id FROM documents)
  SELECT doc_id, source_id, substr(sha256('saij:' || source_id), 1, 16) AS id, sha256(body) AS texto_sha256, 'sala de ' || lang AS sala, source || ', ' || lang AS tribunal,
    CASE WHEN doc_id % 2 = 0 THEN source || '|' || lang || '|X' ELSE source || '|7' END AS magistrados,
    CASE WHEN doc_id % 5 = 0 THEN 'penal' WHEN doc_id % 4 = 0 THEN 'laboral' WHEN doc_id % 4 = 2 THEN 'civil' ELSE '' END AS materia,
    CASE doc_id % 4 WHEN 0 THEN lang || '|Trabajo' WHEN 1 THEN source || '|' || lang WHEN 2 THEN lang || '|CIVIL' ELSE lang || '|' || source END AS voces,
    CASE doc_id % 4 WHEN 0 THEN source || '|' || lang || '|ley 1' WHEN 1 THEN source || '|' || lang || '|ley 2' WHEN 2 THEN 'ley 3' ELSE source || '|z' END AS referencias FROM r WHERE length(body) >= 100""")
def variant_records(spark, sf_dir):
    """Records whose fields are texts, lists or objects by turns."""
    values = {c: F.col(c) for c in ("text", "lang", "source")} | {"own": F.concat(F.lit("i"), "doc_id"), "guid": F.concat(F.lit("g"), "doc_id"), "sala": F.concat(F.lit("  sala de "), "lang", F.lit(" ")), "judges": F.concat("source", F.lit("; "), "lang", F.lit("/ X ,"))}
    fields = {
        "texto-completo": (3, '{"nombre": <text>}', '""', "[<lang>, null, <text>]"), "texto": (1, "<text>"), "id-infojus": (2, '{"descripcion": <own>}', "null"), "guid": (1, "<guid>"), "sala": (1, "<sala>"),
        "tribunal": (1, '[<source>, "", <lang>]'), "magistrados": (2, "<judges>", '[<source>, "", null, false, 0, 7]'), "materia": (5, '" Penal "', '""', "null", '""', '""'),
        "descriptores": (4, '[<lang>, "Trabajo"]', '{"voz": [<source>, " ", <lang>]}', "<described>", "<listed>"),
        "referencias-normativas": (4, '[{"descripcion": <source>}, {"nombre": <lang>}, "ley 1"]', '{"normas": [{"texto": <source>}, {"descripcion": <lang>, "texto": "x"}, " ley 2 "]}', '" ley 3 "', '{"b": " z", "a": <source>}'),
    }
    values |= {"described": F.concat("lang", F.lit(" - CIVIL")), "listed": F.concat("lang", F.lit(", "), "source", F.lit(","))}
    members = [F.concat(F.lit(f'"{name}": '), _by(n, *(_fill(s, **values) for s in shapes))) for name, (n, *shapes) in fields.items()]
    docs = normalize.normalize_variant(table(spark, sf_dir, "documents").select(F.concat(F.lit("{"), F.concat_ws(", ", *members), F.lit("}")).alias("value")))
    listed = {"magistrados": "magistrados", "voces": "voces", "referencias": "referencias_normativas"}
    return docs.select(F.substring("source_id", 2, 20).cast("long").alias("doc_id"), "source_id", "id", F.sha2("texto", 256).alias("texto_sha256"), "sala", "tribunal", "materia", *(F.array_join(c, "|").alias(n) for n, c in listed.items()))


@query(rf"""WITH r AS (SELECT *, {_STRIP.format("text")} AS body FROM documents)
  SELECT doc_id, substr(sha256('jurisgpt:' || doc_id || ':' || lang), 1, 16) AS id, CASE doc_id % 4 WHEN 0 THEN 'Suprema Corte de Justicia - ' || source WHEN 1 THEN 'CÁMARA ' || source || ' de ' || lang WHEN 2 THEN 'JUZGADO ' || source ELSE 'Autos en ' || source || ' SALA II' END AS tribunal,
    CASE doc_id % 3 WHEN 0 THEN '3 de mayo de 2021' WHEN 1 THEN '12/03/2021' ELSE '2020-01-02' END AS fecha, CASE doc_id % 4 WHEN 0 THEN 'laboral' WHEN 1 THEN 'civil' WHEN 2 THEN 'otro tema' ELSE '' END AS materia,
    source || '|' || lang AS voces, CASE WHEN doc_id % 2 = 0 THEN lang ELSE source END AS sumario FROM r WHERE length(body) >= 60""")
def flat_rulings(spark, sf_dir):
    """Rulings with their court and date in the first lines; a line of blanks fills short ones up."""
    head = _by(4, F.concat(F.lit("Suprema Corte de Justicia - "), "source"), F.concat(F.lit("CÁMARA "), "source", F.lit(" de "), "lang"), F.concat(F.lit("JUZGADO "), "source"), F.concat(F.lit("Autos en "), "source", F.lit(" SALA II, y más")))
    day = _by(3, F.lit("a 3 de mayo de 2021, por 1/2/2020"), F.lit("el 12/03/2021 y 1999-01-02"), F.lit("el 2020-01-02"))
    raw = table(spark, sf_dir, "documents").withColumn("body", X.strip(F.col("text"))).where("length(body) >= 60").select(
        F.concat_ws("\n", head, day, F.lit(" " * 100), "body").alias("sentencia"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise(" ").alias("resumen"), F.col("source").alias("texto"),
        F.col("doc_id").cast("string").alias("fallo"), F.concat("source", F.lit(" -  - "), "lang").alias("voces"), F.col("lang").alias("sumario"), _by(4, F.lit("DERECHO DEL TRABAJO"), F.lit("DERECHO CIVIL "), F.lit("Otro Tema"), F.lit(None).cast("string")).alias("materia"),
    )
    return normalize.normalize_rulings(raw).select(F.col("source_id").cast("long").alias("doc_id"), "id", "tribunal", "fecha", "materia", F.array_join("voces", "|").alias("voces"), "sumario")


@query("""SELECT doc_id, substr(sha256('csjn:' || doc_id), 1, 16) AS id, sha256(text) AS texto_sha256, CASE WHEN doc_id % 3 = 0 THEN source ELSE lang END AS caratula, CASE WHEN doc_id % 3 = 0 THEN 'acuerdo' ELSE 'sentencia' END AS tipo_fallo,
  source || '|' || lang AS magistrados, lang AS voces FROM documents WHERE length(text) >= 300""")
def court_records(spark, sf_dir):
    """Records of a supreme court, with the second names of their fields by turns."""
    turn = lambda n, c: F.when(F.col("doc_id") % n == 0, c)
    key, people = F.col("doc_id").cast("string"), F.concat("source", F.lit(" , ,"), "lang")
    raw = table(spark, sf_dir, "documents").select(
        turn(2, key).alias("codigo"), key.alias("idAnalisis"), F.col("text").alias("texto"), turn(3, F.col("source")).alias("caratula"), F.col("lang").alias("titulo"), turn(3, F.lit("acuerdo")).alias("tipoFallo"),
        turn(2, people).alias("magistrados"), people.alias("jueces"), F.concat(F.lit(" , "), "lang").alias("voces"),
    )
    docs = normalize.normalize_records(raw)
    return docs.select(F.col("source_id").cast("long").alias("doc_id"), "id", F.sha2("texto", 256).alias("texto_sha256"), "caratula", "tipo_fallo", *(F.array_join(c, "|").alias(c) for c in ("magistrados", "voces")))


_CODES = [*normalize.JURISDICTIONS, "99-9"]


@query("""SELECT doc_id, substr(sha256('pjn:' || CASE WHEN doc_id % 2 = 0 THEN 'u' ELSE 'e' END || doc_id), 1, 16) AS id, sha256(text) AS texto_sha256, CASE WHEN doc_id % 3 = 0 THEN source ELSE 'e' || doc_id END AS caratula, source AS tribunal, lang AS fecha,
  (['Ciudad de Buenos Aires', 'Buenos Aires', 'Cordoba', 'Mendoza', 'Salta', 'Jujuy', 'Corrientes', 'Chaco', 'Chubut', 'Entre Rios', 'Formosa', 'La Pampa', 'La Rioja', 'Misiones', 'Neuquen', 'Rio Negro', 'San Juan', 'Catamarca', '99-9'])[doc_id % 19 + 1] AS jurisdiccion
  FROM documents WHERE length(text) >= 300""")
def chamber_records(spark, sf_dir):
    """Chamber entries under all codes and an unknown one, with uuids and titles by turns."""
    turn = lambda n, c: F.when(F.col("doc_id") % n == 0, c).otherwise("")
    raw = table(spark, sf_dir, "documents").select(
        turn(2, F.concat(F.lit("u"), "doc_id")).alias("uuid"), F.concat(F.lit("e"), "doc_id").alias("expediente"), F.col("text").alias("texto"), turn(3, F.col("source")).alias("caratula"), F.col("source").alias("tribunal"), F.col("lang").alias("fecha"),
        _by(len(_CODES), *map(F.lit, _CODES)).alias("jurisdiccion"),
    )
    return normalize.normalize_chamber(raw).select(F.substring("source_id", 2, 20).cast("long").alias("doc_id"), "id", F.sha2("texto", 256).alias("texto_sha256"), "caratula", "tribunal", "fecha", "jurisdiccion")


@query("""SELECT CAST(doc_id AS VARCHAR) AS id, sha256(text) AS texto_sha256, source || '|' || lang AS voces, CAST(0 AS BIGINT) AS bad FROM documents WHERE doc_id % 5 > 1
  UNION ALL SELECT NULL, NULL, NULL, count(*) FROM documents WHERE doc_id % 5 = 0""")
def json_lines(spark, sf_dir):
    """Documents written as JSON lines and read again; every fifth line is cut, every fifth holds no object. A last row counts the cut ones."""
    whole = F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("texto"), F.array("source", "lang").alias("voces"), F.lit(1).alias("other")))
    path = scratch_path(spark, "json-lines")
    table(spark, sf_dir, "documents").select(_by(5, F.concat(F.lit('{"id": "'), "doc_id"), F.concat(F.lit("# "), "doc_id"), whole, whole, F.concat(F.lit("  "), whole)).alias("value")).write.mode("overwrite").text(path)
    docs = jsonl.documents(spark, path, "part-*").select("id", F.sha2("texto", 256).alias("texto_sha256"), F.array_join("voces", "|").alias("voces"), F.lit(0).cast("long").alias("bad"))
    none = F.lit(None).cast("string")
    bad = jsonl.bad_lines(spark, path, "part-*").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("bad"))
    return docs.unionByName(bad.select(*(none.alias(c) for c in ("id", "texto_sha256", "voces")), "bad"))


# The pieces of each long text and what joins them, then a walk over them that adds up each chunk's size.
_CHUNKS_SQL = """WITH RECURSIVE docs AS (SELECT doc_id, {0} AS t FROM documents),
  paras AS (SELECT doc_id, unnest(ps) AS para, unnest(range(len(ps))) AS p FROM (SELECT doc_id, string_split(t, chr(10) || chr(10)) AS ps FROM docs WHERE length(t) > 4000)),
  parts AS (SELECT doc_id, p, 0::BIGINT AS k, para AS piece, FALSE AS alone, chr(10) || chr(10) AS joiner FROM paras WHERE length(para) <= 4000
    UNION ALL SELECT doc_id, p, unnest(range(len(ss))), unnest(ss), unnest(range(len(ss))) = 0, ' ' FROM (SELECT doc_id, p, string_split(replace(para, '. ', '.' || chr(10)), chr(10)) AS ss FROM paras WHERE length(para) > 4000)),
  seq AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p, k) AS i, piece, length(piece) AS n, alone, joiner FROM parts),
  walk AS (SELECT doc_id, i, n AS size, 0 AS c, TRUE AS first FROM seq WHERE i = 1
    UNION ALL SELECT s.doc_id, s.i, CASE WHEN fresh THEN s.n ELSE w.size + length(s.joiner) + s.n END, w.c + fresh::INT, fresh
      FROM walk w JOIN seq s ON s.doc_id = w.doc_id AND s.i = w.i + 1, LATERAL (SELECT s.alone OR w.size = 0 OR w.size + s.n + length(s.joiner) > 4000 AS fresh)),
  made AS (SELECT doc_id, c, max(size) AS size, regexp_replace(string_agg(CASE WHEN first THEN piece ELSE joiner || piece END, '' ORDER BY i), '^\\s+|\\s+$', '', 'g') AS chunk, c = max(c) OVER (PARTITION BY doc_id) AS final FROM walk JOIN seq USING (doc_id, i) GROUP BY doc_id, c),
  kept AS (SELECT doc_id, chunk, row_number() OVER (PARTITION BY doc_id ORDER BY c) - 1 AS chunk_index FROM made WHERE size > 0 AND (chunk <> '' OR NOT final)
    UNION ALL SELECT doc_id, coalesce(t, ''), 0 FROM docs WHERE coalesce(length(t), 0) <= 4000)
  SELECT CAST(doc_id AS VARCHAR) || CASE WHEN count(*) OVER d > 1 THEN '_c' || chunk_index ELSE '' END AS id, CAST(chunk_index AS INTEGER) AS chunk_index, CAST(count(*) OVER d AS INTEGER) AS total_chunks, CAST(length(chunk) AS INTEGER) AS n, sha256(chunk) AS chunk_sha256 FROM kept WINDOW d AS (PARTITION BY doc_id)"""


def _chunks(docs):
    found = chunk.chunk_documents(docs)
    return found.select("id", "chunk_index", "total_chunks", F.length("texto").alias("n"), F.sha2("texto", 256).alias("chunk_sha256"))


@query(_CHUNKS_SQL.format("text"))
def chunk_documents(spark, sf_dir):
    """The chunks of all documents by sentences and lines, as their texts have no blank lines."""
    return _chunks(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("texto")))


@query(_CHUNKS_SQL.format("CASE WHEN doc_id % 4 = 0 THEN text || repeat(chr(10) || chr(10) || text, 2) ELSE replace(text, chr(10), chr(10) || chr(10)) END"))
def chunk_paragraphs(spark, sf_dir):
    """The chunks of all documents where lines are paragraphs; every fourth one is three paragraphs of the whole text."""
    text = F.when(F.col("doc_id") % 4 == 0, F.concat_ws("\n\n", "text", "text", "text")).otherwise(F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return _chunks(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), text.alias("texto")))


@query(f"""WITH {_A} SELECT doc_id, sha256(concat_ws(chr(10), 'Analicé "' || caratula || '" (' || tribunal || ', ' || fecha || ').', chr(10) || 'Resultado: ' || CASE resultado WHEN 'favorable' THEN 'FAVORABLE al actor' WHEN 'desfavorable' THEN 'DESFAVORABLE al actor' WHEN 'parcial' THEN 'PARCIALMENTE favorable' ELSE 'INADMISIBLE (no entró al fondo)' END || '.',
  'Llegó al tribunal por: ' || via || '.', chr(10) || 'Doctrina aplicada: ' || tribunal || '.', chr(10) || 'Normas invocadas: ' || nullif(array_to_string(normas, ', '), '') || '.', 'Precedentes citados: ' || nullif(array_to_string(normas, ', '), '') || '.',
  CASE WHEN doc_id % 2 = 0 THEN 'Montos/costas: ' || doc_id END, CASE WHEN doc_id % 3 = 0 THEN 'Votación: mayoría' END)) AS told FROM a""")
def narratives(spark, sf_dir):
    """Each analysis told in sentences."""
    rows = _analyses(spark, sf_dir).withColumns({"quantum": F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("string")).otherwise("N/D"), "votos": _by(3, F.lit("mayoría"), F.lit("unánime"), F.lit("N/D"))})
    return rows.select("doc_id", F.sha2(report.narrative({f.name: f.dataType.simpleString() for f in rows.schema.fields}), 256).alias("told"))


@query("""WITH l AS (SELECT source, lang, quality, toxic FROM labels JOIN documents USING (doc_id)),
  s AS (SELECT source, lang, count(*) AS n, sum(quality) * 100.0::DOUBLE / count(*) AS rate FROM l GROUP BY source, lang),
  g AS (SELECT source, count(*) AS n, count(*) FILTER (quality = 1 AND toxic = 0) AS f, count(*) FILTER (quality = 1 AND toxic = 1) AS u, count(*) FILTER (quality = 0 AND toxic = 0) AS p, count(*) FILTER (quality = 0 AND toxic = 1) AS i FROM l GROUP BY source),
  w AS (SELECT source, string_agg('  • ' || lang || ' (éxito: ' || CAST(round(rate) AS BIGINT) || '%, ' || n || ' casos)', chr(10) ORDER BY lang) AS won, string_agg('  • ' || lang, chr(10) ORDER BY lang) AS risks, string_agg(lang, ', ' ORDER BY lang) AS norms FROM s GROUP BY source)
  SELECT source, concat_ws(chr(10), 'ESTADÍSTICAS: ' || n || ' fallos analizados', '  Favorables: ' || f || ' | Desfavorables: ' || u || ' | Parciales: ' || p || ' | Inadmisibles: ' || i, '  Probabilidad favorable: ' || CAST(round(f * 100.0::DOUBLE / n) AS BIGINT) || '%',
    chr(10) || 'RECOMENDACIÓN ESTRATÉGICA:' || chr(10) || source, chr(10) || 'ESTRATEGIAS EXITOSAS:', won, chr(10) || 'NORMAS CLAVE: ' || norms, chr(10) || 'RIESGOS:', risks) AS report FROM g JOIN w USING (source)""")
def synthesis_reports(spark, sf_dir):
    """A report for each source, its languages as strategies."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id")
    langs = rows.groupBy("source", "lang").agg(F.count("*").alias("n"), (F.sum("quality") * 100.0 / F.count("*")).alias("rate"))
    listed = langs.groupBy("source").agg(F.array_sort(F.collect_list(F.struct(F.col("lang").alias("estrategia"), F.col("rate").alias("tasa_exito"), F.col("n").alias("frecuencia")))).alias("estrategias_exitosas"))
    case = lambda q, t: F.count_if((F.col("quality") == q) & (F.col("toxic") == t))
    counts = rows.groupBy("source").agg(F.count("*").alias("total_analizados"), case(1, 0).alias("favorables"), case(1, 1).alias("desfavorables"), case(0, 0).alias("parciales"), case(0, 1).alias("inadmisibles"))
    all_ = counts.join(listed, "source").select(
        "*", (F.col("favorables") * 100.0 / F.col("total_analizados")).alias("porcentaje_favorable"), F.col("source").alias("recomendacion_estrategica"), F.lit("N/D").alias("rango_quantum"),
        F.col("estrategias_exitosas.estrategia").alias("normas_clave"), F.col("estrategias_exitosas.estrategia").alias("riesgos"), F.array().cast("array<string>").alias("contradicciones"),
    )
    return all_.select("source", report.synthesis_report(all_.columns).alias("report"))


@query(f"""WITH {_A} SELECT string_agg(chr(10) || doc_id || '. ' || caratula || ' (' || tribunal || ', ' || fecha || ')' || chr(10) || '   Resumen: ' || via || chr(10) || '   Cita: "' || resultado || '"' || chr(10), '' ORDER BY doc_id) AS contexto
  FROM (SELECT * FROM a ORDER BY doc_id LIMIT 5)""")
def drafting_hits(spark, sf_dir):
    """The first five analyses as a draft's context."""
    return analyze.drafting_context(_analyses(spark, sf_dir).withColumns({"resumen": F.col("via_procesal"), "cita_textual": F.col("resultado")}))


@query("""SELECT l.doc_id, d.source, l.quality FROM labels l JOIN documents d USING (doc_id) WHERE l.doc_id % 7 > 0 AND (toxic = 0 OR quality = 0)""")
def analyses_by_position(spark, sf_dir):
    """Documents with the analysis of their place; some places lie beyond the results, some analyses are marked irrelevant, some have no mark."""
    results = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("input_rank"), "doc_id", "source")
    index = F.when(F.col("doc_id") % 7 == 0, -1 - F.col("doc_id")).otherwise(F.col("doc_id"))
    told = table(spark, sf_dir, "labels").select(index.alias("index"), F.when(F.col("toxic") == 1, F.col("quality") == 0).alias("relevante"), "quality")
    return analyze.match_by_position(results, told).select("doc_id", "source", "quality")


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS running, event_id AS count, CAST(0 AS BIGINT) AS errors, event_type AS cost, CASE WHEN event_id % 2 = 0 THEN substr(repeat(props || '|', 20), 1, 150) ELSE '' END AS log FROM events WHERE user_id IS NOT NULL""")
def status_lines(spark, sf_dir):
    """Status lines of servers with numbers that are none, bars in the log and no log."""
    running = F.when(F.col("event_id") % 3 == 0, "x1").otherwise(F.col("user_id").cast("string"))
    line = F.concat_ws("|", running, F.col("event_id").cast("string"), F.lit("-1"), F.concat(F.lit(" "), "event_type"), F.when(F.col("event_id") % 2 == 0, F.repeat(F.concat("props", F.lit("|")), 20)))
    return table(spark, sf_dir, "events").where("user_id IS NOT NULL").select("event_id", usage.status_line(line).alias("s")).select("event_id", "s.*")


@query("""WITH h AS (SELECT page_id, html || '<option value="a' || page_id || '" selected>Sala ' || page_id || '</option><option value="b">B</option>' AS html FROM pages)
  SELECT page_id, array_to_string(list_transform(list_zip(regexp_extract_all(html, 'value="([^"]+)"[^>]*>([^<]+)', 1), regexp_extract_all(html, 'value="([^"]+)"[^>]*>([^<]+)', 2)), lambda x: x[1] || '=' || x[2]), '|') AS options, 1234000 + page_id AS total FROM h""")
def form_options(spark, sf_dir):
    """The options of a form behind each page, and the number of results that a line names."""
    html = F.concat("html", F.lit('<option value="a'), "page_id", F.lit('" selected>Sala '), "page_id", F.lit('</option><option value="b">B</option>'))
    named = F.concat(F.lit("Se hallaron "), F.regexp_replace(F.format_number(F.col("page_id") + 1234000, 0), ",", "."), F.lit(" resultados"))
    shown = F.transform(report.options(html), lambda x: F.concat(x["id"], F.lit("="), x["name"]))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(shown, "|").alias("options"), report.result_total(named).alias("total"))


@query(r"""SELECT doc_id, count(*) FILTER (regexp_matches(line, '^(I|II|III|IV|V|VI|VII|VIII)\.') OR (upper(line) = line AND lower(line) <> line)) AS headers FROM (
  SELECT doc_id, unnest(string_split(text || chr(10) || 'IV. ' || lang || chr(10) || 'IX. x' || chr(10) || upper(source) || chr(10) || '12', chr(10))) AS line FROM documents) GROUP BY doc_id""")
def section_headers(spark, sf_dir):
    """How many lines of each document are headers, with some behind it."""
    lines = F.split(F.concat_ws("\n", "text", F.concat(F.lit("IV. "), "lang"), F.lit("IX. x"), F.upper("source"), F.lit("12")), "\n")
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.explode(lines).alias("line")).groupBy("doc_id").agg(F.count_if(X.is_header(F.col("line"))).alias("headers"))


_LEXICON_SQL = X.LEGAL_WORDS.replace(r"ART\b", r"ART(?:[^\pL\pN_]|$)")


@query(f"SELECT doc_id, CAST(len(regexp_extract_all(text || ' Ley  24 DESPIDO, art 5 articulado CÁMARA', '(?i)(?:{_LEXICON_SQL})')) AS INTEGER) AS hits, text <> '' AS filled FROM documents")
def legal_words(spark, sf_dir):
    """How often the legal lexicon occurs in each document and a line behind it."""
    return table(spark, sf_dir, "documents").select("doc_id", X.legal_hits(F.concat("text", F.lit(" Ley  24 DESPIDO, art 5 articulado CÁMARA"))).alias("hits"), (F.col("text") != "").alias("filled"))
