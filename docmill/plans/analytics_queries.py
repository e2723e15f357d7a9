"""Queries of outcomes, costs, saved items and incremental ingestion. Driver tables stand in for the fields they have the shape of."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docmill.engine import Engine
from docmill.functions import text as X
from docmill.operators import analyze, normalize, rank, store, upsert_log, usage
from docmill.plans.registry import query
from docmill.plans.text_queries import corpus
from docmill.session import scratch_path, table
from docmill.streaming import ingest, runs


def _analyses(spark, sf_dir):
    """labels and documents as analyses; the norms and precedents are words of the text."""
    outcome = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "favorable").when(F.col("quality") == 1, "desfavorable").when(F.col("toxic") == 0, "parcial").otherwise("inadmisible")
    labels = table(spark, sf_dir, "labels").select("doc_id", outcome.alias("resultado"))
    docs = table(spark, sf_dir, "documents")
    words = F.split("text", " ")
    return labels.join(docs, "doc_id").select(
        "doc_id", "resultado", (F.col("n_chars") % 100).cast("double").alias("score"), F.col("doc_id").alias("input_rank"), F.substring("text", 1, 30).alias("caratula"), F.col("source").alias("tribunal"),
        F.col("lang").alias("via_procesal"), F.col("source").alias("doctrina_aplicada"), words.alias("normas_citadas"), words.alias("precedentes_citados"), F.col("text").alias("texto"),
        F.concat(F.lit("19"), F.lpad((F.col("doc_id") % 100).cast("string"), 2, "0")).alias("fecha"),
    )


_A = """a AS (SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'favorable' WHEN quality = 1 THEN 'desfavorable' WHEN toxic = 0 THEN 'parcial' ELSE 'inadmisible' END AS resultado, (n_chars % 100)::DOUBLE AS score,
  substr(text, 1, 30) AS caratula, source AS tribunal, lang AS via, string_split(text, ' ') AS normas, text AS texto, '19' || lpad(CAST(doc_id % 100 AS VARCHAR), 2, '0') AS fecha FROM labels JOIN documents USING (doc_id))"""


@query(f"WITH {_A} SELECT count(*) AS n, count(*) FILTER (resultado = 'favorable') AS favorable, count(*) FILTER (resultado = 'desfavorable') AS desfavorable, count(*) FILTER (resultado = 'parcial') AS parcial, count(*) FILTER (resultado = 'inadmisible') AS inadmisible FROM a")
def outcome_counts(spark, sf_dir):
    return analyze.outcome_counts(_analyses(spark, sf_dir))


@query(f"WITH {_A} SELECT round(100.0::DOUBLE * count(*) FILTER (resultado = 'favorable') / greatest(count(*), 1), 1) AS porcentaje_favorable FROM a")
def favourable_pct_all(spark, sf_dir):
    return analyze.favourable_all(_analyses(spark, sf_dir))


@query(f"WITH {_A} SELECT round(100.0::DOUBLE * count(*) FILTER (resultado = 'favorable') / nullif(count(*) FILTER (resultado <> 'inadmisible'), 0), 1) AS porcentaje_favorable FROM a")
def favourable_pct_merits(spark, sf_dir):
    return analyze.favourable_on_merits(_analyses(spark, sf_dir))


@query(f"""WITH {_A} SELECT doc_id, resultado, texto FROM (SELECT doc_id, resultado, substr(texto, 1, 3000) AS texto, row_number() OVER (PARTITION BY resultado ORDER BY score DESC, doc_id) AS p FROM a)
  WHERE (resultado = 'favorable' AND p <= 3) OR (resultado = 'desfavorable' AND p <= 2)""")
def top_n_per_outcome(spark, sf_dir):
    return analyze.top_per_outcome(_analyses(spark, sf_dir)).select("doc_id", "resultado", "texto")


@query(f"WITH {_A} SELECT resultado, doc_id, caratula FROM a QUALIFY row_number() OVER (PARTITION BY resultado ORDER BY score DESC, doc_id) = 1")
def best_case_per_outcome(spark, sf_dir):
    return analyze.best_per_outcome(_analyses(spark, sf_dir), ["doc_id", "caratula"])


@query(f"""WITH {_A}, g AS (SELECT via AS via_procesal, tribunal AS doctrina_aplicada, count(*) AS frecuencia, round(avg((resultado = 'favorable')::INT) * 100, 1) AS tasa_exito, arg_max(caratula, (score, -doc_id)) AS caso_ejemplo FROM a GROUP BY ALL)
  , l AS (SELECT via AS via_procesal, tribunal AS doctrina_aplicada, count(DISTINCT norma) AS n_leyes FROM (SELECT via, tribunal, unnest(normas) AS norma FROM a) GROUP BY ALL)
  SELECT via_procesal, doctrina_aplicada, frecuencia, tasa_exito, caso_ejemplo, n_leyes, tasa_exito >= 50 AS exitosa,
    row_number() OVER (PARTITION BY tasa_exito >= 50 ORDER BY CASE WHEN tasa_exito >= 50 THEN -tasa_exito ELSE tasa_exito END, frecuencia DESC, via_procesal, doctrina_aplicada) AS puesto FROM g JOIN l USING (via_procesal, doctrina_aplicada)""")
def strategy_ranking(spark, sf_dir):
    out = analyze.strategies(_analyses(spark, sf_dir)).withColumn("n_leyes", F.size("leyes_asociadas").cast("long")).drop("leyes_asociadas")
    return out.withColumn("puesto", F.col("puesto").cast("long"))


@query(f"WITH {_A} SELECT via_procesal, doctrina_aplicada, norma, count(*) AS n FROM (SELECT via AS via_procesal, tribunal AS doctrina_aplicada, unnest(list_distinct(normas)) AS norma FROM a) GROUP BY ALL")
def strategy_norms(spark, sf_dir):
    return analyze.strategy_norms(_analyses(spark, sf_dir))


@query(f"WITH {_A} SELECT norma, count(*) AS n FROM (SELECT unnest(list_distinct(normas)) AS norma FROM a WHERE resultado = 'favorable') GROUP BY norma")
def norm_frequency(spark, sf_dir):
    return analyze.norm_frequency(_analyses(spark, sf_dir))


@query(f"""WITH {_A}, c AS (SELECT resultado, unnest(list_distinct(normas)) AS norma FROM a WHERE resultado IN ('favorable', 'desfavorable')),
  g AS (SELECT norma, count(*) FILTER (resultado = 'favorable') AS favorables, count(*) FILTER (resultado = 'desfavorable') AS desfavorables FROM c GROUP BY norma)
  SELECT *, favorables * desfavorables AS pares FROM g WHERE favorables > 0 AND desfavorables > 0""")
def contradictions(spark, sf_dir):
    return analyze.contradictions(_analyses(spark, sf_dir))


@query(f"""WITH {_A}, w AS (SELECT 1 + CASE WHEN fecha::INT > 1900 AND fecha::INT <= 1999 THEN greatest(0.0::DOUBLE, 1 - (1999 - fecha::INT) / 30.0::DOUBLE) ELSE 0 END + CASE WHEN tribunal = 'src1' THEN 0.5 ELSE 0 END AS w, unnest(list_distinct(normas)) AS precedente FROM a)
  SELECT precedente, count(*) AS citas, round(sum(w), 6) AS peso FROM w GROUP BY precedente ORDER BY peso DESC, citas DESC, precedente LIMIT 10""")
def precedent_ranking(spark, sf_dir):
    return analyze.precedents(_analyses(spark, sf_dir), 10, 1999, supreme=F.col("tribunal") == "src1")


def _calls(spark, sf_dir):
    model = F.when(F.col("event_type") == "click", usage.SMALL).when(F.col("event_type") == "view", usage.MID).when(F.col("event_type") == "purchase", usage.LARGE).otherwise("other")
    return table(spark, sf_dir, "events").select(model.alias("model"), (F.col("event_id") % 1000).alias("input_tokens"), (F.col("event_id") % 77).alias("output_tokens"), F.col("event_type").alias("tool"))


@query(f"""WITH p(model, i, o) AS (VALUES ('{usage.LARGE}', 15.0::DOUBLE, 75.0::DOUBLE), ('{usage.MID}', 3.0, 15.0), ('{usage.SMALL}', 1.0, 5.0)),
  c AS (SELECT CASE event_type WHEN 'click' THEN '{usage.SMALL}' WHEN 'view' THEN '{usage.MID}' WHEN 'purchase' THEN '{usage.LARGE}' ELSE 'other' END AS model, event_id % 1000 AS it, event_id % 77 AS ot, event_type AS tool FROM events)
  SELECT tool, count(*) AS calls, CAST(sum(it) AS BIGINT) AS input_tokens, CAST(sum(ot) AS BIGINT) AS output_tokens, round(sum(coalesce(it / 1e6 * i, 0) + coalesce(ot / 1e6 * o, 0)), 6) AS total_cost_usd FROM c LEFT JOIN p USING (model) GROUP BY tool""")
def cost_by_tool(spark, sf_dir):
    return usage.cost_of_calls(_calls(spark, sf_dir), usage.prices(spark), ["tool"])


@query("""SELECT event_id, round((CASE event_type WHEN 'view' THEN 0.005 WHEN 'click' THEN 0.005 ELSE 0.027 END) * (event_id % 100) * (CASE WHEN event_id % 2 = 0 THEN 1.4 ELSE 1.0 END) + CASE event_type WHEN 'click' THEN 0.05 ELSE 0.52 END, 6)::DOUBLE AS usd FROM events""")
def cost_estimate(spark, sf_dir):
    tier = F.when(F.col("event_type") == "view", "standard").when(F.col("event_type") == "click", "economy").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", F.round(usage.cost_estimate(tier, F.col("event_id") % 100, F.col("event_id") % 2 == 0), 6).alias("usd"))


@query("""SELECT CASE event_type WHEN 'view' THEN 'standard' WHEN 'click' THEN 'economy' ELSE 'premium' END AS tier, count(*) AS n, round(sum(value), 6) AS cost_usd FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 100) GROUP BY 1""")
def usage_latest100_summary(spark, sf_dir):
    tier = F.when(F.col("event_type") == "view", "standard").when(F.col("event_type") == "click", "economy").when(F.col("event_type") == "error", "").otherwise(None)
    logs = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), tier.alias("tier"), F.col("value").alias("cost_usd"), F.col("ts").alias("created_at"))
    return usage.usage_summary(logs).withColumn("cost_usd", F.round("cost_usd", 6))


@query("SELECT event_id AS id, event_type AS type, props AS data FROM events WHERE user_id = 8 AND event_type = 'view'")
def saved_items_list(spark, sf_dir):
    items = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("user_id"), F.col("event_type").alias("type"), F.col("props").alias("data"), F.col("ts").alias("created_at"))
    return usage.saved_items(items, "8", "view").select("id", "type", "data")


@query("SELECT conv_id, turn // 100 AS part, string_agg(turn || ':' || role, '|' ORDER BY turn) AS turns FROM conversations GROUP BY conv_id, part")
def strip_heavy_fields(spark, sf_dir):
    """Conversations in parts of a hundred turns, without the columns and the fields of turns that a list doesn't show; texts are never gathered."""
    parts = table(spark, sf_dir, "conversations").groupBy("conv_id", F.floor(F.col("turn") / 100).alias("part")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "conv_id"))).alias("turns"), F.count("*").alias("n"))
    slim = usage.strip_fields(parts, "turns", ["conv_id"], ["n"])
    return slim.withColumn("turns", F.array_join(F.transform("turns", lambda t: F.concat_ws(":", t["turn"], t["role"])), "|"))


@query("""SELECT count(*) AS processed, count(*) FILTER (length(text) >= 500) AS written, count(*) FILTER (length(text) BETWEEN 100 AND 499) AS skipped, count(*) FILTER (length(text) < 100) AS errors, round(100.0::DOUBLE * count(*) / 2000, 1) AS percent FROM documents""")
def ingest_stats(spark, sf_dir):
    status = F.when(F.length("text") >= 500, "written").when(F.length("text") >= 100, "skipped").otherwise("errors")
    return usage.ingest_stats(table(spark, sf_dir, "documents").select(status.alias("status")), total=2000)


@query("""WITH s AS (SELECT source AS name, CASE WHEN source = 'src3' THEN 'OFFLINE' WHEN source IN ('src1', 'src2') THEN 'STOPPED' ELSE 'RUNNING' END AS state, count(*) AS docs, count(*) FILTER (length(text) < 100) AS errors FROM documents GROUP BY source)
  SELECT name, state, docs, errors, NULL::DOUBLE AS percent, NULL::DOUBLE AS eta_days FROM s
  UNION ALL SELECT NULL, 'DEGRADED', CAST(sum(docs) AS BIGINT), CAST(sum(errors) AS BIGINT), round(sum(docs) * 100.0 / 1000000, 1)::DOUBLE, round((1000000 - sum(docs)) / 57000, 1)::DOUBLE FROM s""")
def fleet_rollup(spark, sf_dir):
    servers = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("name")).agg(F.count("*").alias("count"), F.count_if(F.length("text") < 100).alias("errors"))
    return usage.fleet_rollup(servers.withColumn("status", F.when(F.col("name") == "src3", "OFFLINE").otherwise("OK")).withColumn("running", F.when(F.col("name").isin("src1", "src2"), 0).otherwise(1)))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti_join(spark, sf_dir):
    return store.unseen(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id >= 100")
def offset_resume(spark, sf_dir):
    return ingest.after_offset(table(spark, sf_dir, "documents"), 100, "doc_id").select("doc_id")


@query("""WITH d AS (SELECT source || '/' || lang AS source_id, lang, doc_id AS line FROM documents)
  SELECT source_id, line FROM d WHERE lang = 'fr' UNION ALL
  SELECT source_id, line FROM (SELECT * FROM d WHERE lang <> 'fr' QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY line) = 1)""")
def collect_merge(spark, sf_dir):
    """The French documents are stored; all documents arrive."""
    docs = table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang").alias("source_id"), "lang", F.col("doc_id").alias("line"))
    return store.collect_merge(docs.where("lang = 'fr'").drop("lang"), docs.drop("lang"), order=("line",))


@query("SELECT user_id AS agent_id, arg_max(event_type, event_id) AS status, count(*) AS n_events FROM events GROUP BY user_id")
def agent_state_fold(spark, sf_dir):
    return ingest.agent_states(table(spark, sf_dir, "events").select(F.col("user_id").alias("agent_id"), F.col("event_type").alias("status"), F.col("event_id").alias("seq")))


@query("SELECT status, count(*) AS n FROM (SELECT arg_max(event_type, event_id) AS status FROM events GROUP BY user_id) GROUP BY status")
def agent_status_counts(spark, sf_dir):
    return ingest.agent_counts(table(spark, sf_dir, "events").select(F.col("user_id").alias("agent_id"), F.col("event_type").alias("status"), F.col("event_id").alias("seq")))


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'Error al procesar el fallo' ELSE event_type END AS hechos, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS n_articulos FROM events""")
def ruling_summaries(spark, sf_dir):
    """Answers of a summariser, those of one type cut short."""
    answer = F.when(F.col("event_type") == "error", '{"hechos": "x').otherwise(F.to_json(F.struct(F.col("event_type").alias("hechos"), F.array(F.lit("art. 1")).alias("articulos_citados"))))
    found = analyze.ruling_summary(table(spark, sf_dir, "events"), answer)
    return found.select("event_id", "summary.hechos", F.size("summary.articulos_citados").alias("n_articulos"))


@query(f"""WITH {_A} SELECT doc_id, concat_ws(chr(10), 'Resultado: ' || upper(resultado), 'Carátula: ' || nullif(caratula, ''), 'Vía procesal: ' || via, 'Doctrina: ' || tribunal, chr(10) || 'Normas: ' || nullif(array_to_string(normas[1:8], ', '), '')) AS summary FROM a""")
def agent_summary_text(spark, sf_dir):
    row = {c: F.col(c) for c in ("resultado", "caratula", "via_procesal", "doctrina_aplicada", "normas_citadas")} | {c: F.lit("N/D") for c in ("hechos_determinantes", "argumento_clave", "relevancia_cliente", "quantum")}
    return _analyses(spark, sf_dir).select("doc_id", X.agent_summary(row).alias("summary"))


@query("""SELECT source, documents, chunks FROM (SELECT source, count(*) AS documents FROM documents GROUP BY source)
  FULL JOIN (SELECT source, count(*) AS chunks FROM documents JOIN embeddings ON vec_id = doc_id GROUP BY source) USING (source)""")
def ingest_status(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    chunks = docs.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")
    return Engine(spark, chunks, docs, docs, embedder=lambda texts: []).ingest_status()


@query("""SELECT event_id, ts, value FROM events ORDER BY event_id DESC LIMIT 10""")
def log_tail(spark, sf_dir):
    """The last ten entries of a log, in its order."""
    return store.tail(table(spark, sf_dir, "events").select("event_id", "ts", "value"), 10, "event_id")


@query("""SELECT CAST(strftime(o_orderdate, '%d/%m/%Y') AS VARCHAR) AS day, count(*) AS n FROM orders WHERE strftime(o_orderdate, '%d/%m/%Y') LIKE '%1995' GROUP BY day""")
def session_days_of_year(spark, sf_dir):
    """Sessions by their day as text, of one year, newest first."""
    days = table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "dd/MM/yyyy").alias("day")).agg(F.count("*").alias("n"))
    return normalize.newest_days(days, "day", 1995)


@query("""SELECT event_id, strftime(ts, '%y-%m-%d') AS day, props ->> '$.k' AS k FROM events""")
def short_days_and_properties(spark, sf_dir):
    """Days as yy-MM-dd, and a value of a JSON column as text."""
    return table(spark, sf_dir, "events").select("event_id", X.short_day(F.col("ts")).alias("day"), X.json_text(F.col("props"), "k").alias("k"))


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def items_of_known_users(spark, sf_dir):
    """What is left of items once the users with nothing on their account are deleted."""
    users = table(spark, sf_dir, "customer").where("c_acctbal > 0")
    return usage.of_known_users(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), users, "o_custkey", "c_custkey")


@query("""SELECT doc_id, 'pjn_tribunales' AS source, substr(sha256('pjn:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16) AS id, CASE source WHEN 'src1' THEN 'Buenos Aires' WHEN 'src2' THEN 'Cordoba' ELSE source END AS jurisdiccion
  FROM documents WHERE length(text) >= 300""")
def chamber_entries(spark, sf_dir):
    """Chamber entries as documents: ids, jurisdictions by their codes, texts of 300 characters at least."""
    code = F.when(F.col("source") == "src1", "1-1").when(F.col("source") == "src2", "6-6").otherwise(F.col("source"))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("uuid"), F.lit("").alias("expediente"), F.col("text").alias("texto"), F.lit("").alias("caratula"), F.lit("").alias("tribunal"), F.lit("").alias("fecha"), code.alias("jurisdiccion"))
    return normalize.normalize_chamber(rows).select(F.col("source_id").cast("long").alias("doc_id"), "source", "id", "jurisdiccion")


@query("SELECT d.doc_id AS id, CASE WHEN l.doc_id IS NULL THEN length(text) ELSE -length(text) END AS n FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def upsert_log_read(spark, sf_dir):
    """The store after two batches: all documents, then those with a label once more."""
    log = upsert_log.UpsertLog(spark, scratch_path(spark, "upsert-log"), buckets=16)
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.length("text").cast("long").alias("n"))
    log.upsert(rows, 0)
    log.upsert(rows.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")).distinct(), "id").withColumn("n", -F.col("n")), 1)
    return log.read().select("id", "n")


@query(r"""SELECT doc_id, count(*) AS lines, sha256(coalesce(string_agg(line, chr(10) ORDER BY i), '')) AS lines_sha256 FROM (
    SELECT doc_id, unnest(ls[:len(ls) - 1]) AS line, unnest(range(len(ls) - 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents) WHERE len(ls) > 1) GROUP BY doc_id""")
def cut_stream_lines(spark, sf_dir):
    """The finished lines of every document, whose bytes were cut up into pieces of 97."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("run_id"), F.encode("text", "UTF-8").alias("bytes"))
    pieces = docs.select("run_id", "bytes", F.explode(F.sequence(F.lit(0), F.floor(F.length("bytes") / 97))).alias("seq"))
    lines = runs.lines_of(pieces.select("run_id", "seq", F.substring(F.col("bytes"), F.col("seq") * 97 + 1, F.lit(97)).alias("value")))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda s: s["line"]), "\n")
    return lines.groupBy(F.col("run_id").alias("doc_id")).agg(F.count("*").alias("lines"), F.sha2(whole, 256).alias("lines_sha256"))


#: events as those of analyses, one for each user: purchases end them, errors fail them, signups start their agents.
_RUN_STEPS = {"purchase": "done", "error": "error", "signup": "analyze", "click": "agent_event", "view": "search"}


@query("""WITH e AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq FROM events),
  stop AS (SELECT user_id, min(seq) AS fin FROM e WHERE event_type IN ('purchase', 'error') GROUP BY user_id),
  u AS (SELECT e.*, fin FROM e LEFT JOIN stop USING (user_id) WHERE fin IS NULL OR seq <= fin),
  latest AS (SELECT user_id, max_by(event_type, seq) FILTER (event_type IN ('purchase', 'error', 'signup', 'view')) AS step,
    max(seq) FILTER (event_type = 'signup') AS born, count(*) FILTER (event_type = 'signup') AS n FROM u GROUP BY user_id),
  total AS (SELECT user_id, count(*) AS applied FROM e GROUP BY user_id)
  SELECT user_id::VARCHAR AS run_id, CASE step WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' WHEN 'signup' THEN 'analyze' WHEN 'view' THEN 'search' ELSE 'idle' END AS step,
    (CASE WHEN born IS NULL THEN 0 WHEN EXISTS (SELECT 1 FROM u WHERE u.user_id = l.user_id AND event_type = 'click' AND seq > born) THEN 1 ELSE 0 END)::INTEGER AS agents_active,
    applied FROM latest l JOIN total USING (user_id)""")
def run_states(spark, sf_dir):
    """The state of an analysis for each user, folded from all events."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    step = F.create_map(*(F.lit(x) for kv in _RUN_STEPS.items() for x in kv))[F.col("event_type")]
    rows = table(spark, sf_dir, "events").where("user_id IS NOT NULL").select(
        F.col("user_id").cast("string").alias("run_id"), place.cast("long").alias("seq"), step.alias("step"), F.lit(0).alias("agent_id"), F.lit("active").alias("status"),
        F.lit(None).cast("int").alias("progress"), F.when(F.col("event_type") == "signup", 2).alias("total_agents"), F.lit("").alias("detail"), F.lit(0.0).alias("cost_usd"),
    )
    return runs.run_states(rows).select("run_id", "step", "agents_active", "applied")


_SHOWN = "CASE WHEN len(normas) = 0 THEN 'N/D' ELSE coalesce(nullif(array_to_string(normas, ', '), ''), 'N/D') END"


@query(f"""WITH {_A} SELECT doc_id AS position, sha256(concat_ws(chr(10) || '  ', '[' || doc_id || '] ' || caratula || ' — ' || tribunal || ' — ' || fecha, 'Resultado: ' || resultado, 'Vía procesal: ' || via,
  'Normas: ' || {_SHOWN}, 'Precedentes: ' || {_SHOWN}, 'Doctrina: ' || tribunal, 'Hechos determinantes: N/D', 'Prueba decisiva: N/D', 'Quantum/costas: N/D', 'Votos: N/D', 'Estrategia: ', 'Argumento clave: ', 'Razón resultado: ', 'Relevancia cliente: ')) AS block FROM a""")
def reader_blocks(spark, sf_dir):
    """The block of each analysis, as a synthesiser reads it."""
    return analyze.reader_context(_analyses(spark, sf_dir)).select("position", F.sha2("block", 256).alias("block"))


@query(f"""WITH {_A}, t AS (SELECT *, row_number() OVER (PARTITION BY resultado ORDER BY score DESC, doc_id) AS place FROM a)
  SELECT resultado, place, sha256(chr(10) || chr(10) || '--- FALLO COMPLETO (' || upper(resultado) || '): ' || caratula || ' ---' || chr(10) || substr(texto, 1, 3000) || chr(10)) AS section
  FROM t WHERE texto <> '' AND (resultado = 'favorable' AND place <= 3 OR resultado = 'desfavorable' AND place <= 2)""")
def key_texts(spark, sf_dir):
    """The texts that follow the blocks."""
    return analyze.key_texts(_analyses(spark, sf_dir)).select("resultado", F.col("place").cast("long").alias("place"), F.sha2("section", 256).alias("section"))


@query(f"""WITH {_A}, c AS (SELECT count(*) AS n, count(*) FILTER (resultado = 'favorable') AS f FROM a)
  SELECT round(100.0::DOUBLE * f / greatest(n, 1), 1) AS porcentaje_favorable, 'De ' || greatest(n, 1) || ' fallos analizados, ' || f || ' fueron favorables (' || CAST(round(100.0::DOUBLE * f / greatest(n, 1), 1) AS VARCHAR) || '%).' AS recomendacion_estrategica FROM c""")
def synthesis_fallback(spark, sf_dir):
    """What is said where no synthesiser answered."""
    return analyze.fallback_synthesis(_analyses(spark, sf_dir)).select("porcentaje_favorable", "recomendacion_estrategica")


def _logs(spark, sf_dir):
    """orders as usage logs of customers; every fourth tier isn't known."""
    tier = F.element_at(F.array(F.lit("premium"), F.lit("gold"), F.lit(""), F.lit(None)), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), tier.alias("tier"), F.col("o_orderdate").alias("created_at"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 4 <> 1")
def valid_usage_rows(spark, sf_dir):
    return usage.valid_usage(_logs(spark, sf_dir)).select("id")


@query("SELECT o_orderkey AS id FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100")
def usage_newest(spark, sf_dir):
    """The newest logs of one user."""
    logs = _logs(spark, sf_dir)
    return usage.usage_list(logs, logs.agg(F.min("user_id")).first()[0]).select("id")


@query("""WITH c AS (SELECT o_orderkey, year(o_orderdate) AS y, o_totalprice / 1e6 AS s, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders QUALIFY r <= 500)
  SELECT o_orderkey, row_number() OVER (ORDER BY round(s + CASE WHEN y <= 1998 THEN greatest(0.0, 0.15 * (1 - (1998 - y) / 30.0)) ELSE 0 END, 9) DESC, r) AS input_rank FROM c""")
def recency_order(spark, sf_dir):
    """The order of the 500 dearest orders (a search's greatest fetch) after the boost for their dates."""
    top = table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(500)
    place = F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey"))
    rows = top.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("fecha"), (F.col("o_totalprice").cast("double") / 1e6).alias("rerank_score"), place.alias("input_rank"))
    return rank.recency(rows, 1998).selectExpr("o_orderkey", "CAST(input_rank AS BIGINT) AS input_rank")
