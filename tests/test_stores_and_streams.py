"""The upsert log, the offset source, the fold of runs, cut streams, isolated readers and owned rows."""

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from docmill.engine import Engine, read_each, read_rulings
from docmill.operators import analyze, owned, upsert_log, usage
from docmill.operators.chunk import chunks, cut
from docmill.functions import text as X
from docmill.sources import offsets
from docmill.streaming import runs


def stored(log, version=None):
    return {r.id: r.v for r in log.read(version).collect()}


# ---- upsert log


def test_upserts(spark, tmp_path):
    """The first of a batch counts, a later batch replaces, null ids fall out, a number counts once."""
    log = upsert_log.UpsertLog(spark, str(tmp_path), buckets=8)
    assert log.read() is None and log.versions() == []
    frame = lambda rows: spark.createDataFrame(rows, "id string, v int, at int")
    assert log.upsert(frame([("a", 2, 2), ("a", 1, 1), ("b", 1, 1), (None, 9, 1)]), 0, order=("at",))
    assert stored(log) == {"a": 1, "b": 1}
    assert log.upsert(frame([("b", 5, 1), ("c", 5, 2)]), 1) and not log.upsert(frame([("b", 7, 1)]), 1)
    assert stored(log) == {"a": 1, "b": 5, "c": 5} and stored(log, 0) == {"a": 1, "b": 1}
    assert log.upsert(frame([]), 2) and stored(log) == {"a": 1, "b": 5, "c": 5}


def test_batches_open_only_files_that_may_hold_their_ids(spark, tmp_path):
    log = upsert_log.UpsertLog(spark, str(tmp_path), buckets=4)
    rows = lambda a, z, v: spark.range(a, z).select(F.col("id"), F.lit(v).alias("v"))
    log.upsert(rows(0, 400, 0), 0)
    first = {r.file for r in log.manifest().collect()}
    log.upsert(rows(1000, 1400, 1), 1)  # ids of its own: filters keep most files shut
    assert len(first & {r.file for r in log.manifest().collect()}) >= 0
    log.upsert(spark.createDataFrame([(5, 2)], "id long, v int"), 2)
    kept = {r.file for r in log.manifest().collect()}
    touched = log._keyed(spark.createDataFrame([(5,)], "id long")).first()["__b"]
    assert all(f in kept for f in first if not f.endswith(f"__b={touched}") and f in {r.file for r in log.manifest(1).collect()})
    got = stored(log)
    assert len(got) == 800 and got[5] == 2 and got[6] == 0 and got[1000] == 1
    assert {r.bucket for r in log.manifest().collect()} == {0, 1, 2, 3}
    assert "PartitionFilters" in log.read(buckets=[touched])._jdf.queryExecution().executedPlan().toString()
    assert log.read(buckets=[touched]).count() < 800 and len(log.read(buckets=[touched]).inputFiles()) < len(log.read().inputFiles())


def test_filters_let_no_stored_id_down(spark):
    import numpy as np

    h, g = (np.random.default_rng(k).integers(-(1 << 62), 1 << 62, 5000) for k in (1, 2))
    f = upsert_log.bloom(h, g)
    assert upsert_log.may_hold(f, h, g).all() and upsert_log.may_hold(f, h[::-1] + 1, g).mean() < 0.05


def test_compaction_and_vacuum(spark, tmp_path):
    log = upsert_log.UpsertLog(spark, str(tmp_path), buckets=2)
    for k in range(4):
        log.upsert(spark.range(k * 10, k * 10 + 12).withColumn("v", F.lit(k)), k)
    want = stored(log)
    assert log.compact(9, files=1) > 0 and stored(log) == want
    assert log.manifest().groupBy("bucket").count().agg(F.max("count")).first()[0] == 1
    assert log.vacuum(keep=1) > 0 and stored(log) == want and log.versions() == [9]


def test_inserts_keep_what_is_stored(spark, tmp_path):
    log = upsert_log.UpsertLog(spark, str(tmp_path), buckets=2)
    frame = lambda rows: spark.createDataFrame(rows, "id string, v int")
    log.insert(frame([("a", 1), ("b", 1)]), 0)
    files = {r.file for r in log.manifest().collect()}
    assert log.insert(frame([("b", 2), ("c", 2), ("c", 3)]), 1) and not log.insert(frame([("d", 9)]), 1)
    assert stored(log) == {"a": 1, "b": 1, "c": 2} and files <= {r.file for r in log.manifest().collect()}


def test_progress_is_what_a_recount_gives(spark, tmp_path):
    import time

    from docmill.streaming import ingest

    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps({"id": None if i == 0 else f"{k}-{i}", "v": i}) for i in range(5 + k)))
    log = ingest.ProgressLog()
    spark.streams.addListener(log)
    try:
        ingest.ingest(ingest.new_files(spark, str(tmp_path / "in"), spark.createDataFrame([], "id string, v int").schema, 1), str(tmp_path / "store"), str(tmp_path / "mark"), buckets=2).awaitTermination()
        for _ in range(100):
            if log.ended:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(log)
    told = [json.loads(r.observed)["ingest"] for r in log.table(spark).collect()]
    assert sum(t["read"] for t in told) == 18 and sum(t["without_id"] for t in told) == 3
    log.write(spark, str(tmp_path / "progress"))
    assert spark.read.parquet(str(tmp_path / "progress")).agg(F.sum("input_rows")).first()[0] == 18 and not log.rows
    assert ingest.read_store(spark, str(tmp_path / "store")).count() == 15


# ---- offsets


def test_offsets_resume_without_loss_or_repeat(spark, tmp_path):
    """Files grow between runs; a line that isn't finished waits; small splits cut lines at any byte."""
    source, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    source.mkdir()

    def run():
        q = offsets.growing_lines(spark, str(source), split=7).writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(r.value for r in spark.read.parquet(out).collect())

    (source / "a.jsonl").write_bytes(b'{"id": 1}\n{"id": 22}\r\n\n{"id"')
    (source / "ignored.txt").write_text("x\n")
    assert run() == ["", '{"id": 1}', '{"id": 22}']
    with (source / "a.jsonl").open("ab") as f:
        f.write(': 3, "t": "é日"}\n'.encode())
    (source / "b.jsonl").write_bytes(b"first\nsecond\n")
    assert run() == ["", "first", "second", '{"id": 1}', '{"id": 22}', '{"id": 3, "t": "é日"}']
    assert len(run()) == 6


# ---- runs


def events(n=40, seed=3):
    draw = random.Random(seed)
    out = []
    for run in range(6):
        steps = [dict(step="search"), dict(step="analyze", total_agents=3)] + [dict(step="agent_event", agent_id=draw.choice([-1, 0, 1, 2, 9]), status=draw.choice(["active", "done", "error"])) for _ in range(10)]
        steps += [dict(step="analyze", progress=50, cost_usd=0.5), dict(step="synthesize", cost_usd=1.0)] + [[dict(step="done", cost_usd=2.0)], [dict(step="error", detail="x")], [dict(step="cancelled")], []][run % 4] + [dict(step="search")] * (run % 2)
        out += [(f"r{run}", i, e.get("step"), e.get("agent_id"), e.get("status"), e.get("progress"), e.get("total_agents"), e.get("detail"), e.get("cost_usd")) for i, e in enumerate(steps)]
    return out


SCHEMA = "run_id string, seq long, step string, agent_id int, status string, progress int, total_agents int, detail string, cost_usd double"


def test_batch_and_stream_of_shuffled_events_agree(spark, tmp_path):
    rows = events()
    want = {r.run_id: tuple(r) for r in runs.run_states(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {k: v[1] for k, v in want.items()} == {"r0": "done", "r1": "error", "r2": "cancelled", "r3": "search", "r4": "done", "r5": "error"} and want["r1"][3] == "x"
    mixed = rows + rows[:20]
    random.Random(1).shuffle(mixed)
    for k in range(5):
        spark.createDataFrame(mixed[k::5], SCHEMA).coalesce(1).write.json(str(tmp_path / "in" / str(k)))
    files = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    seen = {}

    def keep(batch, _):
        seen.update({r.run_id: tuple(r) for r in batch.collect()})

    runs.run_stream(files).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start().awaitTermination()
    assert seen == want


def test_events_wait_for_those_before_them(spark):
    rows = [r for r in events() if r[0] == "r0" and r[1] != 1]
    got = runs.run_states(spark.createDataFrame(rows, SCHEMA)).first()
    assert (got.step, got.applied, got.waiting) == ("search", 1, len(rows) - 1)


@pytest.mark.parametrize("seed", range(3))
def test_streams_cut_anywhere_give_the_same_events(spark, seed):
    text = 'event: x\ndata: {"step": "é日🙂"}\ndata:  {"n": 1} \r\n\ndata: {oops\ndata: \ndata: {"last": true}\ndata: {"open": 1}'.encode()
    draw = random.Random(seed)
    cuts = sorted({0, len(text), *(draw.randrange(len(text)) for _ in range(draw.choice([1, 12, 60])))})
    pieces = [("s", i, bytearray(text[a:z])) for i, (a, z) in enumerate(zip(cuts, cuts[1:]))]
    draw.shuffle(pieces)
    chunks_ = spark.createDataFrame(pieces + pieces[:1] + [("t", 0, bytearray(b"no line feed"))], "run_id string, seq int, value binary")
    assert [json.loads(r.event) for r in runs.events_of(chunks_).orderBy("place").collect()] == [{"step": "é日🙂"}, {"n": 1}, {"last": True}]


# ---- readers


def test_a_failing_ruling_is_lost_alone(spark):
    """One fails always, one at first; costs of failed calls are counted."""
    df = spark.createDataFrame([(i, f"t{i}") for i in range(7)], "id int, texto string").coalesce(1)

    def reader(p: pd.DataFrame) -> pd.DataFrame:
        if (p.texto == "t3").any() or ((p.texto == "t5").any() and len(p) > 1):
            raise RuntimeError("no answer")
        return pd.DataFrame({"resultado": "ok-" + p.texto, "normas": [["a", "b"]] * len(p)})

    got = {r.source_key: r for r in read_each(df, reader, "resultado string, normas array<string>", retries=2).collect()}
    assert got[3].error == "RuntimeError: no answer" and got[3].attempts == 4 and got[3].resultado is None
    assert all(got[i].error is None and got[i].attempts == 2 and got[i].resultado == f"ok-t{i}" for i in (0, 1, 2, 4, 5, 6))
    assert read_rulings(df, reader, "resultado string, normas array<string>").count() == 6


# ---- owned rows


def test_owned_rows(spark, tmp_path):
    mine, yours = (owned.OwnedRows(spark, str(tmp_path), u) for u in ("u", "v"))
    for bad in ("", "  ", None):
        with pytest.raises(ValueError, match="owner"):
            owned.OwnedRows(spark, str(tmp_path), bad)
    a, b = mine.save("analisis", "A"), yours.save("escrito", "B")
    mine.save("resumen", "C")
    assert {r.title for r in mine.items().collect()} == {"A", "C"} and [r.title for r in mine.items("analisis").collect()] == ["A"]
    with pytest.raises(KeyError):
        mine.delete(b)
    mine.delete(a)
    assert [r.title for r in mine.items().collect()] == ["C"] and [r.title for r in yours.items().collect()] == ["B"]
    with pytest.raises(ValueError, match="type"):
        mine.save("other", "D")
    mine.log("analisis", None, 10, "0.1")
    mine.log("analisis", "economy", 10, 0.2)
    yours.log("analisis", "premium", 1, 5)
    for tier, cost in (("gold", 1), ("economy", -1)):
        with pytest.raises(ValueError):
            mine.log("analisis", tier, 1, cost)
    assert mine.usage().count() == 2 and {r.tier: float(r.cost_usd) for r in mine.usage_by_tier().collect()} == {"premium": 0.1, "economy": 0.2}


# ---- what had no test


def test_reader_block_and_key_texts(spark):
    rows = [(1, "favorable", "A v. B", 0.9, "text one", ["n1", "n2"], "3-0"), (2, "favorable", None, 0.5, "", [], None), (3, "desfavorable", "C", 0.7, "t" * 4000, None, None), (4, "parcial", "D", 1.0, "x", None, None)]
    df = spark.createDataFrame(rows, "input_rank int, resultado string, caratula string, score double, texto string, normas_citadas array<string>, votos string")
    block = analyze.reader_context(df).orderBy("position").first().block
    assert block == "[1] A v. B —  — \n  Resultado: favorable\n  Vía procesal: N/D\n  Normas: n1, n2\n  Precedentes: N/D\n  Doctrina: N/D\n  Hechos determinantes: N/D\n  Prueba decisiva: N/D\n  Quantum/costas: N/D\n  Votos: 3-0\n  Estrategia: \n  Argumento clave: \n  Razón resultado: \n  Relevancia cliente: "
    texts = {r.resultado: r.section for r in analyze.key_texts(df).collect()}
    assert texts == {"favorable": "\n\n--- FALLO COMPLETO (FAVORABLE): A v. B ---\ntext one\n", "desfavorable": "\n\n--- FALLO COMPLETO (DESFAVORABLE): C ---\n" + "t" * 3000 + "\n"}
    told = analyze.fallback_synthesis(df).first()
    assert told.porcentaje_favorable == 50.0 and told.recomendacion_estrategica == "De 4 fallos analizados, 2 fueron favorables (50.0%)." and told.leyes_clave == []


def test_reasoning(spark):
    texts = ["<razonamiento>why</razonamiento>{}", "a<razonamiento>b<razonamiento>c</razonamiento>d</razonamiento> {} ", "<razonamiento>open {}", " {} ", "x</razonamiento>y", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(X.reasoning_of(F.col("t")).alias("why"), X.after_reasoning(F.col("t")).alias("rest")).collect()
    assert [tuple(r) for r in got] == [("why", "{}"), ("c", "{}"), ("open {}", "<razonamiento>open {}"), ("", " {} "), ("", "x</razonamiento>y"), ("", "")]


def test_small_helpers(spark):
    one = spark.createDataFrame([(0.256, ["a"], None, "Título", [{"a": 1, "b": 2}], "s")], "p double, x array<string>, y array<string>, t string, l array<struct<a:int,b:int>>, z string")
    row = one.select(X.percent_label(F.col("p")).alias("p"), analyze.first_of("y", "x").alias("f"), usage.item_title("Caso: ", F.col("t"), 3).alias("t")).first()
    assert tuple(row) == ("26%", ["a"], "Caso: Tít")
    assert usage.strip_fields(one, "l", ["a"], ["z"]).schema["l"].dataType.simpleString() == "array<struct<b:int>>" and "z" not in usage.strip_fields(one, "l", ["a"], ["z"]).columns
    logs = spark.createDataFrame([("1", "u", "gold", 1), ("2", "v", "", 2), ("3", "u", None, 3), ("4", "u", "economy", 4)], "id string, user_id string, tier string, created_at int")
    assert [r.id for r in usage.valid_usage(logs).orderBy("id").collect()] == ["2", "3", "4"] and [r.id for r in usage.usage_list(logs, "u", 2).collect()] == ["4", "3"]
    hits = spark.createDataFrame([("", "b" * 300, "T"), (None, None, None)], "sumario string, texto string, caratula string")
    assert [(r.resumen, r.argumento) for r in analyze.fallback_summary(hits).collect()] == [("b" * 200, "T"), ("", "")]


def test_money_is_decimal(spark):
    calls = spark.createDataFrame([(usage.SMALL, 1, 0)] * 3 + [("none", 5, 5), (usage.LARGE, None, 7)], "model string, input_tokens long, output_tokens long")
    assert usage.cost_of_calls(calls, usage.prices(spark)).first().total_cost_usd == 0.000528


def test_search_cleans_markup_and_stands_empty_results(spark):
    """Titles are compared without their tags; nothing found is an empty frame; with and without an index the same columns are searched."""
    rows = [("1", "[[p]]Caso uno[[/p]]", "despido sin causa [[r uuid:1]]"), ("2", "Caso uno", "despido sin causa"), ("3", "Otro", "despido y daño"), ("4", "Más", "x" * 3000 + " tardío despido")]
    docs = spark.createDataFrame([(i, t, b, "", "", "m", "", "s", [1.0, float(i)]) for i, t, b in rows], "id string, caratula string, texto string, sumario string, tribunal string, materia string, fecha string, source string, embedding array<double>")
    engine = Engine(spark, docs, docs, docs.select("id", "texto"), lambda texts: [[1.0, 0.5]] * len(texts), least=None)
    got = engine.search("despido sin causa", 10).collect()
    assert {r.caratula for r in got} == {"Caso uno", "Otro", "Más"} and all("[[" not in r.caratula for r in got)
    from docmill import jobs
    from docmill.operators import keyword, keyword_index, store
    from docmill.engine import KEYWORD_COLUMNS
    from docmill.session import scratch_path

    index = scratch_path(spark, "words")
    keyword_index.build_index(store.index_rows(docs), index, "doc_id", KEYWORD_COLUMNS)
    again = Engine(spark, docs, docs, docs.select("id", "texto"), lambda texts: [[1.0, 0.5]] * len(texts), least=None, keywords=index)
    assert {(r.id, r._source) for r in again.search("despido sin causa", 10).collect()} == {(r.id, r._source) for r in got}
    none = Engine(spark, docs.where("false"), docs.where("false"), docs.where("false").select("id", "texto"), lambda texts: [[1.0, 0.5]] * len(texts))
    assert none.search("despido", 10).collect() == [] and jobs


def test_chunks_take_time_in_proportion(spark):
    import time

    def took(text):
        best = 9.0
        for _ in range(3):
            began = time.perf_counter()
            cut(text)
            best = min(best, time.perf_counter() - began)
        return best

    text = "Some words here. And more.\n\n" * 20_000
    assert took(text * 10) < 25 * took(text)
    assert spark.createDataFrame([(None,), ("a",)], "t string").select(chunks(F.col("t")).alias("c")).collect() == [([""],), (["a"],)]
