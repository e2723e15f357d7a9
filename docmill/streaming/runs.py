"""The progress of analyses from their events, folded in order: as a table and as a stream with keyed state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Steps after which nothing changes a run.
FINAL = ("done", "error", "cancelled")
RUN = "run_id string, step string, progress int, detail string, agents_idle int, agents_active int, agents_done int, agents_error int, synthesizer_active boolean, cost_usd double, applied long, waiting long"


def start() -> dict:
    return {"next": 0, "step": "idle", "progress": 0, "detail": "", "agents": {}, "total": 0, "synth": False, "cost": 0.0, "held": {}}


def fold(state: dict, event: dict) -> dict:
    """The run after an event (step, agent_id, status, progress, total_agents, detail, cost_usd). A final run stays as it is."""
    if state["step"] in FINAL:
        return state
    step, cost = event.get("step"), event.get("cost_usd") or 0.0
    if step == "error":
        return state | {"step": "error", "detail": event.get("detail") or "Error de validación"}
    if step == "search":
        return state | {"step": "search", "progress": 0, "detail": event.get("detail") or "", "cost": 0.0}
    if step == "analyze" and event.get("total_agents"):
        n = int(event["total_agents"])
        return state | {"step": "analyze", "progress": 0, "detail": event.get("detail") or "", "total": n, "agents": {str(i): "idle" for i in range(n)}, "synth": False, "cost": 0.0}
    if step == "agent_event":
        agent = event.get("agent_id")
        if agent == -1:
            return state | {"synth": event.get("status") == "active", "cost": cost}
        if agent is not None and str(int(agent)) in state["agents"]:
            return state | {"agents": state["agents"] | {str(int(agent)): event.get("status")}, "cost": cost}
        return state
    if step == "analyze":
        progress = event.get("progress")
        return state | {"step": "analyze", "progress": state["progress"] if progress is None else int(progress), "detail": event.get("detail") or "", "cost": cost}
    if step == "synthesize":
        return state | {"step": "synthesize", "progress": 100, "detail": event.get("detail") or "", "synth": True, "cost": cost}
    if step == "cancelled":
        return state | {"step": "cancelled", "detail": event.get("detail") or "Análisis cancelado", "synth": False, "cost": cost}
    if step == "done":
        return state | {"step": "done", "progress": 100, "detail": "Análisis completo", "synth": False, "cost": cost}
    return state


def _taken(state: dict, events: pd.DataFrame) -> dict:
    """The state after events that come in any order: each is applied when all before it (seq from 0) are, others are held; of one seq the first counts."""
    held = dict(state["held"])
    for e in events.to_dict("records"):
        if e["seq"] is not None and e["seq"] == e["seq"] and int(e["seq"]) >= state["next"]:
            held.setdefault(str(int(e["seq"])), {k: None if v is None or v != v else v for k, v in e.items() if k not in ("run_id", "seq")})
    while str(state["next"]) in held:
        state = fold(state, held.pop(str(state["next"]))) | {"next": state["next"] + 1}
    return state | {"held": held}


def _row(run: str, s: dict) -> pd.DataFrame:
    count = lambda status: sum(v == status for v in s["agents"].values())
    return pd.DataFrame([(run, s["step"], s["progress"], s["detail"], count("idle"), count("active"), count("done"), count("error"), s["synth"], float(s["cost"]), s["next"], len(s["held"]))], columns=[c.split()[0] for c in RUN.split(", ")])


def run_states(events: DataFrame) -> DataFrame:
    """RUN for each run of a table of events (run_id, seq from 0, step, agent_id, status, progress, total_agents, detail, cost_usd).

    Events of a run are those of one analysis, so one task folds them. Without a run_id they fall out.
    """

    def one(key, rows: pd.DataFrame) -> pd.DataFrame:
        return _row(key[0], _taken(start(), rows.sort_values("seq", kind="stable")))

    return events.where("run_id IS NOT NULL").groupBy("run_id").applyInPandas(one, RUN)


def run_stream(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """run_states() of a stream, in update mode: the state of each run that a batch had events of.

    Events may come in any order and several times. A run without an event for `idle_ms` ends as an error.
    """
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout

    def one(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = json.loads(state.get[0]) if state.exists else start()
        if state.hasTimedOut:
            known = fold(known, {"step": "error", "detail": f"no event for {idle_ms} ms"})
        else:
            for rows in batches:
                known = _taken(known, rows)
        state.update((json.dumps(known),))
        if idle_ms and known["step"] not in FINAL:
            state.setTimeoutDuration(idle_ms)
        yield _row(key[0], known)

    return events.where("run_id IS NOT NULL").groupBy("run_id").applyInPandasWithState(one, RUN, "state string", "update", timeout)


def lines_of(chunks: DataFrame, key: str = "run_id", order: str = "seq", value: str = "value") -> DataFrame:
    """key, place, line: the finished lines of streams of bytes that were cut anywhere, also within a character.

    A line goes from one line feed to the next, over as many chunks as that takes; what follows the last one isn't finished and falls out. Chunks of
    a stream are ordered by `order`; a chunk that stands there twice counts once. Bytes are put together first and read as UTF-8 then.
    """
    once = chunks.dropDuplicates([key, order]).select(key, order, F.decode(value, "ISO-8859-1").alias("text"))
    parts = once.select(key, order, F.posexplode(F.split("text", "\n", -1)).alias("i", "part"))
    before = Window.partitionBy(key).orderBy(order, "i")
    numbered = parts.withColumn("place", F.sum((F.col("i") > 0).cast("long")).over(before))
    last = numbered.withColumn("last", F.max("place").over(Window.partitionBy(key))).where(F.col("place") < F.col("last"))
    whole = last.groupBy(key, "place").agg(F.array_sort(F.collect_list(F.struct(order, "i", "part"))).alias("x"))
    text = F.decode(F.encode(F.array_join(F.transform("x", lambda s: s["part"]), ""), "ISO-8859-1"), "UTF-8")
    return whole.select(key, "place", text.alias("line"))


def events_of(chunks: DataFrame, key: str = "run_id", order: str = "seq", value: str = "value") -> DataFrame:
    """key, place, event: the JSON of the 'data: ' lines of cut streams; other lines, empty and malformed ones fall out."""
    lines = lines_of(chunks, key, order, value).where(F.col("line").startswith("data: "))
    body = lines.select(key, "place", F.trim(F.regexp_replace(F.substring("line", 7, 1 << 30), r"\s+$", "")).alias("event"))
    return body.where((F.col("event") != "") & F.try_parse_json("event").isNotNull())
