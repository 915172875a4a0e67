"""Emissions as keyed state over an ordered stream: what is on a board under which key, and what each batch does to it.

Keys of one bill share a stem, and a batch may move a task from an older key of the stem to a new one, so the state is
kept per stem. The same transition serves a replay of stored events and a stream."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

#: Kinds of keys under which a moved due date keeps its task.
MOVABLE = ("obligation-due:", "estimate-review:")
DUE = MOVABLE[0]
#: Order of the kinds of events of a batch: whether a bill is open, what the user did, retirements, then items.
PHASES = {"bill": 0, "close": 1, "adopt": 1, "retire": 2, "item": 3}
EVENT = "stem string, batch long, phase int, seq long, kind string, surface_key string, content_hash string, task_id string, status string, gone boolean"
RESULT = "stem string, batch long, seq long, surface_key string, action string, task_id string, rekeyed_from string, status string, content_hash string, created long"


def stem(key: Column) -> Column:
    """The key without its last part where it may move and has three parts or more, else the key."""
    movable = F.startswith(key, F.lit(MOVABLE[0])) | F.startswith(key, F.lit(MOVABLE[1]))
    parts = F.size(F.split(key, ":"))
    return F.when(movable & (parts >= 3), F.regexp_replace(key, ":[^:]*$", "")).otherwise(key)


def events(rows: DataFrame) -> DataFrame:
    """EVENT rows of rows with the columns of EVENT but stem and phase; a key that is null goes."""
    phase = F.lit(None).cast("int")
    for kind, n in PHASES.items():
        phase = F.when(F.col("kind") == kind, n).otherwise(phase)
    names = [c.split()[0] for c in EVENT.split(", ")]
    return rows.where("surface_key is not null").withColumns({"stem": stem(F.col("surface_key")), "phase": phase}).select(*names)


def advance(state: dict[str, dict], batch: list[dict]) -> list[dict]:
    """Applies one batch of a stem's events, in order, to `state` (by key: task, status, hash, created, bill); returns
    what was done. A key without task has only its bill's state.

    Open tasks are retired before items. An item of a resolved key stays resolved; an open one with the same content is
    skipped, with other content updated, or, if its task is gone, closed for good. Without an open task the oldest
    open task of the stem moves to the new key, unless its key is in the batch too or its bill is still open;
    else a task is created, for retired keys as well."""
    asked = {e["surface_key"] for e in batch if e["kind"] == "item"}
    done = []
    for e in batch:
        key, kind = e["surface_key"], e["kind"]
        row = state.setdefault(key, {"task": None, "status": None, "hash": None, "created": None, "bill": False})
        action, moved = None, None
        if kind == "bill":
            row["bill"] = e["status"] == "open"
        elif kind == "close":
            if row["status"]:
                row["status"] = e["status"]
        elif kind == "adopt":
            action = "updated" if row["status"] else "adopted"
            if not row["status"]:
                row |= {"status": "open", "hash": e["content_hash"], "created": e["batch"]}
            row["task"] = e["task_id"]
        elif kind == "retire":
            if row["status"] == "open":
                row["status"], action = "retired", "retired"
        elif row["status"] in ("completed", "deleted_by_user"):
            action = "resolved"
        elif row["status"] == "open" and row["hash"] == e["content_hash"]:
            action = "skipped"
        elif row["status"] == "open" and e["gone"]:
            row["status"], action = "deleted_by_user", "closed"
        elif row["status"] == "open":
            row["hash"], action = e["content_hash"], "updated"
        else:
            older = [(x["created"], k) for k, x in state.items() if x["status"] == "open" and k != key and k not in asked and not (key.startswith(DUE) and x["bill"])] if e["stem"] != key else []
            action, task, created = "created", f"{e['batch']}-{e['seq']}", e["batch"]
            if older and e["gone"]:
                state[min(older)[1]]["status"] = "deleted_by_user"
            elif older:
                moved = min(older)[1]
                task, created, action = state[moved]["task"], state[moved]["created"], "rekeyed"
                state[moved] |= {"task": None, "status": None, "hash": None, "created": None}
            row |= {"task": task, "status": "open", "hash": e["content_hash"], "created": created}
        if action:
            done.append({"stem": e["stem"], "batch": e["batch"], "seq": e["seq"], "surface_key": key, "action": action, "task_id": row["task"], "rekeyed_from": moved})
    return done


def _ledger(name: str, state: dict[str, dict], batch: int) -> list[dict]:
    return [{"stem": name, "batch": batch, "surface_key": k, "task_id": x["task"], "status": x["status"], "content_hash": x["hash"], "created": x["created"]} for k, x in sorted(state.items()) if x["status"]]


def _batches(rows: Iterator[dict]) -> Iterator[tuple[str, int, list[dict]]]:
    held: list[dict] = []
    for e in rows:
        if held and (e["stem"], e["batch"]) != (held[0]["stem"], held[0]["batch"]):
            yield held[0]["stem"], held[0]["batch"], held
            held = []
        held.append(e)
    if held:
        yield held[0]["stem"], held[0]["batch"], held


def replay(rows: DataFrame) -> DataFrame:
    """RESULT rows of all EVENT rows in order: what was done, and, with a null action and the last batch, the ledger.

    A task passes over its sorted stems and holds one stem's keys and one batch of it at a time."""
    kinds = {"string": pa.string(), "long": pa.int64()}
    schema = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in RESULT.split(", "))])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state, last, out = None, {}, 0, []
        for stem_, batch, held in _batches(e for b in parts for e in b.to_pylist()):
            if stem_ != name:
                out += _ledger(name, state, last)
                name, state = stem_, {}
            out += advance(state, held)
            last = batch
            if len(out) >= 1 << 14:
                yield pa.RecordBatch.from_pylist([dict.fromkeys(schema.names) | r for r in out], schema)
                out = []
        out += _ledger(name, state, last)
        if out:
            yield pa.RecordBatch.from_pylist([dict.fromkeys(schema.names) | r for r in out], schema)

    return rows.repartition("stem").sortWithinPartitions("stem", "batch", "phase", "seq").mapInArrow(run, RESULT)


def stream(rows: DataFrame) -> DataFrame:
    """The same over a stream of EVENT rows whose triggers hold whole batches in order: after each trigger, what was
    done and the ledger of the stems it touched. State: one text per stem, kept in the checkpoint."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        state = json.loads(held.get[0]) if held.exists else {}
        got = pd.concat(list(frames)).sort_values(["batch", "phase", "seq"])
        out, last = [], 0
        for name, batch, some in _batches(iter(got.astype(object).where(got.notna(), None).to_dict("records"))):
            out += advance(state, some)
            last = batch
        held.update((json.dumps(state),))
        names = [c.split()[0] for c in RESULT.split(", ")]
        table = pd.DataFrame([*out, *_ledger(key[0], state, last)], columns=names)
        yield table.astype({"batch": "Int64", "seq": "Int64", "created": "Int64"})

    return rows.groupBy("stem").applyInPandasWithState(run, RESULT, "state string", "append", GroupStateTimeout.NoTimeout)
