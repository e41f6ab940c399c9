"""Events of a stream handed on in order of their time, though they arrive out of order, with state that is dropped when a key falls silent.

A key's events wait in its state until the watermark, ``delay`` behind the latest event of all keys, has passed them; then they are folded in order of time
and a tie-breaking column.  Later than that, Spark drops events.  After a pause of more than ``gap`` a key begins anew; this goes by the events' times alone, so
that the result doesn't depend on how events fall into micro-batches, and a timer drops the state of a key that has been silent for as long.  State holds a key's
memory and what came within ``delay``; a key's share of a micro-batch is sorted in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.traces import ENTRY

#: fold(key, memory, events in order) gives the new memory and rows to emit.
Fold = Callable[[tuple, tuple, list[dict[str, Any]]], tuple[tuple, list[tuple]]]


def _values(column: pd.Series) -> list:
    """Without frames, which cost more than the few rows in them."""
    found = column.tolist()
    return [None if null else x for x, null in zip(found, column.isna(), strict=True)] if column.hasnans else found


def in_order(events: DataFrame, keys: list[str], tie: str, fold: Fold, start: tuple, memory: str, emitted: str, delay: str, gap_seconds: int) -> DataFrame:
    """emitted (a schema: the keys, then what fold gives), in append mode.  events: a streaming frame of the keys, ts, the tie-breaking column and others.

    start: what a key's memory, of the schema ``memory``, is at first.  Events without a time, or with a null key, are left out.
    """
    rows = events.withWatermark("ts", delay).where(" and ".join(f"`{c}` is not null" for c in [*keys, "ts"])).withColumn("us", F.unix_micros("ts"))
    kept = [c for c in rows.columns if c not in (*keys, "ts")]
    waiting = ", ".join(f"`w_{c}` array<{rows.schema[c].dataType.simpleString()}>" for c in kept)
    n_memory, columns, gap = len(start), emitted, gap_seconds * 1_000_000
    names = [c.strip().split()[0] for c in emitted.split(",")]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else (*start, None, *([] for _ in kept))
        now, last = tuple(held[:n_memory]), held[n_memory]
        have = list(zip(*held[n_memory + 1 :], strict=True))
        if not state.hasTimedOut:
            for b in batches:
                have += zip(*(_values(b[c]) for c in kept), strict=True)
        passed = max(0, state.getCurrentWatermarkMs()) * 1000
        listed = sorted((dict(zip(kept, x, strict=True)) for x in have), key=lambda x: (x["us"], x[tie] is not None, x[tie]))
        ripe = [x for x in listed if x["us"] <= passed]
        rest = listed[len(ripe) :]
        out: list[tuple] = []
        at = 0
        while at < len(ripe):
            if last is not None and ripe[at]["us"] - last > gap:
                now = start
            end = at + 1
            while end < len(ripe) and ripe[end]["us"] - ripe[end - 1]["us"] <= gap:
                end += 1
            now, found = fold(key, now, ripe[at:end])
            out += found
            last, at = ripe[end - 1]["us"], end
        # anything yet to come is later than the watermark, so a key whose last event lies over the gap behind it begins anew
        if not rest and (last is None or last + gap < passed):
            if state.exists:
                state.remove()
        else:
            state.update((*now, last, *([x[c] for x in rest] for c in kept)))
            due = rest[0]["us"] if rest else last + gap
            state.setTimeoutTimestamp(max(-(-due // 1000), passed // 1000 + 1))
        if out:
            yield pd.DataFrame(dict(zip(names, zip(*((*key, *x) for x in out), strict=True), strict=True)))

    return rows.groupBy(*keys).applyInPandasWithState(step, columns, f"{memory}, last_us long, {waiting}", "append", GroupStateTimeout.EventTimeTimeout)


def _edges(key: tuple, memory: tuple, rows: list[dict[str, Any]]) -> tuple[tuple, list[tuple]]:
    (last,) = memory
    counts: dict[tuple[str, str], int] = {}
    for r in rows:
        counts[last, r["label"]] = counts.get((last, r["label"]), 0) + 1
        last = r["label"]
    return (last,), [(s, d, n) for (s, d), n in counts.items()]


def flow_edges(events: DataFrame, delay: str, gap_seconds: int) -> DataFrame:
    """trace, src, dst, traversed, of all events that the watermark has passed: an edge from each event to the next one of its trace, the first one
    and each that follows a pause from the entry.  events: a streaming frame of trace, ts, event_id, label."""
    rows = events.select("trace", "ts", "event_id", "label")
    return in_order(rows, ["trace"], "event_id", _edges, (ENTRY,), "last string", "trace string, src string, dst string, traversed long", delay, gap_seconds)


def _calls(key: tuple, memory: tuple, rows: list[dict[str, Any]]) -> tuple[tuple, list[tuple]]:
    """A call is emitted when it returns, with the time between."""
    fns, begun = list(memory[0]), list(memory[1])
    out = []
    for r in rows:
        if r["kind"] == "enter":
            fns.append(r["fn"])
            begun.append(r["us"])
        elif r["kind"] == "exit" and fns:
            fn, since = fns.pop(), begun.pop()
            out.append((fns[-1] if fns else ENTRY, fn, len(fns), r["us"] - since))
    return (fns, begun), out


def calls(events: DataFrame, delay: str, gap_seconds: int) -> DataFrame:
    """exec_id, thread, caller, callee, depth, micros: the calls of each thread that have returned.  events: a streaming frame of exec_id, thread, ts, seq,
    kind ('enter', 'exit' and others), fn.  A thread that pauses for longer than the gap has ended, and its open calls with it."""
    rows = events.select("exec_id", "thread", "ts", "seq", "kind", "fn")
    return in_order(rows, ["exec_id", "thread"], "seq", _calls, ([], []), "fns array<string>, begun array<long>", "exec_id string, thread int, caller string, callee string, depth int, micros long", delay, gap_seconds)


def failures(events: DataFrame, delay: str) -> DataFrame:
    """exec_id, position, fn_name, bbid, ts of the failures that a run reports, each position once within ``delay``; what lies further behind is
    forgotten.  events: a streaming frame of exec_id, kind ('fail' and others), position, fn_name, bbid, ts."""
    failed = events.where("kind = 'fail'").select("exec_id", "position", "fn_name", "bbid", "ts").withWatermark("ts", delay)
    return failed.dropDuplicatesWithinWatermark(["exec_id", "position"])
