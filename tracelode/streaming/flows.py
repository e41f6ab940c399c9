"""Flow edges of an event stream: a state for each trace holds its last label, so that each event makes an edge from it.

Events of a trace are ordered within each micro-batch by time and id; across batches they must not arrive late by
more than the batch, as in the batch version's window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.traces import ENTRY


def flow_edges(events: DataFrame) -> DataFrame:
    """trace, src, dst, traversed for every micro-batch.  events: a streaming frame of trace, ts, event_id, label."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # arrays, since frames of a few rows cost more than what is in them
        ts, ids, names = (np.concatenate(x) for x in zip(*([b[c].to_numpy() for c in ("ts", "event_id", "label")] for b in batches), strict=True))
        last = state.get[0] if state.exists else ENTRY
        labels = names[np.lexsort((ids, ts))].tolist()
        counts: dict[tuple[str, str], int] = {}
        for label in labels:
            counts[last, label] = counts.get((last, label), 0) + 1
            last = label
        state.update((last,))
        yield pd.DataFrame({"trace": [key[0]] * len(counts), "src": [s for s, _ in counts], "dst": [d for _, d in counts], "traversed": list(counts.values())})

    return events.groupBy("trace").applyInPandasWithState(step, "trace string, src string, dst string, traversed long", "last string", "update", GroupStateTimeout.NoTimeout)


def call_profile(events: DataFrame) -> DataFrame:
    """exec_id, kind, src, dst, n, nanos of every micro-batch: flow edges between blocks (kind 'flow', with the time spent in the
    source block) and calls between functions (kind 'call').

    events: a streaming frame of exec_id, thread, seq, kind ('enter', 'block', 'exit'), fn, bbid, nanos.  The state of a thread is
    its stack of (function, last block) and the time of its last event, so a call returns to the block that made it.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fns, blocks, last = state.get if state.exists else ([], [], None)
        stack = list(zip(fns, blocks, strict=True))
        found: dict[tuple[str, str, str], list[int]] = {}

        def add(kind: str, src: str, dst: str, nanos: int) -> None:
            at = found.setdefault((kind, src, dst), [0, 0])
            at[0] += 1
            at[1] += nanos

        def name(frame: tuple[str, int] | None) -> str:
            return ENTRY if frame is None else f"{frame[0]} blk {frame[1]}"

        for r in pd.concat(list(batches)).sort_values("seq").to_dict("records"):
            before = stack[-1] if stack else None
            spent = int(r["nanos"]) - int(last) if last is not None else 0
            last = int(r["nanos"])
            if r["kind"] == "enter":
                add("call", before[0] if before else ENTRY, r["fn"], 0)
                stack.append((r["fn"], 0))
            elif r["kind"] == "block" and stack:
                stack[-1] = (stack[-1][0], int(r["bbid"]))
            elif r["kind"] == "exit" and stack:
                stack.pop()
            after = stack[-1] if stack else None
            add("flow", name(before), name(after), spent)
        state.update(([f for f, _ in stack], [b for _, b in stack], last))
        yield pd.DataFrame([(key[0], k, s, d, n, t) for (k, s, d), (n, t) in found.items()], columns=["exec_id", "kind", "src", "dst", "n", "nanos"])

    return events.groupBy("exec_id", "thread").applyInPandasWithState(step, "exec_id string, kind string, src string, dst string, n long, nanos long", "fns array<string>, blocks array<int>, last long", "update", GroupStateTimeout.NoTimeout)


def failures(events: DataFrame) -> DataFrame:
    """exec_id, position, fn_name, bbid of the failures that a run reports, each position once; a streaming frame with a watermark forgets
    positions behind it.  events: exec_id, kind ('fail' and others), position, fn_name, bbid."""
    return events.where("kind = 'fail'").select("exec_id", "position", "fn_name", "bbid").dropDuplicates(["exec_id", "position"])


def method_profiles(events: DataFrame) -> DataFrame:
    """exec_id, func_name, inputs, outputs: what was captured before and after a function's calls, in order of seq; of a stream in update or
    complete mode.  events: exec_id, seq, kind ('input', 'output' and others), func_name, value (JSON)."""

    def side(kind: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("seq", "value")))), lambda x: x["value"])

    return events.where("kind IN ('input', 'output')").groupBy("exec_id", "func_name").agg(side("input").alias("inputs"), side("output").alias("outputs"))
