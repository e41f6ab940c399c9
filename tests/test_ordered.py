"""Streams that put late events in order and forget: against the same events in order, whatever the micro-batches."""

from __future__ import annotations

import datetime as dt
import os
import random

from tracelode.streaming import ordered

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "trace string, ts timestamp, event_id long, label string"


def run(spark, tmp_path, batches, schema, build, name="s"):
    """Rows emitted for files that arrive one by one, and the query's progress."""
    folder = tmp_path / name
    for k, rows in enumerate(batches):
        before = set(folder.glob("*.parquet"))
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        for f in set(folder.glob("*.parquet")) - before:
            os.utime(f, (1_700_000_000 + k,) * 2)  # files are taken in order of their times
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    q = build(stream).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / f"{name}-out")).option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(str(tmp_path / f"{name}-out")).collect(), q.recentProgress


def expected_edges(rows, gap, passed):
    counts, last = {}, {}
    for trace, ts, _, label in sorted(rows, key=lambda r: (r[1], r[2])):
        if ts > passed:
            continue
        before, at = last.get(trace, ("entry", None))
        src = "entry" if at is None or (ts - at).total_seconds() > gap else before
        counts[trace, src, label] = counts.get((trace, src, label), 0) + 1
        last[trace] = (label, ts)
    return counts


def test_late_events_within_the_delay_change_nothing(spark, tmp_path):
    r = random.Random(5)
    rows = [(f"t{r.randrange(4)}", T0 + dt.timedelta(seconds=r.randrange(1200)), k, r.choice("abc")) for k in range(200)]
    arrival = sorted(rows, key=lambda x: x[1] + dt.timedelta(seconds=r.randrange(55)))  # at most 55 s late
    passed = max(x[1] for x in rows) - dt.timedelta(seconds=60)
    expected = expected_edges(rows, 40, passed)
    for name, size in (("few", 40), ("all", 200)):
        got, _ = run(spark, tmp_path, [arrival[k : k + size] for k in range(0, len(arrival), size)], SCHEMA, lambda s: ordered.flow_edges(s, "60 seconds", 40), name)
        found = {}
        for x in got:
            found[x["trace"], x["src"], x["dst"]] = found.get((x["trace"], x["src"], x["dst"]), 0) + x["traversed"]
        assert found == expected and any(s == "entry" for _, s, _ in expected)


def test_state_of_silent_traces_is_dropped(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    batches = [[(f"t{k}", at(k), k, "a") for k in range(20)], [("late", at(1000), 100, "a")], [("late", at(2000), 101, "b"), (None, at(2000), 102, "b"), ("late", None, 103, "b")]]
    got, progress = run(spark, tmp_path, batches, SCHEMA, lambda s: ordered.flow_edges(s, "10 seconds", 60))
    assert {(x["trace"], x["src"], x["dst"]) for x in got} == {(f"t{k}", "entry", "a") for k in range(20)} | {("late", "entry", "a")}
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    assert max(kept) >= 20 and kept[-1] == 1


def test_calls_that_arrive_out_of_order(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    e = [("e", 1, at(0), 0, "enter", "main"), ("e", 1, at(2), 1, "enter", "f"), ("e", 1, at(5), 2, "exit", None), ("e", 1, at(6), 3, "enter", "g"), ("e", 1, at(6), 4, "exit", None), ("e", 1, at(9), 5, "exit", None)]
    batches = [[e[3], e[1], e[5]], [e[0], e[4], e[2]], [("other", 1, at(500), 6, "enter", "x")]]
    got, _ = run(spark, tmp_path, batches, "exec_id string, thread int, ts timestamp, seq int, kind string, fn string", lambda s: ordered.calls(s, "30 seconds", 60))
    assert {tuple(x)[2:] for x in got} == {("main", "f", 1, 3_000_000), ("main", "g", 1, 0), ("entry", "main", 0, 9_000_000)}


def test_failures_are_forgotten(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    schema = "exec_id string, kind string, position string, fn_name string, bbid int, ts timestamp"
    batches = [[("e", "fail", "p", "f", 1, at(0)), ("e", "fail", "p", "f", 1, at(1)), ("e", "block", "q", "f", 1, at(1))], [("e", "fail", "p", "f", 1, at(2))], [("z", "fail", "p", "f", 1, at(900))]]
    got, progress = run(spark, tmp_path, batches, schema, lambda s: ordered.failures(s, "20 seconds"))
    assert sorted((x["exec_id"], x["position"]) for x in got) == [("e", "p"), ("z", "p")]
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] == 1
