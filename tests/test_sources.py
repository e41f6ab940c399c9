"""Profile files are read in byte ranges by many tasks, with the same graphs as whole files."""

from __future__ import annotations

import gzip

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracelode.sources import dot, simple
from tracelode.streaming import flows


def simple_text(n):
    out = []
    for k in range(n):
        vertices = [f'vertex\t{i}, "g{k} start-graph v{i}", {i}, "fn{k}", "start-graph", "1ms"' for i in range(1 + k % 5)]
        edges = [f"edge\t{i}, {i - 1}, {k}" for i in range(1, 1 + k % 5)]
        out += ["start-graph", *vertices, *edges, "end-graph", ""]
    return "\n".join(out)


def dot_text(n):
    out = []
    for k in range(n):
        out += ["digraph {", *(f'"v{i}" [label="g{k} digraph v{i}", bbid={i}];' for i in range(1 + k % 4)), *(f'"v{i}" -> "v{i - 1}" [traversed={k}];' for i in range(1, 1 + k % 4)), "}"]
    return "\n".join(out) + "\n"


@pytest.fixture
def small_ranges(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {k: spark.conf.get(k, None) for k in keys}
    yield lambda size: [spark.conf.set(k, v) for k, v in zip(keys, (size, "0", "1"), strict=True)]
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def rows(df, *without):
    return sorted(map(str, df.drop("graph_id", *without).collect()))


@pytest.mark.parametrize("size", ["199", "1500"])
@pytest.mark.parametrize(("source", "text"), [(simple, simple_text(40)), (dot, dot_text(40))])
def test_ranges_that_begin_inside_graphs(spark, tmp_path, small_ranges, source, text, size):
    (tmp_path / "one").write_text(text)
    (tmp_path / "two").write_text(text)
    whole = source.read(spark, str(tmp_path), "ok")
    expected = [rows(df) for df in whole]
    n = len(expected[0])
    small_ranges(size)
    found = simple.records(spark.read, str(tmp_path), source.START)
    tasks = {p for (p,) in found.select(F.spark_partition_id()).distinct().collect()}
    assert len(tasks) > 2 * len(text) / 4096 and found.groupBy("path", "start").count().count() > 3
    vertices, edges = source.read(spark, str(tmp_path), "ok")
    assert [rows(vertices), rows(edges)] == expected and len(expected[0]) == n > 150
    # every graph has an id of its own, and its vertices and edges share it
    assert vertices.select("graph_id").distinct().count() == 80
    assert edges.join(vertices.select("graph_id", F.col("label").alias("src")), ["graph_id", "src"], "left_semi").count() == edges.count()


def test_other_line_ends_and_compressed_files_are_read_whole(spark, tmp_path):
    (tmp_path / "crlf").write_bytes(simple_text(40).replace("\n", "\r\n").encode())
    (tmp_path / "packed.gz").write_bytes(gzip.compress(simple_text(40).encode()))
    vertices, edges = simple.read(spark, str(tmp_path), "fail")
    assert vertices.count() == 2 * sum(1 + k % 5 for k in range(40)) and edges.count() == 2 * sum(k % 5 for k in range(40))
    assert vertices.select("graph_id").distinct().count() == 80
    (tmp_path / "joined.dot").write_text("digraph a { x -> y } digraph b { z }")
    assert {r["vid"] for r in dot.read(spark, str(tmp_path / "joined.dot"), "ok")[0].collect()} == {"x", "y", "z"}


def test_wrong_lines_are_errors(spark, tmp_path):
    for k, text in enumerate(("what\n", 'start-graph\nvertex\t0, "a", 0, "f", "p"\nedge\t0, 1, 1\nend-graph\n', 'start-graph\nvertex\t0, "a\nend-graph\n')):
        (tmp_path / str(k)).write_text(text)
        with pytest.raises(Exception, match="kind of line|undeclared|quote|fields"):
            simple.read(spark, str(tmp_path / str(k)), "ok")
    (tmp_path / "d").write_text('digraph { "a\ndigraph b" }\n')
    with pytest.raises(Exception, match="does not end"):
        dot.read(spark, str(tmp_path / "d"), "ok")


def test_a_stream_of_profile_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one").write_text(simple_text(30))
    stream = simple.read_stream(spark, str(tmp_path / "in"), "ok")
    run = lambda: stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True).start().awaitTermination()
    run()
    (tmp_path / "in" / "two").write_text(simple_text(20))
    run()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 50 and got.select(F.sum(F.size("vertices"))).first()[0] == sum(1 + k % 5 for k in range(30)) + sum(1 + k % 5 for k in range(20))


class Captured:
    """Stands for a frame, and keeps the function that it is to apply."""

    def mapInPandas(self, fn, schema):
        return fn

    def groupBy(self, *keys):
        return self

    def applyInPandasWithState(self, fn, *rest):
        return fn


def test_graphs_are_handed_on_before_a_batch_is_parsed(monkeypatch):
    monkeypatch.setattr(simple, "HELD", 6)
    run = simple.parsed(Captured(), "ok", lambda text, first: iter([([(k,) for k in range(3)], [("a",)])] * int(text)), "vid int", "src string")
    batch = pd.DataFrame({"path": ["p"] * 3, "start": [0] * 3, "content": ["3", "1", "2"]})
    found = list(run(iter([batch])))
    assert [len(x) for x in found] == [2, 2, 2] and [x for b in found for x in b["graph_id"]] == [f"p#{k}" for k in range(6)]


def test_a_trace_is_folded_without_frames_of_its_own(monkeypatch):
    state = type("State", (), {"exists": False, "update": lambda self, x: setattr(self, "now", x)})()
    batches = [pd.DataFrame({"ts": pd.to_datetime(t), "event_id": i, "label": n}) for t, i, n in ((["2024-01-02", None], [1, 9], ["c", "d"]), (["2024-01-01", "2024-01-01"], [5, 4], ["b", "a"]))]
    monkeypatch.setattr(pd, "concat", None)
    (found,) = flows.flow_edges(Captured())(("t",), iter(batches), state)
    assert found.values.tolist() == [["t", "entry", "a", 1], ["t", "a", "b", 1], ["t", "b", "c", 1], ["t", "c", "d", 1]] and state.now == ("d",)
