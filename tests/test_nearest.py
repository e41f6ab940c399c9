"""Nearest covariates against all pairs, in many small ranges."""

from __future__ import annotations

import random

import pytest

from tracelode.operators import objects


@pytest.fixture(scope="module")
def individuals():
    """A function with most of the rows, one with few, one with a single bin; many equal covariates."""
    rnd = random.Random(3)
    rows = [("hot", k, rnd.randrange(4), float(rnd.randrange(150))) for k in range(260)]
    rows += [("few", 1000 + k, k % 2, rnd.random()) for k in range(5)] + [("one", 2000 + k, 7, float(k)) for k in range(3)]
    return rows


@pytest.mark.parametrize(("bins", "own"), [(20_000, False), (20_000, True), (0, False), (0, True)])
def test_nearest_in_small_ranges(spark, individuals, monkeypatch, bins, own):
    ranged, write = [], objects.staged
    monkeypatch.setattr(objects, "RANGE", 40, raising=False)
    monkeypatch.setattr(objects, "BINS", bins, raising=False)
    monkeypatch.setattr(objects, "staged", lambda df, name: (out := write(df, name), ranged.append(out) if name == "ranged" else None)[0])
    frame = spark.createDataFrame(individuals, "func_name string, id long, bin int, covariate double")
    found = objects.nearest_covariate(frame, own=own).collect()
    expected = {}
    for f, i, b, c in individuals:
        for g, j, o, d in individuals:
            if f == g and (own or b != o):
                key = f, i, b, o
                expected[key] = min(expected.get(key, (float("inf"), 0)), (abs(c - d), j))
    assert len(found) == len(expected) and {(r["func_name"], r["id"], r["bin"], r["other_bin"]): (r["distance"], r["other_id"]) for r in found} == expected
    # ranges follow the rows: with four shuffle partitions, a quarter of them met in a task before
    rows = ranged[0].groupBy("part").count().collect()
    assert len(rows) > 12 and max(r["count"] for r in rows) < 160
