"""The decision loop from polls to enabled tracepoints."""

import json

import pytest
from pyspark.sql import functions as F

from waysift import cli
from waysift.operators import control, search
from waysift.settings import Settings
from waysift.streaming import controller

from .test_cli import settings  # noqa: F401

MANIFEST = "request_type string, hash string, tracepoints array<string>, path_len int, occurrences bigint, added bigint"
PATHS = "base_id string, hash string, request_type string, tracepoints array<string>, times array<bigint>, spans array<string>, variants array<string>, n_nodes int, duration_ns bigint"
ENABLED = "tracepoint string, request_type string"


def group(name, gaps, kind="K", points=("a", "b", "c")):
    """Paths of one group, an edge's microseconds each."""
    out = []
    for k, (x, y) in enumerate(gaps):
        times = [0, x * 1000, (x + y) * 1000]
        out.append((f"{name}{k}", name, kind, list(points), times, ["s", "t", "s"], ["Entry", "Annotation", "Exit"], 3, times[-1]))
    return out


WIDE = [(10, 500), (10, 900), (10, 1300), (11, 1700)]  # the second edge varies most
NARROW = [(100, 100), (100, 102), (100, 101), (100, 100)]  # cv under the limit
SOME = [(10, 50), (10, 90), (10, 130), (10, 170)]


@pytest.fixture
def catalogue(spark):
    return spark.createDataFrame([("K", "m", ["a", "b", "x", "y", "c"], 5, 2, 1), ("K", "n", ["a", "b", "z", "c"], 4, 1, 1), ("L", "o", ["a", "w", "b", "v", "c"], 5, 1, 1)], MANIFEST)


def test_decisions_go_on_with_what_is_left(spark):
    class Fake:
        asked = []

        def search(self, groups, edges, budget, enabled):
            self.asked.append((budget, sorted((r.group_hash, r.edge_pos) for r in edges.collect()), sorted(r.tracepoint for r in enabled.collect())))
            rows = [("g", 1, "q", 1), ("h", 1, "r", 1), ("h", 1, "s", 2), ("h", 2, "u", 1)]
            return spark.createDataFrame(rows, "group_hash string, edge_pos int, tracepoint string, rank int").join(edges, ["group_hash", "edge_pos"], "left_semi").filter(F.col("rank") <= budget)

    problems = spark.createDataFrame([("g", "K", 9.0), ("h", "L", 5.0)], "hash string, request_type string, variance_us2 double")
    edges = spark.createDataFrame([("g", 1, 1.0), ("g", 2, 8.0), ("h", 1, 3.0), ("h", 2, 2.0)], "hash string, pos int, variance_us2 double")
    none = spark.createDataFrame([], ENABLED)
    got = controller.decide(problems, edges, Fake(), none, 2)
    assert [(r.group_hash, r.edge_pos, r.tracepoint, r.request_type) for r in got] == [("g", 1, "q", "K"), ("h", 1, "r", "L")]
    assert Fake.asked[1] == (1, [("h", 1), ("h", 2)], ["q"])
    assert controller.decide(problems.limit(0), edges, Fake(), none, 2) == []


def test_strategies(spark, catalogue):
    groups = spark.createDataFrame([("g", "K", ["a", "b", "c"], ["s", "t", "s"], ["Entry", "Annotation", "Exit"])], "hash string, request_type string, tracepoints array<string>, spans array<string>, variants array<string>")
    edges = spark.createDataFrame([("g", 2)], "group_hash string, edge_pos int")
    none = spark.createDataFrame([], ENABLED)
    found = lambda s, enabled=none, n=3: {r.tracepoint for r in s.search(groups, edges, n, enabled).collect()}
    flat = search.strategy("Flat", catalogue)
    assert found(flat) == {"x", "y", "z"}
    assert found(flat, spark.createDataFrame([("x", "L"), ("y", "K"), ("z", None)], ENABLED)) == {"x"}  # another type's state doesn't count
    historic = search.strategy("Historic", catalogue)
    assert found(historic, n=9) == {"a", "b", "c", "x", "y", "z"} and len(found(historic, n=2)) == 2
    events = [("K", "m", k, *e) for k, e in enumerate([("s", "Entry", "a"), ("t", "Annotation", "b"), ("u", "Entry", "x"), ("u", "Exit", "y"), ("s", "Exit", "c")])]
    events = spark.createDataFrame(events, "request_type string, hash string, ord int, span string, variant string, tracepoint string")
    assert found(search.strategy("Hierarchical", catalogue, events), n=9) == {"b", "x", "c"}  # what lies in span s
    for bad in ("Hierarchical", "x"):
        with pytest.raises(ValueError):
            search.strategy(bad, catalogue)


def test_controller(spark, catalogue, tmp_path):
    s = Settings("HDFS", state_path=str(tmp_path / "state"), tracepoints_per_epoch=3, trace_size_limit=100, decision_s=120)
    now, size = [0.0], [500]
    stats = lambda: spark.createDataFrame([("n1", 1, size[0])], "node string, hour_us bigint, trace_size bigint")
    c = controller.Controller(s, str(tmp_path / "run"), search.strategy("Flat", catalogue), catalogue, {"x"}, lambda: now[0], stats)
    paths = spark.createDataFrame(group("wide", WIDE) + group("narrow", NARROW) + group("some", SOME, "L"), PATHS)
    enabled = lambda: sorted(tuple(r) for r in control.read_state(spark, s.state_path).collect())
    now[0] = 200.0
    c.batch(paths, 0)
    assert enabled() == []  # over the limit
    size[0] = 50
    c.batch(paths.limit(0), 1)
    assert enabled() == [("x", "K"), ("y", "K"), ("z", "K")]
    for _ in range(2):  # a step that is run again decides the same
        now[0], c.last = 400.0, 200.0
        c.batch(paths.limit(0), 2)
        assert enabled() == [("v", "L"), ("w", "L"), ("x", "K"), ("y", "K"), ("z", "K")]
    log = {r["step"]: r for p in (tmp_path / "run/log").glob("*/*.json") for r in map(json.loads, p.read_text().splitlines())}
    assert [log[k]["n_traces"] for k in range(3)] == [12, 0, 0] and [log[k]["over"] for k in range(3)] == [True, False, False]
    assert log[1]["enabled"] and "wide" in {r.group_hash for r in spark.read.json(str(tmp_path / "run/decisions")).collect()}
    assert c.chosen >= {"x"} and c.since == 3 and not c.stopped
    assert controller.Controller(s, str(tmp_path / "run"), c.strategy, catalogue, {"x"}, lambda: 0.0).resume(spark) == 3


def test_polls_give_stable_paths_once(spark, catalogue, tmp_path):
    c = controller.Controller(Settings("HDFS"), str(tmp_path), None, catalogue, set(), lambda: 0.0)
    took = []
    c.batch = lambda paths, number: took.append(sorted(r.base_id for r in paths.collect()))
    for k, rows in enumerate([[("a", 5), ("b", 7)], [("a", 5), ("b", 8)], [("a", 5), ("b", 8), ("c", 1)], [("c", 1)]]):
        c.poll(spark.createDataFrame(rows, "base_id string, duration_ns bigint"), k)
    assert took == [[], ["a"], ["b"], ["c"]]


def test_run_command(spark, settings, tmp_path):  # noqa: F811
    cli.main([settings, "manifest"], spark)
    assert spark.read.parquet(str(tmp_path / "manifest_events")).select("hash").distinct().count() == 2
    waits = []
    cli.run(spark, Settings.read(settings), str(tmp_path / "run"), 2, wait=waits.append)
    log = sorted((r.step, r.n_traces) for r in spark.read.json(str(tmp_path / "run/log")).select("step", "n_traces").collect())
    assert log == [(0, 0), (1, 4)] and waits == [10]
