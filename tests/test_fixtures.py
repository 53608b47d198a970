"""Hand-traced cases of the trace operators."""

import json

from pyspark.sql import functions as F

from waysift import functions as fn
from waysift.operators import control, critical, dag, groups, manifest, search
from waysift.sources import jaeger, osprofiler, xtrace

ID = {c: f"{ord(c):08x}-0000-4000-8000-000000000000" for c in "abcdefghijklmnopqrstuvwxyzBC"}


def span(trace, parent, base, at, info, name="f", tp="tp"):
    return {"trace_id": ID[trace], "parent_id": ID[parent], "base_id": ID[base], "project": "p", "service": "s", "name": name, "tracepoint_id": tp, "timestamp": f"2020-06-23T14:32:34.{at:06d}", "info": info}


def entry(tp):
    return {"function": {"name": tp}, "thread_id": 1, "host": "h", "tracepoint_id": tp, "pid": 1}


def read(spark, tmp_path, spans):
    p = tmp_path / "spans.json"
    p.write_text(json.dumps(spans))
    return osprofiler.read(spark, str(p))


def named(nodes, edges):
    """Edges by tracepoint and variant, with their length in microseconds and kind."""
    label = {(r.base_id, r.node_id): f"{r.tracepoint}{'EXA'['Entry Exit Annotation'.split().index(r.variant)]}" for r in nodes.collect()}
    return sorted((label[r.base_id, r.src], label[r.base_id, r.dst], r.duration_ns // 1000, r.variant) for r in edges.collect())


def test_nested_spans(spark, tmp_path):
    spans = [span("a", "B", "B", 0, entry("a")), span("b", "a", "B", 1, entry("b")), span("b", "a", "B", 2, {"host": "h"}), span("k", "a", "B", 3, {"value": 7, "host": "h", "thread_id": 5743728237, "pid": 1, "tracepoint_id": "k"}), span("a", "B", "B", 4, {"host": "h"})]
    nodes, edges, traces = osprofiler.assemble(osprofiler.spans(read(spark, tmp_path, spans)))
    assert named(nodes, edges) == sorted([("aE", "bE", 1, "ChildOf"), ("bE", "bX", 1, "ChildOf"), ("bX", "kA", 1, "ChildOf"), ("kA", "aX", 1, "ChildOf")])
    assert nodes.filter("tracepoint = 'k'").first().kv["lock_queue"] == "7"
    assert traces.first().duration_ns == 4000


def test_fork_and_wait(spark, tmp_path):
    wait = {"function": {"name": "w"}, "thread_id": 1, "host": "h", "tracepoint_id": "w", "pid": 1, "wait_for": ID["C"]}
    child = {"thread_id": 1, "host": "h", "tracepoint_id": "f", "pid": 1, "child_id": ID["C"]}
    spans = [span("a", "B", "B", 0, entry("a")), span("f", "a", "B", 1, child), span("w", "a", "B", 2, wait), span("w", "a", "B", 5, {"host": "h"}, name="asynch_wait-stop", tp="w"), span("a", "B", "B", 6, {"host": "h"}), span("c", "C", "C", 3, entry("c")), span("c", "C", "C", 4, {"host": "h"})]
    nodes, edges, traces = osprofiler.assemble(osprofiler.spans(read(spark, tmp_path, spans)))
    assert named(nodes, edges) == sorted([("aE", "aX", 6, "ChildOf"), ("aE", "cE", 3, "FollowsFrom"), ("cE", "cX", 1, "ChildOf"), ("cX", "aX", 2, "FollowsFrom")])
    path = critical.critical_paths(nodes, edges, traces).first()
    tp = {r.node_id: r.tracepoint + r.variant[:2] for r in nodes.collect()}
    assert [tp[n] for n in path.node_ids] == ["aEn", "cEn", "cEx", "aEx"] and path.duration_ns == 6000 and path.is_whole


def test_shapes_and_quarantine(spark, tmp_path):
    plain = {"thread_id": 1, "host": "h", "tracepoint_id": "t", "pid": 1}
    args = plain | {"function": {"name": "f", "args": "1", "kwargs": "2"}}
    shapes = {
        "WaitFor": plain | {"function": {"name": "f"}, "wait_for": ID["C"]},
        "Child": plain | {"child_id": ID["C"]},
        "Plain": plain,
        "Log": plain | {"msg": "m"},
        "KeyValue": plain | {"value": 3},
        "Args": args,
        "Results": {"function": {"result": "r"}, "host": "h"},
        "WaitForKeyValue": args | {"wait_for": ID["C"]},
        "FunctionEntry": plain | {"function": {"name": "f"}},
        "RequestEntry": plain | {"request": {"path": "/", "scheme": "s", "method": "m", "query": "q"}},
        "ExitNormal": {"host": "h"},
        "ExitError": {"etype": "e", "message": "m", "host": "h"},
    }
    spans = [span(c, "B", "B", k, info, name=n) for k, (c, (n, info)) in enumerate(zip("abcdefghijkl", shapes.items(), strict=True))]
    raw = read(spark, tmp_path, [*spans, span("m", "B", "B", 50, plain | {"odd": 1}, name="odd")])
    s = osprofiler.spans(raw)
    got = {r.name: (r["shape"], r.variant) for r in s.collect()}
    assert {n: (n, osprofiler.SHAPES[n][1]) for n in shapes} | {"odd": (None, None)} == got
    reasons = {r.reason for r in osprofiler.quarantine(s, raw).collect()}
    assert {"unknown shape of info", "exit without entry"} <= reasons


def test_blob_and_ids(spark):
    one = span("a", "B", "B", 0, entry("a"))
    blobs = spark.createDataFrame([(json.dumps(one) + json.dumps(one | {"trace_id": "936DA01F9ABD4d9d80C702AF85C822A8"}),), ("",), (None,)], "value string")
    got = [r.span_id for r in osprofiler.spans(osprofiler.read_blobs(blobs)).collect()]
    assert sorted(got) == sorted([ID["a"], "936da01f-9abd-4d9d-80c7-02af85c822a8"])
    x = spark.createDataFrame([("1",), ("-1",)], "e string").select(fn.event_uuid(F.col("e"))).collect()
    assert [r[0] for r in x] == ["00000000-0000-0001-0000-000000000000", "ffffffff-ffff-ffff-0000-000000000000"]
    bad = spark.createDataFrame([("xyz",), (None,)], "e string").select(fn.uuid(F.col("e"))).collect()
    assert [r[0] for r in bad] == [None, None]


def envelope(extra=()):
    rows = [(1, 10, []), (2, 20, ["1"]), (3, 25, ["1"]), (4, 40, ["2", "3"]), *extra]
    return [{"id": "abcdef0123456789", "reports": [{"EventID": str(i), "HRT": t, "ParentEventID": p, "Label": f"tp{i}", "Host": "h", "Cycles": 1} for i, t, p in rows]}]


def test_xtrace(spark, tmp_path):
    p = tmp_path / "x.json"
    p.write_text(json.dumps(envelope()))
    nodes, edges, traces = xtrace.assemble(xtrace.read(spark, str(p)))
    assert sorted((r.src, r.dst, r.duration_ns) for r in edges.collect()) == [(1, 2, 10), (1, 3, 15), (2, 4, 20), (3, 4, 15)]
    path = critical.critical_paths(nodes, edges, traces).first()
    assert path.node_ids == [1, 3, 4] and path.duration_ns == 30
    assert {r.node_id for r in dag.sync_points(edges).collect()} == {2, 3, 4}
    skipped = dag.contract(spark, nodes, edges, nodes.filter("tracepoint = 'tp3'").select("base_id", "node_id"))[1]
    assert sorted((r.src, r.dst) for r in skipped.collect()) == [(1, 2), (1, 4), (2, 4)]
    lost = traces.withColumn("start_node", F.lit(99).cast("bigint"))
    assert not critical.critical_paths(nodes, edges, lost).first().is_whole


def test_prune_and_paths(spark, tmp_path):
    p = tmp_path / "x.json"
    p.write_text(json.dumps(envelope([(5, 30, ["1"])])))
    nodes, edges, _ = xtrace.assemble(xtrace.read(spark, str(p)))
    ends = nodes.filter("tracepoint = 'tp4'").select("base_id", F.col("node_id").alias("end_node"))
    root = nodes.filter("tracepoint = 'tp1'").select("base_id", "node_id")
    assert dag.count_paths(nodes, edges, root).first().n_paths == 3 == dag.all_paths(spark, edges, root).count()
    n, e = dag.prune(spark, nodes, edges, ends)
    assert {r.tracepoint for r in n.collect()} == {"tp1", "tp2", "tp3", "tp4"}
    assert dag.count_paths(n, e, root).first().n_paths == 2


def jaeger_file(spans):
    full = [{"traceID": "abcdef0123456789", "spanID": i, "operationName": i, "references": [{"refType": "CHILD_OF", "traceID": t, "spanID": r} for t, r in refs], "startTime": a, "duration": b - a, "tags": [], "logs": [], "process": {"serviceName": "x", "tags": []}, "processID": "p"} for i, refs, a, b in spans]
    return json.dumps({"data": [{"traceID": "abcdef0123456789", "spans": full}], "total": 0, "limit": 0, "offset": 0})


def test_jaeger(spark, tmp_path):
    own = "abcdef0123456789"
    p = tmp_path / "j.json"
    p.write_text(jaeger_file([("1111111111111111", [], 0, 100), ("2222222222222222", [(own, "1111111111111111")], 10, 40), ("3333333333333333", [(own, "1111111111111111")], 50, 90)]))
    nodes, edges, _ = jaeger.assemble(jaeger.read(spark, str(p)))
    assert [e[:3] for e in sorted(named(nodes, edges), key=lambda e: e[2])] and len(edges.collect()) == 5
    order = {r.dst: r.src for r in edges.collect()}
    assert order == {2: 1, 3: 2, 4: 3, 5: 4, 6: 5}
    assert dag.connected(nodes, edges).first().is_connected
    p.write_text(jaeger_file([("1111111111111111", [(own, "2"), (own, "3")], 0, 100), ("2222222222222222", [("ffffffffffffffff", "1")], 0, 5)]))
    assert {r.reason for r in jaeger.rejected(jaeger.read(spark, str(p))).collect()} == {"several references", "reference to another trace"}


def synthesized(names, edges, path):
    rows = [{"pos": k, "node_id": n, "span_id": names[n][0], "tracepoint": names[n][0], "variant": names[n][1], "ts_ns": names[n][2], "is_synthetic": False, "edge_ns": e} for k, (n, e) in enumerate(path)]
    return critical.synthesize(rows, critical.Branches({n: x[0] for n, x in names.items()}, edges))


def test_synthetic_exits():
    names = {1: ("A", "Entry", 0), 2: ("B", "Entry", 1), 3: ("C", "Entry", 2), 4: ("C", "Exit", 9), 5: ("D", "Annotation", 3), 6: ("B", "Exit", 4), 7: ("A", "Exit", 5)}
    got = synthesized(names, [(1, 2), (2, 3), (3, 4), (2, 5), (5, 6), (6, 7)], [(1, None), (2, 1), (3, 1), (4, 7)])
    assert [(r["span_id"], r["variant"], r["ts_ns"], r["is_synthetic"]) for r in got] == [("A", "Entry", 0, False), ("B", "Entry", 1, False), ("B", "Exit", 2, True), ("A", "Exit", 3, True), ("C", "Entry", 2, False), ("C", "Exit", 9, False)]
    assert [r["edge_ns"] for r in got][2:5] == [1, 1, 1]


def test_synthetic_entries():
    """Back to the join over which the span comes, after that node's predecessor on the path; without such a join the path has no meaning."""
    names = {1: ("A", "Entry", 0), 2: ("X", "Annotation", 1), 3: ("B", "Entry", 2), 4: ("J", "Annotation", 5), 5: ("B", "Exit", 6), 6: ("A", "Exit", 7)}
    edges, path = [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (5, 6)], [(1, None), (2, 1), (4, 4), (5, 1), (6, 1)]
    got = synthesized(names, edges, path)
    assert [(r["span_id"], r["variant"], r["ts_ns"]) for r in got if r["span_id"] != "A"] == [("X", "Annotation", 1), ("B", "Entry", 2), ("J", "Annotation", 5), ("B", "Exit", 6)]
    assert synthesized(names, [e for e in edges if e[0] != 3], path) is None


def test_incomplete_spans(spark):
    rows = [("t", 0, "s", "Entry"), ("t", 1, "s", "Entry"), ("t", 2, "x", "Annotation"), ("t", 3, "s", "Exit"), ("t", 4, "s", "Exit"), ("u", 0, "s", "Exit")]
    keep, bad = critical.complete_spans(spark.createDataFrame(rows, "base_id string, pos int, span_id string, variant string"))
    assert sorted((r.base_id, r.pos) for r in keep.collect()) == [("t", 0), ("t", 2), ("t", 4)] and [r.base_id for r in bad.collect()] == ["u"]


def test_containment(spark):
    rows = [(["a", "x", "b", "c"], ["a", "b", "c"]), (["a", "x", "b", "c"], ["b", "a"]), (["a"], []), (["ab", "c"], ["a", "bc"])]
    df = spark.createDataFrame(rows, "l array<string>, s array<string>")
    for expr in (fn.contains(F.col("l"), F.col("s")), fn.contains_text(fn.path_text(F.col("l")), F.col("s"))):
        assert [r[0] for r in df.select(expr).collect()] == [True, False, True, False]
    assert df.select(fn.positions(F.col("l"), F.col("s"))).first()[0] == [0, 2, 3]


def paths(spark, sets):
    rows = [(f"{h}{k}", h, [h, "z"], [0, d], 2, d) for h, ds in sets.items() for k, d in enumerate(ds)]
    return spark.createDataFrame(rows, "base_id string, hash string, tracepoints array<string>, times array<bigint>, n_nodes int, duration_ns bigint")


def test_group_statistics(spark):
    p = paths(spark, {"a": [10_000, 20_000, 30_000, 40_000], "b": [5000] * 4, "c": [1000, 100_000]})
    g = groups.group_paths(p)
    a = g.filter("hash = 'a'").first()
    assert (a.mean_us, a.variance_us2, round(a.cv, 6)) == (25.0, 125.0, 0.447214)
    assert [r.hash for r in groups.problem_groups_cv(g).collect()] == ["a"]
    assert [r.hash for r in groups.problem_groups_cv(g, used=spark.createDataFrame([("a",)], "hash string")).collect()] == []
    z = groups.zero_variance(g).first()
    assert (z.n_groups, z.n_zero) == (3, 1)
    e = groups.group_edges(paths(spark, {"a": [10**9, 3 * 10**9]})).first()
    assert e.variance_s2 == 1.0
    s = groups.merge(groups.sums(p.filter("duration_ns < 25000")), groups.sums(p.filter("duration_ns >= 25000"))).filter("hash = 'a'").first()
    assert (s.n, int(s.total)) == (4, 100)


def test_manifest(spark):
    rows = [("T", "ac", ["a", "c"]), ("T", "abc", ["a", "b", "c"]), ("T", "abc", ["a", "b", "c"]), ("U", "ac", ["a", "c"])]
    m = manifest.build(spark.createDataFrame(rows, "request_type string, hash string, tracepoints array<string>"))
    assert sorted((r.request_type, r.hash, r.occurrences, r.added) for r in m.collect()) == [("T", "abc", 2, 2), ("U", "ac", 1, 1)]
    g = spark.createDataFrame([("g", "T", ["a", "c"]), ("h", "Unknown", ["a", "c"]), ("i", "T", ["q"])], "hash string, request_type string, tracepoints array<string>")
    got = sorted((r.group_hash, r.request_type, r["rank"]) for r in manifest.find_matches(g, m).collect())
    assert got == [("g", "T", 1), ("h", "T", 1), ("h", "U", 2)]


def test_hierarchy_and_context(spark):
    rows = [(0, "p", "Entry", 1), (1, "q", "Annotation", 9), (2, "r", "Entry", 2), (3, "r", "Exit", 2), (4, "p", "Exit", 1), (5, "z", "Annotation", 8)]
    ev = spark.createDataFrame([("t", *r) for r in rows], "base_id string, ord int, tracepoint string, variant string, span int")
    assert sorted((r.parent_tp, r.child_tp) for r in manifest.hierarchy_edges(ev).collect() if r.child_ord < 3) == [("p", "q"), ("p", "r")]
    assert {r.tracepoint for r in manifest.hierarchy_starts(ev).collect()} == {"p", "z"}
    rows = [(0, "p", "Entry", 1), (1, "r", "Entry", 2), (2, "s", "Annotation", 3), (3, "r", "Exit", 2), (4, "p", "Exit", 1)]
    ev = spark.createDataFrame([("t", *r) for r in rows], "base_id string, ord int, tracepoint string, variant string, span int")
    got = {r.ord: r.context for r in search.span_context(ev).collect()}
    assert (got[2], got[3], got[4]) == (["p", "r", "s"], ["p", "r"], ["p"])


def test_split_positions(spark):
    df = spark.createDataFrame([(0, 11, 3), (0, 3, 3), (0, 1, 3)], "s int, t int, n int")
    got = [r[0] for r in df.select(search.split_positions(F.col("s"), F.col("t"), 3)).collect()]
    assert got == [[3, 6, 9], [1, 2], []]
    taken = lambda *on: F.array(*(F.lit(i in on) for i in range(12)))
    picks = lambda s, t, *on: spark.range(1).select(search.split_positions(F.lit(s), F.lit(t), 3, taken(*on))).first()[0]
    assert picks(0, 11, 3) == [4, 7, 10]  # the pick after an enabled one, and the next gaps from there
    assert picks(0, 4, 1) == [2, 3] and picks(0, 4, 3) == [1, 2, 2]  # back by one before the target
    assert picks(2, 4, 3) == [] and picks(0, 4) == [1, 2, 3]  # nothing else is between
    c = spark.createDataFrame([(["a", "b", "c"], ["a", "b", "d"])], "a array<string>, b array<string>").select(search.common_prefix(F.col("a"), F.col("b"))).first()[0]
    assert c == ["a", "b"]


def test_control(spark):
    stats = spark.createDataFrame([("n", 1, 10), ("n", 2, 60_000_000), ("m", 1, 40_000_000)], "node string, hour_us bigint, trace_size bigint")
    assert control.overrun(stats).first().over is False
    assert control.overrun(stats.unionByName(spark.createDataFrame([("m", 2, 50_000_000)], stats.schema))).first().over is True
    p = spark.createDataFrame([(["a", "b", "c"], [1, 2, 3], "T")], "tracepoints array<string>, times array<bigint>, request_type string")
    assert {r.tracepoint for r in control.last_seen(p).collect()} == {"a", "b"}
    r = control.rates(spark.createDataFrame([("n", 0, 5), ("n", 0, 9), ("n", 2_000_000, 19)], "node string, hour_us bigint, received bigint")).collect()
    assert sorted(str(x.rate) for x in r) in (["0.0", "5.0", "None"], ["0.0", "7.0", "None"])  # two readings of one time have no order


def test_request_types(spark):
    tp = "x:openstackclient.compute.v2.server.CreateServer.take_action"
    ev = spark.createDataFrame([("t", 0, tp), ("u", 0, "other")], "base_id string, pos int, tracepoint string")
    assert dict(tuple(r) for r in manifest.tag(ev).collect()) == {"t": "ServerCreate", "u": "Unknown"}
