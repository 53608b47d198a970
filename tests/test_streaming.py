"""Streams over file sources, run to their end."""

import json

from pyspark.sql import functions as F

from waysift import streaming


def test_stable_traces(spark, tmp_path):
    rows = [("a", 1, 5), ("a", 2, 8), ("a", 3, 8), ("a", 4, 8), ("b", 1, 5), ("b", 2, 6), ("c", 1, None), ("c", 2, 4), ("c", 3, 4)] + [("d", k, None) for k in range(6)] + [("d", 7, 1), ("d", 8, 1)]
    schema = "base_id string, poll bigint, duration_ns bigint"
    table = spark.createDataFrame(rows, schema)
    table.repartition(1).write.json(str(tmp_path / "in"))
    q = streaming.stable_traces(spark.readStream.schema(schema).json(str(tmp_path / "in"))).writeStream.format("memory").queryName("stable").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = [("a", 3, 8), ("c", 3, 4)]
    assert sorted(tuple(r) for r in spark.table("stable").collect()) == want
    assert sorted(tuple(r) for r in streaming.stable_in_table(table).collect()) == want


def test_loop(spark, tmp_path):
    schema = "base_id string, hash string, tracepoints array<string>, times array<bigint>, n_nodes int, duration_ns bigint"
    rows = [(f"t{k}", "g", ["a", "b"], [0, d], 2, d) for k, d in enumerate((10_000, 20_000, 30_000, 40_000))]
    for part in (rows[:2], rows[2:]):
        spark.createDataFrame(part, schema).repartition(1).write.mode("append").json(str(tmp_path / "in"))
    now = iter(range(0, 10_000, 100))
    loop = streaming.Loop(str(tmp_path / "state"), decide=lambda g: g.select("hash"), clock=lambda: next(now), epoch_s=120)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    loop.start(stream, str(tmp_path / "cp"), available_now=True).awaitTermination()
    g = loop.groups(spark).first()
    assert (g.n_traces, g.mean_us, g.variance_us2) == (4, 25.0, 125.0)
    logged = [json.loads(line) for p in (tmp_path / "state/log").glob("*/*.json") for line in p.read_text().splitlines()]
    assert sum(r["n_traces"] for r in logged) == 4
    assert list((tmp_path / "state/decisions").glob("*"))


def test_sessions_and_new_traces(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00", 1, "x"), ("a", "2024-01-01 00:00:05", 2, "y"), ("b", "2024-01-01 00:00:00", 1, "x"), ("c", "2024-01-02 00:00:00", 9, "z")]
    df = spark.createDataFrame(rows, "base_id string, seen string, ts_ns bigint, tracepoint string").withColumn("seen", F.to_timestamp("seen"))
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, out in (("sess", streaming.complete_sessions(stream, "seen", "1 minute", "1 minute")), ("fresh", streaming.new_traces(stream))):
        out.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    done = {r.base_id: (r.n_nodes, r.duration_ns) for r in spark.table("sess").collect()}
    assert done == {"a": (2, 1), "b": (1, 0)}
    assert sorted(r.base_id for r in spark.table("fresh").collect()) == ["a", "b", "c"]
    assert streaming.should_stop({"a"}, {"a", "b"}, 20) and not streaming.should_stop({"a"}, set(), 99)
