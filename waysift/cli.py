"""Command line: python -m waysift.cli SETTINGS COMMAND ..."""

from __future__ import annotations

import argparse
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import report
from .functions import REQUEST_TYPES, path_hash
from .operators import control, critical, dag, groups, manifest, search
from .settings import Settings
from .sources import Traces, only, open_source, save, trace_ids
from .streaming.controller import Controller


_STEP = ("span_id", "tracepoint", "variant", "ts_ns", "is_synthetic")


def _rows(steps: DataFrame) -> DataFrame:
    """base_id, path, tracepoints, times, spans, variants, n_nodes, duration_ns, hash of whole paths."""
    p = steps.groupBy("base_id", "path").agg(F.sort_array(F.collect_list(F.struct("pos", "tracepoint", "ts_ns", "span_id", "variant"))).alias("p"))
    names = {"tracepoint": "tracepoints", "ts_ns": "times", "span_id": "spans", "variant": "variants"}
    p = p.select("base_id", "path", *(F.col(f"p.{c}").alias(n) for c, n in names.items()))
    return p.select("*", F.size("tracepoints").alias("n_nodes"), (F.element_at("times", -1) - F.element_at("times", 1)).alias("duration_ns"), path_hash(F.col("tracepoints")).alias("hash"))


def critical_steps(t: Traces) -> DataFrame:
    """The critical paths' steps, with synthetic ends of spans and without repeated ones. Traces whose walk doesn't meet their start are left out."""
    found = critical.critical_paths(t.nodes, t.edges, t.traces).filter("is_whole")
    steps = critical.path_steps(found, t.nodes.select("base_id", "node_id", *_STEP)).withColumn("path", F.lit(0).cast("bigint"))
    return critical.whole_paths(steps, t.nodes, t.edges)


def paths_of(t: Traces) -> DataFrame:
    """Critical paths with their tracepoints, times, hash and request type, as the grouping takes them."""
    return _rows(critical_steps(t)).drop("path").join(types_of(t), "base_id")


def types_of(t: Traces) -> DataFrame:
    """base_id, request_type of every trace, by its entries."""
    entries = t.nodes.filter("variant = 'Entry'")
    return t.traces.select("base_id").join(manifest.tag(entries, "node_id", REQUEST_TYPES), "base_id", "left").withColumn("request_type", F.coalesce("request_type", F.lit("Unknown")))


def possible_steps(spark: SparkSession, t: Traces) -> DataFrame:
    """As critical_steps(), of all paths of traces, not the critical ones only."""
    every = dag.all_paths(spark, t.edges, t.traces.select("base_id", F.col("start_node").alias("node_id")))
    every = every.withColumn("path", F.xxhash64("node_ids"))
    steps = every.select("base_id", "path", F.posexplode("node_ids").alias("pos", "node_id")).join(t.nodes.select("base_id", "node_id", *_STEP), ["base_id", "node_id"])
    w = Window.partitionBy("base_id", "path").orderBy("pos")
    return critical.whole_paths(steps.withColumn("edge_ns", F.col("ts_ns") - F.lag("ts_ns").over(w)), t.nodes, t.edges)


def manifest_of(spark: SparkSession, t: Traces) -> tuple[DataFrame, DataFrame]:
    """The catalogue of all paths of traces, and the paths' events."""
    steps = possible_steps(spark, t)
    rows = _rows(steps).join(types_of(t), "base_id").persist()  # read several times
    return manifest.build(rows), manifest.path_events(steps, rows)


def run(spark: SparkSession, s: Settings, folder: str, batches: int | None = None, targets: set[str] | None = None, clock: Callable[[], float] = time.time, wait: Callable[[float], None] = time.sleep, stats: Callable[[], DataFrame] | None = None) -> DataFrame:
    """The controller over the traces that lie at trace_path, looked at once a jiffy; gives what is enabled in the end. stats: node, hour_us, trace_size of the agents, if there are any."""
    events = spark.read.parquet(s.manifest_file + "_events") if s.search_strategy == "Hierarchical" else None
    known = manifest.read(spark, s.manifest_file)
    c = Controller(s, folder, search.strategy(s.search_strategy, known, events), known, targets or set(), clock, stats)
    first = number = c.resume(spark)
    while not c.stopped and (batches is None or number < first + batches):
        if number > first:
            wait(s.jiffy_s)
        c.poll(paths_of(open_source(s.application)(spark, s.trace_path)), number)
        number += 1
    return control.read_state(spark, s.state_path)


COMMANDS = ("manifest", "manifest-stats", "show-manifest", "group", "read", "get-trace", "dump-traces", "recent-traces", "get-crit", "key-value", "enable-all", "disable-all", "disable-tracepoint", "enable-skeleton", "show-config", "run")


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> DataFrame | None:
    """Runs a command; what it shows is also returned."""
    p = argparse.ArgumentParser(prog="waysift")
    p.add_argument("settings")
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("what", nargs="?", help="a trace id, a list of ids, a request type or a tracepoint")
    p.add_argument("--out")
    p.add_argument("--overwrite", action="store_true")
    p.add_argument("--prune", action="store_true")
    p.add_argument("--batches", type=int, help="run: polls to make; without it, until the targets are found")
    p.add_argument("--target", action="append", default=[], help="run: tracepoints to look for")
    a = p.parse_args(args)
    s = Settings.read(a.settings)
    spark = spark or SparkSession.builder.appName("waysift").getOrCreate()
    mode = "overwrite" if a.overwrite else "errorifexists"
    read = lambda search=False: open_source(s.application)(spark, s.trace_path, search)
    out: DataFrame | None = None
    if a.command == "show-config":
        out = spark.createDataFrame([(k, str(v)) for k, v in vars(s).items()], "setting string, value string")
    elif a.command == "manifest":
        t = read(True)
        t = only(t, trace_ids(spark, a.what))[0] if a.what else t
        catalogue, events = manifest_of(spark, t)
        catalogue.write.partitionBy("request_type").mode(mode).parquet(s.manifest_file)
        events.write.mode(mode).parquet(s.manifest_file + "_events")
        out = manifest.stats(manifest.read(spark, s.manifest_file))
    elif a.command == "run":
        out = run(spark, s, a.out, a.batches, set(a.target))
    elif a.command == "manifest-stats":
        out = manifest.stats(manifest.read(spark, s.manifest_file))
    elif a.command == "show-manifest":
        out = manifest.read(spark, s.manifest_file).filter(F.col("request_type") == a.what).orderBy(F.desc("occurrences"), "hash")
    elif a.command in ("group", "read", "get-trace", "dump-traces", "get-crit", "key-value", "recent-traces"):
        t = read()
        if a.command == "group":
            t = only(t, trace_ids(spark, a.what))[0] if a.what else t
            out = groups.report(paths_of(t).persist()).orderBy(F.desc("n_traces"), "hash")
        elif a.command == "recent-traces":
            out = t.traces.select("base_id")
        else:
            if a.what and a.command != "dump-traces":
                t = only(t, spark.createDataFrame([(a.what,)], "base_id string"))[0]
            if a.prune:
                t = Traces(*dag.prune(spark, t.nodes, t.edges, t.traces), t.traces)
            if a.command == "key-value":
                out = dag.key_values(t.nodes)
            elif a.command == "get-crit":
                steps = critical_steps(t).withColumn("node_id", F.col("pos").cast("bigint"))  # synthetic nodes have no number of their own
                out = report.dot(steps, steps.filter("pos > 0").select("base_id", (F.col("node_id") - 1).alias("src"), F.col("node_id").alias("dst"), F.col("edge_ns").alias("duration_ns")))
            else:
                if a.out:
                    save(t, a.out, mode)
                out = report.dot(t.nodes, t.edges)
    else:
        kind = "seq bigint, tracepoint string, request_type string, enable boolean"
        points = manifest.read(spark, s.manifest_file).select(F.explode("tracepoints").alias("tracepoint")).distinct()
        if a.command == "disable-tracepoint":
            changes = spark.createDataFrame([(0, a.what, None, False)], kind)
        elif a.command == "enable-skeleton":
            changes = manifest.skeleton(manifest.entry_points(manifest.read(spark, s.manifest_file)), manifest.request_type_tracepoints(points)).select(F.lit(0).cast("bigint").alias("seq"), "tracepoint", F.lit(None).cast("string").alias("request_type"), F.lit(True).alias("enable"))
        else:
            changes = points.select(F.lit(0).cast("bigint").alias("seq"), "tracepoint", F.lit(None).cast("string").alias("request_type"), F.lit(a.command == "enable-all").alias("enable"))
        out = control.write_state(spark, control.apply_changes(control.read_state(spark, s.state_path), changes), s.state_path)
        if s.control_file:
            control.control_file(control.not_disabled(points, out), s.control_file)
    if out is not None:
        out.show(50, truncate=False)
    return out


if __name__ == "__main__":
    main()
