"""X-Trace reports: one event graph per envelope, with parents named by each report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import event_uuid, hex_id

#: The fields of a report.
_REPORT = "Agent string, ProcessName string, TaskID string, ParentEventID array<string>, Label string, Title string, Host string, HRT bigint, Timestamp bigint, ThreadID bigint, ThreadName string, EventID string, ProcessID bigint, Source string, Tag array<string>, Operation string, Cycles bigint, File string, Duration bigint, Connection string, Bytes bigint, Queue string, QueueDuration bigint, Name string, Readsize string, Writesize string, Replication string, Command string"
SCHEMA = f"id string, reports array<struct<{', '.join(c.replace(' ', ':', 1) for c in _REPORT.split(', '))}>>"

#: The names under which a node keeps what a report says.
KEPT = {"Agent": "Agent", "Process Name": "ProcessName", "Host": "Host", "Thread Name": "ProcessID", "Name": "Name", "Read Size": "Readsize", "Write Size": "Writesize", "Replication": "Replication"}
#: Tracepoints of the second flavour that stand for no work of their own, and edges (child, parent) between them.
SKIPPED = ("/tmp/xtrace-cpp/src/lua_baggage.cpp:33", "/tmp/xtrace-cpp/src/luaxtrace.cpp:49")
SKIPPED_EDGES = (("/tmp/xtrace-cpp/src/lua_baggage.cpp:33", "/tmp/xtrace-cpp/src/lua_baggage.cpp:33"), ("/tmp/xtrace-cpp/src/lua_baggage.cpp:33", "/tmp/xtrace-cpp/src/lua_baggage.cpp:43"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Envelopes of files or folders."""
    return spark.read.schema(SCHEMA).option("multiLine", True).json(path)


def assemble(envelopes: DataFrame, hex_events: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and traces as osprofiler.assemble() gives them. hex_events: event ids are hex (of at least eight bytes) rather than decimal. A node's tracepoint is its source, else its label; all are annotations; the first report is the start, the last the end."""
    event = (lambda c: hex_id(c)) if hex_events else (lambda c: event_uuid(c))
    r = envelopes.select(hex_id(F.col("id")).alias("base_id"), F.posexplode("reports").alias("seq", "r"))
    w = Window.partitionBy("base_id").orderBy("r.HRT", "seq")
    n = r.select("base_id", "seq", "r", F.row_number().over(w).cast("bigint").alias("node_id"))
    tag = F.get("r.Tag", F.lit(0))
    command = F.when(F.col("r.Source").isNull() & tag.contains(" "), F.expr("substr(substring_index(get(r.Tag, 0), ' ', 1), 2)"))
    values = F.create_map(*(x for k, c in KEPT.items() for x in (F.lit(k), F.col(f"r.{c}").cast("string"))), F.lit("Tag"), F.when(F.col("r.Source").isNotNull(), tag), F.lit("Command"), command)
    nodes = n.select(
        "base_id",
        F.col("base_id").alias("own_base"),
        "node_id",
        event(F.col("r.EventID")).alias("span_id"),
        F.lit(None).cast("string").alias("parent_span_id"),
        F.coalesce("r.Source", "r.Label").alias("tracepoint"),
        F.lit("Annotation").alias("variant"),
        F.col("r.HRT").alias("ts_ns"),
        F.lit(False).alias("is_synthetic"),
        F.map_filter(values, lambda k, v: v.isNotNull()).alias("kv"),
    )
    up = n.select("base_id", F.col("node_id").alias("dst"), F.col("r.HRT").alias("t"), F.posexplode("r.ParentEventID").alias("k", "p")).withColumn("span_id", event(F.col("p")))
    own = nodes.select("base_id", "span_id", F.col("node_id").alias("src"), F.col("ts_ns").alias("s"))
    edges = up.join(own, ["base_id", "span_id"]).select("base_id", "src", "dst", (F.col("t") - F.col("s")).alias("duration_ns"), F.lit("ChildOf").alias("variant"), F.row_number().over(Window.partitionBy("base_id").orderBy("dst", "k")).cast("bigint").alias("edge_seq"))
    return nodes, edges, _ends(nodes)


def simplify(nodes: DataFrame, edges: DataFrame, skip: tuple[str, ...] = SKIPPED, pairs: tuple[tuple[str, str], ...] = SKIPPED_EDGES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and traces without skipped tracepoints, whose successors hang on their nearest kept ancestors, and without skipped edges. The first kept node is the start, the last the end."""
    from ..operators.dag import contract, drop_edges

    spark = nodes.sparkSession
    kept, e = contract(spark, nodes, edges, nodes.filter(F.col("tracepoint").isin(*skip)).select("base_id", "node_id"))
    e = drop_edges(e, kept, spark.createDataFrame(list(pairs), "child string, parent string"))
    at = kept.select("base_id", "node_id", "ts_ns")
    e = e.join(at.select("base_id", F.col("node_id").alias("src"), F.col("ts_ns").alias("a")), ["base_id", "src"]).join(at.select("base_id", F.col("node_id").alias("dst"), F.col("ts_ns").alias("b")), ["base_id", "dst"])
    e = e.select("base_id", "src", "dst", (F.col("b") - F.col("a")).alias("duration_ns"), F.lit("ChildOf").alias("variant"), F.row_number().over(Window.partitionBy("base_id").orderBy("dst", "src")).cast("bigint").alias("edge_seq"))
    return kept, e, _ends(kept)


def _ends(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("base_id").agg(F.min("node_id").alias("start_node"), F.max("node_id").alias("end_node"), (F.max_by("ts_ns", "node_id") - F.min_by("ts_ns", "node_id")).alias("duration_ns"))


def recent(listing: DataFrame, now_s: int, jiffy_s: int = 20, seen: DataFrame | None = None, tag: str = "tag/main") -> tuple[DataFrame, DataFrame]:
    """base_id of a listing's rows (base_id, at_s, tags) that are older than a jiffy, have the tag and were not seen before; and all seen by now. The first poll (seen null) only fills the second."""
    found = listing.filter((F.lit(now_s) - F.col("at_s") > jiffy_s) & F.col("tags").contains(tag)).select("base_id").distinct()
    if seen is None:
        return found.limit(0), found
    new = found.join(seen.select("base_id"), "base_id", "left_anti")
    return new, seen.select("base_id").unionByName(new)
