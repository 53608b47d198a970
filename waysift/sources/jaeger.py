"""Jaeger traces: spans with start and length become entries and exits, chained by parent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hex_id

_REF = "struct<refType:string,traceID:string,spanID:string>"
SCHEMA = f"data array<struct<traceID:string,spans:array<struct<traceID:string,spanID:string,flags:bigint,operationName:string,references:array<{_REF}>,startTime:bigint,duration:bigint,tags:array<struct<key:string,type:string,value:string>>,logs:array<string>,process:struct<serviceName:string,tags:array<string>>,warnings:string,processID:string>>>>, total bigint, limit bigint, offset bigint"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Spans of files or folders, one row each."""
    t = spark.read.schema(SCHEMA).option("multiLine", True).json(path).select(F.explode("data").alias("d"))
    return t.select(F.col("d.traceID").alias("trace"), F.posexplode("d.spans").alias("seq", "s"))


def rejected(spans: DataFrame) -> DataFrame:
    """base_id, op, reason: traces with a span of several references or of one to another trace."""
    bad = F.when(F.size("s.references") > 1, "several references").when((F.size("s.references") == 1) & (F.col("s.references")[0]["traceID"] != F.col("trace")), "reference to another trace").when(F.col("s.traceID") != F.col("trace"), "span of another trace")
    return spans.select(hex_id(F.col("trace")).alias("base_id"), F.lit("jaeger").alias("op"), bad.alias("reason")).filter("reason is not null").distinct()


def assemble(spans: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and traces as osprofiler.assemble() gives them, without rejected traces and without those that aren't connected.

    An event follows the one before among those of its parent's children, else its
    parent's entry; an event without parent follows the event before it if that is an
    exit or of the same span. All events are at hand, so none has to wait for its parent.
    """
    from ..operators.dag import connected

    ok = spans.withColumn("base_id", hex_id(F.col("trace"))).join(rejected(spans).select("base_id").distinct(), "base_id", "left_anti")
    ends = F.array(F.struct(F.lit("Entry").alias("variant"), F.col("s.startTime").alias("us")), F.struct(F.lit("Exit").alias("variant"), (F.col("s.startTime") + F.col("s.duration")).alias("us")))
    e = ok.select("base_id", "seq", hex_id(F.col("s.spanID")).alias("span_id"), hex_id(F.get("s.references", F.lit(0))["spanID"]).alias("parent_span_id"), F.col("s.operationName").alias("tracepoint"), F.col("s.process.serviceName").alias("host"), F.explode(ends).alias("v"))
    w = Window.partitionBy("base_id")
    e = e.withColumn("node_id", F.row_number().over(w.orderBy("v.us", "seq", F.when(F.col("v.variant") == "Entry", 0).otherwise(1))).cast("bigint"))
    nodes = e.select("base_id", F.col("base_id").alias("own_base"), "node_id", "span_id", "parent_span_id", "tracepoint", F.col("v.variant").alias("variant"), (F.col("v.us") * 1000).alias("ts_ns"), F.lit(False).alias("is_synthetic"), F.map_filter(F.create_map(F.lit("host"), F.col("host")), lambda k, v: v.isNotNull()).alias("kv"))
    me = F.struct(F.col("node_id").alias("n"), F.col("ts_ns").alias("t"), F.col("variant").alias("v"), F.col("span_id").alias("s"))
    k = nodes.withColumn("me", me)
    k = k.withColumn("sibling", F.lag("me").over(Window.partitionBy("base_id", "parent_span_id").orderBy("node_id"))).withColumn("before", F.lag("me").over(w.orderBy("node_id")))
    up = k.filter("variant = 'Entry'").select("base_id", F.col("span_id").alias("parent_span_id"), F.col("me").alias("up"))
    k = k.join(up, ["base_id", "parent_span_id"], "left")
    src = F.when(F.col("parent_span_id").isNull(), F.when((F.col("before.v") == "Exit") | (F.col("before.s") == F.col("span_id")), F.col("before"))).otherwise(F.coalesce("sibling", "up"))
    edges = k.withColumn("src", src).filter("src is not null").select("base_id", F.col("src.n").alias("src"), F.col("node_id").alias("dst"), (F.col("ts_ns") - F.col("src.t")).alias("duration_ns"), F.lit("ChildOf").alias("variant"), F.col("node_id").alias("edge_seq"))
    traces = nodes.groupBy("base_id").agg(F.min("node_id").alias("start_node"), F.max("node_id").alias("end_node"), (F.max("ts_ns") - F.min("ts_ns")).alias("duration_ns"))
    whole = connected(nodes, edges).filter("is_connected").select("base_id")
    return tuple(df.join(whole, "base_id", "left_semi") for df in (nodes, edges, traces))
