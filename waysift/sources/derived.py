"""Traces derived from ordinary tables: sessions, line-item graphs, nested spans and agent counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GAP_US = 86_400_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970 of a timestamp column; one without time zone is in UTC, whatever the session's."""
    c = F.col(column)
    return F.unix_micros(F.convert_timezone(F.lit("UTC"), F.current_timezone(), c).cast("timestamp") if dict(df.dtypes)[column] == "timestamp_ntz" else c)


def sessions(events: DataFrame, gap_us: int = GAP_US) -> DataFrame:
    """base_id, user_id, event_id, pos, tracepoint, ts_ns: a trace is a user's events up to a gap of over gap_us (a day at least).

    Within a day there is no such gap, so breaks are found on one row per user and day,
    which the aggregation makes before it shuffles; a user with very many events costs
    no more there than any other.
    """
    if gap_us < 86_400_000_000:
        raise ValueError("gaps under a day aren't found between days")
    us = micros(events, "ts")
    e = events.select("user_id", "event_id", F.col("event_type").alias("tracepoint"), us.alias("us"), F.floor(us / 86_400_000_000).alias("day"))
    days = e.groupBy("user_id", "day").agg(F.min("us").alias("first"), F.max("us").alias("last"))
    w = Window.partitionBy("user_id").orderBy("day")
    days = days.withColumn("new", F.when(F.col("first") - F.lag("last").over(w) > gap_us, 1).otherwise(0)).withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = e.join(days.select("user_id", "day", "session"), ["user_id", "day"])
    order = Window.partitionBy("user_id", "session").orderBy("us", "event_id")
    return own.select(F.concat_ws("-", "user_id", "session").alias("base_id"), "user_id", "event_id", F.row_number().over(order).alias("pos"), "tracepoint", (F.col("us") * 1000).alias("ts_ns"))


def session_paths(events: DataFrame) -> DataFrame:
    """A row per session: base_id, user_id, tracepoints and times (arrays in order), n_nodes, duration_ns, hash."""
    from ..functions import path_hash

    s = sessions(events).groupBy("base_id", "user_id").agg(F.sort_array(F.collect_list(F.struct("pos", "tracepoint", "ts_ns"))).alias("path"))
    tp = F.transform("path", lambda x: x["tracepoint"])
    ts = F.transform("path", lambda x: x["ts_ns"])
    s = s.select("base_id", "user_id", tp.alias("tracepoints"), ts.alias("times"))
    return s.select("*", F.size("tracepoints").alias("n_nodes"), (F.element_at("times", -1) - F.element_at("times", 1)).alias("duration_ns"), path_hash(F.col("tracepoints")).alias("hash"))


_HEAP_ORDER = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]


def heap_nodes(lineitem: DataFrame) -> DataFrame:
    """base_id, node_id, tracepoint, ts_ns, n (lines of the order), days: an order's lines by ship date."""
    w = Window.partitionBy("l_orderkey")
    return lineitem.select(
        F.col("l_orderkey").alias("base_id"),
        F.row_number().over(w.orderBy(*_HEAP_ORDER)).cast("bigint").alias("node_id"),
        F.concat("l_returnflag", "l_linestatus").alias("tracepoint"),
        (micros(lineitem, "l_shipdate") * 1000).alias("ts_ns"),
        F.count("*").over(w).alias("n"),
        F.col("l_quantity").cast("bigint").alias("days"),
    )


def heap_graph(lineitem: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (with the sink, node n + 1, at the last line's time) and edges of one graph per order: node i // 2 leads to node i, nodes without a next lead to the sink. edge_seq is the source for edges to the sink, else the target."""
    lines = heap_nodes(lineitem)
    last = lines.filter("node_id = n").select("base_id", (F.col("n") + 1).alias("node_id"), F.lit("sink").alias("tracepoint"), "ts_ns", "n", F.lit(0).cast("bigint").alias("days"))
    nodes = lines.unionByName(last)
    up = lines.filter("node_id > 1").select("base_id", F.floor(F.col("node_id") / 2).alias("src"), F.col("node_id").alias("dst"), F.col("node_id").alias("edge_seq"))
    down = lines.filter("2 * node_id > n").select("base_id", F.col("node_id").alias("src"), (F.col("n") + 1).alias("dst"), F.col("node_id").alias("edge_seq"))
    edges = up.unionByName(down)
    return nodes, edges


def nested_spans(lineitem: DataFrame) -> DataFrame:
    """Entry and Exit events of a span per order and one per line: base_id, span (0: the order's), parent, tracepoint, variant, ts_ns, ord (the position in the trace)."""
    day = 86_400 * 10**9
    lines = heap_nodes(lineitem)
    end = F.max("ts_ns").over(Window.partitionBy("base_id")) + 10 * day
    lines = lines.withColumn("end", end)
    line = lines.select("base_id", F.col("node_id").alias("span"), F.lit(0).cast("bigint").alias("parent"), "tracepoint", F.explode(F.array(F.struct(F.lit("Entry").alias("variant"), F.col("ts_ns").alias("ts"), F.lit(1).alias("rank")), F.struct(F.lit("Exit").alias("variant"), F.least(F.col("ts_ns") + F.col("days") * day, F.col("end")).alias("ts"), F.lit(2).alias("rank")))).alias("e"))
    order = lines.filter("node_id = 1").select("base_id", F.lit(0).cast("bigint").alias("span"), F.lit(None).cast("bigint").alias("parent"), F.lit("order").alias("tracepoint"), F.explode(F.array(F.struct(F.lit("Entry").alias("variant"), F.col("ts_ns").alias("ts"), F.lit(0).alias("rank")), F.struct(F.lit("Exit").alias("variant"), F.col("end").alias("ts"), F.lit(3).alias("rank")))).alias("e"))
    w = Window.partitionBy("base_id").orderBy("ts_ns", "rank", "span")
    flat = line.unionByName(order).select("base_id", "span", "parent", "tracepoint", F.col("e.variant").alias("variant"), F.col("e.ts").alias("ts_ns"), F.col("e.rank").alias("rank"))
    return flat.select("base_id", "span", "parent", "tracepoint", "variant", "ts_ns", F.row_number().over(w).alias("ord"))


def node_counters(events: DataFrame) -> DataFrame:
    """node, hour_us, received (a rising counter of bytes), trace_size: hourly readings of four agents."""
    hour = F.floor(micros(events, "ts") / 3_600_000_000) * 3_600_000_000
    got = events.groupBy(F.pmod("user_id", F.lit(4)).alias("node"), hour.alias("hour_us")).agg(F.sum(F.length("props") + 100).alias("bytes"), F.sum(F.floor(F.col("value") * 1000)).alias("size"))
    w = Window.partitionBy("node").orderBy("hour_us").rowsBetween(Window.unboundedPreceding, 0)
    return got.select("node", "hour_us", F.sum("bytes").over(w).alias("received"), F.col("size").alias("trace_size"))
