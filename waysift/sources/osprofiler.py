"""OSProfiler spans: variants by shape, names, and edges of the event graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import split_objects, uuid

#: The keys of info (and of its function, after f.) that make each variant, and what each becomes.
SHAPES: dict[str, tuple[str, str]] = {
    "WaitFor": ("f.name,function,host,pid,thread_id,tracepoint_id,wait_for", "Annotation"),
    "Child": ("child_id,host,pid,thread_id,tracepoint_id", "Annotation"),
    "Plain": ("host,pid,thread_id,tracepoint_id", "Annotation"),
    "Log": ("host,msg,pid,thread_id,tracepoint_id", "Annotation"),
    "KeyValue": ("host,pid,thread_id,tracepoint_id,value", "Annotation"),
    "Args": ("f.args,f.kwargs,f.name,function,host,pid,thread_id,tracepoint_id", "Annotation"),
    "Results": ("f.result,function,host", "Annotation"),
    "WaitForKeyValue": ("f.args,f.kwargs,f.name,function,host,pid,thread_id,tracepoint_id,wait_for", "Annotation"),
    "FunctionEntry": ("f.name,function,host,pid,thread_id,tracepoint_id", "Entry"),
    "RequestEntry": ("host,pid,request,thread_id,tracepoint_id", "Entry"),
    "ExitNormal": ("host", "Exit"),
    "ExitError": ("etype,host,message", "Exit"),
}

SCHEMA = "trace_id string, parent_id string, project string, name string, base_id string, service string, tracepoint_id string, timestamp string, info variant"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Spans of files that hold JSON arrays of them; a folder works as a file does."""
    return spark.read.schema(SCHEMA).option("multiLine", True).json(path)


def read_blobs(blobs: DataFrame, column: str = "value") -> DataFrame:
    """Spans of columns in which they stand one after another; what isn't a span comes with a null trace_id."""
    return blobs.select(F.explode(split_objects(F.col(column))).alias("j")).select(F.from_json("j", SCHEMA).alias("s"), "j").select("s.*", F.when(F.col("s.trace_id").isNull(), F.col("j")).alias("_corrupt"))


def shape(info: Column) -> Column:
    """The variant that the keys of info make; null if none."""
    text = F.to_json(info)
    keys = F.concat(F.json_object_keys(text), F.coalesce(F.transform(F.json_object_keys(F.get_json_object(text, "$.function")), lambda k: F.concat(F.lit("f."), k)), F.array().cast("array<string>")))
    joined = F.array_join(F.array_sort(keys), ",")
    out = F.lit(None).cast("string")
    for name, (expected, _) in SHAPES.items():
        out = F.when(joined == expected, F.lit(name)).otherwise(out)
    return out


def nanoseconds(text: Column) -> Column:
    return F.unix_micros(F.to_timestamp(F.concat(F.substring_index(text, "+", 1), F.lit("+00:00")))) * 1000


def spans(raw: DataFrame) -> DataFrame:
    """base_id, span_id, parent_span_id, name, shape, variant, ts_ns, tracepoint (of entries and annotations), wait_for, child_id, kv, ord (order within its own base id)."""
    text = F.to_json("info")
    s = raw.filter("trace_id is not null").select(
        uuid(F.col("base_id")).alias("base_id"),
        uuid(F.col("trace_id")).alias("span_id"),
        uuid(F.col("parent_id")).alias("parent_span_id"),
        "name",
        shape(F.col("info")).alias("shape"),
        nanoseconds(F.col("timestamp")).alias("ts_ns"),
        F.coalesce(F.get_json_object(text, "$.tracepoint_id"), F.col("tracepoint_id")).alias("tracepoint"),
        uuid(F.get_json_object(text, "$.wait_for")).alias("wait_for"),
        uuid(F.get_json_object(text, "$.child_id")).alias("child_id"),
        F.map_filter(F.create_map(F.lit("host"), F.get_json_object(text, "$.host"), F.lit("lock_queue"), F.get_json_object(text, "$.value")), lambda k, v: v.isNotNull()).alias("kv"),
    )
    kinds = F.create_map(*(F.lit(x) for n, (_, v) in SHAPES.items() for x in (n, v)))
    s = s.withColumn("variant", F.element_at(kinds, F.col("shape")))
    w = Window.partitionBy("base_id").orderBy("ts_ns", F.when(F.col("variant") == "Entry", 0).otherwise(1), F.when(F.col("name").endswith("-start"), 0).otherwise(1), "span_id")
    s = s.withColumn("ord", F.row_number().over(w))
    return s.withColumn("tracepoint", F.when((F.col("variant") == "Exit") & ~F.col("name").startswith("asynch_wait"), F.lit(None)).otherwise(F.col("tracepoint")))


def exit_names(events: DataFrame, span: str = "span_id", order: str = "ord") -> DataFrame:
    """With name: an event's own tracepoint, or that of the last entry of its span before it."""
    w = Window.partitionBy("base_id", span).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("name", F.last(F.when(F.col("variant") == "Entry", F.col("tracepoint")), True).over(w)).withColumn("name", F.coalesce(F.col("tracepoint"), F.col("name")))


def infer_edges(events: DataFrame) -> DataFrame:
    """base_id, src, dst, duration_ns, variant, edge_seq from events (base_id, node_id in order, span_id, parent_span_id, variant, ts_ns).

    An entry or annotation follows the node before it with the same parent, else its
    parent's entry; an exit follows the last node whose parent is its span, else its own
    entry. Nodes without either have no edge.
    """
    w = Window.partitionBy("base_id", "parent_span_id").orderBy("node_id")
    e = events.withColumn("sibling", F.when(F.col("parent_span_id").isNotNull(), F.struct(F.lag("node_id").over(w).alias("n"), F.lag("ts_ns").over(w).alias("t"))))
    entry = events.filter("variant = 'Entry'").groupBy("base_id", "span_id").agg(F.min(F.struct(F.col("node_id").alias("n"), F.col("ts_ns").alias("t"))).alias("entry"))
    last = events.filter("parent_span_id is not null").groupBy("base_id", F.col("parent_span_id").alias("span_id")).agg(F.max(F.struct(F.col("node_id").alias("n"), F.col("ts_ns").alias("t"))).alias("child"))
    own = e.join(entry, ["base_id", "span_id"], "left").join(last, ["base_id", "span_id"], "left").join(entry.select("base_id", F.col("span_id").alias("parent_span_id"), F.col("entry").alias("up")), ["base_id", "parent_span_id"], "left")
    src = F.when(F.col("variant") == "Exit", F.coalesce("child", "entry")).otherwise(F.when(F.col("sibling.n").isNotNull(), F.col("sibling")).otherwise(F.col("up")))
    own = own.withColumn("src", src).filter("src.n is not null")
    return own.select("base_id", F.col("src.n").alias("src"), F.col("node_id").alias("dst"), (F.col("ts_ns") - F.col("src.t")).alias("duration_ns"), F.lit("ChildOf").alias("variant"), F.col("node_id").cast("bigint").alias("edge_seq"))


def assemble(s: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and traces of spans(): asynchronous sub-traces are joined to the trace that forks them.

    Nodes: base_id (of the outermost trace), own_base, node_id (by time), span_id,
    parent_span_id, tracepoint, variant, ts_ns, is_synthetic, kv. Edges: base_id, src, dst,
    duration_ns, variant, edge_seq. Traces: base_id, start_node, end_node, duration_ns.
    Spans that wait give no node; the node after their end is the waiter. A child
    annotation gives none either; the node before it forks.
    """
    from ..operators.dag import recursive

    forks = s.filter("shape = 'Child'").select("base_id", "child_id", "ord")
    waits = s.filter("shape = 'WaitFor'").select("base_id", "span_id", "wait_for").distinct()
    pairs = forks.select(F.col("child_id").alias("own"), F.col("base_id").alias("up")).distinct()
    tops = s.select("base_id").distinct().join(pairs.select(F.col("own").alias("base_id")), "base_id", "left_anti")
    root = recursive(
        s.sparkSession,
        "WITH RECURSIVE r(own, root) AS (SELECT base_id, base_id FROM {tops} UNION ALL SELECT p.own, r.root FROM r JOIN {pairs} p ON p.up = r.own) SELECT * FROM r",
        tops=tops,
        pairs=pairs,
    )
    w = Window.partitionBy("base_id").orderBy("ord")
    marked = s.join(waits.select("base_id", "span_id", F.col("wait_for").alias("waits_for")), ["base_id", "span_id"], "left")
    is_node = F.col("waits_for").isNull() & F.col("shape").isNotNull() & (F.col("shape") != "Child")
    marked = marked.withColumn("is_node", is_node)
    near = marked.withColumn("before", F.last(F.when(F.col("is_node"), F.col("ord")), True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("after", F.first(F.when(F.col("is_node"), F.col("ord")), True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    flat = exit_names(marked.filter("is_node")).withColumn("tracepoint", F.col("name")).join(root.select(F.col("own").alias("base_id"), "root"), "base_id")
    ids = flat.withColumn("node_id", F.row_number().over(Window.partitionBy("root").orderBy("ts_ns", F.when(F.col("base_id") == F.col("root"), 0).otherwise(1), "base_id", "ord")).cast("bigint"))
    nodes = ids.select(F.col("root").alias("base_id"), F.col("base_id").alias("own_base"), "ord", "node_id", "span_id", "parent_span_id", "tracepoint", "variant", "ts_ns", F.lit(False).alias("is_synthetic"), "kv")
    # within each sub-trace
    inner = infer_edges(nodes.select(F.col("own_base").alias("base_id"), F.col("ord").alias("node_id"), "span_id", "parent_span_id", "variant", "ts_ns"))
    at = nodes.select("base_id", "own_base", "ord", "node_id", "ts_ns")
    src = at.select(F.col("own_base").alias("b"), F.col("ord").alias("src"), F.col("node_id").alias("s_node"), F.col("ts_ns").alias("s_ts"))
    dst = at.select(F.col("own_base").alias("b"), F.col("ord").alias("dst"), F.col("node_id").alias("d_node"), "base_id")
    edges = inner.withColumnRenamed("base_id", "b").join(src, ["b", "src"]).join(dst, ["b", "dst"]).select("base_id", F.col("s_node").alias("src"), F.col("d_node").alias("dst"), "duration_ns", "variant")
    # between them
    first = at.groupBy("base_id", "own_base").agg(F.min_by(F.struct("node_id", "ts_ns"), "ord").alias("f"), F.max_by(F.struct("node_id", "ts_ns"), "ord").alias("l"))
    here = at.select(F.col("own_base").alias("b"), F.col("ord").alias("o"), F.col("node_id").alias("n"), F.col("ts_ns").alias("t"))
    fork = near.filter("shape = 'Child'").select(F.col("base_id").alias("b"), F.col("before").alias("o"), "child_id").join(here, ["b", "o"]).join(first, F.col("child_id") == F.col("own_base")).select("base_id", F.col("n").alias("src"), F.col("f.node_id").alias("dst"), (F.col("f.ts_ns") - F.col("t")).alias("duration_ns"), F.lit("FollowsFrom").alias("variant"))
    wait = near.filter("waits_for is not null and variant = 'Exit'").select(F.col("base_id").alias("b"), F.col("after").alias("o"), "waits_for").join(here, ["b", "o"]).join(first, F.col("waits_for") == F.col("own_base")).select("base_id", F.col("l.node_id").alias("src"), F.col("n").alias("dst"), (F.col("t") - F.col("l.ts_ns")).alias("duration_ns"), F.lit("FollowsFrom").alias("variant"))
    edges = edges.unionByName(fork).unionByName(wait).withColumn("edge_seq", F.row_number().over(Window.partitionBy("base_id").orderBy("dst", "src")).cast("bigint"))
    start = nodes.filter("own_base = base_id").groupBy("base_id").agg(F.min_by(F.struct("node_id", "ts_ns"), "ord").alias("a"))
    end = nodes.groupBy("base_id").agg(F.max_by(F.struct("node_id", "ts_ns"), F.struct("ts_ns", -F.col("node_id"))).alias("z"))
    traces = start.join(end, "base_id").select("base_id", F.col("a.node_id").alias("start_node"), F.col("z.node_id").alias("end_node"), (F.col("z.ts_ns") - F.col("a.ts_ns")).alias("duration_ns"))
    return nodes.drop("ord"), edges, traces


def quarantine(s: DataFrame, raw: DataFrame) -> DataFrame:
    """base_id, op, reason of what can't be used: unknown shapes, ids that aren't UUIDs, asynchronous marks that aren't annotations, exits before any entry."""
    bad_shape = s.filter("shape is null").select("base_id", F.lit("spans").alias("op"), F.lit("unknown shape of info").alias("reason"))
    bad_id = raw.filter(uuid(F.col("base_id")).isNull()).select("base_id", F.lit("spans").alias("op"), F.lit("malformed id").alias("reason"))
    w = Window.partitionBy("base_id", "span_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    lone = s.withColumn("e", F.max(F.when(F.col("variant") == "Entry", 1).when(F.col("shape").isin("WaitFor", "Args", "WaitForKeyValue"), 1)).over(w)).filter("variant = 'Exit' and e is null").select("base_id", F.lit("names").alias("op"), F.lit("exit without entry").alias("reason"))
    asynch = s.filter("(name like 'asynch_request%' or name like 'asynch_wait%') and variant = 'Entry'").select("base_id", F.lit("spans").alias("op"), F.lit("asynchronous mark that is no annotation").alias("reason"))
    return bad_shape.unionByName(bad_id).unionByName(lone).unionByName(asynch).distinct()
