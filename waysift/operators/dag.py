"""Operators on event graphs. Graphs are edge rows (base_id, src, dst); every operator works on all traces at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Levels that a recursion may take, at least the longest path in edges.
LEVELS = 10_000


def recursive(spark: SparkSession, sql: str, levels: int = LEVELS, **frames: DataFrame) -> DataFrame:
    """A recursive query over frames that it names as {name}. Limits of rows are off: they'd fail large inputs."""
    spark.conf.set("spark.sql.cteRecursionLevelLimit", str(levels))
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    return spark.sql(sql, **frames)


def sinks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without successor."""
    return nodes.join(edges.select("base_id", F.col("src").alias("node_id")), ["base_id", "node_id"], "left_anti")


def sources(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without predecessor."""
    return nodes.join(edges.select("base_id", F.col("dst").alias("node_id")), ["base_id", "node_id"], "left_anti")


def ends_by_time(nodes: DataFrame) -> DataFrame:
    """base_id, start_node, end_node: the nodes of least and of greatest time, the first of equals."""
    return nodes.groupBy("base_id").agg(F.min_by("node_id", F.struct("ts_ns", "node_id")).alias("start_node"), F.max_by("node_id", F.struct("ts_ns", -F.col("node_id"))).alias("end_node"))


def sync_points(edges: DataFrame) -> DataFrame:
    """base_id, node_id: nodes where several edges meet, and their direct predecessors."""
    meet = edges.groupBy("base_id", "dst").agg(F.count("*").alias("n")).filter("n > 1").select("base_id", "dst")
    return meet.select("base_id", F.col("dst").alias("node_id")).unionByName(edges.join(meet, ["base_id", "dst"], "left_semi").select("base_id", F.col("src").alias("node_id"))).distinct()


def reachable(spark: SparkSession, edges: DataFrame, starts: DataFrame, backward: bool = False) -> DataFrame:
    """base_id, node_id of all that starts (base_id, node_id) reach, themselves included. A trace's edges are one row, sorted so that an edge comes after those that lead to it as far as numbers tell; walks over them add what an edge leads to until nothing is added, each node once however many paths lead there."""
    a, b = (F.col("dst"), F.col("src")) if backward else (F.col("src"), F.col("dst"))
    e = edges.groupBy("base_id").agg(F.sort_array(F.collect_list(F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))), not backward).alias("e"))
    s = starts.groupBy("base_id").agg(F.collect_set(F.col("node_id").cast("bigint")).alias("seen"))
    found = s.join(e, "base_id", "left").withColumn("e", F.coalesce("e", F.array().cast("array<struct<a:bigint,b:bigint>>")))
    walk = lambda seen: F.aggregate("e", seen, lambda n, x: F.when(F.array_contains(n, x["a"]) & ~F.array_contains(n, x["b"]), F.concat(n, F.array(x["b"]))).otherwise(n))
    again = F.aggregate(F.sequence(F.lit(1), F.size("e") + 1), F.struct(F.col("seen").alias("n"), F.lit(-1).alias("was")), lambda s, _: F.when(F.size(s["n"]) == s["was"], s).otherwise(F.struct(walk(s["n"]).alias("n"), F.size(s["n"]).alias("was"))), lambda s: s["n"])
    return found.select("base_id", F.explode(again).alias("node_id"))


def reaches_span(spark: SparkSession, nodes: DataFrame, edges: DataFrame, starts: DataFrame, spans: DataFrame) -> DataFrame:
    """base_id, span_id of those spans (base_id, span_id) that starts reach."""
    return spans.join(reachable(spark, edges, starts).join(nodes, ["base_id", "node_id"]), ["base_id", "span_id"], "left_semi")


def prune(spark: SparkSession, nodes: DataFrame, edges: DataFrame, ends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges from which the end node (base_id, end_node) is reached."""
    keep = reachable(spark, edges, ends.select("base_id", F.col("end_node").alias("node_id")), backward=True)
    return nodes.join(keep, ["base_id", "node_id"], "left_semi"), edges.join(keep.withColumnRenamed("node_id", "dst"), ["base_id", "dst"], "left_semi").select(*edges.columns)


def count_paths(nodes: DataFrame, edges: DataFrame, starts: DataFrame) -> DataFrame:
    """base_id, n_paths: paths from the start node (base_id, node_id) to any sink, without listing them.

    Times rise along edges, so the order by time is topological; counts move along the
    edges in that order inside a trace's row.
    """
    rank = nodes.groupBy("base_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ts_ns", "node_id"))), lambda x: x["node_id"]).alias("order"))
    at = lambda c: (F.array_position("order", F.col(c)) - 1).cast("int")
    e = edges.join(rank, "base_id").select("base_id", at("src").alias("a"), at("dst").alias("b"))
    lists = e.groupBy("base_id").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("edges"))
    rows = rank.join(starts.select("base_id", F.col("node_id").alias("start")), "base_id").join(lists, "base_id", "left")
    first = F.transform("order", lambda n: F.when(n == F.col("start"), F.lit(1)).otherwise(F.lit(0)).cast("bigint"))
    moved = F.aggregate(F.coalesce("edges", F.array().cast("array<struct<a:int,b:int>>")), first, lambda c, x: F.transform(c, lambda v, i: F.when(i == x["b"], v + F.get(c, x["a"])).otherwise(v)))
    leaves = F.array_except(F.sequence(F.lit(0), F.size("order") - 1), F.coalesce(F.transform("edges", lambda x: x["a"]), F.array().cast("array<int>")))
    return rows.select("base_id", moved.alias("c"), leaves.alias("leaves")).select("base_id", F.aggregate("leaves", F.lit(0).cast("bigint"), lambda s, i: s + F.get("c", i)).alias("n_paths"))


def all_paths(spark: SparkSession, edges: DataFrame, starts: DataFrame) -> DataFrame:
    """base_id, node_ids of every path from the start to a sink; counts can be had first from count_paths()."""
    e = edges.select("base_id", F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"))
    s = starts.select("base_id", F.col("node_id").cast("bigint").alias("node_id"))
    every = recursive(
        spark,
        """
        WITH RECURSIVE r(base_id, node_id, node_ids) AS (
          SELECT base_id, node_id, array(node_id) FROM {s}
          UNION ALL
          SELECT e.base_id, e.dst, concat(r.node_ids, array(e.dst)) FROM r JOIN {e} e ON e.base_id = r.base_id AND e.src = r.node_id)
        SELECT * FROM r""",
        s=s,
        e=e,
    )
    return every.join(e.select("base_id", F.col("src").alias("node_id")).distinct(), ["base_id", "node_id"], "left_anti").select("base_id", "node_ids")


def contract(spark: SparkSession, nodes: DataFrame, edges: DataFrame, skip: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the nodes in skip (base_id, node_id); their successors hang on their nearest kept ancestors. Edges: base_id, src, dst, once each."""
    s = skip.select("base_id", F.col("node_id").cast("bigint").alias("node_id")).withColumn("skipped", F.lit(True))
    e = edges.select("base_id", F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"))
    e = e.join(s.select("base_id", F.col("node_id").alias("src"), F.col("skipped").alias("via")), ["base_id", "src"], "left").withColumn("via", F.coalesce("via", F.lit(False)))
    kept = e.join(s.select("base_id", F.col("node_id").alias("dst")), ["base_id", "dst"], "left_anti")
    found = recursive(
        spark,
        """
        WITH RECURSIVE r(base_id, src, dst, via) AS (
          SELECT base_id, src, dst, via FROM {kept}
          UNION ALL
          SELECT r.base_id, e.src, r.dst, e.via FROM r JOIN {e} e ON e.base_id = r.base_id AND e.dst = r.src WHERE r.via)
        SELECT DISTINCT base_id, src, dst FROM r WHERE NOT via""",
        kept=kept.select("base_id", "src", "dst", "via"),
        e=e.select("base_id", "src", "dst", "via"),
    )
    return nodes.join(s, ["base_id", "node_id"], "left_anti"), found


def drop_edges(edges: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges but those between tracepoints in pairs (child, parent)."""
    tp = nodes.select("base_id", "node_id", "tracepoint")
    named = edges.join(tp.select("base_id", F.col("node_id").alias("src"), F.col("tracepoint").alias("parent")), ["base_id", "src"]).join(tp.select("base_id", F.col("node_id").alias("dst"), F.col("tracepoint").alias("child")), ["base_id", "dst"])
    return named.join(pairs, ["child", "parent"], "left_anti").select(*edges.columns)


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """base_id, n_components, is_connected. A node's label is its trace's smallest reachable node; each edge makes two labels one, inside a trace's row."""
    e = edges.groupBy("base_id").agg(F.collect_list(F.struct(F.col("src").alias("a"), F.col("dst").alias("b"))).alias("e"))
    n = nodes.groupBy("base_id").agg(F.array_sort(F.collect_set("node_id")).alias("ids")).join(e, "base_id", "left")
    at = lambda c: F.array_position("ids", c).cast("int") - 1
    pairs = F.transform(F.coalesce("e", F.array().cast("array<struct<a:bigint,b:bigint>>")), lambda x: F.struct(at(x["a"]).alias("a"), at(x["b"]).alias("b")))
    n = n.select("base_id", "ids", pairs.alias("e"))
    start = F.transform("ids", lambda _, i: i)
    low = lambda l, x: F.least(F.get(l, x["a"]), F.get(l, x["b"]))  # noqa: E731, E741
    high = lambda l, x: F.greatest(F.get(l, x["a"]), F.get(l, x["b"]))  # noqa: E731, E741
    labels = F.aggregate("e", start, lambda l, x: F.transform(l, lambda v: F.when(v == high(l, x), low(l, x)).otherwise(v)))  # noqa: E741
    n = n.select("base_id", F.size(F.array_distinct(labels)).cast("bigint").alias("n_components"))
    return n.withColumn("is_connected", F.col("n_components") == 1)


def key_values(nodes: DataFrame) -> DataFrame:
    """A row per key and value that nodes (with kv) carry."""
    return nodes.select("base_id", "node_id", F.explode("kv").alias("key", "value"))


def trace_stats(nodes: DataFrame) -> DataFrame:
    """n_traces, n_events."""
    return nodes.groupBy("base_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("n_traces"), F.sum("n").alias("n_events"))
