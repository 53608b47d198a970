"""Graphs and groups as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dot(nodes: DataFrame, edges: DataFrame, hierarchy: DataFrame | None = None) -> DataFrame:
    """base_id, dot: each trace as a DOT graph. hierarchy: further edges (base_id, src, dst) that are drawn dashed."""
    n = nodes.select("base_id", F.lit(0).alias("k"), F.col("node_id").alias("a"), F.lit(0).cast("bigint").alias("b"), F.concat(F.lit("    "), F.col("node_id"), F.lit(' [ label = "'), F.regexp_replace(F.coalesce("tracepoint", F.lit("")), r'(["\\])', r"\\$1"), F.lit('" ]')).alias("line"))
    e = edges.select("base_id", F.lit(1).alias("k"), F.col("src").alias("a"), F.col("dst").alias("b"), F.concat(F.lit("    "), F.col("src"), F.lit(" -> "), F.col("dst"), F.lit(' [ label = "'), F.coalesce(F.col("duration_ns").cast("string"), F.lit("")), F.lit('" ]')).alias("line"))
    lines = n.unionByName(e)
    if hierarchy is not None:
        lines = lines.unionByName(hierarchy.select("base_id", F.lit(2).alias("k"), F.col("src").alias("a"), F.col("dst").alias("b"), F.concat(F.lit("    "), F.col("src"), F.lit(" -> "), F.col("dst"), F.lit(" [ style = dashed ]")).alias("line")))
    body = lines.groupBy("base_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "a", "b", "line"))), lambda x: x["line"]), "\n").alias("body"))
    return body.select("base_id", F.concat(F.lit("digraph {\n"), "body", F.lit("\n}\n")).alias("dot"))


def event_lines(nodes: DataFrame) -> DataFrame:
    """base_id, node_id, line."""
    return nodes.select("base_id", "node_id", F.format_string("%s %s: %d", "tracepoint", "variant", "ts_ns").alias("line"))


def group_lines(groups: DataFrame) -> DataFrame:
    """hash, line: as groups are listed, those with most variance first when ordered by it."""
    return groups.select("hash", "variance_us2", F.format_string("group %s: %d traces, mean %.1f us, variance %.1f us2, cv %.4f", "hash", "n_traces", "mean_us", "variance_us2", F.coalesce("cv", F.lit(0.0))).alias("line"))
