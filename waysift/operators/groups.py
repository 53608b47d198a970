"""Groups of paths by hash, their statistics, and which of them are problems.

Paths come as rows of base_id, hash, tracepoints, times, n_nodes, duration_ns. Statistics
are in microseconds; sums stay exact, so results don't depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exact_variance

#: Members that a group needs before it is looked at, exclusive.
FEWEST = 3


def _stats(us: str) -> list:
    d = F.col(us).cast("decimal(38,0)")
    return [F.count("*").alias("n"), F.sum(d).alias("total"), F.sum((d * d).cast("decimal(38,0)")).alias("squares")]


def _variance():
    return exact_variance(F.col("n"), F.col("total").cast("decimal(38,0)"), F.col("squares").cast("decimal(38,0)"))


def group_paths(paths: DataFrame, *columns: str) -> DataFrame:
    """hash, n_traces, path_len, mean_us, variance_us2 (population), any of columns (the same in a group), cv. One aggregation, combined before the shuffle."""
    g = paths.withColumn("us", F.expr("duration_ns div 1000")).groupBy("hash").agg(*_stats("us"), F.min("n_nodes").alias("path_len"), *(F.any_value(c).alias(c) for c in columns))
    g = g.select("hash", F.col("n").alias("n_traces"), "path_len", (F.col("total").cast("double") / F.col("n")).alias("mean_us"), _variance().alias("variance_us2"), *columns)
    return g.withColumn("cv", F.when(F.col("mean_us") != 0, F.sqrt("variance_us2") / F.col("mean_us")))


def problem_groups(groups: DataFrame) -> DataFrame:
    return groups.filter((F.col("variance_us2") != 0) & (F.col("n_traces") > FEWEST))


def problem_groups_cv(groups: DataFrame, least: float = 0.05, used: DataFrame | None = None) -> DataFrame:
    """Problem groups with cv over least, but those in used (hash)."""
    found = problem_groups(groups).filter(F.col("cv") > least)
    return found if used is None else found.join(used, "hash", "left_anti")


def problem_groups_slow(groups: DataFrame, percentile: float = 0.95) -> DataFrame:
    """Groups whose mean is over that percentile of all groups' means."""
    return groups.sparkSession.sql(f"SELECT * FROM {{g}} WHERE n_traces > {FEWEST} AND mean_us > (SELECT percentile_disc({percentile}) WITHIN GROUP (ORDER BY mean_us) FROM {{g}})", g=groups)


def zero_variance(groups: DataFrame) -> DataFrame:
    return groups.agg(F.count("*").alias("n_groups"), F.count_if(F.col("variance_us2") == 0).alias("n_zero"))


def edge_times(paths: DataFrame) -> DataFrame:
    """hash, pos (of the edge's target, from 1), source, target, us of every path's edges."""
    pair = F.transform(F.sequence(F.lit(1), F.size("times") - 1), lambda i: F.struct(i.alias("pos"), F.get("tracepoints", i - 1).alias("source"), F.get("tracepoints", i).alias("target"), (F.get("times", i) - F.get("times", i - 1)).alias("ns")))
    e = paths.filter("n_nodes > 1").select("hash", F.explode(pair).alias("e"))
    return e.select("hash", "e.pos", "e.source", "e.target", F.expr("e.ns div 1000").alias("us"))


def group_edges(paths: DataFrame) -> DataFrame:
    """hash, pos, source, target, n, min_us, max_us, variance_us2, variance_s2."""
    g = edge_times(paths).groupBy("hash", "pos", "source", "target").agg(*_stats("us"), F.min("us").alias("min_us"), F.max("us").alias("max_us"))
    g = g.withColumn("variance_us2", _variance())
    return g.select("hash", "pos", "source", "target", "n", "min_us", "max_us", "variance_us2", (F.col("variance_us2") / F.lit(1e12)).alias("variance_s2"))


def problem_edges(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges of the groups, numbered within each by falling variance."""
    from pyspark.sql import Window

    w = Window.partitionBy("hash").orderBy(F.desc("variance_us2"), "pos")
    return edges.join(groups.select("hash"), "hash", "left_semi").withColumn("rank", F.row_number().over(w))


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """Sums of two batches of group sums (hash, n, total, squares), for groups that are kept up to date."""
    return old.unionByName(new).groupBy("hash").agg(*(F.sum(c).alias(c) for c in ("n", "total", "squares")))


def sums(paths: DataFrame) -> DataFrame:
    """hash, n, total, squares of a batch of paths, for merge()."""
    return paths.withColumn("us", F.expr("duration_ns div 1000")).groupBy("hash").agg(*_stats("us"))


def edge_sums(paths: DataFrame) -> DataFrame:
    """hash, pos, n, total, squares of a batch of paths' edges."""
    return edge_times(paths).groupBy("hash", "pos").agg(*_stats("us"))


def of_sums(sums: DataFrame, *by: str) -> DataFrame:
    """by, n_traces, mean_us, variance_us2 of the sums of several batches."""
    s = sums.groupBy(*by).agg(*(F.sum(c).cast("decimal(38,0)").alias(c) for c in ("n", "total", "squares"))).withColumn("n", F.col("n").cast("bigint"))
    return s.select(*by, F.col("n").alias("n_traces"), (F.col("total").cast("double") / F.col("n")).alias("mean_us"), _variance().alias("variance_us2"))


def top(groups: DataFrame, by: str, n: int = 6) -> DataFrame:
    """A report's first rows."""
    return groups.orderBy(F.desc(by), "hash").limit(n)


def report(paths: DataFrame) -> DataFrame:
    """A row per group: path_len, n_traces, variance_us2 and its traces' ids, joined by blanks."""
    ids = paths.groupBy("hash").agg(F.array_join(F.sort_array(F.collect_list("base_id")), " ").alias("trace_ids"))
    return group_paths(paths).join(ids, "hash").select("hash", "path_len", "n_traces", "variance_us2", "trace_ids")


def tracepoints(paths: DataFrame, *by: str) -> DataFrame:
    """Distinct tracepoints, by columns."""
    return paths.select(*by, F.explode("tracepoints").alias("tracepoint")).distinct()


def batch_counters(paths: DataFrame) -> DataFrame:
    """n_traces, n_nodes of a batch."""
    return paths.agg(F.count("*").alias("n_traces"), F.coalesce(F.sum("n_nodes"), F.lit(0)).alias("n_nodes"))
