"""Tracepoint state, budget, overhead and bookkeeping of the decision loop."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Limits and periods of the loop.
TRACE_SIZE_LIMIT = 100_000_000
TRACEPOINTS_PER_EPOCH = 3
JIFFY_S, DECISION_S, KEEP_S = 20, 120, 360


def apply_changes(state: DataFrame, changes: DataFrame) -> DataFrame:
    """State rows (tracepoint, request_type; null type: all types) after changes (seq, tracepoint, request_type, enable): the last change of each wins."""
    norm = lambda c: F.when(F.col(c) == "Unknown", None).otherwise(F.col(c))
    all_ = state.select(F.lit(-1).cast("bigint").alias("seq"), "tracepoint", norm("request_type").alias("request_type"), F.lit(True).alias("enable")).unionByName(changes.select(F.col("seq").cast("bigint").alias("seq"), "tracepoint", norm("request_type").alias("request_type"), "enable"))
    return all_.groupBy("tracepoint", "request_type").agg(F.max_by("enable", "seq").alias("enable")).filter("enable").select("tracepoint", "request_type")


def read_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a folder of JSON files; none where there is no folder yet."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """The stored state; none where nothing was stored."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "tracepoint string, request_type string")


def write_state(spark: SparkSession, state: DataFrame, path: str) -> DataFrame:
    """Stores a state that may come from the one stored before. The enabled tracepoints are names that a controller holds in memory, so the driver holds them too."""
    out = spark.createDataFrame(state.collect(), "tracepoint string, request_type string")
    out.write.mode("overwrite").parquet(path)
    return out


def is_enabled(asked: DataFrame, state: DataFrame) -> DataFrame:
    """asked (tracepoint, request_type) with enabled: for its type or for all."""
    s = state.select("tracepoint", F.col("request_type").alias("for_type"))
    hit = asked.join(s, "tracepoint").filter("for_type is null or for_type = request_type").select("tracepoint", "request_type").distinct().withColumn("enabled", F.lit(True))
    return asked.join(hit, ["tracepoint", "request_type"], "left").withColumn("enabled", F.coalesce("enabled", F.lit(False)))


def not_disabled(all_points: DataFrame, disabled: DataFrame) -> DataFrame:
    """The complement, for controllers that keep what is disabled; request types don't matter to them."""
    return all_points.select("tracepoint").distinct().join(disabled.select("tracepoint"), "tracepoint", "left_anti")


def control_file(disabled: DataFrame, path: str) -> None:
    """The disabled tracepoints in order, one a line, as one file: a list of names that the operator of a controller keeps short."""
    disabled.select("tracepoint").distinct().orderBy("tracepoint").coalesce(1).write.mode("overwrite").text(path)


def latest(stats: DataFrame, key: str = "node", at: str = "hour_us") -> DataFrame:
    """Each agent's last reading."""
    return stats.groupBy(key).agg(F.max_by(F.struct(*[c for c in stats.columns if c != key]), at).alias("s")).select(key, "s.*")


def overrun(stats: DataFrame, limit: int = TRACE_SIZE_LIMIT) -> DataFrame:
    """trace_size over all agents' last readings, and whether it is over the limit."""
    return latest(stats).agg(F.coalesce(F.sum("trace_size"), F.lit(0)).alias("trace_size")).withColumn("over", F.col("trace_size") > limit)


def rates(counters: DataFrame, value: str = "received", key: str = "node", at: str = "hour_us") -> DataFrame:
    """key, at, rate a second since the reading before; 0 at the first, null if no time has passed."""
    w = Window.partitionBy(key).orderBy(at)
    elapsed = (F.col(at) - F.lag(at).over(w)) / 1_000_000
    delta = F.col(value) - F.lag(value).over(w)
    return counters.select(key, at, F.when(F.lag(at).over(w).isNull(), F.lit(0.0)).when(elapsed > 0, delta / elapsed).alias("rate"))


def last_seen(steps: DataFrame) -> DataFrame:
    """tracepoint, request_type, seen_ns: latest time of each on a path; a path's last node doesn't count. steps: tracepoints, times, request_type."""
    n = F.size("tracepoints") - 1
    return steps.filter("size(tracepoints) > 1").select("request_type", F.explode(F.arrays_zip(F.slice("tracepoints", 1, n).alias("t"), F.slice("times", 1, n).alias("s"))).alias("x")).groupBy(F.col("x.t").alias("tracepoint"), "request_type").agg(F.max("x.s").alias("seen_ns"))


def old_tracepoints(seen: DataFrame, now_ns: int, keep_s: int = KEEP_S) -> DataFrame:
    return seen.filter(F.lit(now_ns) - F.col("seen_ns") > keep_s * 10**9)


def jiffies(paths: DataFrame, seconds: int = JIFFY_S) -> DataFrame:
    """jiffy (number since 1970), n_traces, n_nodes by the time at which traces end."""
    j = F.expr(f"element_at(times, -1) div {seconds * 10**9}")
    return paths.groupBy(j.alias("jiffy")).agg(F.count("*").alias("n_traces"), F.sum("n_nodes").alias("n_nodes"))


def greedy_budget(candidates: DataFrame, budget: int = TRACEPOINTS_PER_EPOCH) -> DataFrame:
    """The first budget of candidates (priority, tracepoint), each tracepoint at its best priority, with the budget left after each. A top-n, then a window over those few."""
    best = candidates.groupBy("tracepoint").agg(F.min("priority").alias("priority")).orderBy("priority", "tracepoint").limit(budget)
    return best.withColumn("left", budget - F.row_number().over(Window.orderBy("priority", "tracepoint")))
