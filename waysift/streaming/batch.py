"""The streaming operators run over tables, for comparison with SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.catalogue import SESSIONS, _end
from ..sources import derived
from . import stable_in_table


def stable(spark: SparkSession, d: str) -> DataFrame:
    """Sessions polled daily: each poll sees the events up to it."""
    s = derived.sessions(derived.table(spark, d, "events")).withColumn("day", F.expr("ts_ns div 86400000000000"))
    w = s.groupBy("base_id").agg(F.min("ts_ns").alias("first"), F.max("ts_ns").alias("last"), F.min("day").alias("a"), F.max("day").alias("b"))
    polls = w.select("base_id", "first", F.explode(F.sequence("a", F.col("b") + 1)).alias("poll"))
    last = s.groupBy("base_id", "day").agg(F.max("ts_ns").alias("t"))
    j = polls.join(last, (polls["base_id"] == last["base_id"]) & (last["day"] <= polls["poll"])).groupBy(polls["base_id"], "poll", "first").agg(F.max("t").alias("t"))
    return stable_in_table(j.select("base_id", "poll", (F.col("t") - F.col("first")).alias("duration_ns")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"stable_traces": stable}

ORACLE_SQL = {
    "stable_traces": "WITH "
    + _end(SESSIONS)
    + """, b AS (SELECT base_id, min(ts_ns) AS first, min(ts_ns // 86400000000000) AS a, max(ts_ns // 86400000000000) AS z FROM ev GROUP BY 1),
p AS (SELECT base_id, first, unnest(range(a, z + 2)) AS poll FROM b),
q AS (SELECT p.base_id, poll, max(ts_ns) - any_value(first) AS duration_ns FROM p JOIN ev ON ev.base_id = p.base_id AND ev.ts_ns // 86400000000000 <= poll GROUP BY 1, 2),
r AS (SELECT *, lag(duration_ns) OVER (PARTITION BY base_id ORDER BY poll) AS was FROM q)
SELECT base_id, min(poll) AS poll, arg_min(duration_ns, poll) AS duration_ns FROM r WHERE was = duration_ns GROUP BY 1"""
}
