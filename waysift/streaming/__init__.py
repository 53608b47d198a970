"""The decision loop on Structured Streaming: stable traces, running groups, decisions and the run log."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import control, groups

#: Fixed value: failed readings after which a trace is given up.
ERRORS = 5


def stable_traces(polls: DataFrame) -> DataFrame:
    """base_id, poll, duration_ns of traces at the first poll that finds the same duration as the one before.

    polls: a stream of base_id, poll, duration_ns (null: the reading failed).
    A trace is given out once; after more than ERRORS failures it is given up. State is
    two numbers for each trace.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, errors, done = state.get if state.exists else (None, 0, False)
        out = []
        for row in sorted((r for b in batches for r in b.itertuples(index=False)), key=lambda r: r.poll):
            if done:
                break
            if pd.isna(row.duration_ns):
                errors += 1
                done = errors > ERRORS
                continue
            if last is not None and last == int(row.duration_ns):
                out.append((key[0], int(row.poll), last))
                done = True
            last = int(row.duration_ns)
        state.update((last, errors, done))
        yield pd.DataFrame(out, columns=["base_id", "poll", "duration_ns"])

    return polls.groupBy("base_id").applyInPandasWithState(step, "base_id string, poll bigint, duration_ns bigint", "last bigint, errors int, done boolean", "append", GroupStateTimeout.NoTimeout)


def stable_in_table(polls: DataFrame) -> DataFrame:
    """stable_traces() of a table, by windows."""
    w = Window.partitionBy("base_id").orderBy("poll")
    p = polls.withColumn("errors", F.sum(F.when(F.col("duration_ns").isNull(), 1).otherwise(0)).over(w)).filter(f"duration_ns is not null and errors <= {ERRORS}")
    p = p.withColumn("was", F.lag("duration_ns").over(w)).filter("was = duration_ns")
    return p.groupBy("base_id").agg(F.min("poll").alias("poll"), F.min_by("duration_ns", "poll").alias("duration_ns"))


def new_traces(recent: DataFrame, time_col: str = "seen", delay: str = "10 minutes") -> DataFrame:
    """Trace ids that were not announced before, as far back as the watermark reaches."""
    return recent.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["base_id"])


def complete_sessions(events: DataFrame, time_col: str, gap: str, delay: str) -> DataFrame:
    """A simpler completion: a trace ends when nothing came for gap; later events than delay are dropped. base_id, tracepoints, times, n_nodes, duration_ns, hash."""
    from ..functions import path_hash

    s = events.withWatermark(time_col, delay).groupBy("base_id", F.session_window(time_col, gap).alias("w")).agg(F.sort_array(F.collect_list(F.struct("ts_ns", "tracepoint"))).alias("p"))
    s = s.select("base_id", F.transform("p", lambda x: x["tracepoint"]).alias("tracepoints"), F.transform("p", lambda x: x["ts_ns"]).alias("times"))
    return s.select("*", F.size("tracepoints").alias("n_nodes"), (F.element_at("times", -1) - F.element_at("times", 1)).alias("duration_ns"), path_hash(F.col("tracepoints")).alias("hash"))


class Loop:
    """Micro-batches of paths into running group sums, a run log and, once an epoch, decisions.

    sums and log are folders in shared storage. Sums of each batch are appended under its
    number, so that a batch that is run again writes what it wrote before; the groups are
    the sums over all of them. decide gets the groups and returns tracepoints to enable.
    """

    def __init__(self, folder: str, decide: Callable[[DataFrame], DataFrame] | None = None, epoch_s: int = control.DECISION_S, budget: int = control.TRACEPOINTS_PER_EPOCH, clock: Callable[[], float] | None = None) -> None:
        import time

        self.folder, self.decide, self.epoch_s, self.budget = folder.rstrip("/"), decide, epoch_s, budget
        self.clock = clock or time.time
        self.last = self.clock()

    def groups(self, spark) -> DataFrame:
        """hash, n_traces, mean_us, variance_us2 over all batches so far."""
        return groups.of_sums(spark.read.parquet(f"{self.folder}/sums"), "hash")

    def batch(self, paths: DataFrame, number: int) -> None:
        spark = paths.sparkSession
        groups.sums(paths).withColumn("squares", F.col("squares").cast("decimal(38,0)")).write.mode("overwrite").parquet(f"{self.folder}/sums/batch={number}")
        groups.batch_counters(paths).write.mode("overwrite").json(f"{self.folder}/log/batch={number}")
        if self.decide is not None and self.clock() - self.last > self.epoch_s:
            self.last = self.clock()
            self.decide(self.groups(spark)).limit(self.budget).write.mode("overwrite").json(f"{self.folder}/decisions/batch={number}")

    def start(self, paths: DataFrame, checkpoint: str, jiffy_s: int = control.JIFFY_S, available_now: bool = False) -> StreamingQuery:
        trigger = {"availableNow": True} if available_now else {"processingTime": f"{jiffy_s} seconds"}
        return paths.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def should_stop(targets: set[str], chosen: set[str], batches_since: int, after: int = 20) -> bool:
    """Whether all targets are chosen and that many batches have passed since."""
    return targets <= chosen and batches_since >= after
