"""The controller: polls become stable traces, groups, problem edges, decisions, enabled tracepoints and a log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..operators import control, groups
from ..operators.search import SearchStrategy
from ..settings import Settings
from . import should_stop

#: Fixed value: coefficient of variation that makes a group a problem.
CV = 0.05
DECISION = "group_hash string, edge_pos int, tracepoint string, request_type string"
DECISIONS = DECISION + ", batch int"


def decide(problems: DataFrame, edges: DataFrame, strategy: SearchStrategy, enabled: DataFrame, budget: int) -> list[Row]:
    """group_hash, edge_pos, tracepoint, request_type of what to enable, budget at most.

    problems: hash, request_type, tracepoints, spans, variants, variance_us2; edges:
    hash, pos, variance_us2. Groups come by falling variance, their edges too. The first
    edge for which the strategy finds something gets the budget; what it leaves goes to
    the edges after it. Each round is one search over all edges that are left, and there
    are as many rounds as the budget has units.
    """
    spark = problems.sparkSession
    typed = problems.select("hash", "request_type", F.col("variance_us2").cast("double").alias("of_group"))
    order = F.struct((-F.col("of_group")).alias("g"), F.col("hash").alias("h"), (-F.col("variance_us2").cast("double")).alias("e"), F.col("pos").cast("int").alias("p"))
    left = edges.join(typed, "hash").select(F.col("hash").alias("group_hash"), F.col("pos").alias("edge_pos"), "request_type", order.alias("order"))
    out: list[Row] = []
    while len(out) < budget:
        n = budget - len(out)
        now = enabled.unionByName(spark.createDataFrame(out, DECISION).select("tracepoint", "request_type"))
        found = strategy.search(problems, left.select("group_hash", "edge_pos"), n, now).join(left, ["group_hash", "edge_pos"])
        rows = found.orderBy("order", "rank").limit(n).collect()
        if not rows:
            break
        first = rows[0]["order"]
        out += [Row(group_hash=r["group_hash"], edge_pos=int(r["edge_pos"]), tracepoint=r["tracepoint"], request_type=r["request_type"]) for r in rows if r["order"] == first]
        left = left.filter(F.col("order") > F.struct(F.lit(first.g).alias("g"), F.lit(first.h).alias("h"), F.lit(first.e).alias("e"), F.lit(first.p).cast("int").alias("p")))
    return out


class Controller:
    """Steps of the decision loop. What it remembers lies in folder, under the number of the step that wrote it, so a step that is run again writes the same.

    A step takes paths (base_id, hash, request_type, tracepoints, times, spans, variants,
    n_nodes, duration_ns). Where decision_s have passed since the last decision, and the
    agents' traces are within their limit, problem groups are searched and what is found
    is enabled; a group that led to a decision is used and no longer a problem.
    stopped is set should_stop()'s number of steps after all targets were enabled.
    """

    def __init__(self, settings: Settings, folder: str, strategy: SearchStrategy, manifest: DataFrame, targets: set[str], clock: Callable[[], float], stats: Callable[[], DataFrame] | None = None) -> None:
        self.settings, self.folder, self.strategy, self.manifest, self.targets, self.clock, self.stats = settings, folder.rstrip("/"), strategy, manifest, targets, clock, stats
        self.last, self.chosen, self.since, self.stopped = clock(), set(), 0, False

    def _at(self, name: str, number: int) -> str:
        return f"{self.folder}/{name}/batch={number}"

    def resume(self, spark) -> int:
        """The number of the step after the last that folder knows; targets that were chosen before count."""
        done = control.read_rows(spark, f"{self.folder}/log", "step int").agg(F.max("step").alias("n")).first().n
        found = control.read_rows(spark, f"{self.folder}/decisions", DECISIONS).filter(F.col("tracepoint").isin(*self.targets))
        self.chosen = {r.tracepoint for r in found.select("tracepoint").distinct().collect()} if self.targets else set()
        return 0 if done is None else done + 1

    def poll(self, paths: DataFrame, number: int) -> None:
        """A step with those of the paths at hand whose duration is what it was one poll before. Only paths at hand are remembered."""
        spark = paths.sparkSession
        now = paths.select("base_id", "duration_ns")
        was = spark.read.parquet(self._at("polls", number - 1)) if number else spark.createDataFrame([], "base_id string, duration_ns bigint, done boolean")
        known = now.join(was.select("base_id", F.col("duration_ns").alias("was"), F.col("done").alias("before")), "base_id", "left")
        known = known.select("base_id", "duration_ns", F.coalesce(F.col("was") == F.col("duration_ns"), F.lit(False)).alias("same"), F.coalesce("before", F.lit(False)).alias("before"))
        known.withColumn("done", F.col("before") | F.col("same")).write.mode("overwrite").parquet(self._at("polls", number))
        fresh = spark.read.parquet(self._at("polls", number)).filter("same and not before").select("base_id")
        self.batch(paths.join(fresh, "base_id", "left_semi"), number)

    def batch(self, paths: DataFrame, number: int) -> None:
        spark, s = paths.sparkSession, self.settings
        paths = paths.persist()
        for name, df in (("sums", groups.sums(paths)), ("edge_sums", groups.edge_sums(paths))):
            df.withColumn("squares", F.col("squares").cast("decimal(38,0)")).write.mode("overwrite").parquet(self._at(name, number))
        shape = F.min_by(F.struct("request_type", "tracepoints", "spans", "variants"), "base_id").alias("s")
        paths.groupBy("hash").agg(shape).select("hash", "s.*").write.mode("overwrite").parquet(self._at("shapes", number))
        size = control.overrun(self.stats(), s.trace_size_limit).first() if self.stats else Row(trace_size=0, over=False)
        counts = groups.batch_counters(paths).first()
        paths.unpersist()
        made: list[Row] = []
        if not size.over and self.clock() - self.last > s.decision_s:
            made = self._decision(spark, number)
            self.last = self.clock()
        log = [(number, counts.n_traces, counts.n_nodes, int(size.trace_size), bool(size.over), [r.tracepoint for r in made])]
        spark.createDataFrame(log, "step int, n_traces bigint, n_nodes bigint, trace_size bigint, over boolean, enabled array<string>").write.mode("overwrite").json(self._at("log", number))
        if self.targets:
            self.since = self.since + 1 if self.targets <= self.chosen else 0
            self.stopped = should_stop(self.targets, self.chosen, self.since)

    def _decision(self, spark, number: int) -> list[Row]:
        s = self.settings
        read = lambda name: spark.read.parquet(f"{self.folder}/{name}").filter(F.col("batch") <= number)
        every = groups.of_sums(read("sums"), "hash").withColumn("cv", F.when(F.col("mean_us") != 0, F.sqrt("variance_us2") / F.col("mean_us")))
        decisions = control.read_rows(spark, f"{self.folder}/decisions", DECISIONS)
        used = decisions.filter(F.col("batch") < number).select(F.col("group_hash").alias("hash")).distinct()
        shapes = read("shapes").groupBy("hash").agg(F.min_by(F.struct("request_type", "tracepoints", "spans", "variants"), "batch").alias("s")).select("hash", "s.*")
        problems = groups.problem_groups_cv(every, CV, used).join(shapes, "hash").persist()
        edges = groups.of_sums(read("edge_sums"), "hash", "pos").join(problems.select("hash"), "hash", "left_semi").persist()
        state = control.read_state(spark, s.state_path)
        own = decisions.filter(F.col("batch") == number).select("tracepoint", "request_type")  # of a run before of this step
        made = decide(problems, edges, self.strategy, state.join(own, ["tracepoint", "request_type"], "left_anti"), s.tracepoints_per_epoch)
        problems.unpersist()
        edges.unpersist()
        rows = spark.createDataFrame(made, DECISION)
        rows.write.mode("overwrite").json(self._at("decisions", number))
        changes = rows.select(F.lit(0).cast("bigint").alias("seq"), "tracepoint", "request_type", F.lit(True).alias("enable"))
        new = control.write_state(spark, control.apply_changes(state, changes), s.state_path)
        if s.control_file:
            control.control_file(control.not_disabled(self.manifest.select(F.explode("tracepoints").alias("tracepoint")), new), s.control_file)
        self.chosen |= {r.tracepoint for r in made}
        return made
