"""Critical paths: extraction, completion, cleaning and navigation."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import path_hash


def critical_paths(nodes: DataFrame, edges: DataFrame, ends: DataFrame) -> DataFrame:
    """base_id, node_ids (from start to end), n_nodes, duration_ns, is_whole: from a trace's end, always the predecessor of latest time (of equals the edge put in first), until its start.

    nodes: base_id, node_id, ts_ns; edges: base_id, src, dst, edge_seq; ends: base_id,
    start_node, end_node. One aggregation keeps a node's critical predecessor; the walk
    then runs inside a trace's row. is_whole is false where the walk ends elsewhere
    than at the start.
    """
    t = nodes.select("base_id", F.col("node_id").alias("src"), F.col("ts_ns").alias("src_ts"))
    best = edges.join(t, ["base_id", "src"]).groupBy("base_id", "dst").agg(F.max_by("src", F.struct("src_ts", -F.col("edge_seq"))).alias("src"))
    maps = best.groupBy("base_id").agg(F.map_from_entries(F.collect_list(F.struct("dst", "src"))).alias("before"))
    walk = F.aggregate(
        F.sequence(F.lit(1), F.size("before")),
        F.array("end_node"),
        lambda path, _: F.when((F.element_at(path, 1) != F.col("start_node")) & F.map_contains_key("before", F.element_at(path, 1)), F.concat(F.array(F.element_at("before", F.element_at(path, 1))), path)).otherwise(path),
    )
    found = ends.join(maps, "base_id", "left").withColumn("before", F.coalesce("before", F.create_map().cast("map<bigint,bigint>"))).withColumn("node_ids", F.when(F.size("before") > 0, walk).otherwise(F.array("end_node")))
    times = nodes.groupBy("base_id").agg(F.map_from_entries(F.collect_list(F.struct("node_id", "ts_ns"))).alias("ts"))
    found = found.join(times, "base_id")
    return found.select("base_id", "node_ids", F.size("node_ids").alias("n_nodes"), (F.element_at("ts", F.element_at("node_ids", -1)) - F.element_at("ts", F.element_at("node_ids", 1))).alias("duration_ns"), (F.element_at("node_ids", 1) == F.col("start_node")).alias("is_whole"))


def path_steps(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """A row per node of a path, with the node's columns: base_id, pos (from 0), node_id, ..., edge_ns (from the node before)."""
    steps = paths.select("base_id", F.posexplode("node_ids").alias("pos", "node_id")).join(nodes, ["base_id", "node_id"])
    w = Window.partitionBy("base_id").orderBy("pos")
    return steps.withColumn("edge_ns", F.col("ts_ns") - F.lag("ts_ns").over(w))


def hashed(steps: DataFrame) -> DataFrame:
    """base_id, tracepoints, hash of path_steps()."""
    tp = F.transform(F.sort_array(F.collect_list(F.struct("pos", "tracepoint"))), lambda x: x["tracepoint"])
    return steps.groupBy("base_id").agg(tp.alias("tracepoints")).withColumn("hash", path_hash(F.col("tracepoints")))


def complete_spans(steps: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """Steps without repeated ends of spans, and the paths that can't be cleaned.

    steps: keys (base_id unless given), pos, span_id, variant, ... While a span is open
    further entries of it go; of exits without an entry between them the last stays; an
    entry without exit stays; an exit whose span has no entry before puts the path among
    the second result (keys, reason).
    """
    by = list(keys) or ["base_id"]
    w = Window.partitionBy(*by, "span_id").orderBy("pos")
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    end = F.when(F.col("variant").isin("Entry", "Exit"), F.col("variant"))
    marked = steps.withColumn("was", F.last(end, True).over(before)).withColumn("comes", F.first(end, True).over(after))
    bad = marked.filter("variant = 'Exit' and was is null").select(*by, F.lit("exit without entry").alias("reason")).distinct()
    keep = marked.filter("not (variant = 'Entry' and coalesce(was, '') = 'Entry') and not (variant = 'Exit' and coalesce(comes, '') = 'Exit')").drop("was", "comes")
    return keep.join(bad, by, "left_anti"), bad


class Branches:
    """A trace's graph, as far as synthetic ends of spans need it."""

    def __init__(self, span: dict[int, str], edges: Iterable[tuple[int, int]]) -> None:
        self.span = span
        self.after: dict[int, list[int]] = {}
        self.before: dict[int, list[int]] = {}
        for s, d in edges:
            self.after.setdefault(s, []).append(d)
            self.before.setdefault(d, []).append(s)
        self.met: dict[tuple[int, bool], set] = {}

    def spans_from(self, node: int, back: bool) -> set:
        """The spans of a node and of all that it reaches, forwards or back."""
        if (node, back) not in self.met:
            seen, todo = {node}, [node]
            while todo:
                new = [m for m in (self.before if back else self.after).get(todo.pop(), []) if m not in seen]
                seen.update(new)
                todo += new
            self.met[node, back] = {self.span.get(m) for m in seen}
        return self.met[node, back]


def synthesize(rows: list[dict], graph: Branches) -> list[dict] | None:
    """A path with synthetic ends of spans that leave it or come to it; null where such an end has no place.

    Where an untaken branch leaves the path, spans that are open, don't come again on the
    rest of the path and do come on that branch get an exit, the innermost first, each one
    nanosecond after the node before. An exit of a span that is not open gets an entry:
    back along the path, at the first node to which an untaken branch with that span
    leads, one nanosecond after that node's predecessor on the path. The next node keeps
    its edge's length. rows: the path's nodes in order.
    """
    ids = [r["node_id"] for r in rows]
    later, rest = [], {}
    for r in reversed(rows):
        later.append(dict(rest))
        rest[r["span_id"]] = True
    later.reverse()
    follow: dict[int, list[dict]] = {}  # synthetic rows after the path's k-th
    open_: list[dict] = []

    def end(of: dict, variant: str) -> dict:
        return of | {"node_id": -1, "variant": variant, "is_synthetic": True, "edge_ns": 1}

    for k, row in enumerate(rows):
        if row["variant"] == "Entry":
            open_.append(row)
        elif row["variant"] == "Exit":
            own = [o for o in open_ if o["span_id"] == row["span_id"]]
            if own:
                open_ = [o for o in open_ if o is not own[-1]]
            else:
                at = next((j for j in range(k, 0, -1) if any(row["span_id"] in graph.spans_from(b, True) for b in graph.before.get(ids[j], []) if b != ids[j - 1])), 0)
                if not at:
                    return None
                follow.setdefault(at - 1, []).insert(0, end(row, "Entry"))
        if k + 1 < len(rows):
            others = [b for b in graph.after.get(ids[k], []) if b != ids[k + 1]]
            if others:
                done: set = set()
                for o in reversed(open_):
                    if o["span_id"] not in later[k] and o["span_id"] not in done and any(o["span_id"] in graph.spans_from(b, False) for b in others):
                        done.add(o["span_id"])
                        follow.setdefault(k, []).append(end(o, "Exit"))
    made = []
    for k, row in enumerate(rows):
        made.append(row)
        made += [x | {"ts_ns": row["ts_ns"] + 1 + i} for i, x in enumerate(follow.get(k, []))]
    return [x | {"pos": i} for i, x in enumerate(made)]


def with_synthetic(steps: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """synthesize() for every path of every trace; paths in which an end has no place are left out. steps: base_id, path, pos, node_id, span_id, tracepoint, variant, ts_ns, is_synthetic, edge_ns. The three inputs meet by trace; order within a trace rules this out as an expression. Traces in which nothing branches are passed by."""
    cols = ["pos", "node_id", "span_id", "tracepoint", "variant", "ts_ns", "is_synthetic", "edge_ns"]
    step = "struct<pos:int,node_id:bigint,span_id:string,tracepoint:string,variant:string,ts_ns:bigint,is_synthetic:boolean,edge_ns:bigint>"
    text = lambda df, *names: df.select(*[F.col(c).cast("string").alias(c) if c in ("base_id", "span_id") else F.col(c) for c in names])
    own, e = text(steps, "base_id", "path", *cols), text(edges, "base_id", "src", "dst")
    branching = e.groupBy("base_id", "src").count().filter("count > 1").select("base_id").unionByName(e.groupBy("base_id", "dst").count().filter("count > 1").select("base_id")).distinct()
    paths = own.join(branching, "base_id", "left_semi").groupBy("base_id", "path").agg(F.sort_array(F.collect_list(F.struct(*cols))).cast(f"array<{step}>").alias("steps"))
    lists = paths.groupBy("base_id").agg(F.collect_list(F.struct("path", "steps")).alias("paths"))
    spans = text(nodes, "base_id", "node_id", "span_id").groupBy("base_id").agg(F.collect_list(F.struct("node_id", "span_id")).alias("nodes"))
    links = e.groupBy("base_id").agg(F.collect_list(F.struct("src", "dst")).alias("edges"))

    def run(batches: Iterable) -> Iterator:
        kind = pa.list_(pa.struct([("pos", pa.int32()), ("node_id", pa.int64()), ("span_id", pa.string()), ("tracepoint", pa.string()), ("variant", pa.string()), ("ts_ns", pa.int64()), ("is_synthetic", pa.bool_()), ("edge_ns", pa.int64())]))
        for b in batches:
            out: list[tuple] = []
            for r in b.to_pylist():
                graph = Branches({n["node_id"]: n["span_id"] for n in r["nodes"]}, [(x["src"], x["dst"]) for x in r["edges"]])
                made = [(r["base_id"], p["path"], synthesize(p["steps"], graph)) for p in r["paths"]]
                out += [x for x in made if x[2] is not None]
            ids, numbers, rows = zip(*out, strict=True) if out else ((), (), ())
            yield pa.record_batch([pa.array(ids, pa.string()), pa.array(numbers, pa.int64()), pa.array(rows, kind)], names=["base_id", "path", "steps"])

    changed = lists.join(spans, "base_id").join(links, "base_id").mapInArrow(run, f"base_id string, path bigint, steps array<{step}>")
    return own.join(branching, "base_id", "left_anti").unionByName(changed.select("base_id", "path", F.inline("steps")))


def whole_paths(steps: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Steps (as with_synthetic() takes them) after synthesis and cleaning, with positions and edges anew where nodes went."""
    made = with_synthetic(steps, nodes, edges)
    keep = complete_spans(made, "base_id", "path")[0]
    w = Window.partitionBy("base_id", "path").orderBy("pos")
    keep = keep.withColumn("n", F.row_number().over(w) - 1).withColumn("edge_ns", F.when(F.col("pos") - F.lag("pos").over(w) == 1, F.col("edge_ns")).otherwise(F.col("ts_ns") - F.lag("ts_ns").over(w)))
    return keep.withColumn("pos", F.col("n")).drop("n")


def real_steps(steps: DataFrame) -> DataFrame:
    """Steps that were observed."""
    return steps.filter("not coalesce(is_synthetic, false)")


def neighbours(steps: DataFrame) -> DataFrame:
    """Each step with the tracepoints before and after it on its path."""
    w = Window.partitionBy("base_id").orderBy("pos")
    return steps.select("base_id", "pos", "tracepoint", F.lag("tracepoint").over(w).alias("previous"), F.lead("tracepoint").over(w).alias("next"))
