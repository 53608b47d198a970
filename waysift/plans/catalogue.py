"""Queries over the driver tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import control, critical, dag, groups, manifest, search
from ..sources import derived

#: Request types of the event tables, matched in this order.
EVENT_TYPES = (("^sign", "Signup"), ("^pur", "Purchase"), ("^view", "View"))

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = "WITH RECURSIVE " + sql
        return f

    return add


# Shared SQL. Commas end each part, so that parts can be put together.
SESSIONS = """
s0 AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS us,
  CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 86400000000 THEN 1 ELSE 0 END AS nw FROM events),
s1 AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS sess FROM s0),
ev AS (SELECT user_id || '-' || sess AS base_id, user_id, event_id, row_number() OVER (PARTITION BY user_id, sess ORDER BY us, event_id) AS pos, event_type AS tracepoint, us * 1000 AS ts_ns FROM s1),
"""
PATHS = SESSIONS + """
paths AS (SELECT base_id, string_agg(tracepoint, chr(31) ORDER BY pos) AS seq, string_agg(substr(tracepoint, 1, 1), '' ORDER BY pos) AS letters, count(*) AS n_nodes, max(ts_ns) - min(ts_ns) AS duration_ns, (max(ts_ns) - min(ts_ns)) // 1000 AS us, max(ts_ns) AS end_ns FROM ev GROUP BY base_id),
"""


def variance_sql(n: str, total: str, squares: str) -> str:
    """As functions.exact_variance()."""
    q = f"({total} // {n})"
    centred = f"({squares} - 2 * {q} * {total} + {q} * {q} * {n})"
    whole = f"((({centred} // 1000000000000000000000000)::DOUBLE * 1e12 + (({centred} // 1000000000000) % 1000000000000)::DOUBLE) * 1e12 + ({centred} % 1000000000000)::DOUBLE)"
    return f"(({whole} - ({total} - {q} * {n})::DOUBLE * ({total} - {q} * {n})::DOUBLE / {n}) / {n})"


GROUPS = PATHS + f"""
gs AS (SELECT sha256(seq) AS hash, count(*) AS n, sum(us::HUGEINT)::HUGEINT AS total, sum(us::HUGEINT * us::HUGEINT)::HUGEINT AS squares, min(n_nodes) AS path_len FROM paths GROUP BY 1),
g0 AS (SELECT hash, n AS n_traces, path_len, total::DOUBLE / n AS mean_us, {variance_sql('n', 'total', 'squares')} AS variance_us2 FROM gs),
groups AS (SELECT *, CASE WHEN mean_us <> 0 THEN sqrt(variance_us2) / mean_us END AS cv FROM g0),
"""
_G = "hash, n_traces, path_len, mean_us, variance_us2, cv"


def _end(parts: str) -> str:
    return parts.strip().rstrip(",") + "\n"


def _paths(spark, d):
    return derived.session_paths(derived.table(spark, d, "events"))


def _groups(spark, d):
    return groups.group_paths(_paths(spark, d))


@query(_end(GROUPS) + f"SELECT {_G} FROM groups WHERE variance_us2 <> 0 AND n_traces > 3 AND cv > 0.05")
def problem_groups_cv(spark, d):
    return groups.problem_groups_cv(_groups(spark, d), 0.05)


@query(_end(GROUPS) + f"SELECT {_G} FROM groups WHERE variance_us2 <> 0 AND n_traces > 3")
def problem_groups(spark, d):
    return groups.problem_groups(_groups(spark, d))


@query(_end(GROUPS) + f"SELECT {_G} FROM groups WHERE n_traces > 3 AND mean_us > (SELECT quantile_disc(mean_us, 0.1) FROM groups)")
def problem_groups_slow(spark, d):
    """Groups over the first tenth: those of several traces are among the fast ones here."""
    return groups.problem_groups_slow(_groups(spark, d), 0.1)


EDGES = GROUPS + f"""
lagged AS (SELECT e.*, lag(tracepoint) OVER (PARTITION BY base_id ORDER BY pos) AS source, (ts_ns - lag(ts_ns) OVER (PARTITION BY base_id ORDER BY pos)) // 1000 AS us FROM ev e),
es AS (SELECT sha256(seq) AS hash, pos - 1 AS pos, source, tracepoint AS target, count(*) AS n, sum(l.us::HUGEINT)::HUGEINT AS total, sum(l.us::HUGEINT * l.us::HUGEINT)::HUGEINT AS squares, min(l.us) AS min_us, max(l.us) AS max_us
  FROM lagged l JOIN paths USING (base_id) WHERE source IS NOT NULL GROUP BY 1, 2, 3, 4),
edge_stats AS (SELECT hash, pos, source, target, n, min_us, max_us, {variance_sql('n', 'total', 'squares')} AS variance_us2 FROM es),
"""


@query(_end(EDGES) + "SELECT *, variance_us2 / 1e12 AS variance_s2 FROM edge_stats")
def group_edges(spark, d):
    return groups.group_edges(_paths(spark, d))


@query(_end(EDGES) + "SELECT hash, pos, source, target, n, variance_us2, row_number() OVER (PARTITION BY hash ORDER BY variance_us2 DESC, pos) AS rank FROM edge_stats WHERE hash IN (SELECT hash FROM groups WHERE variance_us2 <> 0 AND n_traces > 3)")
def group_edges_ranked(spark, d):
    p = _paths(spark, d)
    return groups.problem_edges(groups.group_edges(p), groups.problem_groups(groups.group_paths(p))).select("hash", "pos", "source", "target", "n", "variance_us2", "rank")


@query(_end(GROUPS) + "SELECT count(*) AS n_groups, count(*) FILTER (WHERE variance_us2 = 0) AS n_zero FROM groups")
def zero_variance_groups(spark, d):
    return groups.zero_variance(_groups(spark, d))


@query(_end(GROUPS) + "SELECT sha256(seq) AS hash, path_len, n_traces, variance_us2, string_agg(base_id, ' ' ORDER BY base_id) AS trace_ids FROM paths JOIN groups ON groups.hash = sha256(seq) GROUP BY ALL")
def group_report(spark, d):
    return groups.report(_paths(spark, d))


@query(_end(GROUPS) + "SELECT * FROM (SELECT 'variance' AS list, hash, n_traces, path_len FROM groups ORDER BY variance_us2 DESC, hash LIMIT 6) UNION ALL SELECT * FROM (SELECT 'length' AS list, hash, n_traces, path_len FROM groups ORDER BY path_len DESC, hash LIMIT 6) UNION ALL SELECT * FROM (SELECT 'members' AS list, hash, n_traces, path_len FROM groups ORDER BY n_traces DESC, hash LIMIT 6)")
def top_groups(spark, d):
    g = _groups(spark, d)
    lists = [groups.top(g, by).select(F.lit(name).alias("list"), "hash", "n_traces", "path_len") for name, by in (("variance", "variance_us2"), ("length", "path_len"), ("members", "n_traces"))]
    return lists[0].unionByName(lists[1]).unionByName(lists[2])


@query(_end(PATHS) + "SELECT base_id, sha256(seq) AS hash, n_nodes, duration_ns FROM paths")
def session_hashes(spark, d):
    return _paths(spark, d).select("base_id", "hash", "n_nodes", "duration_ns")


@query(_end(SESSIONS) + "SELECT base_id, pos, tracepoint, lag(tracepoint) OVER (PARTITION BY base_id ORDER BY pos) AS previous, lead(tracepoint) OVER (PARTITION BY base_id ORDER BY pos) AS next FROM ev")
def path_neighbours(spark, d):
    return critical.neighbours(derived.sessions(derived.table(spark, d, "events")))


# Graphs of line items.
HEAP = """
hn0 AS (SELECT l_orderkey AS base_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS node_id, l_returnflag || l_linestatus AS tracepoint, epoch_us(l_shipdate) * 1000 AS ts_ns, count(*) OVER (PARTITION BY l_orderkey) AS n, l_quantity::BIGINT AS days FROM lineitem),
hn AS (SELECT base_id, node_id, tracepoint, ts_ns, n FROM hn0 UNION ALL SELECT base_id, n + 1, 'sink', ts_ns, n FROM hn0 WHERE node_id = n),
he AS (SELECT base_id, node_id // 2 AS src, node_id AS dst, node_id AS edge_seq FROM hn0 WHERE node_id > 1 UNION ALL SELECT base_id, node_id, n + 1, node_id FROM hn0 WHERE 2 * node_id > n),
"""
CRITICAL = HEAP + """
best AS (SELECT base_id, dst, src FROM (SELECT he.*, row_number() OVER (PARTITION BY he.base_id, dst ORDER BY s.ts_ns DESC, edge_seq) AS k FROM he JOIN hn s ON s.base_id = he.base_id AND s.node_id = he.src) WHERE k = 1),
walk AS (SELECT base_id, n + 1 AS node_id, 0 AS back FROM hn0 WHERE node_id = n UNION ALL SELECT walk.base_id, best.src, back + 1 FROM walk JOIN best ON best.base_id = walk.base_id AND best.dst = walk.node_id WHERE walk.node_id <> 1),
cp AS (SELECT base_id, string_agg(node_id::VARCHAR, ',' ORDER BY back DESC) AS nodes, count(*) AS n_nodes, string_agg(tracepoint, chr(31) ORDER BY back DESC) AS seq, max(ts_ns) - min(ts_ns) AS duration_ns, (max(ts_ns) - min(ts_ns)) // 1000 AS us FROM walk JOIN hn USING (base_id, node_id) GROUP BY base_id),
"""


def _heap(spark, d):
    return derived.heap_graph(derived.table(spark, d, "lineitem"))


def _ends(nodes):
    return nodes.filter("tracepoint = 'sink'").select("base_id", F.lit(1).cast("bigint").alias("start_node"), F.col("node_id").alias("end_node"))


def _roots(nodes):
    return nodes.filter("node_id = 1").select("base_id", "node_id")


@query(_end(CRITICAL) + "SELECT base_id, nodes, n_nodes, duration_ns FROM cp")
def critical_path(spark, d):
    nodes, edges = _heap(spark, d)
    return critical.critical_paths(nodes, edges, _ends(nodes)).select("base_id", F.array_join("node_ids", ",").alias("nodes"), "n_nodes", "duration_ns")


@query(_end(CRITICAL) + f", cg AS (SELECT sha256(seq) AS hash, count(*) AS n, min(n_nodes) AS path_len, sum(us::HUGEINT)::HUGEINT AS total, sum(us::HUGEINT * us::HUGEINT)::HUGEINT AS squares FROM cp GROUP BY 1) SELECT hash, n AS n_traces, path_len, total::DOUBLE / n AS mean_us, {variance_sql('n', 'total', 'squares')} AS variance_us2 FROM cg")
def critical_path_groups(spark, d):
    nodes, edges = _heap(spark, d)
    found = critical.critical_paths(nodes, edges, _ends(nodes))
    hashed = critical.hashed(critical.path_steps(found, nodes))
    return groups.group_paths(found.join(hashed, "base_id")).drop("cv")


# Spans of these graphs: the first two nodes enter one span, the last exits it, all others are annotations.
SYNTHETIC = CRITICAL + """
lca AS (SELECT walk.base_id, any_value(h.n) AS n, max(CASE WHEN list_contains([h.n >> k FOR k IN range(1, 12)], walk.node_id) THEN walk.node_id END) AS lca, bool_or(walk.node_id = h.n) AS has_exit, bool_or(walk.node_id = 2 AND h.n > 2) AS again, bool_or(walk.node_id = 3) AS by_three FROM walk JOIN hn0 h ON h.base_id = walk.base_id AND h.node_id = 1 GROUP BY 1),
put AS (SELECT base_id, n, CASE WHEN n > 1 AND NOT has_exit AND NOT (lca = 1 AND again) THEN lca END AS place, n > 2 AND NOT has_exit AND by_three AS early FROM lca),
"""


def _span_paths(spark, d):
    nodes, edges = _heap(spark, d)
    variant = F.when(F.col("tracepoint") == "sink", "Annotation").when((F.col("node_id") == F.col("n")) & (F.col("n") > 1), "Exit").when((F.col("node_id") == 1) | (F.col("node_id") == 2), "Entry").otherwise("Annotation")
    nodes = nodes.withColumn("variant", variant).withColumn("span_id", F.when(F.col("variant") == "Annotation", F.col("node_id")).otherwise(0).cast("string")).withColumn("is_synthetic", F.lit(False))
    found = critical.critical_paths(nodes, edges, _ends(nodes))
    return critical.path_steps(found, nodes).withColumn("path", F.lit(0).cast("bigint")), nodes, edges


@query(_end(SYNTHETIC) + "SELECT base_id::VARCHAR AS base_id, string_agg(node_id || CASE WHEN node_id = place OR node_id = 1 AND early THEN ',-1' ELSE '' END, ',' ORDER BY back DESC) AS nodes FROM walk JOIN put USING (base_id) GROUP BY 1")
def synthetic_nodes(spark, d):
    """Critical paths with the synthetic ends of spans that end off the path, numbered -1."""
    steps = critical.with_synthetic(*_span_paths(spark, d))
    return steps.groupBy("base_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "node_id"))), lambda x: x["node_id"].cast("string")), ",").alias("nodes"))


@query(
    _end(SYNTHETIC)
    + """, st AS (SELECT walk.base_id, walk.node_id, back, tracepoint, 0 AS made, ts_ns FROM walk JOIN hn ON hn.base_id = walk.base_id AND hn.node_id = walk.node_id JOIN put ON put.base_id = walk.base_id WHERE NOT (walk.node_id = 2 AND put.n > 2)
  UNION ALL SELECT put.base_id, -1, back, f.tracepoint, 1, hn.ts_ns + 1 FROM put JOIN walk ON walk.base_id = put.base_id AND walk.node_id = place JOIN hn ON hn.base_id = put.base_id AND hn.node_id = place JOIN hn f ON f.base_id = put.base_id AND f.node_id = CASE WHEN place > 1 AND EXISTS (SELECT 1 FROM walk w WHERE w.base_id = put.base_id AND w.node_id = 2) THEN 2 ELSE 1 END),
sg AS (SELECT *, ts_ns - lag(ts_ns) OVER (PARTITION BY base_id ORDER BY back DESC, made) AS gap, lag(made) OVER (PARTITION BY base_id ORDER BY back DESC, made) AS after_made FROM st)
SELECT base_id::VARCHAR AS base_id, sha256(string_agg(tracepoint, chr(31) ORDER BY back DESC, made)) AS hash, count(*) AS n_nodes, sum(CASE WHEN after_made = 1 THEN gap + 1 ELSE gap END)::BIGINT AS edges_ns FROM sg GROUP BY 1"""
)
def clean_paths(spark, d):
    """Hashes, lengths and sums of edges of critical paths after synthesis and cleaning."""
    steps = critical.whole_paths(*_span_paths(spark, d))
    return critical.hashed(steps).join(steps.groupBy("base_id").agg(F.count("*").alias("n_nodes"), F.sum("edge_ns").alias("edges_ns")), "base_id").select("base_id", "hash", "n_nodes", "edges_ns")


@query(_end(HEAP) + "SELECT base_id, node_id, 'sink' AS kind FROM hn WHERE (base_id, node_id) NOT IN (SELECT base_id, src FROM he) UNION ALL SELECT base_id, node_id, 'source' FROM hn WHERE (base_id, node_id) NOT IN (SELECT base_id, dst FROM he)")
def sinks_and_sources(spark, d):
    nodes, edges = _heap(spark, d)
    n = nodes.select("base_id", "node_id")
    return dag.sinks(n, edges).withColumn("kind", F.lit("sink")).unionByName(dag.sources(n, edges).withColumn("kind", F.lit("source")))


@query(_end(HEAP) + ", m AS (SELECT base_id, dst FROM he GROUP BY 1, 2 HAVING count(*) > 1) SELECT base_id, dst AS node_id FROM m UNION SELECT he.base_id, src FROM he JOIN m ON m.base_id = he.base_id AND m.dst = he.dst")
def sync_points(spark, d):
    return dag.sync_points(_heap(spark, d)[1])


@query(_end(HEAP) + ", r AS (SELECT base_id, 1::BIGINT AS node_id FROM hn0 WHERE node_id = 1 UNION ALL SELECT r.base_id, he.dst FROM r JOIN he ON he.base_id = r.base_id AND he.src = r.node_id) SELECT r.base_id, count(*) AS n_paths FROM r JOIN hn USING (base_id, node_id) WHERE tracepoint = 'sink' GROUP BY 1")
def count_paths(spark, d):
    nodes, edges = _heap(spark, d)
    return dag.count_paths(nodes, edges, _roots(nodes))


@query(_end(HEAP) + ", r AS (SELECT base_id, 1::BIGINT AS node_id, '1' AS nodes FROM hn0 WHERE node_id = 1 UNION ALL SELECT r.base_id, he.dst, r.nodes || ',' || he.dst FROM r JOIN he ON he.base_id = r.base_id AND he.src = r.node_id) SELECT r.base_id, nodes FROM r JOIN hn USING (base_id, node_id) WHERE tracepoint = 'sink'")
def all_paths(spark, d):
    nodes, edges = _heap(spark, d)
    return dag.all_paths(spark, edges, _roots(nodes)).select("base_id", F.array_join("node_ids", ",").alias("nodes"))


@query(_end(HEAP) + ", r AS (SELECT base_id, 2::BIGINT AS node_id FROM hn0 WHERE node_id = 2 UNION SELECT r.base_id, he.dst FROM r JOIN he ON he.base_id = r.base_id AND he.src = r.node_id) SELECT base_id, node_id FROM r")
def reachability(spark, d):
    nodes, edges = _heap(spark, d)
    return dag.reachable(spark, edges, nodes.filter("node_id = 2 and tracepoint != 'sink'").select("base_id", "node_id"))


@query(_end(HEAP) + ", r AS (SELECT base_id, n AS node_id FROM hn0 WHERE node_id = n UNION SELECT r.base_id, he.src FROM r JOIN he ON he.base_id = r.base_id AND he.dst = r.node_id) SELECT he.base_id, he.src, he.dst FROM he JOIN r ON r.base_id = he.base_id AND r.node_id = he.dst")
def prune(spark, d):
    nodes, edges = _heap(spark, d)
    ends = nodes.filter("node_id = n").select("base_id", F.col("node_id").alias("end_node"))
    return dag.prune(spark, nodes, edges, ends)[1].select("base_id", "src", "dst")


@query(_end(HEAP) + ", sk AS (SELECT base_id, node_id FROM hn WHERE tracepoint = 'NO'), r AS (SELECT he.base_id, he.src, he.dst FROM he WHERE (he.base_id, he.dst) NOT IN (SELECT base_id, node_id FROM sk) UNION SELECT r.base_id, he.src, r.dst FROM r JOIN sk ON sk.base_id = r.base_id AND sk.node_id = r.src JOIN he ON he.base_id = r.base_id AND he.dst = r.src) SELECT base_id, src, dst FROM r WHERE (base_id, src) NOT IN (SELECT base_id, node_id FROM sk)")
def node_contraction(spark, d):
    nodes, edges = _heap(spark, d)
    return dag.contract(spark, nodes, edges, nodes.filter("tracepoint = 'NO'").select("base_id", "node_id"))[1]


@query(_end(HEAP) + "SELECT he.base_id, src, dst FROM he JOIN hn s ON s.base_id = he.base_id AND s.node_id = src JOIN hn t ON t.base_id = he.base_id AND t.node_id = dst WHERE NOT (t.tracepoint = 'NO' AND s.tracepoint = 'RF') AND NOT (t.tracepoint = 'sink' AND s.tracepoint = 'AF')")
def edge_skip(spark, d):
    nodes, edges = _heap(spark, d)
    pairs = spark.createDataFrame([("NO", "RF"), ("sink", "AF")], "child string, parent string")
    return dag.drop_edges(edges.select("base_id", "src", "dst"), nodes, pairs)


@query(_end(HEAP) + """, cut AS (SELECT he.base_id, src, dst FROM he JOIN hn s ON s.base_id = he.base_id AND s.node_id = src JOIN hn t ON t.base_id = he.base_id AND t.node_id = dst WHERE t.tracepoint <> 'NO' AND NOT (t.tracepoint = 'sink' AND s.tracepoint = 'AF')),
und AS (SELECT base_id, src AS a, dst AS b FROM cut UNION ALL SELECT base_id, dst, src FROM cut),
r AS (SELECT base_id, node_id AS root, node_id FROM hn UNION SELECT r.base_id, r.root, und.b FROM r JOIN und ON und.base_id = r.base_id AND und.a = r.node_id),
m AS (SELECT base_id, node_id, min(root) AS root FROM r GROUP BY 1, 2)
SELECT base_id, count(DISTINCT root) AS n_components, count(DISTINCT root) = 1 AS is_connected FROM m GROUP BY 1""")
def connectivity(spark, d):
    """Components of the graphs without some edges."""
    nodes, edges = _heap(spark, d)
    tp = nodes.select("base_id", "node_id", "tracepoint")
    named = edges.join(tp.select("base_id", F.col("node_id").alias("src"), F.col("tracepoint").alias("s")), ["base_id", "src"]).join(tp.select("base_id", F.col("node_id").alias("dst"), F.col("tracepoint").alias("t")), ["base_id", "dst"])
    return dag.connected(nodes, named.filter("t != 'NO' and not (t = 'sink' and s = 'AF')"))


@query(_end(HEAP) + "SELECT count(DISTINCT base_id) AS n_traces, count(*) AS n_events FROM hn")
def trace_stats(spark, d):
    return dag.trace_stats(_heap(spark, d)[0])


@query(_end(HEAP) + ", f AS (SELECT base_id, min(ts_ns) AS a, max(ts_ns) AS b FROM hn GROUP BY 1) SELECT f.base_id, min(node_id) FILTER (WHERE ts_ns = a) AS start_node, min(node_id) FILTER (WHERE ts_ns = b) AS end_node FROM f JOIN hn ON hn.base_id = f.base_id GROUP BY 1")
def ends_by_time(spark, d):
    return dag.ends_by_time(_heap(spark, d)[0])


# Nested spans of line items.
SPANS = HEAP + """
ln AS (SELECT *, max(ts_ns) OVER (PARTITION BY base_id) + 864000000000000 AS fin FROM hn0),
sp0 AS (SELECT base_id, node_id AS span, 0::BIGINT AS parent, tracepoint, 'Entry' AS variant, ts_ns, 1 AS rank FROM ln
  UNION ALL SELECT base_id, node_id, 0, tracepoint, 'Exit', least(ts_ns + days * 86400000000000, fin), 2 FROM ln
  UNION ALL SELECT base_id, 0, NULL, 'order', 'Entry', ts_ns, 0 FROM ln WHERE node_id = 1
  UNION ALL SELECT base_id, 0, NULL, 'order', 'Exit', fin, 3 FROM ln WHERE node_id = 1),
sp AS (SELECT base_id, span, parent, tracepoint, variant, ts_ns, row_number() OVER (PARTITION BY base_id ORDER BY ts_ns, rank, span) AS ord FROM sp0),
"""


def _spans(spark, d):
    return derived.nested_spans(derived.table(spark, d, "lineitem"))


@query(_end(SPANS) + "SELECT base_id, ord, span, variant, last_value(CASE WHEN variant = 'Entry' THEN tracepoint END IGNORE NULLS) OVER (PARTITION BY base_id, span ORDER BY ord ROWS UNBOUNDED PRECEDING) AS name FROM sp")
def span_exit_names(spark, d):
    from ..sources.osprofiler import exit_names

    return exit_names(_spans(spark, d).drop("tracepoint").join(_spans(spark, d).filter("variant = 'Entry'").select("base_id", "span", F.col("tracepoint")), ["base_id", "span"]).withColumn("tracepoint", F.when(F.col("variant") == "Entry", F.col("tracepoint"))), "span").select("base_id", "ord", "span", "variant", "name")


@query(
    _end(SPANS)
    + """, k AS (SELECT *, lag(ord) OVER (PARTITION BY base_id, parent ORDER BY ord) AS sib FROM sp),
ent AS (SELECT base_id, span, ord AS entry_ord FROM sp WHERE variant = 'Entry'),
lc AS (SELECT base_id, parent AS span, max(ord) AS last_child FROM sp WHERE parent IS NOT NULL GROUP BY 1, 2)
SELECT k.base_id, CASE WHEN variant = 'Exit' THEN coalesce(last_child, own.entry_ord) ELSE coalesce(CASE WHEN k.parent IS NOT NULL THEN sib END, par.entry_ord) END AS src, k.ord AS dst
FROM k LEFT JOIN ent own ON own.base_id = k.base_id AND own.span = k.span LEFT JOIN ent par ON par.base_id = k.base_id AND par.span = k.parent LEFT JOIN lc ON lc.base_id = k.base_id AND lc.span = k.span
WHERE (CASE WHEN variant = 'Exit' THEN coalesce(last_child, own.entry_ord) ELSE coalesce(CASE WHEN k.parent IS NOT NULL THEN sib END, par.entry_ord) END) IS NOT NULL"""
)
def sibling_edges(spark, d):
    from ..sources.osprofiler import infer_edges

    s = _spans(spark, d).select("base_id", F.col("ord").alias("node_id"), F.col("span").cast("string").alias("span_id"), F.col("parent").cast("string").alias("parent_span_id"), "variant", "ts_ns")
    return infer_edges(s).select("base_id", "src", "dst")


@query(_end(PATHS) + ", t AS (SELECT base_id, arg_max(CASE WHEN regexp_matches(tracepoint, '^sign') THEN 'Signup' WHEN regexp_matches(tracepoint, '^pur') THEN 'Purchase' ELSE 'View' END, pos) AS request_type FROM ev WHERE regexp_matches(tracepoint, '^(sign|pur|view)') GROUP BY 1) SELECT base_id, coalesce(request_type, 'Unknown') AS request_type FROM paths LEFT JOIN t USING (base_id)")
def request_type_tag(spark, d):
    return manifest.tag(derived.sessions(derived.table(spark, d, "events")), types=EVENT_TYPES)


@query(
    _end(SESSIONS)
    + """, cs AS (SELECT base_id, pos, event_type2 AS variant, span, ts_ns FROM (SELECT base_id, pos, ts_ns, CASE WHEN tracepoint IN ('view', 'signup') THEN 'Entry' WHEN tracepoint = 'click' THEN 'Annotation' ELSE 'Exit' END AS event_type2, (event_id % 3)::VARCHAR AS span FROM ev)),
c1 AS (SELECT *, coalesce(last_value(CASE WHEN variant <> 'Annotation' THEN variant END IGNORE NULLS) OVER (PARTITION BY base_id, span ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS open, coalesce(first_value(CASE WHEN variant <> 'Annotation' THEN variant END IGNORE NULLS) OVER (PARTITION BY base_id, span ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS comes FROM cs)
SELECT base_id, pos, variant, span AS span_id FROM c1 WHERE NOT (variant = 'Entry' AND open = 'Entry') AND NOT (variant = 'Exit' AND comes = 'Exit') AND base_id NOT IN (SELECT base_id FROM c1 WHERE variant = 'Exit' AND open = '')"""
)
def incomplete_spans(spark, d):
    v = F.when(F.col("tracepoint").isin("view", "signup"), "Entry").when(F.col("tracepoint") == "click", "Annotation").otherwise("Exit")
    s = derived.sessions(derived.table(spark, d, "events")).select("base_id", "pos", v.alias("variant"), F.pmod("event_id", F.lit(3)).cast("string").alias("span_id"))
    return critical.complete_spans(s)[0].select("base_id", "pos", "variant", "span_id")


HIERARCHY = SPANS + """
h0 AS (SELECT *, sum(CASE variant WHEN 'Entry' THEN 1 ELSE -1 END) OVER (PARTITION BY base_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS after FROM sp),
h1 AS (SELECT *, after - CASE variant WHEN 'Entry' THEN 1 ELSE -1 END AS depth FROM h0),
h2 AS (SELECT base_id, ord, tracepoint, 1 AS opens, after AS level FROM h1 WHERE variant = 'Entry' UNION ALL SELECT base_id, ord, tracepoint, 0, depth FROM h1),
h3 AS (SELECT *, max(CASE WHEN opens = 1 THEN ord END) OVER (PARTITION BY base_id, level ORDER BY ord, opens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS up FROM h2),
h AS (SELECT base_id, ord, tracepoint, CASE WHEN level > 0 THEN up END AS parent_ord FROM h3 WHERE opens = 0),
"""


@query(_end(HIERARCHY) + "SELECT h.base_id, h.parent_ord, h.ord AS child_ord, p.tracepoint AS parent_tp, h.tracepoint AS child_tp FROM h JOIN sp p ON p.base_id = h.base_id AND p.ord = h.parent_ord WHERE p.tracepoint <> h.tracepoint")
def hierarchy_edges(spark, d):
    return manifest.hierarchy_edges(_spans(spark, d))


@query(_end(HIERARCHY) + "SELECT base_id, ord, tracepoint FROM h WHERE parent_ord IS NULL")
def hierarchy_starts(spark, d):
    return manifest.hierarchy_starts(_spans(spark, d))


@query(
    _end(SPANS)
    + """, iv AS (SELECT base_id, span, min(ord) FILTER (WHERE variant = 'Entry') AS a, max(ord) FILTER (WHERE variant = 'Exit') AS x, min(tracepoint) AS tp FROM sp GROUP BY 1, 2)
SELECT sp.base_id, sp.ord, string_agg(iv.tp, '/' ORDER BY iv.a) AS context FROM sp JOIN iv ON iv.base_id = sp.base_id AND iv.a <= sp.ord AND iv.x >= sp.ord GROUP BY 1, 2"""
)
def span_context(spark, d):
    return search.span_context(_spans(spark, d)).select("base_id", "ord", F.array_join("context", "/").alias("context"))


# The catalogue of paths of sessions, by request type. Tracepoints differ in their first letters, which stand for them.
MANIFEST = GROUPS + """
tagged AS (SELECT base_id, arg_max(CASE WHEN regexp_matches(tracepoint, '^sign') THEN 'Signup' WHEN regexp_matches(tracepoint, '^pur') THEN 'Purchase' ELSE 'View' END, pos) AS request_type FROM ev WHERE regexp_matches(tracepoint, '^(sign|pur|view)') GROUP BY 1),
typed AS (SELECT paths.*, coalesce(request_type, 'Unknown') AS request_type FROM paths LEFT JOIN tagged USING (base_id)),
one AS (SELECT request_type, sha256(seq) AS hash, min(seq) AS seq, min(letters) AS letters, min(n_nodes) AS path_len, count(*) AS added FROM typed GROUP BY 1, 2),
pairs AS (SELECT l.request_type, l.hash, s.hash AS short FROM one l JOIN one s ON s.request_type = l.request_type AND l.path_len > s.path_len AND l.letters LIKE '%' || regexp_replace(s.letters, '(.)', '\\1%', 'g')),
mani AS (SELECT one.*, 1 + (SELECT count(*) FROM pairs p WHERE p.request_type = one.request_type AND p.hash = one.hash) AS occurrences FROM one WHERE (request_type, hash) NOT IN (SELECT request_type, short FROM pairs)),
"""


def _typed(spark, d):
    ev = derived.table(spark, d, "events")
    return derived.session_paths(ev).join(manifest.tag(derived.sessions(ev), types=EVENT_TYPES), "base_id")


def _kinds(spark, d):
    """Groups with their path: what the catalogue and the problem groups are made of."""
    return groups.group_paths(_paths(spark, d), "tracepoints")


def _manifest(spark, d, kinds=None):
    k = _kinds(spark, d) if kinds is None else kinds
    return manifest.build(k.select("hash", "tracepoints", F.col("n_traces").alias("added"), manifest.path_type(F.col("tracepoints"), EVENT_TYPES).alias("request_type")))


@query(_end(MANIFEST) + "SELECT request_type, hash, replace(seq, chr(31), '/') AS path, path_len, occurrences, added FROM mani")
def manifest_paths(spark, d):
    return _manifest(spark, d).withColumn("path", F.array_join("tracepoints", "/")).drop("tracepoints")


@query(_end(MANIFEST) + ", x AS (SELECT request_type, unnest(string_split(seq, chr(31))) AS t FROM mani), xs AS (SELECT request_type, count(DISTINCT t) AS n_tracepoints FROM x GROUP BY ROLLUP (request_type)), ms AS (SELECT request_type, count(*) AS n_paths, sum(added)::BIGINT AS added, min(path_len) AS min_len, sum(path_len)::DOUBLE / count(*) AS avg_len, max(path_len) AS max_len, sum(path_len)::BIGINT AS sum_len FROM mani GROUP BY ROLLUP (request_type)) SELECT ms.*, n_tracepoints FROM ms JOIN xs ON xs.request_type IS NOT DISTINCT FROM ms.request_type")
def manifest_stats(spark, d):
    return manifest.stats(_manifest(spark, d))


@query(
    _end(SPANS)
    + """, m AS (SELECT base_id, dst FROM he GROUP BY 1, 2 HAVING count(*) > 1)
SELECT tracepoint FROM sp WHERE variant = 'Entry' AND span = 0
UNION SELECT tracepoint FROM hn WHERE node_id = 1 OR tracepoint = 'sink'
UNION SELECT tracepoint FROM hn JOIN m ON m.base_id = hn.base_id AND m.dst = hn.node_id
UNION SELECT tracepoint FROM hn JOIN he ON he.base_id = hn.base_id AND he.src = hn.node_id JOIN m ON m.base_id = he.base_id AND m.dst = he.dst
UNION SELECT tracepoint FROM hn WHERE tracepoint LIKE 'R%'"""
)
def skeleton(spark, d):
    nodes, edges = _heap(spark, d)
    ends = nodes.filter("node_id = 1 or tracepoint = 'sink'")
    sync = nodes.join(dag.sync_points(edges), ["base_id", "node_id"], "left_semi")
    top = manifest.hierarchy_starts(_spans(spark, d))
    return manifest.skeleton(ends, sync, top, manifest.request_type_tracepoints(nodes, (("^R", "Returned"),)))


MATCHES = MANIFEST + """
pg AS (SELECT hash AS group_hash, any_value(letters) AS s, any_value(n_traces) AS n FROM groups JOIN paths ON sha256(seq) = hash WHERE variance_us2 <> 0 AND n_traces > 3 AND path_len > 1 GROUP BY 1),
mt AS (SELECT group_hash, s, request_type, mani.hash, letters, occurrences, row_number() OVER (PARTITION BY group_hash ORDER BY occurrences DESC, request_type, mani.hash) AS rank FROM pg JOIN mani ON letters LIKE '%' || regexp_replace(s, '(.)', '\\1%', 'g')),
"""


def _problem(kinds):
    return groups.problem_groups(kinds).filter("path_len > 1").select("hash", "tracepoints", F.lit("Unknown").alias("request_type"))


@query(_end(MATCHES) + "SELECT group_hash, request_type, hash, occurrences, rank FROM mt")
def find_matches(spark, d):
    kinds = manifest.held(_kinds(spark, d))
    return manifest.find_matches(_problem(kinds), _manifest(spark, d, kinds)).select("group_hash", "request_type", "hash", "occurrences", "rank")


@query(
    _end(MATCHES)
    + """, al AS (SELECT group_hash, rank, s, letters, 1 AS i, instr(letters, s[1]) AS p FROM mt UNION ALL SELECT group_hash, rank, s, letters, i + 1, p + instr(substr(letters, p + 1), s[i + 1]) FROM al WHERE i < len(s)),
ed AS (SELECT a.group_hash, a.rank AS mr, a.i AS edge_pos, a.letters, a.p AS source, b.p AS target, b.p - a.p - 1 AS m FROM al a JOIN al b ON b.group_hash = a.group_hash AND b.rank = a.rank AND b.i = a.i + 1),
wk AS (SELECT group_hash, edge_pos, mr, letters, source, target, least(m, 3) AS n, CASE WHEN m <= 3 THEN 0 ELSE m // 4 END AS gap, 0 AS k, source + 1 AS cur, NULL::BIGINT AS pick FROM ed WHERE m > 0 UNION ALL
SELECT group_hash, edge_pos, mr, letters, source, target, n, gap, k + 1, coalesce(p + 1, target), p FROM (SELECT *, CASE WHEN cur + gap >= target OR moved = source THEN NULL ELSE moved END AS p FROM (SELECT *, CASE WHEN letters[cur + gap] <> 'v' THEN cur + gap WHEN cur + gap + 1 = target THEN cur + gap - 1 ELSE cur + gap + 1 END AS moved FROM wk WHERE k < n))),
pk AS (SELECT group_hash, edge_pos, mr, k, letters[pick] AS letter FROM wk WHERE pick IS NOT NULL),
fr AS (SELECT group_hash, edge_pos, letter, min(mr * 100 + k) AS o FROM pk WHERE letter <> 'v' GROUP BY 1, 2, 3),
rk AS (SELECT *, row_number() OVER (PARTITION BY group_hash, edge_pos ORDER BY o, letter) AS rank FROM fr)
SELECT group_hash, edge_pos, (SELECT min(event_type) FROM events WHERE substr(event_type, 1, 1) = letter) AS tracepoint, rank FROM rk WHERE rank <= 3"""
)
def search_flat(spark, d):
    kinds = manifest.held(_kinds(spark, d))
    g = _problem(kinds)
    edges = g.select(F.col("hash").alias("group_hash"), F.explode(F.sequence(F.lit(1), F.size("tracepoints") - 1)).alias("edge_pos"))
    enabled = spark.createDataFrame([("view",)], "tracepoint string")
    return search.flat(g, edges, _manifest(spark, d, kinds), 3, enabled)


@query(
    _end(HIERARCHY)
    + """, iv AS (SELECT base_id, span, min(ord) FILTER (WHERE variant = 'Entry') AS a, max(ord) FILTER (WHERE variant = 'Exit') AS x, min(tracepoint) AS tp FROM sp GROUP BY 1, 2),
cx AS (SELECT sp.base_id, sp.ord, list(iv.tp ORDER BY iv.a) AS c FROM sp JOIN iv ON iv.base_id = sp.base_id AND iv.a <= sp.ord AND iv.x >= sp.ord GROUP BY 1, 2),
ed AS (SELECT base_id, ord AS edge_pos, c, lag(c) OVER (PARTITION BY base_id ORDER BY ord) AS b FROM cx),
pf AS (SELECT base_id, edge_pos, c[1:len([k FOR k IN range(1, least(len(b), len(c)) + 1) IF b[1:k] = c[1:k]])] AS p FROM ed WHERE b IS NOT NULL),
lk AS (SELECT base_id, 0::BIGINT AS up, ord AS at_, tracepoint AS tp FROM h WHERE parent_ord IS NULL UNION ALL SELECT h.base_id, h.parent_ord, h.ord, h.tracepoint FROM h JOIN sp ON sp.base_id = h.base_id AND sp.ord = h.parent_ord WHERE sp.tracepoint <> h.tracepoint),
w AS (SELECT base_id, edge_pos, p, 0 AS n, 0::BIGINT AS at_ FROM pf UNION ALL SELECT w.base_id, edge_pos, p, n + 1, lk.at_ FROM w JOIN lk ON lk.base_id = w.base_id AND lk.up = w.at_ AND lk.tp = w.p[n + 1] WHERE n < len(p))
SELECT DISTINCT w.base_id, edge_pos, lk.tp AS tracepoint FROM w JOIN lk ON lk.base_id = w.base_id AND lk.up = CASE WHEN w.at_ = 0 THEN 1 ELSE w.at_ END WHERE n = len(p) AND lk.tp <> 'RF'"""
)
def search_hierarchical(spark, d):
    """Candidates inside every edge of every trace, each a path of its own."""
    return search.hierarchical_within(_spans(spark, d), spark.createDataFrame([("RF",)], "tracepoint string"))


@query(_end(MANIFEST) + "SELECT DISTINCT t AS tracepoint FROM (SELECT unnest(string_split(seq, chr(31))) AS t FROM mani WHERE request_type = 'Purchase') WHERE t <> 'click'")
def search_historic(spark, d):
    return search.historic(_manifest(spark, d), "Purchase", spark.createDataFrame([("click",)], "tracepoint string"))


_CHANGES = """ch AS (SELECT event_id AS seq, 'tp' || (user_id % 50) AS tracepoint, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END AS request_type, value > 40 AS enable FROM events),
state AS (SELECT tracepoint, request_type FROM ch GROUP BY 1, 2 HAVING arg_max(enable, seq)),
asked AS (SELECT DISTINCT 'tp' || (user_id % 60) AS tracepoint, event_type AS request_type FROM events)"""


@query(_CHANGES + " SELECT *, EXISTS (SELECT 1 FROM state s WHERE s.tracepoint = asked.tracepoint AND (s.request_type IS NULL OR s.request_type = asked.request_type)) AS enabled FROM asked")
def enabled_state(spark, d):
    """What is enabled after a change for each event; a fourth of them for all request types."""
    ev = derived.table(spark, d, "events")
    point = lambda n: F.concat(F.lit("tp"), F.pmod("user_id", F.lit(n)).cast("string")).alias("tracepoint")
    none = spark.createDataFrame([], "tracepoint string, request_type string")
    changes = ev.select(F.col("event_id").alias("seq"), point(50), F.when(F.col("event_id") % 4 == 0, "Unknown").otherwise(F.col("event_type")).alias("request_type"), (F.col("value") > 40).alias("enable"))
    return control.is_enabled(ev.select(point(60), F.col("event_type").alias("request_type")).distinct(), control.apply_changes(none, changes))


COUNTERS = """
cn AS (SELECT user_id % 4 AS node, (epoch_us(ts) // 3600000000) * 3600000000 AS hour_us, sum(length(props) + 100) AS bytes, sum(floor(value * 1000)::BIGINT)::BIGINT AS trace_size FROM events GROUP BY 1, 2),
cc AS (SELECT node, hour_us, sum(bytes) OVER (PARTITION BY node ORDER BY hour_us ROWS UNBOUNDED PRECEDING)::BIGINT AS received, trace_size FROM cn),
"""


def _counters(spark, d):
    return derived.node_counters(derived.table(spark, d, "events"))


@query(_end(COUNTERS) + "SELECT node, hour_us, CASE WHEN lag(hour_us) OVER w IS NULL THEN 0.0::DOUBLE ELSE (received - lag(received) OVER w)::DOUBLE / ((hour_us - lag(hour_us) OVER w) / 1000000) END AS rate FROM cc WINDOW w AS (PARTITION BY node ORDER BY hour_us)")
def node_rates(spark, d):
    return control.rates(_counters(spark, d))


@query(_end(COUNTERS) + "SELECT node, max(hour_us) AS hour_us, arg_max(received, hour_us) AS received, arg_max(trace_size, hour_us) AS trace_size FROM cc GROUP BY 1")
def latest_stats(spark, d):
    return control.latest(_counters(spark, d))


@query(_end(COUNTERS) + ", l AS (SELECT node, arg_max(trace_size, hour_us) AS s FROM cc GROUP BY 1) SELECT sum(s)::BIGINT AS trace_size, sum(s) > 1000000 AS over FROM l")
def budget_overrun(spark, d):
    return control.overrun(_counters(spark, d), 1_000_000)


SEEN = MANIFEST + """
sn AS (SELECT ev.tracepoint, request_type, max(ts_ns) AS seen_ns FROM ev JOIN typed USING (base_id) WHERE pos < n_nodes GROUP BY 1, 2),
"""


@query(_end(SEEN) + "SELECT * FROM sn")
def last_seen(spark, d):
    return control.last_seen(_typed(spark, d))


@query(_end(SEEN) + "SELECT * FROM sn WHERE 1706659200000000000 - seen_ns > 3600000000000")
def old_tracepoints(spark, d):
    return control.old_tracepoints(control.last_seen(_typed(spark, d)), 1_706_659_200_000_000_000, 3600)


@query(_end(PATHS) + "SELECT end_ns // 20000000000 AS jiffy, count(*) AS n_traces, sum(n_nodes)::BIGINT AS n_nodes FROM paths GROUP BY 1")
def jiffy_counts(spark, d):
    return control.jiffies(_paths(spark, d))


@query(_end(PATHS) + "SELECT count(*) AS n_traces, sum(n_nodes)::BIGINT AS n_nodes FROM paths")
def batch_counters(spark, d):
    return groups.batch_counters(_paths(spark, d))


@query(_end(EDGES) + ", er AS (SELECT edge_stats.*, g.variance_us2 AS gv FROM edge_stats JOIN groups g USING (hash) WHERE g.variance_us2 <> 0 AND n_traces > 3), pr AS (SELECT target AS tracepoint, row_number() OVER (ORDER BY gv DESC, hash, edge_v DESC, pos) AS priority FROM (SELECT *, er.variance_us2 AS edge_v FROM er)), b AS (SELECT tracepoint, min(priority) AS priority FROM pr GROUP BY 1 ORDER BY 2 LIMIT 3) SELECT tracepoint, 3 - row_number() OVER (ORDER BY priority) AS left FROM b")
def greedy_budget(spark, d):
    p = _paths(spark, d)
    g = groups.problem_groups(groups.group_paths(p))
    e = groups.group_edges(p).join(g.select("hash", F.col("variance_us2").alias("gv")), "hash")
    c = e.select(F.col("target").alias("tracepoint"), F.struct(-F.col("gv"), F.col("hash"), -F.col("variance_us2"), F.col("pos")).alias("priority"))
    return control.greedy_budget(c).select("tracepoint", "left")


@query(_end(PATHS) + "SELECT request_type, count(DISTINCT t) AS n FROM (SELECT unnest(string_split(seq, chr(31))) AS t, CASE WHEN n_nodes > 3 THEN 'long' ELSE 'short' END AS request_type FROM paths) GROUP BY 1")
def distinct_tracepoints(spark, d):
    p = _paths(spark, d).withColumn("request_type", F.when(F.col("n_nodes") > 3, "long").otherwise("short"))
    return groups.tracepoints(p, "request_type").groupBy("request_type").agg(F.count("*").alias("n"))


@query("c AS (SELECT 1) SELECT event_id // 16 AS blob, row_number() OVER (PARTITION BY event_id // 16 ORDER BY event_id) AS k, props AS object FROM events")
def split_json_blob(spark, d):
    """Events' objects back from blobs of sixteen."""
    ev = derived.table(spark, d, "events").select(F.expr("event_id div 16").alias("blob"), F.struct("event_id", "props").alias("e"))
    blobs = ev.groupBy("blob").agg(F.array_join(F.transform(F.sort_array(F.collect_list("e")), lambda e: e["props"]), "").alias("x"))
    return blobs.select("blob", F.posexplode(fn.split_objects(F.col("x"))).alias("k", "object")).withColumn("k", F.col("k") + 1)


@query("i AS (SELECT DISTINCT printf('%x', o_orderkey * 1000003) AS id FROM orders UNION ALL SELECT '0'), p AS (SELECT id, rpad(CASE id WHEN '0' THEN '' ELSE id END, 32, '0') AS x FROM i) SELECT id, substr(x, 1, 8) || '-' || substr(x, 9, 4) || '-' || substr(x, 13, 4) || '-' || substr(x, 17, 4) || '-' || substr(x, 21, 12) AS uuid FROM p")
def hexid_to_uuid(spark, d):
    ids = derived.table(spark, d, "orders").select(F.lower(F.hex(F.col("o_orderkey") * 1000003)).alias("id")).distinct().unionByName(spark.createDataFrame([("0",)], "id string"))
    return ids.select("id", fn.hex_id(F.col("id")).alias("uuid"))


@query("p AS (SELECT DISTINCT user_id, lpad(printf('%x', user_id), 16, '0') AS x FROM events) SELECT user_id::VARCHAR AS id, substr(x, 1, 8) || '-' || substr(x, 9, 4) || '-' || substr(x, 13, 4) || '-0000-000000000000' AS uuid FROM p")
def event_id_to_uuid(spark, d):
    ids = derived.table(spark, d, "events").select(F.col("user_id").cast("string").alias("id")).distinct()
    return ids.select("id", fn.event_uuid(F.col("id")).alias("uuid"))
