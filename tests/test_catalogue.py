"""Every query against the SQL beside it, and the plans of some."""

import os

import duckdb
import pytest

from waysift.operators import control
from waysift.plans import catalogue
from waysift.sources import derived
from waysift.streaming import batch

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ALL, SQL = catalogue.QUERIES | batch.QUERIES, catalogue.ORACLE_SQL | batch.ORACLE_SQL

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ALL)
def test_same_rows(spark, duck, name):
    df = ALL[name](spark, SF)
    got = sorted(map(repr, map(tuple, df.collect())))
    duck.execute(SQL[name])
    order = [[c[0] for c in duck.description].index(c) for c in df.columns]
    assert sorted(df.columns) == sorted(c[0] for c in duck.description)
    assert got == sorted(repr(tuple(r[i] for i in order)) for r in duck.fetchall())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_columns_are_pruned(spark):
    p = plan(derived.session_paths(derived.table(spark, SF, "events")))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string>" in p


def test_no_python_and_no_cross_join_in_queries(spark):
    for name in ("problem_groups_cv", "critical_path", "manifest_paths", "find_matches", "span_context"):
        p = plan(ALL[name](spark, SF))
        assert "Python" not in p and "Pandas" not in p and "CartesianProduct" not in p and "NestedLoop" not in p, name


def test_groups_combine_before_the_shuffle(spark):
    p = plan(catalogue._groups(spark, SF))
    assert "partial_count" in p


def test_top_n_is_no_full_sort(spark):
    c = spark.range(100).selectExpr("id as priority", "cast(id as string) as tracepoint")
    assert "TakeOrderedAndProject" in plan(control.greedy_budget(c))


def test_event_id_to_uuid_takes_every_id(spark, tmp_path):
    from waysift.plans import catalogue

    spark.createDataFrame([(7,), (65536,), (2**40 + 5,)], "user_id long").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.id: r.uuid for r in catalogue.event_id_to_uuid(spark, str(tmp_path)).collect()}
    assert set(got) == {"7", "65536", str(2**40 + 5)} and len(set(got.values())) == 3 and all(len(u) == 36 for u in got.values())


@pytest.mark.parametrize("shared", [False, True])
def test_build_finds_contained_words_in_texts(spark, monkeypatch, shared):
    """Against plain loops; with letters that several tracepoints share, words are walked."""
    import random

    from waysift import functions
    from waysift.operators import manifest

    if shared:
        monkeypatch.setattr(functions, "_LETTERS", 3)
    r = random.Random(3)
    paths = sorted({(t, tuple(r.choice("abcde") for _ in range(r.randrange(1, 9)))) for t in "xy" for _ in range(150)})
    rows = [(t, "-".join(p), list(p)) for t, p in paths] + [(t, "-".join(p), list(p)) for t, p in paths[:40]]
    made = manifest.build(spark.createDataFrame(rows, "request_type string, hash string, tracepoints array<string>"))

    def contained(short, long):
        rest = iter(long)
        return short != long and all(c in rest for c in short)

    want = {}
    for t, p in paths:
        if not any(contained(p, q) for u, q in paths if u == t):
            want[t, "-".join(p)] = (list(p), len(p), 1 + sum(contained(q, p) for u, q in paths if u == t), 1 + ((t, p) in paths[:40]))
    assert {(m.request_type, m.hash): (m.tracepoints, m.path_len, m.occurrences, m.added) for m in made.collect()} == want
    assert "regexp_extract_all" in plan(made)  # words of a text meet a path at once, not pair by pair


@pytest.mark.parametrize("name", ["manifest_paths", "manifest_stats", "find_matches", "search_flat"])
def test_events_are_read_once(spark, name):
    """Distinct paths are held: the plan over them doesn't go back to the events (it did in up to 30 places)."""
    p = plan(ALL[name](spark, SF))
    assert "FileScan" not in p and "Scan ExistingRDD" in p


def test_build_takes_paths_that_are_summed_up(spark):
    from waysift.operators import manifest

    rows = [("x", "ab", ["a", "b"], 3), ("x", "ab", ["a", "b"], 4), ("x", "a", ["a"], 5), ("y", "a", ["a"], 6)]
    made = manifest.build(spark.createDataFrame(rows, "request_type string, hash string, tracepoints array<string>, added long"))
    assert {(m.request_type, m.hash, m.occurrences, m.added) for m in made.collect()} == {("x", "ab", 2, 7), ("y", "a", 1, 6)}


def test_type_of_a_path_is_its_tag(spark):
    from pyspark.sql import functions as F

    from waysift.operators import manifest

    paths = {"a": ["click"], "b": ["view", "click"], "c": ["purchase", "signup", "error"], "d": ["signup", "purchase", "purchase"], "e": ["error", "view", "signup", "view"]}
    df = spark.createDataFrame([*paths.items()], "base_id string, tracepoints array<string>")
    tagged = manifest.tag(df.select("base_id", F.posexplode("tracepoints").alias("pos", "tracepoint")), types=catalogue.EVENT_TYPES)
    got = df.select("base_id", manifest.path_type(F.col("tracepoints"), catalogue.EVENT_TYPES)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, tagged.collect())) and dict(map(tuple, got)) == {"a": "Unknown", "b": "View", "c": "Signup", "d": "Purchase", "e": "View"}


def test_hierarchical_within_joins_nothing_and_equals_the_walk_by_joins(spark):
    """The plan over line items joins enabled tracepoints only; on traces with annotations, missing ends and spans that cross, candidates are those of hierarchical()."""
    import random

    from pyspark.sql import functions as F

    from waysift.operators import search

    p = plan(ALL["search_hierarchical"](spark, SF))
    assert p.count("Join") == 1 and "UnionLoop" not in p
    r = random.Random(5)
    rows = [(f"t{t}", o, r.choice(["s1", "s2", "s3", None]), r.choice(["Entry", "Entry", "Exit", "Annotation"]), r.choice("abc")) for t in range(60) for o in range(r.randrange(1, 12))]
    s = spark.createDataFrame(rows, "base_id string, ord int, span string, variant string, tracepoint string")
    enabled = spark.createDataFrame([("c",)], "tracepoint string")
    c = search.span_context(s.withColumn("span", F.coalesce("span", F.lit("none"))))
    edges = c.select("base_id", F.col("ord").alias("edge_pos"), F.col("context").alias("target_context")).join(c.select("base_id", (F.col("ord") + 1).alias("edge_pos"), F.col("context").alias("source_context")), ["base_id", "edge_pos"])
    want = search.hierarchical(edges, s, enabled, ("base_id",)).select("base_id", "edge_pos", "tracepoint")
    got = sorted(map(tuple, search.hierarchical_within(s, enabled).collect()))
    assert got == sorted(map(tuple, want.collect())) and len(got) > 50
