"""Readers of trace formats. Each gives nodes, edges and traces; open_source() picks one by the application's name."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Traces(NamedTuple):
    nodes: DataFrame
    edges: DataFrame
    traces: DataFrame


class TraceSource(Protocol):
    """Reads a file or a folder of traces; for_searchspace leaves out what doesn't lead to the end node."""

    def __call__(self, spark: SparkSession, path: str, for_searchspace: bool = False) -> Traces: ...


def _openstack(spark: SparkSession, path: str, for_searchspace: bool = False) -> Traces:
    from . import osprofiler

    return Traces(*osprofiler.assemble(osprofiler.spans(osprofiler.read(spark, path))))


def _xtrace(hex_events: bool, pruned: bool) -> TraceSource:
    def read(spark: SparkSession, path: str, for_searchspace: bool = False) -> Traces:
        from ..operators.dag import prune
        from . import xtrace

        t = Traces(*xtrace.assemble(xtrace.read(spark, path), hex_events))
        if hex_events:
            t = Traces(*xtrace.simplify(t.nodes, t.edges))
        return Traces(*prune(spark, t.nodes, t.edges, t.traces), t.traces) if for_searchspace and pruned else t

    return read


def _jaeger(spark: SparkSession, path: str, for_searchspace: bool = False) -> Traces:
    from . import jaeger

    return Traces(*jaeger.assemble(jaeger.read(spark, path)))


def _saved(spark: SparkSession, path: str, for_searchspace: bool = False) -> Traces:
    return Traces(*(spark.read.parquet(f"{path}/{n}") for n in Traces._fields))


SOURCES: dict[str, Callable] = {"OpenStack": _openstack, "HDFS": _xtrace(False, True), "DEATHSTAR": _xtrace(True, False), "Uber": _jaeger, "saved": _saved}


def open_source(application: str) -> TraceSource:
    if application not in SOURCES:
        raise ValueError(f"no such application: {application}; there are {', '.join(SOURCES)}")
    return SOURCES[application]


def save(t: Traces, path: str, mode: str = "errorifexists") -> None:
    """Traces as three Parquet tables, which the source named saved reads."""
    for name, df in zip(Traces._fields, t, strict=True):
        df.write.mode(mode).parquet(f"{path}/{name}")


def trace_ids(spark: SparkSession, path: str) -> DataFrame:
    """base_id of the lines of a list, those of one character or none left out."""
    return spark.read.text(path).filter("length(value) > 1").select(F.trim("value").alias("base_id"))


def only(t: Traces, ids: DataFrame) -> tuple[Traces, DataFrame]:
    """The traces in ids (base_id), and the ids that there is no trace of."""
    keep = ids.select("base_id").distinct()
    return Traces(*(df.join(keep, "base_id", "left_semi") for df in t)), keep.join(t.traces, "base_id", "left_anti")


def together(many: list[DataFrame]) -> DataFrame:
    """Spans of several agents as one table."""
    out = many[0]
    for df in many[1:]:
        out = out.unionByName(df)
    return out
