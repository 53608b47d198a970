"""Settings of the loop: a flat TOML file of strings, and constants."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields

from .operators import control

APPLICATIONS = "HDFS", "OpenStack", "Uber", "DEATHSTAR"
STRATEGIES = "Flat", "Hierarchical", "Historic"


@dataclass(frozen=True)
class Settings:
    application: str
    search_strategy: str = "Flat"
    manifest_file: str = ""
    trace_path: str = ""
    state_path: str = ""
    control_file: str = ""
    agents: tuple[str, ...] = ()
    jiffy_s: int = control.JIFFY_S
    decision_s: int = control.DECISION_S
    keep_s: int = control.KEEP_S
    tracepoints_per_epoch: int = control.TRACEPOINTS_PER_EPOCH
    trace_size_limit: int = control.TRACE_SIZE_LIMIT

    @classmethod
    def read(cls, path: str) -> Settings:
        with open(path, "rb") as f:
            given = tomllib.load(f)
        known = {f.name: f.type for f in fields(cls)}
        if extra := set(given) - set(known):
            raise ValueError(f"unknown settings: {', '.join(sorted(extra))}")
        values = {k: tuple(x.strip() for x in str(v).split(",")) if k == "agents" else int(v) if known[k] == "int" else str(v) for k, v in given.items()}
        s = cls(**values)
        if s.application not in APPLICATIONS:
            raise ValueError(f"unknown application: {s.application}")
        if s.search_strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy: {s.search_strategy}")
        return s
