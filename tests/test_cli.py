"""Commands over a small folder of traces."""

import json

import pytest

from waysift import cli, report
from waysift.settings import Settings
from waysift.sources import SOURCES, only, open_source, save, trace_ids

from .test_fixtures import envelope


@pytest.fixture
def settings(tmp_path):
    (tmp_path / "traces").mkdir()
    for k in range(4):
        e = envelope()
        e[0]["id"] = f"abcdef012345678{k}"
        (tmp_path / "traces" / f"{k}.json").write_text(json.dumps(e))
    p = tmp_path / "s.toml"
    p.write_text(f'application = "HDFS"\ntrace_path = "{tmp_path}/traces"\nmanifest_file = "{tmp_path}/manifest"\nstate_path = "{tmp_path}/state"\ncontrol_file = "{tmp_path}/control"\njiffy_s = "10"\n')
    return str(p)


def test_commands(spark, settings, tmp_path):
    run = lambda *a: cli.main([settings, *a], spark)
    assert dict(tuple(r) for r in run("show-config").collect())["jiffy_s"] == "10"
    g = run("group").collect()
    assert len(g) == 1 and g[0].n_traces == 4 and g[0].path_len == 3
    stats = run("manifest").filter("request_type is null").first()
    assert (stats.n_paths, stats.added) == (2, 8)
    assert run("show-manifest", "Unknown").count() == 2
    one = "abcdef01-2345-6780-0000-000000000000"
    assert "digraph" in run("get-crit", one).first().dot
    assert run("key-value", one).count() > 0
    assert run("dump-traces", "--out", str(tmp_path / "saved")).count() == 4
    assert open_source("saved")(spark, str(tmp_path / "saved")).traces.count() == 4
    assert run("enable-all").count() == 4
    assert run("disable-tracepoint", "tp2").count() == 3
    text = "".join(p.read_text() for p in (tmp_path / "control").glob("part-*"))
    assert text == "tp2\n"
    assert run("disable-all").count() == 0
    assert run("enable-skeleton").count() == 2


def test_lists_and_errors(spark, settings, tmp_path):
    t = open_source("HDFS")(spark, str(tmp_path / "traces"), True)
    (tmp_path / "ids").write_text("abcdef01-2345-6780-0000-000000000000\n\nx\nabsent-id\n")
    found, lost = only(t, trace_ids(spark, str(tmp_path / "ids")))
    assert found.traces.count() == 1 and [r.base_id for r in lost.collect()] == ["absent-id"]
    save(found, str(tmp_path / "one"))
    assert report.dot(found.nodes, found.edges).first().dot.count("->") == 4
    with pytest.raises(ValueError):
        open_source("none")
    assert set(SOURCES) >= {"OpenStack", "HDFS", "DEATHSTAR", "Uber"}
    for bad in ('application = "x"\n', 'application = "HDFS"\nodd = "1"\n', 'application = "HDFS"\nsearch_strategy = "x"\n'):
        (tmp_path / "bad.toml").write_text(bad)
        with pytest.raises(ValueError):
            Settings.read(str(tmp_path / "bad.toml"))
