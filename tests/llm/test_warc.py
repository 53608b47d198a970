"""WARC records, trees and audits."""

import hashlib

import pytest

pytest.importorskip("waysift.llm.queries")
from pyspark.sql import functions as F  # noqa: E402

from waysift.llm import warc  # noqa: E402

SCHEMA = "page_id long, url string, html string, digest string, file string, offset string"


def page(k, size=3000):
    return (k, f"http://h{k % 7}/é{k}", f"<p>{k}</p>" * (size // 8) + "ü", "d", "f", "o")


ROWS = [page(k) for k in range(0, 2500, 3)] + [page(3), (None, None, None, "", "", ""), (6, None, "", "", "", ""), page(5000, 400_000)]


def brute(rows):
    """record -> (file, offset, n_bytes, digest), and each file's root by plain code."""
    out, by_file = [], {}
    for i, url, html, *_ in rows:
        body = (html or "").encode()
        t = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{'' if i is None else i}>\r\nWARC-Target-URI: {url or ''}\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Block-Digest: sha256:{hashlib.sha256(body).hexdigest()}\r\nContent-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
        by_file.setdefault(None if i is None else i // 1000, []).append((i, hashlib.sha256(t).hexdigest(), len(t)))
    roots, leaves = {}, {}
    for f, rs in by_file.items():
        at = 0
        for i, d, n in sorted(rs, key=lambda r: (r[0] or 0, r[1])):
            out.append((i, f, at, n, d))
            leaves.setdefault((f, at // 65536), []).append(f"{at}:{d}")
            at += n
    level, widest = {k: hashlib.sha256("".join(v).encode()).hexdigest() for k, v in leaves.items()}, max(i for _, i in leaves)
    while widest:
        up = {}
        for (f, i), d in sorted(level.items(), key=lambda x: x[0][1]):
            up.setdefault((f, i // 16), []).append(d)
        level, widest = {k: hashlib.sha256("".join(v).encode()).hexdigest() for k, v in up.items()}, widest // 16
    roots = {f: d for (f, _), d in level.items()}
    return out, roots


def test_records_and_roots(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    want, roots = brute(ROWS)
    key = lambda r: tuple(map(str, r))
    r = warc.records(df)
    assert sorted(map(key, r.select("record_id", "file", "offset", "n_bytes", "digest").collect())) == sorted(map(key, want))
    assert {x.file: x.digest for x in warc.roots(r).collect()} == roots
    back = warc.read_files(warc.files(df))
    assert sorted(map(key, back.select("record_id", "file", "nth", "offset", "n_bytes", "digest").collect())) == sorted(map(key, r.select("record_id", "file", "nth", "offset", "n_bytes", "digest").collect()))


def test_audit_locates_damage(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    a = warc.records(df)
    assert warc.audit(a, a).collect() == []
    rotten = [(*r[:2], "#" + r[2][1:], *r[3:]) if r[0] in (30, 1200, 5000) else r for r in ROWS]
    got = {(r.record_id, r.status) for r in warc.audit(a, warc.records(spark.createDataFrame(rotten, SCHEMA))).collect()}
    assert got == {(30, "corrupt"), (1200, "corrupt"), (5000, "corrupt")}
    lost = [r for r in ROWS if r[0] != 999 and r[0] != 5000 and r[0] is not None] + [page(7000)]
    got = {(r.record_id, r.status) for r in warc.audit(a, warc.records(spark.createDataFrame(lost, SCHEMA))).collect()}
    assert got == {(999, "missing"), (5000, "missing"), (None, "missing"), (7000, "extra")}
    shorter = [(*r[:2], r[2][:-1], *r[3:]) if r[0] == 1500 else r for r in ROWS]
    got = {(r.record_id, r.status) for r in warc.audit(a, warc.records(spark.createDataFrame(shorter, SCHEMA))).collect()}
    assert (1500, "corrupt") in got and {s for i, s in got if i != 1500} == {"moved"} and {i for i, _ in got} == {k for k in range(1500, 2000, 3)}


def test_only_odd_branches_are_compared(spark):
    a = warc.records(spark.createDataFrame(ROWS, SCHEMA))
    odd = warc._differ(warc.ranges(a), warc.ranges(a.withColumn("digest", F.when(F.col("record_id") == 30, "x").otherwise(F.col("digest")))))
    assert [(r.file, r.idx) for r in odd.collect()] == [(0, a.filter("record_id = 30").first().offset // 65536)]


def test_empty_and_broken(spark):
    empty = warc.records(spark.createDataFrame([], SCHEMA))
    assert warc.audit(empty, empty).collect() == [] and warc.roots(empty).collect() == []
    one = warc.records(spark.createDataFrame(ROWS[:2], SCHEMA))
    assert {r.status for r in warc.audit(one, empty).collect()} == {"missing"}
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n"))
