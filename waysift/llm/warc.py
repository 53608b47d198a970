"""WARC fixity: Merkle trees over records and ordered offset ranges, and an audit of replicas.

A page becomes a WARC resource record; records of FILE_IDS consecutive ids make a file,
in order of id, then of digest. A record's offset and hash are a leaf; leaves whose offsets
start in one range of RANGE bytes are hashed, in order, to a range node, and FANOUT neighbours to
a node of the next level, up to the file's root. An audit compares two replicas' roots,
goes down into mismatching branches only, and compares records only in mismatching
ranges. Digests and lengths are taken where pages are scanned; no page is shuffled.

Defined cases: a null url or page counts as empty; records without an id are a file of
their own (number null); equal records of one id are told apart by their order; an empty
table has no files; a file that one replica lacks has all its records missing or extra;
other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, sliced, table

FILE_IDS, RANGE, FANOUT = 1000, 1 << 16, 16
#: Fixed value: records don't tell when they were fetched.
DATE = "2024-01-01T00:00:00Z"


def record_text(page_id: Column, url: Column, html: Column) -> Column:
    """A whole WARC record as text."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Block-Digest: sha256:"),
        F.sha2(body, 256),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
        body,
        F.lit("\r\n\r\n"),
    )


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """record_id, file, nth (among equal ids), offset, n_bytes, digest (SHA-256 of the whole record) per page."""
    text = record_text(pages[id_col], pages[url_col], pages[html_col])
    r = pages.select(pages[id_col].cast("long").alias("record_id"), text.alias("t")).select("record_id", F.expr(f"floor(record_id / {FILE_IDS}.0BD)").cast("long").alias("file"), F.octet_length("t").cast("long").alias("n_bytes"), F.sha2("t", 256).alias("digest"))
    w = Window.partitionBy("file").orderBy("record_id", "digest")
    return r.select("record_id", "file", F.row_number().over(Window.partitionBy("file", "record_id").orderBy("digest")).alias("nth"), (F.sum("n_bytes").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_bytes")).alias("offset"), "n_bytes", "digest")


def _hash(items: str) -> Column:
    return F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(items).alias("o"), "digest"))), lambda x: x["digest"]), ""), 256)


def ranges(r: DataFrame) -> DataFrame:
    """file, level 0, idx (of the offset range), digest: the lowest nodes."""
    placed = r.withColumn("digest", F.concat_ws(":", "offset", "digest"))
    return placed.groupBy("file", F.floor(F.col("offset") / RANGE).alias("idx")).agg(_hash("offset").alias("digest")).select("file", F.lit(0).alias("level"), "idx", "digest")


def tree(r: DataFrame) -> tuple[DataFrame, int]:
    """Nodes (file, level, idx, digest) of all files, all as deep as the deepest, and the roots' level."""
    nodes = table(ranges(r), "ranges")
    widest = nodes.agg(F.max("idx")).first()[0] or 0
    level, at = 0, nodes
    while widest > 0:
        at = at.groupBy("file", F.floor(F.col("idx") / FANOUT).alias("up")).agg(_hash("idx").alias("digest")).select("file", F.lit(level + 1).alias("level"), F.col("up").alias("idx"), "digest")
        nodes = nodes.unionByName(at)
        level, widest = level + 1, widest // FANOUT
    return table(nodes, "tree"), level


def _differ(a: DataFrame, b: DataFrame) -> DataFrame:
    """file, idx of nodes of one level that aren't in both alike."""
    x, y = (t.select(*(F.col(c).alias(f"{n}_{c}") for c in ("file", "idx", "digest"))) for n, t in (("x", a), ("y", b)))
    both = x.join(y, F.expr("x_file <=> y_file and x_idx = y_idx"), "full_outer").filter("not (x_digest <=> y_digest)")
    return both.select(F.expr("if(x_digest is null, y_file, x_file)").alias("file"), F.expr("coalesce(x_idx, y_idx)").alias("idx"))


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """record_id, nth, file, status of records (as records() gives them) in mismatching ranges: corrupt (other content), moved (other offset), missing (not in b), extra (not in a). Intact records give no row."""
    a, b = table(a, "replica"), table(b, "replica")
    (ta, la), (tb, lb) = tree(a), tree(b)
    level = max(la, lb)
    odd: DataFrame | None = None
    while level >= 0:
        na, nb = (_level(t, top, level) for t, top in ((ta, la), (tb, lb)))
        if odd is not None:  # children of mismatching nodes only
            up = odd.select(F.col("file").alias("up_file"), F.col("idx").alias("up"))
            na, nb = (n.join(up, F.expr(f"file <=> up_file and floor(idx / {FANOUT}) = up"), "left_semi") for n in (na, nb))
        odd = table(_differ(na, nb), f"odd{level}")
        level -= 1
    own = [r.withColumn("idx", F.floor(F.col("offset") / RANGE)) for r in (a, b)]
    last = odd.select(F.col("file").alias("up_file"), F.col("idx").alias("up"))
    x, y = (r.join(last, F.expr("file <=> up_file and idx = up"), "left_semi") for r in own)
    x, y = x.select("record_id", "nth", "file", "offset", "digest"), y.select(*(F.col(c).alias(f"b_{c}") for c in ("record_id", "nth", "file", "offset", "digest")))
    both = x.join(y, F.col("record_id").eqNullSafe(F.col("b_record_id")) & (F.col("nth") == F.col("b_nth")), "full_outer")
    status = F.when(F.col("b_digest").isNull(), "missing").when(F.col("digest").isNull(), "extra").when(F.col("digest") != F.col("b_digest"), "corrupt").when(F.col("offset") != F.col("b_offset"), "moved")
    of = lambda c: F.when(F.col("digest").isNotNull(), F.col(c)).otherwise(F.col(f"b_{c}")).alias(c)
    return both.withColumn("status", status).filter("status is not null").select(of("record_id"), of("nth"), of("file"), "status")


def _level(nodes: DataFrame, top: int, level: int) -> DataFrame:
    """A tree's nodes of a level; over its roots, the roots again."""
    return nodes.filter(F.col("level") == min(top, level)).select("file", "idx", "digest")


def roots(r: DataFrame) -> DataFrame:
    """file, digest."""
    nodes, top = tree(r)
    return nodes.filter(F.col("level") == top).select("file", "digest")


def files(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """file, content (binary): the WARC files themselves, of FILE_IDS ids each."""
    t = pages.select(pages[id_col].cast("long").alias("record_id"), record_text(pages[id_col], pages[url_col], pages[html_col]).alias("t"))
    t = t.select(F.expr(f"floor(record_id / {FILE_IDS}.0BD)").cast("long").alias("file"), F.struct("record_id", F.sha2("t", 256).alias("digest"), "t").alias("s"))
    return t.groupBy("file").agg(F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["t"]), "").cast("binary").alias("content"))


def parse(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, header fields and block of each record of an uncompressed WARC file."""
    at = 0
    while at < len(content):
        if not content.startswith(b"WARC/", at):
            raise ValueError(f"no record at {at}")
        head = content.index(b"\r\n\r\n", at)
        fields = dict(line.split(": ", 1) for line in content[at:head].decode().split("\r\n")[1:])
        block = head + 4
        end = block + int(fields["Content-Length"])
        if content[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} doesn't end where it says")
        yield at, end + 4 - at, fields, content[block:end]
        at = end + 4


def read_files(stored: DataFrame) -> DataFrame:
    """record_id, file, nth, offset, n_bytes, digest of stored files (file, content), by their bytes; records are known by their ids."""
    bound_batches(stored.sparkSession)

    @sliced
    def run(batches: Iterable) -> Iterator:
        import hashlib
        from collections import Counter

        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for name, content in zip(b.column("file").to_pylist(), b.column("content").to_pylist(), strict=True):
                seen: Counter = Counter()
                for at, n, fields, _ in parse(content or b""):
                    own = fields["WARC-Record-ID"].removeprefix("<urn:page:").removesuffix(">")
                    seen[own] += 1
                    for column, x in zip(out, (int(own) if own else None, name, seen[own], at, n, hashlib.sha256(content[at : at + n]).hexdigest()), strict=True):
                        column.append(x)
            kinds = pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()
            yield pa.record_batch([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["record_id", "file", "nth", "offset", "n_bytes", "digest"])

    return stored.select("file", "content").mapInArrow(run, "record_id long, file long, nth int, offset long, n_bytes long, digest string")


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """read_files() of a folder of WARC files whose names end in their numbers."""
    f = spark.read.format("binaryFile").load(path)
    return read_files(f.select(F.regexp_extract("path", r"(\d+)[^/\d]*$", 1).cast("long").alias("file"), "content"))
