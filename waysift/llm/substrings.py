"""Repeated passages across documents, by compaction of a token de Bruijn graph.

An edge of the graph is a window of `length` words. Whether a window repeats shows in
its anchor first, the k-mer of least hash among its k-mers: equal windows have equal
anchors, so only windows whose anchor is in several texts are made edges. Spark joins
give every edge its first document; where consecutive edges of a document lead into
the same first document they are a nonbranching path, and compact to a span with its
source. Spans are then held against the source's words at their coordinates there, and
the words of those that hold go. Exact copies are met by a digest of all their words,
and only the first of each takes part in the graph.

Defined cases: a null text has no words; documents with fewer words than `length` lose
none; windows that repeat within one document, or in rows of one id, stay; rows
without an id lose and give nothing; an empty table gives none; other columns of the
input are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import buffers
from .common import bound_batches, drop, id_text, sliced, table
from .nn import hashes, rolled, word_bounds

LENGTH, KMER = 50, 20


def anchors(h: np.ndarray, length: int, k: int) -> np.ndarray:
    """Of each window of length words, given by their hashes: the least hash of its k-mers."""
    m, width = rolled(h, k), 1
    want = length - k + 1
    while width * 2 <= want and len(m) > width:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    rest = want - width
    return (np.minimum(m[:-rest], m[rest:]) if rest and len(m) > rest else m)[: max(0, len(h) - length + 1)]


class Block:
    """The words of a block of texts."""

    def __init__(self, column: pa.Array) -> None:
        raw, offsets = buffers(column)
        self.starts, self.ends, self.first = word_bounds(raw, offsets)
        self.hash, self.data = hashes(raw, self.starts, self.ends), raw.tobytes()

    def of(self, k: int) -> np.ndarray:
        return self.hash[self.first[k] : self.first[k + 1]]

    def words(self, k: int, keep: np.ndarray | None = None) -> bytes:
        """A text's words, or those to keep, joined by one blank."""
        a, b = self.starts[self.first[k] : self.first[k + 1]], self.ends[self.first[k] : self.first[k + 1]]
        if keep is not None:
            a, b = a[keep], b[keep]
        return b" ".join([self.data[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)])


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(p) for p in parts])], pa.int32()), pa.array(flat, kind))


def repeats(df: DataFrame, length: int = LENGTH, k: int = KMER, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two tables. Documents: doc_id, n_words, digest (SHA-256 of the words joined by one blank), first (the smallest id with these words). Paths: doc_id, digest, spans (array of start word, words, source id, place there), n_removed, kept (the words that stay, joined by one blank), for documents that aren't copies and share a passage."""
    bound_batches(df.sparkSession)
    docs = id_text(df, id_col, text_col)

    @sliced
    def seen(batches: Iterable) -> Iterator:
        for b in batches:
            w = Block(b.column("text"))
            n = range(b.num_rows)
            yield pa.record_batch(
                [b.column("doc_id"), pa.array(np.diff(w.first), pa.int64()), pa.array([hashlib.sha256(w.words(i)).digest() for i in n], pa.binary()), _lists([np.unique(anchors(w.of(i), length, k)).view(np.int64) for i in n], pa.int64())],
                names=["doc_id", "n_words", "digest", "anchors"],
            )

    all_ = table(docs.mapInArrow(seen, "doc_id long, n_words long, digest binary, anchors array<long>"), "seen")
    classes = table(all_.groupBy("digest").agg(F.min("doc_id").alias("first")), "classes")
    documents = all_.select("doc_id", "n_words", "digest").join(classes, "digest")

    own = all_.filter(f"n_words >= {length} and doc_id is not null").join(classes, "digest").filter("doc_id = first")
    nodes = table(own.select("doc_id", F.explode("anchors").alias("anchor")).distinct(), "anchors")
    shared = table(nodes.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("anchor"), "shared")
    marked = nodes.join(shared.hint("merge"), "anchor").groupBy("doc_id").agg(F.collect_list("anchor").alias("anchors"))

    @sliced
    def edges(batches: Iterable) -> Iterator:
        for b in batches:
            w = Block(b.column("text"))
            keys, places, digests = [], [], []
            for i, mark in enumerate(b.column("anchors")):
                h = w.of(i)
                at = np.flatnonzero(np.isin(anchors(h, length, k).view(np.int64), mark.values.to_numpy()))
                keys.append(rolled(h, length)[at].view(np.int64))
                places.append(at)
                digests.append(hashlib.sha256(w.words(i)).digest())
            yield pa.record_batch([b.column("doc_id"), b.column("text"), pa.array(digests, pa.binary()), _lists(keys, pa.int64()), _lists(places, pa.int32())], names=["doc_id", "text", "digest", "edges", "at"])

    graph = table(docs.join(marked.hint("merge"), "doc_id").mapInArrow(edges, "doc_id long, text string, digest binary, edges array<long>, at array<int>"), "graph")
    every = graph.select("doc_id", F.explode(F.arrays_zip("edges", "at")).alias("e")).select("doc_id", F.col("e.edges").alias("edge"), F.col("e.at").alias("at"))
    firsts = table(every.groupBy("edge").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last"), F.min_by("at", "doc_id").alias("place")).filter("source < last").select("edge", "source", "place"), "firsts")
    again = every.join(firsts.hint("merge"), "edge").filter("source < doc_id").groupBy("doc_id").agg(F.collect_list(F.struct("at", "source", "place", "edge")).alias("hits"))

    @sliced
    def compact(batches: Iterable) -> Iterator:
        """Paths of consecutive edges with consecutive places in one source."""
        for b in batches:
            w = Block(b.column("text"))
            out = []
            for i, hits in enumerate(b.column("hits")):
                v = hits.values
                at, source, place, edge = (v.field(n).to_numpy() for n in ("at", "source", "place", "edge"))
                # places that this row's text doesn't have come from another row of its id
                own = rolled(w.of(i), length).view(np.int64)
                keep = at < len(own)
                keep[keep] = own[at[keep]] == edge[keep]
                order = np.flatnonzero(keep)
                order = order[np.unique(at[order], return_index=True)[1]]
                at, source, place = at[order], source[order], place[order]
                new = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (np.diff(source) != 0) | (np.diff(place) != 1)]) if len(at) else np.zeros(0, np.int64)
                size = np.diff(np.r_[new, len(at)]) + length - 1
                a = w.starts[w.first[i] : w.first[i + 1]]
                spans: dict[tuple, dict] = {}
                for s, n, j in zip(at[new].tolist(), size.tolist(), new.tolist(), strict=True):
                    key = int(source[j]), int(place[j]), n
                    if key in spans:  # the same words again, as where a line repeats
                        spans[key]["starts"].append(s)
                    else:
                        mine = np.zeros(len(a), bool)
                        mine[s : s + n] = True
                        spans[key] = {"starts": [s], "words": n, "source": key[0], "place": key[1], "proof": hashlib.blake2b(w.words(i, mine), digest_size=16).digest()}
                out.append(list(spans.values()))
            kind = pa.list_(pa.struct([("starts", pa.list_(pa.int64())), ("words", pa.int64()), ("source", pa.int64()), ("place", pa.int64()), ("proof", pa.binary())]))
            yield pa.record_batch([b.column("doc_id"), b.column("digest"), pa.array(out, kind)], names=["doc_id", "digest", "spans"])

    paths = table(graph.select("doc_id", "text", "digest").join(again.hint("merge"), "doc_id").mapInArrow(compact, "doc_id long, digest binary, spans array<struct<starts array<long>, words long, source long, place long, proof binary>>"), "paths")

    @sliced
    def prove(batches: Iterable) -> Iterator:
        """Digests of the asked words of sources."""
        for b in batches:
            w = Block(b.column("text"))
            out: tuple[list, ...] = ([], [], [], [])
            for i, (doc, asked) in enumerate(zip(b.column("source").to_pylist(), b.column("asked").to_pylist(), strict=True)):
                line = w.words(i)
                sizes = w.ends[w.first[i] : w.first[i + 1]] - w.starts[w.first[i] : w.first[i + 1]]
                begin = np.r_[0, np.cumsum(sizes + 1)].tolist()
                for q in asked:
                    a, z = q["place"], q["place"] + q["words"]
                    if z < len(begin):
                        for column, x in zip(out, (doc, a, q["words"], hashlib.blake2b(line[begin[a] : begin[z] - 1], digest_size=16).digest()), strict=True):
                            column.append(x)
            yield pa.record_batch([*(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.binary())], names=["source", "place", "words", "proof"])

    spans = paths.select("doc_id", "digest", F.explode("spans").alias("s")).select("doc_id", "digest", "s.*")
    asked = spans.select("source", "place", "words").distinct().groupBy("source").agg(F.collect_list(F.struct("place", "words")).alias("asked"))
    proofs = table(graph.select(F.col("doc_id").alias("source"), "text").join(asked.hint("merge"), "source").mapInArrow(prove, "source long, place long, words long, proof binary").distinct(), "proofs")
    held = spans.join(proofs.hint("merge"), ["source", "place", "words", "proof"]).groupBy("doc_id", "digest").agg(F.collect_list(F.struct("starts", "words", "source", "place")).alias("spans"))

    @sliced
    def remove(batches: Iterable) -> Iterator:
        for b in batches:
            w = Block(b.column("text"))
            gone, kept, found = [], [], []
            for i, held_ in enumerate(b.column("spans").to_pylist()):
                spans = sorted(({"start": start} | {k: h[k] for k in ("words", "source", "place")} for h in held_ for start in h["starts"]), key=lambda x: x["start"])
                n = int(w.first[i + 1] - w.first[i])
                edge = np.zeros(n + 1, np.int64)
                start, size = np.array([[x["start"], x["words"]] for x in spans], np.int64).reshape(-1, 2).T
                np.add.at(edge, start, 1)
                np.add.at(edge, start + size, -1)
                keep = np.cumsum(edge)[:n] == 0
                gone.append(n - int(keep.sum()))
                kept.append(w.words(i, keep))
                found.append(spans)
            kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "words", "source", "place")]))
            yield pa.record_batch([b.column("doc_id"), b.column("digest"), pa.array(found, kind), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "digest", "spans", "n_removed", "kept"])

    cut = graph.select("doc_id", "text", "digest").join(held.hint("merge"), ["doc_id", "digest"]).mapInArrow(remove, "doc_id long, digest binary, spans array<struct<start long, words long, source long, place long>>, n_removed long, kept string")
    cut = table(cut, "cut")
    drop([nodes, shared, graph, firsts, paths, proofs])
    return documents, cut


def dedup(df: DataFrame, length: int = LENGTH, k: int = KMER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest, n_words, n_removed, kept (null where all words stay), spans (null likewise, and for copies) per row."""
    documents, cut = repeats(df, length, k, id_col, text_col)
    copy = F.coalesce((F.col("first") < F.col("doc_id")) & (F.col("n_words") >= length), F.lit(False))
    return documents.join(cut.distinct().hint("merge"), ["doc_id", "digest"], "left").select(
        "doc_id",
        "digest",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept"),
        F.when(~copy, F.col("spans")).alias("spans"),
    )
