"""Near-duplicate embeddings by hierarchical navigable small-world graphs, one per shard.

Equal vectors are one node with a weight. Nodes are dealt to shards by a hash; each
shard's graph is built from its top layer down, in batches whose searches move in
lockstep. Graphs lie and travel in small parts; a task puts a shard's together, and
every node then queries every shard, in blocks that stream past it. A query's beam widens while
all it holds is within the threshold, and a block's beams widen until an audit of some
of its queries, and of probes made beside the shard's vectors, against all vectors of
the shard finds recall enough; a beam as wide as the shard is exhaustive. Hits are
verified by their cosine in double precision and folded, slice by slice, into link
counts and a spanning forest: pairs are neither held nor reported.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing and are their own component; vectors of different lengths
don't link; rows with one id are separate vectors of one id; rows without an id don't
take part and have null results; an empty table gives none; other columns of the input
are not looked at.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, drop, sliced, table
from .components import components, forest

#: Links of a node, twice as many on the lowest layer; beam while building and searching.
LINKS, BUILD_BEAM, BEAM = 16, 64, 64
#: Bytes of a shard's and of a block's vectors at most (a vector at least), and the fewest of each that are made.
SHARD_BYTES, BLOCK_BYTES, FEWEST = 1 << 25, 1 << 24, 4
#: Bytes of a graph in a row, and the tasks (a shard with some blocks) from which more don't help.
PART_BYTES, TASKS = 1 << 14, 64
#: Queries of a block that are audited, as many probes, and the recall they need; the widest beam.
AUDIT, RECALL, WIDEST = 96, 0.98, 4096


class Layer:
    """A proximity graph over some nodes of x (rows of unit length)."""

    def __init__(self, x: np.ndarray, nodes: np.ndarray, links: int) -> None:
        self.x, self.nodes, self.links = x, nodes, links
        self.near = np.full((len(x), links), -1, np.int32)

    def search(self, q: np.ndarray, start: np.ndarray, beam: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """The beam nearest nodes found from start (queries x some nodes): numbers (-1: none) and cosines, best first."""
        ids, sims = np.full((len(q), beam), -1, np.int32), np.full((len(q), beam), -2, np.float32)
        size = max(16, min(1024, (1 << 26) // max(1, len(self.x)), (1 << 19) // beam))
        for i in range(0, len(q), size):
            k = slice(i, i + size)
            ids[k], sims[k] = self._block(q[k], start[k], beam, step)
        return ids, sims

    def _block(self, q: np.ndarray, start: np.ndarray, beam: int, step: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(q)
        seen = np.zeros((n, len(self.x) + 1), bool)  # the last column takes what isn't a node
        ids, sims, done = np.full((n, beam), -1, np.int32), np.full((n, beam), -2, np.float32), np.ones((n, beam), bool)
        todo, new = np.arange(n), start
        while len(todo):
            new = np.sort(new, 1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            new[seen[todo[:, None], new]] = -1
            seen[todo[:, None], new] = True
            sim = np.einsum("ad,akd->ak", q[todo], self.x[new])
            sim[new < 0] = -2
            all_s = np.concatenate((sims[todo], sim), 1)
            top = np.argpartition(-all_s, beam - 1, 1)[:, :beam] if all_s.shape[1] > beam else np.tile(np.arange(beam), (len(todo), 1))
            top = np.take_along_axis(top, np.argsort(-np.take_along_axis(all_s, top, 1), 1, kind="stable"), 1)
            sims[todo] = np.take_along_axis(all_s, top, 1)
            ids[todo] = np.take_along_axis(np.concatenate((ids[todo], new), 1), top, 1)
            done[todo] = np.take_along_axis(np.concatenate((done[todo], new < 0), 1), top, 1)
            open_ = ~done[todo]
            todo, open_ = todo[open_.any(1)], open_[open_.any(1)]
            if not len(todo):
                break
            first = np.argsort(~open_, 1, kind="stable")[:, :step]
            good = np.take_along_axis(open_, first, 1)
            from_ = np.where(good, np.take_along_axis(ids[todo], first, 1), -1)
            done[todo[:, None], first] = True
            new = np.where(from_[:, :, None] >= 0, self.near[from_], -1).reshape(len(todo), -1)
        return ids, sims

    def choose(self, node: np.ndarray, cand: np.ndarray) -> np.ndarray:
        """Of candidates (nodes x some, -1: none): neighbours that are nearer to the node than to those chosen before, then the nearest others."""
        cand = np.sort(cand, 1)
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
        cand[cand == node[:, None]] = -1
        out = np.full((len(node), self.links), -1, np.int32)
        step = max(1, min(512, (1 << 16) // cand.shape[1]))  # a popular node may have very many candidates
        for i in range(0, len(node), step):
            c, v = cand[i : i + step], self.x[node[i : i + step]]
            sim = np.einsum("ad,akd->ak", v, self.x[c])
            sim[c < 0] = -2
            order = np.argsort(-sim, 1, kind="stable")[:, : 3 * self.links]
            c, sim = np.take_along_axis(c, order, 1), np.take_along_axis(sim, order, 1)
            among = np.einsum("akd,ajd->akj", self.x[c], self.x[c])
            keep = np.zeros(c.shape, bool)
            for k in range(c.shape[1]):
                blocked = (keep[:, :k] & (among[:, k, :k] > sim[:, k, None])).any(1)
                keep[:, k] = ~blocked & (c[:, k] >= 0)
            rank = np.where(keep, 0, 1) + np.where(c >= 0, 0, 2)
            order = np.argsort(rank, 1, kind="stable")[:, : self.links]
            got = np.take_along_axis(c, order, 1)
            out[i : i + step, : got.shape[1]] = got
        return out

    def connect(self, node: np.ndarray, cand: np.ndarray) -> None:
        """Links nodes with what is chosen of their candidates, both ways; a node's links over the limit are chosen anew."""
        new = self.choose(node, cand)
        self.near[node] = new
        to, back = new.reshape(-1), np.repeat(node, self.links)
        to, back = to[to >= 0], back[to >= 0]
        order = np.argsort(to, kind="stable")
        to, back = to[order], back[order]
        target, first, count = np.unique(to, return_index=True, return_counts=True)
        for i in range(0, len(target), 4096):  # widths differ little within a part
            part = slice(i, i + 4096)
            t, f, c = target[part], first[part], count[part]
            for lo, hi in ((1, 8), (9, 64), (65, 1 << 30)):
                some = (c >= lo) & (c <= hi)
                if some.any():
                    tt, ff, cc = t[some], f[some], c[some]
                    wide = ff[:, None] + np.arange(int(cc.max()))
                    more = np.where(np.arange(int(cc.max())) < cc[:, None], back[np.minimum(wide, len(back) - 1)], -1)
                    self.near[tt] = self.choose(tt, np.concatenate((self.near[tt], more), 1))


class Graph:
    """Layers from the lowest up; a node is on each layer with a chance of one in LINKS of being on the next."""

    def __init__(self, x: np.ndarray, seed: int = 1) -> None:
        self.x = np.concatenate((x, np.zeros((1, x.shape[1]), x.dtype))).astype(np.float32)  # the last row stands for none
        level = np.floor(np.random.default_rng(seed).exponential(1 / np.log(LINKS), len(x))).astype(int)
        sets = [np.flatnonzero(level >= k) for k in range(level.max(initial=0) + 1)]
        while len(sets) > 1 and len(sets[-1]) < 4:
            sets.pop()
        self.layers: list[Layer] = []
        for k in range(len(sets) - 1, -1, -1):
            self._add(sets[k], LINKS if k else 2 * LINKS)

    def _add(self, nodes: np.ndarray, links: int) -> None:
        layer = Layer(self.x, nodes, links)
        had = self.layers[-1].nodes if self.layers else nodes[:1]
        rest = np.setdiff1d(nodes, had)
        for i in range(0, len(had), 1024):  # the layer above comes first, each with the nearest of the others there
            part = had[i : i + 1024]
            ids = self.find(self.x[part], BUILD_BEAM)[0] if self.layers else np.full((len(part), 1), -1, np.int32)
            layer.connect(part, ids)
        i, size = 0, max(64, len(had))
        while i < len(rest):
            part = rest[i : i + min(size, 1024)]
            v = self.x[part]
            start = self.find(v, 8)[0][:, :4] if self.layers else np.tile(had[:1].astype(np.int32), (len(part), 1))
            ids = layer.search(v, start, BUILD_BEAM)[0]
            own = v @ v.T  # those that come together
            np.fill_diagonal(own, -2)
            m = min(links, len(part) - 1)
            if m:
                ids = np.concatenate((ids, part[np.argpartition(-own, m - 1, 1)[:, :m]].astype(np.int32)), 1)
            layer.connect(part, ids)
            i += len(part)
            size = 2 * size
        self.layers.append(layer)

    def find(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest nodes of the lowest layer so far."""
        start = np.tile(self.layers[0].nodes[:4].astype(np.int32), (len(q), 1))
        for layer in self.layers[:-1]:
            start = layer.search(q, start, 8)[0][:, :4]
        return self.layers[-1].search(q, start, beam)

    def links(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Each layer's nodes and their neighbours: with the vectors, all that restored() needs."""
        return [(layer.nodes, layer.near[layer.nodes]) for layer in self.layers]

    @classmethod
    def restored(cls, x: np.ndarray, links: list[tuple[np.ndarray, np.ndarray]]) -> Graph:
        g = cls.__new__(cls)
        g.x, g.layers = np.zeros((len(x) + 1, x.shape[1]), np.float32), []
        g.x[:-1] = x
        for nodes, near in links:
            layer = Layer(g.x, nodes, near.shape[1])
            layer.near[nodes] = near
            g.layers.append(layer)
        return g


def probes(vectors: np.ndarray, threshold: float, n: int) -> np.ndarray:
    """Unit vectors beside n of the vectors, in a direction of their own, with a cosine to them that is barely enough."""
    v = vectors[np.linspace(0, len(vectors) - 1, min(n, len(vectors))).astype(int)]
    away = np.random.default_rng(3).standard_normal(v.shape)
    away -= np.einsum("ij,ij->i", away, v)[:, None] * v
    long = np.linalg.norm(away, axis=1, keepdims=True)
    c = threshold + 0.1 * (1 - threshold)
    out = c * v + np.sqrt(max(0.0, 1 - c * c)) * away / np.maximum(long, 1e-300)
    return np.where(long > 1e-9, out, v)  # of one component: no other direction


def hits(g: Graph, vectors: np.ndarray, queries: np.ndarray, threshold: float, beam: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, node) with cosine of at least threshold in double precision, a slice of queries at a time. A beam that is full of such nodes widens; one over the shard or WIDEST compares all."""
    n = len(vectors)

    def proven(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = np.concatenate([np.einsum("ij,ij->i", queries[a[i : i + 65536]], vectors[b[i : i + 65536]]) for i in range(0, len(a), 65536)] or [np.zeros(0)]) >= threshold
        return a[ok], b[ok]

    for first in range(0, len(queries), 1024):
        todo, width = np.arange(first, min(first + 1024, len(queries))), min(beam, n)
        while len(todo):
            if width >= n or width > WIDEST:
                for i in range(0, len(todo), 64):
                    a, b = np.nonzero(queries[todo[i : i + 64]] @ vectors.T >= threshold - 1e-9)
                    yield proven(todo[i + a], b)
                break
            ids, sims = g.find(queries[todo].astype(np.float32), width)
            near = sims >= threshold - 1e-3
            full = near.all(1)  # there may be more
            a, k = np.nonzero(near & ~full[:, None])
            yield proven(todo[a], ids[a, k].astype(np.int64))
            todo, width = todo[full], min(n, 4 * width)


def audited_beam(g: Graph, vectors: np.ndarray, queries: np.ndarray, threshold: float, beam: int = BEAM, audit: int = AUDIT, recall: float = RECALL) -> int:
    """The first beam, doubled from the given one, whose recall is enough.

    Held against all vectors are some of the queries, and as many probes that lie beside
    vectors of the shard, barely within the threshold: those have links whatever the
    queries have. Recall is the mean over audited queries that have links of the part
    of them that is found, so one query of very many links can't hide others' misses.
    """
    some = np.linspace(0, len(queries) - 1, min(audit, len(queries))).astype(int)
    asked = np.concatenate((queries[some], probes(vectors, threshold, audit)))
    real = np.concatenate([asked[i : i + 32] @ vectors.T >= threshold for i in range(0, len(asked), 32)])
    has = real.any(1)
    while beam < len(vectors):
        found = np.zeros_like(real)
        for a, b in hits(g, vectors, asked, threshold, beam):
            found[a, b] = True
        if ((found & real)[has].sum(1) / real[has].sum(1)).mean() >= recall:
            return beam
        beam *= 2
    return beam


def folded(g: Graph, vectors: np.ndarray, ids: np.ndarray, weight: np.ndarray, queries: np.ndarray, own: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per query the weight of the nodes that it links with, but itself; and of all ids, rising, the smallest that its links reach. Pairs are folded into these slice by slice."""
    every = np.unique(np.r_[own, ids])
    n, root, self_ = np.zeros(len(own), np.int64), np.arange(len(every)), np.arange(len(every))
    if len(queries) and len(vectors):
        for a, b in hits(g, vectors, queries, threshold, audited_beam(g, vectors, queries, threshold)):
            other = own[a] != ids[b]
            a, b = a[other], b[other]
            np.add.at(n, a, weight[b])
            root = forest(len(every), np.r_[self_, np.searchsorted(every, own[a])], np.r_[root, np.searchsorted(every, ids[b])])
    return n, every, root


def near_duplicates(df: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept per row."""
    bound_batches(df.sparkSession)

    @sliced
    def read(batches: Iterable) -> Iterator:
        for b in batches:
            out = []
            for v in b.column("v").to_pylist():
                a = np.array([np.nan if c is None else c for c in v or ()], np.float64)
                out.append(a.astype("<f8").tobytes() if len(a) and np.isfinite(a).all() and np.abs(a).max() > 0 else None)
            yield pa.record_batch([b.column("vec_id"), pa.array(out, pa.binary())], names=["vec_id", "v"])

    rows = table(df.select(df[id_col].cast("long").alias("vec_id"), df[vector_col].cast("array<double>").alias("v")).mapInArrow(read, "vec_id long, v binary"), "vectors")
    nodes = table(rows.filter("v is not null and vec_id is not null").groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight")), "nodes")
    sizes = {r[0]: r[1] for r in nodes.groupBy(F.octet_length("v")).count().collect()}  # a row for each vector length
    shards, blocks = ({k: max(FEWEST, -(-n // max(1, most // k))) for k, n in sizes.items()} for most in (SHARD_BYTES, BLOCK_BYTES))
    if not sizes:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    by = lambda m: F.element_at(F.create_map(*(F.lit(x) for kv in m.items() for x in kv)), F.octet_length("v"))
    dealt = table(nodes.select("*", F.octet_length("v").alias("kind"), F.pmod(F.xxhash64(F.lit(1), "id"), by(shards)).cast("int").alias("shard"), F.pmod(F.xxhash64(F.lit(2), "id"), by(blocks)).cast("int").alias("block")), "dealt")

    def unit(v: list[bytes]) -> np.ndarray:
        x = np.frombuffer(b"".join(v), "<f8").reshape(len(v), -1)
        x = x / np.abs(x).max(1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        return x

    def lines(batches: Iterable) -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

    @sliced
    def build(batches: Iterable) -> Iterator:
        for (kind, shard), nodes in groupby(lines(batches), lambda r: r[:2]):
            ids, weight, v = map(list, zip(*(r[2:] for r in nodes), strict=True))
            x = unit(v)
            v.clear()
            blob = memoryview(pickle.dumps((np.array(ids), np.array(weight), x, Graph(x).links()), protocol=5))
            n = -(-len(blob) // PART_BYTES)
            for first in range(0, n, 256):
                part = range(first, min(first + 256, n))
                columns = [pa.array([kind] * len(part), pa.int32()), pa.array([shard] * len(part), pa.int32()), pa.array([i - n for i in part], pa.int32()), pa.array([blob[i * PART_BYTES : (i + 1) * PART_BYTES] for i in part], pa.binary())]
                yield pa.record_batch(columns, names=["kind", "shard", "at", "v"])

    def parted(df: DataFrame, n: int, keys: list[str], rest: list[str]) -> DataFrame:
        return df.repartition(n, *keys).sortWithinPartitions(*keys, *rest)

    built = parted(dealt.select("kind", "shard", "id", "weight", "v"), 2 * sum(shards.values()), ["kind", "shard"], ["id"])
    graphs = table(built.mapInArrow(build, "kind int, shard int, at int, v binary"), "graphs")

    @sliced
    def ask(batches: Iterable) -> Iterator:
        for _, rows in groupby(lines(batches), lambda r: r[:3]):  # kind, shard, crew
            graph, blob = None, []
            for block, some in groupby(rows, lambda r: r[4]):  # -1, the graph's parts, comes first
                if block < 0:
                    blob += (r[6] for r in some)
                    continue
                if graph is None:
                    if not blob:
                        break
                    whole = b"".join(blob)
                    blob.clear()
                    ids, weight, x, links = pickle.loads(whole)
                    del whole
                    graph = Graph.restored(x, links)
                    del links
                own, v = map(list, zip(*(r[5:] for r in some), strict=True))
                queries, own = unit(v), np.array(own)
                v.clear()
                n, every, root = folded(graph, x, ids, weight, queries, own, threshold)
                far, hit = np.flatnonzero(root != np.arange(len(every))), n > 0
                to = pa.concat_arrays([pa.nulls(int(hit.sum()), pa.int64()), pa.array(every[root[far]], pa.int64())])
                yield pa.record_batch([pa.array(np.r_[own[hit], every[far]], pa.int64()), pa.array(np.r_[n[hit], np.zeros(len(far), np.int64)], pa.int64()), to], names=["id", "n", "to"])

    # a crew of blocks goes past one copy of a shard's graph
    crews = {k: min(blocks[k], max(FEWEST, -(-TASKS // shards[k]))) for k in sizes}
    asks = dealt.select("kind", F.explode(F.sequence(F.lit(0), by(shards) - 1)).alias("shard"), F.pmod("block", by(crews)).cast("int").alias("crew"), F.lit(0).alias("at"), "block", "id", "v")
    kinds = F.create_map(*(F.lit(x) for kv in crews.items() for x in kv))
    shared = graphs.select("kind", "shard", F.explode(F.sequence(F.lit(0), F.element_at(kinds, F.col("kind")) - 1)).alias("crew"), "at", F.lit(-1).alias("block"), F.lit(None).cast("long").alias("id"), "v")
    tasks = 2 * sum(shards[k] * crews[k] for k in sizes)
    met = parted(shared.unionByName(asks), tasks, ["kind", "shard", "crew"], ["block", "at", "id"])
    found = table(met.mapInArrow(ask, "id long, n long, to long"), "found")
    count = found.filter("to is null").groupBy("id").agg(F.sum("n").alias("n"))
    joined = components(found.filter("to is not null").select(F.col("id").alias("a"), F.col("to").alias("b")))
    ends = table(nodes.join(count, "id", "left").join(joined, "id", "left").select("v", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id")), "ends")
    drop([nodes, dealt, graphs, found])
    took = rows.filter("v is not null and vec_id is not null").join(ends, "v").select("vec_id", "n_links", "component_id")
    rest = rows.filter("v is null or vec_id is null").select("vec_id", F.when(F.col("vec_id").isNotNull(), F.lit(0).cast("long")).alias("n_links"), F.col("vec_id").alias("component_id"))
    return took.unionByName(rest).withColumn("kept", F.col("vec_id") == F.col("component_id"))
