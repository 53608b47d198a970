"""SimHash near-duplicates by a binary trie self-join.

Each distinct fingerprint goes, once for each pair of its four 16-bit blocks, to the
trie of those two blocks' values: fingerprints that differ in at most two bits agree
in two blocks at least, so that no link is lost, and a trie holds few but near ones.
A task sorts its fingerprints, which makes every trie node a range of them, and walks
all its tries level by level: pairs of nodes move to pairs of children, a pair of
unequal children costs a bit, and pairs over the error budget are cut off. What
remains at the leaves are the links; a task reports a spanning forest of them.

Defined cases: a null or wordless text has fingerprint zero and links like any other;
rows of one id are separate rows of one node; rows without an id have a fingerprint,
and the component of their class where an id is in it, else null; an empty table gives
none; other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import buffers
from .common import batches_of, bound_batches, bucketed, drop, id_text, sliced, table
from .components import components, spanning
from .nn import hashes, rolled, word_bounds

BLOCKS, BLOCK_BITS = 4, 16
#: Node pairs that are walked at once; more are walked in parts. Pairs of nodes with so few leaf pairs are compared leaf by leaf.
FRONTIER, LEAVES = 1 << 20, 64
#: For similarity: texts whose shingles are counted, counts that are kept, how much further apart a round's pairs of a list are than those of the round before, and pairs of sets in an Arrow batch.
ORDERED, USUAL, STEP, PAIR_ROWS = 20_000, 1 << 17, 64, 64
#: Bits of a set's parities at most.
MARK_BITS = 4096
NAMES = ["token", "id", "n", "place", "other"]


def shingle_hashes(text: str | None, size: int, seed: int) -> np.ndarray:
    """XXH64 of each shingle of the words, repeats included; fewer words than size make one shingle."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and blanks, tabs to carriage returns only
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    k = min(size, len(words)) - 1
    return np.array([xxh64_intdigest(line[i:j], seed) for i, j in zip(starts[: len(words) - k].tolist(), ends[k:].tolist(), strict=True)], np.uint64)


def majority(h: np.ndarray, words: int = 1) -> bytes:
    """The bits set in over half of the hashes, big-endian; further words are of the hashes mixed anew."""
    out = []
    for k in range(words):
        counts = np.zeros(64, np.int64)
        for i in range(0, len(h), 1 << 16):
            g = h[i : i + (1 << 16)]
            if k:
                g = (g + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
                g = (g ^ g >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)
                g ^= g >> np.uint64(30)
            counts += np.unpackbits(g.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.uint32)
        out.append(np.packbits(counts * 2 > len(h)).tobytes())
    return b"".join(out)


def fingerprints(df: DataFrame, size: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a long) per row. No shuffle."""
    bound_batches(df.sparkSession)

    @sliced
    def run(batches: Iterable) -> Iterator:
        for b in batches:
            yield pa.record_batch([b.column("doc_id"), pa.array([int.from_bytes(majority(shingle_hashes(t, size, seed)), "big", signed=True) for t in b.column("text").to_pylist()], pa.int64())], names=["doc_id", "fp"])

    return id_text(df, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def trie_pairs(key: np.ndarray, fp: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Arrays of positions of pairs with equal keys whose fingerprints (unsigned, no repeats within a key) differ in at most budget bits. key and fp are sorted by key, then fingerprint."""
    cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
    lo, hi = np.r_[0, cuts], np.r_[cuts, len(key)]
    keep = hi - lo > 1
    lo, hi = lo[keep], hi[keep]
    todo = [(63, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    ones: dict[int, np.ndarray] = {}
    while todo:
        bit, l1, h1, l2, h2, errors = todo.pop()
        if not len(l1):
            continue
        if bit < 0:
            yield l1, l2
            continue
        if len(l1) > FRONTIER:
            half = len(l1) // 2
            todo += [(bit, *(x[s] for x in (l1, h1, l2, h2, errors))) for s in (slice(half), slice(half, None))]
            continue
        if bit not in ones:
            ones[bit] = np.r_[0, np.cumsum((fp >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)]
        c = ones[bit]
        m1, m2, same = h1 - (c[h1] - c[l1]), h2 - (c[h2] - c[l2]), l1 == l2  # ranges of one depth are the same or apart
        zero, one, cross, back = (l1, m1, l2, m2, errors), (m1, h1, m2, h2, errors), (l1, m1, m2, h2, errors + 1), (m1, h1, l2, m2, errors + 1)
        back = tuple(x[~same] for x in back)
        new = [np.concatenate(x) for x in zip(zero, one, cross, back, strict=True)]
        a, b, x, y, e = new
        keep = (b > a) & (y > x) & (e <= budget) & ~((a == x) & (b - a == 1))
        a, b, x, y, e = (v[keep] for v in new)
        few = (b - a) * (y - x) <= LEAVES
        for part in np.array_split(np.flatnonzero(few), max(1, int(few.sum()) >> 16)):
            n, m = (b - a)[part], (y - x)[part]
            own = np.repeat(np.arange(len(part)), n * m)
            k = np.arange(len(own)) - np.repeat(np.cumsum(n * m) - n * m, n * m)
            i, j = a[part][own] + k // m[own], x[part][own] + k % m[own]
            near = (i < j) & (np.bitwise_count(fp[i] ^ fp[j]) <= budget)
            if near.any():
                yield i[near], j[near]
        todo.append((bit - 1, *(v[~few] for v in (a, b, x, y, e))))


def links(classes: DataFrame, budget: int = 2) -> DataFrame:
    """classes: id, fp, each fingerprint once. Gives a, b: links that span, within each task's tries, all pairs within the budget (at most 2, which the block pairs cover)."""
    if not 0 <= budget <= BLOCKS - 2:
        raise ValueError("pairs of blocks cover at most two differing bits")
    block = [F.shiftrightunsigned("fp", BLOCK_BITS * k).bitwiseAND((1 << BLOCK_BITS) - 1) for k in range(BLOCKS)]
    keys = [(i, j) for i in range(BLOCKS) for j in range(i)]
    dealt = classes.select("id", "fp", F.explode(F.array(*(F.lit(n << 32).bitwiseOR(F.shiftleft(block[i], BLOCK_BITS)).bitwiseOR(block[j]) for n, (i, j) in enumerate(keys)))).alias("key"))

    @sliced
    def run(batches: Iterable) -> Iterator:
        got = [(b.column("key").to_numpy(), b.column("fp").to_numpy(), b.column("id").to_numpy()) for b in batches]
        if not got:
            return
        key, fp, ids = (np.concatenate(x) for x in zip(*got, strict=True))
        del got
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        keep = count[inverse] > 1
        key, fp, ids = key[keep], fp[keep].view(np.uint64), ids[keep]
        order = np.lexsort((fp, key))
        key, fp, ids = key[order], fp[order], ids[order]
        yield spanning(ids, trie_pairs(key, fp, budget)).rename_columns(["a", "b"])

    return dealt.repartition("key").mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, size: int = 3, budget: int = 2, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id per row: fingerprints link at budget or fewer differing bits; a component's id is its smallest doc_id."""
    prints = table(fingerprints(df, size, seed, id_col, text_col), "prints")
    classes = table(prints.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("id")), "classes")
    joined = components(links(classes, budget))
    ends = table(classes.join(joined, "id", "left").select("fp", F.coalesce("component_id", "id").alias("component_id")), "ends")
    drop([classes])
    return prints.join(ends.hint("merge"), "fp", "left").select("doc_id", "fp", "component_id")


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Each text's set of shingles as rising 64-bit hashes: of size words (lower case), or of all where they are fewer."""
    raw, offsets = buffers(column)
    raw = raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32)  # A-Z only
    starts, ends, first = word_bounds(raw, offsets)
    h = hashes(raw, starts, ends)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        yield np.unique(rolled(h[a:b], min(size, b - a))) if b > a else np.zeros(0, np.uint64)


def usual(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes, rising, that several of some 20,000 texts have, and in how many. They only order shingles, so the sample bears on work and not on results."""
    n = max(1, docs.count())
    some = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n // ORDERED))) == 0)

    @sliced
    def each(batches: Iterable) -> Iterator:
        for b in batches:
            yield pa.record_batch([pa.array(np.concatenate([*shingle_sets(b.column("text"), size), np.zeros(0, np.uint64)]).view(np.int64))], names=["h"])

    top = some.mapInArrow(each, "h long").groupBy("h").count().filter("count > 1").orderBy(F.desc("count"), "h").limit(USUAL).toArrow()
    h, count = top.column("h").to_numpy().view(np.uint64), top.column("count").to_numpy()
    order = np.argsort(h)
    return h[order], count[order]


def prefixes(docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """token, id, n, place, group: of each text's n shingles, rarest first, so many that two texts of that Jaccard similarity share one of them. docs: doc_id, text, group."""
    known, times = usual(docs, size)

    @sliced
    def run(batches: Iterable) -> Iterator:
        for part in batches:
            rows: list[np.ndarray] = []
            counts = []
            for h in shingle_sets(part.column("text"), size):
                at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
                seen = np.where(known[at] == h, times[at], 0) if len(known) else np.zeros(len(h), np.int64)
                k = len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1 if len(h) else 0
                rows.append(h[np.lexsort((h, seen))[:k]])
                counts.append(len(h))
            m = [len(r) for r in rows]
            token = np.concatenate([*rows, np.zeros(0, np.uint64)]).view(np.int64)
            place = np.concatenate([*(np.arange(k) for k in m), np.zeros(0, np.int64)])
            own = pa.array(np.repeat(np.arange(len(m)), m))
            made = pa.record_batch([pa.array(token), part.column("doc_id").take(own), pa.array(np.repeat(counts, m), pa.int32()), pa.array(place, pa.int32()), part.column("group").take(own)], names=["token", "id", "n", "place", "group"])
            for i in range(0, made.num_rows, 1 << 17):
                yield made.slice(i, 1 << 17)

    return docs.select("doc_id", "text", "group").mapInArrow(run, "token long, id long, n int, place int, group long")


def parities(column: pa.Array, size: int) -> Iterator[tuple[int, bytes]]:
    """By text, how many shingles its set has, and by bit whether an odd number of them fall on it: about a bit a shingle, a power of two from 64 to MARK_BITS."""
    for h in shingle_sets(column, size):
        m = min(MARK_BITS, max(64, 1 << (max(1, len(h)) - 1).bit_length()))
        at = ((h ^ h >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.int64) & (m - 1)
        yield len(h), np.packbits((np.bincount(at, minlength=m) & 1).astype(np.uint8), bitorder="little").tobytes()


def marks_of(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """id, n, bits: parities() of the docs in ids (doc_id), by id and size of the set; null where one id has several sets of that size."""

    @sliced
    def run(batches: Iterable) -> Iterator:
        for b in batches:
            found = list(parities(b.column("text"), size))
            yield pa.record_batch([b.column("doc_id"), pa.array([n for n, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], names=["id", "n", "bits"])

    chosen = docs.select("doc_id", "text").join(ids.distinct().hint("shuffle_hash"), "doc_id", "left_semi")
    made = chosen.mapInArrow(run, "id long, n int, bits binary")
    return table(made.groupBy("id", "n").agg(F.when(F.count("*") == 1, F.any_value("bits")).alias("bits")), "marks")


class Marks:
    """parities() of rows, for a bound on how much the sets of two rows differ: a shingle of one set only flips a bit, so at least as many shingles differ as bits do."""

    def __init__(self, columns: list[pa.Array], n: np.ndarray) -> None:
        parts = [buffers(c) for c in columns]
        self.n, self.words = n, np.concatenate([np.diff(offsets) for _, offsets in parts]).astype(np.int64) // 8
        self.flat = np.concatenate([np.frombuffer(raw.tobytes(), "<u8") for raw, _ in parts])
        self.start = np.cumsum(self.words) - self.words

    def near(self, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
        """Whether the sets of rows i and j may have that Jaccard similarity; rows without bits may."""
        ok = np.ones(len(i), bool)
        kind = self.words[i] << 32 | self.words[j]
        for k in np.unique(kind).tolist():
            one, two = k >> 32, k & 0xFFFFFFFF
            few = min(one, two)
            part = np.flatnonzero(kind == k)
            for at in np.array_split(part, -(-len(part) * max(one, two) >> 20) or 1) if few else ():
                # bits of a larger mark, folded, are those of a smaller one
                a, b = (np.bitwise_xor.reduce(self.flat[self.start[rows[at]][:, None] + np.arange(m)].reshape(len(at), -1, few), axis=1) for rows, m in ((i, one), (j, two)))
                total = self.n[i[at]].astype(np.int64) + self.n[j[at]]
                ok[at] = np.bitwise_count(a ^ b).sum(1, dtype=np.int64) * (1 + similarity) <= (1 - similarity) * total + 1e-6
        return ok


def listed_pairs(token: np.ndarray, ids: np.ndarray, n: np.ndarray, place: np.ndarray, group: np.ndarray, low: int, high: int, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of pairs of one token, low to under high places apart in its list, of unequal groups, which may reach the similarity if the token is the first they share. All are sorted by token, then id."""
    for gap in range(low, high):
        i = np.flatnonzero(token[gap:] == token[:-gap])
        if not len(i):
            return
        i = i[(group[i] != group[i + gap]) & (ids[i] != ids[i + gap])]
        j = i + gap
        both = np.minimum(n[i] - place[i], n[j] - place[j])
        ok = both * (1 + similarity) >= similarity * (n[i].astype(np.int64) + n[j]) - 1e-6
        yield i[ok], j[ok]


def sets_of(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """doc_id, shingles (the set's hashes, rising, as bytes) of the docs in ids (doc_id)."""

    @sliced
    def run(batches: Iterable) -> Iterator:
        for b in batches:
            yield pa.record_batch([b.column("doc_id"), pa.array([h.tobytes() for h in shingle_sets(b.column("text"), size)], pa.binary())], names=["doc_id", "shingles"])

    chosen = docs.select("doc_id", "text").join(ids.distinct().hint("shuffle_hash"), "doc_id", "left_semi")
    return table(chosen.mapInArrow(run, "doc_id long, shingles binary"), "shingles")


def verified(known: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """Those pairs (a, b) of known (doc_id, shingles) whose sets of shingles have that Jaccard similarity at least."""
    one, two = (known.select(F.col("doc_id").alias(c), F.col("shingles").alias(f"of_{c}")).hint("merge") for c in "ab")

    @sliced
    def compare(batches: Iterable) -> Iterator:
        for b in batches:
            keep = []
            for x, y in zip(b.column("of_a"), b.column("of_b"), strict=True):  # without copies: sets of long texts are large
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = 0
                if min(len(x), len(y)) >= similarity * max(len(x), len(y)) - 1e-9:
                    both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with batches_of(known.sparkSession, PAIR_ROWS):
        return table(pairs.join(one, "a").join(two, "b").mapInArrow(compare, "a long, b long"), "similar")


def similar(df: DataFrame, size: int = 5, similarity: float = 0.8, budget: int = 2, id_col: str = "doc_id", text_col: str = "text", stored: bool = False) -> DataFrame:
    """doc_id, component_id per row: texts link whose shingle sets have that Jaccard similarity or more. No link is lost.

    Texts of equal sets, told by a digest, are one class with one fingerprint. The trie
    self-join finds the classes whose fingerprints are equal or differ in budget bits;
    those whose sets prove similar are joined. Fingerprints of similar texts may differ
    in more bits, so an exact search finds the other links: of each class so many of its
    rarest shingles are listed that similar ones share a listed one, and pairs of a list
    are held against each other by their sets, first neighbours, then those further
    apart, up to the list's length, each pair only if what was verified before does not
    join its two texts already. From the second round on pairs whose sets differ too much by
    their parities (a bit a shingle) aren't compared, so that texts of a long list that are
    not similar cost a count of bits. So a large group of near copies costs few comparisons a
    text, and a rejected pair takes no other pair's place. Rows of one id are one text
    with several sets. stored: df is a table, in buckets of its ids at best, and is read
    in place; else its ids and texts are stored so.
    """
    bound_batches(df.sparkSession)
    docs = id_text(df, id_col, text_col)
    docs = docs if stored else bucketed(docs, "doc_id", "texts")

    @sliced
    def digests(batches: Iterable) -> Iterator:
        for b in batches:
            found = [(blake2b(h.tobytes(), digest_size=16).digest(), int.from_bytes(majority(h), "big", signed=True)) for h in shingle_sets(b.column("text"), size)]
            yield pa.record_batch([b.column("doc_id"), pa.array([d for d, _ in found], pa.binary()), pa.array([f for _, f in found], pa.int64())], names=["doc_id", "digest", "fp"])

    rows = table(docs.mapInArrow(digests, "doc_id long, digest binary, fp long"), "digests")
    classes = table(rows.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("id"), F.min("fp").alias("fp")), "classes")
    of_class = docs.join(classes.select(F.col("id").alias("doc_id")).distinct().hint("shuffle_hash"), "doc_id", "left_semi")
    prints = table(classes.groupBy("fp").agg(F.min("id").alias("id")), "prints")
    equal = classes.select("fp", F.col("id").alias("a")).join(prints.withColumnRenamed("id", "b").hint("merge"), "fp").filter("a != b").select("a", "b")
    pairs = table(links(prints, budget).unionByName(equal).distinct(), "near")
    known = sets_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")), size)
    new = verified(known, pairs, similarity)
    joined = table(components(new), "joined")
    drop([prints, pairs, known, new])

    def meet(low: int, high: int) -> Callable:
        def run(batches: Iterable) -> Iterator:
            """Pairs (id, other), and with other null the lists that later rounds need."""
            got, bits = [], []
            for b in batches:
                if b.num_rows:
                    got.append([b.column(c).to_numpy() for c in ("token", "id", "n", "place", "group")])
                    bits += [b.column("bits")] if "bits" in b.schema.names else []
            if not got:
                return
            token, ids, n, place, group = (np.concatenate(x) for x in zip(*got, strict=True))
            del got
            marks = Marks(bits, n) if bits else None
            del bits
            row = np.lexsort((place, n, ids, token))  # the same in each round
            token, ids, n, place, group = (x[row] for x in (token, ids, n, place, group))

            def only(keep: np.ndarray) -> None:
                nonlocal token, ids, n, place, group, row
                token, ids, n, place, group, row = (x[keep] for x in (token, ids, n, place, group, row))

            _, at, count = np.unique(token, return_inverse=True, return_counts=True)
            split = np.zeros(len(count), bool)
            split[at[1:][(token[1:] == token[:-1]) & (group[1:] != group[:-1])]] = True
            only((split & (count > low))[at])
            seen = np.zeros((0, 2), np.int64)
            for i, j in listed_pairs(token, ids, n, place, group, low, high, similarity):
                if marks:
                    near = marks.near(row[i], row[j], similarity)
                    i, j = i[near], j[near]
                seen = np.r_[seen, np.stack((ids[i], ids[j]), 1)]
                if len(seen) > FRONTIER:
                    seen = np.unique(seen, axis=0)
                    if len(seen) > FRONTIER // 2:
                        yield out(seen)
                        seen = seen[:0]
            yield out(np.unique(seen, axis=0))
            _, at, count = np.unique(token, return_inverse=True, return_counts=True)
            only((count > high)[at])
            for k in range(0, len(token), 1 << 16):
                s = slice(k, k + (1 << 16))
                yield pa.record_batch([pa.array(x[s]) for x in (token, ids, n, place)] + [pa.nulls(len(token[s]), pa.int64())], names=NAMES)

        def out(pairs: np.ndarray) -> pa.RecordBatch:
            m = len(pairs)
            return pa.record_batch([pa.nulls(m, pa.int64()), pa.array(pairs[:, 0]), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int32()), pa.array(pairs[:, 1])], names=NAMES)

        return run

    grouped = of_class.join(joined.select(F.col("id").alias("doc_id"), F.col("component_id").alias("group")).hint("shuffle_hash"), "doc_id", "left")
    posts = prefixes(grouped.withColumn("group", F.coalesce("group", "doc_id")), size, similarity)
    low, high = 1, 4
    old: list[DataFrame] = []
    marks: DataFrame | None = None
    while True:
        met = table(posts.repartition("token").mapInArrow(meet(low, high), "token long, id long, n int, place int, other long"), "met")
        drop(old, collect=False)
        old = [met]
        pairs = table(met.filter("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")).distinct(), "pairs")
        if not pairs.isEmpty():
            known = sets_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")), size)
            new = verified(known, pairs, similarity)
            if not new.isEmpty():
                was, joined = joined, table(components(new.unionByName(joined.select(F.col("id").alias("a"), F.col("component_id").alias("b")))), "joined")
                drop([was], collect=False)
            drop([known, new, pairs])
        else:
            drop([pairs], collect=False)
        lists = met.filter("other is null").select("token", "id", "n", "place")
        if lists.isEmpty():
            break
        low, high = high, high * STEP
        if marks is None:  # those of later rounds are among these
            marks = marks_of(docs, lists.select(F.col("id").alias("doc_id")), size)
        posts = lists.join(joined.hint("merge"), "id", "left").join(marks.hint("merge"), ["id", "n"], "left").select("token", "id", "n", "place", F.coalesce("component_id", "id").alias("group"), "bits")
    ends = table(classes.join(joined, "id", "left").select("digest", F.coalesce("component_id", "id").alias("component_id")), "ends")
    drop([classes, joined, *old] + ([marks] if marks is not None else []) + ([] if stored else [docs]))
    return rows.join(ends.hint("merge"), "digest", "left").select("doc_id", "component_id")
