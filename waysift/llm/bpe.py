"""Byte-level BPE encoding and decoding by corpus-level merge replay.

A block of the corpus (an Arrow batch of documents) is cut into chunks, the
distinct chunks into words, and the distinct words that are new are laid end to
end as byte symbols. An inverted index from token pair (by the rank of the pair's
merge) to symbol positions then replays the merges in rank order over all words
at once; a merge updates only the two neighbours of its position. Documents are
put together from the words' ids.

Defined cases: a null text counts as empty; an empty text has no ids; repeated
rows, null ids and ties give a row each; an empty table gives none; other columns
of the input, whatever their names, are not looked at.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, id_text, sliced

#: The bound of what a Python worker remembers between batches, in words and chunks; beyond it starts anew.
KEPT = 600_000
#: Whether a unit is surely one word: a blank or none, then letters, digits or signs only.
PLAIN = re.compile(rb" ?(?:(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[0-9]+|[!-&(-/:-@\[-`{-~]+)").fullmatch


class MergeReplay:
    """Encodes blocks of distinct words by ranks {bytes: id}.

    The inverted index goes from a window of merge ranks to the positions whose pair
    has such a rank. The lowest window is served first; of each word it takes the pair
    of lowest rank, at the leftmost of equals, and puts the word's others back, so
    every word sees its merges in exact rank order while all words move together. In
    blocks with long words a pass merges all places of a word's lowest rank that don't
    overlap, from the left, where that rank's token can't make a pair of lower rank;
    one place a pass would take a long word time that grows with its square.
    """

    WINDOW, LONG = 512, 1024  # ranks; bytes of a word that counts as long
    NONE = 2**31 - 1  # the rank of a pair that doesn't merge

    def __init__(self, ranks: dict[bytes, int], merges: list[tuple[bytes, bytes]] | None = None) -> None:
        """merges: the pairs that merge, where not all pairs that make a token do; whole words then need merges too."""
        self.ranks, self.whole = ranks, ranks if merges is None else {}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        if merges is None:
            merges = [(t[:k], t[k:]) for t in ranks for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        pairs = sorted((ranks[a] << 32 | ranks[b], ranks[a + b]) for a, b in merges)
        self.keys, self.vals = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self.vals = self.vals.astype(np.int32)
        one, two = self.keys >> 32, self.keys & 0xFFFFFFFF
        self.early = np.zeros(int(max(ranks.values())) + 1, bool)  # tokens that are part of a token of lower rank
        for part in (one, two):
            self.early[part[self.vals <= part]] = True
        every = np.arange(256)
        self.of_bytes = self.of(np.repeat(self.single, 256), np.tile(self.single[every], 256))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merges' ranks of pairs of tokens."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.vals[at], self.NONE)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Each word's ids, packed as little-endian unsigned 32-bit integers."""
        whole, none, window = self.whole, self.NONE, self.WINDOW
        out = [struct.pack("<I", whole[w]) if w in whole else b"" for w in words]
        todo = [k for k, w in enumerate(words) if w and not out[k]]
        if not todo:
            return out
        sizes = np.array([len(words[k]) for k in todo])
        long = sizes.max() > self.LONG
        raw = np.frombuffer(b"".join(words[k] for k in todo), np.uint8)
        n, ends = len(raw), np.cumsum(sizes)
        starts = ends - sizes
        sym, word = self.single[raw], np.repeat(np.arange(len(todo), dtype=np.int32), sizes)
        left, right = np.arange(-1, n - 1, dtype=np.int32), np.arange(1, n + 1, dtype=np.int32)
        left[starts] = right[ends - 1] = -1
        rank = np.full(n, none, np.int32)  # of the pair that starts at a position
        rank[:-1] = self.of_bytes[raw[:-1].astype(np.int32) * 256 + raw[1:]]
        rank[ends - 1] = none
        index: dict[int, list[np.ndarray]] = {}
        ready: list[int] = []

        def put(at: np.ndarray) -> None:
            at = at[rank[at] != none]
            if len(at):
                w = rank[at] // window
                order = np.argsort(w, kind="stable")
                at, w = at[order], w[order]
                cuts = np.flatnonzero(w[1:] != w[:-1]) + 1
                for part, k in zip(np.split(at, cuts), w[np.r_[0, cuts]].tolist(), strict=True):
                    if k not in index:
                        index[k] = []
                        heappush(ready, k)
                    index[k].append(part)

        put(np.arange(n, dtype=np.int32))
        while ready:
            k = heappop(ready)
            parts = index.pop(k)
            at = np.sort(np.concatenate(parts)) if len(parts) > 1 else np.sort(parts[0])
            at = at[rank[at] // window == k]  # the others were merged away or have another rank by now
            if not len(at):
                continue
            if long:
                at = np.unique(at)
            order = rank[at].astype(np.int64) << 32 | at
            first = np.r_[0, np.flatnonzero(np.diff(word[at])) + 1]
            best = np.minimum.reduceat(order, first)
            every = np.repeat(best, np.diff(np.r_[first, len(at)]))
            if long:
                take = (order == every) | (order >> 32 == every >> 32) & ~self.early[rank[at]]
                some = np.flatnonzero(take)
                laps = np.r_[False, right[at[some[:-1]]] == at[some[1:]]]  # over the place before
                begin = np.maximum.accumulate(np.where(laps, 0, np.arange(len(some))))
                take[some[(np.arange(len(some)) - begin) % 2 == 1]] = False
                rest, i = at[~take], at[take]
            else:
                rest, i = at[order != every], (best & 0xFFFFFFFF).astype(np.int32)
            r, j = rank[i], right[i]
            after = right[j]
            sym[i], sym[j], rank[i], rank[j], right[i] = r, -1, none, none, after
            has = after >= 0
            ia, aa = i[has], after[has]
            left[aa] = ia
            before = left[i]  # now, as the merge before may end there
            rank[ia] = self.of(r[has], sym[aa])
            has = before >= 0
            bb = before[has]
            rank[bb] = self.of(sym[bb], r[has])
            put(np.concatenate((rest, ia, bb)))
        stay = sym >= 0
        ids = sym[stay].astype("<u4").tobytes()
        upto = np.cumsum(np.add.reduceat(stay, starts, dtype=np.int64)) * 4
        for k, a, b in zip(todo, [0, *upto[:-1].tolist()], upto.tolist(), strict=True):
            out[k] = ids[a:b]
        return out


def white(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By byte of a UTF-8 text: whether a white-space character starts there, and whether one ends there."""
    starts = (raw == 32) | ((raw >= 9) & (raw <= 13)) | ((raw >= 28) & (raw <= 31))
    ends = starts.copy()
    wide = np.flatnonzero((raw == 0xC2) | ((raw >= 0xE1) & (raw <= 0xE3)))
    if len(wide):
        pad = np.r_[raw, np.zeros(2, np.uint8)]
        a, b, c = pad[wide], pad[wide + 1], pad[wide + 2]
        two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
        three = ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80)) | ((a == 0xE2) & (b == 0x81) & (c == 0x9F)) | ((a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)))
        starts[wide[two | three]] = True
        ends[wide[two] + 1] = True
        ends[wide[three] + 2] = True
    return starts, ends


#: Classes of bytes: letters and digits of ASCII and Latin-1 (whose lead byte is C3), other signs, and what the word pattern treats in its own ways.
_LETTER, _DIGIT, _SIGN, _BLANK, _BREAK, _ODD = range(6)
_CLASS = np.full(256, _ODD, np.uint8)
_CLASS[33:127] = _SIGN
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[32], _CLASS[9:14], _CLASS[39] = _BLANK, _BREAK, _ODD


def units(raw: np.ndarray, offsets: np.ndarray, whole: list[int]) -> np.ndarray:
    """Where the units start of the texts raw[offsets[k]:offsets[k + 1]]: words of the word pattern where bytes alone tell them, else chunks of several words.

    A chunk starts at each text and before each single blank between two characters
    that aren't white space; the pattern never matches across such a place. In chunks
    of plain letters, digits, signs and single line breaks the words are the runs of a
    class, the leading blank with the first; a chunk with anything else, or with a
    position that whole names, stays whole.
    """
    n = len(raw)
    starts, ends = white(raw)
    last = np.zeros(n + 1, bool)
    last[offsets] = True
    at = np.flatnonzero(raw == 32)
    at = at[(at > 0) & (at < n - 1)]
    mark = np.zeros(n + 1, bool)
    mark[at[~ends[at - 1] & ~starts[at + 1] & ~last[at + 1]]] = True
    mark |= last
    mark[n] = False
    chunk = np.flatnonzero(mark)
    kind = _CLASS[raw]
    lead = np.flatnonzero(raw == 0xC3)
    if len(lead):
        tail = np.r_[raw, np.uint8(0)][lead + 1]
        fine = lead[(tail != 0x97) & (tail != 0xB7)]
        kind[fine] = kind[fine + 1] = _LETTER
    odd = kind == _ODD
    odd[whole] = True
    odd[1:] |= ends[:-1] & starts[1:]  # two white-space characters
    odd[:-1] |= odd[1:] & starts[:-1]
    blank = np.flatnonzero(kind == _BLANK)
    odd[blank[~mark[blank]]] = True  # a blank inside a chunk
    odd[blank[last[blank + 1]]] = True
    odd[blank[last[blank]]] |= starts[np.minimum(blank[last[blank]] + 1, n - 1)]
    plain = np.add.reduceat(odd, chunk, dtype=np.int64) == 0
    cut = np.zeros(n, bool)
    cut[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _BREAK)
    cut[1:] &= kind[:-1] != _BLANK
    cut &= np.repeat(plain, np.diff(np.r_[chunk, n]))
    mark[:n] |= cut
    return np.flatnonzero(mark)


_POWER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def distinct(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the byte strings raw[starts[k]:ends[k]]: positions of one of each kind, and each one's kind. Kinds are found by a hash and held against the bytes; where a hash fails, strings of one hash count as so many kinds."""
    power = np.full(len(raw) + 1, _POWER)
    power[0] = 1
    np.cumprod(power, out=power)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:-1], out=sums[1:])
    size = (ends - starts).astype(np.uint64)
    inverse = np.full(len(raw) + 1, _INVERSE)
    inverse[0] = 1
    np.cumprod(inverse, out=inverse)
    h = (sums[ends] - sums[starts]) * inverse[starts]
    h ^= size * np.uint64(0xD6E8FEB86659FD93)
    _, first, kind = np.unique(h, return_index=True, return_inverse=True)
    n = ends - starts
    twin = starts[first][kind]
    bad = n != n[first][kind]
    todo = np.flatnonzero(~bad & (twin != starts))
    total = np.cumsum(n[todo])
    i = 0
    while i < len(todo):  # a few million bytes at a time
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + (1 << 22), "right")))
        k = todo[i:j]
        step = np.arange(n[k].sum()) - np.repeat(np.cumsum(n[k]) - n[k], n[k])
        odd = raw[np.repeat(starts[k], n[k]) + step] != raw[np.repeat(twin[k], n[k]) + step]
        bad[k[np.unique(np.repeat(np.arange(len(k)), n[k])[odd])]] = True
        i = j
    wrong = np.flatnonzero(bad)
    kind = kind.copy()
    kind[wrong] = len(first) + np.arange(len(wrong))
    return np.r_[first, wrong], kind


def gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[starts[k]:starts[k] + sizes[k]] of all k, one after another."""
    ends = np.cumsum(sizes)
    return values[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


class Encoder:
    """Blocks of whole texts to ids, with the chunks and words that the worker has already seen. specials: strings that are one token wherever they stand."""

    def __init__(self, replay: MergeReplay, pattern: str, specials: dict[str, int] | None = None, kept: int = KEPT) -> None:
        import regex

        self.kept = kept
        self.replay, self.words_in, self.specials = replay, regex.compile(pattern).findall, specials or {}
        self.special = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")").split if self.specials else None
        self.own = {s.encode(): struct.pack("<I", i) for s, i in self.specials.items()}
        self.known = dict(self.own)  # ids by word or chunk

    def cut(self, chunk: str) -> list[str]:
        if self.special is None or not any(s in chunk for s in self.specials):
            return self.words_in(chunk)
        return [w for k, part in enumerate(self.special(chunk)) for w in ([part] if k % 2 else self.words_in(part))]

    def learn(self, fresh: list[bytes]) -> None:
        simple, others = [], []
        for c in fresh:
            (simple if PLAIN(c) else others).append(c)
        found = [(c, [w.encode() for w in self.cut(c.decode())]) for c in others]
        new = list({w for _, x in found for w in x}.difference(self.known, simple))
        new += simple
        self.known.update(zip(new, self.replay.encode(new), strict=True))
        self.known.update([(c, b"".join(map(self.known.__getitem__, x))) for c, x in found])

    def block(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the UTF-8 texts raw[offsets[k]:offsets[k + 1]], one after another, and each text's offset there."""
        if not len(raw):
            return np.zeros(0, "<u4"), np.zeros(len(offsets), np.int64)
        if len(self.known) > self.kept:
            self.known = dict(self.own)
        data = raw.tobytes()
        starts = units(raw, offsets, [m.start() for s in self.own for m in re.finditer(re.escape(s), data)])
        ends = np.r_[starts[1:], len(raw)]
        first, kind = distinct(raw, starts, ends)
        own = [data[i:j] for i, j in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        known = self.known
        self.learn([c for c in dict.fromkeys(own) if c not in known])
        coded = [known[c] for c in own]
        sizes = np.array([len(c) for c in coded], np.int64) // 4
        ids = gather(np.frombuffer(b"".join(coded), "<u4"), (np.cumsum(sizes) - sizes)[kind], sizes[kind])
        upto = np.r_[0, np.cumsum(sizes[kind])]
        return ids, upto[np.searchsorted(starts, offsets)]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a string or binary column; nulls are empty."""
    column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def binary(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column of values' bytes; offsets in bytes."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_encoders: dict[tuple[str, str], Encoder] = {}
_tables: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def encoder(path: str, pattern: str) -> Encoder:
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(MergeReplay(load_ranks(path)), pattern)
    return _encoders[path, pattern]


def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes, and by id where they start and how many they are (-1: no such id)."""
    if path not in _tables:
        by_id = sorted((i, t) for t, i in load_ranks(path).items())
        sizes, starts = np.full(by_id[-1][0] + 1, -1, np.int64), np.zeros(by_id[-1][0] + 1, np.int64)
        at = np.array([i for i, _ in by_id])
        sizes[at] = [len(t) for _, t in by_id]
        starts[at] = np.cumsum(sizes[at]) - sizes[at]
        _tables[path] = np.frombuffer(b"".join(t for _, t in by_id), np.uint8), starts, sizes
    return _tables[path]


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, ids (binary: little-endian unsigned 32-bit integers, as token files hold them). No shuffle. ranks_path is a file that every executor has."""
    bound_batches(df.sparkSession)

    @sliced
    def run(batches: Iterable) -> Iterator:
        e = encoder(ranks_path, pattern)
        for b in batches:
            ids, offsets = e.block(*buffers(b.column("text")))
            yield pa.record_batch([b.column("doc_id"), binary(ids, offsets * 4)], names=["doc_id", "ids"])

    return id_text(df, id_col, text_col).mapInArrow(run, "doc_id long, ids binary")


def decode(df: DataFrame, ranks_path: str) -> DataFrame:
    """A row per row of encode(): doc_id, ids, decoded (binary: the bytes that the ids stand for; null ids: empty). An id that the ranks don't have is an error."""
    bound_batches(df.sparkSession)

    @sliced
    def run(batches: Iterable) -> Iterator:
        data, starts, sizes = token_bytes(ranks_path)
        for b in batches:
            raw, offsets = buffers(b.column("ids"))
            ids = raw.view("<u4") if raw.flags.aligned else raw.copy().view("<u4")
            if len(ids) and (int(ids.max()) >= len(sizes) or (sizes[ids] < 0).any()):
                raise ValueError("an id that the ranks don't have")
            upto = np.r_[0, np.cumsum(sizes[ids])]
            yield pa.record_batch([b.column("doc_id"), b.column("ids"), binary(gather(data, starts[ids], sizes[ids]), upto[offsets // 4])], names=["doc_id", "ids", "decoded"])

    return df.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def digest(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of decode()'s rows, by built-in functions."""
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
