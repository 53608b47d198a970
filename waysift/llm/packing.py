"""Order-preserving packing of token streams into windows by dynamic programming.

The documents of a partition, in their order, are one stream of tokens, each document
ending with its end id. Windows of at most `size` tokens cut the stream; a window
costs its padding (none where its length is a power of two), and a cut costs nothing
at a document's end, little at a sentence's end and more elsewhere. The least cost up
to each possible cut comes from the least of (cost + position) over the last `size`
tokens, which a monotone queue holds at hand, or from the cuts a power of two before.
A block of documents is solved at a time; its last windows go into the next block.

Defined cases: a null text counts as empty and has its end id only; rows without an id
or with an id seen before are documents of their own; an empty table gives no piece;
other columns of the input are not looked at.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import Encoder, MergeReplay, buffers
from .common import bound_batches, id_text, sliced

SIZE = 1024
#: What a cut costs, in tokens of padding, at a sentence's end and elsewhere.
SENTENCE, TORN = 1, 8
#: Tokens that are solved at a time at least.
BLOCK = 1 << 18


@dataclass
class Tokenizer:
    """Ids as the tokenizers library gives them for a byte-level BPE file without added special tokens, and which ids end a sentence."""

    encoder: Encoder
    ends: np.ndarray


_tokenizers: dict[tuple[str, str], Tokenizer] = {}


def _byte_letters() -> dict[str, int]:
    """The printable characters by which byte-level files write bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def tokenizer(path: str, pattern: str) -> Tokenizer:
    """Of a tokenizers file of byte-level BPE without normalizer."""
    if (path, pattern) not in _tokenizers:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"] or model.get("ignore_merges"):
            raise ValueError("not a byte-level BPE file of the expected kind")
        letters = _byte_letters()
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if t not in specials}
        merges = [tuple(bytes(letters[c] for c in part) for part in (m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        order = [ranks[a + b] for a, b in merges]
        if order != sorted(order):
            raise ValueError("merges aren't in the order of their ids")
        ends = np.zeros(max(*model["vocab"].values(), *specials.values(), 0) + 1, bool)
        ends[[i for t, i in ranks.items() if t.rstrip(b" ")[-1:] in (b".", b"!", b"?", b"\n")]] = True
        _tokenizers[path, pattern] = Tokenizer(Encoder(MergeReplay(ranks, merges), pattern, specials, kept=1_200_000), ends)
    return _tokenizers[path, pattern]


def cuts(n: int, doc_ends: np.ndarray, sentence_ends: np.ndarray, size: int = SIZE, sentence: float = SENTENCE, torn: float = TORN, exact_from: int | None = None) -> list[int]:
    """Ends of the windows of least cost over a stream of n tokens. Possible cuts: documents' and sentences' ends, the stream's end, and a whole window after each of these, or several where no other cut is in reach. A window of a power of two tokens costs no padding from exact_from up, or else a quarter of size."""
    fees = np.full(n + 1, float(torn))
    fees[sentence_ends] = sentence
    fees[doc_ends] = 0
    fees[[0, n]] = 0
    soft_here = np.zeros(n + 1, bool)
    for x in (sentence_ends, doc_ends, [0, n]):
        soft_here[x] = True
    soft = np.flatnonzero(soft_here)
    gap = np.diff(soft)
    steps = np.maximum(1, (gap - 1) // size)
    base = np.repeat(soft[:-1], steps)
    whole = base + size * (1 + np.arange(len(base)) - np.repeat(np.cumsum(steps) - steps, steps))
    here = soft_here.copy()
    here[whole[whole < n]] = True
    at = np.flatnonzero(here)
    number = np.full(n + 1, -1)  # of the cut at a place
    number[at] = np.arange(len(at))
    price, is_soft = fees[at], soft_here[at]
    to, back = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]  # soft cuts, and cuts a power of two before them
    own = number[soft]
    w = max(1, size // 4 if exact_from is None else exact_from)
    w = 1 << (w - 1).bit_length()
    while w <= size:
        j = number[np.maximum(soft - w, 0)]
        ok = (j >= 0) & (soft >= w)
        to.append(own[ok])
        back.append(j[ok])
        w *= 2
    order = np.argsort(np.concatenate(to), kind="stable")
    exact = np.concatenate(back)[order].tolist()
    upto = np.cumsum(np.bincount(np.concatenate(to), minlength=len(at))).tolist()  # by cut, the end of its part of these
    before = number[np.maximum(at - size, 0)].tolist()
    cost, came, pos, fee, soft_at = [0.0], [0], at.tolist(), price.tolist(), is_soft.tolist()
    queue, least, head = [-1, 0], [float("-inf"), 0.0], 1  # cuts with their cost + position, rising in both, after a stop
    for k in range(1, len(pos)):
        p = pos[k]
        if soft_at[k]:
            low = p - size
            while pos[queue[head]] < low:
                head += 1
            frm, best = queue[head], least[head] + size - p
            for f in exact[upto[k - 1] : upto[k]]:
                if cost[f] < best:
                    frm, best = f, cost[f]
        else:  # only as the end of a whole window
            frm = before[k]
            best = cost[frm]
        best += fee[k]
        cost.append(best)
        came.append(frm)
        best += p
        while least[-1] >= best:
            queue.pop()
            least.pop()
        head = min(head, len(queue))
        queue.append(k)
        least.append(best)
    out, k = [], len(pos) - 1
    while k:
        out.append(pos[k])
        k = came[k]
    return out[::-1]


class Packer:
    """Cuts blocks of one stream; holds back what the next block may pack better."""

    def __init__(self, first: int, size: int, sentence: float, torn: float, ends: np.ndarray) -> None:
        self.next, self.size, self.sentence, self.torn, self.ends = first, size, sentence, torn, ends
        self.ids, self.docs = np.zeros(0, "<u4"), []  # docs: id, start of what is here, length of that, whole length

    def add(self, doc_ids: list, ids: np.ndarray, offsets: np.ndarray) -> None:
        self.docs += [(d, 0, n, n) for d, n in zip(doc_ids, np.diff(offsets).tolist(), strict=True)]
        self.ids = np.concatenate((self.ids, ids)) if len(self.ids) else ids

    def flush(self, last: bool) -> tuple:
        """Columns of pieces."""
        n, sizes = len(self.ids), np.array([d[2] for d in self.docs], np.int64)
        upto = np.cumsum(sizes)
        where = np.flatnonzero(self.ends[self.ids]) + 1
        ends = cuts(n, upto, where, self.size, self.sentence, self.torn, 1) if n else []
        if not last:
            ends = ends[: max(0, len(ends) - 2)]
        done = ends[-1] if ends else 0
        # pieces lie between the cuts of windows and documents
        edges = np.union1d(np.array([0, *ends], np.int64), upto[upto < done])
        a, b = edges[:-1], edges[1:]
        seq = np.searchsorted(np.array(ends, np.int64), a, "right")
        first = np.array([0, *ends], np.int64)[seq]
        doc = np.searchsorted(upto, a, "right")
        begin = upto - sizes
        held = np.array([d[1] for d in self.docs], np.int64)
        data = memoryview(self.ids.tobytes())
        crc = [zlib.crc32(data[4 * i : 4 * j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
        total = np.array([d[3] for d in self.docs], np.int64)
        out = [self.docs[k][0] for k in doc.tolist()], held[doc] + a - begin[doc], b - a, np.array(crc, np.int64), total[doc], self.next + seq, a - first, self.ids[:done]
        self.next += len(ends)
        k = int(np.searchsorted(upto, done, "right"))
        rest = self.docs[k:]
        if rest and done > begin[k]:
            d, s, m, t = rest[0]
            gone = int(done - begin[k])
            rest[0] = d, s + gone, m - gone, t
        self.docs, self.ids = rest, self.ids[done:].copy()
        return out


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
SCHEMA = ", ".join(f"{n} long" for n in NAMES)


def pack(df: DataFrame, path: str, pattern: str, end_id: int = 0, size: int = SIZE, sentence: float = SENTENCE, torn: float = TORN, block: int = BLOCK, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, with_ids: ids (array of int). Each input partition packs its own documents, without a shuffle; its number and the window's make the sequence_id."""
    bound_batches(df.sparkSession)

    @sliced
    def run(batches: Iterable) -> Iterator:
        t = tokenizer(path, pattern)
        packer = Packer(TaskContext.get().partitionId() << 40, size, sentence, torn, t.ends)

        def rows(last: bool) -> pa.RecordBatch:
            *cols, ids = packer.flush(last)
            made = [pa.array(c, pa.int64()) for c in cols]
            if with_ids:
                made.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(cols[2])], pa.int32()), pa.array(ids.astype(np.int32))))
            return pa.record_batch(made, names=[*NAMES, "ids"][: len(made)])

        for b in batches:
            raw, offsets = buffers(b.column("text"))
            ids, at = t.encoder.block(raw, offsets)
            n = np.diff(at)
            out = np.full(len(ids) + len(n), end_id, "<u4")  # an end id after each document
            out[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
            packer.add(b.column("doc_id").to_pylist(), out, at + np.arange(len(at)))
            if len(packer.ids) >= block:
                yield rows(False)
        yield rows(True)

    return id_text(df, id_col, text_col).mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))
