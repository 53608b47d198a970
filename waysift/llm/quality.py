"""Text quality by attention-based multiple-instance learning.

A document is a bag of passages of 64 words; all its passages count. A passage is
described by what kinds of bytes it has and in which order, how its words repeat, and
their lengths and cases; an encoder layer maps that to a hidden vector. Gated
attention weighs the passages, and the weighted sum is scored. Only documents have
labels; encoder, attention and score are trained together on a bounded sample.

Defined cases: a null, empty or wordless text is a bag of one empty passage and gets
that bag's score; repeated rows and null ids are separate rows; an empty table gives
none; with no labels, or one label only, every score is the share of label 1 (0.5
without any); other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import buffers
from .common import bound_batches, fold, id_text, sliced, training_sample
from .nn import Adam, hashes, shift, sigmoid, word_bounds

WORDS = 64
#: The bound of the training sample, in labelled documents.
TRAIN_TEXTS = 4000
HIDDEN, GATE = 24, 12
_MARKS = b".,!?|#$%&*:;-=<>/\\@()[]{}\"'"


def _kinds() -> np.ndarray:
    """Lower case, upper case, digit, blank, line break, beyond ASCII, other, and the marks in five groups and alone."""
    kind = np.full(256, 6, np.int64)
    kind[97:123], kind[65:91], kind[48:58], kind[32], kind[9:14], kind[128:] = 0, 1, 2, 3, 4, 5
    for k, c in enumerate(_MARKS):
        kind[c] = 7 + min(k, 12)
    return kind


KIND = _kinds()
KINDS = int(KIND.max()) + 1
FEATURES = KINDS * KINDS + 10


def passages(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features (passages x FEATURES) of UTF-8 texts raw[offsets[k]:offsets[k + 1]], and by text where its passages start."""
    starts, ends, first = word_bounds(raw, offsets)
    n = np.diff(first)
    bags = np.maximum(1, -(-n // WORDS))
    base = np.r_[0, np.cumsum(bags)]
    doc = np.repeat(np.arange(len(n)), n)
    own = base[doc] + (np.arange(len(starts)) - first[doc]) // WORDS
    p = int(base[-1])
    count = np.bincount(own, minlength=p).astype(np.float64)
    share = lambda w: np.bincount(own, w, p) / np.maximum(count, 1)
    x = np.zeros((p, FEATURES), np.float32)
    if len(starts):
        new = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        begin = np.where(new == first[doc[new]], offsets[doc[new]], starts[new])  # what stands before a text's first word is of its first passage
        at = np.zeros(len(raw), np.int64)
        at[begin] = np.diff(np.r_[0, own[new]])
        at = np.cumsum(at)  # a byte's passage: that of the last word begun
        inside = np.repeat(n > 0, np.diff(offsets))[:-1]  # pairs of bytes of one text that has words
        inside[np.unique(offsets[(offsets > 0) & (offsets < len(raw))]) - 1] = False
        kind = KIND[raw]
        pair = at[:-1] * (KINDS * KINDS) + kind[:-1] * KINDS + kind[1:]
        got = np.bincount(pair[inside], minlength=p * KINDS * KINDS).reshape(p, -1)
        x[:, : KINDS * KINDS] = np.sqrt(got / np.maximum(got.sum(1, keepdims=True), 1))
        h = hashes(raw, starts, ends)
        size = (ends - starts).astype(np.float64)
        same = lambda k: np.r_[np.zeros(min(k, len(h)), bool), (h[k:] == h[:-k]) & (doc[k:] == doc[:-k])]
        upper = np.r_[0, np.cumsum(kind == 1)]
        low = np.r_[0, np.cumsum(kind == 0)]
        kinds = np.zeros(len(h))
        kinds[_first_of(own, h)] = 1
        mean = share(size)
        stats = share(same(1)), share(same(2)), share(same(4)), share(kinds), mean / 10, np.sqrt(np.maximum(share(size * size) - mean**2, 0)) / 10, share((upper[ends] - upper[starts]) > (low[ends] - low[starts])), share(size > 20), share(size == 1), np.minimum(count, WORDS) / WORDS
        x[:, KINDS * KINDS :] = np.stack(stats, 1)
    return x, base


def _first_of(own: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Positions of the first word of each kind in each passage."""
    order = np.lexsort((np.arange(len(h)), h, own))
    o, v = own[order], h[order]
    return order[np.r_[True, (o[1:] != o[:-1]) | (v[1:] != v[:-1])]]


class Model:
    def __init__(self, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        make = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.mean, self.scale = np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32)
        self.p = {"W": make(FEATURES, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": make(HIDDEN, GATE), "U": make(HIDDEN, GATE), "a": make(GATE, 1), "o": make(HIDDEN, 1), "c": np.zeros(1, np.float32)}
        self.shift, self.constant = 0.0, None

    def logits(self, x: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, tuple]:
        """By bag; x is centred and scaled already."""
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        v, u = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
        e = (v * u) @ p["a"][:, 0]
        n = np.diff(base)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, base[:-1]), n))
        w = e / np.repeat(np.add.reduceat(e, base[:-1]), n)
        z = np.add.reduceat(h * w[:, None], base[:-1], axis=0)
        return z @ p["o"][:, 0] + p["c"][0], (h, v, u, w, z, n)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) * self.scale

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(offsets) - 1, self.constant)
        x, base = passages(raw, offsets)
        return sigmoid(self.logits(self.scaled(x), base)[0].astype(np.float64) + self.shift)


def fit(raw: np.ndarray, offsets: np.ndarray, labels: np.ndarray, at: float = 0.3, epochs: int = 40, batch: int = 64, seed: int = 5) -> Model:
    """at: the score that shall separate the labels best. A fifth of the texts set that point and are not trained on."""
    model, rng = Model(seed), np.random.default_rng(seed)
    if not len(labels) or labels.min() == labels.max():
        model.constant = float(labels.mean()) if len(labels) else 0.5
        return model
    parts = [passages(raw[offsets[i] : offsets[min(i + 200, len(labels))]], offsets[i : i + 201] - offsets[i]) for i in range(0, len(labels), 200)]
    base = np.r_[0, np.cumsum(np.concatenate([np.diff(b) for _, b in parts]))]
    x = np.concatenate([p for p, _ in parts])
    del parts
    model.mean = x.mean(0)
    model.scale = 1 / (np.sqrt(np.maximum(np.einsum("ij,ij->j", x, x) / len(x) - model.mean**2, 0)) + 0.02)
    x -= model.mean
    x *= model.scale
    order = rng.permutation(len(labels))
    check, own = order[: len(order) // 5], order[len(order) // 5 :]
    if len(set(labels[check].tolist())) < 2 or len(set(labels[own].tolist())) < 2:
        check = own = order
    share = labels[own].mean()
    weight = np.where(labels == 1, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6))
    p, opt = model.p, Adam(model.p)

    def some(docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = base[docs + 1] - base[docs]
        upto = np.r_[0, np.cumsum(n)]
        return x[np.repeat(base[docs] - upto[:-1], n) + np.arange(upto[-1])], upto

    for _ in range(epochs):
        rng.shuffle(own)
        for i in range(0, len(own), batch):
            docs = own[i : i + batch]
            bx, bb = some(docs)
            z, (h, v, u, w, bag, n) = model.logits(bx, bb)
            g = ((sigmoid(z) - labels[docs]) * weight[docs] / len(docs)).astype(np.float32)
            gz = np.repeat(g, n)[:, None] * p["o"][:, 0]
            ga = (gz * h).sum(1)
            ge = w * (ga - np.repeat(np.add.reduceat(w * ga, bb[:-1]), n))
            gv, gu = ge[:, None] * p["a"][:, 0] * u * (1 - v * v), ge[:, None] * p["a"][:, 0] * v * u * (1 - u)
            gh = (gz * w[:, None] + gv @ p["V"].T + gu @ p["U"].T) * (1 - h * h)
            opt.step({"W": bx.T @ gh, "b": gh.sum(0), "V": h.T @ gv, "U": h.T @ gu, "a": ((v * u) * ge[:, None]).sum(0)[:, None], "o": (bag * g[:, None]).sum(0)[:, None], "c": g.sum(keepdims=True)})
    model.shift = shift(model.logits(*some(check))[0].astype(np.float64), labels[check], at)
    return model


def train(docs: DataFrame, labels: DataFrame, label_col: str, mod: int, but: int, n: int = TRAIN_TEXTS, id_col: str = "doc_id", text_col: str = "text", **how) -> Model:
    """Fits on at most n labelled documents whose crc32(doc_id) mod mod is not but."""
    rows = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("label")).filter((fold("doc_id", mod) != but) & labels[label_col].isNotNull())
    got = training_sample(rows, id_text(docs, id_col, text_col), n)
    return fit(*buffers(got.column("text").combine_chunks()), got.column("label").to_numpy().astype(np.float64), **how)


def score(df: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", also: list[str] = ()) -> DataFrame:
    """doc_id, score per row, by any model with scores(raw, offsets); with also, the text and these columns too. No shuffle; the model's size is fixed."""
    bound_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", *(["text", *also] if also else [])]
    given = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"), *(df[c] for c in also))

    @sliced
    def run(batches: Iterable) -> Iterator:
        for b in batches:
            for i in range(0, b.num_rows, 200):
                part = b.slice(i, 200)
                yield pa.record_batch([*(part.column(n) for n in names), pa.array(shared.value.scores(*buffers(part.column("text"))), pa.float64())], names=[*names, "score"])

    kinds = dict(given.dtypes)
    return given.mapInArrow(run, ", ".join(f"`{n}` {kinds[n]}" for n in names) + ", score double")
