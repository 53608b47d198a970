"""Toxicity by a bidirectional gated recurrent network over overlapping windows.

A text is its runs of letters, lower case. A word enters the network by a learned
vector of its own, the mean of learned vectors of its character n-grams, and how
strongly the word and its n-grams went with toxic texts in training. Two gated
recurrent layers read each window of 32 words forwards and backwards, attention pools
their states, and a text's score is that of its highest window; windows overlap by
half and cover the whole text. Trained in numpy on a bounded sample: a text's label is
put on its highest window, anew in each epoch.

Defined cases: a null, empty or letterless text is one empty window and gets that
window's score; repeated rows and null ids are separate rows; an empty table gives
none; with no labels, or one label only, every score is the share of label 1 (0.5
without any); other columns of the input are not looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import buffers, gather
from .common import fold, id_text, training_sample
from .nn import Adam, hashes, shift, sigmoid

WINDOW, STEP = 32, 16
#: The bound of the training sample, in labelled texts of each label.
TRAIN_TEXTS = 2500
#: Sizes of the hashed tables, of a state, and of a learned vector.
ODDS, VECTORS, STATE, SIDE = 1 << 18, 1 << 14, 8, 4
GRAMS = 3, 4, 5, 6
#: Of learned vectors, in steps of the network's rate.
RATE = 3
INPUT = 2 * SIDE + 4


def _lower() -> np.ndarray:
    """By byte: letters of ASCII as lower case, bytes beyond ASCII as they are, else 0."""
    low = np.zeros(256, np.uint8)
    low[97:123] = low[65:91] = np.arange(97, 123)
    low[128:] = np.arange(128, 256)
    return low


LOWER = _lower()


class Words:
    """The words of a block of UTF-8 texts, and its distinct words' table rows."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray) -> None:
        low = LOWER[raw]
        wide = np.flatnonzero(raw[:-1] == 0xC3) + 1
        wide = wide[(raw[wide] >= 0x80) & (raw[wide] <= 0x9E) & (raw[wide] != 0x97)]
        low[wide] += 0x20  # capitals of Latin-1
        ink = low > 0
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        prev = np.r_[False, ink[:-1]]
        starts = np.flatnonzero(ink & (~prev | edge[:-1]))
        ends = np.flatnonzero(np.r_[ink[:-1] & (~ink[1:] | edge[1:-1]), ink[-1:]]) + 1
        self.first = np.searchsorted(starts, offsets)
        h = hashes(low, starts, ends)
        kinds, one, self.kind = np.unique(h, return_index=True, return_inverse=True)
        self.odds_row = (kinds % np.uint64(ODDS)).astype(np.int64)
        # each kind between two marks, and its n-grams
        a, n = starts[one], (ends - starts)[one]
        upto = np.r_[0, np.cumsum(n + 2)]
        text = np.ones(int(upto[-1]), np.uint32)
        text[np.arange(int(n.sum())) + np.repeat(1 + 2 * np.arange(len(n)), n)] = gather(low, a, n)
        owner = np.repeat(np.arange(len(n), dtype=np.int32), n + 2)
        rows, owners = [], []
        code = text.astype(np.uint64)
        for k in range(2, max(GRAMS) + 1):
            code = code[: len(text) - k + 1] * np.uint64(0x9E3779B97F4A7C15) + text[k - 1 :].astype(np.uint64) if len(text) >= k else code[:0]
            if k in GRAMS:
                own = owner[: len(code)]
                inside = own == owner[k - 1 :]
                g = code[inside] * np.uint64(0xD6E8FEB86659FD93)
                rows.append(((g ^ g >> np.uint64(32)) % np.uint64(ODDS)).astype(np.int32))
                owners.append(own[inside])
        rows, owners = np.concatenate(rows), np.concatenate(owners)
        order = np.argsort(owners, kind="stable")
        self.gram_row, owners = rows[order], owners[order]
        self.grams = np.bincount(owners, minlength=len(n))  # three at least
        self.gram_first = np.cumsum(self.grams) - self.grams

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Words' kinds by window (-1: none), and each text's first window."""
        n = np.diff(self.first)
        count = np.maximum(1, -(-(n - WINDOW) // STEP) + 1)
        upto = np.r_[0, np.cumsum(count)]
        begin = np.repeat(self.first[:-1] - STEP * upto[:-1], count) + STEP * np.arange(upto[-1])
        at = begin[:, None] + np.arange(WINDOW)
        out = at < np.repeat(self.first[1:], count)[:, None]
        return np.where(out, self.kind[np.where(out, at, 0)] if len(self.kind) else 0, -1), upto


class Model:
    def __init__(self, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        make = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.word_odds, self.gram_odds = np.zeros(ODDS, np.float32), np.zeros(ODDS, np.float32)
        self.p = {"word": 0.02 * rng.standard_normal((VECTORS, SIDE)).astype(np.float32), "gram": 0.02 * rng.standard_normal((VECTORS, SIDE)).astype(np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": make(INPUT, 3 * STATE), f"B{d}": np.zeros(3 * STATE, np.float32), f"U{d}": make(STATE, 2 * STATE), f"C{d}": make(STATE, STATE)}
        self.p |= {"A": make(2 * STATE, STATE), "a": make(STATE, 1), "o": make(2 * STATE, 1), "c": np.zeros(1, np.float32)}
        self.shift, self.constant = 0.0, None

    def inputs(self, w: Words, word_odds: np.ndarray, gram_odds: np.ndarray) -> np.ndarray:
        """By kind of word."""
        if not len(w.grams):
            return np.zeros((0, INPUT), np.float32)
        out = np.empty((len(w.grams), INPUT), np.float32)
        out[:, :SIDE], out[:, 2 * SIDE] = self.p["word"][w.odds_row % VECTORS], word_odds[w.odds_row] / 4
        for i in range(0, len(out), 1 << 15):
            k = slice(i, i + (1 << 15))
            first, n = w.gram_first[k], w.grams[k]
            rows = w.gram_row[first[0] : first[-1] + n[-1]]
            first, g = first - first[0], gram_odds[rows]
            out[k, SIDE : 2 * SIDE] = np.add.reduceat(self.p["gram"][rows % VECTORS], first) / n[:, None]
            out[k, 2 * SIDE + 1], out[k, 2 * SIDE + 2], out[k, 2 * SIDE + 3] = np.maximum.reduceat(g, first) / 4, np.add.reduceat(g, first) / n / 4, np.minimum.reduceat(g, first) / 4
        return out

    def layer(self, x: np.ndarray, win: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States by window and word of one direction; x: gate inputs by kind, its last row for no word."""
        states = np.empty((len(win), WINDOW, STATE), np.float32)
        h, u, c = np.zeros((len(win), STATE), np.float32), self.p[f"U{d}"], self.p[f"C{d}"]
        for t in range(WINDOW) if d == "f" else reversed(range(WINDOW)):
            g = x[win[:, t]]
            zr = sigmoid(g[:, : 2 * STATE] + h @ u)
            z, r = zr[:, :STATE], zr[:, STATE:]
            n = np.tanh(g[:, 2 * STATE :] + (r * h) @ c)
            if keep is not None:
                keep.append((t, h, z, r, n))
            h = h + z * (n - h)
            states[:, t] = h
        return states

    def logits(self, x: np.ndarray, win: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """By window; x: inputs by kind."""
        p, off = self.p, np.zeros(3 * STATE, np.float32)
        off[:STATE] = -30  # no word: the state stays
        steps = {d: [] if keep is not None else None for d in "fb"}
        s = np.concatenate([self.layer(np.concatenate((x @ p[f"W{d}"] + p[f"B{d}"], off[None])), win, d, steps[d]) for d in "fb"], 2)
        k = np.tanh(s @ p["A"])
        e = np.where(win < 0, -1e9, (k @ p["a"])[:, :, 0])
        e = np.exp(e - e.max(1, keepdims=True)) * (win >= 0)
        w = e / np.maximum(e.sum(1, keepdims=True), 1e-9)
        v = (s * w[:, :, None]).sum(1)
        if keep is not None:
            keep |= {"steps": steps, "s": s, "k": k, "w": w, "v": v}
        return v @ p["o"][:, 0] + p["c"][0]

    def back(self, x: np.ndarray, win: np.ndarray, g: np.ndarray, keep: dict) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters and of x, from those of the logits."""
        p, s, k, w = self.p, keep["s"], keep["k"], keep["w"]
        out = {"o": (keep["v"] * g[:, None]).sum(0)[:, None], "c": g.sum(keepdims=True)}
        gv = g[:, None] * p["o"][:, 0]
        gs = w[:, :, None] * gv[:, None]
        gw = (s * gv[:, None]).sum(2)
        ge = w * (gw - (w * gw).sum(1, keepdims=True))
        gk = ge[:, :, None] * p["a"][:, 0] * (1 - k * k)
        out["a"] = (k * ge[:, :, None]).sum((0, 1))[:, None]
        out["A"] = np.einsum("bti,btj->ij", s, gk, optimize=True)
        gs += gk @ p["A"].T
        gx = np.zeros_like(x)
        for j, d in enumerate("fb"):
            u, c, gu, gc = p[f"U{d}"], p[f"C{d}"], np.zeros_like(p[f"U{d}"]), np.zeros_like(p[f"C{d}"])
            gate = np.zeros((len(x) + 1, 3 * STATE), np.float32)
            gh = np.zeros((len(win), STATE), np.float32)
            for t, h, z, r, n in reversed(keep["steps"][d]):
                gh = gh + gs[:, t, j * STATE : (j + 1) * STATE]
                gn = gh * z * (1 - n * n)
                grh = gn @ c.T
                gzr = np.concatenate((gh * (n - h) * z * (1 - z), grh * h * r * (1 - r)), 1)
                gu += h.T @ gzr
                gc += (r * h).T @ gn
                np.add.at(gate, win[:, t], np.concatenate((gzr, gn), 1))
                gh = gh * (1 - z) + grh * r + gzr @ u.T
            gate = gate[:-1]
            out |= {f"U{d}": gu, f"C{d}": gc, f"W{d}": x.T @ gate, f"B{d}": gate.sum(0)}
            gx += gate @ p[f"W{d}"].T
        return out, gx

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.constant is not None or len(offsets) < 2:
            return np.full(len(offsets) - 1, self.constant or 0.0)
        w = Words(raw, offsets) if len(raw) else None
        if w is None or not len(w.kind):
            win, upto, x = np.full((len(offsets) - 1, WINDOW), -1), np.arange(len(offsets)), np.zeros((0, INPUT), np.float32)
        else:
            win, upto = w.windows()
            x = self.inputs(w, self.word_odds, self.gram_odds)
        z = np.concatenate([self.logits(x, win[i : i + 4096]) for i in range(0, len(win), 4096)])
        return sigmoid(np.maximum.reduceat(z, upto[:-1]).astype(np.float64) + self.shift)


def counted(raw: np.ndarray, offsets: np.ndarray, groups: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """By group of texts and table row: the texts that have it, for words and for n-grams."""
    words, grams = np.zeros(n * ODDS), np.zeros(n * ODDS)
    for i in range(0, len(groups), 100):
        w = Words(raw[offsets[i] : offsets[min(i + 100, len(groups))]], offsets[i : i + 101] - offsets[i])
        seen = np.unique(np.repeat(np.arange(len(w.first) - 1), np.diff(w.first)) * len(w.odds_row) + w.kind)  # text and kind of word
        doc, kind = seen // max(1, len(w.odds_row)), seen % max(1, len(w.odds_row))
        for count, d, r in ((words, doc, w.odds_row[kind]), (grams, np.repeat(doc, w.grams[kind]), gather(w.gram_row, w.gram_first[kind], w.grams[kind]))):
            pair = np.unique(d * ODDS + r)
            count += np.bincount(groups[i + pair // ODDS] * ODDS + pair % ODDS, minlength=n * ODDS)
    return words.reshape(n, ODDS), grams.reshape(n, ODDS)


def odds(c1: np.ndarray, c0: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """By table row: log odds of the texts that have it being toxic, in standard errors; rows that none has are 0. c1, c0: texts that have it; n1, n0: all."""
    a1, a0 = 2 * n1 / (n1 + n0), 2 * n0 / (n1 + n0)
    z = np.log((c1 + a1) / (n1 + a1)) - np.log((c0 + a0) / (n0 + a0)) - np.log(a1 / (n1 + a1)) + np.log(a0 / (n0 + a0))
    z /= np.sqrt(1 / (c1 + a1) + 1 / (c0 + a0))
    return np.where(c1 + c0 > 0, z, 0).astype(np.float32)


def fit(raw: np.ndarray, offsets: np.ndarray, labels: np.ndarray, share: float = 0.5, at: float = 0.7, epochs: int = 8, batch: int = 32, texts: int = 30_000, seed: int = 3) -> Model:
    """share: of toxic texts among all, for the point that the score at shall separate best; a fifth of the texts set it. Odds that train the network on a fold of the texts are of the other folds (two, or eight of under 1,500 texts). Epochs are more, up to 60, where they are short of so many texts in all."""
    model, rng = Model(seed), np.random.default_rng(seed)
    if len(labels) < 4 or labels.min() == labels.max():
        model.constant = float(labels.mean()) if len(labels) else 0.5
        return model
    w = Words(raw, offsets)
    win, upto = w.windows()
    folds = 2 if len(labels) >= 1500 else 8
    part = np.where(rng.integers(0, 5, len(labels)) == 0, 0, 1 + rng.permutation(len(labels)) % folds)  # 0 sets the point
    if any(len(set(labels[part == k].tolist())) < 2 for k in range(folds + 1)):
        part[:] = 0
    own = part > 0 if (part > 0).any() else part == 0
    parts = [part == k for k in range(1, folds + 1)] if (part > 0).any() else [own]
    counts = counted(raw, offsets, part * 2 + labels.astype(np.int64), 2 * folds + 2)
    sizes = np.bincount(part * 2 + labels.astype(np.int64), minlength=2 * folds + 2)

    def table(but: int) -> tuple[np.ndarray, np.ndarray]:
        """Odds over the trained folds but one."""
        rows = [k for k in range(folds + 1) if k not in (0, but)] if len(parts) > 1 else [0]
        one, zero = [2 * k + 1 for k in rows], [2 * k for k in rows]
        return tuple(odds(c[one].sum(0), c[zero].sum(0), sizes[one].sum(), sizes[zero].sum()) for c in counts)

    tables = [table(k) for k in range(1, len(parts) + 1)]
    model.word_odds, model.gram_odds = table(-1)
    del counts
    p, opt = model.p, Adam(model.p, rate=5e-3)
    spans = np.diff(upto)

    def highest(docs: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each text's highest window and its logit."""
        n = spans[docs]
        rows = gather(np.arange(len(win)), upto[docs], n)
        z = np.concatenate([model.logits(x, win[rows[i : i + 4096]]) for i in range(0, len(rows), 4096)])
        first = np.cumsum(n) - n
        top = np.maximum.reduceat(z, first)
        hit = np.flatnonzero(z == np.repeat(top, n))
        _, one = np.unique(np.repeat(np.arange(len(n)), n)[hit], return_index=True)
        return rows[hit[one]], top

    epochs = max(epochs, min(60, texts // len(labels)))
    for epoch in range(epochs):
        opt.rate = 5e-3 * (1 - epoch / epochs) + 5e-4
        for one, (wo, go) in zip(parts, tables, strict=True):
            docs = rng.permutation(np.flatnonzero(one))
            x = model.inputs(w, wo, go)
            if epoch == 0:  # to begin with, the window of the largest sum of odds
                strength = np.r_[np.maximum(x[:, 2 * SIDE], 0) + np.maximum(x[:, 2 * SIDE + 1], 0), 0][win].sum(1)
                pick = np.array([upto[k] + int(np.argmax(strength[upto[k] : upto[k + 1]])) for k in docs.tolist()])
            else:
                pick = highest(docs, x)[0]
            for i in range(0, len(docs), batch):
                b, y = win[pick[i : i + batch]], labels[docs[i : i + batch]]
                kinds, own_kind = np.unique(b, return_inverse=True)
                has = kinds >= 0
                own_kind = own_kind.reshape(b.shape) - (0 if has.all() else 1)
                kinds = kinds[has]
                rows = gather(w.gram_row, w.gram_first[kinds], w.grams[kinds]) % VECTORS
                first = np.cumsum(w.grams[kinds]) - w.grams[kinds]
                bx = x[kinds].copy()
                if len(kinds):
                    bx[:, :SIDE] = p["word"][w.odds_row[kinds] % VECTORS]
                    bx[:, SIDE : 2 * SIDE] = np.add.reduceat(p["gram"][rows], first) / w.grams[kinds][:, None]
                keep: dict = {}
                z = model.logits(bx, own_kind, keep)
                grads, gx = model.back(bx, own_kind, ((sigmoid(z) - y) / len(y)).astype(np.float32), keep)
                opt.step(grads)
                if len(kinds):
                    np.add.at(p["word"], w.odds_row[kinds] % VECTORS, -RATE * opt.rate * gx[:, :SIDE])
                    np.add.at(p["gram"], rows, -RATE * opt.rate * np.repeat(gx[:, SIDE : 2 * SIDE] / w.grams[kinds][:, None], w.grams[kinds], axis=0))
    docs = np.flatnonzero(part == 0)
    z = highest(docs, model.inputs(w, model.word_odds, model.gram_odds))[1].astype(np.float64)
    model.shift = shift(z, labels[docs], at, share)
    return model


def train(docs: DataFrame, labels: DataFrame, label_col: str, mod: int, but: int, n: int = TRAIN_TEXTS, id_col: str = "doc_id", text_col: str = "text", **how) -> Model:
    """Fits on at most n documents of each label whose crc32(doc_id) mod mod is not but."""
    rows = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("label")).filter((fold("doc_id", mod) != but) & labels[label_col].isNotNull() & labels[id_col].isNotNull())
    share = rows.agg(F.avg("label")).first()[0]
    order = F.xxhash64(F.lit(7), "doc_id"), F.col("doc_id")
    picked = rows.filter("label = 1").orderBy(*order).limit(n).unionByName(rows.filter("label = 0").orderBy(*order).limit(n))
    got = training_sample(picked, id_text(docs, id_col, text_col), 2 * n)
    return fit(*buffers(got.column("text").combine_chunks()), got.column("label").to_numpy().astype(np.float64), share if share is not None else 0.5, **how)
