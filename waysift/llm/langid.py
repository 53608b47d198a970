"""Language identification: nearest centroid over TF-IDF character n-grams.

A text becomes hashed counts of the 1-, 2- and 3-grams of its letters (lower case;
everything between letters is one blank), weighted by inverse document frequency and
normalised. Each language has several centroids, found by spherical k-means on a
bounded sample of its labelled texts; a text gets the language of the centroid of
largest cosine and is rejected where that cosine falls short of what the languages'
own texts reach.

Defined cases: a text that is null or has no letter is `und`, score 0 and rejected;
ties of cosine go to the first language in alphabetical order; repeated rows and null
ids are separate rows; an empty table gives none; with no labelled text everything is
`und`; other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, id_text, sliced, training_sample

UND = "und"
#: Hashed n-gram columns, a power of two.
COLUMNS = 1 << 13
#: The bound of the training sample, in labelled texts of all languages together.
TRAIN_TEXTS = 3000
#: Centroids for each language.
CENTROIDS = 4


def _letters() -> np.ndarray:
    """By code point: its lower-case letter, or a blank where it isn't a letter."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


_table: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _table:
        _table.append(_letters())
    return _table[0]


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed n-grams (texts x COLUMNS), and which texts have letters. Texts are folded in pieces, whole."""
    counts, some = np.zeros((len(texts), COLUMNS), np.float32), np.zeros(len(texts), bool)
    fold = letters()
    for k, t in enumerate(texts):
        if not t:
            continue
        c = fold[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)]
        blank = c == 32
        if blank.all():
            continue
        some[k] = True
        c = np.r_[np.uint32(32), c[~(blank & np.r_[True, blank[:-1]])], np.uint32(32)]  # one blank between words
        for i in range(0, len(c), 1 << 20):
            p = c[i : i + (1 << 20) + 2]
            two = p[:-1] * np.uint32(0x9E3779B1) + p[1:]
            three = two[:-1] * np.uint32(0x85EBCA6B) + p[2:]
            for h in (p[: 1 << 20], two[: 1 << 20], three[: 1 << 20]):
                h = h * np.uint32(0xC2B2AE35)
                counts[k] += np.bincount((h ^ h >> np.uint32(15)) >> np.uint32(7) & np.uint32(COLUMNS - 1), minlength=COLUMNS)
    return counts, some


@dataclass
class Model:
    """idf by column; centroids (unit rows) with their languages' numbers; by language the least cosine that isn't rejected."""

    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    of: np.ndarray
    least: np.ndarray

    def vectors(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        counts, some = grams(texts)
        x = np.log1p(counts, out=counts)
        x *= self.idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        return x, some

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, cosines and rejections."""
        if not self.langs:
            return [UND] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        x, some = self.vectors(texts)
        cos = x @ self.centroids.T
        best = cos.argmax(1)
        lang, score = self.of[best], np.where(some, np.clip(cos.max(1), 0, 1), 0).astype(float)
        return [self.langs[k] if s else UND for k, s in zip(lang, some, strict=True)], score, ~some | (score < self.least[lang])


def fit(texts: list[str], langs: list[str], centroids: int = CENTROIDS, slack: float = 0.5, seed: int = 11) -> Model:
    """slack: a text is rejected under this share of the first percentile of its language's own cosines."""
    names = sorted(set(langs))
    counts, some = grams(texts)
    idf = np.log((1 + len(texts)) / (1 + np.count_nonzero(counts, axis=0))).astype(np.float32) + 1 if texts else np.ones(COLUMNS, np.float32)
    x = np.log1p(counts, out=counts)  # in place: the sample is the driver's largest array
    x *= idf
    x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-9)[:, None]
    y, rng = np.array([names.index(v) for v in langs], int), np.random.default_rng(seed)
    found, of, least = [], [], []
    for k in range(len(names)):
        own = x[(y == k) & some]
        if not len(own):
            least.append(0.0)
            continue
        c = own[rng.choice(len(own), min(centroids, len(own)), replace=False)]
        for _ in range(15):
            to = (own @ c.T).argmax(1)
            c = np.array([own[to == j].mean(0) if (to == j).any() else c[j] for j in range(len(c))])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        found.append(c)
        of += [k] * len(c)
        least.append(slack * float(np.quantile((own @ c.T).max(1), 0.01)))
    return Model(names if found else [], idf, np.concatenate(found).astype(np.float32) if found else np.zeros((0, COLUMNS), np.float32), np.array(of, int), np.array(least))


def train(df: DataFrame, keep: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", n: int = TRAIN_TEXTS, **how) -> Model:
    """Fits on a sample of at most n of the rows that keep (over doc_id) allows and whose language is not null."""
    rows = df.select(df[id_col].cast("long").alias("doc_id"), df[lang_col].cast("string").alias("lang")).filter(keep & F.col("lang").isNotNull())
    got = training_sample(rows, id_text(df, id_col, text_col), n)
    return fit(got.column("text").to_pylist(), got.column("lang").to_pylist(), **how)


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", also: list[str] = ()) -> DataFrame:
    """doc_id, lang_pred, score (cosine to the nearest centroid), rejected per row; with also, the text and these columns too. No shuffle; the model's size is fixed."""
    bound_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", *(["text", *also] if also else [])]
    given = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"), *(df[c] for c in also))

    @sliced
    def run(batches: Iterable) -> Iterator:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                lang, score, out = shared.value.predict(part.column("text").to_pylist())
                yield pa.record_batch([*(part.column(n) for n in names), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(out, pa.bool_())], names=[*names, "lang_pred", "score", "rejected"])

    kinds = dict(given.dtypes)
    return given.mapInArrow(run, ", ".join(f"`{n}` {kinds[n]}" for n in names) + ", lang_pred string, score double, rejected boolean")
