"""The pipeline's stages against plain code on a small corpus."""

import random

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
import public_tokenizers as P  # noqa: E402

from waysift.llm import langid, quality  # noqa: E402
from waysift.llm.common import fold  # noqa: E402

from .test_ops import brute_removed, edited, prose, words  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, component_id long, score double"


def shingles(t):
    w = words(t.lower())
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(11)
    texts = [prose(r.randrange(60, 260), 7000 + k) for k in range(260)]
    texts += [edited(t, share, k) for k, t in enumerate(texts[:60]) for share in (0.0, 0.01)]
    passage = prose(80, 9999)
    texts += [prose(40, 8000 + k) + " " + passage + " " + prose(60, 8500 + k) for k in range(30)]
    bad = [" | ".join(prose(80, 6000 + k).split()) if k % 3 else " ".join(w.upper() + "!!" for w in prose(80, 6000 + k).split()) for k in range(90)]
    rows = [(k, t, "en", "s", len(t), "x", -1, 0.5) for k, t in enumerate(texts + bad)]
    rows += [(9000, None, None, None, None, None, None, None), (9001, "", "en", "s", 0, "x", 0, 0.0), (9002, "12 34", None, "s", 5, "x", 0, 0.0)]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(k, int(k < len(texts))) for k in range(0, len(texts) + len(bad), 2)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), len(texts)


def test_stages(spark, corpus, tmp_path):
    folder, n_good = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    made = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        made.append((docs, out))
        if k < 4:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = out
    ids = [({r.doc_id for r in a.select("doc_id").collect()}, {r.doc_id for r in b.select("doc_id").collect()}) for a, b in made]

    given, _ = made[0]
    model = quality.train(given, spark.read.parquet(f"{folder}/labels.parquet"), "quality", 5, 0)
    assert ids[0][1] == {r.doc_id for r in quality.score(given, model).collect() if r.score >= 0.3}
    assert len(ids[0][1] & set(range(n_good))) >= 0.99 * n_good and len([i for i in ids[0][1] if n_good <= i < 9000]) <= 3

    given, _ = made[1]
    model = langid.train(given, fold("doc_id", 5) != 0)
    assert ids[1][1] == {r.doc_id for r in langid.predict(given, model).collect() if not r.rejected}
    assert not ids[1][1] & {9000, 9001, 9002} and len(ids[1][1]) >= 0.99 * len(ids[1][0] - {9000, 9001, 9002})

    sets = {r.doc_id: shingles(r.text) for r in made[2][0].collect()}
    kept = ids[2][1]
    root = {i: i for i in sets}
    for i, s in sets.items():
        for j, t in sets.items():
            if j < i and root[i] != root[j] and jaccard(s, t) >= 0.8:
                x, y = sorted((root[i], root[j]))
                root = {k: x if r == y else r for k, r in root.items()}
    assert kept == set(root.values())

    given, out = made[3]
    want = {i: removed for i, _, removed, _ in brute_removed([(r.doc_id, r.text) for r in given.collect()], 50)}
    after = {r.doc_id: r for r in out.collect()}
    assert set(after) == ids[3][0] and sum(want.values()) > 0
    for r in given.collect():
        if want[str(r.doc_id)]:
            assert len(words(after[r.doc_id].text)) == len(words(r.text)) - want[str(r.doc_id)] and after[r.doc_id].n_chars == len(after[r.doc_id].text)
        else:
            assert after[r.doc_id] == r

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    given, out = made[4]
    pieces = out.groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in pieces} == {r.doc_id: len(t.encode(r.text, add_special_tokens=False).ids) + 1 for r in given.collect()}
    whole = np.array([r[0] for r in out.groupBy("sequence_id").sum("length").select("sum(length)").collect()])
    assert whole.max() <= 1024


def test_rows_of_one_id_and_without_id(spark, corpus):
    folder, _ = corpus
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    passage, near = prose(90, 4242), prose(200, 4243)
    rows = [(1, prose(50, 1) + " " + passage, "en", "a", 0), (5, prose(40, 2) + " " + passage, "en", "b", 0), (5, "totally different text here", "en", "c", 4), (6, passage + " " + prose(30, 3), "en", "d", 0), (6, passage + " " + prose(30, 3), "en", "e", 0)]
    got = corpus_pipeline.substring_stage(spark, spark.createDataFrame(rows, schema), folder).collect()
    assert sorted((r.doc_id, r.text, r.source) for r in got) == sorted([(1, rows[0][1], "a"), (5, prose(40, 2), "b"), (5, rows[2][1], "c"), (6, prose(30, 3), "d"), (6, prose(30, 3), "e")])
    rows = [(7, near, "en", "a", 0), (7, near, "en", "a", 0), (7, prose(150, 9), "en", "b", 0), (None, edited(near, 0.004, 1), "en", "c", 0), (None, prose(120, 12), "en", "d", 0), (None, prose(120, 12), "en", "d", 0), (3, edited(near, 0.004, 2), "en", "e", 0), (None, None, None, None, None), (9, "", "en", "f", 0)]
    got = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(rows, schema).repartition(2), folder).collect()
    assert sorted((str(r.doc_id), r.source) for r in got) == sorted([("3", "e"), ("7", "b"), ("None", "d"), ("9", "f")])


def test_run(spark, corpus):
    got = corpus_pipeline.run(spark, corpus[0])
    assert {"doc_id", "sequence_id", "ids_crc32"} <= set(got.columns) and got.count() > 100


def test_stages_on_an_empty_table(spark, corpus, tmp_path):
    folder, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id < 0")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.count() == 0
