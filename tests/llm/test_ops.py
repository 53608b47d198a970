"""The training-data operators against brute force on small tables, with their odd rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("waysift.llm.queries")
import public_tokenizers as P  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from waysift.llm import bpe, components, hnsw, langid, mjpeg, packing, quality, simhash, substrings, toxicity  # noqa: E402
from waysift.llm.bpe import buffers  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, fp string, ids string, component_id long, anchors string, first long, kind string"
random.seed(4)
WORDS = [f"{a}{b}" for a in "ba co du ei fo gre hil ju ka lo".split() for b in "n r st x mel dor pim ta vu zz".split()]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ".", ","]) for _ in range(n))


def cases():
    """Rows with nulls, empty and long texts, ties, repeats, Unicode and white space, in a table whose other columns have awkward names."""
    base = prose(400, 1)
    texts = [base, base, prose(60, 2) + " " + base, base[:900], "", None, "   \n\t ", "one", "A b C d", "Ünïcode  é漢字　x   y's\r\n\r\nz", prose(30_000, 3), "a " * 300, "the the the " * 40, prose(120, 5), prose(70, 7) + " " + prose(120, 5)]
    rows = [(k * 3, t, "en", "x", "y", -1, "z", -5, "q") for k, t in enumerate(texts)]
    return rows + [rows[0], (None, base, None, "", "", 0, "", 0, ""), (None, None, None, "", "", 0, "", 0, "")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(cases(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_bpe_matches_the_library_and_round_trips(docs, empty):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    rows = bpe.decode(bpe.encode(docs, path, P.PATTERN), path).collect()
    want = sorted((str(i), np.array(enc.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t, *_ in cases())
    assert sorted((str(r.doc_id), bytes(r.ids), bytes(r.decoded)) for r in rows) == want
    assert bpe.digest(bpe.decode(bpe.encode(empty, path, P.PATTERN), path)).collect() == []


def test_bpe_on_random_texts():
    import tiktoken

    ranks = bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    e = bpe.Encoder(bpe.MergeReplay(ranks), P.PATTERN)
    alphabet = "ab \n\t  'sdé中１²!?  \U0001f600漢Ⅷ_-\x1c\x85\xa0 　“éü×÷ß12"
    texts = ["".join(random.choice(alphabet) for _ in range(random.randrange(60))) for _ in range(3000)]
    ids, at = e.block(*buffers(pa.array(texts)))
    assert all(ids[a:b].tolist() == enc.encode_ordinary(t) for a, b, t in zip(at[:-1], at[1:], texts, strict=True))


def test_bpe_on_long_words():
    import time

    import tiktoken

    ranks = bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    replay = bpe.MergeReplay(ranks)
    r = random.Random(4)
    alphabets = ["a", "ab", "aab", "etaoinshrdlu", "abcdefghijklmnopqrstuvwxyz", "éaü", "thein", "-", "=-", "漢字"]
    texts = ["".join(r.choice(a) for _ in range(n)) for a in alphabets for n in (300, 1025, 3001, 9000)] + ["".join(WORDS) * 40]
    for block in (texts, texts[:1], texts[3:4], [*texts[-3:], "ab", "x"]):
        got = replay.encode([t.encode() for t in block])
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [enc._encode_single_piece(t) for t in block]

    def took(n):
        word = "".join(r.choice("etaoinshrdlu") for _ in range(n)).encode()
        t = time.perf_counter()
        replay.encode([word])
        return time.perf_counter() - t

    took(1000)
    assert took(160_000) < 30 * took(20_000)  # square: 64 times


def test_bpe_rejects_unknown_ids(spark):
    bad = spark.createDataFrame([(1, np.array([10**6], "<u4").tobytes())], "doc_id long, ids binary")
    with pytest.raises(Exception, match="an id that the ranks don't have"):
        bpe.decode(bad, P.path("byte_bpe_multi_50k.tiktoken")).collect()


def brute_fingerprint(t):
    import xxhash

    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    s = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if s and 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, empty):
    got = simhash.near_duplicates(docs).collect()
    prints = {(i, t): brute_fingerprint(t) for i, t, *_ in cases() if len(t or "") < 10_000}
    by_print = {}
    for r in got:
        by_print.setdefault(r.fp % 2**64, set()).add(r.component_id)
    assert set(prints.values()) <= set(by_print)
    ids = [(i, f) for (i, _), f in prints.items() if i is not None]
    comp = {i: i for i, _ in ids}
    for _ in ids:
        for i, f in ids:
            comp[i] = min(comp[j] for j, g in ids if bin(f ^ g).count("1") <= 2)
    assert all(r.component_id == comp[r.doc_id] for r in got if r.doc_id in comp)
    assert len(got) == len(cases()) and simhash.near_duplicates(empty).collect() == []


def test_trie_finds_all_pairs():
    r = np.random.default_rng(0)
    base = r.integers(0, 2**63, 40, dtype=np.uint64)
    flips = np.uint64(1) << r.integers(0, 64, (40, 12), dtype=np.uint64)
    fp = np.unique(np.concatenate([base, (base[:, None] ^ flips).ravel(), (base[:, None] ^ flips ^ np.roll(flips, 1, 1)).ravel()]))
    for budget in (0, 2, 5):
        pairs = {tuple(sorted(p)) for i, j in simhash.trie_pairs(np.zeros(len(fp)), fp, budget) for p in zip(i.tolist(), j.tolist(), strict=True)}
        assert pairs == {(i, j) for i in range(len(fp)) for j in range(i + 1, len(fp)) if int(fp[i] ^ fp[j]).bit_count() <= budget}


def test_links_lose_none(spark):
    r = np.random.default_rng(1)
    base = [int(x) for x in r.integers(0, 2**63, 60)]
    fps = sorted({x ^ (1 << int(r.integers(64))) ^ (1 << int(r.integers(64))) for x in base for _ in range(4)} | set(base))
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    got = components.components(simhash.links(spark.createDataFrame(list(enumerate(signed)), "id long, fp long")))
    comp = {x.id: x.component_id for x in got.collect()}
    want = list(range(len(fps)))
    while True:
        new = [min(want[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 2) for i in range(len(fps))]
        if new == want:
            break
        want = new
    assert all(comp.get(i, i) == c for i, c in enumerate(want))


def edited(text, share, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) if r.random() < share else w for w in text.split())


def test_similarity_finds_near_copies_and_spares_others(spark):
    rows, want = [], {}
    for k in range(60):
        t = prose(300, 1000 + k)
        rows.append((10 * k, t))
        for j, share in enumerate((0.0, 0.005, 0.01)):
            rows.append((10 * k + 1 + j, edited(t, share, k * 7 + j)))
            want[10 * k + 1 + j] = 10 * k
    got = dict(tuple(r) for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert all(got[10 * k] == 10 * k for k in range(60))
    assert sum(got[i] == c for i, c in want.items()) >= 0.97 * len(want)
    assert all(got[i] in (i, c) for i, c in want.items())


def single_linkage(rows, similarity=0.8):
    """Each text's smallest id reachable by links of that similarity, by brute force."""
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in ((i, words(t.lower())) for i, t in rows)}
    root = {i: i for i in sets}
    for i, a in sets.items():
        for j, b in sets.items():
            if j < i and root[i] != root[j] and len(a & b) >= similarity * len(a | b):
                x, y = sorted((root[i], root[j]))
                root = {k: x if r == y else r for k, r in root.items()}
    return root


def similar_groups(spark, rows):
    return dict(tuple(r) for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())


def test_similarity_joins_many_near_copies_of_a_long_text(spark):
    t = prose(3000, 41)
    rows = [(k, t if k == 0 else edited(t, 0.0004, k)) for k in range(120)]
    assert similar_groups(spark, rows) == single_linkage(rows) == {k: 0 for k in range(120)}


def test_similarity_puts_others_in_a_rejected_pairs_place(spark):
    rows = []
    for g in range(12):  # groups whose pairs lie on both sides of 0.8
        t = prose(220, 5100 + g)
        rows += [(100 * g + k, edited(t, 0.005 + 0.004 * (k % 6), 31 * g + k)) for k in range(14)]
    want = single_linkage(rows)
    assert similar_groups(spark, rows) == want and 12 < len(set(want.values())) < len(rows)


def test_similarity_is_of_sets(spark):
    passage, t = prose(100, 77) + " ", prose(200, 78)
    rows = [(k, passage * 300 + prose(50, 600 + k)) for k in range(6)]
    rows += [(10, t), (11, t + (" " + prose(10, 79)) * 200), (12, "x " * 5000 + prose(60, 80)), (13, "x " * 5000 + prose(60, 81))]
    want = single_linkage(rows)
    assert similar_groups(spark, rows) == want and want[11] == 10 and len(set(want.values())) == len(rows) - 1


def test_similarity_loses_no_pair_from_the_threshold_on(spark):
    rows = []
    for k in range(150):
        t = prose(120, 9100 + k)
        rows += [(2 * k, t), (2 * k + 1, edited(t, 0.021, k))]
    want = single_linkage(rows)
    assert similar_groups(spark, rows) == want and 40 < sum(want[i] != i for i in want) < 150


def brute_removed(rows, length):
    first, out = {}, []
    rows = [(i, words(t)) for i, t in rows]
    for i, w in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        for p in range(len(w) - length + 1):
            first.setdefault(tuple(w[p : p + length]), i)
    for i, w in rows:
        gone = [False] * len(w)
        for p in range(len(w) - length + 1):
            if i is not None and first[tuple(w[p : p + length])] < i:
                gone[p : p + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((str(i), len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def dedup_rows(df, **how):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.h) for r in substrings.dedup(df, **how).select("doc_id", "n_words", "n_removed", F.coalesce(F.sha2("kept", 256), F.lower(F.hex("digest"))).alias("h")).collect())


def test_substrings(docs, empty):
    assert dedup_rows(docs) == brute_removed([r[:2] for r in cases()], 50)
    assert dedup_rows(empty) == []


def test_substrings_on_few_words(spark):
    r = random.Random(8)
    rows = [(r.randrange(30), " ".join(r.choice("ab") for _ in range(r.randrange(40)))) for _ in range(60)]
    assert dedup_rows(spark.createDataFrame(rows, "doc_id long, text string"), length=8, k=3) == brute_removed(rows, 8)


def test_substrings_where_a_source_repeats_itself(spark):
    x = "x " * 60
    rows = [(1, x + prose(60, 31) + " " + x), (2, "x " * 130), (3, prose(20, 32) + " " + "x " * 70 + prose(60, 31)), (4, "y z " * 40), (5, "z y " * 60)]
    assert dedup_rows(spark.createDataFrame(rows, "doc_id long, text string")) == brute_removed(rows, 50)


def test_spans_name_their_source(docs):
    spans = {r.doc_id: r.spans for r in substrings.dedup(docs).filter("spans is not null").collect()}
    text = {i: words(t) for i, t, *_ in cases()}
    assert spans
    for i, found in spans.items():
        for s in found:
            passage = " ".join(text[i][s.start : s.start + s.words])
            assert s.source < i and s.words >= 50 and passage == " ".join(text[s.source][s.place : s.place + s.words])


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = packing.pack(docs.filter("doc_id > 0"), P.path("byte_bpe_50k.json"), P.PATTERN, with_ids=True).collect()
    docs_, seqs = {}, {}
    for r in rows:
        docs_.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
        assert len(r.ids) == r.length and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    for i, text, *_ in cases():
        if i is not None and i > 0:
            ids = [x for r in sorted(docs_[i], key=lambda r: r.start) for x in r.ids]
            assert ids == [*t.encode(text or "", add_special_tokens=False).ids, 0] and all(r.doc_tokens == len(ids) for r in docs_[i])
    for pieces in seqs.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert packing.pack(empty, P.path("byte_bpe_50k.json"), P.PATTERN).collect() == []


def test_packing_finds_the_least_cost():
    rng = np.random.default_rng(1)
    for _ in range(150):
        n, size = int(rng.integers(1, 60)), 8
        ends, sentences = np.unique(rng.integers(1, n + 1, rng.integers(0, 4))), np.unique(rng.integers(1, n + 1, rng.integers(0, 12)))
        got = packing.cuts(n, ends, sentences, size, 0.5, 3)
        soft = sorted({0, n, *ends.tolist(), *sentences.tolist()})
        every = set(soft)
        for a, b in zip(soft, soft[1:], strict=False):
            every.update([a + size, *range(a + size, b, size)])
        price = lambda z: 0 if z in ends or z in (0, n) else 0.5 if z in sentences else 3
        pad = lambda k: 0 if k & (k - 1) == 0 and k >= size // 4 else size - k
        best = {0: 0}
        for z in sorted(x for x in every if 0 < x <= n):
            best[z] = min(best[y] + pad(z - y) for y in best if z - y <= size and (z in soft or z - y == size)) + price(z)
        assert got[-1] == n and sum(pad(b - a) + price(b) for a, b in zip([0, *got], got, strict=False)) == pytest.approx(best[n])


def test_packing_weighs_every_sentence_and_power_of_two():
    ends = np.zeros(2, bool)
    ends[1] = True
    ids = np.zeros(72, "<u4")
    ids[[7, 19]] = 1  # windows of 8 and 64 have no padding; 20 is the later end in the same 32 tokens
    p = packing.Packer(0, 64, packing.SENTENCE, packing.TORN, ends)
    p.add([1], ids, np.array([0, 72]))
    assert p.flush(True)[2].tolist() == [8, 64]


def test_media_round_trip(docs, empty):
    rows = mjpeg.clips(mjpeg.store(docs)).collect()
    want = []
    for i, t, *_ in cases():
        b = (t or "").encode()
        want.append((str(i), len(b), b.ljust(max(1, -(-len(b) // 192)) * 192)))
    assert sorted((str(r.doc_id), r.n_bytes, bytes(r.payload)) for r in rows) == sorted(want)
    for r in rows:
        assert r.clips[0].first_frame == 0 and sum(c.n_frames for c in r.clips) == r.n_frames == len(r.payload) // 192
    assert mjpeg.digest(mjpeg.clips(mjpeg.store(empty))).collect() == []
    f = mjpeg.digest(mjpeg.clips(mjpeg.store(docs.filter("doc_id in (0, 3)")))).select("media_sha256", "feature").distinct()
    assert f.count() == 1


def test_media_frames_and_shots():
    x = np.random.default_rng(0).integers(0, 256, (9, 192)).astype(np.uint8)
    x[3], x[4, ::2] = 0, 255
    files = mjpeg.encode_frames(x)
    assert (mjpeg.decode_frames(files) == x).all() and all((mjpeg.decode_any(f).reshape(-1) == y).all() for f, y in zip(files, x, strict=True))
    got, fps = mjpeg.read_avi(mjpeg.write_avi(files))
    assert got == files and fps == 25
    movie = np.concatenate([np.full((20, 192), 10), np.full((20, 192), 200), np.full((20, 192), 90)]).astype(np.uint8)
    assert mjpeg.shots(movie) == [20, 40] and mjpeg.shots(movie[:2]) == []
    with pytest.raises(ValueError):
        mjpeg.read_avi(b"not a file")


def test_media_null_file(spark):
    df = spark.createDataFrame([(1, 2, None)], "doc_id long, n_bytes long, media binary")
    assert mjpeg.clips(df).first().payload is None


def vectors():
    r = np.random.default_rng(2)
    x = r.standard_normal((150, 16))
    near = x[:40] + 0.02 * r.standard_normal((40, 16))
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate([x, near, near[:10]]))]
    chain = [r.standard_normal(16)]
    for _ in range(6):
        chain.append(chain[-1] + 0.07 * np.linalg.norm(chain[-1]) * r.standard_normal(16) / 4 * 3)
    rows += [(500 + k, v.tolist()) for k, v in enumerate(chain)]
    rows += [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [None] + [1.0] * 15), (905, [1.0, 2.0]), (906, [2.0, 4.0]), (907, [float("inf")] * 16)]
    return rows


def test_embeddings(spark):
    rows = vectors()
    schema = "vec_id long, embedding array<double>, label int, id long, weight long, block int"
    df = spark.createDataFrame([(i, v, 0, 7, 7, 7) for i, v in rows], schema)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in hnsw.near_duplicates(df).collect()}
    ok = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)}
    link = {i: {j for j, w in ok.items() if j != i and len(w) == len(v) and v @ w >= 0.95} for i, v in ok.items()}
    comp = {i: i for i, _ in rows}
    for _ in rows:
        comp |= {i: min([comp[i], *(comp[j] for j in link.get(i, ()))]) for i in comp}
    assert got == {i: (len(link.get(i, ())), comp[i], comp[i] == i) for i, _ in rows}
    assert hnsw.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    lone = hnsw.near_duplicates(spark.createDataFrame([(None, [1.0], 0, 1, 1, 1), (1, [1.0], 0, 1, 1, 1)], schema)).collect()
    assert {r.vec_id: r.n_links for r in lone} == {None: None, 1: 0}


def test_graph_recall():
    r = np.random.default_rng(5)
    x = r.standard_normal((3000, 32))
    x[1000:1300] = x[0] + 0.05 * r.standard_normal((300, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = hnsw.Graph(x)
    ids = g.find(x[::50].astype(np.float32), 64)[0][:, :10]
    true = np.argsort(-(x[::50] @ x.T), 1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(ids.tolist(), true.tolist(), strict=True)]) >= 0.9
    a, b = (np.concatenate(c) for c in zip(*hnsw.hits(g, x, x, 0.95, hnsw.audited_beam(g, x, x, 0.95)), strict=True))
    real = (x @ x.T >= 0.95).sum()
    assert len(a) == len(set(zip(a.tolist(), b.tolist(), strict=True))) and len(a) >= 0.97 * real


class Blind:
    """A graph that finds nothing in beams under 512, then all nodes."""

    def __init__(self, x):
        self.x, self.beams = x, []

    def find(self, q, beam):
        self.beams.append(beam)
        ids = np.full((len(q), beam), -1, np.int32)
        sims = np.full((len(q), beam), -2, np.float32)
        if beam >= 512:
            ids[:, : len(self.x)] = np.arange(len(self.x))[:beam]
            sims[:, : len(self.x)] = (q @ self.x.T)[:, :beam]
        return ids, sims


def test_audit_does_not_pass_on_queries_without_links():
    r = np.random.default_rng(6)
    x = r.standard_normal((600, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = r.standard_normal((200, 16))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    assert not (q @ x.T >= 0.95).any()
    assert hnsw.audited_beam(Blind(x), x, q, 0.95) >= 600
    p = hnsw.probes(x, 0.95, 96)
    assert np.allclose(np.linalg.norm(p, axis=1), 1) and ((p @ x.T).max(1) >= 0.95).all()
    assert (hnsw.probes(np.ones((3, 1)), 0.95, 96) == 1).all()


def test_dense_block_is_folded_in_little_memory():
    import tracemalloc

    r = np.random.default_rng(7)
    x = r.standard_normal(24) + 0.02 * r.standard_normal((6000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, weight = np.arange(6000) * 3, np.ones(6000, np.int64)
    tracemalloc.start()
    n, every, root = hnsw.folded(Blind(x), x, ids, weight, x[:2000], ids[:2000], 0.95)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n.tolist() == ((x[:2000] @ x.T >= 0.95).sum(1) - 1).tolist() and n.min() > 5000
    assert every.tolist() == ids.tolist() and set(root.tolist()) == {0}
    assert peak < 150 << 20  # the pairs alone are 192 MB


def test_embeddings_in_many_shards(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD_BYTES", 40 * 128)
    monkeypatch.setattr(hnsw, "BLOCK_BYTES", 30 * 128)
    r = np.random.default_rng(8)
    x = r.standard_normal((250, 16))
    x[100:180] = x[:80] + 0.05 * r.standard_normal((80, 16))
    x[180:200] = x[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(3, x[40].tolist())]  # an id with two vectors
    got = hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == len(rows)
    near = x @ x.T >= 0.95 + 1e-9
    real = {k: int(near[k].sum()) - 1 for k in range(250) if k not in (3, 40) and not near[k, 3] and not near[k, 40]}
    found = {g.vec_id: g.n_links for g in got if g.vec_id in real}
    assert all(found[k] <= real[k] for k in real) and sum(found.values()) >= 0.98 * sum(real.values())


def test_graphs_travel_in_small_parts(spark, monkeypatch):
    """A shard's graph is 80 times a part here; no row of what is stored holds more than a part."""
    monkeypatch.setattr(hnsw, "PART_BYTES", 1 << 12, raising=False)
    most, keep = {}, hnsw.table

    def seen(df, name):
        out = keep(df, name)
        binary = [c for c, kind in out.dtypes if kind == "binary"]
        if binary:
            most[name] = max(r for r in out.selectExpr(*(f"max(octet_length({c}))" for c in binary)).first() if r)
        return out

    monkeypatch.setattr(hnsw, "table", seen)
    r = np.random.default_rng(4)
    x = r.standard_normal((2000, 16))
    x[1000:1300] = x[:300] + 0.02 * r.standard_normal((300, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = {g.vec_id: g.n_links for g in hnsw.near_duplicates(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    assert most["graphs"] <= 1 << 12 and max(most.values()) <= 1 << 12
    real = (x @ x.T >= 0.95).sum(1) - 1
    assert len(got) == 2000 and all(got[k] <= real[k] for k in got) and sum(got.values()) >= 0.98 * real.sum() > 500


def test_graph_is_restored_from_its_links():
    x = np.random.default_rng(5).standard_normal((700, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = hnsw.Graph(x)
    again = hnsw.Graph.restored(x, g.links())
    q = x[:100].astype(np.float32)
    assert all((a == b).all() for a, b in zip(g.find(q, 32), again.find(q, 32), strict=True))


LANGS = {"aa": "lo mi ra tel nor vis pam".split(), "bb": "sch ung keit ver gra zuf tz".split(), "cc": "qua eux oir ien ment eau ç".split()}


def sentence(lang, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice(LANGS[lang]) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(10, 60)))


def test_language(spark, docs, empty):
    rows = [(k, sentence(lang, k), lang if k % 10 else None) for k, lang in enumerate([*LANGS] * 60)]
    df = spark.createDataFrame([*rows, (900, "123 !!", "aa"), (901, None, "bb"), (902, "漢字 漢字", None)], "doc_id long, text string, lang string")
    model = langid.train(df, F.col("doc_id") % 4 != 0)
    got = {r.doc_id: r for r in langid.predict(df, model).collect()}
    assert np.mean([got[k].lang_pred == [*LANGS][k % 3] for k in range(180)]) > 0.98
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[900].score == 0 and got[900].rejected
    assert got[902].rejected and got[902].lang_pred in LANGS
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.predict(docs, model).count() == len(cases()) and langid.predict(empty, model).collect() == []
    none = langid.train(empty, F.lit(True))
    assert {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}


def plain_language(model, text):
    """Language and cosine by loops over characters and n-grams."""
    chars = [(c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text or ""]
    kept = " " + " ".join("".join(chars).split()) + " "
    if not kept.strip():
        return "und", 0.0
    if "".join(chars).endswith(" "):
        kept += " "  # the blank after the last word and the text's end
    c, m, counts = [ord(x) for x in kept], 2**32, {}
    for n in (1, 2, 3):
        for k in range(len(c) - n + 1):
            h = c[k]
            if n > 1:
                h = (h * 0x9E3779B1 + c[k + 1]) % m
            if n > 2:
                h = (h * 0x85EBCA6B + c[k + 2]) % m
            h = h * 0xC2B2AE35 % m
            col = (h ^ h >> 15) >> 7 & langid.COLUMNS - 1
            counts[col] = counts.get(col, 0) + 1
    v = {col: math.log1p(n) * float(model.idf[col]) for col, n in counts.items()}
    norm = math.sqrt(sum(x * x for x in v.values()))
    cos = [sum(x / norm * float(row[col]) for col, x in v.items()) for row in model.centroids]
    best = max(range(len(cos)), key=cos.__getitem__)
    return model.langs[model.of[best]], cos[best]


def test_language_equals_plain_loops():
    texts = [sentence(lang, k) for k, lang in enumerate([*LANGS] * 20)]
    model = langid.fit(texts[:45], [[*LANGS][k % 3] for k in range(45)])
    odd = ["", None, "12 !?", "a", " \t Lo  MI-ra, 12x ", "É漢字 ẞİ ß", "lo" * 3000, "x " * 9000, *texts[45:]]
    lang, score, _ = model.predict(odd)
    for t, got, of in zip(odd, lang, score, strict=True):
        want, cos = plain_language(model, t)
        assert got == want and abs(of - min(1, max(0, cos))) < 1e-5, t


def labelled(n, bad, seed):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        w = prose(r.randrange(20, 200), seed + k).split()
        y = int(r.random() < 0.3)
        rows.append((k, bad(w, r) if y else " ".join(w), y))
    return rows


def test_quality_features_are_of_the_text_alone():
    texts = ["", " \n ", "  lead in. " + prose(70, 1), prose(64, 2) + "  ", "é", None, "x", "A! b", prose(200, 3), ""]
    x, base = quality.passages(*buffers(pa.array(texts)))
    for k, t in enumerate(texts):
        alone, ends = quality.passages(*buffers(pa.array([t], pa.string())))
        assert ends.tolist() == [0, base[k + 1] - base[k]] and np.array_equal(alone, x[base[k] : base[k + 1]]), t
    raw = texts[7].encode()
    pairs = [quality.KIND[a] * quality.KINDS + quality.KIND[b] for a, b in zip(raw, raw[1:])]
    want = np.zeros(quality.KINDS**2)
    for c in pairs:
        want[c] += 1 / len(pairs)
    assert np.allclose(x[base[7]][: quality.KINDS**2], np.sqrt(want), atol=1e-6)


def plain_quality(model, x):
    """The gated attention's score of one text's passages (centred and scaled), a passage at a time."""
    p = {k: v.astype(float) for k, v in model.p.items()}
    hidden, e = [], []
    for row in x:
        h = [math.tanh(sum(a * b for a, b in zip(row, p["W"][:, j], strict=True)) + p["b"][j]) for j in range(len(p["b"]))]
        v = [math.tanh(sum(a * b for a, b in zip(h, p["V"][:, j], strict=True))) for j in range(p["V"].shape[1])]
        u = [1 / (1 + math.exp(-sum(a * b for a, b in zip(h, p["U"][:, j], strict=True)))) for j in range(p["U"].shape[1])]
        hidden.append(h)
        e.append(math.exp(sum(a * b * c for a, b, c in zip(v, u, p["a"][:, 0], strict=True))))
    z = [sum(w * h[j] for w, h in zip(e, hidden, strict=True)) / sum(e) for j in range(len(hidden[0]))]
    logit = sum(a * b for a, b in zip(z, p["o"][:, 0], strict=True)) + p["c"][0] + model.shift
    return 1 / (1 + math.exp(-logit))


def test_quality_equals_plain_loops():
    rows = labelled(60, lambda w, r: " | ".join(w), 7)
    raw, offsets = buffers(pa.array([t for _, t, _ in rows]))
    model = quality.fit(raw, offsets, np.array([float(y) for *_, y in rows]), epochs=5)
    x, base = quality.passages(raw, offsets)
    got = model.scores(raw, offsets)
    for k in range(12):
        assert abs(got[k] - plain_quality(model, model.scaled(x[base[k] : base[k + 1]]).astype(float))) < 1e-4


def test_quality(spark, docs, empty):
    rows = labelled(500, lambda w, r: " | ".join(w) if r.random() < 0.5 else " ".join(x.upper() + "!!" for x in w), 100)
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality.train(df, labels, "quality", 5, 0)
    got = {r.doc_id: r.score for r in quality.score(df, model).collect()}
    assert np.mean([(got[i] >= 0.3) == (y == 0) for i, _, y in rows]) > 0.97
    s = quality.score(docs, model).collect()
    assert len(s) == len(cases()) and all(0 <= r.score <= 1 for r in s) and quality.score(empty, model).collect() == []
    one = quality.train(df, labels.filter("quality = 1"), "quality", 5, 0)
    assert {r.score for r in quality.score(docs, one).collect()} == {1.0}


def test_toxicity(spark, docs, empty):
    r0 = random.Random(3)

    def insult(w, r):
        for _ in range(3):
            w.insert(r.randrange(len(w)), r.choice(["zorgak", "Blimfo!", "qwert" + r.choice(WORDS)]))
        return " ".join(w)

    rows = labelled(700, insult, 5000)
    r0.shuffle(rows)
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.train(df, labels, "toxic", 3, 1)
    got = {r.doc_id: r.score for r in quality.score(df, model).collect()}
    held = [(got[i] >= 0.7) == (y == 1) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean(held) > 0.93
    s = quality.score(docs, model).collect()
    assert len(s) == len(cases()) and all(0 <= r.score <= 1 for r in s) and quality.score(empty, model).collect() == []


def test_recurrent_gradients():
    m = toxicity.Model()
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    r = np.random.default_rng(0)
    x, win = r.standard_normal((5, toxicity.INPUT)), r.integers(-1, 5, (3, toxicity.WINDOW))
    win[0, 10:] = -1
    g = r.standard_normal(3)
    keep = {}
    m.logits(x, win, keep)
    grads, gx = m.back(x, win, g, keep)
    for name in ("Uf", "Cb", "Wf", "Bb", "A", "a", "o"):
        p, at = m.p[name], tuple(0 for _ in m.p[name].shape)
        was, d = p[at], 1e-4
        p[at] = was + d
        up = (m.logits(x, win) * g).sum()
        p[at] = was - d
        down = (m.logits(x, win) * g).sum()
        p[at] = was
        assert grads[name][at] == pytest.approx((up - down) / (2 * d), rel=0.02, abs=1e-3), name


def test_components(spark):
    e = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (5, 5), (None, 1), (20, 21)] + [(100, k) for k in range(101, 180)]
    got = dict(tuple(r) for r in components.components(spark.createDataFrame(e, "a long, b long")).collect())
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 9: 7, 8: 7, 7: 7, 20: 20, 21: 20} | {k: 100 for k in range(100, 180)}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_similar_does_not_compare_texts_that_only_share_a_list(spark, monkeypatch):
    """Texts of one base that differ too much: their lists are long, but few of their pairs are compared by their sets."""
    base, rows = words(prose(200, 555)), []
    for k in range(120):
        w = list(base)
        for at in range(6):
            w[33 * at + random.Random(100 * k + at).randrange(28)] = f"own{k}x{at}"
        rows.append((k, " ".join(w)))
    rows += [(200 + k, rows[k][1] + " more") for k in range(0, 120, 40)]
    compared, verified = [], simhash.verified

    def counted(known, pairs, similarity):
        compared.append(pairs.count())
        return verified(known, pairs, similarity)

    monkeypatch.setattr(simhash, "verified", counted)
    monkeypatch.setattr(simhash, "ORDERED", 1)  # as in a large table, whose sample tells little of a shingle
    got = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string"), 5, 0.8).collect()}
    assert got == {k: k - 200 if k >= 200 else k for k, _ in rows}
    assert sum(compared) < 1200, compared


def test_parities_reject_no_similar_pair():
    r = random.Random(8)
    texts = [prose(r.randrange(1, 400), k) for k in range(40)] + [prose(6000, 99)]
    texts += [edited(t, share, 7 * k) for k, t in enumerate(texts) for share in (0.005, 0.02, 0.05)] + ["", "a b"]
    sets = list(simhash.shingle_sets(pa.array(texts), 5))
    found = list(simhash.parities(pa.array(texts), 5))
    assert [n for n, _ in found] == [len(s) for s in sets]
    marks = simhash.Marks([pa.array([x for _, x in found], pa.binary())], np.array([n for n, _ in found]))
    i, j = (np.array(x) for x in zip(*((i, j) for i in range(len(texts)) for j in range(i)), strict=True))
    near = marks.near(i, j, 0.8)
    similar = np.array([len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)])
    close = np.array([min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])) for a, b in zip(i, j, strict=True)])
    assert near[similar].all() and similar.sum() > 60 and (near & close).sum() < 2 * similar.sum() < close.sum() / 4


def test_encoder_looks_at_each_new_word_once(monkeypatch):
    t = packing.tokenizer(P.path("byte_bpe_50k.json"), P.PATTERN)
    encoder, seen, plain = bpe.Encoder(t.encoder.replay, P.PATTERN), [], bpe.PLAIN
    monkeypatch.setattr(bpe, "PLAIN", lambda c: seen.append(c) or plain(c))
    encoder.block(*buffers(pa.array([prose(300, 3) + " it's  two\n\n blanks", prose(50, 4)])))
    assert seen and len(seen) == len(set(seen))


def test_exact_windows_cost_no_padding():
    """Cuts of least cost against all ways to cut: windows of a power of two cost nothing."""
    r = random.Random(5)
    for _ in range(60):
        n = r.randrange(1, 40)
        docs = np.array(sorted({n, *(r.randrange(1, n + 1) for _ in range(3))}))
        sentences = np.array(sorted({r.randrange(1, n + 1) for _ in range(4)}))
        fee = [0 if k in docs else 1 if k in sentences else 8 for k in range(n + 1)]
        cost = lambda ends: sum(fee[b] + (0 if (b - a) & (b - a - 1) == 0 else 16 - (b - a)) for a, b in zip([0, *ends[:-1]], ends, strict=True))  # noqa: B023, E731
        best = [0.0] + [float("inf")] * n
        soft = {0, n, *docs.tolist(), *sentences.tolist()}
        for b in range(1, n + 1):
            for a in range(max(0, b - 16), b):
                if b in soft or b - a == 16:
                    best[b] = min(best[b], best[a] + fee[b] + (0 if (b - a) & (b - a - 1) == 0 else 16 - (b - a)))
        got = packing.cuts(n, docs, sentences, 16, 1, 8, 1)
        assert got[-1] == n and all(0 < b - a <= 16 for a, b in zip([0, *got[:-1]], got, strict=True)) and cost(got) >= best[n]
        if n <= 16:
            assert cost(got) == best[n]
