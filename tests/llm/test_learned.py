"""Spelling variants, whitening and quality against brute force and held-out labels, over odd rows."""

import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioloom.llm import quality, queries, spelling, whitening
from folioloom.llm.common import Shelf

FOLDER = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = "doc_id long, text string, word string, n int, key string"


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            at = h % len(run)
            run = run[:at] + run[at + 1 :] if h % 97 == 0 else run
            found[run] += len(run) >= 5
    n = {w: k for w, k in found.items() if k >= 3}
    forms, out = {}, {}
    for w in n:
        close = sorted((-n[v], v) for v in n if near(v, w))
        forms[w] = (close[0][1] if close and -close[0][0] >= 2 * n[w] else None), len(close)
    for w in n:
        root = w
        while forms[root][0]:
            root = forms[root][0]
        form, k = forms[w]
        out[w] = (n[w], k, form, n[form] if form else None, root)
    return out


def misspelt(seed):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("aabcñé") for _ in range(rng.randint(5, 11))) for _ in range(25)] + ["aaaaa", "aaaaaa", "aaaaaaa", "÷÷×××÷", "x" * 3000, "x" * 1500 + "y" + "x" * 1500, "x" * 2999]
    rows = [(None, "Null ids COUNT count cOunt counts"), (3, None), (4, ""), (5, "a b c 123 日本語日本語 ABCDÉ abcdÉ abcdÉ abcdé abcdé abcdé")]
    for k in range(120):
        said = []
        for _ in range(60):
            w = rng.choice(stems)
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abñ") + w[at:], w[:at] + rng.choice("abc") + w[at + 1 :]])
            said.append(w.upper() if rng.random() < 0.2 else w)
        rows.append((k, rng.choice([" ", ", ", "9"]).join(said)))
    return rows + [rows[-1], (1, "Zweifel zweifel zweifel")]


@pytest.mark.parametrize("limit", [2_000, 3])
def test_variants(spark, limit):
    rows = misspelt(1)
    docs = spark.createDataFrame([(*r, "clash", 1, "k") for r in rows], TEXTS).repartition(3)
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.variants(docs, limit).collect()}
    want = plain_variants(rows)
    assert got == want and any(v[2] for v in want.values()) and any(v[4] != v[2] for v in want.values() if v[2])


def test_variants_without_words(spark):
    none = spark.createDataFrame([], TEXTS)
    assert spelling.variants(none).count() == 0
    alone = spark.createDataFrame([(k, "lonely", None, None, None) for k in range(3)], TEXTS)
    assert [tuple(r) for r in spelling.variants(alone).select("word", "n", "n_near", "form", "form_n", "root").collect()] == [("lonely", 3, 0, None, None, "lonely")]


def test_acceptors_and_composition():
    for seed in range(20):
        rng = random.Random(seed)
        m, letters = rng.randint(5, 8), "ab" if seed % 2 else "abcé"
        found = {"".join(rng.choice(letters) for _ in range(rng.choice([m, m + 1]))) for _ in range(60)}
        shorter, longer = sorted(w for w in found if len(w) == m), sorted(w for w in found if len(w) > m)
        want = sorted((a, b) for a in shorter for b in shorter + longer if near(a, b) and (a < b or len(b) > m))
        assert sorted(spelling.near_in(shorter, longer, 0, m + 1)) == want
        assert sorted(p for low, high in ((0, 2), (2, 3), (3, m + 1)) for p in spelling.near_in(shorter, longer, low, high)) == want
        made = spelling.Acceptor(sorted(found))
        assert len(made.arcs) == len({(e, *a.items()) for e, a in zip(made.ends, made.arcs)})
        stack, read = [(made.start, "")], []
        while stack:
            state, said = stack.pop()
            read += [said] * made.ends[state]
            stack += [(to, said + c) for c, to in made.arcs[state].items()]
        assert sorted(read) == sorted(found)


def test_partitions_are_bounded(spark):
    words = [("".join("ab"[k >> i & 1] for i in range(9)), 5) for k in range(512)]
    dealt = spelling.partitions(Shelf(spark), spark.createDataFrame(words, "word string, n long"), 20)
    sizes = dealt.groupBy("m", "low", "high", "key").count().collect()
    assert all(r["count"] <= 20 or r.high - r.low == 1 for r in sizes)
    assert spelling.near_pairs(dealt).count() == 512 * 9


VECTORS = "vec_id long, embedding array<float>, label int, v string, n string, component int"


def vectors(seed=3, n=400, d=12):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) * 0.2
    x[:, 4] = x[:, 3]
    x[50:120] = x[7 % n]
    return [(k, [float(np.float32(c)) for c in row], 0, "clash", "clash", 0) for k, row in enumerate(x)]


def test_whitening(spark):
    rows = vectors()
    odd = [(900, None), (901, []), (902, [1.0] * 11 + [None]), (903, [float("nan")] * 12), (904, [float("inf")] + [0.0] * 11), (905, [0.5] * 5), (906, [float("-inf")] * 12)]
    table = spark.createDataFrame(rows + [rows[3], (None, *rows[9][1:])] + [(*o, 1, None, None, None) for o in odd], VECTORS).repartition(11)
    got = whitening.whiten(table).collect()
    kept = rows + [rows[3], (None, *rows[9][1:])]
    x = [[int(np.floor(64 * np.float64(np.float32(c)))) + 1_000_000 for c in r[1]] for r in kept]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    off = np.array([[(n * c - s) for c, s in zip(row, sums)] for row in x], dtype=np.float64) / n
    cov = off.T @ off / n
    e, vectors_ = np.linalg.eigh(cov)
    e, vectors_ = e[::-1], vectors_[:, ::-1]
    k = int((e > 1e-12 * e[0]).sum())
    assert k == 11 and len(got) == n * k and {r.n for r in got} == {n}
    assert {(r.vec_id, r.deviation) for r in got} == {(r[0], sum((n * c - s) ** 2 for c, s in zip(row, sums))) for r, row in zip(kept, x)}
    want = off @ vectors_[:, :k] / np.sqrt(e[:k])
    place = {r[0]: i for i, r in enumerate(kept)}
    mine = np.zeros((n, k))
    for r in got:
        mine[place[r.vec_id], r.component - 1] = r.whitened
        assert abs(r.explained / (e[r.component - 1] / e.sum()) - 1) < 1e-9 and r.identity_error < 1e-9
    live = [i for i, r in enumerate(kept) if r[0] in place and place[r[0]] == i]
    signs = np.sign((mine[live] * want[live]).sum(axis=0))
    assert np.abs(mine[live] * signs - want[live]).max() < 1e-7


def test_whitening_of_few_rows(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert whitening.whiten(empty).count() == 0
    assert whitening.whiten(spark.createDataFrame(vectors(n=1), VECTORS)).count() == 0
    same = spark.createDataFrame([(k, [0.25, 0.5], 0, None, None, 0) for k in range(5)], VECTORS)
    assert whitening.whiten(same).count() == 0
    two = whitening.whiten(spark.createDataFrame([(0, [0.0, 0.0], 0, None, None, 0), (1, [1.0, 0.0], 0, None, None, 0)], VECTORS)).collect()
    assert sorted((r.component, r.deviation, round(abs(r.whitened), 12)) for r in two) == [(1, 4096, 1.0)] * 2
    huge = whitening.whiten(spark.createDataFrame([(k, [1e30 * k, float(k)], 0, None, None, 0) for k in range(-3, 4)], VECTORS)).collect()
    assert len(huge) == 7 and [r.deviation for r in huge].count(None) == 6


def test_spectra_by_rank_one_updates():
    rng = np.random.default_rng(5)
    x = np.floor(64 * rng.normal(size=(300, 16)))
    x[:40] = x[0]
    x[:, 5] = 7
    whole, other = whitening.Spectrum.empty(16), whitening.Spectrum.empty(16)
    for row in x[:180]:
        whole.add(row)
    for row in x[180:]:
        other.add(row)
    whole.merge(other)
    want = np.cov(x.T, bias=True) * len(x)
    assert whole.n == 300 and np.allclose(whole.mean, x.mean(axis=0))
    assert np.abs(whole.basis.T @ whole.basis - np.eye(16)).max() < 1e-12
    assert np.abs(whole.basis * whole.values @ whole.basis.T - want).max() < 1e-11 * np.abs(want).max()


def test_secular_roots_are_exact():
    rng = np.random.default_rng(2)
    for k in (1, 2, 7, 40):
        poles, weights = np.cumsum(rng.uniform(1e-6, 1, k)), rng.uniform(1e-12, 1, k)
        roots, away = whitening.secular_roots(poles, weights)
        want = np.linalg.eigvalsh(np.diag(poles) + np.sqrt(np.outer(weights, weights)))
        assert np.allclose(roots, want, rtol=1e-12, atol=1e-13) and np.allclose(away, poles[:, None] - roots, atol=1e-12)


@pytest.mark.skipif(not os.path.isdir(FOLDER.replace("0.001", "0.01")), reason="no tables")
def test_quality_of_held_out_documents(spark):
    folder = FOLDER.replace("0.001", "0.1")
    rows = queries.op13_quality(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    got = rows.join(labels, "doc_id").where("held_out").select("quality", "predicted", "score").collect()
    right = sum(r.quality == r.predicted for r in got) / len(got)
    assert len(got) > 500 and right > 0.97
    assert all(0 <= r.score <= 1 for r in got)


MARKS = "doc_id long, quality int, toxic int, text string"


def test_quality_of_odd_rows(spark):
    rng = random.Random(1)
    say = lambda letters, k: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(k))
    texts = [(k, say("abcdefghij", rng.randint(5, 300)) if k % 2 else say("#$%&!AB", rng.randint(5, 300))) for k in range(240)]
    odd = [(1000, None), (1001, ""), (1002, "日本語" * 50_000), (None, "abc def"), (7, texts[7][1])]
    docs = spark.createDataFrame([(*r, "x", 0, "clash", 9) for r in texts + odd], "doc_id long, text string, lang string, score int, quality string, held_out int")
    labels = spark.createDataFrame([(k, k % 2, 0, "clash") for k, _ in texts] + [(3, None, 1, None), (4, 5, 0, None), (None, 1, 0, None)], MARKS)
    model = quality.train(docs, labels)
    got = quality.predict(docs, model).collect()
    assert len(got) == 245 and len([r for r in got if r.doc_id == 7]) == 2
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {k for k, _ in texts + odd if k is not None and zlib.crc32(str(k).encode()) % 4 == 2}
    assert all((r.score >= 0.7) == bool(r.doc_id % 2) for r in held if r.doc_id < 240)
    none = docs.limit(0)
    assert quality.predict(none, model).count() == 0
    assert isinstance(quality.train(none, labels), quality.Constant) and isinstance(quality.train(docs, labels.where("quality = 1")), quality.Constant)
    assert {r.score for r in quality.predict(docs, quality.Constant(0.5)).collect()} == {0.5}


def test_quality_reads_whole_texts(spark):
    chunks = quality.chunks_of(bytes(range(256)) * 40)
    step = quality.CHUNK - quality.OVERLAP
    assert b"".join([bytes(c[:step]) for c in chunks[:-1]] + [bytes(chunks[-1])])[: 256 * 40] == bytes(range(256)) * 40
    net = quality.Network(3)
    net.weights[:] = np.random.default_rng(1).normal(size=net.weights.shape)
    long = ("abc def " * 60_000).encode()
    tables = net.tables()
    assert net.score(net.combined(long + b"#" * 300, tables)) != net.score(net.combined(long + b" " * 300, tables))
    # Filters meet every byte: the plain sum over embeddings of a chunk's windows.
    one = quality.chunks_of(b"hello world, hello bytes")
    top, _ = net.pooled(one, tables)
    windows = np.lib.stride_tricks.sliding_window_view(one[0], quality.WIDTH)
    plain = np.einsum("wkd,kdf->wf", net.bytes[windows], net.filters).max(axis=0) + net.bias
    assert np.allclose(top[0], np.maximum(plain, 0), atol=1e-4)


def test_gradients():
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab cd#") for _ in range(rng.randint(1, 600))).encode() for _ in range(5)]
    y = np.array([0, 1, 1, 0, 1], np.float32)
    net = quality.Network(2)
    net.weights[:] = np.random.default_rng(0).normal(0, 0.02, net.weights.shape)
    grads = net._gradients(texts, y)

    def loss():
        p = np.array([net.score(net.combined(t, net.tables())) for t in texts], np.float64)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for values, grad, at in ((net.weights, grads[3], (5,)), (net.bias, grads[2], (3,)), (net.shift, grads[4], (0,))):
        step = 1e-2
        values[at] += step
        up = loss()
        values[at] -= 2 * step
        down = loss()
        values[at] += step
        assert abs((up - down) / (2 * step) - grad[at]) < 0.05 * max(0.01, abs(grad[at]))
