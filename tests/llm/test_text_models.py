"""Language-model scoring, toxicity and quality rules."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from helpers import DOC, odd, prose, words

from quarrylog.llm import ngram, quality, toxicity
from quarrylog.llm.common import blocks


def kn(train):
    end, begin = "</s>", "<s>"
    uni, bi = Counter(), Counter()
    for w in train:
        s = [begin, *w, end]
        uni.update(s[1:])
        bi.update(zip(s, s[1:], strict=False))
    disc = lambda cs: [0, *ngram.discounts(*(sum(c == k for c in cs) for k in (1, 2, 3, 4)))]
    cont = Counter(b for _, b in bi)
    d, e, total = disc(bi.values()), disc(cont.values()), sum(cont.values())
    g0 = sum(e[min(c, 3)] for c in cont.values()) / max(total, 1) if total else 1.0
    tot, gam = Counter(), Counter()
    for (a, _), c in bi.items():
        tot[a] += c
        gam[a] += d[min(c, 3)]

    def p(a, b):
        low = g0 / (len(uni) + 1) + (cont[b] - e[min(cont[b], 3)]) / max(total, 1)
        return (bi[a, b] - d[min(bi[a, b], 3)]) / tot[a] + gam[a] / tot[a] * low if tot[a] else low

    def scores(w):
        s = [begin, *w, end]
        n, v = sum(uni.values()), len(uni)
        return sum(math.log10(p(a, b)) for a, b in zip(s, s[1:], strict=False)), sum(math.log10((uni[x] + 0.1) / (n + 0.1 * (v + 1))) for x in s[1:]), sum(uni[x] > 0 for x in s[1:]), n

    return scores


def test_scores_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, prose(rng, int(rng.integers(0, 60))), "en", "a", 0) for i in range(150)]
    docs = spark.createDataFrame(rows, DOC).unionByName(odd(spark).select("doc_id", "text", "lang", "source", "n_chars")).repartition(5)
    every = docs.select("doc_id", "text").collect()
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    scores = kn([words(r.text) for r in every if not held(r.doc_id)])
    got = ngram.train_and_score(docs).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = sorted(((r.doc_id, len(words(r.text)) + 1, held(r.doc_id), *scores(words(r.text))) for r in every), key=key)
    for g, w in zip(sorted(((r.doc_id, r.n_tokens, r.held_out, r.score, r.base_score, r.n_known, r.train_tokens) for r in got), key=key), want, strict=True):
        assert g[:3] == w[:3] and g[5:] == w[5:]
        assert math.isclose(g[3], w[3], rel_tol=1e-9) and math.isclose(g[4], w[4], rel_tol=1e-9)


def test_no_rows_and_no_training_rows(spark):
    none = spark.createDataFrame([], DOC)
    assert ngram.train_and_score(none).count() == 0
    alone = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = ngram.train_and_score(spark.createDataFrame([(alone, "a b", "en", "s", 3)], DOC)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.score) == (3, 0, 0, 0.0)


def test_unseen_words_and_contexts(spark):
    rows = [(i, "a b c a b d" if i % 2 else "b c d d a", "en", "s", 0) for i in range(40) if zlib.crc32(str(i).encode()) % 10]
    probe = [(1000 + k, f"a {w}", "en", "s", 0) for k, w in enumerate(["a", "b", "c", "d", "unseen"])] + [(2000, "a", "en", "s", 0)]
    train, test = spark.createDataFrame(rows, DOC), spark.createDataFrame(probe, DOC)
    from quarrylog.llm.common import Workspace

    model = ngram.train(train, Workspace(spark, "t"))
    p = {r.text: r for r in ngram.score(test.withColumnRenamed("lang", "x"), model, ("doc_id",)).join(test.select("doc_id", "text"), "doc_id").collect()}
    scores = kn([words(r[1]) for r in rows])
    for r in p.values():
        assert math.isclose(r.score, scores(words(r.text))[0], rel_tol=1e-9)


def test_toxicity_finds_documents_and_sentences(spark):
    rng = np.random.default_rng(5)
    rows, labels, spot = [], [], {}
    for i in range(900):
        parts = [prose(rng, 8) + "." for _ in range(int(rng.integers(1, 8)))]
        bad = i % 4 == 0
        if bad:
            at = int(rng.integers(0, len(parts)))
            parts[at] = parts[at].replace(" ", f" vile{'xyz'[i % 3]} ", 1)
            spot[i] = sum(len(p) + 1 for p in parts[:at])
        rows.append((i, " ".join(parts), "en", "a", 0))
        labels.append((i, 1, int(bad)))
    docs = spark.createDataFrame(rows, DOC)
    out = toxicity.train_and_score(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    held = [r for r in out if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    wrong = [r for r in held if r.predicted != (r.doc_id % 4 == 0)]
    assert len(wrong) <= 0.03 * len(held) and all(0 <= r.score <= 1 for r in out)
    hits = [r for r in held if r.doc_id in spot and r.predicted]
    assert sum(any(s.start == spot[r.doc_id] for s in r.offending) for r in hits) >= 0.95 * len(hits)


def feature(t):
    """The hashes of a word and of its prefixes."""
    (b,) = blocks(pa.array([t]), lower=True)
    return toxicity.sentences(b)[0][0].tolist()


def test_toxicity_scores_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    signs = [". ", "! ", "? ", "\n", " ", " ", ", ", "... ", "!?", ""]
    texts = ["".join(f"{w}{rng.choice(signs)}" for w in prose(rng, int(rng.integers(0, 40)), 60).split()) for _ in range(80)] + [None, "", "...", "x" * 30_000, "w1. " * 5000, "É w2! ÉÉ w3"]
    names = [f"w{i}" for i in range(60)]
    weights = {h: float(v) for w, v in zip(names, rng.normal(size=60), strict=True) for h in feature(w)[:1]}
    model = toxicity.Model(np.array(sorted(weights), np.uint32), np.array([weights[h] for h in sorted(weights)]), -2.5)
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], DOC)
    out = {r.doc_id: r for r in toxicity.score(docs, model, threshold=0.3).collect()}
    known = {w: weights[feature(w)[0]] for w in names}
    for i, t in enumerate(texts):
        none, offending = 1.0, 0
        low = (t or "").translate({k: k + 32 for k in range(65, 91)})
        for part in re.split(r"[.!?\n]", low):
            own = [w for w in re.split(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", part) if w]
            if own:
                p = 1 / (1 + math.exp(2.5 - sum(known.get(w, 0.0) for w in own)))
                none, offending = none * (1 - p), offending + (p >= 0.3)
        assert math.isclose(out[i].score, 1 - none, rel_tol=1e-9, abs_tol=1e-12), t
        assert len(out[i].offending) == offending and out[i].predicted == (1 - none >= 0.3)


def test_toxicity_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(3)
    doc = np.sort(rng.integers(0, 6, 15))
    bags = toxicity.Bags(rng.integers(0, 4, 40), rng.integers(0, 15, 40), doc, np.array([0, 1, 0, 1, 1, 0]), rng.random(6) + 0.5)
    w, bias, e = rng.normal(size=4), -0.7, 1e-6
    _, gw, gb = bags.loss(w, bias, 0.01)
    slope = [(bags.loss(w + e * np.eye(4)[k], bias, 0.01)[0] - bags.loss(w - e * np.eye(4)[k], bias, 0.01)[0]) / (2 * e) for k in range(4)]
    # a document without a sentence can't be explained; its loss is flat
    assert np.allclose(gw, slope, atol=1e-6) and math.isclose(gb, (bags.loss(w, bias + e, 0.01)[0] - bags.loss(w, bias - e, 0.01)[0]) / (2 * e), abs_tol=1e-6)


def test_training_does_not_hang_on_order_or_key_type(spark):
    rng = np.random.default_rng(6)
    rows = [(f"d{i}", prose(rng, 20) + (" vile" if i % 3 == 0 else ""), i) for i in range(200)]
    rows += [(f"d{i}", f"another vile text {i}", i) for i in range(0, 200, 7)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, n int")
    labels = spark.createDataFrame([(f"d{i}", int(i % 2), int(i % 3 == 0)) for i in range(200)], "doc_id string, quality int, toxic int")
    a, b = (toxicity.train(docs.orderBy(c).repartition(k), labels) for c, k in (("n", 2), ("text", 5)))
    assert a.words.tolist() == b.words.tolist() and np.allclose(a.weights, b.weights) and len(a.words)
    x, y = (quality.train(docs.orderBy(c).repartition(k), labels) for c, k in (("n", 2), ("text", 5)))
    assert x.value.tolist() == y.value.tolist() and x.threshold.tolist() == y.threshold.tolist()


def test_toxicity_odd_rows_and_labels(spark):
    labels = spark.createDataFrame([(None, 1, 1), (4, 1, None), (9, 0, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.train_and_score(odd(spark), labels).collect()
    assert len(out) == 8 and {r.score for r in out} == {0.0}
    assert toxicity.train_and_score(spark.createDataFrame([], DOC), labels).count() == 0


def base(t):
    w = (t or "").encode().split()
    c, cov = Counter(zip(w, w[1:], w[2:], strict=False)), set()
    for k in range(len(w) - 2):
        if c[tuple(w[k : k + 3])] > 1:
            cov |= {k, k + 1, k + 2}
    lines = [x for x in (t or "").split("\n") if x.encode().split()]
    return len(w), sum(len(x.decode()) for x in w), sum(x in "#*$%&|<>" for x in t or ""), len(lines) - len(set(lines)), len(cov)


def test_quality_counts_and_verdicts(spark):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(400):
        good = i % 3 > 0
        text = "\n".join(prose(rng, 12, 4000) for _ in range(8))
        if not good:
            text = "\n".join(f"{x} |" if i % 2 else f"{x.upper()}!! ###" for x in text.split())
        rows.append((i, text + ("\n" if i % 5 else "\né é é é é é\n\n"), "en", "a", 0))
        labels.append((i, int(good), 0))
    docs = spark.createDataFrame(rows, DOC).unionByName(odd(spark).select("doc_id", "text", "lang", "source", "n_chars"))
    model = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    out = quality.judge(docs, model).collect()
    want = Counter(((r.doc_id, *base(r.text)) for r in docs.collect()))
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out) == want
    for r in out:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    fine = [r for r in out if r.doc_id is not None and not r.base_failed and r.doc_id >= 10]
    assert np.mean([r.kept == (r.doc_id % 3 > 0) for r in fine]) > 0.97
    kept = quality.keep(odd(spark).unionByName(odd(spark)), model)
    assert kept.columns == odd(spark).columns and kept.count() == 0


def test_trees_keep_constraints():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = (rng.random(2000) < 0.2 + 0.6 * x[:, 0] * (x[:, 1] > 0.5)).astype(float)
    t = quality.fit_trees(x, y, monotone=(1, -1, 0), trees=30)
    at = rng.random((50, 3))
    for j, sign in ((0, 1), (1, -1)):
        line = np.repeat(at, 40, 0)
        line[:, j] = np.tile(np.linspace(0, 1, 40), 50)
        assert (sign * np.diff(t.raw(line).reshape(50, 40), axis=1) >= -1e-12).all()


def test_quality_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.train(odd(spark), labels) is None
    assert quality.judge(spark.createDataFrame([], DOC), None).count() == 0
