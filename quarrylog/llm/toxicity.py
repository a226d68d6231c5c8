"""Toxicity by multiple-instance learning: sentence scores combined by noisy-or, trained from document labels alone.

Words have features of their own and of their first PREFIXES bytes, so inflected and run-together forms are met too.
A document is toxic if any of its sentences is: P = 1 - prod(1 - p_j), p_j the logistic score of sentence j over its words.
The gradient of the document's log-likelihood reaches a sentence in proportion to its part in P, so the sentences that
explain a label learn it. The words' weights then locate the offending sentences. The model is fitted on the driver from
a bounded sample of labelled documents (SAMPLE_ROWS): features are counted and chosen in Spark, and of the documents only
where the chosen ones occur reaches the driver. Every document is scored over its whole text.

Defined cases: a null or empty text has no sentence and scores 0; repeated rows score alike; of rows with one doc_id and
different texts the text of the smallest hash is learnt from; labels with a null doc_id or a null mark are left out; any
type of doc_id will do; without labels of both kinds every document gets the share of marked ones (0 if none is labelled).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Block, Workspace, blocks, crc_mod, doc_of, prefix_sums, span_hashes

#: At most so many labelled documents of either mark are learnt from, those of the smallest hash; a bound of the training
#: only. The loss weighs them by how many they stand for, so scores stay probabilities.
SAMPLE_ROWS = 4_000
#: Only features whose documents are marked more often than others have weights, if the log-likelihood ratio says so as firmly.
#: With a weight for each of the many features of one or two documents, the fit would learn the documents by heart.
MIN_RATIO = 14.0
PREFIXES = (4, 5, 6)
THRESHOLD = 0.3
_OUTSIDE = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
_STOP = np.isin(np.arange(256), list(b".!?\n"))


@dataclass
class Model:
    words: np.ndarray  # sorted 32-bit feature hashes
    weights: np.ndarray
    bias: float
    constant: float | None = None


def sentences(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature hashes (a row per word; 0 where a word is no longer than the prefix), word starts and ends, each sentence's first word, and each document's first sentence (n + 1 long).

    A sentence ends at a document's end or where ., !, ? or a line break stands between two words. b: lower-cased."""
    starts, ends, first = b.words(_OUTSIDE)
    sums = prefix_sums(b.buf)
    h = np.zeros((len(starts), 1 + len(PREFIXES)), np.uint32)
    h[:, 0] = span_hashes(sums, starts, ends) >> np.uint64(32)
    for k, n in enumerate(PREFIXES, 1):
        long = np.flatnonzero(ends - starts > n)
        h[long, k] = (span_hashes(sums, starts[long], starts[long] + n) * np.uint64(2 * n + 1)) >> np.uint64(32)
    c = np.zeros(len(b.buf) + 1, np.int64)
    np.cumsum(_STOP[b.buf], out=c[1:])
    new = np.ones(len(h), bool)
    new[1:] = c[starts[1:]] > c[ends[:-1]]
    new[first[:-1][np.diff(first) > 0]] = True
    at = np.flatnonzero(new)
    return h, starts, ends, at, np.searchsorted(at, first)


def associated(seen: DataFrame, marked: int, total: int) -> DataFrame:
    """Of features (f) with the number of documents that have them (n) and of marked ones among these (a): those whose documents
    are marked beyond chance, by the log-likelihood ratio."""

    def ll(k, m):
        p = F.least(F.greatest(k / F.greatest(m, F.lit(1.0)), F.lit(1e-9)), F.lit(1 - 1e-9))
        return k * F.log(p) + (m - k) * F.log(1 - p)

    A, N, a, n = F.lit(float(marked)), F.lit(float(total)), F.col("a").cast("double"), F.col("n").cast("double")
    ratio = 2 * (ll(a, n) + ll(A - a, N - n) - ll(n * A / N, n) - ll((N - n) * A / N, N - n))
    return seen.where((F.col("f") != 0) & (a * N > n * A) & (ratio >= MIN_RATIO)).select("f")


@dataclass
class Bags:
    """Labelled documents as bags of sentences: of each occurrence of a chosen feature its place among them and its sentence;
    of each sentence its document; of each document its mark and its weight."""

    at: np.ndarray
    sentence: np.ndarray
    doc: np.ndarray
    y: np.ndarray
    weight: np.ndarray

    def loss(self, w: np.ndarray, bias: float, l2: float) -> tuple[float, np.ndarray, float]:
        """The weighted mean log-loss of the noisy-or, half l2 times the weights' squares, and its gradient by weights and bias."""
        s = np.clip(bias + np.bincount(self.sentence, w[self.at], len(self.doc)), -30, 30)
        p = 1 / (1 + np.exp(-s))
        none = np.bincount(self.doc, -np.logaddexp(0, s), len(self.y))  # log(1 - P)
        P = np.maximum(-np.expm1(none), 1e-12)
        share = self.weight / self.weight.sum()
        value = float((share * np.where(self.y == 1, -np.log(P), -none)).sum() + l2 / 2 * (w * w).sum())
        g = p * (share * np.where(self.y == 1, -(1 - P) / P, 1.0))[self.doc]
        return value, np.bincount(self.at, g[self.sentence], len(w)) + l2 * w, float(g.sum())


def fit(words: np.ndarray, bags: Bags, steps: int = 250, rate: float = 0.15, l2: float = 2e-5) -> Model:
    """Adam on the loss of the bags. words: the chosen features, ascending."""
    y = bags.y
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(0, np.uint32), np.zeros(0), 0.0, float(y.mean()) if len(y) else 0.0)
    w, bias = np.zeros(len(words)), -5.0
    m, v, mb, vb = np.zeros(len(w)), np.zeros(len(w)), 0.0, 0.0
    for t in range(1, steps + 1):
        _, gw, gb = bags.loss(w, bias, l2)
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        a, c = 1 - 0.9**t, 1 - 0.99**t
        w -= rate * (m / a) / (np.sqrt(v / c) + 1e-6)
        bias -= rate * (mb / a) / (np.sqrt(vb / c) + 1e-6)
    return Model(words, w, float(bias))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """docs: doc_id and text of the documents that may be learnt from; labels: doc_id and toxic."""
    ws = Workspace(docs.sparkSession, "toxicity")
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.least(F.max("toxic"), F.lit(1)).alias("toxic"))
    total = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    some = lambda m: marks.where(m).withColumn("_h", F.xxhash64(F.lit(3), "doc_id")).orderBy("_h", "doc_id").limit(sample_rows).select("doc_id", "toxic")
    marked = some(F.col("toxic") == 1).union(some(F.col("toxic") != 1))  # at most 2 x sample_rows, so it may be broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("toxic").cast("int").alias("toxic"))
    rows = ws.cut(rows, "sample").select("text", F.greatest("toxic", F.lit(0)).alias("toxic"), F.xxhash64("doc_id").alias("k"))
    count = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n = np.array([count.get(k, 0) for k in (0, 1)])
    if not n.all():
        y = np.repeat(np.arange(2), n)
        return fit(np.zeros(0, np.uint32), Bags(y[:0], y[:0], y[:0], y, np.ones(len(y))))

    def features(batches):
        for rb in batches:
            for b in blocks(rb.column(0), lower=True):
                h, _, _, at, first = sentences(b)
                doc = np.repeat(doc_of(np.append(at, len(h))[first]), h.shape[1])
                own = np.unique((doc.astype(np.uint64) << np.uint64(32)) | h.ravel())
                mark = rb.column(1)[b.rows].to_numpy()[(own >> np.uint64(32)).astype(np.int64)]
                f, inv = np.unique((own & np.uint64(0xFFFFFFFF)).astype(np.int64), return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(np.bincount(inv, minlength=len(f))), pa.array(np.bincount(inv, mark, len(f)).astype(np.int64))], ["f", "n", "a"])

    seen = rows.select("text", "toxic").mapInArrow(features, "f long, n long, a long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("a").alias("a"))
    words = np.sort(associated(seen, int(n[1]), int(n.sum())).toArrow().column("f").to_numpy()).astype(np.uint32)

    def occurrences(batches):
        for rb in batches:
            for b in blocks(rb.column(0), lower=True):
                h, _, _, at, first = sentences(b)
                flat = h.ravel()
                k = np.minimum(np.searchsorted(words, flat), max(len(words) - 1, 0))
                ok = np.flatnonzero(words[k] == flat) if len(words) else np.zeros(0, np.int64)
                sentence = np.searchsorted(at, ok // h.shape[1], "right") - 1
                doc = doc_of(first)[sentence]
                offs = pa.array(np.searchsorted(doc, np.arange(b.n + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offs, pa.array(x.astype(np.int32))) for x in (k[ok], sentence - first[doc])]
                yield pa.RecordBatch.from_arrays([rb.column(2)[b.rows], rb.column(1)[b.rows], pa.array(np.diff(first).astype(np.int32)), *lists], ["k", "toxic", "sentences", "at", "of"])

    t = rows.mapInArrow(occurrences, "k long, toxic int, sentences int, at array<int>, of array<int>").orderBy("k").toArrow()
    size, y = t.column("sentences").to_numpy(), t.column("toxic").to_numpy()
    begins, each = np.cumsum(size) - size, [np.asarray(x) for x in t.column("of").to_numpy()]
    flat = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.int64)
    stands_for = np.array([sum(v for k, v in total.items() if k != 1), total.get(1, 0)]) / n
    return fit(words, Bags(flat(t.column("at").to_numpy()), flat([x + o for x, o in zip(each, begins, strict=True)]), np.repeat(np.arange(len(y)), size), y, stands_for[y]))


def score(docs: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """Each document's carried columns, score, predicted, and its offending sentences with their places in code points."""
    src = docs.select(*carry, "text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])

    def run(batches):
        for rb in batches:
            for b in blocks(rb.column(rb.num_columns - 1), lower=True):
                h, starts, ends, at, first = sentences(b)
                w = np.zeros(len(h))
                if len(model.words):
                    for f in h.T:
                        k = np.minimum(np.searchsorted(model.words, f), len(model.words) - 1)
                        w += np.where(model.words[k] == f, model.weights[k], 0.0)
                s = np.clip(model.bias + np.add.reduceat(w, at), -30, 30) if len(at) else np.zeros(0)
                none = np.bincount(doc_of(first), -np.logaddexp(0, s), b.n) if len(at) else np.zeros(b.n)
                p = -np.expm1(none) if model.constant is None else np.full(b.n, model.constant)
                hot = np.flatnonzero(1 / (1 + np.exp(-s)) >= threshold) if model.constant is None else np.zeros(0, np.int64)
                code = np.zeros(len(b.buf) + 1, np.int64)
                np.cumsum((b.buf & 0xC0) != 0x80, out=code[1:])
                doc = doc_of(first)[hot]
                last = np.append(at[1:], len(h))[hot] - 1
                offs = pa.array(np.searchsorted(doc, np.arange(b.n + 1)).astype(np.int32))
                base = code[b.offs[doc]]
                spans = pa.StructArray.from_arrays([pa.array((code[starts[at[hot]]] - base).astype(np.int32)), pa.array((code[ends[last]] - base).astype(np.int32)), pa.array(1 / (1 + np.exp(-s[hot])))], ["start", "end", "score"])
                yield pa.RecordBatch.from_arrays([*(rb.column(i)[b.rows] for i in range(rb.num_columns - 1)), pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.ListArray.from_arrays(offs, spans)], [*carry, "score", "predicted", "offending"])

    return src.mapInArrow(run, f"{kinds}, score double, predicted int, offending array<struct<start:int,end:int,score:double>>")


def train_and_score(docs: DataFrame, labels: DataFrame, modulus: int = 4, rest: int = 2) -> DataFrame:
    """Learn from the documents outside the held-out part and score them all."""
    held = lambda d: d.withColumn("held_out", crc_mod("doc_id", modulus) == rest)
    # the sample is drawn from labels outside the held-out part, so its size doesn't hang on the split
    model = train(docs, held(labels.select("doc_id", "toxic")).where(~F.col("held_out")).drop("held_out"))
    return score(held(docs.select("doc_id", "text")), model, ("doc_id", "held_out"))
