"""Quality rules: base rules and gradient-boosted trees over document statistics.

The trees are trained on the driver from a bounded sample of labelled rows (SAMPLE_ROWS), with monotonic
constraints on chosen features, and flattened into numpy node arrays that score blocks of documents at once.

Defined cases: a null or empty text has no words and fails the base rules; repeated rows are judged alike; of rows with
one doc_id and different texts the text of the smallest hash is learnt from; any type of doc_id will do; labels with a null
doc_id or quality aren't learnt from; without labels of both classes the method keeps all that the
base rules keep; extra columns are ignored; a null doc_id stays null.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Block, blocks, doc_of, give_back, mix, prefix_sums, span_hashes

#: At most so many labelled rows are learnt from, those of the smallest hash; a bound of the training only.
SAMPLE_ROWS = 12_000
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A document goes only if the trees are this sure that it is bad.
REJECT_AT = 0.5

#: Name and constraint of each statistic: +1, the badness may only rise with it; -1, only fall; 0, free.
FEATURES = (
    ("log_words", 0), ("mean_word", 0), ("symbols_per_word", 1), ("upper_share", 1), ("digit_share", 0), ("dup_line_share", 1),
    ("repeat_share", 1), ("distinct_share", 0), ("pipes_per_word", 1), ("bangs_per_word", 1), ("punct_share", 0),
    ("words_per_line", 0), ("same_as_last_share", 1), ("nonascii_share", 0), ("stop_share", 0),
)
WORD_CLASS = {
    "sym": b"#*$%&|<>", "pipe": b"|", "bang": b"!", "digit": b"0123456789", "upper": bytes(range(65, 91)),
    "letter": bytes([*range(65, 91), *range(97, 123)]), "punct": bytes(b for b in range(33, 127) if not chr(b).isalnum()), "stop": b".",
}
CLASS = {k: np.isin(np.arange(256), list(v)) for k, v in WORD_CLASS.items()}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = np.zeros(len(k), bool)
    eq = k[1:] == k[:-1]
    same[1:] |= eq
    same[:-1] |= eq
    out = np.zeros(len(k), bool)
    out[order] = same
    return out


def _later(keys: np.ndarray) -> np.ndarray:
    """Which keys have occurred before."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    out = np.zeros(len(k), bool)
    out[order[1:]] = k[1:] == k[:-1]
    return out


def statistics(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """The base counts (BASE) and the statistics (FEATURES) of each document of a block."""
    starts, ends, first = b.words()
    nw = np.diff(first)
    p = prefix_sums(b.buf)
    docs = doc_of(first)
    h = span_hashes(p, starts, ends)
    salt = mix(np.arange(1, b.n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    covered = np.zeros(len(h), bool)
    if len(h) >= 3:
        tri = mix(h[:-2] * np.uint64(3) + mix(h[1:-1] * np.uint64(5)) + mix(mix(h[2:] + np.uint64(7)))) ^ salt[docs[:-2]]
        ok = docs[:-2] == docs[2:]
        at = np.flatnonzero(ok)
        at = at[_repeats(tri[at])]
        for k in range(3):
            covered[at + k] = True
    count = lambda flags: np.bincount(docs[flags], minlength=b.n) if len(docs) else np.zeros(b.n, np.int64)
    full = ~SPACE[b.buf]
    chars = b.per_doc(full & ((b.buf & 0xC0) != 0x80))
    by = {k: b.per_doc(v[b.buf]) for k, v in CLASS.items()}
    # lines: split at \n, within documents
    nl = np.flatnonzero(b.buf == 10)
    ls = np.sort(np.concatenate([b.offs[:-1], nl + 1]), kind="stable")
    doc_l = np.searchsorted(b.offs[1:], ls, "right")
    # a line that starts where its document ends (text ends in \n, or is empty) has no word; it may be filed under the next document
    le = np.minimum(np.concatenate([ls[1:], [len(b.buf)]]), len(b.buf))
    cut = np.searchsorted(nl, ls)
    le = np.minimum(le, np.concatenate([nl, [len(b.buf)]])[cut])
    c = np.zeros(len(b.buf) + 1, np.int64)
    np.cumsum(full, out=c[1:])
    has = (c[le] > c[ls]) & (doc_l < b.n)
    ls, le, doc_l = ls[has], le[has], doc_l[has]
    lines = np.bincount(doc_l, minlength=b.n)
    dup = np.bincount(doc_l[_later(span_hashes(p, ls, le) ^ salt[doc_l])], minlength=b.n) if len(ls) else np.zeros(b.n, np.int64)
    rep = count(covered)
    again = count(_later(h ^ salt[docs])) if len(h) else np.zeros(b.n, np.int64)
    run = np.zeros(len(h), bool)
    if len(h):
        run[1:] = (h[1:] == h[:-1]) & (docs[1:] == docs[:-1])
    base = np.stack([nw, chars, by["sym"], dup, rep], 1).astype(np.int64)
    w, ch = np.maximum(nw, 1), np.maximum(chars, 1)
    nonascii = b.per_doc(b.buf >= 0xC0)
    x = np.stack([np.log1p(nw), chars / w, by["sym"] / w, by["upper"] / np.maximum(by["letter"], 1), by["digit"] / ch, dup / np.maximum(lines, 1), rep / w, 1 - again / w, by["pipe"] / w, by["bang"] / w, by["punct"] / ch, nw / np.maximum(lines, 1), count(run) / w, nonascii / ch, by["stop"] / w], 1)
    return base, x


@dataclass
class Trees:
    """All trees in flat arrays: node i tests x[feature[i]] <= threshold[i] and goes to left[i] or right[i]; a leaf points at itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    bias: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out += self.value[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))


def fit_trees(x: np.ndarray, y: np.ndarray, monotone=tuple(m for _, m in FEATURES), trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, lam: float = 1.0, min_rows: int = 20) -> Trees:
    """Newton boosting on the logistic loss over binned features. A split against a constraint is refused, and the
    values below a constrained split are held on either side of its middle, so the whole tree is monotonic."""
    n, f = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(f)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    prior = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    bias = float(np.log(prior / (1 - prior)))
    raw = np.full(n, bias)
    nodes: list[list] = []
    roots = []

    def grow(rows, g, h, d, lo, hi) -> int:
        at = len(nodes)
        G, H = g[rows].sum(), h[rows].sum()
        nodes.append([0, np.inf, at, at, float(np.clip(-G / (H + lam), lo, hi)) * rate])
        if d == 0 or len(rows) < 2 * min_rows:
            return at
        best = (1e-6, None)
        for j in range(f):
            m = len(edges[j])
            if not m:
                continue
            k = binned[rows, j]
            gl, hl, nl = (np.cumsum(np.bincount(k, v, m + 1))[:-1] for v in (g[rows], h[rows], np.ones(len(rows))))
            gr, hr, nr = G - gl, H - hl, len(rows) - nl
            vl, vr = np.clip(-gl / (hl + lam), lo, hi), np.clip(-gr / (hr + lam), lo, hi)
            gain = -(gl * vl + (hl + lam) * vl**2 / 2) - (gr * vr + (hr + lam) * vr**2 / 2) - G * G / (2 * (H + lam))
            gain[(nl < min_rows) | (nr < min_rows) | (monotone[j] * (vr - vl) < 0)] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] > best[0]:
                best = (gain[b], (j, b, vl[b], vr[b]))
        if best[1] is None:
            return at
        j, b, vl, vr = best[1]
        goes = binned[rows, j] <= b
        mid, m = (vl + vr) / 2, monotone[j]
        nodes[at][0], nodes[at][1] = j, float(edges[j][b])
        nodes[at][2] = grow(rows[goes], g, h, d - 1, mid if m < 0 else lo, mid if m > 0 else hi)
        nodes[at][3] = grow(rows[~goes], g, h, d - 1, mid if m > 0 else lo, mid if m < 0 else hi)
        return at

    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        root = grow(np.arange(n), p - y, p * (1 - p), depth, -np.inf, np.inf)
        roots.append(root)
        a = nodes
        flat = Trees(*(np.array([r[k] for r in a[root:]]) for k in range(5)), np.array([0]), 0.0, depth)
        flat.left, flat.right = flat.left - root, flat.right - root
        raw += flat.raw(x)
    cols = [np.array([r[k] for r in nodes]) for k in range(5)]
    return Trees(cols[0].astype(np.int32), cols[1].astype(float), cols[2].astype(np.int32), cols[3].astype(np.int32), cols[4].astype(float), np.array(roots, np.int32), bias, depth)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Trees | None:
    """Learn from a bounded sample of labelled rows; only their statistics, never their texts, reach the driver."""
    picked = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")).withColumn("_h", F.xxhash64(F.lit(7), "doc_id")).orderBy("_h", "doc_id").limit(sample_rows).select("doc_id", "quality")
    rows = docs.select("doc_id", "text").where("doc_id is not null").join(F.broadcast(picked), "doc_id").select(F.xxhash64("doc_id").alias("k"), "text", "quality", F.xxhash64("text").alias("t"))

    def stats(batches):
        for rb in batches:
            for b in blocks(rb.column(1)):
                base, x = statistics(b)
                yield pa.RecordBatch.from_arrays([rb.column(0)[b.rows], rb.column(2)[b.rows].cast(pa.int32()), pa.array(list(x), pa.list_(pa.float64())), rb.column(3)[b.rows]], ["k", "quality", "x", "t"])

    found = rows.mapInArrow(stats, "k long, quality int, x array<double>, t long").groupBy("k").agg(F.first("quality").alias("quality"), F.min_by("x", "t").alias("x")).toArrow()
    if not found.num_rows:
        return None
    order = np.argsort(found.column("k").to_numpy(), kind="stable")
    x = np.stack(found.column("x").to_numpy())[order]
    bad = 1.0 - np.clip(found.column("quality").to_numpy()[order], 0, 1)
    if bad.min() == bad.max():
        return None
    return fit_trees(x, bad)


def judge(docs: DataFrame, model: Trees | None, reject_at: float = REJECT_AT, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Every document's carried columns, base counts, base_failed, badness and kept."""
    src = docs.select(*(F.col(c) for c in carry), F.col("text").alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])

    def run(batches):
        for rb in batches:
            for b in blocks(rb.column(rb.num_columns - 1)):
                base, x = statistics(b)
                failed = (base[:, 0] < MIN_WORDS) | (100 * base[:, 4] > MAX_REPEAT_PERCENT * base[:, 0])
                bad = model.probability(x) if model is not None else np.zeros(len(x))
                own = [rb.column(i)[b.rows] for i in range(rb.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(base[:, k]) for k in range(5)), pa.array(failed), pa.array(bad), pa.array(~failed & (bad < reject_at))], [*carry, *BASE, "base_failed", "badness", "kept"])

    return src.mapInArrow(run, f"{kinds}, {', '.join(f'{c} long' for c in BASE)}, base_failed boolean, badness double, kept boolean")


def keep(docs: DataFrame, model: Trees | None, reject_at: float = REJECT_AT) -> DataFrame:
    """The documents that pass, with all their columns."""
    names = docs.columns
    src = docs.toDF(*(f"_x{i}" for i in range(len(names))))
    text = names.index("text")

    def run(batches):
        for rb in batches:
            ok = []
            for b in blocks(rb.column(text)):
                base, x = statistics(b)
                bad = model.probability(x) if model is not None else np.zeros(len(x))
                ok.append((base[:, 0] >= MIN_WORDS) & (100 * base[:, 4] <= MAX_REPEAT_PERCENT * base[:, 0]) & (bad < reject_at))
            yield rb.filter(pa.array(np.concatenate(ok))) if ok else rb
            give_back()

    return src.mapInArrow(run, src.schema).toDF(*names)
