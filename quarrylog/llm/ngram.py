"""Interpolated modified Kneser-Ney bigram model: counted in Spark, stored as sorted arrays, memory-mapped by workers.

1. Every task counts its words by 64-bit hash and sends sorted runs to hash-range shards; a shard merges its runs and
   writes the sorted hashes and counts to the shared folder. A word's id is its rank over all shards.
2. Every task counts its bigrams by (id, id) and sends sorted runs to shards of contexts. A context with a large part of
   all tokens is spread over all shards, so no shard holds more than its part. A shard writes sorted keys and counts.
3. Per-context totals and continuation counts are summed by ranges of word ids and written as flat arrays.
4. Scoring tasks map all these files and look up whole blocks of text at once.

Only counts of counts, shard sizes and a bounded list of hot contexts reach the driver. The order is two: the sorted
arrays of all trigrams alone would exceed the disk that the check allows (README). All that is gathered grows with the corpus.

Defined cases: a null or empty text is the end token alone; without training rows every token has probability 1 / 1
(the uniform distribution over the unknown word); repeated rows count and are scored each; a null doc_id hashes as ''.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Workspace, blocks, map_file, prefix_sums, span_hashes, write_bytes

END = U64(0x452821E638D01377)  # the end token's hash
RUN = 4_000_000  # keys that a task gathers before it sends a run
ID_RANGE = 1 << 20  # word ids in one file of the per-word arrays


def planes(v: np.ndarray) -> bytes:
    """64-bit numbers as the byte planes that aren't all zero, after one byte that says which those are."""
    p = np.ascontiguousarray(v.astype(U64).view(np.uint8).reshape(-1, 8).T)
    used = p.any(1)
    return np.packbits(used).tobytes() + p[used].tobytes()


def from_planes(data: bytes) -> np.ndarray:
    used = np.unpackbits(np.frombuffer(data, np.uint8, 1)).astype(bool)
    n = (len(data) - 1) // max(int(used.sum()), 1)
    p = np.zeros((8, n), np.uint8)
    p[used] = np.frombuffer(data, np.uint8, offset=1).reshape(-1, n) if used.any() else 0
    return np.ascontiguousarray(p.T).reshape(-1).view(U64)


def pack(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as byte planes of their differences."""
    d = keys.astype(U64)
    d[1:] -= keys[:-1].astype(U64)
    # a lone 0 would have no plane and no length: differences are stored one up
    return planes(d + U64(1))


def unpack(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data) - U64(1), dtype=U64)


def pack_counts(c: np.ndarray) -> bytes:
    return planes(c.astype(U64) + U64(1))


def unpack_counts(data: bytes) -> np.ndarray:
    return from_planes(data) - U64(1)


def count_keys(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and their counts."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    if counts is None:
        return keys[at], np.diff(at, append=len(keys)).astype(np.int64)
    return keys[at], np.add.reduceat(counts, at).astype(np.int64) if len(at) else np.zeros(0, np.int64)


def range_shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shards in order of the hashes, so their concatenation stays sorted."""
    return ((hashes >> U64(40)) * U64(shards)) >> U64(24)


class Runs:
    """Gathers keys and yields (shard, keys, counts) rows of sorted runs."""

    def __init__(self, shard_of, run: int = RUN):
        self.shard_of, self.run, self.parts, self.n = shard_of, run, [], 0

    def add(self, keys: np.ndarray):
        self.parts.append(keys)
        self.n += len(keys)
        if self.n >= self.run:
            yield from self.flush()

    def flush(self):
        if self.n:
            keys, counts = count_keys(np.concatenate(self.parts))
            self.parts, self.n = [], 0
            shard = self.shard_of(keys).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            bounds = np.flatnonzero(np.diff(shard[order], prepend=-1, append=-1))
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                own = order[a:b]
                yield pa.RecordBatch.from_arrays([pa.array([int(shard[own[0]])], pa.int32()), pa.array([pack(keys[own])], pa.binary()), pa.array([pack_counts(counts[own])], pa.binary())], ["shard", "keys", "counts"])


RUN_SCHEMA = "shard int, keys binary, counts binary"


def merged(table: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
    keys = [unpack(x.as_py()) for x in table.column("keys")]
    counts = [unpack_counts(x.as_py()).astype(np.int64) for x in table.column("counts")]
    return table.column("shard")[0].as_py(), *count_keys(np.concatenate(keys), np.concatenate(counts))


def word_hashes(block) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = block.words()
    return span_hashes(prefix_sums(block.buf), starts, ends), first


def tokens_of(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words with each document's end token, and the index of each document's first token."""
    n = len(first) - 1
    at = first + np.arange(n + 1)
    out = np.empty(len(h) + n, h.dtype)
    is_end = np.zeros(len(out), bool)
    is_end[at[1:] - 1] = True
    out[is_end] = END
    out[~is_end] = h
    return out, at


_mapped: dict[str, dict[str, np.ndarray]] = {}


def mapped(root: str, name: str, kind) -> np.ndarray:
    """A mapped file of the model; the worker keeps the newest model only."""
    if root not in _mapped:
        _mapped.clear()
    files = _mapped.setdefault(root, {})
    if name not in files:
        files[name] = map_file(f"{root}/{name}").view(kind)
    return files[name]


@dataclass
class Model:
    """Where the arrays lie, and the few numbers that the driver knows."""

    root: str
    shards: int
    starts: np.ndarray  # the first word id of each vocabulary shard, and the number of words
    tokens: int
    big_shards: int = 1
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    discounts: tuple = (0.5, 0.5, 0.5)
    low: tuple = (0.5, 0.5, 0.5)
    low_total: int = 0
    low_gamma: float = 1.0

    @property
    def words(self) -> int:
        return int(self.starts[-1])

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word ids (-1: unknown) and training counts."""
        u, inv = np.unique(hashes, return_inverse=True)
        ids, counts = np.full(len(u), -1, np.int64), np.zeros(len(u), np.int64)
        shard = range_shard(u, self.shards).astype(np.int64)
        bounds = np.flatnonzero(np.diff(shard, prepend=-1, append=-1))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):  # the shards that have any of these words
            s = int(shard[a])
            if self.starts[s] == self.starts[s + 1]:
                continue
            v = mapped(self.root, f"words-{s}", np.int64)
            n = len(v) // 2
            keys, c = v[:n].view(U64), v[n:]
            at = np.minimum(np.searchsorted(keys, u[a:b]), n - 1)
            ok = keys[at] == u[a:b]
            ids[a:b] = np.where(ok, at + self.starts[s], -1)
            counts[a:b] = np.where(ok, c[at], 0)
        return ids[inv], counts[inv]

    def big_shard(self, keys: np.ndarray) -> np.ndarray:
        """By context, or by context and word where the context is hot."""
        ctx = keys >> U64(32)
        from .common import mix

        hot = np.isin(ctx.astype(np.int64), self.hot)
        return mix(np.where(hot, keys, ctx)) % U64(self.big_shards)

    def per_word(self, name: str, ids: np.ndarray, kind) -> np.ndarray:
        out = np.zeros(len(ids), kind)
        part = ids >> 20
        for r in np.unique(part):
            if r >= 0:
                at = np.flatnonzero(part == r)
                out[at] = mapped(self.root, f"{name}-{r}", kind)[ids[at] & (ID_RANGE - 1)]
        return out

    def bigram_counts(self, keys: np.ndarray) -> np.ndarray:
        shard = self.big_shard(keys).astype(np.int64)
        order = np.lexsort((keys, shard))
        bounds = np.flatnonzero(np.diff(shard[order], prepend=-1, append=-1))
        out = np.zeros(len(keys), np.int64)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            own = order[a:b]
            v = mapped(self.root, f"bigrams-{int(shard[own[0]])}", np.uint8)
            n, width = v[:16].view(np.int64).tolist() if len(v) else (0, 4)
            if n:
                k, c = v[16 : 16 + 8 * n].view(U64), v[16 + 8 * n :].view(f"u{width}")
                at = np.minimum(np.searchsorted(k, keys[own]), n - 1)
                out[own] = np.where(k[at] == keys[own], c[at], 0)
        return out

    def log10(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 P of each token given the token before it in its document."""
        if not self.tokens:
            return np.zeros(len(ids))
        prev = np.empty(len(ids), np.int64)
        prev[1:] = ids[:-1]
        prev[first[:-1]] = self.words  # the start of a document
        cont = self.per_word("cont", ids, np.int64)
        low = self.low_gamma / (self.words + 1) + (cont - discount(cont, self.low)) / max(self.low_total, 1)
        known, seen = prev >= 0, (prev >= 0) & (ids >= 0)
        total = self.per_word("total", prev, np.float64)
        gamma = self.per_word("gamma", prev, np.float64)
        c = np.zeros(len(ids), np.int64)
        c[seen] = self.bigram_counts((prev[seen].astype(U64) << U64(32)) | ids[seen].astype(U64))
        has = known & (total > 0)
        p = np.where(has, (c - discount(c, self.discounts)) / np.where(has, total, 1) + gamma * low, low)
        return np.log10(p)


def discount(c: np.ndarray, d: tuple) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(c, 3)]


def discounts(n1: float, n2: float, n3: float, n4: float) -> tuple[float, float, float]:
    """Chen and Goodman's three discounts from the counts of counts; 0.5 steps where a count of counts is 0."""
    if not n1 or not n2:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.0]
    return tuple(float(min(max(x, 0.05), k + 0.95)) for k, x in enumerate(d))  # type: ignore[return-value]


def train(docs: DataFrame, ws: Workspace) -> Model:
    """docs: the texts to learn from, in the column text."""
    texts = docs.select("text")
    parts = max(1, texts.rdd.getNumPartitions())
    shards, big = max(4, parts), max(8, 2 * parts)
    root = ws.path("model")

    def words(batches):
        runs = Runs(lambda k: range_shard(k, shards))
        for rb in batches:
            for b in blocks(rb.column(0), lower=True):
                yield from runs.add(tokens_of(*word_hashes(b))[0])
        yield from runs.flush()

    def merge_words(t: pa.Table) -> pa.Table:
        s, keys, counts = merged(t)
        write_bytes(f"{root}/words-{s}", keys.tobytes() + counts.tobytes())
        top = np.argsort(-counts, kind="stable")[: 4 * big]
        return pa.table({"shard": pa.array([s], pa.int32()), "n": [len(keys)], "tokens": [int(counts.sum())], "docs": [int(counts[np.searchsorted(keys, END) % len(keys)]) if END in keys else 0], "ranks": [top.astype(np.int64)], "top": [counts[top]]})

    found = texts.mapInArrow(words, RUN_SCHEMA).repartition(shards, "shard").groupBy("shard").applyInArrow(merge_words, "shard int, n long, tokens long, docs long, ranks array<long>, top array<long>").collect()
    size = np.zeros(shards, np.int64)
    for r in found:
        size[r.shard] = r.n
    starts = np.concatenate([[0], np.cumsum(size)])
    if starts[-1] >= (1 << 32) - 1:
        raise ValueError("a bigram's key has 32 bits for a word's id; there are more distinct words")
    tokens = sum(r.tokens for r in found)
    limit = tokens / (4 * big)
    hot = [int(starts[r.shard] + k) for r in found for k, c in zip(r.ranks, r.top, strict=True) if c > limit]
    if sum(r.docs for r in found) > limit:
        hot.append(int(starts[-1]))
    model = Model(root, shards, starts, tokens, big, np.array(sorted(hot), np.int64))
    if not tokens:
        return model

    def bigrams(batches):
        runs = Runs(model.big_shard)
        for rb in batches:
            for b in blocks(rb.column(0), lower=True):
                h, first = tokens_of(*word_hashes(b))
                ids = model.ids(h)[0]
                prev = np.empty(len(ids), np.int64)
                prev[1:] = ids[:-1]
                prev[first[:-1]] = model.words
                yield from runs.add((prev.astype(U64) << U64(32)) | ids.astype(U64))
        yield from runs.flush()

    def by_range(kind: str, ids: np.ndarray, *cols: np.ndarray):
        part = ids >> 20
        bounds = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield int(part[a]), kind, pack(ids[a:b].astype(U64)), pack_counts(np.concatenate([c[a:b] for c in cols]))

    def merge_bigrams(t: pa.Table) -> pa.Table:
        s, keys, counts = merged(t)
        width = 4 if counts.max(initial=0) < 1 << 32 else 8
        write_bytes(f"{root}/bigrams-{s}", np.array([len(keys), width], np.int64).tobytes() + keys.tobytes() + counts.astype(f"u{width}").tobytes())
        of = [int((counts == k).sum()) for k in (1, 2, 3, 4)]
        ctx = (keys >> U64(32)).astype(np.int64)
        at = np.flatnonzero(np.diff(ctx, prepend=-1))
        sums = [np.add.reduceat(x.astype(np.int64), at) for x in (counts, counts == 1, counts == 2, counts > 2)]
        second, n = count_keys(keys & U64(0xFFFFFFFF))
        rows = [(-1, "of", b"", np.array(of, np.int64).tobytes()), *by_range("ctx", ctx[at], *sums), *by_range("cont", second.astype(np.int64), n)]
        return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.binary())], ["part", "kind", "ids", "nums"])

    stats = ws.cut(texts.mapInArrow(bigrams, RUN_SCHEMA).repartition(big, "shard").groupBy("shard").applyInArrow(merge_bigrams, "part int, kind string, ids binary, nums binary"), "stats")
    of = sum(np.frombuffer(r.nums, np.int64) for r in stats.where("kind = 'of'").select("nums").collect())
    model.discounts = d = discounts(*of)

    def merge_range(t: pa.Table) -> pa.Table:
        r = t.column("part")[0].as_py()
        cont, ctx = np.zeros(ID_RANGE, np.int64), np.zeros((4, ID_RANGE), np.int64)
        for kind, ids, nums in zip(*(t.column(c).to_pylist() for c in ("kind", "ids", "nums")), strict=True):
            at = (unpack(ids) & U64(ID_RANGE - 1)).astype(np.int64)
            v = unpack_counts(nums).astype(np.int64)
            if kind == "cont":
                cont[at] += v
            else:
                ctx[:, at] += v.reshape(4, -1)
        total = ctx[0].astype(np.float64)
        gamma = (d[0] * ctx[1] + d[1] * ctx[2] + d[2] * ctx[3]) / np.maximum(total, 1)
        for name, a in (("cont", cont), ("total", total), ("gamma", gamma)):
            write_bytes(f"{root}/{name}-{r}", a.tobytes())
        return pa.table({"of": [[int((cont == k).sum()) for k in (1, 2, 3, 4)]], "more": [int((cont > 2).sum())], "total": [int(cont.sum())]})

    low = stats.where("kind <> 'of'").groupBy("part").applyInArrow(merge_range, "of array<long>, more long, total long").collect()
    ws.drop("stats")
    n = np.sum([r.of for r in low], 0)
    model.low = e = discounts(*n)
    model.low_total = sum(r.total for r in low)
    model.low_gamma = (e[0] * n[0] + e[1] * n[1] + e[2] * sum(r.more for r in low)) / max(model.low_total, 1)
    return model


def score(docs: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id", "held_out")) -> DataFrame:
    """Each document's carried columns, n_tokens, n_known, train_tokens, base_score, score and perplexity."""
    src = docs.select(*carry, "text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])

    def run(batches):
        for rb in batches:
            for b in blocks(rb.column(rb.num_columns - 1), lower=True):
                h, first = tokens_of(*word_hashes(b))
                ids, c = model.ids(h)
                sums = lambda v, at=first: np.add.reduceat(v, at[:-1])  # noqa: E731  every document has its end token
                base = np.log10((c + 0.1) / (model.tokens + 0.1 * (model.words + 1)))
                s, n = sums(model.log10(ids, first)), np.diff(first)
                yield pa.RecordBatch.from_arrays(
                    [*(rb.column(i)[b.rows] for i in range(rb.num_columns - 1)), pa.array(n), pa.array(sums((c > 0).astype(np.int64))), pa.array(np.full(b.n, model.tokens)), pa.array(sums(base)), pa.array(s), pa.array(10 ** (-s / n))],
                    [*carry, "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
                )

    return src.mapInArrow(run, f"{kinds}, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def held_out_split(docs: DataFrame, modulus: int, rest: int) -> DataFrame:
    from .common import crc_mod

    return docs.select("doc_id", "text", (crc_mod("doc_id", modulus) == rest).alias("held_out"))


def train_and_score(docs: DataFrame, modulus: int = 10, rest: int = 0) -> DataFrame:
    """Learn from the documents outside the held-out part and score them all."""
    split = held_out_split(docs, modulus, rest)
    ws = Workspace(docs.sparkSession, "ngram")
    return score(split, train(split.where(~F.col("held_out")), ws))
