"""Exact removal of repeated byte strings with suffix arrays built by two-stage sorting.

A byte goes if some LENGTH-byte string over it also starts earlier in the corpus. Any such string holds the anchor of its
window: the leftmost least hash among its GRAM-byte substrings. So equal strings meet under equal anchors:

1. Anchors are counted over all documents; only those that occur twice or more matter from here on (their hashes lie as
   sorted files in the shared folder, memory-mapped by workers).
2. An anchor owns a run of windows, the slice of text they cover. Equal slices are grouped; all but the first of a group
   repeat it as a whole. No text moves for this, and hot slices are pre-aggregated.
3. Where one anchor has different slices, the first of each is fetched with its text, if it shares the anchor with
   34 bytes more on the left or on the right with another one (an equal window reaches that far on one side). These
   slices go to blocks. A block's suffix array is
   built by two-stage sorting: only suffixes smaller than their successors are sorted directly, the rest are induced by
   scanning the buckets upwards. Neighbours with a common prefix of LENGTH bytes or more form groups, and all but the
   first window of a group are repeats. An anchor with more slices than a block may hold is settled by hashing its windows.
4. The spans of each document are merged in sorted files, which a last scan of the texts looks up.

Hashes have 64 bits; strings are taken as equal in steps 1, 2 and for hot anchors if their hashes are.

Defined cases: a null text is empty; a document shorter than LENGTH loses nothing; rows with the same doc_id and text are
one document and get one result; rows with the same doc_id and other texts are ordered by a hash of the text; a null
doc_id comes before all others; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Block, Workspace, blocks, give_back, map_file, mix, multi_arange, prefix_sums, powers, span_hashes, write_bytes
from .ngram import RUN_SCHEMA, Runs, merged, range_shard

LENGTH, GRAM = 100, 32
#: Slices of one anchor that go to a block; beyond, its windows are hashed.
HOT_SLICES = 1000
#: Bytes of slices in a block, about.
SUFFIX_BLOCK = 256 << 10
#: Bytes of text whose windows are hashed at once.
TEXT_BLOCK = 1 << 18


def anchors(b: Block, length: int = LENGTH, gram: int = GRAM):
    """Of each run of windows with one anchor: the document, the anchor's place, the slice [lo, hi), the anchor's and the slice's hash."""
    none = tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, U64),) * 2
    n = len(b.buf)
    if n < length:
        return none
    p = prefix_sums(b.buf)
    m = n - gram + 1
    g = mix((p[gram:] - p[:m]) * powers(n + 1)[1][:m])
    key = (g & U64(0xFFFFFFFF00000000)) | np.arange(m, dtype=U64)
    want, s = length - gram + 1, 1
    while 2 * s <= want:
        key = np.minimum(key[:-s], key[s:])
        s *= 2
    if want > s:
        key = np.minimum(key[: -(want - s)], key[want - s :])
    at = (key & U64(0xFFFFFFFF)).astype(np.int64)  # of the window that starts here
    size = np.diff(b.offs)
    starts = multi_arange(b.offs[:-1], np.maximum(size - length + 1, 0))
    if not len(starts):
        return none
    a = at[starts]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    lo, hi = starts[first], starts[np.append(first[1:], len(starts)) - 1] + length
    a = a[first]
    doc = np.searchsorted(b.offs, lo, "right") - 1
    sl = mix(span_hashes(p, lo, hi) + (a - lo).astype(U64) * U64(0xC2B2AE3D27D4EB4F))
    # an anchor's hash is the least of many, so most would fall into the lowest ranges; mixed again, they spread over all
    return doc, a, lo, hi, mix(g[a]), sl


STEP = 7  # characters of nine bits in a word


def packed(t: np.ndarray, depth: int) -> np.ndarray:
    """STEP characters from each place on in one word, zeros beyond the end, for places up to depth past it."""
    n = len(t) + depth
    pad = np.concatenate([t.astype(np.int64) + 1, np.zeros(depth + STEP, np.int64)])
    word = np.zeros(n, np.int64)
    for k in range(STEP):
        word <<= 9
        word |= pad[k : k + n]
    return word


def suffix_array(t: np.ndarray, depth: int = LENGTH + 4, word: np.ndarray | None = None) -> np.ndarray:
    """Two-stage sorting of t's suffixes, exact to depth characters (in any order beyond). word: packed(t, depth)."""
    n = len(t)
    x = t.astype(np.int64)
    word = packed(t, depth) if word is None else word
    # type B: smaller than the successor; an equal run has the type of its end, and the last suffix is type A
    step = np.sign(np.diff(x, append=-1))
    end = np.where(step != 0, np.arange(n), n)
    is_b = step[np.minimum.accumulate(end[::-1])[::-1]] > 0
    b = np.flatnonzero(is_b)
    # direct sort, a word at a time, only what is still tied
    order = b[np.argsort(word[b])]
    group = np.concatenate([[0], np.cumsum(np.diff(word[order]) != 0)]) if len(order) else np.zeros(0, np.int64)
    d = STEP
    while d < depth and len(order):
        same = np.zeros(len(order), bool)
        eq = group[1:] == group[:-1]
        same[1:] |= eq
        same[:-1] |= eq
        tied = np.flatnonzero(same)
        if not len(tied):
            break
        own, w, g = order[tied], word[order[tied] + d], group[tied]
        k = np.argsort(w)
        rank = np.empty(len(w), np.int64)
        rank[k] = np.concatenate([[0], np.cumsum(np.diff(w[k]) != 0)])
        k = np.argsort((g << 32) | rank)
        order[tied] = own[k]
        change = np.zeros(len(order), bool)
        change[1:] = ~eq
        change[tied[1:]] |= (rank[k][1:] != rank[k][:-1]) & (np.diff(tied) == 1)
        group = np.cumsum(change)
        d += STEP
    # induced: buckets upwards; in a bucket first the type A suffixes in the order of their successors, then type B
    rank = np.full(n + 1, -1, np.int64)
    sa = np.empty(n, np.int64)
    heads = np.searchsorted(x[order], np.arange(258))
    a = np.flatnonzero(~is_b)
    a = a[np.argsort(x[a].astype(np.int16), kind="stable")]
    tails = np.searchsorted(x[a], np.arange(258))
    filled = 0
    nxt = np.append(x[1:], -1)
    for c in range(257):
        own = a[tails[c] : tails[c + 1]]
        wave = own[nxt[own] < c]
        while len(wave):
            wave = wave[np.argsort(rank[wave + 1])]
            sa[filled : filled + len(wave)] = wave
            rank[wave] = np.arange(filled, filled + len(wave))
            filled += len(wave)
            before = wave - 1
            before = before[before >= 0]
            wave = before[(x[before] == c) & ~is_b[before]]
        own = order[heads[c] : heads[c + 1]]
        sa[filled : filled + len(own)] = own
        rank[own] = np.arange(filled, filled + len(own))
        filled += len(own)
    return sa


def common_prefixes(word: np.ndarray, left: np.ndarray, right: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of each pair of suffixes, up to most. word: packed(t, at least most)."""
    out = np.zeros(len(left), np.int64)
    on = np.arange(len(left))
    for d in range(0, most, STEP):
        differ = word[left[on] + d] ^ word[right[on] + d]
        stop = np.flatnonzero(differ)
        # the first of the word's characters that differs
        at = np.zeros(len(stop), np.int64)
        for k in range(1, STEP):
            at += (differ[stop] >> (9 * (STEP - k))) == 0
        out[on[stop]] = d + at
        on = on[differ == 0]
        out[on] = d + STEP
        if not len(on):
            break
    return np.minimum(out, most)


def repeats_in_block(slices: list[bytes], first: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """Of each slice, the starts of windows that equal a window of a slice that comes first (first: the slices' order)."""
    size = np.array([len(s) for s in slices], np.int64)
    at = np.cumsum(size + 1) - size - 1
    t = np.zeros(int((size + 1).sum()), np.int16)
    body = np.ones(len(t), bool)
    body[at + size] = False
    t[body] = np.frombuffer(b"".join(slices), np.uint8).astype(np.int16) + 1
    of = np.repeat(np.arange(len(slices)), size + 1)
    word = packed(t, length + 2 * STEP)
    sa = suffix_array(t, length + 4, word)
    left = (at + size)[of[sa]] - sa
    sa = sa[left >= length]
    if not len(sa):
        return [np.zeros(0, np.int64)] * len(slices)
    lcp = common_prefixes(word, sa[:-1], sa[1:], length)
    heads = np.concatenate([[0], np.flatnonzero(lcp < length) + 1])
    order = first[of[sa]]
    least = np.repeat(np.minimum.reduceat(order, heads), np.diff(np.append(heads, len(sa))))
    dup = np.sort(sa[order != least])
    cut = np.searchsorted(dup, np.append(at, len(t)))
    return [dup[cut[i] : cut[i + 1]] - at[i] for i in range(len(slices))]


def window_runs(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The spans [lo, hi) that windows at ascending starts cover, one for each run of consecutive starts."""
    cut = np.flatnonzero(np.diff(starts) != 1) + 1
    lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(starts)]]) - 1
    return starts[lo], starts[hi] + length


_files: dict[str, np.ndarray] = {}


def _mapped(uri: str) -> np.ndarray:
    if uri not in _files:
        if len(_files) > 1024:
            _files.clear()
        _files[uri] = map_file(uri)
    return _files[uri]


def member(root: str, shards: int, present: frozenset[int], keys: np.ndarray) -> np.ndarray:
    """Which keys are in the sorted files of a set."""
    shard = range_shard(keys, shards).astype(np.int64)
    order = np.lexsort((keys, shard))
    bounds = np.searchsorted(shard[order], np.arange(shards + 1))
    out = np.zeros(len(keys), bool)
    for s in present:
        own = order[bounds[s] : bounds[s + 1]]
        if len(own):
            v = _mapped(f"{root}-{s}").view(U64)
            out[own] = v[np.minimum(np.searchsorted(v, keys[own]), len(v) - 1)] == keys[own]
    return out


def key_files(keys: DataFrame, col: str, root: str, shards: int) -> frozenset[int]:
    """Write the distinct values of a long column as sorted files by range; the shards that have any."""
    shard = F.shiftrightunsigned(F.shiftrightunsigned(col, 40) * shards, 24).cast("int")

    def write(t: pa.Table) -> pa.Table:
        s = t.column("shard")[0].as_py()
        write_bytes(f"{root}-{s}", np.unique(t.column("key").to_numpy().view(U64)).tobytes())
        return pa.table({"shard": pa.array([s], pa.int32())})

    return frozenset(r.shard for r in keys.select(shard.alias("shard"), F.col(col).alias("key")).groupBy("shard").applyInArrow(write, "shard int").collect())


def spans(docs: DataFrame, ws: Workspace, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Repeated spans (k, lo, hi), which may overlap. docs: id (the order), k (hash of id and text) and text."""
    parts = max(1, docs.rdd.getNumPartitions())
    shards = max(4, parts)

    def count(batches):
        runs = Runs(lambda x: range_shard(x, shards), 1_000_000)
        for rb in batches:
            for b in blocks(rb.column(0), TEXT_BLOCK):
                yield from runs.add(anchors(b, length, gram)[4])
            give_back()
        yield from runs.flush()
        give_back()

    twice_root = ws.path("files/twice")

    def keep_twice(t: pa.Table) -> pa.Table:
        s, keys, counts = merged(t)
        keys = keys[counts > 1]
        if len(keys):
            write_bytes(f"{twice_root}-{s}", keys.tobytes())
        del counts
        give_back()
        return pa.table({"shard": pa.array([s] if len(keys) else [], pa.int32())})

    twice = frozenset(r.shard for r in docs.select("text").mapInArrow(count, RUN_SCHEMA).repartition(shards, "shard").groupBy("shard").applyInArrow(keep_twice, "shard int").collect())

    def locate(batches):
        for rb in batches:
            for b in blocks(rb.column(2), TEXT_BLOCK):
                doc, a, lo, hi, h, sl = anchors(b, length, gram)
                ok = np.flatnonzero(member(twice_root, shards, twice, h))
                doc, base = doc[ok], b.offs[doc[ok]]
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays([pa.array(h[ok].view(np.int64)), pa.array(sl[ok].view(np.int64)), rb.column(0)[b.rows].take(take), rb.column(1)[b.rows].take(take), pa.array(a[ok] - base), pa.array(lo[ok] - base), pa.array(hi[ok] - base)], ["h", "sl", "id", "k", "a", "lo", "hi"])
            give_back()

    rows = ws.cut(docs.select("id", "k", "text").mapInArrow(locate, "h long, sl long, id long, k long, a long, lo long, hi long"), "rows")
    place = F.struct("id", "k", "a")
    # a slice's hash covers its anchor's bytes too, so it is the whole key
    slices = ws.cut(rows.groupBy("sl").agg(F.first("h").alias("h"), F.min(place).alias("place"), F.count("*").alias("copies")), "slices")
    # a slice that another one equals, and isn't the first: all of it is repeated
    again = slices.where("copies > 1").select("sl", "place")
    later = rows.select("sl", "id", "k", "a", "lo", "hi").join(again, "sl").where(place != F.col("place")).select("k", "lo", "hi")
    # anchors with different slices: the first of each slice, with its text
    many = slices.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    mixed = ws.cut(slices.join(many, "h").select("sl", "place"), "mixed")
    wanted_root = ws.path("files/wanted")
    wanted = key_files(mixed.select("sl"), "sl", wanted_root, shards)
    owners_root = ws.path("files/owners")
    owners = key_files(mixed.select("place.k"), "k", owners_root, shards)

    def fetch(batches):
        for rb in batches:
            rb = rb.filter(pa.array(member(owners_root, shards, owners, rb.column(1).to_numpy().view(U64))))
            for b in blocks(rb.column(2), TEXT_BLOCK):
                doc, a, lo, hi, h, sl = anchors(b, length, gram)
                ok = np.flatnonzero(member(wanted_root, shards, wanted, sl))
                buf, take, base = b.buf.tobytes(), pa.array(doc[ok]), b.offs[doc[ok]]
                text = pa.array([buf[i:j] for i, j in zip(lo[ok].tolist(), hi[ok].tolist(), strict=True)], pa.binary())
                p, at, side = prefix_sums(b.buf), a[ok], length - gram - (length - gram) // 2
                reach = [(np.maximum(at - side, 0), at + gram, at - side >= lo[ok]), (at, np.minimum(at + gram + side, len(b.buf)), at + gram + side <= hi[ok])]
                sides = [pa.array(span_hashes(p, x, y).view(np.int64), mask=~inside) for x, y, inside in reach]
                yield pa.RecordBatch.from_arrays([pa.array(h[ok].view(np.int64)), pa.array(sl[ok].view(np.int64)), rb.column(0)[b.rows].take(take), rb.column(1)[b.rows].take(take), pa.array(at - base), pa.array(lo[ok] - base), text, *sides], ["h", "sl", "id", "k", "a", "lo", "text", "left", "right"])
            give_back()

    texts = docs.select("id", "k", "text").mapInArrow(fetch, "h long, sl long, id long, k long, a long, lo long, text binary, left long, right long")
    texts = ws.cut(texts.join(mixed, "sl").where(place == F.col("place")).dropDuplicates(["sl"]).drop("place"), "texts")
    alike = [texts.where(f"{c} is not null").groupBy(c).agg(F.count("*").alias("m")).where("m > 1").select(c) for c in ("left", "right")]
    near = [texts.join(keys, c, "left_semi").select("sl") for keys, c in zip(alike, ("left", "right"), strict=True)]
    texts = texts.drop("left", "right").join(near[0].union(near[1]).distinct(), "sl").drop("sl")
    texts = ws.cut(texts.join(texts.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "h"), "close")
    total = texts.where(F.col("n") <= HOT_SLICES).agg(F.sum(F.length("text"))).first()[0] or 0
    bins = max(1, -(-total // SUFFIX_BLOCK))

    def suffixes(t: pa.Table) -> pa.Table:
        rank = np.empty(t.num_rows, np.int64)
        rank[np.lexsort(tuple(t.column(c).to_numpy() for c in ("a", "k", "id")))] = np.arange(t.num_rows)
        out: list[list] = [[], [], []]
        for i, found in enumerate(repeats_in_block(t.column("text").to_pylist(), rank, length)):
            if len(found):
                lo, hi = window_runs(found, length)
                base = t.column("lo")[i].as_py()
                for col, v in zip(out, ([t.column("k")[i].as_py()] * len(lo), (lo + base).tolist(), (hi + base).tolist()), strict=True):
                    col += v
        give_back()
        return pa.table([pa.array(c, pa.int64()) for c in out], ["k", "lo", "hi"])

    cold = texts.where(F.col("n") <= HOT_SLICES).withColumn("bin", F.pmod(F.xxhash64("h"), F.lit(bins)))
    found = later.unionByName(cold.groupBy("bin").applyInArrow(suffixes, "k long, lo long, hi long"))
    if texts.where(F.col("n") > HOT_SLICES).limit(1).count():

        def windows(batches):
            for rb in batches:
                for s in range(0, rb.num_rows, 2048):
                    part = rb.slice(s, 2048)
                    size = np.array([len(x) for x in part.column(4).to_pylist()], np.int64)
                    buf = np.frombuffer(b"".join(part.column(4).to_pylist()), np.uint8)
                    at = np.cumsum(size) - size
                    starts = multi_arange(at, size - length + 1)
                    row = np.repeat(np.arange(part.num_rows), size - length + 1)
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays([pa.array(span_hashes(prefix_sums(buf), starts, starts + length).view(np.int64)), part.column(0).take(take), part.column(1).take(take), pa.array(part.column(3).to_numpy()[row] + starts - at[row])], ["w", "id", "k", "p"])

        each = ws.cut(texts.where(F.col("n") > HOT_SLICES).select("id", "k", "a", "lo", "text").mapInArrow(windows, "w long, id long, k long, p long"), "windows")
        spot = F.struct("id", "k", "p")
        one = each.groupBy("w").agg(F.min(spot).alias("first"), F.count("*").alias("n")).where("n > 1").select("w", "first")
        twice_seen = each.join(one, "w").where(spot != F.col("first")).select("k", F.col("p").alias("lo"), (F.col("p") + length).alias("hi"))
        found = found.unionByName(twice_seen)
    return found


def merged_files(found: DataFrame, root: str, shards: int) -> frozenset[int]:
    """Merge the spans of each document and write them as sorted files by range of k: keys, firsts, starts, ends."""
    shard = F.shiftrightunsigned(F.shiftrightunsigned("k", 40) * shards, 24).cast("int")

    def write(t: pa.Table) -> pa.Table:
        k, lo, hi = (t.column(c).to_numpy() for c in ("k", "lo", "hi"))
        order = np.lexsort((lo, k.view(U64)))
        k, lo, hi = k[order], lo[order], hi[order]
        doc = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])])
        shift = doc * (int(hi.max()) + 2)  # documents one after the other, with a gap
        upto = np.maximum.accumulate(hi + shift)
        new = np.ones(len(k), bool)
        new[1:] = (lo + shift)[1:] > upto[:-1]
        at = np.flatnonzero(new)
        end = np.append(at[1:], len(k)) - 1
        keys, first = np.unique(k[at].view(U64), return_index=True)
        s = t.column("shard")[0].as_py()
        write_bytes(f"{root}-{s}", np.concatenate([[len(keys), len(at)], keys.view(np.int64), np.append(first, len(at)), lo[at], upto[end] - shift[end]]).astype(np.int64).tobytes())
        return pa.table({"shard": pa.array([s], pa.int32())})

    return frozenset(r.shard for r in found.select("k", "lo", "hi").withColumn("shard", shard).groupBy("shard").applyInArrow(write, "shard int").collect())


def remove(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the spans removed; with_text, also what is left (kept, binary)."""
    ws = Workspace(docs.sparkSession, "substrings")
    own = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    shards = max(4, own.rdd.getNumPartitions())
    root = ws.path("files/spans")
    there = merged_files(spans(own, ws, length, gram), root, shards)

    def run(batches):
        for rb in (whole.slice(i, 256) for whole in batches for i in range(0, whole.num_rows, 256)):
            keys = rb.column(1).to_numpy().view(U64)
            shard = range_shard(keys, shards).astype(np.int64)
            texts = rb.column(2).cast(pa.binary())
            cols: list[list] = [[], [], [], [], [], []]
            for i in range(rb.num_rows):
                text, s = texts[i].as_py(), int(shard[i])
                lo = hi = np.zeros(0, np.int64)
                if s in there:
                    v = _mapped(f"{root}-{s}").view(np.int64)
                    n, m = int(v[0]), int(v[1])
                    known = v[2 : 2 + n].view(U64)
                    j = int(np.searchsorted(known, keys[i]))
                    if j < n and known[j] == keys[i]:
                        a, z = int(v[2 + n + j]), int(v[3 + n + j])
                        lo, hi = v[3 + 2 * n + a : 3 + 2 * n + z], v[3 + 2 * n + m + a : 3 + 2 * n + m + z]
                cut = [0, *(x for pair in zip(lo.tolist(), hi.tolist(), strict=True) for x in pair), len(text)]
                kept = b"".join(text[cut[x] : cut[x + 1]] for x in range(0, len(cut), 2))
                row = (len(text), len(text) - len(kept), len(lo), hashlib.sha256(kept).hexdigest(), [{"start": x, "end": y} for x, y in zip(lo.tolist(), hi.tolist(), strict=True)], kept if with_text else b"")
                for c, x in zip(cols, row, strict=True):
                    c.append(x)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
            some = range(6 if with_text else 5)
            yield pa.RecordBatch.from_arrays([rb.column(0), *(pa.array(cols[i], kinds[i]) for i in some)], ["doc_id", *(names[i] for i in some)])

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>" + ", kept binary" * with_text
    return own.select("doc_id", "k", "text").mapInArrow(run, schema)
