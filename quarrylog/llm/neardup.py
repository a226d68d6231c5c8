"""MinHash near-duplicates by an inverted join over signature coordinates.

1. Every document gets the set of its 5-word shingles (64-bit hashes) and a signature of COORDS minima. Documents with the
   same set form a class; from here on only one of each class is looked at.
2. A class is posted under (coordinate, value) pairs. Two classes that agree on `matches` coordinates or more must share one
   of the first COORDS - matches + 1 pairs of any common order (prefix), so only those are posted, rarest first; the order
   comes from a sketch of fixed size, and any order is right. Pairs posted by one class alone are skipped at once.
3. Merging skips what is settled: first each posting list is held against its most central class only (the one in the
   fullest lists), and the links found are joined into components. Only lists that still hold several components are merged
   fully, by bands of set sizes and in blocks, and there the members of the largest component are held against the others
   but not among each other.
4. A pair is retained if it collides on matches(percent) coordinates or more (for Jaccard percent / 100, P(fewer) < 1e-8), in
   the first list that both are in; retained pairs are confirmed on the full shingle sets, which are fetched for these classes alone. What
   leaves a block is never its pairs but which members have any, and then edges that span its components.

No step emits all pairs of a group, caps a list or gathers links on the driver; the two fixed-size sketches do reach it.

Defined cases: a null or empty text has no shingles, is linked with nothing and kept; repeated rows share a component and
are all kept or all not; a null doc_id counts as larger than any (a component of such rows alone has a null id and
keeps them); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Workspace, blocks, doc_of, give_back, mix, multi_arange, prefix_sums, span_hashes

COORDS, SHINGLE = 64, 5
#: The least similarity of a link, and that of op10's contract.
PERCENT, OP10_PERCENT = 80, 85
SKETCH_BITS, BITMAP_BITS = 18, 23
#: Rows of a posting list that are held against others at once, and how many others.
LIST_BLOCK, GUEST_BLOCK = 512, 1024

_rng = np.random.default_rng(20240501)
_A = _rng.integers(0, 1 << 32, COORDS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, COORDS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_C = _rng.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) | U64(1)
_K = mix(np.arange(1, COORDS + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))


def matches(percent: int) -> int:
    """How many coordinates must collide: the most that sets of this similarity miss with a probability below 1e-8."""
    p, below, m = percent / 100, 0.0, 0
    while m < COORDS and (below := below + math.comb(COORDS, m) * p**m * (1 - p) ** (COORDS - m)) < 1e-8:
        m += 1
    return m


def shingle_sets(block) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each document, ascending, and where each document's begin (n + 1 long). block: lower-cased."""
    starts, ends, first = block.words()
    h = span_hashes(prefix_sums(block.buf), starts, ends)
    n = np.diff(first)
    full = np.where(n >= SHINGLE, n - SHINGLE + 1, (n > 0).astype(np.int64))
    at = multi_arange(first[:-1], full)
    doc = np.repeat(np.arange(block.n), full)
    short = n[doc] < SHINGLE
    s = np.zeros(len(at), U64)
    for k in range(SHINGLE):
        inside = at + k < first[doc + 1]
        s += np.where(inside, mix(h[np.minimum(at + k, max(len(h) - 1, 0))] + U64(k)) * _C[k], U64(0)) if len(h) else U64(0)
    s = mix(s + np.where(short, n[doc].astype(U64), U64(0)) * U64(0xA24BAED4963EE407))
    order = np.lexsort((s, doc))
    s, doc = s[order], doc[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    s, doc = s[new], doc[new]
    return s, np.searchsorted(doc, np.arange(block.n + 1))


def set_hashes(s: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each non-empty set (0 for empty ones), the same in any order."""
    out = np.zeros(len(first) - 1, U64)
    has = np.flatnonzero(np.diff(first))
    if len(has):
        out[has] = mix(np.add.reduceat(mix(s ^ U64(0x5851F42D4C957F2D)), first[has]) + np.diff(first)[has].astype(U64))
    return out


def signatures(s: np.ndarray, first: np.ndarray) -> np.ndarray:
    """COORDS minima of each set as uint32 rows."""
    out = np.zeros((len(first) - 1, COORDS), np.uint32)
    has = np.flatnonzero(np.diff(first))
    if len(has):
        lo, hi = s.astype(np.uint32), (s >> U64(32)).astype(np.uint32)
        for k in range(COORDS):
            out[has, k] = np.minimum.reduceat(lo * _A[k] + hi * _B[k], first[has])
    return out


def rows_of(col: pa.Array, kind, width: int) -> np.ndarray:
    """A binary column of fixed width as an array of rows."""
    if not len(col):
        return np.zeros((0, width), kind)
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    _, at, data = col.buffers()
    offs = np.frombuffer(at, np.int32)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]].view(kind).reshape(-1, width)


def binary_rows(a: np.ndarray) -> pa.Array:
    width = a.dtype.itemsize * a.shape[1]
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(a), [None, pa.py_buffer(np.ascontiguousarray(a).tobytes())]).cast(pa.binary())


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, t (hash of the text), n, c (hash of the set) and sig of every document."""

    def run(batches):
        for rb in batches:
            for b in blocks(rb.column(2), lower=True):
                s, first = shingle_sets(b)
                yield pa.RecordBatch.from_arrays([rb.column(0)[b.rows], rb.column(1)[b.rows], pa.array(np.diff(first)), pa.array(set_hashes(s, first).view(np.int64)), binary_rows(signatures(s, first))], ["doc_id", "t", "n", "c", "sig"])
            give_back()

    return docs.select("doc_id", F.xxhash64("text").alias("t"), "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, t long, n long, c long, sig binary")


def _items(sig: np.ndarray) -> np.ndarray:
    return mix(sig.astype(U64) ^ _K)


def item_sketch(classes: DataFrame) -> np.ndarray:
    """How many items fall in each of 2^SKETCH_BITS buckets."""

    def run(batches):
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for rb in batches:
            total += np.bincount((_items(rows_of(rb.column(0), np.uint32, COORDS)) & U64((1 << SKETCH_BITS) - 1)).astype(np.int64).ravel(), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(1 << SKETCH_BITS, np.int64)
    t = classes.select("sig").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out[t.column("bucket").to_numpy()] = t.column("n").to_numpy()
    return out


def postings(classes: DataFrame, sketch: np.ndarray, percent: int) -> DataFrame:
    """(item, c): each class under the rarest COORDS - matches(percent) + 1 of its items."""
    keep = COORDS - matches(percent) + 1
    level = np.minimum(sketch, (1 << 23) - 1).astype(U64) << U64(40)

    def run(batches):
        for rb in batches:
            for a in range(0, rb.num_rows, 4096):
                part = rb.slice(a, 4096)
                items = _items(rows_of(part.column(1), np.uint32, COORDS))
                order = level[(items & U64((1 << SKETCH_BITS) - 1)).astype(np.int64)] | (items >> U64(24))
                at = np.argpartition(order, keep - 1, axis=1)[:, :keep]
                own = np.take_along_axis(items, at, 1)
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64).ravel()), pa.array(np.repeat(part.column(0).to_numpy(), keep))], ["item", "c"])

    return classes.select("c", "sig").mapInArrow(run, "item long, c long")


def similar(n_a, n_b, percent: int):
    """Whether sizes alone allow a link."""
    return 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)


def colliding(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those of allowed sizes that agree on matches(percent) coordinates or more."""
    least = matches(percent)
    low = low_bytes(classes)
    full = pairs.join(low.toDF("b", "nb", "sb"), "b").join(low.toDF("a", "na", "sa"), "a").where(similar(F.col("na"), F.col("nb"), percent)).select("a", "b", "sa", "sb")

    def run(batches):
        for rb in batches:
            same = (rows_of(rb.column(2), np.uint8, COORDS) == rows_of(rb.column(3), np.uint8, COORDS)).sum(1) >= least
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1)], ["a", "b"]).filter(pa.array(same))

    return full.mapInArrow(run, "a long, b long")


def low_bytes(classes: DataFrame) -> DataFrame:
    """c, n and the low byte of each coordinate: equal coordinates have equal bytes, so no collision is lost."""

    def run(batches):
        for rb in batches:
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), binary_rows(rows_of(rb.column(2), np.uint32, COORDS).astype(np.uint8))], ["c", "n", "low"])

    return classes.select("c", "n", "sig").mapInArrow(run, "c long, n long, low binary")


def full_sets(c: DataFrame, classes: DataFrame, docs: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """(c, s): the shingle sets of the classes in c, read again from one document of each."""
    need = c.distinct().join(classes.select("c", "rep"), "c")
    bit = F.pmod(F.xxhash64("rep"), F.lit(1 << BITMAP_BITS)).cast("int")
    words = need.select(bit.alias("h")).groupBy(F.shiftright("h", 5).alias("w")).agg(F.expr("bit_or(shiftleft(1L, h & 31))").alias("bits")).toArrow()
    bitmap = np.zeros(1 << (BITMAP_BITS - 5), np.uint32)
    bitmap[words.column("w").to_numpy()] = words.column("bits").to_numpy().astype(np.uint32)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)  # 2^BITMAP_BITS bits, whatever the input

    def run(batches):
        bits = shared.value
        for rb in batches:
            h = rb.column(0).to_numpy()
            rb = rb.filter(pa.array((bits[h >> 5] >> (h & 31).astype(np.uint32)) & 1 == 1))
            for b in blocks(rb.column(1), lower=True):
                s, first = shingle_sets(b)
                has = np.flatnonzero(np.diff(first))
                sets = pa.ListArray.from_arrays(pa.array(np.concatenate([first[:-1][has], first[-1:]]).astype(np.int32)), pa.array(s.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(set_hashes(s, first)[has].view(np.int64)), sets], ["c", "s"])
            give_back()

    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << BITMAP_BITS)).cast("int")
    sets = docs.select(h.alias("h"), "text").mapInArrow(run, "c long, s array<long>").join(need.select("c"), "c", "left_semi")
    return ws.cut(sets.groupBy("c").agg(F.first("s").alias("s")), name)


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, ws: Workspace, name: str, percent: int) -> DataFrame:
    """Of pairs (a, b), those linked by their full shingle sets. pairs: a table (read twice)."""
    sets = full_sets(pairs.select(F.col("a").alias("c")).union(pairs.select(F.col("b").alias("c"))), classes, docs, ws, f"{name}-sets")
    full = pairs.join(sets.toDF("b", "sb"), "b").join(sets.toDF("a", "sa"), "a")
    inter = F.size(F.array_intersect("sa", "sb"))
    return full.where(100 * inter >= percent * (F.size("sa") + F.size("sb") - inter)).select("a", "b")


def components(links: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """(c, label) of all nodes of links (a, b), label being the least node of the component: alternating large and small stars."""
    edges = ws.cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    last, i = None, 0
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        i += 1
        edges = ws.cut(small, f"{name}-{i}")
        ws.drop(f"{name}-{i - 1}")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(now) == last:
            break
        last = tuple(now)
    return edges.select(F.col("u").alias("c"), F.col("v").alias("label")).union(edges.select(F.col("v").alias("c"), F.col("v").alias("label")).distinct())


def open_lists(posted: DataFrame, labels: DataFrame, classes: DataFrame, sketch: np.ndarray, percent: int, ws: Workspace) -> DataFrame:
    """What is left to confirm: members (item, band, i, j, c, label, home, guest) of lists with several components that have a
    retained pair there: a home row against a guest row of its block (i, j), of another component.

    A list falls into bands of set sizes, so wide that linked sets are in one band or in neighbouring ones: a row is at home in
    its own band, and a guest, if it isn't of the list's largest component, in that and the two beside it. What remains of a
    large band is dealt out in blocks."""
    rows = posted.select("item", "c").join(labels, "c", "left").select("item", "c", F.coalesce("label", "c").alias("label"))
    by = rows.groupBy("item", "label").agg(F.count("*").alias("n"))
    lists = by.groupBy("item").agg(F.count("*").alias("labels"), F.max_by("label", F.struct("n", "label")).alias("main")).where("labels > 1")
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent)).cast("int")
    full = rows.join(lists.select("item", "main"), "item").join(classes.select("c", "n", "sig"), "c").select("item", "c", "label", "n", "sig", band.alias("band"), (F.col("label") != F.col("main")).alias("minor"))
    full = ws.cut(full, "open")
    visits = full.where("minor").withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    homes = full.groupBy("item", "band").agg(F.count("*").alias("rows"))
    guests = visits.groupBy("item", "band").agg(F.count("*").alias("guests"))
    size = homes.join(guests, ["item", "band"]).select("item", "band", F.ceil(F.col("rows") / LIST_BLOCK).cast("int").alias("hs"), F.ceil(F.col("guests") / GUEST_BLOCK).cast("int").alias("gs"))
    span = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cols = ("item", "band", "i", "j", "c", "label", "n", "sig", "home", "guest")
    home = full.join(size, ["item", "band"]).select("*", F.pmod(F.xxhash64("c"), F.col("hs")).cast("int").alias("i"), F.explode(span("gs")).alias("j"), F.lit(True).alias("home"), F.lit(False).alias("guest")).select(*cols)
    guest = visits.join(size, ["item", "band"]).select("*", F.pmod(F.xxhash64("c", F.lit(1)), F.col("gs")).cast("int").alias("j"), F.explode(span("hs")).alias("i"), F.lit(False).alias("home"), F.lit(True).alias("guest")).select(*cols)
    dealt = home.unionByName(guest).repartition("item", "band", "i", "j").sortWithinPartitions("item", "band", "i", "j", "c", "home")
    level = np.minimum(sketch, (1 << 23) - 1).astype(U64) << U64(40)
    least = matches(percent)

    def retained(item: int, c, label, n, sig, home, guest) -> np.ndarray:
        """Which rows of a block have a retained pair whose first common item is this list's."""
        items = _items(sig)
        order = level[(items & U64((1 << SKETCH_BITS) - 1)).astype(np.int64)] | (items >> U64(24))
        out = np.zeros(len(c), bool)
        x, y = np.flatnonzero(home), np.flatnonzero(guest)
        for a in range(0, len(y), 256):
            p = y[a : a + 256]
            for b in range(0, len(x), 256):
                q = x[b : b + 256]
                ok = (label[p][:, None] != label[q][None]) & (100 * np.minimum(n[p][:, None], n[q][None]) >= percent * np.maximum(n[p][:, None], n[q][None]))
                i, j = np.nonzero(ok)
                for k in range(0, len(i), 32768):
                    u, v = p[i[k : k + 32768]], q[j[k : k + 32768]]
                    same = sig[u] == sig[v]
                    hit = np.flatnonzero(same.sum(1) >= least)
                    u, v, same = u[hit], v[hit], same[hit]
                    at = np.where(same, order[u], U64(0xFFFFFFFFFFFFFFFF)).argmin(1)
                    first = items[u, at].view(np.int64) == item
                    out[u[first]] = out[v[first]] = True
        return out

    def run(batches):
        held = None

        def flush(t, upto):
            item, band, bi, bj, c, label, n, home, guest = (t.column(k).to_numpy()[:upto] for k in ("item", "band", "i", "j", "c", "label", "n", "home", "guest"))
            sig = rows_of(t.column("sig").slice(0, upto), np.uint32, COORDS)
            cut = np.flatnonzero((item[1:] != item[:-1]) | (band[1:] != band[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])) + 1
            keep = np.zeros(upto, bool)
            for lo, hi in zip([0, *cut], [*cut, upto], strict=True):
                keep[lo:hi] = retained(item[lo], c[lo:hi], label[lo:hi], n[lo:hi], sig[lo:hi], home[lo:hi], guest[lo:hi])
            at = np.flatnonzero(keep)
            if len(at):
                yield from t.drop_columns(["n", "sig"]).take(pa.array(at)).combine_chunks().to_batches()

        for rb in batches:
            if not rb.num_rows:
                continue
            t = pa.Table.from_batches([rb])
            t = (t if held is None else pa.concat_tables([held, t])).combine_chunks()
            same = np.ones(t.num_rows, bool)
            for k in ("item", "band", "i", "j"):
                v = t.column(k).to_numpy()
                same &= v == v[-1]
            whole = int(np.flatnonzero(~same).max(initial=-1)) + 1  # the last block may go on
            if whole:
                yield from flush(t, whole)
            held = t.slice(whole).combine_chunks()
        if held is not None and held.num_rows:
            yield from flush(held, held.num_rows)

    return dealt.mapInArrow(run, "item long, band int, i int, j int, c long, label long, home boolean, guest boolean")


def intersections(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray, width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of sets x with sets y, by products of 0/1 matrices, some thousand members at a time."""
    flat, size = np.concatenate(sets), np.array([len(v) for v in sets])
    row = np.repeat(np.arange(len(sets)), size)
    _, member, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1  # members of one set alone add nothing
    ok = times[member] > 1
    row, member = row[ok], shared[member[ok]]
    out = np.zeros((len(x), len(y)), np.float32)
    order = np.argsort(member, kind="stable")
    row, member = row[order], member[order]
    for lo in range(0, int(member[-1]) + 1 if len(member) else 0, width):
        a, b = np.searchsorted(member, (lo, lo + width))
        m = np.zeros((len(sets), width), np.float32)
        m[row[a:b], member[a:b] - lo] = 1
        out += m[x] @ m[y].T
    return out.astype(np.int64)


def spanning(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirm the pairs of open_lists on full sets: edges (a, b) that span the linked members of each block."""

    def confirm(t: pa.Table) -> pa.Table:
        c, label = t.column("c").to_numpy(), t.column("label").to_numpy()
        own = t.column("s").to_numpy()
        n = np.array([len(v) for v in own])
        root = np.arange(len(c))
        x, y = np.flatnonzero(t.column("home").to_numpy()), np.flatnonzero(t.column("guest").to_numpy())
        if len(x) and len(y):
            both = intersections(list(own), x, y)
            link = (100 * both >= percent * (n[x][:, None] + n[y][None] - both)) & (label[x][:, None] != label[y][None])
            i, j = (v[k] for v, k in zip((x, y), np.nonzero(link), strict=True))
            while len(i):
                before = root.copy()
                least = np.minimum(root[i], root[j])
                np.minimum.at(root, i, least)
                np.minimum.at(root, j, least)
                root = root[root]
                if (root == before).all():
                    break
        at = np.flatnonzero(root != np.arange(len(c)))
        return pa.table({"a": c[root[at]], "b": c[at]})

    return members.join(sets, "c").groupBy("item", "band", "i", "j").applyInArrow(confirm, "a long, b long")


def near_duplicates(docs: DataFrame, ws: Workspace | None = None, percent: int = OP10_PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    return grouped(docs, ws, percent).select("doc_id", "n_shingles", "component_id", "kept")


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents without near-duplicates: of each component the row of the smallest doc_id (then text hash), with all columns."""
    ws = Workspace(docs.sparkSession, "neardup")
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    # rows of one doc_id and different texts can be in one component: the smallest hash stays
    kept = grouped(docs, ws, percent).where("kept").groupBy("label", key("doc_id").alias("_k")).agg(F.min("t").alias("_t")).select("_k", "_t")
    names = docs.columns
    own = [f"_x{i}" for i in range(len(names))]
    src = docs.select(*(F.col(f"`{c}`").alias(x) for c, x in zip(names, own, strict=True)), key("doc_id").alias("_k"), F.xxhash64("text").alias("_t"))
    return src.join(kept, ["_k", "_t"], "left_semi").dropDuplicates(["_k", "_t"]).select(*own).toDF(*names)


def grouped(docs: DataFrame, ws: Workspace | None = None, percent: int = PERCENT) -> DataFrame:
    """doc_id, t, label (of the component; of an empty text, its hash), n_shingles, component_id and kept of every document."""
    ws = ws or Workspace(docs.sparkSession, "neardup")
    docs = docs.select("doc_id", "text")
    signed = ws.cut(sketches(docs), "signed")
    classes = ws.cut(signed.where("n > 0").groupBy("c").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig")), "classes")
    sketch = item_sketch(classes)
    posts = postings(classes, sketch, percent)
    posted = ws.cut(posts.join(posts.groupBy("item").agg(F.count("*").alias("k")).where("k > 1"), "item"), "posted")
    central = posted.join(posted.groupBy("c").agg(F.sum("k").alias("centrality")), "c")
    leaders = central.groupBy("item").agg(F.max_by("c", F.struct("centrality", "c")).alias("leader"))
    stars = posted.join(leaders, "item").where("c <> leader").select(F.col("leader").alias("a"), F.col("c").alias("b")).distinct()
    links = ws.cut(confirmed(ws.cut(colliding(stars, classes, percent), "stars"), classes, docs, ws, "star", percent), "links")
    labels = ws.cut(components(links, ws, "first"), "labels")
    more = ws.cut(open_lists(posted, labels, classes, sketch, percent, ws), "more")
    if not more.isEmpty():
        found = spanning(more, full_sets(more.select("c"), classes, docs, ws, "more-sets"), percent)
        labels = ws.cut(components(links.union(found), ws, "second"), "labels2")
    least = labels.join(classes.select("c", "rep"), "c").groupBy("label").agg(F.min("rep").alias("component_id"))
    of = labels.join(least, "label").select("c", "label", F.col("component_id").alias("least"))
    of = classes.select("c", "rep").join(of, "c", "left").select("c", F.coalesce("label", "c").alias("label"), F.when(F.col("label").isNull(), F.col("rep")).otherwise(F.col("least")).alias("component_id"))
    out = signed.select("doc_id", "t", F.col("n").alias("n_shingles"), "c").join(of, "c", "left")
    none = F.col("n_shingles") == 0
    out = out.withColumns({"component_id": F.when(none, F.col("doc_id")).otherwise(F.col("component_id")), "label": F.when(none, F.col("t")).otherwise(F.col("label"))})
    return out.select("doc_id", "t", "label", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
