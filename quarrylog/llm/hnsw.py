"""Approximate nearest neighbours: a hierarchical navigable small-world graph over cells of vectors.

1. Equal vectors are indexed once with their smallest ids (one more than the neighbours wanted, which is all that ties by id
   can need), so a common vector neither fills a cell nor breaks a graph.
2. Cells are fitted on a bounded sample: k-means on one half of SAMPLE_ROWS vectors picked by hash. The graph is built over
   the cells' centres. The other half tells how many cells a query must visit for RECALL of its nearest. Neighbours in the
   whole table are nearer than those in the sample, so there the same number of cells finds more.
3. Every vector goes to the cell of its nearest centre. Cells are files of flat arrays in the shared folder, some to a file;
   one of more than SHARD_ROWS vectors is spread over several.
4. Each query finds its cells by the graph, once. A task takes a group of files and a block of queries, multiplies each cell
   with the queries that visit it, and keeps the nearest. Files are mapped where they lie: a shuffle carries pairs of numbers.
5. Distances of what is kept are taken again in double precision on the original vectors; a query's results of all groups (at
   most GROUPS, with its k nearest each) are merged by rank.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, as queries neither;
vectors of another length than the query's are no candidates; repeated rows (id and vector) count once; rows that share
the query's id are its own; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, map_file, multi_arange, write_bytes

M, EF_BUILD, EF_SEARCH, SHARD_ROWS, QUERY_BLOCK = 16, 64, 16, 65_536, 1024
#: Cells at most, vectors they are fitted and measured on at most (and bytes), the recall that the visited cells are to give.
CELLS, SAMPLE_ROWS, SAMPLE_BYTES, RECALL = 1024, 32_768, 16 << 20, 0.97
#: Groups of files that a query's results are merged over, at most.
GROUPS = 64
#: Vectors of a cell that are multiplied at once, and how many more than wanted are kept for the distances in double precision.
SCAN, SPARE = 4096, 8


class Graph:
    """Vectors (float32 rows), the entry node, and of each level its nodes and their neighbours (-1: none)."""

    def __init__(self, vectors: np.ndarray, entry: int = -1, levels: list[tuple[np.ndarray, np.ndarray]] | None = None):
        self.v, self.entry, self.levels = vectors, entry, levels or []
        self.norm = (vectors * vectors).sum(1)
        self.stamp, self.seen = 0, np.zeros(len(vectors), np.int64)
        self.row = [self._rows(nodes) for nodes, _ in self.levels]

    def _rows(self, nodes: np.ndarray) -> np.ndarray:
        row = np.full(len(self.v), -1, np.int32)
        row[nodes] = np.arange(len(nodes), dtype=np.int32)
        return row

    def far(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return self.norm[ids] - 2 * (self.v[ids] @ q)

    def search(self, q: np.ndarray, entries: list[tuple[float, int]], level: int, ef: int) -> list[tuple[float, int]]:
        """The ef nearest found on a level, nearest first (distances less |q|^2)."""
        self.stamp += 1
        nb, row, seen = self.levels[level][1], self.row[level], self.seen
        for _, i in entries:
            seen[i] = self.stamp
        todo = list(entries)
        heapq.heapify(todo)
        best = [(-d, i) for d, i in entries]
        heapq.heapify(best)
        while todo:
            d, i = heapq.heappop(todo)
            if len(best) >= ef and d > -best[0][0]:
                break
            ids = nb[row[i]]
            ids = ids[ids >= 0]
            ids = ids[seen[ids] != self.stamp]
            if not len(ids):
                continue
            seen[ids] = self.stamp
            for x, j in zip(self.far(q, ids).tolist(), ids.tolist(), strict=True):
                if len(best) < ef:
                    heapq.heappush(best, (-x, j))
                    heapq.heappush(todo, (x, j))
                elif x < -best[0][0]:
                    heapq.heapreplace(best, (-x, j))
                    heapq.heappush(todo, (x, j))
        return sorted((-d, i) for d, i in best)

    def nearest(self, q: np.ndarray, ef: int) -> list[int]:
        if len(self.v) <= ef:
            return list(range(len(self.v)))
        at = [(float(self.far(q, np.array([self.entry]))[0]), self.entry)]
        for level in range(len(self.levels) - 1, 0, -1):
            at = self.search(q, at, level, 1)
        return [i for _, i in self.search(q, at, 0, ef)]


def diverse(between: np.ndarray, most: int) -> list[int]:
    """Of items with these distances between them (to the node itself on the diagonal, nearest first): one is kept if it is
    nearer to the node than to any kept before; then the nearest of the rest."""
    kept: list[int] = []
    near = np.full(len(between), np.inf)
    for k in range(len(between)):
        if len(kept) == most:
            break
        if not kept or near[k] > between[k, k]:
            kept.append(k)
            near = np.minimum(near, between[:, k])
    for k in range(len(between)):
        if len(kept) == most:
            break
        if k not in kept:
            kept.append(k)
    return kept


def build(vectors: np.ndarray, m: int = M, ef: int = EF_BUILD, seed: int = 1) -> Graph:
    n = len(vectors)
    rng = np.random.default_rng(seed)
    height = np.minimum((-np.log(1 - rng.random(n)) / np.log(m)).astype(int), 12)
    g = Graph(vectors)
    if not n:
        return g
    top = int(height.max())
    for level in range(top + 1):
        nodes = np.flatnonzero(height >= level).astype(np.int32)
        g.levels.append((nodes, np.full((len(nodes), 2 * m if level == 0 else m), -1, np.int32)))
        g.row.append(g._rows(nodes))
    degree = [np.zeros(len(nodes), np.int32) for nodes, _ in g.levels]
    g.entry = 0
    reached = int(height[0])
    for i in range(1, n):
        q = vectors[i]
        at = [(float(g.far(q, np.array([g.entry]))[0]), g.entry)]
        for level in range(reached, -1, -1):
            if level > height[i]:
                at = g.search(q, at, level, 1)
                continue
            at = g.search(q, at, level, ef)
            nb, row, deg = g.levels[level][1], g.row[level], degree[level]
            most = nb.shape[1]
            own = select(g, q, at, m)
            nb[row[i], : len(own)] = own
            deg[row[i]] = len(own)
            for j in own:
                r = row[j]
                if deg[r] < most:
                    nb[r, deg[r]] = i
                    deg[r] += 1
                else:
                    cand = np.append(nb[r], i)
                    d = g.norm[cand] - 2 * (g.v[cand] @ g.v[j])
                    order = np.argsort(d, kind="stable")
                    nb[r] = select(g, g.v[j], list(zip(d[order].tolist(), cand[order].tolist(), strict=True)), most)
        if height[i] > reached:
            reached, g.entry = int(height[i]), i
    return g


def select(g: Graph, q: np.ndarray, found: list[tuple[float, int]], most: int) -> list[int]:
    """At most so many of the found, nearest first, spread over directions; exactly so many if there are."""
    if len(found) <= most:
        return [i for _, i in found]
    ids = np.array([i for _, i in found])
    x = g.v[ids]
    between = g.norm[ids][:, None] + g.norm[ids][None] - 2 * (x @ x.T)
    np.fill_diagonal(between, np.array([d for d, _ in found]) + float(q @ q))
    return ids[diverse(between, most)].tolist()


def valid(col: str):
    x = F.col(col)
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return x.isNotNull() & (F.size(x) > 0) & ~odd & F.exists(x, lambda v: v != 0)


def write_arrays(uri: str, arrays: list[np.ndarray]) -> None:
    """Arrays one after the other, after a table of their kinds, lengths and widths (0: flat)."""
    kinds = {np.dtype(np.float64): 0, np.dtype(np.int64): 1, np.dtype(np.int32): 2, np.dtype(np.float32): 3}
    head = np.array([len(arrays), *(x for a in arrays for x in (kinds[a.dtype], len(a), a.shape[1] if a.ndim > 1 else 0))], np.int64)
    # eight bytes are a multiple of every kind's
    write_bytes(uri, b"".join([head.tobytes(), *(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays)]))


def map_arrays(uri: str) -> list[np.ndarray]:
    data = map_file(uri)
    n = int(data[:8].view(np.int64)[0])
    head, at, out = data[8 : 8 + 24 * n].view(np.int64).reshape(n, 3), 8 + 24 * n, []
    for kind, length, width in head.tolist():
        dtype = np.dtype((np.float64, np.int64, np.int32, np.float32)[kind])
        size = dtype.itemsize * length * max(width, 1)
        a = data[at : at + size].view(dtype)
        out.append(a.reshape(length, width) if width else a)
        at += size + -size % 8
    return out


def rows_of(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Arrow lists of one length as the rows of a matrix."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def to_centres(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres, less each row's own square."""
    return (centres * centres).sum(1) - 2 * (x @ centres.T)


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *(to_centres(x[i : i + SCAN], centres).argmin(1) for i in range(0, len(x), SCAN))])


def fit(sample: np.ndarray, cells: int, k: int, rounds: int = 8, seed: int = 1) -> tuple[np.ndarray, int]:
    """Centres of cells, and how many cells a query must visit for RECALL of its k nearest, measured on vectors that took no part in the fit."""
    sample = sample[np.random.default_rng(seed).permutation(len(sample))]
    x, other = sample[: len(sample) // 2], sample[len(sample) // 2 :]
    centres = x[:cells].copy()
    for _ in range(rounds):
        own = nearest_centre(x, centres)
        order = np.argsort(own, kind="stable")
        there, at = np.unique(own[order], return_index=True)
        centres[there] = np.add.reduceat(x[order], at) / np.diff(at, append=len(x))[:, None]
    ask = other[:256]
    far = to_centres(ask, other)
    far[np.arange(len(ask)), np.arange(len(ask))] = np.inf
    found = np.argsort(far, axis=1, kind="stable")[:, : min(k, len(other) - 1)]
    own, way = nearest_centre(other, centres), to_centres(ask, centres)
    before = (way[:, None, :] < np.take_along_axis(way, own[found], 1)[:, :, None]).sum(2)
    return centres, 1 + int(np.quantile(before, RECALL, method="higher")) if before.size else len(centres)


def smallest(q: np.ndarray, d: np.ndarray, most: int) -> np.ndarray:
    """Places of each q's smallest d, at most so many, in order of q and d."""
    order = np.lexsort((d, q))
    new = np.flatnonzero(np.diff(q[order], prepend=-1))
    return order[np.arange(len(order)) - np.repeat(new, np.diff(new, append=len(order))) < most]


def scan(asked: np.ndarray, routes: np.ndarray, files: list[list[np.ndarray]], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query rows, file numbers and places of the vectors found nearest, about so many for each query.

    routes: the cells that each query visits. A file: vectors, mean, cells and where each begins, and more."""
    by = np.argsort(routes, axis=None, kind="stable")
    cells, rows = routes.ravel()[by], by // max(routes.shape[1], 1)
    limit = np.full(len(asked), np.inf)
    held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    new: list[list[np.ndarray]] = []

    def settle() -> None:
        nonlocal held
        held = [np.concatenate(x) for x in zip(held, *new, strict=True)]
        new.clear()
        keep = smallest(held[0], held[3], most)
        held = [x[keep] for x in held]
        last = np.flatnonzero(np.diff(held[0], append=-1))
        full = last[np.bincount(held[0], minlength=len(asked))[held[0][last]] >= most]
        limit[held[0][full]] = held[3][full]

    for f, (v, mean, own, begins, *_) in enumerate(files):
        q = asked - mean
        scale = max(1e-300, np.abs(q).max(initial=0), np.abs(v).max(initial=0) + np.abs(mean).max(initial=0))
        kind = np.float32 if 1e-12 < scale < 1e12 else np.float64
        # one product gives whole squared distances: (-2q, 1, |q|^2) by (v, |v|^2, 1)
        left = np.hstack([-2 * q, np.ones((len(q), 1)), (q * q).sum(1)[:, None]]).astype(kind)
        lo, hi = np.searchsorted(cells, own), np.searchsorted(cells, own, "right")
        for c in np.flatnonzero(hi > lo).tolist():
            who = rows[lo[c] : hi[c]]
            mine = left[who]
            for a in range(int(begins[c]), int(begins[c + 1]), SCAN):
                x = v[a : min(a + SCAN, int(begins[c + 1]))] - mean
                d = mine @ np.hstack([x, (x * x).sum(1)[:, None], np.ones((len(x), 1))]).astype(kind).T
                fresh = np.flatnonzero(np.isinf(limit[who]))
                if len(fresh) and len(x) > most:
                    limit[who[fresh]] = np.partition(d[fresh], most - 1, axis=1)[:, most - 1]
                i, j = np.nonzero(d <= limit[who][:, None])
                new.append([who[i], np.full(len(i), f), a + j, d[i, j].astype(np.float64)])
                if sum(len(n[0]) for n in new) > 200_000:
                    settle()
    settle()
    return held[0], held[1], held[2]


def neighbours(vectors: DataFrame, is_query, k: int = 10, ef: int = EF_SEARCH) -> DataFrame:
    """vectors: vec_id, embedding. query_id, rank, vec_id and score (Euclidean distance) of the k nearest of each query row.

    ef: cells that a query visits at least."""
    spark, ws = vectors.sparkSession, Workspace(vectors.sparkSession, "hnsw")
    root = ws.path("files")
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    rows = vectors.select("vec_id", F.col("embedding").cast(kind).alias("embedding")).where(valid("embedding") & F.col("vec_id").isNotNull())
    rows = rows.withColumn("h", F.xxhash64("embedding"))
    some = F.row_number().over(Window.partitionBy("h").orderBy("vec_id"))
    once = rows.dropDuplicates(["h", "vec_id"])
    distinct = once.withColumn("_r", some).where(F.col("_r") <= k + 1).groupBy("h").agg(F.first("embedding").alias("embedding"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    distinct = ws.cut(distinct.withColumn("dim", F.size("embedding")), "distinct")

    probes: dict[int, int] = {}  # of each length with a graph
    for r in distinct.groupBy("dim").agg(F.count("*").alias("n")).collect():
        most = max(1024, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * r["dim"])))
        cells = min(CELLS, math.isqrt(r["n"]), min(r["n"], most) // 4)
        if cells < 2:
            continue
        sample = distinct.where((F.col("dim") == r["dim"]) & (F.pmod("h", F.lit(-(-r["n"] // most))) == 0)).orderBy("h").limit(2 * most).select("embedding").toArrow()
        x = rows_of(sample.column("embedding")).astype(np.float64)
        if len(x) < 2 * cells:
            continue
        mean = x.mean(0)
        centres, probe = fit(x - mean, cells, k)
        g = build(centres.astype(np.float32))
        write_arrays(f"{root}/cells-{r['dim']}", [centres, mean, np.array([g.entry], np.int64), *(a for nodes, links in g.levels for a in (nodes, links))])
        probes[r["dim"]] = min(cells, max(ef, probe))

    def in_cells(batches, place=None):
        for rb in batches:
            dims, cell = rb.column(3).to_numpy(), np.zeros(rb.num_rows, np.int64)
            for dim in np.unique(dims).tolist():
                if dim in probes:
                    centres, mean, *_ = map_arrays(f"{root}/cells-{dim}")
                    own = np.flatnonzero(dims == dim)
                    cell[own] = nearest_centre(rows_of(rb.column(1).take(pa.array(own))) - mean, centres)
            if place is None:
                yield pa.RecordBatch.from_arrays([rb.column(3), pa.array(cell)], ["dim", "cell"])
                continue
            h, shard = rb.column(0).to_numpy(), np.zeros(rb.num_rows, np.int64)
            for key in np.unique(np.stack([dims, cell]), axis=1).T.tolist():
                own = (dims == key[0]) & (cell == key[1])
                first, over = place[tuple(key)]
                shard[own] = first + h[own] % over
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(cell), pa.array(shard)], ["h", "embedding", "ids", "dim", "cell", "shard"])

    columns = distinct.select("h", "embedding", "ids", "dim")
    sizes = columns.mapInArrow(in_cells, "dim int, cell long").groupBy("dim", "cell").agg(F.count("*").alias("n")).orderBy("dim", "cell").collect()
    full = {(r["dim"], r["cell"]): r["n"] for r in sizes}
    place, shards, room, last = {}, -1, 0, None
    for r in sizes:  # cells of one length one after the other, a file for about SHARD_ROWS vectors; a larger cell has files of its own
        over = -(-r["n"] // SHARD_ROWS)
        if r["dim"] != last or r["n"] > room:
            shards, room = shards + 1, SHARD_ROWS
        place[r["dim"], r["cell"]] = shards, over
        shards, room, last = shards + over - 1, room - r["n"] if over == 1 else 0, r["dim"]
    dealt = columns.mapInArrow(lambda batches: in_cells(batches, place), f"h long, embedding {kind}, ids array<{dict(vectors.dtypes)['vec_id']}>, dim int, cell long, shard long")

    def index(t: pa.Table) -> pa.Table:
        cell = t.column("cell").to_numpy()
        order = np.lexsort((t.column("h").to_numpy(), cell))
        t, cell = t.take(pa.array(order)), cell[order]
        v, ids = rows_of(t.column("embedding")), t.column("ids").combine_chunks()
        own, begins = np.unique(cell, return_index=True)
        shard, dim = t.column("shard")[0].as_py(), v.shape[1]
        write_arrays(f"{root}/shard-{shard}", [v, v.mean(0, dtype=np.float64), own, np.append(begins, len(v)), ids.flatten().to_numpy().astype(np.int64), np.append(0, np.cumsum(ids.value_lengths().to_numpy())).astype(np.int64)])
        return pa.table({"shard": pa.array([shard], pa.int64()), "dim": pa.array([dim], pa.int32())})

    files = ws.cut(dealt.groupBy("shard").applyInArrow(index, "shard long, dim int"), "index")
    groups = files.groupBy("dim", (F.col("shard") % GROUPS).alias("group")).agg(F.sort_array(F.collect_list("shard")).alias("shards"))

    queries = rows.where(is_query).dropDuplicates(["h", "vec_id"]).select(F.col("vec_id").alias("query_id"), "embedding", F.size("embedding").alias("dim"))
    n_blocks = max(1, -(-queries.count() // QUERY_BLOCK))

    def gather(t: pa.Table) -> pa.Table:
        block, dim = t.column("block")[0].as_py(), t.column("dim")[0].as_py()
        asked, routes = rows_of(t.column("embedding")), np.zeros((t.num_rows, 1), np.int32)
        names = t.column("query_id").to_numpy().astype(np.int64)
        _, which, times = np.unique(names, return_inverse=True, return_counts=True)
        same = times[which]  # vectors under the query's id, which are no candidates
        if dim in probes:
            centres, mean, entry, *levels = map_arrays(f"{root}/cells-{dim}")
            g = Graph(centres.astype(np.float32), int(entry[0]), list(zip(levels[::2], levels[1::2], strict=True)))
            held, found = np.array([full.get((dim, c), 0) for c in range(len(centres))]), []
            for q, need in zip(asked - mean, k + same, strict=True):
                cells = g.nearest(q.astype(np.float32), probes[dim])
                if held[cells].sum() < need:  # then as many of the nearest cells as have enough vectors, or all
                    order = np.argsort(to_centres(q[None], centres)[0], kind="stable")
                    cells = order[: 1 + np.searchsorted(np.cumsum(held[order]), need)].tolist() + cells
                found.append(list(dict.fromkeys(cells)))
            # filled up to one width with a cell that there isn't
            routes = np.array([x + [len(centres)] * (max(map(len, found)) - len(x)) for x in found], np.int32)
        write_arrays(f"{root}/queries-{block}-{dim}", [asked, names, routes, same])
        return pa.table({"block": pa.array([block], pa.int64()), "dim": pa.array([dim], pa.int32())})

    dealt_queries = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)))
    blocks = ws.cut(dealt_queries.groupBy("block", "dim").applyInArrow(gather, "block long, dim int"), "blocks")
    visits = blocks.join(groups, "dim").repartition(max(1, min(groups.count() * n_blocks, 20_000)), "group", "block")

    def visit(batches):
        for rb in batches:
            for r in rb.to_pylist():
                asked, names, routes, same = map_arrays(f"{root}/queries-{r['block']}-{r['dim']}")
                asked = asked.astype(np.float64)
                own = [map_arrays(f"{root}/shard-{s}") for s in r["shards"]]
                who, of, at = scan(asked, routes, own, k + int(same.max()) + SPARE)
                out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
                for f in np.unique(of).tolist():
                    v, *_, ids, first = own[f]
                    q, j = who[of == f], at[of == f]
                    d = np.sqrt(((v[j].astype(np.float64) - asked[q]) ** 2).sum(1))
                    n = first[j + 1] - first[j]
                    for col, x in zip(out, (np.repeat(q, n), ids[multi_arange(first[j], n)], np.repeat(d, n)), strict=True):
                        col.append(x)
                q, i, d = (np.concatenate(x) for x in out)
                other = np.flatnonzero(i != names[q])
                other = other[np.argsort(i[other], kind="stable")]  # ties by id
                best = other[smallest(q[other], d[other], k)]
                yield pa.RecordBatch.from_arrays([pa.array(names[q[best]], pa.int64()), pa.array(i[best], pa.int64()), pa.array(d[best])], ["query_id", "vec_id", "score"])

    found = visits.mapInArrow(visit, "query_id long, vec_id long, score double").dropDuplicates(["query_id", "vec_id"])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
