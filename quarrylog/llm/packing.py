"""Best-fit packing by bin completion branch-and-bound.

Documents are tokenised (each distinct chunk once per worker, cut where the tokenizer never joins), cut where longer
than a sequence, and packed by their lengths alone: pieces of one length are interchangeable, so the packing is solved on
the histogram of lengths, which has at most `size` entries however large the corpus is.

1. Incumbents: best fit (around the largest remaining length always the largest that fits), and least waste: a table of
   reachable sums of the remaining lengths gives the least waste that any filling of a bin can have, and the filling itself.
2. If neither meets the lower bound (Martello and Toth's L2), bin completion goes on from them: around the largest
   remaining length the undominated fillings are enumerated by waste, each taken as often as counts allow and then less
   often. A branch is left when its waste so far and the least that the next bin must waste exceed what a better packing
   may waste, or when its sequences and the bound of the rest don't beat the incumbent.

The search is exact if it ends; it ends in any case after SEARCH_STEPS steps, with the incumbent. Packing is NP-hard, so
some such limit is part of the method; whatever the outcome, every piece is placed.

Pieces are then ranked within their length and take the slots of that rank. The n pieces of a length are ranked in about
sqrt(n) hash buckets of about sqrt(n) pieces, so a length of a third of all pieces is spread, and its buckets are few.

Defined cases: a null or empty text is the end id alone; the tokenizer's special tokens in a text are their ids, as it
reads them itself; repeated rows are packed each; ties take any slot of their length in an order fixed by doc_id, piece and
content; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import math
import os
import unicodedata
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, Block, Workspace, blocks, give_back, multi_arange, prefix_sums, span_hashes

SIZE, END_ID = 4096, 1
#: Steps of the search for a packing better than the incumbents.
SEARCH_STEPS = 100_000
#: Chunks whose ids a worker keeps.
CACHE_CHUNKS = 800_000
_ALNUM = np.array([b < 128 and chr(b).isalnum() for b in range(256)])
_PUNCT = np.array([32 < b < 127 and not chr(b).isalnum() for b in range(256)])
_OPENS = _PUNCT & (np.arange(256) != ord("'"))
#: The letter that stands for each byte in a byte-level vocabulary: itself where it is printable, else one from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}


def _one_word(t: str) -> bool:
    """Whether the tokenizer surely takes t as it is, as one run of letters: composed lower-case Latin, Greek or Cyrillic."""
    return t.isalpha() and (t.isascii() or (max(t) < "\u0530" and t == t.lower() and unicodedata.is_normalized("NFC", t)))


class ChunkTokenizer:
    """Ids of whole documents through a table of distinct chunks.

    The tokenizer lower-cases and splits at white space and between letters or digits and other signs, before its merges; so a
    text may be cut at white space, from an ASCII letter or digit to an ASCII sign, and back unless that sign is an apostrophe
    (which may open a contraction). The tokenizer's special tokens are chunks of their own."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core and one memory arena a worker
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        self.model = self.tok.model
        probe = ["a", "the", "xqzj", "incomprehensibilities", "ünïcödé", "ωμέγα", "жизнь"]
        #: whether a run of letters is one word of the model, so that it needs no normaliser and no splitting
        self.plain = all([t.id for t in self.model.tokenize(w.encode().decode("latin-1").translate(_BYTE_CHARS))] == self.tok.encode(w, add_special_tokens=False).ids for w in probe)
        self.clear()

    def clear(self) -> None:
        self.tables = [self._table(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))] * 2  # all, and the latest
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    @staticmethod
    def _table(hashes: np.ndarray, at: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, ascending, and where their ids begin and how many they are."""
        order = np.argsort(hashes, kind="stable")
        return hashes[order], at[order], count[order]

    def _ids(self, chunks: list[bytes]) -> list[list[int]]:
        """The ids of each chunk."""
        texts, out, rest = [c.decode("utf-8", "replace") for c in chunks], [[] for _ in chunks], []
        for i, t in enumerate(texts):
            if self.plain and _one_word(t):
                out[i] = [x.id for x in self.model.tokenize(t if t.isascii() else chunks[i].decode("latin-1").translate(_BYTE_CHARS))]
            else:
                rest.append(i)
        for k in range(0, len(rest), 4096):
            part = rest[k : k + 4096]
            for i, e in zip(part, self.tok.encode_batch_fast([texts[i] for i in part], add_special_tokens=False), strict=True):
                out[i] = e.ids
        return out

    def _learn(self, hashes: np.ndarray, chunks: list[bytes]) -> None:
        found = self._ids(chunks)
        count = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.uint32, int(count.sum()))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(flat)] = flat
        at = self.used + np.cumsum(count) - count
        self.used += len(flat)
        every, latest = self.tables
        latest = self._table(*(np.concatenate(x) for x in zip(latest, (hashes, at, count), strict=True)))
        if 4 * len(latest[0]) > len(every[0]):
            every, latest = self._table(*(np.concatenate(x) for x in zip(every, latest, strict=True))), self._table(*(x[:0] for x in latest))
        self.tables = [every, latest]

    def _find(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each hash begin (-1: not known) and how many they are."""
        at, count = np.full(len(u), -1, np.int64), np.zeros(len(u), np.int64)
        for hashes, begins, n in self.tables:
            if len(hashes):
                k = np.minimum(np.searchsorted(hashes, u), len(hashes) - 1)
                ok = hashes[k] == u
                at[ok], count[ok] = begins[k[ok]], n[k[ok]]
        return at, count

    def encode(self, block) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block, each document ended by END_ID, and where each document starts (n + 1 long)."""
        b = LOWER[block.buf]
        breaks = np.zeros(len(b) + 1, bool)
        breaks[1:-1] = (_ALNUM[b[:-1]] & _PUNCT[b[1:]]) | (_OPENS[b[:-1]] & _ALNUM[b[1:]])
        raw = block.buf.tobytes()
        for token in self.special:  # one chunk each, as the tokenizer takes them out of the text as it is, before anything else
            i = raw.find(token)
            while i >= 0:
                breaks[i + 1 : i + len(token)] = False
                breaks[[i, i + len(token)]] = True
                i = raw.find(token, i + len(token))
        own = Block(b, block.offs, block.rows)
        starts, ends, first = own.words(breaks=breaks[:-1])
        h = span_hashes(prefix_sums(b), starts, ends)
        u, where, inv = np.unique(h, return_index=True, return_inverse=True)
        if len(self.tables[0][0]) > CACHE_CHUNKS:
            self.clear()
        at, counts = self._find(u)
        new = np.flatnonzero(at < 0)
        if len(new):
            buf = b.tobytes()
            self._learn(u[new], [buf[starts[i] : ends[i]] for i in where[new]])
            at, counts = self._find(u)
        at, counts = at[inv], counts[inv]
        ends_at = np.concatenate([[0], np.cumsum(counts)])[first] + np.arange(block.n + 1)
        out = np.empty(int(ends_at[-1]), np.uint32)
        is_end = np.zeros(len(out), bool)
        is_end[ends_at[1:] - 1] = True
        out[is_end] = END_ID
        out[~is_end] = self.ids[multi_arange(at, counts)]
        return out, ends_at


_tokenizers: dict[str, ChunkTokenizer] = {}


def pieces(docs: DataFrame, path: str, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids of every piece."""
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def run(batches):
        tok = _tokenizers.get(path) or _tokenizers.setdefault(path, ChunkTokenizer(path))
        for rb in batches:
            for b in blocks(rb.column(1)):
                ids, at = tok.encode(b)
                n = np.diff(at)
                cuts = -(-n // size)
                doc = np.repeat(np.arange(b.n), cuts)
                piece = multi_arange(np.zeros(b.n, np.int64), cuts)
                start = piece * size
                length = np.minimum(n[doc] - start, size)
                lo = at[:-1][doc] + start
                crc = [zlib.crc32(ids[i : i + k]) for i, k in zip(lo.tolist(), length.tolist(), strict=True)]
                cols = [rb.column(0)[b.rows].take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.array([ids[i : i + k].astype(np.int64) for i, k in zip(lo, length, strict=True)], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])
            give_back()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


class Pool:
    """The lengths left, ascending, with their counts; and which sums some of them have: bit s of sums(i) tells whether
    lengths[:i] can sum to s, each used at most as often as it is there."""

    def __init__(self, counts: dict[int, int], size: int):
        self.size, self.x = size, sorted(k for k, v in counts.items() if v > 0)
        self.n = [counts[k] for k in self.x]
        self._sums, self._valid, self._top = [1] * (len(self.x) + 1), 0, len(self.x) - 1
        self._mask = (1 << (size + 1)) - 1

    def sums(self, i: int) -> int:
        while self._valid < i:
            k, r, x = self._valid, self._sums[self._valid], self.x[self._valid]
            left, step = min(self.n[k], self.size // x), 1
            while left:
                t = min(step, left)
                r |= (r << t * x) & self._mask
                left, step = left - t, 2 * step
            self._sums[k + 1] = r
            self._valid += 1
        return self._sums[i]

    def take(self, i: int, times: int) -> None:
        """Take a length so often, or give it back (times below 0)."""
        most = self.size // self.x[i]
        if min(self.n[i], most) != min(self.n[i] - times, most):
            self._valid = min(self._valid, i)
        self.n[i] -= times
        if self.n[i]:
            self._top = max(self._top, i)

    def largest(self) -> int:
        """Index of the largest length left (-1: none is)."""
        while self._top >= 0 and not self.n[self._top]:
            self._top -= 1
        return self._top

    def least_waste(self, room: int) -> int:
        return room - ((self.sums(self._top + 1) & ((2 << room) - 1)).bit_length() - 1)

    def filling(self, total: int) -> list[int]:
        """Indices of lengths that sum to a reachable total, the largest first."""
        out, i = [], min(self._top + 1, bisect.bisect_right(self.x, total))
        while total:
            i -= 1
            for k in range(min(self.n[i], total // self.x[i]), 0, -1):
                if self.sums(i) >> (total - k * self.x[i]) & 1:
                    out += [i] * k
                    total -= k * self.x[i]
                    break
        return out

    def best_fit(self, room: int) -> list[int]:
        """Indices of the largest length that fits, again and again."""
        out, i = [], min(self._top + 1, bisect.bisect_right(self.x, room))
        while room and i:
            i = min(i, bisect.bisect_right(self.x, room)) - 1
            if i < 0:
                break
            k = min(self.n[i], room // self.x[i])
            out += [i] * k
            room -= k * self.x[i]
        return out


def greedy(counts: dict[int, int], size: int, fill) -> list[tuple[int, list[int]]]:
    """(how often, lengths): around the largest length left the filling that fill(pool, room) gives, as often as counts allow."""
    pool, out = Pool(counts, size), []
    while (i := pool.largest()) >= 0:
        pool.take(i, 1)
        own = [i, *fill(pool, size - pool.x[i])]
        pool.take(i, -1)
        need = {k: own.count(k) for k in set(own)}
        times = min(pool.n[k] // n for k, n in need.items())
        out.append((times, [pool.x[k] for k in own]))
        for k, n in need.items():
            pool.take(k, times * n)
    return out


def lower_bound(counts: dict[int, int], size: int) -> int:
    """Martello and Toth's L2: of all thresholds k, what lengths over size - k, over half, and from k on need at least."""
    if not counts:
        return 0
    n = np.zeros(size + 2, np.int64)
    for k, v in counts.items():
        n[k] = v
    return bound_of(n, size)


def bound_of(n: np.ndarray, size: int) -> int:
    """lower_bound of the counts n, by length up to size + 1."""
    c, w = np.cumsum(n), np.cumsum(n * np.arange(size + 2))  # of lengths up to each
    k, half = np.arange(size // 2 + 1), size // 2
    alone, over = c[size] - c[size - k], c[size - k] - c[half]
    room = over * size - (w[size - k] - w[half])
    rest = w[half] - np.where(k > 0, w[k - 1], 0)
    return int((alone + over + np.maximum(0, -(-(rest - room) // size))).max())


def dominated(own: list[int], waste: int, left: list[int]) -> bool:
    """Whether another filling is never worse: if a length that is left (ascending) fits besides, or instead of a smaller one or two."""
    if not left:
        return False
    if left[0] <= waste:
        return True
    parts = {(x + 1, x + waste) for x in set(own)} | {(x + y, x + y + waste) for i, x in enumerate(own) for y in own[:i]}
    return any((k := bisect.bisect_left(left, lo)) < len(left) and left[k] <= hi for lo, hi in parts)


def improve(counts: dict[int, int], size: int, best: list[tuple[int, list[int]]], steps: int) -> list[tuple[int, list[int]]]:
    """Bin completion branch-and-bound from an incumbent on.

    All levels of the search share one pool: a level takes its filling, and gives it back when it is tried again. So a level
    holds its filling and no more, however many lengths there are."""
    used = lambda plan: sum(t for t, _ in plan)
    total, bound, left, fewest = sum(k * v for k, v in counts.items()), lower_bound(counts, size), steps, used(best)
    pool, held = Pool(counts, size), np.zeros(size + 2, np.int64)
    index = {x: i for i, x in enumerate(pool.x)}
    held[pool.x] = pool.n

    def take(x: int, times: int) -> None:
        pool.take(index[x], times)
        held[x] -= times

    def fillings(room: int, after: tuple | None, most: int):
        """(waste, members) of the pool's undominated fillings of the room, the least waste first, up to most, only those after the given one."""
        nonlocal left

        def go(i: int, total: int):
            nonlocal left
            left -= 1
            if not total:
                yield []
                return
            for j in range(min(i, bisect.bisect_right(pool.x, total)) - 1, -1, -1):
                if left < 0:
                    return
                if not pool.sums(j + 1) >> total & 1:
                    return  # nor do smaller lengths alone sum to it
                for k in range(min(pool.n[j], total // pool.x[j]), 0, -1):
                    if pool.sums(j) >> (total - k * pool.x[j]) & 1:
                        for more in go(j, total - k * pool.x[j]):
                            yield [pool.x[j]] * k + more

        top = pool.largest() + 1
        for waste in range(pool.least_waste(room), min(most, room) + 1):
            if not pool.sums(top) >> (room - waste) & 1:
                continue
            for members in go(top, room - waste):
                if after is not None and (waste, [-m for m in members]) <= after:
                    continue
                there = [y for y, n in zip(pool.x, pool.n, strict=True) if n and n > members.count(y)]
                if not dominated(members, waste, there):
                    yield waste, members

    def branches(n: int, wasted: int, last):
        """What may follow the pool's state, each as (times, filling) and what came of it; the pool is without them until the next one."""
        spare = (fewest - 1) * size - total - wasted
        if spare < 0 or n + bound_of(held, size) >= fewest:
            return
        x = pool.x[pool.largest()]
        take(x, 1)
        for waste, members in fillings(size - x, last[1] if last and last[0] == x else None, spare):
            need = {k: members.count(k) for k in set(members)}
            need[x] = need.get(x, 0) + 1
            for times in range(min((pool.n[index[k]] + (k == x)) // m for k, m in need.items()), 0, -1):
                if wasted + times * waste > (fewest - 1) * size - total:
                    continue
                for k, m in need.items():
                    take(k, times * m - (k == x))
                yield (times, [x, *members]), n + times, wasted + times * waste, (x, (waste, [-m for m in members]))
                for k, m in need.items():
                    take(k, (k == x) - times * m)
        take(x, -1)

    path: list[tuple[int, list[int]]] = []
    stack = [branches(0, 0, None)]
    while stack and left > 0 and fewest > bound:
        left -= 1
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            if path:
                path.pop()
            continue
        own, n, wasted, last = step
        if pool.largest() < 0:
            if n < fewest:
                best, fewest = [*path, own], n
            continue
        path.append(own)
        stack.append(branches(n, wasted, last))
    return best


def pack_lengths(counts: dict[int, int], size: int = SIZE, steps: int = SEARCH_STEPS) -> list[tuple[int, list[int]]]:
    """(how often, lengths in order of place) of each filling used; every length is used exactly counts[length] times."""
    counts = {k: v for k, v in counts.items() if v > 0}
    if not counts:
        return []
    used, bound = lambda plan: sum(t for t, _ in plan), lower_bound(counts, size)
    best = greedy(counts, size, Pool.best_fit)
    if used(best) > bound:
        best = min(best, greedy(counts, size, lambda p, room: p.filling(room - p.least_waste(room))), key=used)
    return best if used(best) == bound else improve(counts, size, best, steps)


def slots(plan: list[tuple[int, list[int]]]) -> dict[str, np.ndarray]:
    """For each (length, first rank): the sequence of that rank, and the place in it; later ranks are in later sequences."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for times, own in plan:
        at = 0
        for x in own:
            rows.append((x, used.get(x, 0), base, at))
            used[x] = used.get(x, 0) + times
            at += x
        base += times
    a = np.array(rows, np.int64).reshape(-1, 4)
    a = a[np.lexsort((a[:, 1], a[:, 0]))]
    return {"key": (a[:, 0] << 48) | a[:, 1], "rank": a[:, 1], "sequence": a[:, 2], "place": a[:, 3]}


def pack(parts: DataFrame, size: int = SIZE, steps: int = SEARCH_STEPS) -> DataFrame:
    """parts: a table with doc_id, piece, length, ids_crc32 beside any other columns (read three times); adds sequence_id and offset."""
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    place = slots(pack_lengths(counts, size, steps))
    # one literal that Spark folds, not a column for each length
    many = F.split(F.lit(",".join(str(math.isqrt(counts.get(k, 1) - 1) + 1) for k in range(max(counts, default=0) + 1))), ",")
    parts = parts.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.element_at(many, F.col("length").cast("int") + 1).cast("long")))
    by = parts.groupBy("length", "_bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by.select("length", "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = parts.withColumn("_within", within).join(offsets, ["length", "_bucket"]).withColumn("_rank", F.col("_before") + F.col("_within"))
    src = ranked.drop("_bucket", "_within", "_before")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.drop("_rank").schema)
    names = src.columns

    def run(batches):
        for rb in batches:
            length, rank = rb.column(names.index("length")).to_numpy(), rb.column(names.index("_rank")).to_numpy()
            at = np.searchsorted(place["key"], (length << 48) | rank, "right") - 1
            keep = [i for i, c in enumerate(names) if c != "_rank"]
            yield pa.RecordBatch.from_arrays([*(rb.column(i) for i in keep), pa.array(place["sequence"][at] + rank - place["rank"][at]), pa.array(place["place"][at])], [*(names[i] for i in keep), "sequence_id", "offset"])

    return src.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def tokenise_and_pack(docs: DataFrame, path: str, size: int = SIZE) -> DataFrame:
    ws = Workspace(docs.sparkSession, "packing")
    return pack(ws.cut(pieces(docs, path, size), "pieces"), size).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
