"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that claim them). Token capacity flows from each
pattern to the quotas of its sources; the k-th repetition of a pattern's tokens costs k - 1, so repetition costs are convex
and fresh tokens go first. A pattern's flow is then met with whole documents in a seeded order: all of them as often as
the flow covers the pattern, and once more those before a cut. The cut is found from sizes summed by hash range; only
the one range that holds it is walked document by document, and a document too large for what is left there is passed over.

The flow falls apart into components of patterns and sources that share any; each is solved on its own, so disjoint sources
cost no more than their number. The driver holds one row per pattern, never one per document; that row's table is broadcast
while it has at most BROADCAST_ROWS rows and joined by key beyond.

Defined cases: a null text has size 0; null is a source of its own and comes last; documents of size 0 take nothing;
repeated rows are documents of their own, equal ones being interchangeable; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

#: Documents in the hash range that is walked one by one, about.
RANGE_ROWS = 4000
#: Rows of a table of patterns or sources that may be broadcast.
BROADCAST_ROWS = 100_000


def n_words(text):
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def shared_targets(sizes: Sequence[int], weights: Sequence[float], total: float, most: float) -> list[float]:
    """Share total by weight; no target above most times its size, the excess being shared again by weight."""
    out, open_, left = [0.0] * len(sizes), list(range(len(sizes))), total
    while open_:
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if weights[i] * left / w > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = weights[i] * left / w
            break
        for i in over:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


def flows_by_component(capacity: Sequence[int], members: Sequence[Sequence[int]], quotas: Sequence[int], repeats: int) -> list[dict[int, int]]:
    """min_cost_flow over each component of patterns that share sources; their union is a flow of least cost of the whole."""
    root = list(range(len(quotas)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for own in members:
        for q in own[1:]:
            root[find(q)] = find(own[0])
    parts: dict[int, list[int]] = {}
    for p, own in enumerate(members):
        if own:
            parts.setdefault(find(own[0]), []).append(p)
    out: list[dict[int, int]] = [{} for _ in members]
    for part in parts.values():
        sources = sorted({q for p in part for q in members[p]})
        place = {q: i for i, q in enumerate(sources)}
        flow = min_cost_flow([capacity[p] for p in part], [[place[q] for q in members[p]] for p in part], [quotas[q] for q in sources], repeats)
        for p, f in zip(part, flow, strict=True):
            out[p] = {sources[i]: v for i, v in f.items()}
    return out


def travelling(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def min_cost_flow(capacity: Sequence[int], members: Sequence[Sequence[int]], quotas: Sequence[int], repeats: int) -> list[dict[int, int]]:
    """Route each pattern's capacity (repeats times, the k-th at cost k - 1) to the quotas of its sources: flow by pattern and source."""
    n, m = len(capacity), len(quotas)
    s, t = n + m, n + m + 1
    head: list[list[int]] = [[] for _ in range(n + m + 2)]
    to, cap, cost = [], [], []

    def arc(a, b, c, w):
        for x, y, k, v in ((a, b, c, w), (b, a, 0, -w)):
            head[x].append(len(to))
            to.append(y)
            cap.append(k)
            cost.append(v)

    for p in range(n):
        for k in range(repeats):
            arc(s, p, capacity[p], k)
    inner = {}
    for p in range(n):
        for q in members[p]:
            inner[p, q] = len(to)
            arc(p, n + q, repeats * capacity[p], 0)
    for q in range(m):
        arc(n + q, t, quotas[q], 0)
    while True:
        far, by, queued = [float("inf")] * (n + m + 2), [-1] * (n + m + 2), {s}
        far[s], line = 0, deque([s])
        while line:
            a = line.popleft()
            queued.discard(a)
            for e in head[a]:
                if cap[e] > 0 and far[a] + cost[e] < far[to[e]]:
                    far[to[e]], by[to[e]] = far[a] + cost[e], e
                    if to[e] not in queued:
                        queued.add(to[e])
                        line.append(to[e])
        if by[t] < 0:
            break
        path, a = [], t
        while a != s:
            path.append(by[a])
            a = to[by[a] ^ 1]
        f = min(cap[e] for e in path)
        for e in path:
            cap[e] -= f
            cap[e ^ 1] += f
    out: list[dict[int, int]] = [{} for _ in range(n)]
    for (p, q), e in inner.items():
        if cap[e ^ 1]:
            out[p][q] = cap[e ^ 1]
    return out


def mix(docs: DataFrame, quotas: dict[str | None, int], repeats: int = 2, seed: int = 1) -> DataFrame:
    """docs: size long, sources array<string> and _h long (a seeded hash of the document) beside any other columns; adds taken long.

    docs is read three times; pass a table. quotas: tokens wanted of each source; a source without quota takes nothing."""
    spark, names = docs.sparkSession, list(quotas)
    place = {s: i for i, s in enumerate(names)}
    docs = docs.withColumn("_pattern", F.to_json(F.array_sort("sources"), {"ignoreNullFields": "false"}))
    patterns = docs.groupBy("_pattern").agg(F.first("sources").alias("sources"), F.sum("size").alias("size"), F.count("*").alias("n")).orderBy("_pattern").collect()
    if not patterns:
        return docs.drop("_pattern", "_h").withColumn("taken", F.lit(0).cast("long"))
    flows = flows_by_component([r["size"] for r in patterns], [sorted({place[x] for x in r["sources"] if x in place}) for r in patterns], [quotas[x] for x in names], repeats)
    bits = max(0, (sum(r["n"] for r in patterns) // RANGE_ROWS).bit_length())
    docs = docs.withColumn("_b", F.shiftrightunsigned("_h", 64 - bits) if bits else F.lit(0).cast("long"))
    plan = []
    for r, f in zip(patterns, flows, strict=True):
        full, rest = divmod(sum(f.values()), r["size"]) if r["size"] else (0, 0)
        plan.append((r["_pattern"], full, rest))
    plan_df = spark.createDataFrame(plan, "_pattern string, _full long, _rest long")
    sums = docs.groupBy("_pattern", "_b").agg(F.sum("size").alias("_size"))
    from pyspark.sql import Window

    upto = F.sum("_size").over(Window.partitionBy("_pattern").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
    cuts = {r["_pattern"]: (r["_b"], r["_rest"] - r["_upto"] + r["_size"]) for r in sums.withColumn("_upto", upto).join(plan_df, "_pattern").where("_rest > 0 and _upto >= _rest and _upto - _size < _rest").collect()}
    table = spark.createDataFrame([(p, full, *cuts.get(p, (-1, 0))) for p, full, _ in plan], "_pattern string, _full long, _cut long, _need long")
    own = docs.join(travelling(table, len(plan)), "_pattern")
    keep = [c for c in docs.columns if c not in ("_pattern", "_h", "_b")]
    clear = own.where("_b <> _cut").select(*keep, (F.col("size") * (F.col("_full") + F.when(F.col("_b") < F.col("_cut"), 1).otherwise(0))).alias("taken"))
    # in the range of the cut, whole documents by hash as long as they fit
    edge = own.where("_b = _cut")
    fields = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema), "taken long"]

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_h", "size"], kind="stable")
        need, total = int(rows["_need"].iloc[0]), int(rows["size"].sum())
        out = 2 * need > total  # the smaller part is walked: what to add, or what to leave out
        if out:
            rows, need = rows.iloc[::-1], total - need
        taken = []
        for full, size in zip(rows["_full"], rows["size"], strict=True):
            fits = 0 < size <= need
            need -= size if fits else 0
            taken.append(size * (full + (fits != out)))
        return rows[keep].assign(taken=taken)

    return clear.unionByName(edge.groupBy("_pattern").applyInPandas(walk, ", ".join(fields)))


def seeded_hash(seed: int):
    return F.xxhash64(F.lit(seed), "doc_id", F.xxhash64(F.col("text")))


def mixed_by_source(sized: DataFrame, weights: Sequence[float], share: float, most: int, seed: int) -> tuple[DataFrame, list[tuple]]:
    """sized (with source, size and _h) with taken, and (source, size, target) of each source by code point, null last."""
    total = {r["source"]: r["size"] for r in sized.groupBy("source").agg(F.sum("size").alias("size")).collect()}
    names = sorted(total, key=lambda x: (x is None, x or ""))
    targets = shared_targets([total[x] for x in names], [weights[i % len(weights)] for i in range(len(names))], share * sum(total.values()), most)
    mixed = mix(sized.withColumn("sources", F.array("source")), {x: round(t) for x, t in zip(names, targets, strict=True)}, most, seed)
    return mixed, [(x, total[x], t) for x, t in zip(names, targets, strict=True)]


def mix_by_source(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 1) -> DataFrame:
    """Mix documents by their source column: doc_id, size, source_size, target and taken."""
    ws = Workspace(docs.sparkSession, "mixing")
    sized = ws.cut(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), seeded_hash(seed).alias("_h")), "sized")
    mixed, info = mixed_by_source(sized, weights, share, most, seed)
    info_df = docs.sparkSession.createDataFrame(info, "_s string, source_size long, target double")
    return mixed.join(travelling(info_df, len(info)), F.col("source").eqNullSafe(F.col("_s"))).select("doc_id", "size", "source_size", "target", "taken")


def resampled(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 1) -> DataFrame:
    """The documents of the mix with all their columns, each as often as it is taken. docs is read four times; pass a table."""
    names = docs.columns
    own = [f"_x{i}" for i in range(len(names))]
    sized = docs.select(*(F.col(f"`{c}`").alias(x) for c, x in zip(names, own, strict=True)), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), seeded_hash(seed).alias("_h"))
    mixed, _ = mixed_by_source(sized, weights, share, most, seed)
    times = F.expr("explode(sequence(1, cast(taken div size as int)))")
    return mixed.where("taken > 0").select(*own, times.alias("_i")).select(*own).toDF(*names)
