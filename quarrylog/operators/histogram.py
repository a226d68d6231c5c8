"""Match histograms on a dense, epoch-aligned axis."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECOND = 1_000_000_000
WIDTHS = tuple(s * SECOND for s in (1, 2, 5, 10, 15, 30, 60, 120, 300, 600, 900, 1800, 3600, 7200, 10800, 21600, 43200, 86400, 172800, 259200, 604800, 1209600, 2592000, 7776000, 31536000))
MAX_BUCKETS = 100


@dataclass
class Histogram:
    start: int
    width: int
    counts: list[int] = field(default_factory=list)

    @property
    def total(self) -> int:
        return sum(self.counts)

    def reach(self, n: int, newest_first: bool = False) -> tuple[int, int]:
        """The range of time [lo, hi) that holds the first n hits, or the last."""
        seen, order = 0, range(len(self.counts))
        for i in reversed(order) if newest_first else order:
            seen += self.counts[i]
            if seen >= n:
                break
        end = self.start + self.width * len(self.counts)
        return (self.start + self.width * i, end) if newest_first else (self.start, self.start + self.width * (i + 1))


def buckets(lo: int, hi: int, width: int) -> int:
    """Aligned buckets that [lo, hi) touches."""
    return (hi - 1) // width - lo // width + 1


def axis(extents: Iterable[tuple[int, int]], from_ns: int, to_ns: int) -> Histogram | None:
    """The finest axis of at most MAX_BUCKETS over the given (min_ts, max_ts), clipped to [from_ns, to_ns); None if nothing is left."""
    extents = list(extents)
    if not extents:
        return None
    lo, hi = max(min(a for a, _ in extents), from_ns), min(max(b for _, b in extents) + 1, to_ns)
    if lo >= hi:
        return None
    width = next((w for w in WIDTHS if buckets(lo, hi, w) <= MAX_BUCKETS), 2 * WIDTHS[-1])
    while buckets(lo, hi, width) > MAX_BUCKETS:
        width *= 2
    return Histogram(lo // width * width, width, [0] * buckets(lo, hi, width))


def bucket_start(ts: Column, width) -> Column:
    """Floor to the bucket, before 1970 too."""
    w = width if isinstance(width, Column) else F.lit(width)
    return ts - F.pmod(ts, w)


def counted(hits: DataFrame, h: Histogram) -> Histogram:
    """Fill an axis with the exact number of hits (ts_ns); partial sums, at most as many rows as buckets."""
    at = F.expr(f"(ts_ns - {h.start}) div {h.width}")
    last = len(h.counts) - 1
    rows = hits.groupBy(F.least(F.greatest(at, F.lit(0)), F.lit(last)).cast("int").alias("b")).count().collect()
    counts = [0] * len(h.counts)
    for r in rows:
        counts[r["b"]] = r["count"]
    return Histogram(h.start, h.width, counts)


def dense(lines: DataFrame, width_ns: int) -> DataFrame:
    """bucket_start, n for every bucket between the first and the last line, empty ones too."""
    counts = lines.groupBy(bucket_start(F.col("ts_ns"), width_ns).alias("bucket_start")).agg(F.count("*").alias("n"))
    ends = counts.agg(F.min("bucket_start").alias("lo"), F.max("bucket_start").alias("hi")).where("lo is not null")
    starts = ends.select(F.explode(F.sequence("lo", "hi", F.lit(width_ns).cast("long"))).alias("bucket_start"))
    return starts.join(counts, "bucket_start", "left").select("bucket_start", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
