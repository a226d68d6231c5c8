"""Search: prune segments by time, then by bloom filter, then scan what is left.

Pruning by time happens on the driver over the manifest; only the filters of segments in range are looked at, those that
are small together kept on the driver, others tested where they lie. The match histogram comes first, from a scan of times
and terms alone; it says up to which bucket the first (or last) lines asked for reach, so the scan for whole lines opens
only that part of the sorted files. A search ends after SEARCH_TIMEOUT_S seconds, and its jobs with it.
"""

from __future__ import annotations

import threading
import uuid
from collections import Counter
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bloom
from ..functions.text import matches, query_terms
from ..schema import CEIL, DEFAULT_LIMIT, FILTER_CACHE_BYTES, FLOOR, MAX_LIMIT, MAX_OUTCOMES, MAX_SEARCHES, MAX_TEXT_BYTES, SEARCH_ATTEMPTS, SEARCH_TIMEOUT_S, Busy, Corrupt, InvalidRequest, SearchTimeout, SegmentMissing
from . import segments as seg
from .histogram import Histogram, axis, counted
from .manifest import Manifest, Segment

TIME, BLOOM, SCANNED = "skipped_by_time", "skipped_by_bloom", "scanned"


@dataclass
class Outcome:
    segment: Segment
    outcome: str
    hits: int = 0

    @property
    def bytes_read(self) -> int:
        return self.segment.size_bytes if self.outcome == SCANNED else 0


@dataclass
class Result:
    hits: list[dict]
    truncated: bool
    histogram: Histogram | None
    outcomes: list[Outcome] = field(default_factory=list)
    retries: int = 0

    @property
    def metrics(self) -> dict[str, int]:
        by = Counter(o.outcome for o in self.outcomes)
        return {"segments_considered": len(self.outcomes), TIME: by[TIME], BLOOM: by[BLOOM], SCANNED: by[SCANNED], "bytes_read": sum(o.bytes_read for o in self.outcomes), "retries": self.retries}

    def as_json(self) -> dict:
        """What a reply holds: hits, flags, metrics, histogram and the listed outcomes."""
        h = self.histogram
        return {
            "hits": self.hits, "truncated": self.truncated, "metrics": self.metrics,
            "histogram": None if h is None else {"start": h.start, "width": h.width, "counts": h.counts, "total": h.total},
            "outcomes": [{"segment": o.segment.id, "outcome": o.outcome, "hits": o.hits, "bytes_read": o.bytes_read} for o in self.listed()],
        }

    def of_segment(self, segment_id: str) -> list[dict]:
        return [h for h in self.hits if h["segment_id"] == segment_id]

    def listed(self) -> list[Outcome]:
        """Outcomes for a reply: scanned ones go first where there are too many, then in order."""
        if len(self.outcomes) <= MAX_OUTCOMES:
            return self.outcomes
        keep = {id(o) for o in sorted(self.outcomes, key=lambda o: o.outcome != SCANNED)[:MAX_OUTCOMES]}
        return [o for o in self.outcomes if id(o) in keep]


def checked(text: str, tags: dict[str, str], from_ns: int, to_ns: int, limit: int) -> int:
    """The limit to use; InvalidRequest for what a request may not ask."""
    if len(text.encode()) > MAX_TEXT_BYTES:
        raise InvalidRequest(f"the text has more than {MAX_TEXT_BYTES} bytes")
    if not 0 <= limit <= MAX_LIMIT:
        raise InvalidRequest(f"the limit is not within 0 and {MAX_LIMIT}")
    if from_ns < 0 or to_ns < 0 or (from_ns and to_ns and from_ns >= to_ns):
        raise InvalidRequest("0 <= from < to is required")
    if any(not k for k in tags):
        raise InvalidRequest("a tag key is empty")
    return limit or DEFAULT_LIMIT


def hits(lines: DataFrame, text: str, tags: dict[str, str], from_ns: int = 0, to_ns: int = 0) -> DataFrame:
    """Matching lines of a stored or tokenised DataFrame; a bound of 0 is open."""
    cond = matches(F.col("message"), F.col("tags"), text, tags, F.col("terms") if "terms" in lines.columns else None)
    if from_ns:
        cond = (F.col("ts_ns") >= from_ns) & cond
    if to_ns:
        cond = (F.col("ts_ns") < to_ns) & cond
    return lines.where(cond)


def top(found: DataFrame, limit: int, newest_first: bool = False, ties: tuple[str, ...] = ("arrival_seq",)) -> DataFrame:
    """First or last by time in a total order."""
    order = [F.col(c).desc() if newest_first else F.col(c).asc() for c in ("ts_ns", *ties)]
    return found.orderBy(*order).limit(limit)


class Filters:
    """Which segments may have all of some terms. Filters never change, so those read stay on the driver up to a number of bytes."""

    def __init__(self, spark: SparkSession, root: str, most: int = FILTER_CACHE_BYTES):
        self.spark, self.root, self.most, self.held, self.size = spark, root, most, {}, 0

    def _table(self, segments: list[Segment]) -> DataFrame:
        tables = sorted({s.filters for s in segments})
        df = self.spark.read.schema("segment_id string, bloom binary").parquet(*(f"{self.root}/{t}" for t in tables))
        ids = [s.id for s in segments]
        if len(ids) <= 1000:
            return df.where(F.col("segment_id").isin(ids))
        return df.join(self.spark.createDataFrame([(i,) for i in ids], "segment_id string"), "segment_id", "left_semi")

    def survivors(self, segments: list[Segment], terms: list[str]) -> set[str]:
        """The ids of segments that no filter excludes."""
        if not terms:
            return {s.id for s in segments}
        new = [s for s in segments if s.filters and s.id not in self.held]
        if sum(s.filter_bytes for s in new) > self.most:  # too many for the driver: tested where they lie
            def test(batches):
                for rows in batches:
                    yield rows[[bloom.may_contain_all(b, terms) for b in rows["bloom"]]][["segment_id"]]

            there = {r.segment_id for r in self._table(new).mapInPandas(test, "segment_id string").collect()}
            far = {s.id for s in new}
            return {s.id for s in segments if (s.id in there if s.id in far else bloom.may_contain_all(self.held.get(s.id), terms))}
        if new:
            self.size += sum(s.filter_bytes for s in new)
            if self.size > self.most:
                self.held, self.size = {}, sum(s.filter_bytes for s in segments if s.filters)
                new = [s for s in segments if s.filters]
            rows: pd.DataFrame = self._table(new).toPandas()
            self.held |= dict(zip(rows["segment_id"], map(bytes, rows["bloom"]), strict=True))
        return {s.id for s in segments if bloom.may_contain_all(self.held.get(s.id), terms)}


class Searcher:
    def __init__(self, spark: SparkSession, manifest: Manifest, timeout_s: float = SEARCH_TIMEOUT_S):
        self.spark, self.manifest, self.slots, self.timeout = spark, manifest, threading.BoundedSemaphore(MAX_SEARCHES), timeout_s
        self.filters = Filters(spark, manifest.files.root)

    def search(self, text: str = "", tags: dict[str, str] | None = None, from_ns: int = 0, to_ns: int = 0, limit: int = 0, newest_first: bool = False) -> Result:
        tags = tags or {}
        limit = checked(text, tags, from_ns, to_ns, limit)
        if not self.slots.acquire(blocking=False):
            raise Busy(f"{MAX_SEARCHES} searches are running")
        tag, late = f"search-{uuid.uuid4().hex}", threading.Event()
        sc = self.spark.sparkContext

        def stop():
            late.set()
            sc.cancelJobsWithTag(tag)

        timer = threading.Timer(self.timeout, stop)
        sc.addJobTag(tag)
        timer.start()
        try:
            for attempt in range(SEARCH_ATTEMPTS):
                try:
                    r = self._once(text, tags, from_ns, to_ns, limit, newest_first, late)
                    r.retries = attempt
                    return r
                except SegmentMissing:
                    if attempt == SEARCH_ATTEMPTS - 1:
                        raise
                except Exception as e:
                    if late.is_set():
                        raise SearchTimeout(f"the search took more than {self.timeout} s") from e
                    raise
            raise AssertionError
        finally:
            timer.cancel()
            sc.removeJobTag(tag)
            self.slots.release()

    def _once(self, text, tags, from_ns, to_ns, limit, newest_first, late) -> Result:
        plan = self.manifest.plan(from_ns or FLOOR, to_ns or CEIL)
        near = [s for s, is_near in plan if is_near]
        terms = query_terms(text, tags)
        files = self.manifest.files
        empty = axis([(s.min_ts, s.max_ts) for s in near], from_ns or FLOOR, to_ns or CEIL)
        todo: list[Segment] = []
        try:
            may = self.filters.survivors(near, terms)
            out = [Outcome(s, TIME if not is_near else SCANNED if s.id in may else BLOOM) for s, is_near in plan]
            todo = [o.segment for o in out if o.outcome == SCANNED]
            if not todo or empty is None:
                return Result([], False, empty, out)
            found = hits(seg.read(self.spark, files, [s.storage_key for s in todo]), text, tags, from_ns, to_ns)
            filled = counted(found.select("ts_ns"), empty)
            if late.is_set():
                raise SearchTimeout
            rows = []
            if filled.total:
                lo, hi = filled.reach(limit + 1, newest_first)
                part = found if newest_first or hi > CEIL else found.where(F.col("ts_ns") < hi)
                part = part.where(F.col("ts_ns") >= lo) if newest_first and lo > FLOOR else part
                order = self.spark.createDataFrame([(s.id, s.min_ts) for s in todo], "segment_id string, seg_min_ts long")
                placed = part.select("ts_ns", "message", "tags", "segment_id", "line_no").join(F.broadcast(order) if len(todo) <= 100_000 else order, "segment_id")
                rows = top(placed, limit + 1, newest_first, ("seg_min_ts", "segment_id", "line_no")).collect()
        except Exception as e:
            if late.is_set():
                raise
            gone = [s.id for s in todo or near if not files.exists(s.storage_key)]
            if gone:
                raise SegmentMissing(", ".join(gone)) from e
            if any(w in str(e) for w in DAMAGED):
                raise Corrupt(str(e)[:300]) from e
            raise
        own = [{"ts_ns": r.ts_ns, "message": r.message, "tags": dict(r.tags or {}), "segment_id": r.segment_id} for r in rows[:limit]]
        by = Counter(h["segment_id"] for h in own)
        for o in out:
            o.hits = by.get(o.segment.id, 0)
        return Result(own, len(rows) > limit, filled, out)


#: What a reader says of damaged files.
DAMAGED = ("is not a Parquet file", "CANNOT_READ_FILE", "could not read page", "FAILED_READ_FILE", "Checksum", "checksum", "ParquetDecodingException", "CANNOT_READ_FOOTER")
