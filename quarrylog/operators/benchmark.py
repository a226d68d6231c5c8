"""Measured search cases over a store: rare, common and absent words, tags, windows, and a full scan."""

from __future__ import annotations

import math
import time
from dataclasses import dataclass, field

from pyspark.sql import functions as F

HOUR, DAY = 3_600_000_000_000, 86_400_000_000_000


def nearest_rank(values: list[float], p: float) -> float:
    """The least value with at least p percent of all at or below it; 0 for none."""
    return sorted(values)[max(0, math.ceil(p / 100 * len(values)) - 1)] if values else 0


@dataclass
class Case:
    name: str
    text: str = ""
    tags: dict[str, str] = field(default_factory=dict)
    window: int = 0  # nanoseconds; 0 is all history
    runs: int = 100


def cases(engine, tag: tuple[str, str], alert: tuple[str, str]) -> list[Case]:
    """Seven cases whose words come from the store's own document frequencies."""
    terms = engine.lines().select(F.explode("terms").alias("t")).where("NOT startswith(t, 'tag:')").groupBy("t").agg(F.count("*").alias("n"))
    common = terms.orderBy(F.desc("n"), "t").first()
    rare = terms.where("n >= 2").orderBy("n", "t").limit(2).collect()
    words = [r.t for r in rare] + [common.t if common else ""] * 2
    return [
        Case("rare word, all history", words[0]), Case("rarer word, all history", words[1]), Case("common word, 1-hour window", words[-1], window=HOUR), Case("tag, 1-day window", tags=dict([tag]), window=DAY),
        Case("alert tag, all history", tags=dict([alert])), Case("word not in the data", "nosuchwordanywhere"), Case("common word, all history", words[-1], runs=10),
    ]


def run(engine, case: Case, warm_up: int = 2) -> dict:
    """Latency percentiles in ms, and means of what was scanned, read and returned. Windows move over the stored range."""
    s, took, scanned, read, found = engine.stats(), [], [], [], []
    for i in range(warm_up + case.runs):
        start = max(1, s["min_ts"] + (s["max_ts"] - s["min_ts"]) * i // (warm_up + case.runs)) if case.window else 0
        t = time.perf_counter()
        r = engine.search(case.text, case.tags, start, start + case.window if case.window else 0, 100)
        if i >= warm_up:
            took.append((time.perf_counter() - t) * 1000)
            scanned.append(r.metrics["scanned"])
            read.append(r.metrics["bytes_read"])
            found.append(len(r.hits))
    mean = lambda v: sum(v) / len(v) if v else 0
    return {"case": case.name, "p50": nearest_rank(took, 50), "p99": nearest_rank(took, 99), "max": max(took, default=0), "scanned": mean(scanned), "considered": s["segments"], "bytes_read": mean(read), "hits": mean(found)}


def settle(engine, most: int = 1000) -> int:
    """Compact until there is nothing to do; how many merges that took."""
    n = 0
    while n < most and engine.compact():
        n += 1
    return n


def sampled_lines_found(engine, lines, n: int = 300, seed: int = 42) -> tuple[int, int]:
    """Of n sampled lines (ts_ns, message), how many a search over their own nanosecond gives back."""
    some = lines.orderBy(F.md5(F.concat(F.col("ts_ns").cast("string"), F.lit(f"-{seed}"), F.col("message"))), "ts_ns").limit(n).collect()
    ok = sum(any(h["message"] == r.message for h in engine.search(r.message[:500], {}, r.ts_ns, r.ts_ns + 1, 1000).hits) for r in some)
    return ok, len(some)
