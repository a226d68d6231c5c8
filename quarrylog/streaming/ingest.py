"""Streams in and out: micro-batches become segments, new lines are followed once each."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schema import EVENT_RING, InvalidRequest, LogError, Settings
from ..sources.logs import line_key


def segments_sink(engine, stream: DataFrame, checkpoint: str, settings: Settings | None = None, available_now: bool = False) -> StreamingQuery:
    """Seal every micro-batch as segments. The trigger is the age bound; a batch over the size bound is split by running size.

    A batch is retried from its checkpoint if sealing fails. The manifest holds the last batch of each stream, by the id that
    the checkpoint gave the query, so a restart between commit and checkpoint adds nothing twice, and a stream whose
    checkpoint was deleted is another one, wherever it writes."""
    s = settings or engine.settings
    own: list[str] = []

    def seal(batch: DataFrame, batch_id: int) -> None:
        if not own:
            own.append(query_id(engine.spark, checkpoint))
        if int(engine.manifest.snapshot().meta.get(f"stream {own[0]}", -1)) < batch_id:
            engine.ingest(batch, source=f"{own[0]}#{batch_id}")

    w = stream.writeStream.foreachBatch(seal).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime=f"{s.buffer_age_s} seconds")).start()


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of the query that a checkpoint belongs to."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}/metadata")
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        return json.loads(bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())["id"]
    finally:
        stream.close()


def tail_stream(lines: DataFrame, overlap: str = "15 seconds") -> DataFrame:
    """A stream of lines with each line once: by content, within the overlap that late lines may have."""
    at = F.timestamp_micros(F.expr("ts_ns div 1000"))
    keyed = lines.withColumns({"at": at, "line_key": line_key(F.col("ts_ns"), F.col("message"), F.col("tags"))})
    return keyed.withWatermark("at", overlap).dropDuplicatesWithinWatermark(["line_key"])


class Tail:
    """Follow stored lines: each tick searches newest first from the overlap before the cursor and gives what wasn't given yet."""

    def __init__(self, engine, text: str = "", tags: dict[str, str] | None = None, after_ns: int | None = None, overlap_ns: int = 15_000_000_000, limit: int = 1000, lifetime_s: float = 900.0):
        self.engine, self.text, self.tags, self.overlap, self.limit = engine, text, tags or {}, overlap_ns, limit
        stats = engine.stats()
        self.resumed = after_ns is not None
        self.after = after_ns if after_ns is not None else stats["max_ts"]
        self.cursor, self.seen, self.first = self.after, {}, True
        self.ends, self.closed = time.monotonic() + lifetime_s, False

    def open(self) -> bool:
        return not self.closed and time.monotonic() <= self.ends

    def close(self) -> None:
        self.closed = True

    def records(self, wait_s: float = 2.0, most: int | None = None):
        """What a view sends: a tick with new lines, whether there may be a gap and the corpus; a problem where a search failed,
        which is tried again unless the request itself is wrong; and at last the end with the cursor to go on from."""
        n = 0
        while self.open() and (most is None or n < most):
            if n:
                time.sleep(wait_s)
            n += 1
            try:
                lines, gap = self.tick()
                yield {"event": "tick", "lines": lines, "gap": gap, "cursor": self.cursor, "corpus": self.engine.stats()}
            except InvalidRequest as e:
                yield {"event": "problem", "message": str(e), "retry": False}
                break
            except LogError as e:
                if not self.open():
                    break
                yield {"event": "problem", "message": str(e), "retry": True}
        self.close()
        yield {"event": "end", "cursor": self.cursor}

    @staticmethod
    def key(hit: dict) -> tuple:
        return hit["ts_ns"], hit["message"], tuple(sorted(hit["tags"].items()))

    def tick(self) -> tuple[list[dict], bool]:
        """New lines, newest first, and whether there may be a gap (more new lines than a tick can show)."""
        if not self.open():
            raise LogError("the view has ended; open another from its cursor")
        r = self.engine.search(self.text, self.tags, max(1, self.cursor - self.overlap), 0, self.limit, True)
        new = []
        for h in r.hits:
            k = self.key(h)
            if k not in self.seen:
                self.seen[k] = h["ts_ns"]
                # the first look only learns what is there, but for lines after the cursor that was asked for
                if not self.first or (self.resumed and h["ts_ns"] > self.after):
                    new.append(h)
        gap = r.truncated and bool(new) and r.hits[-1] is new[-1]
        if r.hits:
            self.cursor = max(self.cursor, r.hits[0]["ts_ns"])
        self.seen = {k: t for k, t in self.seen.items() if t >= self.cursor - self.overlap}
        self.first = False
        return new, gap


class Events:
    """The last things that happened: Sealed, Merged, Cleaned."""

    def __init__(self, most: int = EVENT_RING):
        self.most, self.rows, self.seq = most, [], 0

    def add(self, kind: str, **what) -> None:
        self.seq += 1
        self.rows = [*self.rows, {"seq": self.seq, "at": time.time(), "kind": kind, **what}][-self.most :]

    def since(self, seq: int) -> list[dict]:
        return [r for r in self.rows if r["seq"] > seq]

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(r["seq"], r["at"], r["kind"], r.get("segment"), r.get("lines"), r.get("bytes")) for r in self.rows]
        return spark.createDataFrame(rows, "seq long, at double, kind string, segment string, lines long, bytes long")


class Rate:
    """Lines per second over a sliding window: from the last sample at or before its start."""

    def __init__(self, window_s: float = 10.0):
        self.window, self.samples = window_s, []

    def add(self, at: float, total: int) -> None:
        self.samples.append((at, total))
        while len(self.samples) > 1 and self.samples[1][0] <= at - self.window:
            self.samples.pop(0)

    def stored(self, least_s: float = 10.0) -> float | None:
        """Lines stored a second; None until the samples span least_s, as sealing goes in steps."""
        if len(self.samples) < 2:
            return None
        (a, x), (b, y) = self.samples[0], self.samples[-1]
        return (y - x) / (b - a) if b - a >= least_s and y >= x else None

    def value(self) -> float:
        if len(self.samples) < 2:
            return 0.0
        (a, x), (b, y) = self.samples[0], self.samples[-1]
        return (y - x) / (b - a) if b > a else 0.0


def merged_view(shown: list[dict], new: list[dict], limit: int) -> list[dict]:
    """The lines of a view after a tick: new ones first, cut to the limit."""
    return [*new, *shown][:limit]
