"""The facade: ingest, search, statistics, compaction and live tail over one store."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import segments as seg
from .operators.compaction import Compactor
from .operators.manifest import Manifest, Segment
from .operators.search import Result, Searcher
from .schema import MAX_BATCH, MAX_VIEWS, STAGED, SYSTEM_SEGMENTS, Busy, BufferFull, Closed, InvalidEntry, Settings
from .sources.logs import entry_size, validated
from .streaming.ingest import Events, Rate, Tail, segments_sink


class Engine:
    def __init__(self, spark: SparkSession, root: str, settings: Settings | None = None):
        self.spark, self.settings = spark, settings or Settings()
        self.manifest = Manifest(spark, root)
        self.identity = self.manifest.identity(self.settings.adopt)
        self.searcher = Searcher(spark, self.manifest)
        self.compactor = Compactor(spark, self.manifest, self.settings)
        self.events, self.rate, self.pending, self.ingested = Events(), Rate(), [], 0
        self.views, self.closed = [], False

    def ingest(self, lines: DataFrame, source: str | None = None, max_entries: int | None = None) -> list[Segment]:
        """Write lines (ts_ns, message, tags and, if equal times matter, arrival_seq) as segments of about buffer_bytes each.

        The input is evaluated once, into a staged table; its size, order and ranges are taken from there. Files first, then one
        commit: a failure in between leaves only files that nothing lists, which collect() removes. max_entries bounds a batch
        of a client (MAX_BATCH); a load has no bound. source is of the form stream#batch: a batch that its stream has committed
        already, or one before it, is not added again."""
        if self.closed:
            raise Closed("the engine is closed")
        if "arrival_seq" not in lines.columns:
            lines = lines.withColumn("arrival_seq", F.monotonically_increasing_id())
        files, stage = self.manifest.files, f"staged/{seg.new_id()}"
        try:
            lines.select("ts_ns", "message", "tags", F.col("arrival_seq").cast("long")).write.parquet(f"{files.root}/{stage}")
            staged = self.spark.read.schema(STAGED).parquet(f"{files.root}/{stage}")
            staged = validated(staged, time.time_ns(), max_entries or 1 << 62)
            total = staged.agg(F.sum(entry_size(F.col("message"), F.col("tags")).cast("long"))).first()[0]
            if not total:
                return []
            made, tags = seg.write(self.spark, files, staged, max(1, -(-total // max(self.settings.buffer_bytes, 1))))
        finally:
            files.delete(stage)
        stream, _, batch = (source or "").rpartition("#")

        def change(s):
            from .operators.manifest import add_tags

            if stream and int(s.meta.get(f"stream {stream}", -1)) >= int(batch):
                return
            for x in made:
                s.segments[x.id] = x
            add_tags(s.tags, tags)
            if stream:
                s.meta[f"stream {stream}"] = batch

        there = self.manifest.commit(change).segments
        made = [x for x in made if x.id in there]
        for x in made:
            self.ingested += x.entry_count
            self.events.add("Sealed", segment=x.id, lines=x.entry_count, bytes=x.size_bytes)
        self.rate.add(time.monotonic(), self.ingested)
        return made

    def add_batch(self, entries: list[tuple[int, str, dict[str, str]]]) -> None:
        """A small batch into the buffer: all or nothing; sealed by flush(), or here once it is large enough."""
        if self.closed:
            raise Closed("the engine is closed")
        if len(entries) > MAX_BATCH:
            raise InvalidEntry(f"a batch has at most {MAX_BATCH} entries")
        if any(not k or "=" in k for _, _, tags in entries for k in tags or {}):
            raise InvalidEntry("a tag key is empty or has '='")
        size = lambda e: 8 + len(e[1].encode()) + sum(len(k.encode()) + len(v.encode()) for k, v in (e[2] or {}).items())
        if sum(map(size, self.pending)) >= self.settings.pending_factor * self.settings.buffer_bytes:
            raise BufferFull("flush first")
        now = time.time_ns()
        self.pending += [(t or now, m, dict(tags or {})) for t, m, tags in entries]
        if sum(map(size, self.pending)) >= self.settings.buffer_bytes:
            self.flush()

    def flush(self) -> list[Segment]:
        """Seal what is buffered; on failure it stays buffered, before whatever came meanwhile."""
        if not self.pending:
            return []
        taken = list(self.pending)
        made = self.ingest(self.spark.createDataFrame([(t, m, tags, i) for i, (t, m, tags) in enumerate(taken)], STAGED))
        self.pending = self.pending[len(taken) :]
        return made

    def close(self) -> list[Segment]:
        """Seal what is buffered and take no more."""
        made = self.flush()
        self.closed = True
        return made

    def ingest_stream(self, stream: DataFrame, checkpoint: str, available_now: bool = False):
        return segments_sink(self, stream, checkpoint, self.settings, available_now)

    def search(self, text: str = "", tags: dict[str, str] | None = None, from_ns: int = 0, to_ns: int = 0, limit: int = 0, newest_first: bool = False) -> Result:
        return self.searcher.search(text, tags, from_ns, to_ns, limit, newest_first)

    def lines(self) -> DataFrame:
        """All stored lines, for any DataFrame operation."""
        return seg.read(self.spark, self.manifest.files, [s.storage_key for s in self.manifest.snapshot().ordered()])

    def stats(self) -> dict[str, int]:
        return self.manifest.stats()

    def tags(self) -> dict[str, dict]:
        return self.manifest.snapshot().tags

    def overview(self) -> dict:
        """What a start page shows; the examples are searches that find something."""
        tags = self.tags()
        examples = [f"{k}={v}" for k, own in sorted(tags.items()) for v in own["values"][:1]][:4]
        return {"corpus": self.stats(), "tags": tags, "rate": self.rate.value(), "examples": examples}

    def amplification(self, dataset_bytes: int) -> float:
        """Stored bytes for each byte of what was ingested."""
        return self.stats()["bytes"] / dataset_bytes if dataset_bytes else 0.0

    def system(self, events_after: int = 0) -> dict:
        own = self.manifest.snapshot().ordered()
        return {"segments": own[-SYSTEM_SEGMENTS:], "omitted": max(0, len(own) - SYSTEM_SEGMENTS), "events": self.events.since(events_after), "rate": self.rate.value(), "buffered": len(self.pending)}

    def tail(self, text: str = "", tags: dict[str, str] | None = None, after_ns: int | None = None) -> Tail:
        """A view of new lines; at most MAX_VIEWS that are still open."""
        self.views = [v for v in self.views if v.open()]
        if len(self.views) >= MAX_VIEWS:
            raise Busy(f"{MAX_VIEWS} views are open")
        self.views.append(Tail(self, text, tags, after_ns))
        return self.views[-1]

    def compact(self) -> Segment | None:
        new = self.compactor.once()
        if new:
            self.events.add("Merged", segment=new.id, lines=new.entry_count, bytes=new.size_bytes)
        return new

    def collect(self, now_ns: int | None = None):
        out = self.compactor.collect(now_ns)
        if out.replaced or out.orphans:
            self.events.add("Cleaned", lines=None, bytes=None)
        return out


def distinct_lines(lines: DataFrame) -> DataFrame:
    """One of each line by content, the earliest arrival."""
    from .sources.logs import line_key

    w = Window.partitionBy("_k").orderBy("arrival_seq")
    return lines.withColumn("_k", line_key(F.col("ts_ns"), F.col("message"), F.col("tags"))).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_k", "_r")
