"""Immutable, time-sorted Parquet segments, each with a filter over its terms in a table beside it.

Damage shows three ways: Parquet's page checksums are verified on every read, a segment's files must have the bytes that
its row says, and verify() holds their CRC-32 and the count of their lines against it."""

from __future__ import annotations

import contextlib
import re
import secrets
import threading
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bloom
from ..functions.text import line_terms
from ..schema import MAX_SEGMENT_PAIRS, MAX_TAG_KEYS, MAX_TAG_VALUES, STORED, Corrupt
from .manifest import Files, Segment

#: A segment's distinct terms beyond this number aren't gathered for its filter, which then excludes nothing.
MAX_BLOOM_TERMS = 2_000_000
#: Lines that one task sorts and one file holds, or so.
TASK_LINES = 500_000
#: Hashes of terms that a task holds for a segment, and that one row has.
PART_HASHES, ROW_HASHES = 1 << 18, 512
#: Tasks that list the folders of many segments.
LISTERS = 32
SUMMARY = "segment_id string, n long, lo long, hi long, hashes binary, key string, value string"
FILTER = "segment_id string, bloom binary"


def new_id(now_ns: int | None = None) -> str:
    return f"{now_ns if now_ns is not None else time.time_ns():016x}-{secrets.token_hex(4)}"


def created_at(key: str) -> int | None:
    """The time in a segment's name; None for foreign names."""
    m = re.fullmatch(r"(?:segments/)?id=([0-9a-f]{16})-[0-9a-f]{8}", key)
    return int(m[1], 16) if m else None


def key_of(segment_id: str) -> str:
    return f"segments/id={segment_id}"


def write(spark: SparkSession, files: Files, lines: DataFrame, n: int = 1, now_ns: int | None = None, generation: int = 0, group: str | None = None) -> tuple[list[Segment], list[tuple[str, str]]]:
    """Write ts_ns, message, tags, arrival_seq as about n segments: their rows for the manifest, and their tag pairs.

    Lines are dealt out by arrival, or by group. A task sorts TASK_LINES lines or so at most: a larger segment has several files,
    each of a range of time. Counts, filters and tags are then taken from what was written, in one scan."""
    first = new_id(now_ns)
    at, tail = int(first[:16], 16), first[16:]
    columns = ["ts_ns", "message", "tags", "arrival_seq"]
    own = F.concat(F.lower(F.lpad(F.hex(F.lit(at) + F.col("_g")), 16, "0")), F.lit(tail))
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # in a task's sort
    if n > 1 and not group:
        sizes = dict.fromkeys(range(n), 0)
        dealt = lines.select(*columns).repartitionByRange(n, "arrival_seq").withColumn("_g", F.spark_partition_id().cast("long")).withColumn("id", own)
        _save(files, dealt.sortWithinPartitions("id", "ts_ns", "arrival_seq").withColumn("line_no", place))
    else:  # a segment for each value (a number from 0 on) of a column that the caller deals lines by, or one of all
        dealt = lines.select(*columns, (F.col(group) if group else F.lit(0)).cast("long").alias("_g")).withColumn("id", own)
        sizes = {r["_g"]: r["count"] for r in dealt.groupBy("_g").count().collect()}
        large = {g: k for g, k in sizes.items() if k > TASK_LINES}
        if len(sizes) > len(large):
            small = dealt.where(~F.col("_g").isin(list(large))) if large else dealt
            parts = -(-sum(k for g, k in sizes.items() if g not in large) // TASK_LINES)
            small = small.repartition(parts, "id") if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else small.repartition("id")
            no = F.row_number().over(Window.partitionBy("id").orderBy("ts_ns", "arrival_seq")) - 1
            _save(files, small.sortWithinPartitions("id", "ts_ns", "arrival_seq").withColumn("line_no", no), bool(group))
        if large:
            cell, starts = _cells(dealt.where(F.col("_g").isin(list(large))), large)
            parted = dealt.where(F.col("_g").isin(list(large))).withColumn("_c", cell).repartitionById(len(starts), "_c")
            start = F.element_at(F.array(*(F.lit(k).cast("long") for k in starts)), F.col("_c") + 1)
            _save(files, parted.sortWithinPartitions("id", "ts_ns", "arrival_seq").withColumn("line_no", start + place))
    ids = [i for i in (f"{at + g:016x}{tail}" for g in sorted(sizes)) if group or files.exists(key_of(i))]
    if not ids:
        return [], []
    keys = [key_of(i) for i in ids]
    there, stage, table = contents(spark, files, keys), f"staged/{new_id()}", f"filters/{first}"
    try:
        read(spark, files, keys).select("segment_id", "ts_ns", "terms", "tags").mapInArrow(_summaries, SUMMARY).write.parquet(f"{files.root}/{stage}")
        found = spark.read.schema(SUMMARY).parquet(f"{files.root}/{stage}")
        ends = {r.segment_id: r for r in found.where("n > 0").groupBy("segment_id").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()}
        # written where they are made; the driver learns their sizes
        hashes = found.where("hashes is not null").select("segment_id", "hashes").repartition("segment_id").sortWithinPartitions("segment_id")
        hashes.mapInArrow(_filters(MAX_BLOOM_TERMS), FILTER).write.mode("overwrite").parquet(f"{files.root}/{table}")
        # what the catalogue can hold, and one value more where a key has more
        rank = F.row_number().over(Window.partitionBy("key").orderBy("value"))
        pairs = _first_pairs(found.where("key is not null").select("segment_id", "key", "value")).select("key", "value").distinct().withColumn("r", rank).where(F.col("r") <= MAX_TAG_VALUES + 1)
        tags = [(r.key, r.value) for r in pairs.join(pairs.select("key").distinct().orderBy("key").limit(MAX_TAG_KEYS), "key").select("key", "value").collect()]
    finally:
        files.delete(stage)
    made = {r.segment_id: r.n for r in spark.read.schema(FILTER).parquet(f"{files.root}/{table}").select("segment_id", F.length("bloom").alias("n")).collect()}
    rows = [Segment(i, key_of(i), ends[i].lo, ends[i].hi, ends[i].n, there[i][1], int(i[:16], 16), generation, "active", table if i in made else None, made.get(i, 0), there[i][0]) for i in ids if i in ends]
    return rows, sorted(tags)


def _save(files: Files, dealt: DataFrame, many: bool = False) -> None:
    """Files of lines that have an id and a line_no. A task's files get their place when it ends: what counts is the manifest,
    and a job that fails leaves only files that nothing lists. Many small ones in a local folder go without Hadoop's .crc files,
    as it starts four processes (chmod) for each file with one; pages and segments have checksums of their own."""
    raw = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"} if many and files.root.startswith(("file:", "/")) else {}
    dealt = dealt.withColumn("terms", line_terms(F.col("message"), F.col("tags")))
    out = dealt.select("ts_ns", "message", "tags", "terms", "arrival_seq", F.col("line_no").cast("int").alias("line_no"), F.col("id").alias("segment_id"), "id")
    out.write.mode("append").options(**raw).option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("id").parquet(f"{files.root}/segments")


def _cells(lines: DataFrame, sizes: dict[int, int]) -> tuple[Column, list[int]]:
    """The number of a line's cell, and the number within its group of each cell's first line.

    Cells are ranges of group, time and arrival of TASK_LINES lines or so, cut at lines that are picked by hash."""
    picked = lines.where(F.pmod(F.xxhash64("ts_ns", "arrival_seq"), F.lit(max(1, TASK_LINES // 64))) == 0).select("_g", "ts_ns", "arrival_seq").collect()
    by: dict[int, list[tuple[int, int]]] = {g: [] for g in sizes}
    for r in picked:
        by[r["_g"]].append((r.ts_ns, r.arrival_seq))
    cuts: list[tuple] = []
    for i, g in enumerate(sorted(sizes)):
        own, parts = sorted(by[g]), -(-sizes[g] // TASK_LINES)
        cuts += [(g, None, None)] * (i > 0) + [(g, *x) for x in sorted({own[len(own) * k // parts] for k in range(1, parts)} if own else ())]

    def number(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        g, ts, seq = cuts[mid]
        before = F.col("_g") < g
        if ts is not None:
            before = before | ((F.col("_g") == g) & ((F.col("ts_ns") < ts) | ((F.col("ts_ns") == ts) & (F.col("arrival_seq") < seq))))
        return F.when(before, number(lo, mid)).otherwise(number(mid + 1, hi))

    cell = number(0, len(cuts))
    n = {r["_c"]: r["count"] for r in lines.groupBy(cell.alias("_c")).count().collect()}
    starts, at = [], 0
    for c in range(len(cuts) + 1):
        at = 0 if c and cuts[c - 1][1] is None else at
        starts.append(at)
        at += n.get(c, 0)
    return cell, starts


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of stored lines, file by file: the count, range of time and distinct hashes of terms of (a part of) each segment, in rows of
    ROW_HASHES hashes at most, and the distinct tag pairs of each batch."""
    schema = pa.schema([("segment_id", pa.string()), ("n", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("hashes", pa.binary()), ("key", pa.string()), ("value", pa.string())])
    own, rows = None, []  # own: id, n, lo, hi, arrays of hashes, how many in all

    def close() -> None:
        if own:
            all_ = np.unique(np.concatenate(own[4])) if own[4] else np.zeros(0, np.uint64)
            cut = [all_[k : k + ROW_HASHES].tobytes() for k in range(0, len(all_), ROW_HASHES)] or [None]
            rows.extend((own[0], *(own[1:4] if not k else (0, None, None)), h, None, None) for k, h in enumerate(cut))

    def taken() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        rows.clear()
        return out

    for batch in batches:
        if not len(batch):
            continue
        ids, ts, terms = batch["segment_id"], batch["ts_ns"].to_numpy(zero_copy_only=False), batch["terms"]
        ends = np.cumsum(pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False))
        coded = terms.flatten().dictionary_encode()
        at = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        hashes = bloom.term_hashes(coded.dictionary)
        runs = pc.run_end_encode(ids)
        lo = 0
        for i, hi in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
            if own and (own[0] != i or own[5] > PART_HASHES):
                close()
                own = None
            own = own or [i, 0, None, None, [], 0]
            here = np.unique(at[(ends[lo - 1] if lo else 0) : ends[hi - 1]])
            here, t = hashes[here[here >= 0]], ts[lo:hi]
            own[1:4] = own[1] + hi - lo, int(min(t.min(), t.min() if own[2] is None else own[2])), int(max(t.max(), t.max() if own[3] is None else own[3]))
            own[4].append(here)
            own[5] += len(here)
            lo = hi
            if len(rows) >= 1000:
                yield taken()
        tags = batch["tags"]
        at = tags.offsets.to_numpy()
        of = pa.array(np.repeat(np.arange(len(tags)), np.diff(at)))
        pairs = pa.table({"segment_id": ids.take(of), "key": tags.keys[at[0] : at[-1]], "value": tags.items[at[0] : at[-1]]}).group_by(["segment_id", "key", "value"]).aggregate([])
        for some in pairs.to_batches():
            no = len(some)
            if no:
                yield pa.RecordBatch.from_arrays([some["segment_id"], *(pa.nulls(no, schema.field(k).type) for k in range(1, 5)), some["key"], some["value"]], schema=schema)
    close()
    if rows:
        yield taken()


def _filters(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows of hashes in order of their segments to a filter of each; an empty one beyond so many terms."""

    def build(batches):
        own, held, n, rows, size = None, [], 0, [], 0

        def fold() -> None:
            nonlocal held, n
            held = [np.unique(np.concatenate(held))]
            n = len(held[0])

        def close() -> None:
            nonlocal size
            if n >= 0:
                fold()
            rows.append((own, bloom.build_hashed(held[0]) if 0 <= n <= most else b""))
            size += len(rows[-1][1]) + 64

        def taken() -> pa.RecordBatch:
            nonlocal size
            out = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["segment_id", "bloom"])
            rows.clear()
            size = 0
            return out

        for batch in batches:
            for i, h in zip(batch["segment_id"].to_pylist(), batch["hashes"], strict=True):
                if i != own:
                    if own is not None:
                        close()
                    own, held, n = i, [], 0
                    if size > 4 << 20:
                        yield taken()
                if n >= 0:  # -1: too many
                    held.append(np.frombuffer(h.as_buffer(), np.uint64))
                    n += len(held[-1])
                    if n > 2 * most:
                        fold()
                        if n > most:
                            held, n = [], -1
        if own is not None:
            close()
        if rows:
            yield taken()

    return build


_listing, _listers = threading.Lock(), {"n": 0, "was": None}
_PARALLEL = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextlib.contextmanager
def listed(spark: SparkSession, n: int):
    """While it lasts, folders are listed by LISTERS tasks, not by one for each folder."""
    if n <= LISTERS:
        yield
        return
    with _listing:
        _listers["n"] += 1
        if _listers["n"] == 1:
            _listers["was"] = spark.conf.get(_PARALLEL)
            spark.conf.set(_PARALLEL, str(LISTERS))
    try:
        yield
    finally:
        with _listing:
            _listers["n"] -= 1
            if not _listers["n"]:
                spark.conf.set(_PARALLEL, _listers["was"])


def contents(spark: SparkSession, files: Files, keys: list[str]) -> dict[str, tuple[int, int]]:
    """The sum of the CRC-32 of each segment's files, and their bytes, by id; a file is read whole by one task."""
    with listed(spark, len(keys)):
        found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load([f"{files.root}/{k}" for k in keys])
    of = F.regexp_extract("path", r"/id=([^/]+)/[^/]*$", 1)
    return {r.id: (r.sum, r.size) for r in found.groupBy(of.alias("id")).agg(F.sum(F.crc32("content")).alias("sum"), F.sum("length").alias("size")).collect()}


def checksums(spark: SparkSession, files: Files, keys: list[str]) -> dict[str, int]:
    return {i: k for i, (k, _) in contents(spark, files, keys).items()}


def segment_pairs(lines: DataFrame, most: int = MAX_SEGMENT_PAIRS) -> DataFrame:
    """segment_id, key, value: the first distinct tag pairs of each segment, by key and value. Counted before they are ranked,
    so a segment's common pairs are one row each."""
    return _first_pairs(lines.select("segment_id", F.explode("tags")), most)


def _first_pairs(pairs: DataFrame, most: int = MAX_SEGMENT_PAIRS) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("segment_id").orderBy("key", "value"))
    return pairs.distinct().withColumn("_r", rank).where(F.col("_r") <= most).drop("_r")


def read(spark: SparkSession, files: Files, keys: list[str]) -> DataFrame:
    if not keys:
        return spark.createDataFrame([], STORED)
    with listed(spark, len(keys)):
        return spark.read.schema(STORED).option("ignoreCorruptFiles", "false").option("ignoreMissingFiles", "false").option("parquet.page.verify-checksum.enabled", "true").parquet(*(f"{files.root}/{k}" for k in keys))


def verify(spark: SparkSession, files: Files, s: Segment) -> None:
    """Read a segment back and hold its bytes, lines and checksum against its row."""
    if not files.exists(s.storage_key) or files.size(s.storage_key) != s.size_bytes:
        raise Corrupt(f"{s.id} doesn't have the bytes that its row says")
    try:
        sums, n = checksums(spark, files, [s.storage_key]), read(spark, files, [s.storage_key]).count()
    except Exception as e:
        raise Corrupt(f"{s.id} can't be read") from e
    if n != s.entry_count or (s.checksum is not None and sums != {s.id: s.checksum}):
        raise Corrupt(f"{s.id} is not what its row says")


def inverted_index(lines: DataFrame) -> DataFrame:
    """(term, segment_id, line_no) of lines with terms: the postings, each once."""
    return lines.select(F.explode(F.array_distinct("terms")).alias("term"), "segment_id", "line_no")


def entry(spark: SparkSession, files: Files, s: Segment, line_no: int) -> dict | None:
    """One line by its number; sorted files let statistics skip the rest."""
    r = read(spark, files, [s.storage_key]).where(F.col("line_no") == line_no).select("ts_ns", "message", "tags").first()
    return None if r is None else {"ts_ns": r.ts_ns, "message": r.message, "tags": dict(r.tags or {})}
