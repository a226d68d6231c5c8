"""Readers that give (ts_ns, message, tags, arrival_seq), and adapters from relational tables to log lines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import InvalidEntry

EMPTY_TAGS = "map<string,string>"


def no_tags() -> Column:
    return F.create_map().cast(EMPTY_TAGS)


def plain_text(spark: SparkSession, path: str) -> DataFrame:
    """Each line a message; ts_ns 0 stands for the time of receipt."""
    return spark.read.text(path).select(F.lit(0).cast("long").alias("ts_ns"), F.col("value").alias("message"), no_tags().alias("tags"), F.monotonically_increasing_id().alias("arrival_seq"))


def bgl_columns(value: Column) -> dict[str, Column]:
    """Fields of a supercomputer log line: label epoch date node time node type component level message."""
    f = F.split(value, " ", 9)
    at = F.try_to_timestamp(F.element_at(f, 5), F.lit("yyyy-MM-dd-HH.mm.ss.SSSSSS"))
    whole = F.when(F.size(f) == 9, at)
    tags = F.map_from_entries(F.filter(F.array(F.struct(F.lit("component").alias("k"), F.element_at(f, 8).alias("v")), F.struct(F.lit("level").alias("k"), F.regexp_extract(F.element_at(f, 9), r"^(\S*)", 1).alias("v")), F.struct(F.lit("alert").alias("k"), F.when(F.element_at(f, 1) != "-", F.element_at(f, 1)).alias("v"))), lambda e: e["v"].isNotNull() & (e["v"] != "")))
    return {"ts_ns": F.unix_micros(whole) * 1000, "message": F.regexp_replace(value, r"^\S+ \S+ ", ""), "tags": tags}


def bgl(lines: DataFrame, col: str = "value") -> tuple[DataFrame, DataFrame]:
    """Parsed lines, and one row with how many were parsed and skipped."""
    # a blank or short line has no time; element_at past the end is an error under ANSI, so short lines are padded
    padded = F.concat(F.col(col), F.lit(" " * 9))
    ok = F.size(F.split(F.col(col), " ", 9)) == 9
    parsed = lines.select("*", *(c.alias(f"_{k}") for k, c in bgl_columns(padded).items())).withColumn("_ts_ns", F.when(ok, F.col("_ts_ns"))).withColumn("_message", F.rtrim("_message"))
    out = parsed.where("_ts_ns is not null").select(F.col("_ts_ns").alias("ts_ns"), F.col("_message").alias("message"), F.col("_tags").alias("tags"))
    counts = parsed.agg(F.count("_ts_ns").alias("lines"), (F.count("*") - F.count("_ts_ns")).alias("skipped"))
    return out, counts


def first_lines(lines: DataFrame, most: int, order: list[str] | None = None) -> DataFrame:
    """At most so many lines of a source, in its order if one is named."""
    return (lines.orderBy(*order) if order else lines).limit(most)


def raw_counts(lines: DataFrame, col: str = "value") -> DataFrame:
    """Lines and bytes of raw text, a line break for each line."""
    return lines.agg(F.count("*").alias("lines"), F.coalesce(F.sum(F.octet_length(F.coalesce(col, F.lit(""))).cast("long") + 1), F.lit(0)).alias("bytes"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as log lines; arrival_seq is event_id."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_ns"),
        F.concat(F.col("event_type"), F.lit(" user"), F.col("user_id").cast("string"), F.lit(" event"), F.col("event_id").cast("string")).alias("message"),
        F.create_map(F.lit("type"), F.col("event_type"), F.lit("k"), F.regexp_extract("props", r'"k": *([0-9]+)', 1)).alias("tags"),
        F.col("event_id").alias("arrival_seq"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select((F.col("doc_id") * 1_000_000_000).alias("ts_ns"), F.col("text").alias("message"), F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")).alias("tags"), F.col("doc_id").alias("arrival_seq"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    seq = F.col("conv_id") * 1000 + F.col("turn")
    return c.select((seq * 1_000_000_000).alias("ts_ns"), F.col("text").alias("message"), F.create_map(F.lit("role"), F.col("role")).alias("tags"), seq.alias("arrival_seq"))


def interleaved(lines: DataFrame) -> DataFrame:
    """segment_no of four interleaved ingest streams of 2,000 events each, which makes overlapping segments."""
    return lines.withColumn("segment_no", F.expr("arrival_seq div 2000") * 4 + F.col("arrival_seq") % 4)


def bad_tags(tags: Column) -> Column:
    """Whether a key is empty or has '='."""
    return F.coalesce(F.exists(F.map_keys(tags), lambda k: (k == "") | F.contains(k, F.lit("="))), F.lit(False))


def validated(batch: DataFrame, now_ns: int, max_entries: int) -> DataFrame:
    """A batch is accepted as a whole or not at all; ts_ns 0 becomes the time of receipt."""
    n, bad = batch.agg(F.count("*"), F.coalesce(F.sum(bad_tags(F.col("tags")).cast("int")), F.lit(0))).first()
    if n > max_entries:
        raise InvalidEntry(f"a batch has at most {max_entries} entries, not {n}")
    if bad:
        raise InvalidEntry("a tag key is empty or has '='")
    return batch.withColumn("ts_ns", F.when(F.coalesce("ts_ns", F.lit(0)) == 0, F.lit(now_ns)).otherwise(F.col("ts_ns")))


def entry_size(message: Column, tags: Column) -> Column:
    """Estimated bytes of an entry in the buffer."""
    own = F.aggregate(F.map_entries(tags), F.lit(0), lambda a, e: a + F.octet_length(e["key"]) + F.octet_length(e["value"]))
    return F.lit(8) + F.octet_length(message) + F.coalesce(own, F.lit(0))


def line_key(ts_ns: Column, message: Column, tags: Column) -> Column:
    """Identity of a line by content, whatever segment holds it."""
    return F.sha2(F.concat_ws("|", ts_ns.cast("string"), message, F.array_join(F.transform(F.array_sort(F.map_entries(tags)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")), 256)


TEMPLATES = (("INFO", "ciod: generated {n} core files for program {hex}", 36), ("INFO", "{n} ddr errors detected and corrected on rank 0 node {node}", 24), ("WARNING", "temperature {n} on {node} above limit", 20), ("ERROR", "request {hex} to {node} timed out after {n} ms", 14), ("FATAL", "machine check interrupt on {node} code {hex}", 6))


def generated(spark: SparkSession, n: int, run: str, sources: int = 1, start_ns: int = 1_700_000_000_000_000_000, rate: float = 1000.0, late_fraction: float = 0.0, late_max_s: float = 0.0, seed: int = 1, parts: int | None = None) -> DataFrame:
    """n marked lines of each source at an even rate: a template by cumulative weight, placeholders filled, the marker last.

    Every random choice is a hash of (seed, source, seq), so reruns and retries agree. A late line is moved back in time."""
    ids = spark.range(0, n * sources, 1, parts) if parts else spark.range(n * sources)
    lines = ids.select((F.col("id") % sources).alias("source"), F.expr(f"id div {sources}").alias("seq"))
    late = F.when(_draw(seed, 5, 1_000_000) < int(late_fraction * 1_000_000), _draw(seed, 6, max(1, int(late_max_s * 1e9)))).otherwise(F.lit(0))
    return _worded(lines, F.lit(start_ns) + (F.col("seq") * int(1e9 / rate)) - late, run, sources, seed)


def _draw(seed: int, k: int, m: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.col("source"), F.col("seq")), F.lit(m))


def _worded(lines: DataFrame, at: Column, run: str, sources: int, seed: int) -> DataFrame:
    """Lines with source and seq as log lines at the given times."""
    total, level, text = 0, None, None
    pick = _draw(seed, 0, sum(w for _, _, w in TEMPLATES))
    for lv, body, w in TEMPLATES:
        total += w
        level = (F.when if level is None else level.when)(pick < total, F.lit(lv))
        text = (F.when if text is None else text.when)(pick < total, F.lit(body))
    body = F.replace(F.replace(F.replace(text, F.lit("{n}"), _draw(seed, 1, 10_000).cast("string")), F.lit("{hex}"), F.lower(F.hex(_draw(seed, 2, 1 << 24)))), F.lit("{node}"), F.concat(F.lit("R"), F.lpad(_draw(seed, 3, 64).cast("string"), 2, "0"), F.lit("-M"), _draw(seed, 4, 2).cast("string")))
    mark = F.concat(F.lit(f" ~{run}."), F.col("source").cast("string"), F.lit("."), F.col("seq").cast("string"))
    return lines.select(at.alias("ts_ns"), F.concat(body, mark).alias("message"), F.create_map(F.lit("level"), level).alias("tags"), (F.col("seq") * sources + F.col("source")).alias("arrival_seq"))


def scheduled(elapsed_s: Column, rate: float, factor: float, every_s: float, for_s: float) -> Column:
    """Lines due after so many seconds: the steady rate, and bursts in the last for_s of every period."""
    if every_s <= 0:
        return F.floor(elapsed_s * rate)
    periods = F.floor(elapsed_s / every_s)
    inside = F.greatest(elapsed_s - periods * every_s - (every_s - for_s), F.lit(0.0))
    return F.floor(elapsed_s * rate + (periods * for_s + inside) * rate * (factor - 1))


@dataclass(frozen=True)
class Profile:
    """A named load: lines a second over all sources, bursts of factor times that for the last for_s of every every_s, late lines."""

    rate: float
    sources: int = 1
    factor: float = 1.0
    every_s: float = 0.0
    for_s: float = 0.0
    late_fraction: float = 0.0
    late_max_s: float = 0.0


PROFILES = {"demo": Profile(20), "busy": Profile(1000, 2, 3, 60, 5, 0.02, 120), "peak": Profile(5000, 4, 3, 30, 5, 0.05, 300)}


def paced(spark: SparkSession, profile: Profile, run: str, seed: int = 1) -> DataFrame:
    """A stream of generated lines at a profile's pace, open loop: as many as are due by the clock, whatever the sink does.

    A clock row stands for the lines that become due in its 100 ms; a stream that falls behind gets them all the same."""
    clock = spark.readStream.format("rate").option("rowsPerSecond", 10).load()
    due = lambda at: scheduled(at, profile.rate, profile.factor, profile.every_s, profile.for_s).cast("long")
    begin, end = due(F.col("value") / 10), due((F.col("value") + 1) / 10)
    ids = F.explode(F.when(end > begin, F.sequence(begin, end - 1)).otherwise(F.array().cast("array<long>")))
    lines = clock.select((F.unix_micros("timestamp") * 1000).alias("now_ns"), ids.alias("id"))
    numbered = lines.select("now_ns", (F.col("id") % profile.sources).alias("source"), F.expr(f"id div {profile.sources}").alias("seq"))
    late = _draw(seed, 5, 1_000_000) < int(profile.late_fraction * 1_000_000)
    at = F.col("now_ns") - F.when(late, _draw(seed, 6, max(1, int(profile.late_max_s * 1e9)))).otherwise(F.lit(0))
    return _worded(numbered, at, run, profile.sources, seed)


def resent(lines: DataFrame, share: float, seed: int = 1) -> DataFrame:
    """Lines as a client at least once sends them: a share of batches (of 500 lines of a source) lost its answer and comes again."""
    again = F.pmod(F.xxhash64(F.lit(seed), F.expr("arrival_seq div 500")), F.lit(1_000_000)) < int(share * 1_000_000)
    return lines.unionByName(lines.where(again))
