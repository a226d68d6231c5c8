"""Corpus statistics, tag catalogue, templates, percentiles, rates, and the loss check, as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import marker
from ..schema import MAX_TAG_KEYS, MAX_TAG_VALUES


def corpus(segments: DataFrame) -> DataFrame:
    """segments, lines, bytes, min_ts, max_ts of active rows; zeros where there are none."""
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return segments.where("status = 'active'").agg(F.count("*").alias("segments"), zero(F.sum("entry_count")).alias("lines"), zero(F.sum("size_bytes")).alias("bytes"), zero(F.min("min_ts")).alias("min_ts"), zero(F.max("max_ts")).alias("max_ts"))


def segment_rows(lines: DataFrame, by: str = "segment_no") -> DataFrame:
    """min_ts, max_ts, entry_count and size_bytes (the entry-size estimate) of each segment."""
    from ..sources.logs import entry_size

    size = entry_size(F.col("message"), F.col("tags")).cast("long")
    return lines.groupBy(by).agg(F.min("ts_ns").alias("min_ts"), F.max("ts_ns").alias("max_ts"), F.count("*").alias("entry_count"), F.sum(size).alias("size_bytes"))


def plan(segments: DataFrame, from_ns: int, to_ns: int) -> DataFrame:
    """All segments with in_range: the overlap with [from, to)."""
    return segments.withColumn("in_range", (F.col("max_ts") >= from_ns) & (F.col("min_ts") < to_ns))


def tag_pairs(lines: DataFrame) -> DataFrame:
    return lines.select(F.explode("tags")).distinct()


def tag_catalogue(lines: DataFrame, max_keys: int = MAX_TAG_KEYS, max_values: int = MAX_TAG_VALUES) -> DataFrame:
    """key, value, capped: the first values of the first keys; capped if the key has more. Ranks run over distinct pairs only."""
    pairs = tag_pairs(lines)
    rank = F.row_number().over(Window.partitionBy("key").orderBy("value"))
    n = pairs.groupBy("key").agg(F.count("*").alias("n"))
    keys = n.orderBy("key").limit(max_keys)
    return pairs.withColumn("r", rank).where(F.col("r") <= max_values).join(keys, "key").select("key", "value", (F.col("n") > max_values).alias("capped"))


def term_index(lines: DataFrame, terms: Column, line_id: str) -> DataFrame:
    """term, df and the first and last line of each term."""
    return lines.select(F.explode(terms).alias("term"), F.col(line_id).alias("line")).groupBy("term").agg(F.count("*").alias("df"), F.min("line").alias("first_line"), F.max("line").alias("last_line"))


def templates(lines: DataFrame, group: list[str], top: int = 500) -> DataFrame:
    """Message shapes by frequency: nodes, hexadecimal and other numbers become placeholders."""
    node = r"\bR\d\d-M\d(-N[0-9A-F]-[CI]:J\d\d-U\d\d|-NC-I:J\d\d-U\d\d|-L\d-U\d\d-[A-Z])?\b"
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace("message", node, "{node}"), "0x[0-9a-fA-F]+", "{hex}"), "[0-9]+", "{n}")
    counts = lines.groupBy(*group, shape.alias("template")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), *group, "template").limit(top)


def coverage(lines: DataFrame, mined: DataFrame) -> DataFrame:
    """total, covered and share: how many lines the mined templates stand for."""
    total = lines.agg(F.count("*").alias("total"))
    covered = mined.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("covered"))
    both = total.select("total", F.lit(0).cast("long").alias("covered")).union(covered.select(F.lit(0).cast("long"), "covered"))
    return both.agg(F.sum("total").alias("total"), F.sum("covered").alias("covered")).select("*", F.try_divide("covered", "total").alias("share"))


def percentiles(df: DataFrame, value: str, ps: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Nearest-rank percentiles: the least value with at least p of all at or below it; 0 for none."""
    cols = [F.coalesce(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})"), F.lit(0.0)).alias(n) for n, p in ps.items()]
    return df.groupBy(*by).agg(*cols) if by else df.agg(*cols)


def sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows by the hash of key and seed: the same rows on every run, and in SQL."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}"))), key).limit(n)


def sliding_rate(samples: DataFrame, window_s: int, by: list[str] | None = None) -> DataFrame:
    """samples: at_s and total, rising. rate: over the samples from the one at or before the window's start on; 0 for one sample."""
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    ranged = part.orderBy("at_s")
    before = F.last(F.struct("at_s", "total"), True).over(ranged.rangeBetween(Window.unboundedPreceding, -window_s))
    inside = F.first(F.struct("at_s", "total"), True).over(ranged.rangeBetween(-window_s + 1, 0))
    start = F.coalesce(before, inside)
    span = F.col("at_s") - start["at_s"]
    return samples.withColumn("rate", F.when(span > 0, (F.col("total") - start["total"]) / span).otherwise(F.lit(0.0)))


def lost_ranges(sent: DataFrame, found: DataFrame, source: str = "source", seq: str = "seq") -> DataFrame:
    """Runs of consecutive sequence numbers that were acknowledged and aren't there: source, first_seq, last_seq, n."""
    lost = sent.select(source, seq).distinct().join(found.select(source, seq).distinct(), [source, seq], "left_anti")
    island = F.col(seq) - F.row_number().over(Window.partitionBy(source).orderBy(seq))
    return lost.withColumn("_g", island).groupBy(source, "_g").agg(F.min(seq).alias("first_seq"), F.max(seq).alias("last_seq"), F.count("*").alias("n")).drop("_g")


def verification(sent: DataFrame, lines: DataFrame) -> DataFrame:
    """acked, found, lost and duplicates of marked lines. sent: source and seq."""
    seen = lines.select(marker(F.col("message")).alias("m")).where("m is not null").select("m.source", "m.seq")
    counts = seen.groupBy("source", "seq").agg(F.count("*").alias("n"))
    both = sent.select("source", "seq").distinct().withColumn("acked", F.lit(1)).join(counts, ["source", "seq"], "full")
    return both.agg(F.coalesce(F.sum("acked"), F.lit(0)).alias("acked"), F.count("n").alias("found"), F.count(F.when(F.col("n").isNull(), 1)).alias("lost"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def orphans(stored: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return stored.join(known, key, "left_anti")


def suggestions(catalogue: DataFrame, prefix: str, most: int = 8) -> DataFrame:
    """Values of the catalogue that complete a bare word, in order of key and value."""
    low = prefix.lower()
    return catalogue.where(F.lower("value").startswith(low)).select(F.concat("key", F.lit("="), "value").alias("suggestion")).distinct().orderBy("suggestion").limit(most)


def occurrence_keys(lines: DataFrame, key: str, order: str) -> DataFrame:
    """Tell equal lines apart: occurrence is 0, 1, ... in the given order."""
    return lines.withColumn("occurrence", F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1)


def loss_by_window(sent: DataFrame, found: DataFrame, truncated: DataFrame) -> DataFrame:
    """bucket, expected, found, state. sent: source, seq, bucket; found: source and seq, repeats and all; truncated: bucket.

    A window whose search was cut short is unverifiable, never lost; a complete one is lost if a line is missing."""
    there = found.select("source", "seq").distinct().withColumn("there", F.lit(1))
    n = sent.join(there, ["source", "seq"], "left").groupBy("bucket").agg(F.count("*").alias("expected"), F.count("there").alias("found"))
    cut = truncated.select("bucket").distinct().withColumn("cut", F.lit(True))
    state = F.when(F.col("found") == F.col("expected"), "verified").when(F.coalesce("cut", F.lit(False)), "unverifiable").otherwise("lost")
    return n.join(cut, "bucket", "left").select("bucket", "expected", "found", state.alias("state"))
