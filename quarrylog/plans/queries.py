"""One query per operator of the log engine over the relational test tables, each with SQL that gives the same rows."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..engine import Engine
from ..functions import bloom, text
from ..operators import segments as seg
from ..operators import stats
from ..operators.compaction import pick_batch
from ..operators.histogram import WIDTHS, axis, bucket_start, dense
from ..operators.manifest import Segment
from ..operators.search import BLOOM, SCANNED, TIME, hits, top
from ..schema import STORED, Settings
from ..sources import logs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
DAY = 86_400_000_000_000
JAN5 = 1_704_412_800_000_000_000

EV = """ev AS (SELECT epoch_us(ts) * 1000 AS ts_ns, event_type || ' user' || user_id || ' event' || event_id AS message, event_type, regexp_extract(props, '"k": *([0-9]+)', 1) AS k, event_id AS arrival_seq FROM events)"""
SEG = f"""{EV}, sg AS (SELECT *, (arrival_seq // 2000) * 4 + arrival_seq % 4 AS segment_no FROM ev),
segs AS (SELECT segment_no, min(ts_ns) AS min_ts, max(ts_ns) AS max_ts, count(*) AS entry_count, CAST(sum(8 + strlen(message) + 5 + strlen(event_type) + strlen(k)) AS BIGINT) AS size_bytes FROM sg GROUP BY 1)"""


def toks(c: str) -> str:
    return rf"list_distinct(list_filter(regexp_split_to_array(lower({c}), '[^\p{{L}}\p{{Nd}}]+'), lambda t: t <> ''))"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def shown(df: DataFrame) -> DataFrame:
    """Event lines without their map."""
    return df.select("ts_ns", "message", F.col("tags")["type"].alias("event_type"), F.col("tags")["k"].alias("k"))


def store_of(spark, lines: DataFrame, group: str, settings: Settings | None = None) -> tuple[Engine, dict[str, int]]:
    """A new store that has a segment for each value of a column, and the value of each segment's id."""
    e = Engine(spark, new_folder(spark, "store"), settings)
    made, tags = seg.write(spark, e.manifest.files, lines, group=group)

    def change(s) -> None:
        from ..operators.manifest import add_tags

        for x in made:
            s.segments[x.id] = x
        add_tags(s.tags, tags)

    e.manifest.commit(change)
    first = min((x.created_at for x in made), default=0)
    own = [r[0] for r in lines.agg(F.min(group)).collect()][0] if made else 0
    return e, {x.id: x.created_at - first + own for x in made}


_stores: dict[tuple, tuple[Engine, dict[str, int]]] = {}


def events_store(spark, d) -> tuple[Engine, dict[str, int]]:
    """The events in a store of interleaved, overlapping segments; made once a session, as queries only read it."""
    key = spark.sparkContext.applicationId, d
    if key not in _stores or not _stores[key][0].manifest.files.exists("manifest"):
        _stores[key] = store_of(spark, logs.interleaved(logs.events(spark, d)), "segment_no")
    return _stores[key]


@query(f"WITH {EV} SELECT ts_ns, message, event_type, k FROM ev WHERE list_contains({toks('message')}, 'error') AND ts_ns >= {JAN5} AND ts_ns < {JAN5 + DAY} ORDER BY ts_ns, arrival_seq LIMIT 100")
def search_word_window(spark, d):
    return shown(top(hits(logs.events(spark, d), "ERROR", {}, JAN5, JAN5 + DAY), 100))


@query(f"WITH {EV} SELECT ts_ns, message, event_type, k FROM ev WHERE list_contains({toks('message')}, 'error') AND ts_ns >= {JAN5} AND ts_ns < {JAN5 + DAY} ORDER BY ts_ns DESC, arrival_seq DESC LIMIT 20")
def search_newest(spark, d):
    return shown(top(hits(logs.events(spark, d), "error", {}, JAN5, JAN5 + DAY), 20, newest_first=True))


@query(f"WITH t AS (SELECT doc_id, {toks('text')} AS w FROM documents) SELECT doc_id FROM t WHERE list_contains(w, 'the') AND list_contains(w, 'stupid') ORDER BY doc_id LIMIT 1000")
def search_all_terms(spark, d):
    return top(hits(logs.documents(spark, d), "The stupid, the!", {}), 1000).select(F.col("arrival_seq").alias("doc_id"))


@query("SELECT doc_id, lang, source FROM documents WHERE lang = 'en' AND source = 'src3' ORDER BY doc_id LIMIT 50")
def search_tag(spark, d):
    return top(hits(logs.documents(spark, d), "", {"lang": "en", "source": "src3"}), 50).select(F.col("arrival_seq").alias("doc_id"), F.col("tags")["lang"].alias("lang"), F.col("tags")["source"].alias("source"))


@query(f"SELECT conv_id, turn FROM conversations WHERE role = 'user' AND list_contains({toks('text')}, 'the') ORDER BY conv_id * 1000 + turn LIMIT 200")
def search_tags_and_text(spark, d):
    return top(hits(logs.conversations(spark, d), "the", {"role": "user"}), 200).select(F.expr("arrival_seq div 1000").alias("conv_id"), (F.col("arrival_seq") % 1000).alias("turn"))


@query(f"WITH {EV} SELECT ts_ns, message, event_type, k FROM ev WHERE ts_ns >= {JAN5} AND ts_ns < {JAN5 + DAY} ORDER BY ts_ns, arrival_seq LIMIT 1000")
def search_match_all(spark, d):
    return shown(top(hits(logs.events(spark, d), "-- !!", {}, JAN5, JAN5 + DAY), 1000))


@query(f"WITH {EV}, m AS (SELECT count(*) AS n FROM ev WHERE event_type = 'purchase') SELECT CAST(least(n, 100) AS BIGINT) AS returned, n > 100 AS truncated FROM m")
def search_truncated_flag(spark, d):
    found = hits(logs.events(spark, d), "", {"type": "purchase"}).select("ts_ns", "arrival_seq")
    return top(found, 101).agg(F.least(F.count("*"), F.lit(100)).alias("returned"), (F.count("*") > 100).alias("truncated"))


@query(f"WITH {EV}, w AS (SELECT unnest(['nosuchword', 'signup']) AS word) SELECT word, count(message) AS total FROM w LEFT JOIN ev ON list_contains({toks('message')}, word) GROUP BY 1")
def search_absent_word(spark, d):
    """A word that no line has, which filters answer, and one that lines have."""
    e, _ = events_store(spark, d)
    found = {w: e.search(w, limit=1).histogram for w in ("nosuchword", "signup")}
    return spark.createDataFrame([(w, h.total if h else 0) for w, h in found.items()], "word string, total long")


@query(f"SELECT doc_id, CAST(len(list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{Nd}}]+'), lambda t: lower(t) IN ('the', 'of'))) AS INTEGER) AS n_hits FROM documents WHERE list_contains({toks('text')}, 'the') AND list_contains({toks('text')}, 'of')")
def highlight_hits(spark, d):
    return hits(logs.documents(spark, d), "the of", {}).select(F.col("arrival_seq").alias("doc_id"), F.size(text.highlight_hits(F.col("message"), ["the", "of"])).alias("n_hits"))


@query(f"""WITH {EV}, e AS (SELECT min(ts_ns) AS lo, max(ts_ns) + 1 AS hi FROM ev),
w AS (SELECT min(x) AS w FROM (SELECT unnest([{', '.join(map(str, WIDTHS))}]) AS x), e WHERE (hi - 1) // x - lo // x + 1 <= 100),
b AS (SELECT unnest(generate_series((lo // w) * w, ((hi - 1) // w) * w, w)) AS bucket_start, w AS width FROM e, w),
h AS (SELECT (ts_ns // w) * w AS bucket_start, count(*) AS n FROM ev, w WHERE event_type = 'error' GROUP BY 1)
SELECT b.bucket_start, b.width, coalesce(h.n, 0) AS n FROM b LEFT JOIN h USING (bucket_start)""")
def match_histogram(spark, d):
    lines = logs.events(spark, d)
    lo, hi = lines.agg(F.min("ts_ns"), F.max("ts_ns")).first()
    h = axis([(lo, hi)] if lo is not None else [], lo or 0, (hi or 0) + 1)
    if h is None:
        return spark.createDataFrame([], "bucket_start long, width long, n long")
    counts = hits(lines, "error", {}).groupBy(bucket_start(F.col("ts_ns"), h.width).alias("bucket_start")).agg(F.count("*").alias("n"))
    starts = spark.range(h.start, h.start + h.width * len(h.counts), h.width).select(F.col("id").alias("bucket_start"), F.lit(h.width).cast("long").alias("width"))
    return starts.join(counts, "bucket_start", "left").select("bucket_start", "width", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query(f"""WITH {EV}, h AS (SELECT (ts_ns // {DAY}) * {DAY} AS bucket_start, count(*) AS n FROM ev WHERE event_type = 'click' GROUP BY 1),
b AS (SELECT unnest(generate_series((SELECT min(bucket_start) FROM h), (SELECT max(bucket_start) FROM h), {DAY})) AS bucket_start)
SELECT b.bucket_start, coalesce(n, 0) AS n FROM b LEFT JOIN h USING (bucket_start)""")
def match_histogram_fixed_day(spark, d):
    return dense(hits(logs.events(spark, d), "click", {}), DAY)


@query(f"SELECT count(*) AS total FROM documents WHERE list_contains({toks('text')}, 'the')")
def histogram_total(spark, d):
    return hits(logs.documents(spark, d), "the", {}).groupBy(bucket_start(F.col("ts_ns"), DAY).alias("b")).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total"))


def _segments(spark, d) -> DataFrame:
    return stats.segment_rows(logs.interleaved(logs.events(spark, d)))


@query(f"WITH {SEG} SELECT * FROM segs")
def segment_manifest(spark, d):
    return _segments(spark, d)


@query(f"WITH {SEG} SELECT segment_no, max_ts >= {JAN5} AND min_ts < {JAN5 + DAY} AS in_range, min_ts, max_ts, entry_count FROM segs")
def segment_plan(spark, d):
    e, no = events_store(spark, d)
    rows = [(no[s.id], near, s.min_ts, s.max_ts, s.entry_count) for s, near in e.manifest.plan(JAN5, JAN5 + DAY)]
    return spark.createDataFrame(rows, "segment_no long, in_range boolean, min_ts long, max_ts long, entry_count long")


@query(f"""WITH {SEG}, q AS (SELECT range AS window_no, {JAN5} + range * {2 * DAY} AS a, {JAN5} + (range + 1) * {2 * DAY} AS z FROM range(10))
SELECT window_no, count(segment_no) AS n FROM q LEFT JOIN segs ON max_ts >= a AND min_ts < z GROUP BY 1""")
def segment_interval_join(spark, d):
    q = spark.range(10).select(F.col("id").alias("window_no"), (F.lit(JAN5) + F.col("id") * 2 * DAY).alias("a"), (F.lit(JAN5) + (F.col("id") + 1) * 2 * DAY).alias("z"))
    # ten windows: the bounded side travels
    segs = _segments(spark, d)
    n = segs.join(F.broadcast(q), (F.col("max_ts") >= F.col("a")) & (F.col("min_ts") < F.col("z"))).groupBy("window_no").agg(F.count("*").alias("n"))
    return q.join(n, "window_no", "left").select("window_no", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query(f"""WITH {SEG}, t AS (SELECT segment_no, count(*) FILTER (list_contains({toks('message')}, 'user17') AND ts_ns >= {JAN5} AND ts_ns < {JAN5 + 5 * DAY}) AS n FROM sg GROUP BY 1)
SELECT segment_no, max_ts >= {JAN5} AND min_ts < {JAN5 + 5 * DAY} AS in_range, n AS hits, false AS lost FROM segs JOIN t USING (segment_no)""")
def segment_outcomes(spark, d):
    """What a search did with each segment. A filter may let a segment through that lacks the word, but never hold one back that
    has it: lost tells whether it did, by counting over the lines of those it held back."""
    e, no = events_store(spark, d)
    r = e.search("user17", {}, JAN5, JAN5 + 5 * DAY, 10_000)
    # a reply's hits end at its limit: a segment's are counted over the lines of all in range
    near = [o.segment.storage_key for o in r.outcomes if o.outcome != TIME]
    inside = (F.col("ts_ns") >= JAN5) & (F.col("ts_ns") < JAN5 + 5 * DAY)
    there = {x.segment_id: x.n for x in hits(seg.read(spark, e.manifest.files, near), "user17", {}).groupBy("segment_id").agg(F.count_if(inside).alias("n")).collect()}
    rows = [(no[o.segment.id], o.outcome != TIME, there.get(o.segment.id, 0) if o.outcome == SCANNED else 0, o.outcome == BLOOM and o.segment.id in there) for o in r.outcomes]
    return spark.createDataFrame(rows, "segment_no long, in_range boolean, hits long, lost boolean")


@query(f"WITH {SEG} SELECT count(*) AS segments, CAST(coalesce(sum(entry_count), 0) AS BIGINT) AS lines, coalesce(min(min_ts), 0) AS min_ts, coalesce(max(max_ts), 0) AS max_ts FROM segs")
def corpus_stats(spark, d):
    own = events_store(spark, d)[0].stats()
    return spark.createDataFrame([tuple(own[k] for k in ("segments", "lines", "min_ts", "max_ts"))], "segments long, lines long, min_ts long, max_ts long")


@query(f"""WITH {EV}, p AS (SELECT 'type' AS key, event_type AS value FROM ev UNION SELECT 'k', k FROM ev UNION SELECT 'lang', lang FROM documents UNION SELECT 'source', source FROM documents),
r AS (SELECT key, value, row_number() OVER (PARTITION BY key ORDER BY value) AS r, count(*) OVER (PARTITION BY key) AS n FROM p)
SELECT key, value, n > 256 AS capped FROM r WHERE r <= 256""")
def tag_catalogue(spark, d):
    both = logs.events(spark, d).select("tags").unionByName(logs.documents(spark, d).select("tags"))
    return stats.tag_catalogue(both)


@query("SELECT DISTINCT 'source=' || source AS suggestion FROM documents WHERE starts_with(lower(source), 'src1') ORDER BY 1 LIMIT 8")
def tag_suggest(spark, d):
    return stats.suggestions(stats.tag_catalogue(logs.documents(spark, d)), "SRC1")


@query(f"WITH t AS (SELECT doc_id, unnest({toks('text')}) AS term FROM documents) SELECT term, count(*) AS df, min(doc_id) AS first_line, max(doc_id) AS last_line FROM t GROUP BY 1")
def inverted_index(spark, d):
    return stats.term_index(logs.documents(spark, d), text.tokens(F.col("message")), "arrival_seq")


@query(f"SELECT DISTINCT unnest({toks('message')}) AS term FROM (SELECT event_type || ' user' || user_id AS message FROM events)")
def distinct_terms(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.concat("event_type", F.lit(" user"), F.col("user_id").cast("string")).alias("message"))
    return e.select(F.explode(text.tokens(F.col("message"))).alias("term")).distinct()


@query(f"WITH t AS (SELECT doc_id, unnest({toks('text')}) AS term FROM documents) SELECT term, count(*) AS df FROM t GROUP BY 1 ORDER BY df DESC, term LIMIT 50")
def term_df_topk(spark, d):
    return logs.documents(spark, d).select(F.explode(text.tokens(F.col("message"))).alias("term")).groupBy("term").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "term").limit(50)


@query(f"WITH t AS (SELECT doc_id, unnest({toks('text')}) AS term FROM documents) SELECT doc_id FROM t WHERE term = 'the' INTERSECT SELECT doc_id FROM t WHERE term = 'and' INTERSECT SELECT doc_id FROM t WHERE term = 'of'")
def posting_intersection(spark, d):
    # one pass over the postings of the three terms: a line with all of them has three
    rows = logs.documents(spark, d).select(F.col("arrival_seq").alias("doc_id"), F.explode(text.tokens(F.col("message"))).alias("term")).where(F.col("term").isin("the", "and", "of"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n = 3").select("doc_id")


@query("SELECT o_orderkey AS orphan FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def orphan_keys(spark, d):
    stored = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("orphan"))
    return stats.orphans(stored, spark.read.parquet(f"{d}/lineitem.parquet").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("orphan")), "orphan")


#: Eight overlapping streams of events, in order of their first line.
EIGHT = f"""{EV}, sg AS (SELECT *, arrival_seq % 8 AS segment_no FROM ev),
ranked AS (SELECT segment_no, row_number() OVER (ORDER BY min(ts_ns), segment_no) - 1 AS rank FROM sg GROUP BY 1)"""


def eight(spark, d, **settings) -> tuple[Engine, dict[str, int]]:
    big = {"small_bytes": 1 << 40, "target_bytes": 1 << 40} | settings
    return store_of(spark, logs.events(spark, d).withColumn("segment_no", F.col("arrival_seq") % 8), "segment_no", Settings(**big))


@query(f"""WITH {EIGHT}, i AS (SELECT *, row_number() OVER (PARTITION BY segment_no ORDER BY ts_ns, arrival_seq) AS own_no FROM sg JOIN ranked USING (segment_no))
SELECT ts_ns, message, rank // 4 AS batch, CAST(1 AS BIGINT) AS generation, CAST(row_number() OVER (PARTITION BY rank // 4 ORDER BY ts_ns, rank, own_no) - 1 AS BIGINT) AS line_no FROM i""")
def compaction_union(spark, d):
    """All lines after merging segments four by four: which merge has each, and its number there."""
    e, _ = eight(spark, d, min_segments=4, max_segments=4)
    made = {}
    while new := e.compactor.once():
        made[new.id] = (len(made), new.generation)
        e.compactor.bad.add(new.id)  # what is merged isn't merged again here
    order = spark.createDataFrame([(i, b, g) for i, (b, g) in made.items()], "segment_id string, batch long, generation long")
    return e.lines().join(order, "segment_id").select("ts_ns", "message", "batch", "generation", F.col("line_no").cast("long").alias("line_no"))


_PICK = Settings(small_bytes=30_000, target_bytes=200_000, min_segments=2, max_segments=8)


@query(f"""WITH RECURSIVE {SEG}, small AS (SELECT segment_no, size_bytes, row_number() OVER (ORDER BY min_ts, segment_no) AS r FROM segs WHERE size_bytes < {_PICK.small_bytes}),
took AS (SELECT r, segment_no, size_bytes, size_bytes AS total FROM small WHERE r = 1
UNION ALL SELECT s.r, s.segment_no, s.size_bytes, t.total + s.size_bytes FROM took t JOIN small s ON s.r = t.r + 1 WHERE t.total + s.size_bytes <= {_PICK.target_bytes} AND s.r <= {_PICK.max_segments})
SELECT segment_no, size_bytes FROM took WHERE (SELECT count(*) FROM took) >= {_PICK.min_segments}""")
def compaction_pick(spark, d):
    """Which segments a merge would take: a walk over the catalogue's rows, oldest first."""
    rows = _segments(spark, d).orderBy("min_ts", "segment_no").collect()
    own = [Segment(f"{r.segment_no:06d}", f"segments/{r.segment_no}", r.min_ts, r.max_ts, r.entry_count, r.size_bytes, 0) for r in rows]
    took = pick_batch(own, _PICK)
    return spark.createDataFrame([(int(s.id), s.size_bytes) for s in took], "segment_no long, size_bytes long")


@query(f"WITH {EV} SELECT CAST(4 AS BIGINT) AS generation, count(*) AS entry_count, min(ts_ns) AS min_ts, max(ts_ns) AS max_ts FROM ev HAVING count(*) > 7")
def merge_generation(spark, d):
    """Eight segments merged three by three, oldest first, until one is left: each merge is one generation up."""
    e, _ = eight(spark, d, min_segments=2, max_segments=3)
    while e.compact():
        pass
    rows = [(s.generation, s.entry_count, s.min_ts, s.max_ts) for s in e.manifest.snapshot().ordered()]
    return spark.createDataFrame(rows, "generation long, entry_count long, min_ts long, max_ts long")


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1")
def percentile_latency(spark, d):
    return stats.percentiles(spark.read.parquet(f"{d}/events.parquet"), "value", {"p50": 0.5, "p90": 0.9, "p99": 0.99}, ["event_type"])


@query("SELECT l_returnflag, CAST(sum(CAST(l_quantity AS BIGINT)) // count(*) AS BIGINT) AS mean FROM lineitem GROUP BY 1")
def integer_mean(spark, d):
    return spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_returnflag").agg(F.expr("sum(cast(l_quantity as bigint)) div count(*)").alias("mean"))


@query("""WITH h AS (SELECT event_type, epoch_us(ts) // 3600000000 AS at_s, count(*) AS n FROM events GROUP BY 1, 2),
s AS (SELECT event_type, at_s, sum(n) OVER (PARTITION BY event_type ORDER BY at_s) AS total FROM h),
p AS (SELECT *, coalesce(last_value(at_s) OVER b, first_value(at_s) OVER i) AS a0, coalesce(last_value(total) OVER b, first_value(total) OVER i) AS t0 FROM s
WINDOW b AS (PARTITION BY event_type ORDER BY at_s RANGE BETWEEN UNBOUNDED PRECEDING AND 10 PRECEDING), i AS (PARTITION BY event_type ORDER BY at_s RANGE BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT event_type, at_s, CAST(total AS BIGINT) AS total, CASE WHEN at_s > a0 THEN CAST(total - t0 AS DOUBLE) / (at_s - a0) ELSE 0.0 END AS rate FROM p""")
def sliding_rate(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    h = e.groupBy("event_type", F.expr("unix_micros(cast(ts as timestamp)) div 3600000000").alias("at_s")).agg(F.count("*").alias("n"))
    s = h.select("event_type", "at_s", F.sum("n").over(Window.partitionBy("event_type").orderBy("at_s")).alias("total"))
    return stats.sliding_rate(s, 10, ["event_type"])


_LOST = "event_id % 97 IN (0, 1, 5)"


@query(f"WITH l AS (SELECT event_id % 4 AS source, event_id // 4 AS seq FROM events WHERE {_LOST}), g AS (SELECT *, seq - row_number() OVER (PARTITION BY source ORDER BY seq) AS g FROM l) SELECT source, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n FROM g GROUP BY source, g")
def lost_ranges(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", (F.col("event_id") % 4).alias("source"), F.expr("event_id div 4").alias("seq"))
    return stats.lost_ranges(e, e.where("event_id % 97 NOT IN (0, 1, 5)"))


@query("SELECT CAST(2000 AS BIGINT) AS acked, CAST(count(DISTINCT range) AS BIGINT) AS found, CAST(2000 - count(DISTINCT range) AS BIGINT) AS lost, CAST(count(*) FILTER (range % 50 = 0) AS BIGINT) AS duplicates FROM range(2000) WHERE range % 101 <> 7")
def verified_load(spark, d):
    lines = logs.generated(spark, 1000, "run0000beef", sources=2, late_fraction=0.05, late_max_s=60, parts=4)
    there = lines.where("arrival_seq % 101 <> 7")
    sent = spark.range(2000).select((F.col("id") % 2).alias("source"), F.expr("id div 2").alias("seq"))
    return stats.verification(sent, there.unionByName(there.where("arrival_seq % 50 = 0")))


@query("WITH u AS (SELECT event_id FROM events UNION ALL SELECT event_id FROM events WHERE event_id % 50 = 0) SELECT count(*) AS lines, count(DISTINCT event_id) AS distinct_lines, count(*) - count(DISTINCT event_id) AS duplicates FROM u")
def duplicates(spark, d):
    e = logs.events(spark, d).select("arrival_seq")
    n = e.unionByName(e.where("arrival_seq % 50 = 0")).groupBy("arrival_seq").agg(F.count("*").alias("n"))
    return n.agg(F.sum("n").alias("lines"), F.count("*").alias("distinct_lines"), (F.sum("n") - F.count("*")).alias("duplicates"))


@query(f"WITH {EV} SELECT ts_ns // 6000000000000 AS bucket, count(*) AS expected FROM ev GROUP BY 1")
def expected_buckets(spark, d):
    return logs.events(spark, d).groupBy(F.expr("ts_ns div 6000000000000").alias("bucket")).agg(F.count("*").alias("expected"))


@query("""WITH t AS (SELECT regexp_replace(regexp_replace(url, '0x[0-9a-fA-F]+', '{hex}', 'g'), '[0-9]+', '{n}', 'g') AS template FROM pages)
SELECT template, count(*) AS n FROM t GROUP BY 1 ORDER BY n DESC, template LIMIT 500""")
def template_mining(spark, d):
    return stats.templates(spark.read.parquet(f"{d}/pages.parquet").select(F.col("url").alias("message")), []).select("template", "n")


@query("SELECT event_id AS id, CASE WHEN event_id % 3 < 2 THEN 'run0000cafe' ELSE '' END AS run, CASE WHEN event_id % 3 < 2 THEN event_id % 5 ELSE -1 END AS source, CASE WHEN event_id % 3 < 2 THEN event_id ELSE -1 END AS seq FROM events")
def marker_parse(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id")
    mark = F.concat(F.lit("line ~run0000cafe."), (F.col("event_id") % 5).cast("string"), F.lit("."), F.col("event_id").cast("string"), F.when(F.col("event_id") % 3 == 2, " more").otherwise(""))
    m = text.marker(mark)
    return e.select(F.col("event_id").alias("id"), F.coalesce(m["run"], F.lit("")).alias("run"), F.coalesce(m["source"], F.lit(-1)).alias("source"), F.coalesce(m["seq"], F.lit(-1)).alias("seq"))


@query("SELECT lang, CAST(sum(8 + strlen(text) + 4 + strlen(lang) + 6 + strlen(source)) AS BIGINT) AS size_bytes FROM documents GROUP BY 1")
def entry_size(spark, d):
    lines = logs.documents(spark, d)
    return lines.groupBy(F.col("tags")["lang"].alias("lang")).agg(F.sum(logs.entry_size(F.col("message"), F.col("tags")).cast("long")).alias("size_bytes"))


@query("""SELECT event_id AS id, epoch_us(ts) * 1000 AS ts_ns, CASE WHEN event_id % 7 = 0 THEN 'ALERT' END AS alert, upper(event_type) AS component, 'INFO' AS level,
strftime(ts, '%Y.%m.%d') || ' R0' || (event_id % 8) || ' ' || strftime(ts, '%Y-%m-%d-%H.%M.%S.%f') || ' R0' || (event_id % 8) || ' RAS ' || upper(event_type) || ' INFO user ' || user_id AS message FROM events WHERE event_id % 11 <> 0""")
def bgl_parse(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    node = F.concat(F.lit("R0"), (F.col("event_id") % 8).cast("string"))
    at = F.date_format("ts", "yyyy-MM-dd-HH.mm.ss.SSSSSS")
    line = F.concat_ws(" ", F.when(F.col("event_id") % 7 == 0, "ALERT").otherwise("-"), F.unix_seconds(F.col("ts").cast("timestamp")).cast("string"), F.date_format("ts", "yyyy.MM.dd"), node, at, node, F.lit("RAS"), F.upper("event_type"), F.lit("INFO"), F.lit("user"), F.col("user_id").cast("string"))
    lines = e.select("event_id", F.when(F.col("event_id") % 11 == 0, "too few fields").otherwise(line).alias("value"))
    c = logs.bgl_columns(F.concat("value", F.lit(" " * 9)))
    out = lines.select(F.col("event_id").alias("id"), c["ts_ns"].alias("ts_ns"), F.rtrim(c["message"]).alias("message"), c["tags"].alias("tags")).where("ts_ns is not null")
    return out.select("id", "ts_ns", F.col("tags")["alert"].alias("alert"), F.col("tags")["component"].alias("component"), F.col("tags")["level"].alias("level"), "message")


@query(f"WITH {EV} SELECT DISTINCT ts_ns, message, event_type, k FROM ev")
def line_key_dedup(spark, d):
    """All events, and those of a second, overlapping source once more: each line once."""
    e = logs.events(spark, d)
    both = e.unionByName(e.where("arrival_seq % 3 = 0"))
    return shown(both.withColumn("key", logs.line_key(F.col("ts_ns"), F.col("message"), F.col("tags"))).dropDuplicates(["key"]))


@query("SELECT doc_id, lang, source FROM documents ORDER BY md5(doc_id || '-42'), doc_id LIMIT 50")
def reservoir_sample(spark, d):
    return stats.sample(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "source"), "doc_id", 50, 42)


@query(f"WITH t AS (SELECT doc_id // 100 AS segment_no, unnest({toks('text')}) AS term FROM documents) SELECT segment_no, count(DISTINCT term) AS terms, CAST(0 AS BIGINT) AS denied, true AS selective FROM t GROUP BY 1")
def bloom_no_false_negative(spark, d):
    """Of segments of 100 documents: their distinct terms, how many of them their own filter denies (none), and whether it lets
    through less than 3 % of words that it doesn't have."""
    docs = logs.documents(spark, d)
    terms = docs.select(F.expr("arrival_seq div 100").alias("segment_no"), F.explode(text.tokens(F.col("message"))).alias("term")).distinct()

    def probed(rows: pd.DataFrame) -> pd.DataFrame:
        words = rows["term"].tolist()
        f = bloom.build(words)
        denied = int((~bloom.passed(f, words)).sum())
        passed = int(bloom.passed(f, [f"~absent{i}" for i in range(2000)]).sum())
        return pd.DataFrame({"segment_no": [rows["segment_no"].iloc[0]], "terms": [len(rows)], "denied": [denied], "selective": [passed < 60]})

    return terms.groupBy("segment_no").applyInPandas(probed, "segment_no long, terms long, denied long, selective boolean")


@query("SELECT range AS at_s, CAST(floor(range * 100.0 + (floor(range / 10.0) * 2 + greatest(range - floor(range / 10.0) * 10 - 8, 0)) * 100.0 * 2) AS BIGINT) AS due FROM range(61)")
def burst_schedule(spark, d):
    return spark.range(61).select(F.col("id").alias("at_s"), logs.scheduled(F.col("id").cast("double"), 100.0, 3.0, 10.0, 2.0).cast("long").alias("due"))


@query(f"WITH {EV} SELECT event_type, count(*) AS n, min(ts_ns) AS min_ts, max(ts_ns) AS max_ts FROM ev GROUP BY 1")
def stream_ingest_available_now(spark, d):
    """Events as a stream of files, sealed by the engine's sink batch by batch, and aggregated from what it stored."""
    src = spark.read.parquet(f"{d}/events.parquet")
    e = Engine(spark, new_folder(spark, "stream"))
    stream = spark.readStream.schema(src.schema).parquet(f"{d}/events.parquet" if _is_folder(spark, f"{d}/events.parquet") else f"{d}/events.parque[t]")
    lines = stream.select((F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_ns"), F.concat("event_type", F.lit(" event")).alias("message"), F.create_map(F.lit("type"), "event_type").alias("tags"), F.col("event_id").alias("arrival_seq"))
    e.ingest_stream(lines, f"{e.manifest.files.root}/checkpoint", available_now=True).awaitTermination()
    return e.lines().groupBy(F.col("tags")["type"].alias("event_type")).agg(F.count("*").alias("n"), F.min("ts_ns").alias("min_ts"), F.max("ts_ns").alias("max_ts"))


@query(f"WITH {EV} SELECT ts_ns, message FROM ev WHERE list_contains({toks('message')}, 'signup') AND ts_ns >= {JAN5} AND ts_ns < {JAN5 + 2 * DAY} ORDER BY ts_ns DESC, arrival_seq DESC LIMIT 100")
def engine_search(spark, d):
    """The whole way: overlapping segments in a store, manifest, pruning, scan, merge."""
    e = Engine(spark, new_folder(spark, "store"))
    lines = logs.events(spark, d)
    for half in (0, 1):
        e.ingest(lines.where(F.expr("arrival_seq div 2000") % 2 == half))
    r = e.search("signup", {"type": "signup"}, JAN5, JAN5 + 2 * DAY, 100, newest_first=True)
    return spark.createDataFrame([(h["ts_ns"], h["message"]) for h in r.hits], "ts_ns long, message string")


def scratch(spark) -> str:
    """The folder that all executors share; unset, a temporary one in local mode, an error on a cluster."""
    import re
    import tempfile

    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*)?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quarrylog-")
        atexit.register(shutil.rmtree, root.removeprefix("file://"), True)
    return root.rstrip("/")


def new_folder(spark, name: str) -> str:
    """A folder of its own in the shared one, removed at exit."""
    root = f"{scratch(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def drop() -> None:
        if root.startswith(("file:", "/")):
            shutil.rmtree("/" + root.removeprefix("file:").lstrip("/"), True)
            return
        with contextlib.suppress(Exception):
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    atexit.register(drop)
    return root


def _is_folder(spark, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def empty_lines(spark) -> DataFrame:
    return spark.createDataFrame([], STORED)


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
