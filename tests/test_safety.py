"""Crashes, damage, limits and the smaller operators."""

import json
import os
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quarrylog import __main__ as cli
from quarrylog.engine import Engine, distinct_lines
from quarrylog.functions import bloom, display
from quarrylog.operators import manifest as mf
from quarrylog.operators import segments as seg
from quarrylog.operators import stats
from quarrylog.operators.histogram import Histogram
from quarrylog.operators.manifest import Manifest, Segment
from quarrylog.schema import (
    MAX_BATCH, MAX_VIEWS, BufferFull, Busy, Closed, Conflict, Corrupt, InvalidEntry, InvalidRequest, LogError, SearchTimeout, Settings, page_limit, status,
)
from quarrylog.sources import logs
from quarrylog.streaming.ingest import Rate, merged_view, tail_stream

LINES = "ts_ns long, message string, tags map<string,string>, arrival_seq long"


def frame(spark, rows):
    return spark.createDataFrame([(t, m, dict(tags), i) for i, (t, m, tags) in enumerate(rows)], LINES)


def some(spark, n=20, at=1000, word="common"):
    return frame(spark, [(at + i, f"{word} line{i}", {"k": str(i % 3)}) for i in range(n)])


def store(spark, tmp_path, **settings):
    return Engine(spark, f"file://{tmp_path}/store", Settings(**settings))


class Dies(RuntimeError):
    pass


def test_a_writer_that_dies_keeps_nobody_out(spark, tmp_path, monkeypatch):
    e = store(spark, tmp_path)
    e.ingest(some(spark))
    for step in ("mkdirs", "name"):  # before anything is written, and just before the name is given
        m = Manifest(spark, e.manifest.files.root)
        with monkeypatch.context() as p:
            if step == "name":
                p.setattr(m.files, "_name", lambda *a: (_ for _ in ()).throw(Dies()))
            else:
                p.setattr(m.files, "create", lambda *a: (_ for _ in ()).throw(Dies()))
            with pytest.raises(Dies):
                m.commit(lambda s: s.meta.__setitem__("x", "1"))
        assert "x" not in e.manifest.snapshot().meta
    (tmp_path / "store/manifest" / f"v{e.manifest.snapshot().version + 1:012d}.json.dead.tmp").write_text("half")
    e.manifest.commit(lambda s: s.meta.__setitem__("y", "2"))
    assert Manifest(spark, e.manifest.files.root).snapshot().meta["y"] == "2"


def test_writers_in_turn_lose_nothing(spark, tmp_path):
    a, b = (Manifest(spark, f"file://{tmp_path}/m") for _ in range(2))
    row = lambda i: Segment(f"{i:016x}-00000000", f"segments/{i}", i, i + 1, 1, 1, i)
    for i in range(120):
        (a, b)[i % 2].add(row(i), [("k", str(i % 5))])
    third = Manifest(spark, f"file://{tmp_path}/m")
    assert len(third.snapshot().segments) == 120 and third.snapshot().tags["k"]["values"] == list("01234")
    assert third.trim(10) > 50 and len(Manifest(spark, f"file://{tmp_path}/m").snapshot().segments) == 120
    a.replace([row(500)], [row(0).id])
    assert b.counts() == (121, 120) and b.purge([row(0).id, row(1).id]) == 1 and a.counts() == (120, 120)
    with pytest.raises(Conflict):
        b.replace([row(501)], [row(0).id])
    # a commit that another one overtakes is made again on what that one left
    def overtaken(s):
        if "late" not in a.snapshot().meta:
            a.commit(lambda t: t.meta.__setitem__("late", "1"))
        s.meta["own"] = s.meta.get("late", "none")

    b.commit(overtaken)
    assert Manifest(spark, f"file://{tmp_path}/m").snapshot().meta["own"] == "1"


def test_older_and_newer_formats(spark, tmp_path):
    m = Manifest(spark, f"file://{tmp_path}/m")
    old = {"id": "a", "storage_key": "segments/a", "min_ts": 1, "max_ts": 2, "entry_count": 1, "size_bytes": 3, "created_at": 4, "generation": 0, "status": "active", "bloom": "QUJD"}
    for v, rows in ((1, []), (2, [old])):
        m.files.create(f"manifest/v{v:012d}.json", json.dumps({"format": 1, "segments": rows, "tags": {}, "meta": {"instance_id": "i"}}))
    s = m.snapshot()
    assert s.version == 2 and s.segments["a"].filters is None and s.meta == {"instance_id": "i"}
    m.commit(lambda x: x.meta.__setitem__("z", "1"))
    assert set(Manifest(spark, f"file://{tmp_path}/m").snapshot().segments) == {"a"} and list(mf.MIGRATIONS) == list(range(1, mf.FORMAT))
    m.files.create(f"manifest/v{4:012d}.json", json.dumps({"format": 99}))
    with pytest.raises(Corrupt):
        Manifest(spark, f"file://{tmp_path}/m").snapshot()


def test_streams_with_nested_names_and_new_checkpoints(spark, tmp_path):
    e = store(spark, tmp_path)

    def run(source, checkpoint):
        e.ingest_stream(spark.readStream.schema(LINES).parquet(str(source)), str(checkpoint), available_now=True).awaitTermination()

    some(spark, 7).write.parquet(str(tmp_path / "one"))
    some(spark, 4, 5000).write.parquet(str(tmp_path / "two"))
    run(tmp_path / "one", tmp_path / "x/cp")
    run(tmp_path / "two", tmp_path / "x")  # its name is within the other's
    assert e.stats()["lines"] == 11
    run(tmp_path / "two", tmp_path / "x")
    assert e.stats()["lines"] == 11
    # a stream whose checkpoint is gone starts again under the same name, and its batches are new ones
    os.system(f"rm -r {tmp_path}/x/cp")
    run(tmp_path / "one", tmp_path / "x/cp")
    assert e.stats()["lines"] == 18
    # a batch that was committed before its checkpoint was is not added twice
    stream = json.loads((tmp_path / "x/cp/metadata").read_text())["id"]
    assert e.ingest(some(spark, 3), source=f"{stream}#0") == [] and e.stats()["lines"] == 18


def test_damage_is_seen(spark, tmp_path):
    e = store(spark, tmp_path)
    (s,) = e.ingest(some(spark, 400))
    seg.verify(spark, e.manifest.files, s)
    (file,) = Path(f"{tmp_path}/store/{s.storage_key}").glob("*.parquet")
    whole = file.read_bytes()
    (file.parent / f".{file.name}.crc").unlink()
    size = len(whole)
    for bad in (whole[: size // 2], b"", whole + b"x", *(whole[:i] + bytes([whole[i] ^ 0x5A]) + whole[i + 1 :] for i in (0, 60, size // 4, size // 2, size - 6, size - 1))):
        file.write_bytes(bad)
        with pytest.raises(Corrupt):
            seg.verify(spark, e.manifest.files, s)
    file.write_bytes(whole[: size // 2])
    with pytest.raises(Corrupt):
        e.search("common")
    file.write_bytes(whole)
    assert len(e.search("common").hits) == 400
    # a filter that is missing or damaged excludes nothing
    assert bloom.may_contain(b"", "x") and bloom.may_contain(b"\1\0", "x") and bloom.may_contain(None, "x")


def test_bad_segments_are_passed_over_and_stuck_settings_reported(spark, tmp_path, caplog):
    e = store(spark, tmp_path, min_segments=2, max_segments=2)
    made = [e.ingest(some(spark, 10, 1000 * i + 1))[0] for i in range(3)]
    (file,) = Path(f"{tmp_path}/store/{made[0].storage_key}").glob("*.parquet")
    file.write_bytes(file.read_bytes()[:-9])
    assert e.compact() is None and e.compactor.bad == {made[0].id}
    new = e.compact()
    assert new.entry_count == 20 and new.generation == 1
    tight = store(spark, tmp_path / "b", small_bytes=1 << 20, target_bytes=1 << 20, min_segments=2)
    rows = [Segment(str(i), str(i), i, i, 1, 600_000, 0) for i in range(3)]
    assert tight.compactor._warn(rows) and not tight.compactor._warn(rows) and tight.compactor._warn(rows[:2]) and not tight.compactor._warn(rows[:1])
    # filters of segments that are gone go with them
    assert e.collect(time.time_ns() + 10**13) and len(e.manifest.files.list("filters")) == len({s.filters for s in e.manifest.snapshot().segments.values()})


def test_a_seal_that_fails_keeps_its_lines(spark, tmp_path, monkeypatch):
    e = store(spark, tmp_path, buffer_bytes=10_000)
    e.add_batch([(1, "a", {}), (2, "b", {})])
    for where in ("before", "after"):  # files not written at all, or written and then not listed

        def broken(*a, real=seg.write, where=where, **k):
            if where == "after":
                real(*a, **k)
            raise Dies

        with monkeypatch.context() as p:
            p.setattr(seg, "write", broken)
            with pytest.raises(Dies):
                e.flush()
        assert len(e.pending) == 2 and e.stats()["lines"] == 0
    e.add_batch([(3, "c", {})])
    assert e.flush()[0].entry_count == 3 and not e.pending and not e.manifest.files.list("staged")
    assert len(e.collect(time.time_ns() + 10**13).orphans) == 1 and e.stats()["lines"] == 3
    e.add_batch([(4, "d", {})])
    assert e.close()[0].entry_count == 1
    for late in (lambda: e.add_batch([(5, "e", {})]), lambda: e.ingest(some(spark))):
        with pytest.raises(Closed):
            late()
    with pytest.raises(InvalidEntry):
        store(spark, tmp_path).ingest(some(spark, 5), max_entries=4)
    assert MAX_BATCH == 10_000


def test_a_search_ends_at_its_deadline(spark, tmp_path):
    e = store(spark, tmp_path)
    e.ingest(some(spark))
    e.searcher.timeout = 0.0
    with pytest.raises(SearchTimeout):
        e.search("common")
    e.searcher.timeout = 30.0
    assert len(e.search("common").hits) == 20
    e.searcher.slots.acquire()
    for _ in range(7):
        e.searcher.slots.acquire()
    with pytest.raises(Busy):
        e.search("common")


def test_filters_beyond_the_cache_are_tested_where_they_lie(spark, tmp_path):
    e = store(spark, tmp_path)
    for i in range(3):
        e.ingest(some(spark, 10, 100 * i + 1, f"word{i}"))
    want = [e.search(f"word{i}").metrics for i in range(3)]
    e.searcher.filters.most, e.searcher.filters.held, e.searcher.filters.size = 1, {}, 0
    assert [e.search(f"word{i}").metrics for i in range(3)] == want and want[0]["scanned"] == 1
    h = Histogram(0, 10, [0, 4, 0, 5])
    assert h.reach(4) == (0, 20) and h.reach(5) == (0, 40) and h.reach(5, True) == (30, 40) and h.reach(6, True) == (10, 40) and h.reach(99) == (0, 40)


def test_views(spark, tmp_path):
    e = store(spark, tmp_path)
    e.ingest(some(spark, 3))
    v = e.tail()
    records = v.records(wait_s=0, most=2)
    assert next(records)["lines"] == []
    e.ingest(some(spark, 2, 9000, "later"))
    tick = next(records)
    assert [x["message"] for x in tick["lines"]] == ["later line1", "later line0"] and tick["corpus"]["lines"] == 5
    assert next(records) == {"event": "end", "cursor": 9001} and not v.open()
    bad = e.tail("x" * 5000)
    assert [r["event"] for r in bad.records(wait_s=0, most=3)] == ["problem", "end"]
    views = [e.tail() for _ in range(MAX_VIEWS)]
    with pytest.raises(Busy):
        e.tail()
    views[0].close()
    e.tail()
    assert merged_view([{"m": 1}, {"m": 2}], [{"m": 3}], 2) == [{"m": 3}, {"m": 1}]
    r = Rate()
    for t, n in ((0, 0), (4, 40), (9.5, 95)):
        r.add(t, n)
    assert r.stored() is None
    r.add(10, 100)
    assert r.stored() == 10.0 and r.value() == 10.0
    assert set(e.overview()["examples"]) <= {"k=0", "k=1", "k=2"} and e.amplification(e.stats()["bytes"] // 2) >= 2


def test_streamed_tail_gives_each_line_once(spark, tmp_path):
    rows = some(spark, 5).withColumn("ts_ns", F.col("ts_ns") * 10**9)
    rows.union(rows).write.parquet(str(tmp_path / "in"))
    q = tail_stream(spark.readStream.schema(LINES).parquet(str(tmp_path / "in"))).select("message").writeStream.format("memory").queryName("tail_once").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("tail_once").count() == 5
    assert distinct_lines(rows.union(rows)).count() == 5
    twice = stats.occurrence_keys(rows.union(rows), "message", "arrival_seq").groupBy("message").agg(F.sort_array(F.collect_list("occurrence")).alias("o"))
    assert {tuple(r.o) for r in twice.collect()} == {(0, 1)}


def test_loads(spark, tmp_path):
    lines = logs.generated(spark, 1000, "run0000cafe")
    twice = logs.resent(lines, 0.5, seed=3)
    again = twice.count() - 1000
    assert again % 500 == 0 and 0 <= again <= 1000 and twice.select("message").distinct().count() == 1000
    assert {k: (p.rate, p.sources) for k, p in logs.PROFILES.items()} == {"demo": (20, 1), "busy": (1000, 2), "peak": (5000, 4)}
    q = logs.paced(spark, logs.PROFILES["busy"], "run0000beef").writeStream.format("memory").queryName("paced_lines").start()
    end = time.time() + 60
    while time.time() < end and spark.table("paced_lines").count() < 300:
        time.sleep(0.5)
    q.stop()
    got = spark.table("paced_lines")
    n = got.count()
    assert n >= 300 and got.select("arrival_seq").distinct().count() == n and got.agg(F.max("arrival_seq")).first()[0] == n - 1
    text = spark.createDataFrame([("ab",), ("",), ("é",)], "value string")
    assert tuple(logs.raw_counts(text).first()) == (3, 7) and logs.first_lines(text, 2, ["value"]).count() == 2
    mined = stats.templates(lines, [], 2)
    c = stats.coverage(lines, mined).first()
    assert c.total == 1000 and c.covered == sum(r.n for r in mined.collect()) and c.share == c.covered / 1000


def test_catalogue_bounds(spark, tmp_path):
    rows = frame(spark, [(1, "m", {"a": str(i), "b": "x"}) for i in range(5)])
    got = {(r.key, r.value, r.capped) for r in stats.tag_catalogue(rows, max_values=3).collect()}
    assert got == {("a", "0", True), ("a", "1", True), ("a", "2", True), ("b", "x", False)}
    own = seg.segment_pairs(rows.withColumn("segment_id", F.lit("s")), 4)
    assert sorted((r.key, r.value) for r in own.collect()) == [("a", "0"), ("a", "1"), ("a", "2"), ("a", "3")]
    e = store(spark, tmp_path)
    e.ingest(rows)
    post = seg.inverted_index(e.lines())
    assert sorted(r.line_no for r in post.where("term = 'm'").collect()) == [0, 1, 2, 3, 4] and post.where("term = 'tag:b=x'").count() == 5


def test_words_for_people():
    assert [page_limit(x) for x in (None, 0, 7, 5000)] == [100, 100, 7, 1024]
    with pytest.raises(InvalidRequest):
        page_limit(-1)
    assert status(InvalidRequest("x")) == (400, "x") and status(SearchTimeout())[0] == 504 and status(BufferFull("b"))[0] == 429 and status(ValueError("secret")) == (500, "internal error") and status(LogError("y"))[0] == 500
    assert display.range_label() == "All time" and display.range_label(last_s=3600) == "Last 1h"
    assert display.range_label("2005-06-20 13:00", "2005-06-20 14:00") == "2005-06-20 13:00 – 14:00" and display.range_label("2005-06-20 13:00", "") == "From 2005-06-20 13:00"
    assert display.range_label("", "2005-06-21") == "Until 2005-06-21" and display.range_label("2005-06-20 13:00", "2005-06-21 14:00") == "2005-06-20 13:00 – 2005-06-21 14:00"
    assert display.range_problem("2005-06-20 13:00", "2005-06-20 14:00") is None and display.range_problem("", "") is None
    assert display.range_problem("soon", "")[0] == "from" and display.range_problem("2005-06-20 13:00", "2005-06-20 12:00")[0] == "to"
    day = 86_400 * 10**9
    assert display.range_problem("2005-06-20 13:00", "", (day, 2 * day))[0] == "from" and display.range_problem("", "1970-01-01 12:00", (day, 2 * day))[0] == "to"
    assert [bloom.hashes(t) for t in ("", "a", "tag:é=日本", "x" * 300)] == list(zip(*map(lambda v: v.tolist(), bloom.hash_pairs(["", "a", "tag:é=日本", "x" * 300])), strict=True))


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "a.log").write_text("one red line\ntwo blue lines\n")
    at = ["--store", f"file://{tmp_path}/store"]
    assert cli.main([*at, "ingest", str(tmp_path / "a.log")]) == 0
    assert cli.main([*at, "search", "blue", "--json"]) == 0
    assert cli.main([*at, "search", "red"]) == 0 and cli.main([*at, "stats"]) == 0 and cli.main([*at, "compact"]) == 0 and cli.main([*at, "gc"]) == 0
    out = capsys.readouterr().out
    assert out.startswith("2 lines\n") and '"message": "two blue lines"' in out and "one red line" in out and '"lines": 2' in out
    assert cli.main([*at, "search", "x" * 5000]) == 1


def test_a_large_segment_is_sorted_by_many_tasks(spark, tmp_path, monkeypatch):
    """no task sorts more than about TASK_LINES lines, and lines have the numbers of one sort; many equal times too."""
    monkeypatch.setattr(seg, "TASK_LINES", 400)
    e = store(spark, tmp_path)
    lines = spark.range(3000).select((F.col("id") % 7 * F.when(F.col("id") < 2000, 0).otherwise(1) + 5).alias("ts_ns"), F.concat(F.lit("w"), "id").alias("message"), F.create_map(F.lit("k"), (F.col("id") % 3).cast("string")).alias("tags"), F.col("id").alias("arrival_seq"), F.when(F.col("id") < 2500, 0).otherwise(1 + F.col("id") % 2).alias("g"))
    made, tags = seg.write(spark, e.manifest.files, lines, group="g")
    assert [s.entry_count for s in made] == [2500, 250, 250] and tags == [("k", "0"), ("k", "1"), ("k", "2")]
    for g, s in enumerate(made):
        own = seg.read(spark, e.manifest.files, [s.storage_key]).orderBy("line_no").collect()
        want = sorted((r.ts_ns, r.arrival_seq) for r in lines.where(F.col("g") == g).collect())
        assert [(r.ts_ns, r.arrival_seq) for r in own] == want and [r.line_no for r in own] == list(range(len(want)))
        assert (s.min_ts, s.max_ts) == (want[0][0], want[-1][0])
        seg.verify(spark, e.manifest.files, s)
    per_file = seg.read(spark, e.manifest.files, [made[0].storage_key]).groupBy(F.input_file_name()).count().collect()
    assert len(per_file) >= 5 and max(r["count"] for r in per_file) < 800


def test_filters_from_hashes(spark, tmp_path, monkeypatch):
    """filters are built from hashes in streams, and are those of the terms; beyond MAX_BLOOM_TERMS there is none."""
    e = store(spark, tmp_path)
    lines = spark.range(900).select(F.col("id").alias("ts_ns"), F.concat(F.lit("\u65e5\u672c w"), "id").alias("message"), F.create_map(F.lit("k"), F.lit("v")).alias("tags"), F.col("id").alias("arrival_seq"), F.when(F.col("id") < 100, 0).otherwise(1).alias("g"))
    monkeypatch.setattr(seg, "MAX_BLOOM_TERMS", 500)
    made, _ = seg.write(spark, e.manifest.files, lines, group="g")
    own = {r.segment_id: bytes(r.bloom) for r in spark.read.parquet(f"{e.manifest.files.root}/{made[0].filters}").collect()}
    words = ["\u65e5\u672c", *(f"w{i}" for i in range(100)), "tag:k=v"]
    assert own == {made[0].id: bloom.build(words), made[1].id: b""} and made[1].filter_bytes == 0
    assert bloom.passed(own[made[0].id], [*words, "nosuch"]).tolist() == [bloom.may_contain(own[made[0].id], w) for w in [*words, "nosuch"]]


def test_many_small_segments_are_listed_by_few_tasks(spark, tmp_path, monkeypatch):
    """reading many segments starts no task for each of their folders, and the setting is as it was afterwards."""
    monkeypatch.setattr(seg, "LISTERS", 3)
    e, own = store(spark, tmp_path), spark.conf.get(seg._PARALLEL)
    lines = some(spark, 200).withColumn("g", F.col("arrival_seq") % 40)
    made, _ = seg.write(spark, e.manifest.files, lines, group="g")
    with seg.listed(spark, len(made)):
        assert spark.conf.get(seg._PARALLEL) == "3"
    assert spark.conf.get(seg._PARALLEL) == own and seg.read(spark, e.manifest.files, [s.storage_key for s in made]).count() == 200
    assert not list(Path(f"{tmp_path}/store/segments").rglob("*.crc"))


def test_probes_of_many_terms_are_those_of_one():
    """a filter is probed for all terms at once; a missing one excludes nothing."""
    f, words = bloom.build(f"w{i}" for i in range(300)), [f"w{i}" for i in range(250, 2000)] + ["", "\u65e5"]
    assert bloom.passed(f, words).tolist() == [bloom.may_contain(f, w) for w in words]
    assert bloom.passed(None, words).all() and bloom.passed(f, []).tolist() == []
