import random

import pytest
from pyspark.sql import functions as F

from quarrylog.engine import Engine
from quarrylog.functions.text import tokenize
from quarrylog.operators import segments as seg
from quarrylog.operators.compaction import pick_batch
from quarrylog.operators.manifest import Segment
from quarrylog.schema import BufferFull, Conflict, IdentityMismatch, InvalidEntry, InvalidRequest, SegmentMissing, Settings

LINES = "ts_ns long, message string, tags map<string,string>, arrival_seq long"


def store(spark, tmp_path, **settings):
    return Engine(spark, f"file://{tmp_path}/store", Settings(**settings))


def frame(spark, rows):
    return spark.createDataFrame([(t, m, dict(tags), i) for i, (t, m, tags) in enumerate(rows)], LINES)


def test_random_searches_against_brute_force(spark, tmp_path):
    rng, words = random.Random(7), ["alpha", "beta", "gamma", "ERR", "timeout", "ok", "db", "42"]
    e, every = store(spark, tmp_path), []
    for _ in range(3):
        rows = [(rng.randrange(1, 400) + 1000, " ".join(rng.choices(words, k=rng.randrange(0, 6))), {"svc": f"s{rng.randrange(3)}"} if rng.random() < 0.5 else {}) for _ in range(rng.randrange(60, 90))]
        s = e.ingest(frame(spark, rows))[0]
        every += [(t, s.min_ts, s.id, i, m, tags) for i, (t, _, m, tags) in enumerate(sorted(((t, k, m, tags) for k, (t, m, tags) in enumerate(rows)), key=lambda r: r[:2]))]
    for _ in range(12):
        text = " ".join(rng.choices([*words, "absent"], k=rng.randrange(0, 3)))
        tags = {"svc": f"s{rng.randrange(4)}"} if rng.random() < 0.4 else {}
        lo, hi = (rng.randrange(1000, 1300), rng.randrange(1300, 1500)) if rng.random() < 0.5 else (0, 0)
        limit, newest = rng.choice([3, 50, 1000]), rng.random() < 0.5
        want = sorted((r for r in every if set(tokenize(text)) <= set(tokenize(r[4])) and all(r[5].get(k) == v for k, v in tags.items()) and (not lo or lo <= r[0] < hi)), key=lambda r: r[:4], reverse=newest)
        got = e.search(text, tags, lo, hi, limit, newest)
        assert [(h["ts_ns"], h["message"], h["tags"]) for h in got.hits] == [(r[0], r[4], r[5]) for r in want[:limit]]
        assert got.truncated == (len(want) > limit)
        assert (got.histogram.total if got.histogram else 0) == len(want)
        assert sum(o.hits for o in got.outcomes) == len(got.hits) and len(got.outcomes) == 3


def test_pruning_retry_and_missing(spark, tmp_path):
    e = store(spark, tmp_path)
    for i in range(3):
        e.ingest(frame(spark, [(i * 1000 + j + 1, f"common seg{i} line{j}", {"env": "prod"} if j % 2 == 0 else {}) for j in range(20)]))
    r = e.search("seg1")
    assert r.metrics["scanned"] == 1 and r.metrics["skipped_by_bloom"] == 2 and len(r.hits) == 20
    assert e.search("common", {}, 1, 900).metrics["skipped_by_time"] == 2
    assert e.search("nothere").histogram.total == 0
    gone = e.manifest.snapshot().ordered()[0]
    e.manifest.files.delete(gone.storage_key)
    with pytest.raises(SegmentMissing):
        e.search("common")


def test_requests_and_entries_are_checked(spark, tmp_path):
    e = store(spark, tmp_path, buffer_bytes=100)
    for bad in ({"limit": 10_001}, {"text": "x" * 4097}, {"from_ns": -1}, {"from_ns": 10, "to_ns": 5}, {"from_ns": 10, "to_ns": 10}):
        with pytest.raises(InvalidRequest):
            e.search(**bad)
    for key in ("", "a=b"):
        with pytest.raises(InvalidEntry):
            e.add_batch([(1, "m", {key: "v"})])
        with pytest.raises(InvalidEntry):
            e.ingest(frame(spark, [(1, "ok", {}), (1, "m", {key: "v"})]))
    assert e.stats()["lines"] == 0 and e.search("").hits == []
    e.add_batch([(0, "a", {})])
    assert e.pending[0][0] > 0
    e.add_batch([(1, "b" * 200, {})])
    assert not e.pending and e.stats()["lines"] == 2
    e.pending = [(1, "x" * 500, {})]
    with pytest.raises(BufferFull):
        e.add_batch([(1, "c", {})])


def test_compaction_keeps_every_line_once(spark, tmp_path):
    e = store(spark, tmp_path, min_segments=2, max_segments=3)
    for i in range(4):
        e.ingest(frame(spark, [(100 + j, f"s{i}-l{j} common", {"n": str(j % 3)}) for j in range(10)]))
    before = [(h["ts_ns"], h["message"]) for h in e.search("common").hits]
    new = e.compact()
    assert new.generation == 1 and new.entry_count == 30 and e.compact().generation == 2 and e.compact() is None
    after = [(h["ts_ns"], h["message"]) for h in e.search("common").hits]
    assert sorted(after) == sorted(before) and len(after) == 40
    assert [x["kind"] for x in e.events.rows].count("Merged") == 2 and e.tags()["n"]["values"] == ["0", "1", "2"]
    # an old unlisted segment goes; a young one and a foreign name stay
    old, young = seg.new_id(1), seg.new_id()
    old, young = f"id={old}", f"id={young}"
    for n in (old, young, "README.txt"):
        e.manifest.files.create(f"segments/{n}/x", "x")
    assert e.collect().orphans == [old]
    assert {young, "README.txt"} <= {n for n, _, _ in e.manifest.files.list("segments")}


def test_manifest_swaps_and_identity(spark, tmp_path):
    e = store(spark, tmp_path)
    a, b = (Segment(f"{i:016x}-0000000{i}", f"segments/{i}", i, i + 1, 1, 1, i) for i in (1, 2))
    e.manifest.add(a)
    with pytest.raises(Conflict):
        e.manifest.add(a)
    with pytest.raises(Conflict):
        e.manifest.replace([b], ["unknown"])
    assert [s.id for s in e.manifest.snapshot().ordered()] == [a.id]
    e.manifest.replace([b], [a.id])
    assert [s.id for s in e.manifest.snapshot().ordered()] == [b.id] and e.manifest.purge([a.id, b.id]) == 1
    plan = [("a", 0, 9), ("b", 10, 19)]
    segs = [Segment(n, n, lo, hi, 1, 1, 0) for n, lo, hi in plan]
    for (lo, hi), want in {(0, 100): "ab", (10, 20): "b", (9, 10): "a", (19, 20): "b", (20, 30): "", (-50, 0): "", (5, 15): "ab"}.items():
        assert "".join(s.id for s in segs if e.manifest.overlaps(s, lo, hi)) == want
    assert store(spark, tmp_path).identity == e.identity
    e.manifest.files.delete("IDENTITY")
    with pytest.raises(IdentityMismatch):
        store(spark, tmp_path)
    assert store(spark, tmp_path, adopt=True).identity == e.identity


def test_pick_batch_rules():
    s = Settings(small_bytes=10, target_bytes=20, min_segments=2, max_segments=3)
    own = lambda *sizes: [Segment(str(i), str(i), i, i, 1, n, 0) for i, n in enumerate(sizes)]
    ids = lambda x: "".join(y.id for y in x)
    assert ids(pick_batch(own(5, 12, 6, 9, 1), s)) == "023"
    assert ids(pick_batch(own(9, 9, 9, 1), s)) == "01" and pick_batch(own(5, 12), s) == []
    assert ids(pick_batch(own(5, 5, 5, 5), s)) == "012" and ids(pick_batch(own(5, 5, 5), s, {"0"})) == "12"


def test_stream_and_tail(spark, tmp_path):
    e = store(spark, tmp_path)
    src = tmp_path / "in"
    frame(spark, [(10**12 + i, f"old {i}", {"k": "v"}) for i in range(5)]).write.parquet(str(src))
    run = lambda: e.ingest_stream(spark.readStream.schema(LINES).parquet(str(src)), str(tmp_path / "cp"), available_now=True).awaitTermination()
    run()
    assert e.stats()["lines"] == 5
    t, resumed = e.tail(), e.tail(after_ns=10**12 + 2)
    assert t.tick() == ([], False)
    assert [h["message"] for h in resumed.tick()[0]] == ["old 4", "old 3"]
    frame(spark, [(10**12 + 100 + i, f"new {i}", {"k": "v"}) for i in range(4)]).write.mode("append").parquet(str(src))
    run()
    assert e.stats()["lines"] == 9
    assert [h["message"] for h in t.tick()[0]] == ["new 3", "new 2", "new 1", "new 0"] and t.tick() == ([], False)


def test_sources(spark, tmp_path):
    from quarrylog.sources import logs

    lines = ["- 1117838570 2005.06.03 R02-M1-N0-C:J12-U11 2005-06-03-15.42.50.363779 R02-M1-N0-C:J12-U11 RAS KERNEL INFO instruction cache parity error corrected", "KERNDTLB 1117838573 2005.06.03 R02 2005-06-03-15.42.53.276129 R02 RAS KERNEL FATAL data TLB error", "", "too few fields", "- 1 2 3 not-a-time 5 6 7 8"]
    good, counts = logs.bgl(spark.createDataFrame([(x,) for x in lines], "value string"))
    rows = good.orderBy("ts_ns").collect()
    assert tuple(counts.first()) == (2, 3)
    assert rows[0].ts_ns == 1117813370363779000 and rows[0].tags == {"component": "KERNEL", "level": "INFO"}
    assert rows[1].tags == {"component": "KERNEL", "level": "FATAL", "alert": "KERNDTLB"} and rows[1].message.startswith("2005.06.03 R02")
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    assert [r.message for r in logs.plain_text(spark, str(tmp_path / "a.txt")).collect()] == ["one", "two"]
    sizes = frame(spark, [(1, "é", {"a": "bc"}), (1, "", {})]).select(logs.entry_size(F.col("message"), F.col("tags")).alias("n")).collect()
    assert [r.n for r in sizes] == [13, 8]


def test_cases_windows_and_points(spark, tmp_path):
    from quarrylog.operators import benchmark, stats
    from quarrylog.sources import logs

    e = store(spark, tmp_path)
    lines = logs.generated(spark, 400, "run0000cafe", parts=2)
    e.ingest(lines)
    assert lines.orderBy("arrival_seq").first() == logs.generated(spark, 400, "run0000cafe", parts=3).orderBy("arrival_seq").first()
    own = benchmark.cases(e, ("level", "INFO"), ("level", "FATAL"))
    assert len(own) == 7
    got = {c.name: benchmark.run(e, benchmark.Case(c.name, c.text, c.tags, c.window, 1), 0) for c in (own[0], own[5], own[6])}
    assert got["word not in the data"]["hits"] == 0 and got["rare word, all history"]["hits"] > 0
    assert benchmark.sampled_lines_found(e, lines, 3) == (3, 3) and benchmark.settle(e) == 0
    assert [benchmark.nearest_rank(list(range(1, 101)), p) for p in (50, 99, 100, 1)] == [50, 99, 100, 1] and benchmark.nearest_rank([], 50) == 0
    s = e.manifest.snapshot().ordered()[0]
    assert seg.entry(spark, e.manifest.files, s, 0)["ts_ns"] == s.min_ts and seg.entry(spark, e.manifest.files, s, 400) is None
    reply = e.search("nosuchword").as_json()
    assert reply["hits"] == [] and reply["outcomes"][0]["outcome"] == "skipped_by_bloom"
    sent = spark.createDataFrame([(0, i, 100 + i // 5) for i in range(15)], "source int, seq int, bucket int")
    found = sent.where("seq NOT IN (2, 3, 7)").select("source", "seq")
    cut = spark.createDataFrame([(101,)], "bucket int")
    assert [tuple(r) for r in stats.loss_by_window(sent, found.union(found), cut).orderBy("bucket").collect()] == [(100, 5, 3, "lost"), (101, 5, 4, "unverifiable"), (102, 5, 5, "verified")]
    assert [tuple(r) for r in stats.lost_ranges(sent, found).orderBy("first_seq").collect()] == [(0, 2, 3, 2), (0, 7, 7, 1)]


def test_large_ingest_makes_several_segments_in_one_pass(spark, tmp_path):
    from quarrylog.sources import logs

    e = store(spark, tmp_path, buffer_bytes=10_000)
    lines = logs.generated(spark, 600, "run0000cafe", late_fraction=0.2, late_max_s=5)
    made = e.ingest(lines)
    assert len(made) >= 4 and sum(s.entry_count for s in made) == 600 == e.lines().count()
    for r in e.lines().groupBy("segment_id").agg(F.min("line_no"), F.max("line_no"), F.count_distinct("line_no"), F.count("*")).collect():
        assert r[1] == 0 and r[2] + 1 == r[3] == r[4]
    found = e.search("", {}, limit=1000).hits
    assert sorted(h["message"] for h in found) == sorted(r.message for r in lines.collect())
    assert [h["ts_ns"] for h in found] == sorted(h["ts_ns"] for h in found)
    assert e.search("run0000cafe").metrics["scanned"] == len(made) and e.search("absentword").metrics["scanned"] == 0
