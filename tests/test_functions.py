import pytest

from quarrylog.functions import bloom, display, text
from quarrylog.operators.histogram import SECOND, WIDTHS, axis
from quarrylog.operators.manifest import add_tags, valid_key
from quarrylog.operators.segments import created_at, new_id
from quarrylog.schema import InvalidRequest, Settings
from quarrylog.streaming.ingest import Events, Rate


def test_tokens_of_literals():
    assert text.tokenize("Connection RESET by peer: 10.0.0.1, user=Zoë_42") == ["connection", "reset", "by", "peer", "10", "0", "0", "1", "user", "zoë", "42"]
    assert text.tokenize("ΟΔΟΣ") == ["οδοσ"] and text.tokenize("İSTANBUL") == ["istanbul"] and text.tokenize("") == []
    assert text.query_terms("b a B", {"z": "1", "k": "v"}) == ["b", "a", "tag:k=v", "tag:z=1"]


def test_column_tokens_agree_with_literals(spark):
    from pyspark.sql import functions as F

    samples = ["Connection RESET by peer: 10.0.0.1, user=Zoë_42", "ΟΔΟΣ İstanbul", "", "①② ٣٤ ẞ", "error error ERROR"]
    rows = spark.createDataFrame([(s,) for s in samples], "s string").select("s", text.tokens(F.col("s")).alias("t")).collect()
    for r in rows:
        assert r.t == list(dict.fromkeys(text.tokenize(r.s)))


def test_query_box():
    assert text.parse_query("  parity  error level=FATAL component=APP ") == ("parity error", [("level", "FATAL"), ("component", "APP")])
    assert text.parse_query("=x a=b=c") == ("=x", [("a", "b=c")])
    with pytest.raises(InvalidRequest):
        text.tag_filter([("level", "FATAL"), ("level", "INFO")])
    assert text.tag_filter([("level", "FATAL"), ("level", "FATAL")]) == {"level": "FATAL"}
    assert text.toggle_tag("a k=v", "k", "v") == "a" and text.toggle_tag("a", "k", "v") == "a k=v"


def test_highlight_and_suggest():
    runs = text.highlight("ciod: Error loading /p/hangtest_062005, ERRORS", {"error", "hangtest"})
    assert [t for t, hit in runs if hit] == ["Error", "hangtest"] and "".join(t for t, _ in runs) == "ciod: Error loading /p/hangtest_062005, ERRORS"
    tags = {"component": ["APP", "KERNEL"], "level": ["FATAL", "INFO", "WARNING"]}
    assert text.suggest("parity lev", tags) == ["level="]
    assert text.suggest("level=w", tags) == ["level=WARNING"]
    assert text.suggest("fatal", tags) == ["level=FATAL"] and text.suggest("k", tags) == ["component=KERNEL"]
    assert text.suggest("level=INFO", tags) == []


def test_markers():
    assert text.MARKER.search("x ~runcafe0001.5.77").groups() == ("runcafe0001", "5", "77")
    for bad in ("", "no marker", "~runcafe0001.1", "x ~runzzzzzzzz.1.2", "~runcafe0001.1.2 trailing"):
        assert not text.MARKER.search(bad)


def test_times_and_numbers():
    assert display.parse_time("") == 0 and display.parse_time("123") == 123
    assert display.parse_time("2024-01-05T00:00:00.000000001Z") == 1_704_412_800_000_000_001
    for bad in ("tomorrow", "2024-02-30T00:00:00Z"):
        with pytest.raises(InvalidRequest):
            display.parse_time(bad)
    with pytest.raises(InvalidRequest):
        display.parse_page_time("2024-02-30")
    assert display.parse_page_time("2024-01-05") == display.parse_page_time("2024-01-05T00:00") == 1_704_412_800_000_000_000
    assert display.parse_duration("15m") == 900 and display.duration_label(604800) == "7d"
    newest = display.parse_page_time("2006-01-04T08:00:30")
    assert display.last_range(newest, 3600)[0] == display.parse_page_time("2006-01-04T07:01")
    assert [display.human_bytes(n) for n in (0, 1023, 1024, 5 << 20, 3 << 30)] == ["0 B", "1023 B", "1.0 KiB", "5.0 MiB", "3.0 GiB"]
    shares = [((26.4, 1016), "97%"), ((15.3, 1017), "98%"), ((5, 1000), "99.5%"), ((1, 1e6), "over 99.9%"), ((0, 1016), "100%"), ((1016, 1016), "0%"), ((5, 0), None)]
    assert all(display.avoided_share(*a) == e for a, e in shares)
    assert display.skip_bar(1000, 0, 1).count("#") == 1 and len(display.skip_bar(3, 2, 1)) == 62


def test_bloom():
    terms = [f"term{i}" for i in range(5000)]
    f = bloom.build(terms)
    assert all(bloom.may_contain(f, t) for t in terms)
    assert sum(bloom.may_contain(f, f"other{i}") for i in range(10_000)) <= 200
    for bad in (b"", b"12345", f[:-1], f + b"x", b"\0\0\0\0" + f[4:]):
        assert bloom.read(bad) is None and bloom.may_contain(bad, "anything")
    assert bloom.read(bloom.build([], -1)) is not None
    assert bloom.parameters(0) == bloom.parameters(1) and bloom.parameters(1000)[1] == 7


def test_histogram_axes():
    s = SECOND
    for span, width, n in ((1500, 15, 100), (3600, 60, 60), (86400, 900, 96), (215 * 86400, 3 * 86400, 72)):
        h = axis([(0, span * s - 1)], -(1 << 63), 1 << 62)
        assert h.width == width * s and abs(len(h.counts) - n) <= 1
    assert axis([], 0, 10) is None and axis([(5, 6)], 10, 20) is None
    long = axis([(-8_520_000_000 * s, 7_289_000_000 * s)], -(1 << 63), 1 << 63)
    assert len(long.counts) <= 100 and long.width > WIDTHS[-1] and long.start % long.width == 0


def test_names_tags_settings_events():
    a = new_id(5)
    assert created_at(f"id={a}") == 5 and created_at(f"segments/id={a}") == 5 and created_at("README.txt") is None
    assert valid_key("a/b") and not any(map(valid_key, ("", "/a", "a//b", "../x", "a\\b", "a\0b")))
    tags = {}
    add_tags(tags, [("request", f"{i:03d}") for i in range(266)])
    assert len(tags["request"]["values"]) == 256 and tags["request"]["capped"]
    add_tags(tags, [(f"k{i}", "v") for i in range(80)])
    assert len(tags) == 64
    with pytest.raises(InvalidRequest):
        Settings(min_segments=1)
    assert Settings.resolve({"buffer_bytes": 7}, {"QUARRYLOG_BUFFER_BYTES": "9", "QUARRYLOG_ADOPT": "true"}) == Settings(buffer_bytes=7, adopt=True)
    with pytest.raises(InvalidRequest):
        Settings.resolve({}, {"QUARRYLOG_BUFFER_BYTES": "many"})
    e = Events(3)
    for i in range(5):
        e.add("Sealed", segment=str(i))
    assert [r["seq"] for r in e.since(3)] == [4, 5] and len(e.rows) == 3
    r = Rate(10)
    for t in range(26):
        r.add(t, min(t, 20) * 100)
    assert r.value() == 50
