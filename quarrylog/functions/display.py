"""Times, ranges and numbers as people write and read them."""

from __future__ import annotations

import math
import re
from datetime import UTC, datetime, timedelta

from ..schema import InvalidRequest

_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


def _ns(t: datetime, fraction: str = "") -> int:
    whole = (t.replace(microsecond=0) - _EPOCH) // timedelta(seconds=1)
    return whole * 1_000_000_000 + int((fraction + "0" * 9)[:9])


def parse_rfc3339(s: str) -> int:
    """Nanoseconds of an RFC 3339 time, with up to nine digits of a fraction."""
    m = re.fullmatch(r"(\d{4}-\d\d-\d\d)[Tt](\d\d:\d\d:\d\d)(?:\.(\d{1,9}))?([Zz]|[+-]\d\d:\d\d)", s)
    if not m:
        raise InvalidRequest(f"not a time: {s!r}")
    zone = "+00:00" if m[4] in "Zz" else m[4]
    try:
        return _ns(datetime.fromisoformat(f"{m[1]}T{m[2]}{zone}"), m[3] or "")
    except ValueError as e:
        raise InvalidRequest(f"not a time: {s!r}") from e


def parse_time(s: str) -> int:
    """Command line: empty is 0 (unbounded), digits are nanoseconds, else RFC 3339."""
    if not s:
        return 0
    return int(s) if re.fullmatch(r"-?\d+", s) else parse_rfc3339(s)


def parse_page_time(s: str) -> int:
    """Page: RFC 3339, a local date and time (as UTC), or a date. Impossible dates are refused."""
    for form in ("%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M", "%Y-%m-%d"):
        try:
            return _ns(datetime.strptime(s, form).replace(tzinfo=UTC))
        except ValueError:
            pass
    return parse_rfc3339(s)


def parse_duration(s: str) -> int:
    """Seconds of 15m, 1h or 7d."""
    m = re.fullmatch(r"([1-9]\d*)([smhd])", s)
    if not m:
        raise InvalidRequest(f"not a duration: {s!r}")
    return int(m[1]) * _UNITS[m[2]]


def duration_label(seconds: int) -> str:
    for unit in ("d", "h", "m"):
        if seconds and seconds % _UNITS[unit] == 0:
            return f"{seconds // _UNITS[unit]}{unit}"
    return f"{seconds}s"


def range_label(start: str = "", end: str = "", last_s: int = 0) -> str:
    """A range of time in words: all of it, the last so long, or from and to, with the date once where both are of one day."""
    start, end = start.strip(), end.strip()
    if last_s:
        return f"Last {duration_label(last_s)}"
    if start and end:
        return f"{start} – {end[11:] if start[:10] == end[:10] and len(end) > 10 else end}"
    return f"From {start}" if start else f"Until {end}" if end else "All time"


def range_problem(start: str, end: str, stored: tuple[int, int] | None = None) -> tuple[str, str] | None:
    """Which bound of a range is wrong, and why; stored: the first and last nanosecond that there are lines of."""
    at = {}
    for side, text in (("from", start), ("to", end)):
        try:
            at[side] = parse_page_time(text.strip().replace(" ", "T", 1)) if text.strip() else 0
        except (InvalidRequest, ValueError):
            return side, f"{text.strip()!r} is no time; write it as 2005-06-20 13:00, in UTC"
    if at["from"] and at["to"] and at["to"] <= at["from"]:
        return "to", "the end does not come after the start"
    if stored:
        if at["from"] > stored[1]:
            return "from", f"no stored line is so late; the last is of {iso(stored[1])}"
        if at["to"] and at["to"] < stored[0]:
            return "to", f"no stored line is so early; the first is of {iso(stored[0])}"
    return None


def last_range(newest_ns: int, seconds: int) -> tuple[int, int]:
    """The last so many seconds before the newest stored line, whose minute is rounded up; the end is open."""
    minute = 60_000_000_000
    top = -(-newest_ns // minute) * minute
    return top - seconds * 1_000_000_000, 0


def clip_range(from_ns: int, to_ns: int, min_ts: int, max_ts: int) -> tuple[int, int]:
    """A query's range within what is stored."""
    return max(from_ns or min_ts, min_ts), min(to_ns or max_ts + 1, max_ts + 1)


def iso(ns: int) -> str:
    return (_EPOCH + timedelta(microseconds=ns // 1000)).strftime("%Y-%m-%dT%H:%M:%S.") + f"{ns % 1_000_000_000:09d}Z"


def human_bytes(n: int) -> str:
    if n < 1024:
        return f"{n} B"
    value, units = float(n), ["KiB", "MiB", "GiB", "TiB", "PiB"]
    for unit in units:
        value /= 1024
        if value < 1024 or unit == units[-1]:
            return f"{value:.1f} {unit}"
    raise AssertionError


def skip_bar(by_time: int, by_bloom: int, scanned: int, width: int = 60) -> str:
    """'.' skipped by time, '-' by bloom filter, '#' scanned; at least one '#' if anything was."""
    total = by_time + by_bloom + scanned
    if not total:
        return "[" + " " * width + "]"
    hashes = max(1, round(width * scanned / total)) if scanned else 0
    dashes = min(width - hashes, round(width * by_bloom / total))
    dots = width - hashes - dashes
    return "[" + "." * dots + "-" * dashes + "#" * hashes + "]"


def avoided_share(read: float, stored: float) -> str | None:
    """How much of what is stored a search needn't read, never overstated."""
    if stored <= 0 or read > stored:
        return None
    share = 100 * (1 - read / stored)
    if not read:
        return "100%"
    if share >= 99.9:
        return "over 99.9%"
    return f"{math.floor(share * 10) / 10:g}%" if share >= 99 else f"{math.floor(share)}%"


def last_ns_of_micros(ns_micros: int) -> int:
    """The last nanosecond of a microsecond."""
    return ns_micros * 1000 + 999


def to_url(query: dict) -> str:
    """A search as the query string of a link; defaults are left out."""
    from urllib.parse import urlencode

    return urlencode({k: v for k, v in query.items() if v not in ("", None, False, 0)})


def from_url(link: str) -> dict[str, str]:
    from urllib.parse import parse_qsl

    return dict(parse_qsl(link.lstrip("?")))


def event_text(e: dict) -> str:
    """One thing that happened, in words."""
    n = e.get("lines") or 0
    if e["kind"] == "Sealed":
        return f"sealed {n} lines, {human_bytes(e.get('bytes') or 0)}"
    return f"merged into a segment of {n} lines" if e["kind"] == "Merged" else "removed files that nothing needs"


def nice_ceiling(n: float) -> float:
    """The least 1, 2 or 5 times a power of ten that n doesn't exceed."""
    if n <= 1:
        return 1
    p = 10 ** math.floor(math.log10(n))
    return next(m * p for m in (1, 2, 5, 10) if m * p >= n)
