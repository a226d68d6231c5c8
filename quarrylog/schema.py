"""Record types, limits and defaults."""

from __future__ import annotations

from dataclasses import dataclass

LINE = "ts_ns long, message string, tags map<string,string>"
STAGED = f"{LINE}, arrival_seq long"
STORED = f"{LINE}, terms array<string>, arrival_seq long, line_no int, segment_id string"

DEFAULT_LIMIT, MAX_LIMIT, CLI_LIMIT, PAGE_LIMIT, PAGE_MAX = 1000, 10_000, 20, 100, 1024
MAX_TEXT_BYTES, MAX_BATCH, MAX_OUTCOMES, MAX_SEARCHES = 4096, 10_000, 1000, 8
SEARCH_TIMEOUT_S, SEARCH_ATTEMPTS = 30.0, 3
MAX_TAG_KEYS, MAX_TAG_VALUES, MAX_SEGMENT_PAIRS = 64, 256, 1024
MAX_VIEWS, FILTER_CACHE_BYTES = 16, 64 << 20
BLOOM_P = 0.01
SYSTEM_SEGMENTS, EVENT_RING = 2000, 500
FLOOR, CEIL = -(1 << 63), (1 << 63) - 1


class LogError(Exception):
    """Base of what this engine refuses or reports."""


class InvalidRequest(LogError):
    pass


class InvalidEntry(LogError):
    pass


class BufferFull(LogError):
    pass


class Busy(LogError):
    pass


class Corrupt(LogError):
    pass


class SegmentMissing(LogError):
    pass


class Closed(LogError):
    """The engine takes no more entries."""


class SearchTimeout(LogError):
    """A search took longer than it may."""


class Conflict(LogError):
    """Another writer committed first, or a segment to be replaced is no longer active."""


class IdentityMismatch(LogError):
    pass


#: What a caller over HTTP gets, by the nearest class.
STATUS = {InvalidRequest: 400, InvalidEntry: 400, BufferFull: 429, Busy: 429, SearchTimeout: 504, Closed: 503, Conflict: 409, SegmentMissing: 503, Corrupt: 500, IdentityMismatch: 500}


def status(e: BaseException) -> tuple[int, str]:
    """The status and the explanation of an error; what this engine doesn't know is 500 and isn't shown."""
    for kind in type(e).__mro__:
        if kind in STATUS:
            return STATUS[kind], str(e) or kind.__name__
    return 500, "internal error"


def page_limit(asked: int | None) -> int:
    """Lines of a page: 100 if nothing is asked for, at most 1024."""
    if asked is not None and asked < 0:
        raise InvalidRequest("a limit is not negative")
    return min(asked or PAGE_LIMIT, PAGE_MAX)


@dataclass(frozen=True)
class Settings:
    """Tunable behaviour; names and defaults follow the operator inventory."""

    buffer_bytes: int = 4 << 20
    buffer_age_s: float = 5.0
    pending_factor: int = 4
    compact: bool = True
    compact_interval_s: float = 30.0
    small_bytes: int = 8 << 20
    target_bytes: int = 64 << 20
    min_segments: int = 4
    max_segments: int = 32
    gc_interval_s: float = 600.0
    orphan_grace_s: float = 600.0
    adopt: bool = False

    def __post_init__(self):
        if not 2 <= self.min_segments <= self.max_segments:
            raise InvalidRequest("2 <= min_segments <= max_segments is required")
        if self.target_bytes < self.small_bytes:
            raise InvalidRequest("target_bytes must not be below small_bytes")

    @classmethod
    def resolve(cls, flags: dict, env: dict, prefix: str = "QUARRYLOG_") -> Settings:
        """A flag goes before the environment, which goes before the default; a malformed value is an error."""
        out = {}
        for name, field in cls.__dataclass_fields__.items():
            kind = {"int": int, "float": float, "bool": lambda v: {"true": True, "1": True, "false": False, "0": False}[str(v).lower()]}[field.type]
            raw = flags.get(name, env.get(prefix + name.upper()))
            if raw is not None:
                try:
                    out[name] = kind(raw)
                except (KeyError, ValueError) as e:
                    raise InvalidRequest(f"{name}: {raw!r} is malformed") from e
        return cls(**out)
