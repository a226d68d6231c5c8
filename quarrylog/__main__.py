"""Command line: ingest text or BGL files into a store, search it, show it, compact it."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from .engine import Engine
from .functions.display import human_bytes, iso, parse_time, skip_bar
from .functions.text import parse_query, tag_filter
from .schema import CLI_LIMIT, LogError, Settings
from .sources import logs


def main(argv: list[str]) -> int:
    p = argparse.ArgumentParser(prog="quarrylog", description=__doc__)
    p.add_argument("--store", required=True)
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("ingest")
    i.add_argument("path")
    i.add_argument("--format", choices=("text", "bgl"), default="text")
    s = sub.add_parser("search")
    s.add_argument("query", nargs="*")
    s.add_argument("--from", dest="start", default="")
    s.add_argument("--to", dest="end", default="")
    s.add_argument("--limit", type=int, default=CLI_LIMIT)
    s.add_argument("--newest", action="store_true")
    s.add_argument("--json", action="store_true")
    for name in ("stats", "compact", "gc"):
        sub.add_parser(name)
    a = p.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        e = Engine(spark, a.store, Settings.resolve({}, dict(os.environ)))
        if a.command == "ingest":
            lines = logs.plain_text(spark, a.path) if a.format == "text" else logs.bgl(spark.read.text(a.path))[0]
            print(f"{sum(x.entry_count for x in e.ingest(lines))} lines")
        elif a.command == "search":
            text, tags = parse_query(" ".join(a.query))
            r = e.search(text, tag_filter(tags), parse_time(a.start), parse_time(a.end), a.limit, a.newest)
            for h in r.hits:
                print(json.dumps(h, ensure_ascii=False) if a.json else f"{iso(h['ts_ns'])} {h['message']} {h['tags']}")
            m = r.metrics
            if not a.json:
                print(skip_bar(m["skipped_by_time"], m["skipped_by_bloom"], m["scanned"]), f"{m['scanned']} of {m['segments_considered']} segments, {human_bytes(m['bytes_read'])}", "(more lines match)" if r.truncated else "")
        elif a.command == "stats":
            print(json.dumps(e.overview(), ensure_ascii=False))
        elif a.command == "compact":
            while new := e.compact():
                print(f"merged into {new.id}: {new.entry_count} lines")
        else:
            print(e.collect())
    except LogError as err:
        print(f"{type(err).__name__}: {err}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
