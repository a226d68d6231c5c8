"""Tokens, tag terms, the query box and highlighting.

Tokens are maximal runs of letters (L) and decimal digits (Nd) of the lower-cased text. Lower-casing is by single code
points: the two letters whose full mapping differs (capital dotted I, capital sigma) are translated first.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import InvalidRequest

NOT_TOKEN = r"[^\p{L}\p{Nd}]+"


def lowered(col: Column) -> Column:
    return F.lower(F.translate(col, "\u0130\u03a3", "i\u03c3"))


def tokens(col: Column) -> Column:
    """The distinct tokens of a text, in order of appearance; null gives an empty array."""
    return F.array_distinct(F.filter(F.split(lowered(F.coalesce(col, F.lit(""))), NOT_TOKEN), lambda t: t != ""))


def tag_terms(tags: Column) -> Column:
    return F.transform(F.array_sort(F.map_entries(F.coalesce(tags, F.create_map().cast("map<string,string>")))), lambda e: F.concat(F.lit("tag:"), e["key"], F.lit("="), e["value"]))


def line_terms(message: Column, tags: Column) -> Column:
    return F.concat(tokens(message), tag_terms(tags))


def lower_text(s: str) -> str:
    return "".join(c.lower() for c in s.translate({0x130: "i", 0x3A3: "\u03c3"}))


def _in_token(c: str) -> bool:
    k = unicodedata.category(c)
    return k[0] == "L" or k == "Nd"


def tokenize(s: str) -> list[str]:
    """Tokens of a literal, with repeats."""
    out, run = [], []
    for c in lower_text(s):
        if _in_token(c):
            run.append(c)
        elif run:
            out.append("".join(run))
            run = []
    return out + (["".join(run)] if run else [])


def query_terms(text: str, tags: dict[str, str]) -> list[str]:
    """Distinct words in order, then tag terms by key."""
    return [*dict.fromkeys(tokenize(text)), *(f"tag:{k}={tags[k]}" for k in sorted(tags))]


def matches(message: Column, tags: Column, text: str, wanted: dict[str, str], terms: Column | None = None) -> Column:
    """All words of the text are tokens of the message, and all wanted tags are set so. No word and no tag: everything."""
    words = list(dict.fromkeys(tokenize(text)))
    cond = F.lit(True)
    own = terms if terms is not None else tokens(message)
    for w in words:
        cond = cond & F.array_contains(own, w)
    for k in sorted(wanted):
        cond = cond & F.coalesce(F.element_at(tags, F.lit(k)) == F.lit(wanted[k]), F.lit(False))
    return cond


def parse_query(box: str) -> tuple[str, list[tuple[str, str]]]:
    """White-space pieces; '=' after the first character makes a tag, split at the first '='."""
    words, tags = [], []
    for piece in box.split():
        at = piece.find("=")
        if at > 0:
            tags.append((piece[:at], piece[at + 1 :]))
        else:
            words.append(piece)
    return " ".join(words), tags


def tag_filter(tags: Iterable[tuple[str, str]]) -> dict[str, str]:
    out: dict[str, str] = {}
    for k, v in tags:
        if out.setdefault(k, v) != v:
            raise InvalidRequest(f"{k} can't be both {out[k]} and {v}")
    return out


def toggle_tag(box: str, key: str, value: str) -> str:
    """Add or take away the piece key=value."""
    piece, pieces = f"{key}={value}", box.split()
    return " ".join([p for p in pieces if p != piece] if piece in pieces else [*pieces, piece])


def highlight(text: str, words: Iterable[str]) -> list[tuple[str, bool]]:
    """The text in runs, each with whether it is a hit; the original case stays."""
    wanted, out, run, inside = set(words), [], [], False

    def close():
        if run:
            part = "".join(run)
            hit = inside and lower_text(part) in wanted
            if out and out[-1][1] == hit and not hit:
                out[-1] = (out[-1][0] + part, False)
            else:
                out.append((part, hit))

    for c in text:
        if bool(run) and _in_token(c) != inside:
            close()
            run = []
        inside = _in_token(c)
        run.append(c)
    close()
    return out


def highlight_hits(message: Column, words: list[str]) -> Column:
    """The hit runs of a message, in its own case."""
    runs = F.regexp_extract_all(message, F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))
    return F.filter(runs, lambda t: F.array_contains(F.array(*(F.lit(w) for w in words)).cast("array<string>"), lowered(t)))


def suggest(piece: str, catalogue: dict[str, list[str]], most: int = 8) -> list[str]:
    """Completions of the last piece of a query box: keys, values of a key, or any value."""
    last = piece.split(" ")[-1] if not piece.endswith(" ") else ""
    if not last:
        return []
    at, low, out = last.find("="), last.lower(), []
    if at > 0:
        key = last[:at]
        out = [f"{key}={v}" for v in catalogue.get(key, ()) if v.lower().startswith(last[at + 1 :].lower())]
    elif at < 0:
        out = [f"{k}=" for k in sorted(catalogue) if k.lower().startswith(low)]
        out += [f"{k}={v}" for k in sorted(catalogue) for v in catalogue[k] if v.lower().startswith(low)]
    return [x for x in out if x != last][:most]


MARKER = re.compile(r"~(run[0-9a-f]{8})\.(\d+)\.(\d+)$")


def marker(col: Column) -> Column:
    """run, source and seq of a generated line's marker; null without one."""
    rule = r"~(run[0-9a-f]{8})\.([0-9]+)\.([0-9]+)$"
    part = lambda i: F.regexp_extract(col, rule, i)
    return F.when(col.rlike(rule), F.struct(part(1).alias("run"), part(2).cast("long").alias("source"), part(3).cast("long").alias("seq")))
