"""URL filters: host-and-path rules first, then pattern rules indexed by their rarest literal token.

A pattern rule is a regular expression over the lower-cased url. The tokens (runs of a-z and 0-9) that every match must
hold as whole tokens are read off the expression itself: literals that are on its only path and that something other than
a letter or digit surrounds in any case. Each rule is filed under its rarest one, rarity being counted over all urls of
the table; a url's own tokens fetch the candidate rules, and only those run their expression. A rule without such a token
runs on every url. Rules and their tokens' counts are few and travel with the task; urls are never gathered.

Defined cases: a null url, or one without ://, has an empty host and path, fits no rule and is allowed unless a pattern
without :// matches it; repeated rows are judged alike; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path): fits the host and its subdomains where the url's path starts with the path.
HOST_RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


_ALNUM = frozenset(map(ord, "abcdefghijklmnopqrstuvwxyz0123456789"))
#: Stands for any character beyond ASCII, and for the end of the text on either side.
OTHER, EDGE = -1, -2
_ALL = frozenset([*range(128), OTHER])


def _chars(items) -> frozenset[int]:
    """What a class can match; characters beyond ASCII are one."""
    out: set[int] = set()
    negated = False
    for op, arg in items:
        name = str(op)
        if name == "NEGATE":
            negated = True
        elif name == "LITERAL":
            out.add(arg if arg < 128 else OTHER)
        elif name == "RANGE":
            out |= {c for c in range(arg[0], min(arg[1], 127) + 1)} | ({OTHER} if arg[1] > 127 else set())
        else:
            return _ALL
    return frozenset((_ALL - out) | {OTHER}) if negated else frozenset(out)


def _ends(seq, first: bool) -> tuple[frozenset[int], bool]:
    """What a sequence can begin (or end) with, and whether it can be empty."""
    out: frozenset[int] = frozenset()
    for op, arg in seq if first else reversed(seq):
        got, empty = _one(op, arg, first)
        out |= got
        if not empty:
            return out, False
    return out, True


def _one(op, arg, first: bool) -> tuple[frozenset[int], bool]:
    name = str(op)
    if name == "LITERAL":
        return frozenset([arg if arg < 128 else OTHER]), False
    if name == "NOT_LITERAL":
        return _ALL - {arg}, False
    if name == "ANY":
        return _ALL, False
    if name == "IN":
        return _chars(arg), False
    if name == "AT":
        # the start of the text before, its end after: nothing else can stand there
        fits = str(arg) in (("AT_BEGINNING", "AT_BEGINNING_STRING") if not first else ("AT_END", "AT_END_STRING"))
        return (frozenset([EDGE]), False) if fits else (frozenset(), True)
    if name == "SUBPATTERN":
        return _ends(list(arg[3]), first)
    if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        got, empty = _ends(list(arg[2]), first)
        return got, empty or arg[0] == 0
    if name == "BRANCH":
        each = [_ends(list(x), first) for x in arg[1]]
        return frozenset().union(*(x for x, _ in each)), any(e for _, e in each)
    return _ALL, True  # whatever else there is: anything


def required_tokens(regex: str) -> tuple[str, ...]:
    """The whole tokens of every text that the expression matches, as far as its outermost sequence shows them."""
    from re import _parser  # type: ignore[attr-defined]

    seq: list = []

    def flat(items) -> None:
        for op, arg in items:
            # a group that always runs once, without alternatives, is part of the sequence
            if str(op) == "SUBPATTERN" and arg[0] is not None and not arg[1] and not arg[2] and not any(str(o) == "BRANCH" for o, _ in arg[3]):
                flat(arg[3])
            else:
                seq.append((op, arg))

    flat(_parser.parse(regex))
    out, i = [], 0
    literal = lambda x: str(x[0]) == "LITERAL" and x[1] in _ALNUM
    while i < len(seq):
        if not literal(seq[i]):
            i += 1
            continue
        j = i
        while j < len(seq) and literal(seq[j]):
            j += 1
        before, open_before = _ends(seq[:i], False)
        after, open_after = _ends(seq[j:], True)
        if not open_before and not open_after and not (before | after) & _ALNUM:
            out.append("".join(chr(c) for _, c in seq[i:j]))
        i = j
    return tuple(dict.fromkeys(out))


@dataclass(frozen=True)
class Pattern:
    """A blocking expression over the lower-cased url."""

    regex: str

    @property
    def tokens(self) -> tuple[str, ...]:
        return required_tokens(self.regex)


def _rules() -> tuple[Pattern, ...]:
    """The default list: hosts and paths of unwanted kinds, tracking and redirect parameters, login and download traps."""
    labels = "casino adult poker betting lottery jackpot roulette slots pharmacy viagra cialis pills replica knockoff counterfeit warez keygen cracked torrent escort webcam xxx porn hentai payday loanshark clickbait scam phishing malware adware spyware botnet"
    paths = "free-download cheap-pills online-casino best-odds buy-followers earn-money work-from-home get-rich-quick weight-loss-miracle crypto-giveaway"
    params = "utm_source=spam utm_campaign=spam ref=affiliate aff_id=spam click_id=spam"
    traps = "wp-login.php xmlrpc.php wp-admin.php phpmyadmin.php shell.php"
    out = [rf"://([^/?#]*[.-])?{w}[.-]" for w in labels.split()] + [r"://([^/?#]*[.-])?spam-", r"://([^/?#]*[.-])?farm\."]
    out += [rf"/(tag|category|topic)/{p}([/?#]|$)" for p in paths.split()]
    out += [rf"[?&]{re.escape(p)}(&|#|$)" for p in params.split()] + [r"[?&]redirect=https?(:|%3a)", r"[?&]goto=https?(:|%3a)"]
    out += [rf"/{re.escape(t)}(\?|#|$)" for t in traps.split()] + [r"/[^/?#]*\.(exe|scr|apk)([?#]|$)"]
    return tuple(map(Pattern, out))


TOKEN = re.compile("[a-z0-9]+")
PATTERNS = _rules()


def token_counts(urls: DataFrame, patterns: Sequence[Pattern], col: str = "url") -> dict[str, int]:
    """In how many urls each rule token occurs: tokens of urls that are rule tokens, counted before they are shuffled."""
    tokens = sorted({t for p in patterns for t in p.tokens})
    if not tokens:
        return {}
    own = F.array_intersect(F.split(F.lower(F.coalesce(F.col(col), F.lit(""))), "[^a-z0-9]+"), F.lit(tokens))
    seen = urls.select(F.explode(own).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return {r["token"]: r["n"] for r in seen.collect()}


class PatternIndex:
    """Rules by rarest token."""

    def __init__(self, patterns: Sequence[Pattern], counts: dict[str, int]):
        self.by_token: dict[str, list[tuple[str, re.Pattern]]] = {}
        self.always: list[tuple[str, re.Pattern]] = []
        for p in patterns:
            tokens = p.tokens
            own = self.by_token.setdefault(min(tokens, key=lambda t: (counts.get(t, 0), t)), []) if tokens else self.always
            own.append((p.regex, re.compile(p.regex)))

    def match(self, url: str) -> str | None:
        """The expression of the first candidate rule that matches, by the order of the url's tokens; then the rules without one."""
        low = url.lower()
        for t in dict.fromkeys(TOKEN.findall(low)):
            for name, rule in self.by_token.get(t, ()):
                if rule.search(low):
                    return name
        return next((name for name, rule in self.always if rule.search(low)), None)


def host_and_path(url):
    """Host (A-Z lower-cased) and path as columns."""
    has = F.instr(url, "://") > 0
    rest = F.when(has, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, rules=HOST_RULES, patterns: Sequence[Pattern] = PATTERNS, key: str = "page_id", col: str = "url") -> DataFrame:
    """Each url's key, host, path, rule, pattern and verdict."""
    index = PatternIndex(patterns, token_counts(pages, patterns, col))
    host, path = host_and_path(F.col(col))
    base = pages.select(F.col(key).alias("page_id"), F.col(col).alias("url"), host.alias("host"), path.alias("path"))
    hit = F.lit(None).cast("string")
    rule = verdict = None
    for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):  # the longest rule that fits wins
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule = (F.when if rule is None else rule.when)(fits, F.lit(h + p))
        verdict = (F.when if verdict is None else verdict.when)(fits, F.lit(v))
    base = base.withColumns({"rule": hit if rule is None else rule, "ruled": hit if verdict is None else verdict})

    def run(batches):
        for rb in batches:
            urls, ruled = rb.column(1).to_pylist(), rb.column(5).to_pylist()
            found = [index.match(u) if u and not r else None for u, r in zip(urls, ruled, strict=True)]
            last = [r or ("block" if f else "allow") for r, f in zip(ruled, found, strict=True)]
            yield pa.RecordBatch.from_arrays([rb.column(0), *(rb.column(k) for k in (2, 3, 4)), pa.array(last, pa.string()), pa.array(found, pa.string())], ["page_id", "host", "path", "rule", "verdict", "pattern"])

    return base.mapInArrow(run, f"page_id {dict(base.dtypes)['page_id']}, host string, path string, rule string, verdict string, pattern string")
