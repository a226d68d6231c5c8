"""Personal data: base patterns, and information-theoretic sanitisation of the terms that reveal what they found.

Built from DataFrame functions alone. The values that the base patterns find (emails, addresses, cards, phones) are the
protected entities. For each entity e and each term t (a run of MIN_TERM letters or more, lower-cased, outside emails),
co(t, e) is the number of documents with both, anywhere in their texts, df their document counts over all N documents, and

    disclosure(t, e) = PMI(t; e) / IC(e) = log(N co / (df(t) df(e))) / log(N / df(e)),

the share of e's information that t gives away. Evidence needs three different contexts: a term counts if the documents
that have it with e mention e in three different surroundings (CONTEXT characters to each side on the line), so copies of
one passage are none. A term that discloses GENERALISE_AT or more is a span in every document that mentions e and is
generalised there; from REMOVE_AT on it is a span wherever it occurs, with or without e, and is removed.

Every array is bounded by one document. Counts are partial aggregates, so a common entity or term costs a row a task. The
table of documents with such terms is broadcast only while its files are small, and joined by key beyond that.

Defined cases: a null text is empty and has no spans; repeated rows (same doc_id and text) count as one document everywhere
and get the same result; a null doc_id is a value like others; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace

MIN_TERM, CONTEXT = 2, 40
GENERALISE_AT, REMOVE_AT = 0.6, 0.9

#: Kind, expression and guard (a cheap test that any match passes). Possessive groups keep the matcher from recursing on long
#: texts, and a match may start inside a run only where the one before has ended, so a long run is not tried from each character.
KINDS = (
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@[A-Za-z0-9-]"),
    ("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    ("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){12}"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]"),
)
SPAN = "array<struct<s:int,e:int,v:string>>"


def _valid(kind: str, v: Column) -> Column:
    digits = F.regexp_replace(v, "[^0-9]", "")
    if kind == "ip":
        return v.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


#: Results of a fold are gathered in runs of this length, so that appending to them stays linear.
RUN = 64


def gathered(items: Column, start: Column, kind: str, step) -> Column:
    """Fold over items, step(position, item) giving (new position, result or null): the results in order, an array of kind."""
    none = F.array().cast(f"array<{kind}>")
    zero = F.struct(start.alias("p"), none.alias("cur"), F.array().cast(f"array<array<{kind}>>").alias("done"))

    def add(acc, x):
        at, own = step(acc["p"], x)
        full = F.size(acc["cur"]) == RUN
        cur = F.when(full, F.array(own)).otherwise(F.concat(acc["cur"], F.array(own)))
        return F.struct(at.alias("p"), cur.alias("cur"), F.when(full, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"]).alias("done"))

    return F.aggregate(items, zero, add, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["cur"]))))


def located(text: Column, regex: Column) -> Column:
    """All matches in order with start and end in code points: what lies between them gives their places."""
    found = F.regexp_extract_all(text, regex, F.lit(0))
    pairs = F.zip_with(found, F.slice(F.split(text, regex, -1), 1, F.size(found)), lambda m, g: F.struct(m.alias("m"), F.length(g).alias("g")))

    def step(p, x):
        at = p + x["g"]
        end = at + F.length(x["m"])
        return end, F.struct(at.alias("s"), end.alias("e"), x["m"].alias("v"))

    return gathered(pairs, F.lit(0), "struct<s:int,e:int,v:string>", step)


def kind_spans(text: Column, kind: str, regex: str, guard: str) -> Column:
    spans = F.filter(located(text, F.lit(regex)), lambda x: _valid(kind, x["v"]))
    return F.when(text.rlike(guard), spans).otherwise(F.array().cast(SPAN))


def with_base(docs: DataFrame) -> DataFrame:
    """Adds the spans of each kind; text is no longer null."""
    return docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumns({k: kind_spans(F.col("text"), k, r, g) for k, r, g in KINDS})


def listed(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string")))


def _entity(kind: str, v: Column) -> Column:
    return F.concat(F.lit(kind + ":"), F.lower(v) if kind in ("email", "ip") else F.regexp_replace(v, "[^0-9]", ""))


def has_base() -> Column:
    return sum((F.size(k) for k, *_ in KINDS), F.lit(0)) > 0


def maybe(text: Column) -> Column:
    """Whether any guard passes."""
    out = F.lit(False)
    for _, _, guard in KINDS:
        out = out | text.rlike(guard)
    return F.coalesce(out, F.lit(False))


def terms_of(text: Column) -> Column:
    """The distinct terms of a text, without what is in emails."""
    _, email, guard = KINDS[0]
    rest = F.when(text.rlike(guard), F.regexp_replace(text, email, " ")).otherwise(text)
    return F.array_distinct(F.regexp_extract_all(F.lower(rest), F.lit(r"\p{L}{%d,}" % MIN_TERM), F.lit(0)))


def several_contexts() -> Column:
    """Whether a group has three different contexts or more: the sum of (c - min)(c - max) is 0 only if all are the least or the greatest."""
    c = F.col("context").cast("decimal(10,0)")
    lo, hi = F.min(c), F.max(c)
    return F.sum(c * c) - (lo + hi) * F.sum(c) + F.count("*") * (lo * hi) != 0


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null made empty) and _h, its hash: the two name a document, whatever its id."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_h", F.xxhash64("text"))


def disclosing_terms(docs: DataFrame, ws: Workspace) -> DataFrame | None:
    """doc_id, _h (hash of the text), reveal and remove (arrays of terms) of the documents with disclosing terms; None if there is no such term."""
    own = keyed(docs)
    found = with_base(own.where(maybe(F.col("text")))).where(has_base())
    text = F.col("text")

    def context(x):
        left = F.substring_index(F.substring(text, F.greatest(x["s"] - CONTEXT, F.lit(0)) + 1, F.least(x["s"], F.lit(CONTEXT))), "\n", -1)
        right = F.substring_index(F.substring(text, x["e"] + 1, F.lit(CONTEXT)), "\n", 1)
        return F.pmod(F.xxhash64(left, right), F.lit(1 << 30))

    def mentioned(kind):
        return F.transform(F.col(kind), lambda x: F.struct(_entity(kind, x["v"]).alias("entity"), context(x).alias("context")))

    found = found.select("doc_id", "_h", F.array_distinct(F.concat(*(mentioned(k) for k, *_ in KINDS))).alias("mentions"), terms_of(text).alias("terms"))
    found = ws.cut(found.dropDuplicates(["doc_id", "_h"]), "found")
    rows = found.select("doc_id", "_h", F.explode("mentions").alias("m")).groupBy("doc_id", "_h", "m.entity").agg(F.min("m.context").alias("context"))
    rows = ws.cut(rows, "mentions")
    entities = ws.cut(rows.groupBy("entity").agg(F.count("*").alias("df_e"), several_contexts().alias("ok")).where("ok").drop("ok"), "entities")
    if entities.isEmpty():
        return None
    key = ["doc_id", "_h"]
    told = rows.join(entities, "entity")
    terms = found.select(F.col("doc_id").alias("_id"), F.col("_h").alias("_fh"), "terms")
    told = told.join(terms, told["doc_id"].eqNullSafe(terms["_id"]) & (told["_h"] == terms["_fh"])).select(*key, "entity", "df_e", "context", "terms")
    pairs = ws.cut(told, "told").select(*key, "entity", "df_e", "context", F.explode("terms").alias("term"))
    cand = ws.cut(pairs.groupBy("entity", "df_e", "term").agg(F.count("*").alias("co"), several_contexts().alias("ok")).where("ok").drop("ok"), "candidates")
    if cand.isEmpty():
        return None
    n, n_rows = own.groupBy(*key).agg(F.count("*").alias("k")).agg(F.count("*"), F.sum("k")).first()
    once = own if n == n_rows else own.dropDuplicates(key)
    words = once.select(*key, F.explode(terms_of(text)).alias("term"))
    df_t = words.groupBy("term").agg(F.count("*").alias("df_t"))
    pmi = F.log(F.lit(float(n)) * F.col("co") / (F.col("df_t") * F.col("df_e")))
    share = pmi / F.greatest(F.log(F.lit(float(n)) / F.col("df_e")), F.lit(1e-9))
    flagged = ws.cut(cand.join(df_t, "term").select("entity", "term", share.alias("share")).where(F.col("share") >= GENERALISE_AT), "flagged")
    if flagged.isEmpty():
        return None
    near = pairs.join(flagged, ["entity", "term"]).select(*key, "term", (F.col("share") >= REMOVE_AT).alias("goes"))
    everywhere = ws.cut(flagged.where(F.col("share") >= REMOVE_AT).select("term").distinct(), "everywhere")
    if not everywhere.isEmpty():
        near = near.union(words.join(everywhere, "term").select(*key, "term", F.lit(True)))
    return ws.cut(near.groupBy(*key).agg(F.collect_set("term").alias("reveal"), F.collect_set(F.when(F.col("goes"), F.col("term"))).alias("remove")), "reveal")


def find(docs: DataFrame, ws: Workspace) -> DataFrame:
    """docs with null texts made empty, the spans of each kind, term (spans of disclosing terms) and remove (which of them go)."""
    none = F.array().cast("array<string>")
    reveal = disclosing_terms(docs, ws)
    if reveal is None:
        return with_base(docs).withColumns({"term": F.array().cast(SPAN), "remove": none})
    r = reveal.select(F.col("doc_id").alias("_id"), F.col("_h").alias("_rh"), "reveal", "remove")
    some = docs.withColumn("_h", F.xxhash64(F.coalesce("text", F.lit(""))))
    some = with_base(some.join(ws.small(r, "reveal"), some["doc_id"].eqNullSafe(r["_id"]) & (some["_h"] == r["_rh"]), "left"))
    rule = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(F.array_sort("reveal"), "|"), F.lit(r")(?!\p{L})"))
    some = some.withColumn("term", F.when(F.col("reveal").isNotNull(), located(F.col("text"), rule)).otherwise(F.array().cast(SPAN)))
    return some.withColumn("remove", F.coalesce("remove", none)).drop("_h", "_id", "_rh", "reveal")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the count of each base kind, base_sha256 and spans."""
    out = find(docs.select("doc_id", "text"), Workspace(docs.sparkSession, "pii"))
    base = F.concat_ws(",", *(listed(k, F.col(k)) for k, *_ in KINDS))
    every = F.concat_ws(",", *(listed(k, F.col(k)) for k, *_ in KINDS), listed("term", F.col("term")))
    return out.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k, *_ in KINDS), F.sha2(base, 256).alias("base_sha256"), every.alias("spans"))


def sanitise(docs: DataFrame) -> DataFrame:
    """The documents with base spans replaced by their kind, disclosing terms generalised or removed; other columns stay."""
    names = docs.columns
    shadow = {c: f"_x{i}" for i, c in enumerate(names) if c not in ("doc_id", "text")}
    out = find(docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(s) for c, s in shadow.items())), Workspace(docs.sparkSession, "pii"))

    def labelled(kind):
        label = lambda x: F.when(F.array_contains("remove", F.lower(x["v"])), "").otherwise("[TERM]") if kind == "term" else F.lit(f"[{kind.upper()}]")
        return F.transform(F.col(kind), lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), label(x).alias("l")))

    every = F.array_sort(F.concat(*(labelled(k) for k in (*(k for k, *_ in KINDS), "term"))))

    def step(p, x):  # what a span before it has taken already adds nothing
        part = F.concat(F.substring(F.col("text"), p + 1, x["s"] - p), x["l"])
        return F.greatest(p, -x["e"]), F.when(x["s"] >= p, part).otherwise("")

    last = F.greatest(F.coalesce(F.array_max(F.transform(every, lambda x: -x["e"])), F.lit(0)), F.lit(0))
    clean = F.concat(F.array_join(gathered(every, F.lit(0), "string", step), ""), F.substring(F.col("text"), last + 1, F.length("text")))
    changed = F.when(has_base() | (F.size("term") > 0), clean).otherwise(F.col("text"))
    return out.select(*(changed.alias("text") if c == "text" else F.col("doc_id") if c == "doc_id" else F.col(shadow[c]).alias(c) for c in names))
