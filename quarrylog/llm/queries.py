"""The queries of the training-data operators: thin contract queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hnsw, mixing, neardup, ngram, packing, pii, quality, substrings, toxicity, urls
from .common import table

Q, SQL = {}, {}


def query(f):
    Q[f.__name__] = f
    return f


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.train_and_score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))


@query
def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("spans")


@query
def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.neighbours(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


@query
def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url")).drop("pattern")


def _op5_sql() -> str:
    rules = sorted(urls.HOST_RULES, key=lambda r: (-len(r[1] + r[2]), r))
    fit = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    rule = "CASE " + " ".join(f"WHEN {fit(h, p)} THEN '{h}{p}'" for _, h, p in rules) + " END"
    ruled = "CASE " + " ".join(f"WHEN {fit(h, p)} THEN '{v}'" for v, h, p in rules) + " END"
    blocked = " OR ".join(f"regexp_matches(low, '{p.regex}')" for p in urls.PATTERNS)
    return f"""
WITH a AS (SELECT page_id, coalesce(url, '') AS url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, lower(url) AS low, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, {rule} AS rule, {ruled} AS ruled FROM b)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN {blocked} THEN 'block' ELSE 'allow' END) AS verdict FROM c"""


SQL["op5_url_filters"] = _op5_sql()


@query
def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_by_source(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


@query
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.tokenise_and_pack(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return quality.judge(docs, model)


@query
def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.train_and_score(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op10_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), percent=neardup.OP10_PERCENT)


def queries():
    return dict(Q)


def oracle_sql():
    return dict(SQL)
