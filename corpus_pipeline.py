"""A training corpus from documents: quality rules, near-duplicates, personal data, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result to the shared folder and reads it
back as the next stage's docs. All but the last return the columns of documents; the last returns packed pieces.

Defined cases of every stage: an empty table gives an empty result; extra columns, whatever their names, are carried by all
stages but the last, which has none of them; a null text is an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrylog.llm import mixing, neardup, packing, pii, quality
from quarrylog.llm.common import Workspace, table
from quarrylog.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or that the trees judge bad go.

    Null and empty texts go; repeated rows are judged alike; labels that are null or name no document teach nothing."""
    return quality.keep(docs, quality.train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of the smallest doc_id.

    Repeated rows are one document; of rows with one doc_id and different texts that are alike, the smallest hash stays; a null
    doc_id comes after all others; documents without words are alike with nothing and stay."""
    return neardup.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind, terms that disclose it are generalised or removed; no document goes.

    Repeated rows count as one document and change alike; a null text becomes an empty one."""
    return pii.sanitise(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay as often as the mix takes them, up to twice; what isn't taken goes, as do documents without words.

    A null source is one of its own and comes last; which of equal documents are taken is fixed by a seeded hash."""
    return mixing.resampled(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and place in it; repeated documents are packed each."""
    return packing.tokenise_and_pack(docs.select("doc_id", "text"), tokenizer_path())


STAGES = [("quality rules", quality_rules), ("near-duplicates", near_duplicates), ("personal data", personal_data), ("source mix", source_mix), ("packing", packed)]
#: SQL has neither the trained trees nor the tokenizer; tests/llm/test_pipeline.py holds the stages and run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, ws = table(spark, sf_dir, "documents"), Workspace(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = ws.cut(stage(spark, docs, sf_dir), f"stage-{i}")
    return docs


def queries():
    return {"pipeline": run}


def oracle_sql():
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
