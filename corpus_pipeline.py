"""The corpus pipeline: its stages one after another, each written and read again.

Every stage is a function of (spark, docs, sf_dir) on all that the stage before it kept; all but the last return the columns
of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import jaccard, language, packing, toxicity
from lamina.llm.common import held_out, saved, small_batches, table

#: A document goes if no language is found in it or fewer of its letters than this share are in the one found most.
LANGUAGE_LEAST = 0.25


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; one goes that has no letter or is a mixture of which no language has much.

    Null and empty texts go, very long ones are read whole. Each row goes by its own text, so rows that repeat, share a doc_id
    or have none are like others; other columns stay as they are, whatever their names. An empty table stays one, and without
    any row to learn from all rows stay.
    """
    small_batches(spark)
    return language.kept(docs, language.learn(docs.where(~held_out())), LANGUAGE_LEAST)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted to be toxic. Null and empty texts stay; other rows as in keep_languages()."""
    small_batches(spark)
    return toxicity.kept(docs, toxicity.learn(toxicity.training_rows(docs, table(spark, sf_dir, "labels"))))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id.

    Null and empty texts are no duplicates. Of rows with one doc_id the first by its columns stays. A row without a doc_id
    belongs to no group and stays. Other columns stay as they are, whatever their names; an empty table stays one.
    """
    small_batches(spark)
    found = saved(jaccard.near_duplicates(docs.select("doc_id", "text")).select("doc_id", "component_id"), "groups")
    kept = without(docs, found.where("component_id <> doc_id").select("doc_id"))
    repeated = saved(found.where("doc_id is not null and component_id = doc_id").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return kept
    few = repeated.count() <= BROADCAST_IDS
    again = kept.join(F.broadcast(repeated) if few else repeated, "doc_id", "left_semi")
    # The least row of each doc_id; Spark takes the least of each task before it shuffles them.
    first = again.groupBy(F.col("doc_id").alias("_id")).agg(F.min(F.struct(*docs.columns)).alias("_row")).select("_row.*")
    return without(kept, repeated).unionByName(first)


def pack_best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, each with its sequence and place. A null text counts as empty: its document has one id."""
    return packing.packed(docs)


#: Rejected ids are broadcast up to so many; beyond, the join is a shuffled one.
BROADCAST_IDS = 2_000_000


def without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id isn't among those rejected."""
    ids = saved(rejected.where("doc_id is not null").distinct(), "rejected")
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_anti").select(*docs.columns)


STAGES = [("language", keep_languages), ("toxicity", drop_toxic), ("near duplicates", drop_near_duplicates), ("packing", pack_best_fit)]

#: SQL can express none of the four stages: the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
