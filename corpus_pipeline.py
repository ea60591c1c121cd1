"""A training corpus in five stages, each written and read again: quality, exact copies, near copies,
source mixing, packing. Every stage works on all rows its predecessor kept; all but the last return
the columns of documents.

A stage's own tables lie in the shared folder until the next stage begins, so its result is to be written before that.

Defined results of every stage: a null text counts as empty; empty tables give empty tables; extra columns are kept,
whatever their names (packing drops them); a very long text is one row of its task in each stage; ties are broken by doc_id, in
mixing by keyed hashes of doc_id and text; repeated rows and a null doc_id are said at each stage."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from salesflow.llm.common import as_row, drop, made, saved, whole_text
from salesflow.llm.exact_dedup import dedup_exact
from salesflow.llm.jaccard_join import near_duplicates
from salesflow.llm.mixing import mixed_documents
from salesflow.llm.packing import pack
from salesflow.llm.quality import keep_good
from salesflow.llm.queries import vocabulary


#: Parameters of the mixing stage: tokens drawn as a part of all, passes over a source at most, and the entropy of the weights as a
#: part of that of equal ones.
BUDGET_SHARE, MAX_REPEATS, TARGET_ENTROPY = 0.8, 2.0, 0.98


#: Tables that the last stage of an application saved on its way.
_LEFT: dict[str, list[str]] = {}


def _stage(f):
    """A stage that first deletes what the stage before it saved, unless its documents still come from there."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        own = spark.sparkContext.applicationId
        kept = drop(spark, _LEFT.pop(own, []), docs)
        with made() as tables:
            out = f(spark, docs, sf_dir)
        _LEFT[own] = kept + tables
        return out

    return run_stage


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"row.`{c}`").alias(c) for c in docs.columns]


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. Repeated rows are judged alike and all stay or go; labels of a null
    doc_id are not learnt; without usable labels all texts get one score."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the largest doc_id (a null one is smaller than all); of repeated rows, one."""
    decided = saved(dedup_exact(docs))
    gone = decided.filter("NOT kept").select(F.col("doc_id").alias("d"), F.col("text_sha256").alias("s"))
    own = docs.select(as_row(docs), F.col("doc_id").cast("long").alias("doc_id"), F.sha2(F.encode(whole_text(), "UTF-8"), 256).alias("sha"))
    kept = own.join(gone, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("sha") == F.col("s")), "left_anti")
    if decided.count() < docs.count():  # rows are repeated
        kept = kept.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "sha").orderBy("sha"))).filter("n = 1")
    return kept.select(_columns(docs))


@_stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest doc_id, which names the group. Empty texts are near nothing
    and stay; rows of a null doc_id stay; repeated rows of one doc_id stay or go together."""
    gone = near_duplicates(docs).filter("component_id != doc_id").select(F.col("doc_id").alias("d")).distinct()
    own = docs.select(as_row(docs), F.col("doc_id").cast("long").alias("doc_id"))
    return own.join(gone, F.col("doc_id") == F.col("d"), "left_anti").select(_columns(docs))


@_stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to source weights tempered to TARGET_ENTROPY, BUDGET_SHARE of the corpus' tokens in all: of a large
    source a part, of a small one up to MAX_REPEATS passes (a row for each copy); a source at that limit lowers no other.
    A null source is a source; empty texts are kept once; repeated rows count each."""
    return mixed_documents(docs, target_entropy=TARGET_ENTROPY, max_repeats=MAX_REPEATS, budget_share=BUDGET_SHARE, fill=True)


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens; repeated rows and those of a null doc_id are
    packed each."""
    return pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mixing", mixing), ("packing", packing)]

#: The classifier is trained and the tokenizer is a library: SQL cannot express them; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed corpus of the documents of `sf_dir`."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        with made() as tables:
            docs = saved(out)
        drop(spark, before + _LEFT.pop(spark.sparkContext.applicationId, []))
        before = tables
    return docs


QUERIES = {"pipeline": run}
