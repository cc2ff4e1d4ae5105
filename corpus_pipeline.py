"""From raw documents to packed sequences: five stages, each on all that its predecessor kept.

Each function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of documents, COLUMNS, and leave others out. The stages are written as Parquet
in between.

Rows are judged one by one by the first two stages, whatever their ids: of two rows with
one doc_id one may go and the other stay, and a null doc_id is no shelter. Null and empty
texts fail the quality rules. Near copies take rows with one doc_id as one document, and
leave a null doc_id alone, as substrings do. An empty table stays empty through all stages;
without toxic labels the toxicity stage keeps every document.
"""

from __future__ import annotations

from functools import reduce

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnout.llm.common import saved, table, without
from turnout.llm.near_duplicates import near_duplicates
from turnout.llm.packing import pack
from turnout.llm.quality_rules import judge
from turnout.llm.substring_dedup import repeated_spans
from turnout.llm.toxicity import fit, score

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the fixed and the adaptive rules."""
    return judge(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted as not toxic; the model is fitted on those labelled among them."""
    row = F.xxhash64("doc_id", "text")  # a verdict is on a row's text, whatever other rows have its id
    model = fit(docs, table(spark, sf_dir, "labels"))
    found = saved(score(docs.select(row.alias("doc_id"), "text"), model).where("predicted = 1").select(F.col("doc_id").alias("row")).distinct())
    return without(docs.select(*COLUMNS, row.alias("row")), found, "row").select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id."""
    others = saved(near_duplicates(docs).where("doc_id <> class_id").select("doc_id"))
    return without(docs.select(*COLUMNS), others, "doc_id")


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document has; a text with nothing left goes."""
    cut = repeated_spans(docs, carry=["lang", "source", "n_chars"])
    changed = F.col("n_removed") > 0
    n_chars = F.when(changed, F.char_length("kept_text").cast("long")).otherwise(F.col("carried.n_chars"))
    left = cut.where(~changed | (F.col("kept_text") != ""))
    return left.select("doc_id", F.col("kept_text").alias("text"), "carried.lang", "carried.source", n_chars.alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2,048 tokens."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_copies", near_copies), ("substrings", substrings), ("packing", packing)]

#: Sketches, a fitted model and hashing stand in the way of SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again before the next."""
    step = lambda docs, stage: stage[1](spark, saved(docs), sf_dir)
    first = STAGES[0][1](spark, table(spark, sf_dir, "documents"), sf_dir)
    return reduce(step, STAGES[1:], first)
