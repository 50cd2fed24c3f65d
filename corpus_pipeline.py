"""The corpus pipeline: quality rules, near-duplicates, benchmark decontamination, mixing, token-ID output.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; its result is written as Parquet and
reread as the next stage's docs. All but the last return the columns of documents, whatever others docs has and whatever
their names; the last returns what it reads back from its token files. Every stage takes an empty table and gives an
empty result, reads texts whole however long, and judges each row by its values, so the order of rows does not matter.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from loomwork.llm import decontaminate, mixing, near_dup, quality, token_files
from loomwork.llm.common import Scratch, shared_dir, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the perplexity bands reject go.

    A null or empty text fails the rules; a null language is a language of its own; at a band's end a text stays; repeated
    rows stay or go together.
    """
    return quality.filter_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that with the smallest id (of rows that repeat it, one).

    Rows without a word are in no group and stay; a row without an id stands for a group only if no member has one.
    """
    return near_dup.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go.

    A null or wordless text has none and stays; an item of the benchmark without text or words is in none; repeated rows
    stay or go together.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source is taken in part, or up to three times, as its target asks; a document stands once for each pass.

    A null source is a source like others, last in order; documents without words are in no mix; rows that repeat an id
    and a text are interchangeable.
    """
    return mixing.mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix is written as token files and read back. The files outlive the driver: in the folder that the session names in
    loomwork.tokens.dir, else in a new folder beside the scratch tables.

    A null text is empty; null ids come first; rows of one id are ordered by their text.
    """
    folder = spark.conf.get("loomwork.tokens.dir", None) or f"{shared_dir(spark)}/corpus-tokens-{uuid.uuid4().hex}"
    return token_files.token_output(docs, folder=folder)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mix", mix),
    ("token_output", token_output),
]

#: The first stage scores with a language model, which SQL can't express; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        scratch.only(docs)
    return docs
