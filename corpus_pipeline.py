"""From raw documents to packed sequences: rules, near duplicates, personal data, mixture, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. Between stages the documents are
Parquet in the shared folder, so a lost executor costs a task and not the stages before.

For every stage: an empty table gives an empty result, columns of any name pass through untouched (but for those that a
stage's docstring names), absent columns but doc_id and text are not missed, and reruns agree.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinstone.llm.common import Sealed, remove, shared_folder, table
from veinstone.llm.mixing import mix
from veinstone.llm.near_dedup import deduplicated
from veinstone.llm.packing import pack
from veinstone.llm.pii import redact
from veinstone.llm.quality_rules import apply_rules

#: The stages before the last keep the columns of documents; the packing's rows are checked by brute force in the tests.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without their failing lines in ``text``, ``n_chars`` to match.

    A null or empty text is rejected; repeated rows are judged alike, each by itself.
    """
    sealed = Sealed(docs)
    judged = apply_rules(sealed.df, f"in_{sealed.place('text')}").filter("kept")
    counted = {} if sealed.place("n_chars") is None else {"n_chars": F.length("cleaned").cast("long")}
    return sealed.opened(judged, {"text": F.col("cleaned"), **counted})


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that with the smallest doc_id (null last).

    Rows that repeat a doc_id, or have none, are members of groups like others. Texts without words are in no group and stay.
    """
    return deduplicated(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and secrets in ``text`` replaced by their kind, ``n_chars`` to match.

    A null text stays null; repeated rows are treated alike.
    """
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mixture takes them: a repeated document's ``text`` is repeated, a partly taken one holds its chosen blocks, ``n_chars`` to match.

    Null and blank texts have nothing to take and go. A null source is a source. Repeated rows are mixed each; which of rows
    equal in doc_id, source and text takes which part is not defined.
    """
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document: its place in a sequence. A null text is one piece; repeated rows are packed each."""
    return pack(docs)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("pii", pii), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. A stage's table goes when the next has been written; the packing keeps what it needs itself."""
    docs = table(spark, sf_dir, "documents")
    place = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
        if i:
            remove(spark, f"{place}/{STAGES[i - 1][0]}")
    packed = STAGES[-1][1](spark, docs, sf_dir)
    remove(spark, place)
    return packed
