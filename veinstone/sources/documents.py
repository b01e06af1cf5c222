"""Readers and writers: text, PDF, documents by source type, gold queries, CSV."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, text
from . import pdf

#: Fixed provenance texts by source type.
PROVENANCE = {"RELEASE_NOTE": "release note", "MIGRATION_GUIDE": "migration guide", "OFFICIAL_DOCS": "official docs", "GITHUB_PR_ISSUE": "github pr/issue"}


def read_lines(spark: SparkSession, path: str, parse_pdf: Callable[[bytes], list[str]] = pdf.pages) -> DataFrame:
    """(path, line_no, line): stripped, non-blank lines of .txt files, or of .pdf files by a parser that gives the pages' texts.

    Files are read and parsed where the rows are, some at a time."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "txt":
        whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    elif kind == "pdf":

        @F.pandas_udf("string")
        def read(files: pd.Series) -> pd.Series:
            return files.map(lambda data: "\n".join(parse_pdf(bytes(data))))

        whole = spark.read.format("binaryFile").load(path).select("path", read("content").alias("text"))
    else:
        raise ValueError(f"unsupported format: {path}")
    return whole.select("path", F.posexplode(text.lines(F.col("text"))).alias("line_no", "line"))


def provenance(source_type: Column, url: Column, reference: Column) -> Column:
    said = F.lit(None).cast("string")
    for kind, words in PROVENANCE.items():
        said = F.when(source_type == kind, F.lit(words)).otherwise(said)
    named = F.when((source_type == "GITHUB_PR_ISSUE") & reference.isNotNull(), F.concat(said, F.lit(" "), reference)).otherwise(said)
    return F.when(F.nullif(url, F.lit("")).isNotNull(), F.concat(named, F.lit(" ("), url, F.lit(")"))).otherwise(named)


def source_documents(raw: DataFrame) -> DataFrame:
    """Documents of (source_type, raw_text, url, version, date, reference, doc_ord)."""
    refs = F.when((F.col("source_type") == "GITHUB_PR_ISSUE") & F.col("reference").isNotNull(), F.array("reference")).otherwise(F.array().cast("array<string>"))
    return raw.select(ids.document_id(F.col("source_type"), F.col("url"), F.col("raw_text")).alias("document_id"), "source_type", "raw_text", provenance(F.col("source_type"), F.col("url"), F.col("reference")).alias("provenance"), "url", "version", "date", refs.alias("document_refs"), F.col("doc_ord").cast("long").alias("doc_ord"))


def read_corpus(spark: SparkSession, files: list[tuple[str, str, str]]) -> DataFrame:
    """Documents of (source type, path, url) in the given order."""
    out = None
    for i, (kind, path, url) in enumerate(files):
        one = spark.read.text(path, wholetext=True).select(F.lit(kind).alias("source_type"), F.col("value").alias("raw_text"), F.lit(url).alias("url"), F.lit(None).cast("string").alias("version"), F.lit(None).cast("string").alias("date"), F.lit(None).cast("string").alias("reference"), F.lit(i).alias("doc_ord"))
        out = one if out is None else out.unionByName(one)
    return source_documents(out)


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold queries; the scope is change_retrieval where none is given."""
    gold = spark.read.json(path, multiLine=True).select(F.explode("queries").alias("q")).select("q.*")
    scope = F.col("evaluation_scope") if "evaluation_scope" in gold.columns else F.lit(None).cast("string")
    return gold.withColumn("evaluation_scope", F.coalesce(scope, F.lit("change_retrieval")))


def write_csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def gold_digest(queries: list[dict]) -> str:
    """Digest of queries that does not depend on the order of keys."""
    return hashlib.sha256(json.dumps(queries, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def write_gold(path: str, metadata: dict, queries: list[dict], frozen: str | None = None) -> None:
    """Writes the gold set, but not over a frozen one whose digest differs."""
    if frozen and gold_digest(queries) != frozen:
        raise ValueError("the gold set is frozen and the queries differ")
    with open(path, "w") as out:
        json.dump({"metadata": metadata, "queries": queries}, out, indent=2, ensure_ascii=False)
