"""Collections of chunks with vectors and flat metadata: create, reset, add, filter and query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import retrieve

#: Metadata of a chunk, all text: unknown is empty.
METADATA = ("source_document_id", "source_type", "package", "version", "symbols", "evidence_id")
SCHEMA = "collection_id string, document string, embedding array<double>, " + ", ".join(f"{m} string" for m in METADATA)


def default_id(document_name: Column, index: Column) -> Column:
    """The id of a document's chunk by its number, where none is given."""
    return F.concat(F.replace(document_name, F.lit("."), F.lit("_")), F.lit("_chunk_"), index.cast("string"))


def metadata(chunks: DataFrame) -> dict[str, Column]:
    """Flat columns of chunks: nulls are empty, symbols are joined by commas; what chunks lack is empty."""
    plain = lambda c: F.concat_ws(",", c) if c == "symbols" else F.coalesce(F.col(c).cast("string"), F.lit(""))
    return {m: plain(m) if m in chunks.columns else F.lit("") for m in METADATA}


def where(rows: DataFrame, **values: str) -> DataFrame:
    """Rows whose metadata have these values."""
    for name, value in values.items():
        rows = rows.filter(F.col(name) == value)
    return rows


class Collection:
    """A named table of chunks below a folder that all machines see."""

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.path = spark, f"{root.rstrip('/')}/{name}"

    def create(self) -> Collection:
        """Makes the collection, if it is not there yet."""
        self.spark.createDataFrame([], SCHEMA).write.mode("ignore").parquet(self.path)
        return self

    def reset(self) -> Collection:
        """Makes the collection anew, empty."""
        self.spark.createDataFrame([], SCHEMA).write.mode("overwrite").parquet(self.path)
        return self

    def rows(self, **values: str) -> DataFrame:
        return where(self.spark.read.schema(SCHEMA).parquet(self.path), **values)

    def add(self, chunks: DataFrame, document_name: str = "", ids: str | None = None) -> None:
        """Adds chunks (ord, text, embedding and metadata); ids come from the column ``ids`` or else from the name and number. A repeated id raises."""
        key = F.col(ids) if ids else default_id(F.lit(document_name), F.col("ord"))
        fresh = chunks.select(key.alias("collection_id"), F.col("text").alias("document"), F.col("embedding").cast("array<double>"), *[v.alias(k) for k, v in metadata(chunks).items()])
        whole = fresh.select("collection_id").unionByName(self.rows().select("collection_id"))
        if whole.groupBy("collection_id").count().filter("count > 1").limit(1).count():
            raise ValueError("repeated id in the collection")
        fresh.write.mode("append").parquet(self.path)

    def count(self) -> int:
        return self.rows().count()

    def query(self, queries: DataFrame, k: int = retrieve.OUTPUT, **values: str) -> DataFrame:
        """The k nearest of the rows with these metadata for each of queries (query_id, embedding)."""
        return retrieve.dense(self.rows(**values).select(F.col("collection_id").alias("item_id"), "embedding"), queries, k)
