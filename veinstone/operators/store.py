"""Tables of changes, evidence, links and constraints: schemas, keys, inserts, upserts, lookups and integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from ..functions import text
from ..session import sound

#: Primary key columns by table.
KEYS = {"change_records": ["change_id"], "evidence": ["evidence_id"], "evidence_links": ["evidence_id", "change_id"], "cannot_link_constraints": ["change_id_a", "change_id_b"]}
SYMBOL = "struct<name:string,package:string,kind:string>"
#: Schemas by table. Lists are arrays; ``decoded`` reads those that come as JSON text.
SCHEMAS = {
    "change_records": "change_id string not null, symbol_name string not null, symbol_package string not null, symbol_kind string, version_from string, version_to string, change_type string not null, summary string not null, external_refs array<string> not null, replacement_symbol string, parameters array<string> not null, migration_action_text string, source_type string not null, source_document_id string not null, raw_text string not null",
    "evidence": f"evidence_id string not null, source_type string not null, source_document_id string not null, symbol_mentions array<{SYMBOL}> not null, raw_text string not null, external_refs array<string> not null, embedding_id string",
    "evidence_links": "evidence_id string not null, change_id string not null, link_type string not null, link_confidence double not null, confidence_tier string not null, link_method string not null, provenance string not null, review_status string not null",
    "cannot_link_constraints": "change_id_a string not null, change_id_b string not null, reason string not null, provenance string not null, created_by string not null",
}
#: Columns that point to another table's key.
PARENTS = {"evidence_links": [("evidence_id", "evidence"), ("change_id", "change_records")]}


def schema(name: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[name])


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def insert(rows: DataFrame, path: str, keys: list[str], existing: DataFrame | None = None) -> None:
    """Appends rows; a key that is there already, or twice, raises and nothing is written."""
    whole = rows.select(*keys) if existing is None else rows.select(*keys).unionByName(existing.select(*keys))
    if repeated_keys(whole, keys).limit(1).count():
        raise ValueError(f"repeated key in {keys}")
    rows.write.mode("append").parquet(path)


def insert_absent(rows: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Those rows whose key is not there yet."""
    return rows.join(existing.select(*keys), keys, "left_anti")


def upsert_pairs(rows: DataFrame, a: str, b: str, order: Column) -> DataFrame:
    """The last row of each unordered pair, the smaller id first."""
    placed = rows.withColumns({a: F.least(a, b), b: F.greatest(a, b)})
    last = Window.partitionBy(a, b).orderBy(order.desc())
    return placed.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")


def find(rows: DataFrame, **values) -> DataFrame:
    for name, value in values.items():
        rows = rows.filter(F.col(name) == value)
    return rows


def find_pair(rows: DataFrame, a: str, b: str) -> DataFrame:
    return find(rows, change_id_a=min(a, b), change_id_b=max(a, b))


def orphans(links: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Links whose parent is missing."""
    return links.join(parents.select(key).distinct(), key, "left_anti")


def decoded(rows: DataFrame, name: str) -> DataFrame:
    """Rows of a table as records: lists that are JSON text become arrays, and a change's symbol one struct."""
    for field in schema(name).fields:
        if isinstance(field.dataType, ArrayType) and isinstance(rows.schema[field.name].dataType, StringType):
            rows = rows.withColumn(field.name, F.from_json(field.name, field.dataType.simpleString()))
    if name == "change_records":
        parts = ["symbol_name", "symbol_package", "symbol_kind"]
        symbol = F.struct(*[F.col(c).alias(c.removeprefix("symbol_")) for c in parts])
        return rows.select(symbol.alias("symbol"), *[c for c in rows.columns if c not in parts])
    return rows


class Store:
    """The four tables below a folder that all machines see. Constraints are a log of which the last row of a pair counts."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def init(self) -> Store:
        """Creates the tables that are not there yet."""
        for name in SCHEMAS:
            self.spark.createDataFrame([], self._stored(name)).write.mode("ignore").parquet(self.path(name))
        return self

    def _stored(self, name: str) -> StructType:
        return schema(name).add("seq", "long") if name == "cannot_link_constraints" else schema(name)

    def table(self, name: str) -> DataFrame:
        rows = self.spark.read.schema(self._stored(name)).parquet(self.path(name))
        return upsert_pairs(rows, "change_id_a", "change_id_b", F.col("seq")).drop("seq") if name == "cannot_link_constraints" else rows

    def insert(self, name: str, rows: DataFrame) -> None:
        """Appends whole rows; a null where none may be, a repeated key or a missing parent raises, and nothing is written."""
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema(name).fields])
        missing = [f.name for f in schema(name).fields if not f.nullable]
        empty = rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in missing]).head().asDict()
        if any(empty.values()):
            raise ValueError(f"null in {[c for c, n in empty.items() if n]} of {name}")
        for key, parent in PARENTS.get(name, []):
            if orphans(rows, self.table(parent), key).limit(1).count():
                raise ValueError(f"{key} of {name} is not in {parent}")
        insert(rows, self.path(name), KEYS[name], self.table(name))

    def insert_cannot_link(self, rows: DataFrame, order: Column | None = None) -> None:
        """Adds constraints; one of a pair that is there already, in either order, takes its place, as does a later of ``rows`` by ``order``."""
        log = self.spark.read.schema(self._stored("cannot_link_constraints")).parquet(self.path("cannot_link_constraints"))
        after = (log.agg(F.max("seq")).head()[0] or 0) + 1
        placed = rows.withColumn("_order", order if order is not None else F.lit(0))
        fresh = upsert_pairs(placed, "change_id_a", "change_id_b", F.col("_order"))
        fresh.select(*[f.name for f in schema("cannot_link_constraints").fields], F.lit(after).cast("long").alias("seq")).write.mode("append").parquet(self.path("cannot_link_constraints"))

    def get(self, name: str, **key) -> Row | None:
        """The record of a key, or None; a constraint's two ids may come in either order."""
        if name == "cannot_link_constraints":
            a, b = sorted((key["change_id_a"], key["change_id_b"]))
            key = {"change_id_a": a, "change_id_b": b}
        return next(iter(find(decoded(self.table(name), name), **key).take(1)), None)

    def links(self, **key) -> DataFrame:
        """Links of a change (``change_id``) or of an evidence (``evidence_id``)."""
        return find(self.table("evidence_links"), **key)

    def candidates(self, name: str, package: str, version_to: str | None = None) -> DataFrame:
        """Changes of a symbol, but for those of another known version if the version is known."""
        rows = find(self.table("change_records"), symbol_name=name, symbol_package=package)
        return rows if version_to is None else rows.filter(F.col("version_to").isNull() | (F.col("version_to") == version_to))


def candidates(claims: DataFrame, changes: DataFrame) -> DataFrame:
    """Claims with each change record of the same symbol whose version is unknown or the same."""
    there = changes.select("symbol_name", "symbol_package", F.struct(*changes.columns).alias("candidate"))
    version = F.col("candidate.version_to")
    return claims.join(there, ["symbol_name", "symbol_package"]).filter(F.col("version_to").isNull() | version.isNull() | (F.col("version_to") == version))


def owning_chunks(claims: DataFrame, chunks: DataFrame) -> DataFrame:
    """(evidence_id, claim_idx, chunk_id): a claim's chunk in its document, equal text before containment, then the first.

    Equal texts are joined by hash; only the claims that are left are searched for in the chunks of their document.
    """
    c = chunks.select("source_document_id", "chunk_id", "ord", F.col("text").alias("chunk_text"), text.stripped(F.col("text")).alias("said"))
    asked = claims.select("source_document_id", "evidence_id", "claim_idx", "raw_text", text.stripped(F.col("raw_text")).alias("said"))
    first = c.groupBy("source_document_id", "said").agg(F.min(F.struct("ord", "chunk_id")).alias("at"))
    met = asked.join(first, ["source_document_id", "said"], "left")
    equal = met.filter("at is not null").select("evidence_id", "claim_idx", "at.chunk_id")
    rest = met.filter("at is null").drop("at").withColumnRenamed("said", "wanted").join(c, "source_document_id")
    near = rest.filter(F.contains("chunk_text", "wanted") | F.contains("raw_text", "said")).groupBy("evidence_id", "claim_idx").agg(F.min(F.struct("ord", "chunk_id")).alias("at"))
    sound(claims.sparkSession)
    return equal.unionByName(near.select("evidence_id", "claim_idx", "at.chunk_id"))


def with_evidence(chunks: DataFrame, owners: DataFrame) -> DataFrame:
    """Chunks with the evidence of the last claim that they own."""
    return chunks.join(owners.groupBy("chunk_id").agg(F.max_by("evidence_id", "claim_idx").alias("evidence_id")), "chunk_id", "left")
