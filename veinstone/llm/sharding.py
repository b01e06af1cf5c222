"""Reproducible shuffle into shards by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered in the order of (doc_id, text checksum, size). The permutation sends row number r of n to a position
in [0, n): a balanced Feistel network over the smallest even number of bits that holds n, walked again while it lands
outside. Position p is slot p // shards of shard p % shards, so any row's place, or any place's row, can be computed from
the seed and n alone, and the shards' counts are at most one apart.

The numbering is a range partitioning of narrow rows (no texts move) and one count per partition on the driver. Rows that
are equal in all keys are counted before the shuffle and numbered together, so neither a doc_id nor a row with a third of
all repeats is more than one narrow row there; many copies are dealt to tasks in runs of ``RUN`` before they are rows again.

Defined results: a null text is empty: size 1, checksum 0. Repeated rows have places of their own. A null doc_id
sorts first. Other columns, under any name, are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Sealed, cut, mix64, table

SHARDS = 8
ROUNDS = 6
RUN = 10_000


def _half_bits(n: int) -> int:
    return max(1, -(-max(1, n - 1).bit_length() // 2))


def _keys(seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def _network(x: np.ndarray, bits: int, keys: np.ndarray) -> np.ndarray:
    mask, shift = np.uint64((1 << bits) - 1), np.uint64(bits)
    left, right = x >> shift, x & mask
    for k in keys:
        left, right = right, left ^ (mix64(right ^ k) & mask)
    return (left << shift) | right


def permuted(rows: np.ndarray, n: int, seed: int = 9) -> np.ndarray:
    """Positions of row numbers, each in [0, n)."""
    bits, keys = _half_bits(n), _keys(seed)
    out = _network(rows.astype(np.uint64), bits, keys)
    while (outside := out >= np.uint64(n)).any():
        out[outside] = _network(out[outside], bits, keys)
    return out.astype(np.int64)


def row_at(position: int, n: int, seed: int = 9) -> int:
    """The row number at a position: the permutation the other way."""
    bits, keys = _half_bits(n), _keys(seed)
    mask = (1 << bits) - 1
    while True:
        left, right = position >> bits, position & mask
        for k in keys[::-1]:
            left, right = right ^ (int(mix64(np.array([left], np.uint64) ^ k)[0]) & mask), left
        position = left << bits | right
        if position < n:
            return position


def _running(batches):
    """Copies before each row of a partition."""
    before = 0
    for batch in batches:
        n = np.asarray(batch.column(batch.num_columns - 1))
        ends = before + np.cumsum(n)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends - n, pa.int64())], [*batch.schema.names, "before"])
        before = int(ends[-1]) if len(ends) else before


def numbered(narrow: DataFrame, keys: list[str], name: str = "row_number") -> tuple[DataFrame, int]:
    """``narrow`` (of the ``keys`` alone) with row numbers from 0 in their order, and the number of rows."""
    kinds = ", ".join(f"`{k}` {narrow.schema[k].dataType.simpleString()}" for k in keys)
    equal = narrow.groupBy(*keys).agg(F.count("*").alias("n"))
    runs = equal.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(_running, f"{kinds}, n long, before long")
    runs = cut(runs.withColumn("part", F.spark_partition_id()))
    counts = runs.groupBy("part").agg(F.sum("n").alias("n")).collect()  # one row for each partition
    starts, total = [], 0
    for part, n in sorted((r["part"], r["n"]) for r in counts):
        starts.append((part, total))
        total += n
    offsets = narrow.sparkSession.createDataFrame(starts, "part int, start long")
    placed = runs.join(F.broadcast(offsets), "part").withColumn("first", F.col("start") + F.col("before"))
    each = lambda df: df.select(*keys, F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias(name))
    few, many = placed.filter(F.col("n") <= RUN), placed.filter(F.col("n") > RUN)
    if not many.limit(1).count():
        return each(few), total
    split = many.select(*keys, "first", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {RUN}"))).alias("run"))
    split = split.select(*keys, (F.col("first") + F.col("run") * RUN).alias("first"), F.least(F.lit(RUN).cast("long"), F.col("n") - F.col("run") * RUN).alias("n"))
    return each(few).unionByName(each(split.repartition("first"))), total


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = 9) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, size, text_crc32, row_number, shard, slot."""
    sealed = Sealed(docs)
    text = sealed.of("text")
    narrow = sealed.df.select(sealed.of("doc_id").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"))
    rows, n = numbered(narrow, ["doc_id", "text_crc32", "size"])

    @F.pandas_udf("long")
    def position(x: pd.Series) -> pd.Series:
        return pd.Series(permuted(x.to_numpy(), n, seed))

    placed = rows.withColumn("position", position("row_number"))
    return placed.withColumns({"shard": F.pmod("position", F.lit(shards)).cast("int"), "slot": F.floor(F.col("position") / shards).cast("long")})


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
