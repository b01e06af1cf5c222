"""Recall, reciprocal rank and discounted gain of ranked lists, and their summaries."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import sound


def recall_at(required: Column, found: Column, k: int) -> Column:
    """Share of the required ids, repeats counted, among the first k; 1 if none is required."""
    head = F.slice(found, 1, k)
    return F.when(F.size(required) == 0, 1.0).otherwise(F.size(F.filter(required, lambda r: F.array_contains(head, r))) / F.size(required))


def reciprocal_rank(required: Column, found: Column) -> Column:
    hits = F.filter(F.transform(found, lambda x, i: F.when(F.array_contains(required, x), i + 1)), lambda p: p.isNotNull())
    return F.when(F.size(hits) > 0, 1.0 / F.get(hits, F.lit(0))).otherwise(0.0)


def ndcg_at(required: Column, found: Column, k: int) -> Column:
    gains = F.array(*[F.lit(1 / math.log2(i + 2)) for i in range(k)])
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    got = add(F.transform(F.slice(found, 1, k), lambda x, i: F.when(F.array_contains(required, x), F.get(gains, i)).otherwise(0.0)))
    ideal = add(F.slice(gains, F.lit(1), F.least(F.size(F.array_distinct(required)), F.lit(k))))
    return F.when(F.size(required) == 0, 0.0).otherwise(got / ideal)


def resolve_items(ranking: DataFrame, mapping: DataFrame) -> DataFrame:
    """(query_id, item, rank) of a ranking of (query_id, item_id, rank) through (item_id, item, idx): unmapped items vanish, first occurrences count."""
    first = ranking.join(mapping, "item_id").groupBy("query_id", "item").agg(F.min(F.struct("rank", "idx")).alias("at"))
    return first.select("query_id", "item", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "item")).alias("rank"))


def listed(ranking: DataFrame, item: str = "item") -> DataFrame:
    """(query_id, found): items in the order of their ranks."""
    return ranking.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", item))), lambda s: s[item]).alias("found"))


def listed_by(gold: DataFrame, run_query: Callable[[str], list[str]]) -> DataFrame:
    """(query_id, found) of gold (query_id, query_text) by any function from a text to ranked items; it runs where the rows are."""

    @F.pandas_udf("array<string>")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: list(run_query(t)))

    return gold.select("query_id", found("query_text").alias("found"))


def evaluated(required: DataFrame, lists: DataFrame) -> DataFrame:
    """Metrics of every query of ``required`` (query_id, required, others)."""
    rows = required.join(lists, "query_id", "left").withColumn("found", F.coalesce("found", F.array().cast(lists.schema["found"].dataType)))
    r, f = F.col("required"), F.col("found")
    return rows.withColumns({"recall_at_5": recall_at(r, f, 5), "recall_at_10": recall_at(r, f, 10), "mrr": reciprocal_rank(r, f), "ndcg_at_5": ndcg_at(r, f, 5), "ndcg_at_10": ndcg_at(r, f, 10)}).drop("required", "found")


METRICS = ("recall_at_5", "recall_at_10", "mrr", "ndcg_at_5", "ndcg_at_10")


def summary(results: DataFrame, *keys: str) -> DataFrame:
    return results.groupBy(*keys).agg(F.count("*").alias("n"), *[F.coalesce(F.round(F.avg(m), 6), F.lit(0.0)).alias(m) for m in METRICS])


def quadrants(results: DataFrame) -> DataFrame:
    """(query_id, quadrant): where one mode finds all and another does not; a query may be in none."""
    wide = results.groupBy("query_id").pivot("mode", ["dense", "sparse", "hybrid"]).agg(F.first("recall_at_5"))
    d, s, h = (F.coalesce(F.col(m), F.lit(0.0)) >= 0.999 for m in ("dense", "sparse", "hybrid"))
    names = {"dense_only_succeeds": d & ~s, "sparse_only_succeeds": s & ~d, "hybrid_fixes_both": h & ~d & ~s, "all_fail": ~h & ~d & ~s}
    return wide.select("query_id", F.explode(F.filter(F.array(*[F.when(t, F.lit(n)) for n, t in names.items()]), lambda x: x.isNotNull())).alias("quadrant"))


def failing(results: DataFrame, mode: str = "hybrid") -> DataFrame:
    """Queries (query_id) that a mode answers with less than full recall in the first five, from results as the sink wrote them."""
    return results.filter((F.col("retrieval_mode") == mode) & (F.col("recall_at_5").cast("double") < 1)).select("query_id")


def diagnosis(rankings: dict[str, DataFrame], mapping: DataFrame, required: DataFrame, cutoffs: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """(query_id, item, mode, rank, within_k): for each required item its first uncompressed rank in each mode, null if it isn't found.

    ``mapping``: (item_id, item); ``required``: (query_id, required).
    """
    wanted = required.select("query_id", F.explode("required").alias("item"))
    sound(required.sparkSession)
    out = None
    for mode, ranking in rankings.items():
        hit = ranking.select("query_id", "item_id", "rank").join(mapping.select("item_id", "item"), "item_id").groupBy("query_id", "item").agg(F.min("rank").alias("rank"))
        one = wanted.join(hit, ["query_id", "item"], "left").withColumn("mode", F.lit(mode))
        out = one if out is None else out.unionByName(one)
    return out.withColumns({f"within_{k}": F.coalesce(F.col("rank") <= k, F.lit(False)) for k in cutoffs})


def counts(gold: DataFrame) -> DataFrame:
    """(kind, value, n): queries by type and by scope."""
    one = lambda kind, column: gold.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "value", "n")
    return one("query_type", "query_type").unionByName(one("evaluation_scope", "evaluation_scope"))


def rank_trace(ranking: DataFrame, required: DataFrame, cutoffs: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """First uncompressed rank of any required item (item_id) for each query, and whether it is within the cutoffs."""
    hit = required.select("query_id", F.explode("required").alias("item_id")).join(ranking, ["query_id", "item_id"]).groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    rows = required.select("query_id").join(hit, "query_id", "left")
    return rows.withColumns({f"within_{k}": F.coalesce(F.col("first_rank") <= k, F.lit(False)) for k in cutoffs})
