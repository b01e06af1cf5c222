"""From a corpus to scored retrieval: the corpus build, modes, and reports."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.mentions import interval, point, versions_in
from ..functions.text import stripped
from ..operators import claims as claim_ops
from ..operators import evaluate, resolve, retrieve, store
from ..session import sound

MODES = ("dense", "sparse", "hybrid", "hybrid_version_filtered")
WEIGHTS = {"rrf_1_1": None, "rrf_dense2_sparse1": [2.0, 1.0], "rrf_dense1_sparse2": [1.0, 2.0]}


def build(docs: DataFrame, package: str | None = None, embed: resolve.Embedder | None = None, extractor: claim_ops.Extractor = claim_ops.declined) -> dict[str, DataFrame]:
    """chunks (with evidence_id), claims, change_records, evidence_links and cannot_link_constraints of documents."""
    sound(docs.sparkSession)
    found = claim_ops.extract_claims(docs, package, extractor)
    linked = resolve.link_evidence(found, embed)
    chunks = claim_ops.chunks_of(docs, package)
    order = found.select("evidence_id", F.struct("doc_ord", "claim_idx").alias("ord"))
    links = linked.filter("kind = 'link'").select("evidence_id", "change_id", "link_type", "link_confidence", "confidence_tier", "link_method", "provenance", "review_status")
    records = linked.filter("kind = 'change'").select("change_id", "symbol_name", "symbol_package", "symbol_kind", "version_from", "version_to", "change_type", "summary", "external_refs", "replacement_symbol", "evidence_id").join(order, "evidence_id").drop("evidence_id")
    pairs = linked.filter("kind = 'cannot_link'").select(F.col("change_id").alias("change_id_a"), F.col("other_change_id").alias("change_id_b"), "reason").distinct()
    return {"chunks": store.with_evidence(chunks, store.owning_chunks(found, chunks)), "claims": found, "change_records": records, "evidence_links": links, "cannot_link_constraints": pairs}


def embedded(items: DataFrame, embed: resolve.Embedder, id_column: str, text: str = "text") -> DataFrame:
    @F.pandas_udf("array<double>")
    def vector(texts: pd.Series) -> pd.Series:
        return pd.Series(list(embed(texts.tolist())) if len(texts) else [], dtype=object)

    return items.select(id_column, vector(text).alias("embedding"))


def query_intervals(gold: DataFrame) -> DataFrame:
    first = F.get(versions_in("query_text"), F.lit(0))
    named = gold.select("query_id", first.alias("v"))
    return named.select("query_id", interval(F.col("v.normalized"), F.col("v.normalized_end"), F.col("v.qualifier")).alias("wanted"))


def candidates(chunks: DataFrame, gold: DataFrame, embed: resolve.Embedder | None = None) -> tuple[DataFrame, DataFrame]:
    """The dense and the sparse candidates of every query: what all modes start from. Chunks are numbered (``n``) in the corpus's order."""
    embed = embed or resolve.hashed_embedder()
    queries = gold.select("query_id", F.col("query_text").alias("text"))
    sparse = retrieve.bm25(chunks.select(F.col("n").alias("item_id"), "text"), queries, retrieve.CANDIDATES)
    near = retrieve.dense(embedded(chunks, embed, "n").withColumnRenamed("n", "item_id"), embedded(queries, embed, "query_id"), retrieve.CANDIDATES, 9)
    return near, sparse


def rankings(chunks: DataFrame, gold: DataFrame, embed: resolve.Embedder | None = None, output: int = retrieve.OUTPUT) -> dict[str, DataFrame]:
    """A ranking of chunks for each mode."""
    near, sparse = candidates(chunks, gold, embed)
    items = chunks.select(F.col("n").alias("item_id"), "package", point(F.col("version")).alias("versions"))
    cut = lambda df: df.filter(F.col("rank") <= output)
    return {"dense": cut(near), "sparse": cut(sparse), "hybrid": retrieve.hybrid(near, sparse, output), "hybrid_version_filtered": retrieve.hybrid(near, sparse, output, items=items, wanted=query_intervals(gold))}


def ablation(chunks: DataFrame, gold: DataFrame, embed: resolve.Embedder | None = None, scorer: retrieve.Scorer | None = None, output: int = retrieve.OUTPUT) -> dict[str, DataFrame]:
    """Rankings by fusion weights, and by reranking all candidates of the equal weights before the cut."""
    near, sparse = candidates(chunks, gold, embed)
    out = {mode: retrieve.hybrid(near, sparse, output, weights=weights) for mode, weights in WEIGHTS.items()}
    pool = retrieve.hybrid(near, sparse, retrieve.CANDIDATES).drop("score")
    texts = chunks.select(F.col("n").alias("item_id"), "text")
    return out | {"hybrid_reranked": retrieve.rerank(pool.join(gold.select("query_id", "query_text"), "query_id").join(texts, "item_id"), output, scorer)}


def numbered(chunks: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """Chunks with a number ``n`` that goes up in the order of documents and chunks (with gaps: up to 2^31 chunks a document)."""
    return chunks.withColumn("n", F.shiftleft(F.col("doc_ord").cast("long"), 31) + F.col("ord"))


def statistics(docs: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n): how many documents, chunks, claims, chunks with evidence and rows of the store there are."""
    named = {"documents": docs, "chunks": tables["chunks"], "unresolved_changes": tables["claims"], "chunks_with_evidence": tables["chunks"].filter("evidence_id is not null"), **{k: tables[k] for k in ("change_records", "evidence_links", "cannot_link_constraints")}}
    out = None
    for name, df in named.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def scored(chunks: DataFrame, links: DataFrame, gold: DataFrame, by_mode: dict[str, DataFrame], level: str = "change") -> DataFrame:
    """Metrics of every query and mode, against the required changes or the relevant evidence."""
    carried = chunks.filter("evidence_id is not null").select(F.col("n").alias("item_id"), "evidence_id")
    if level == "change":
        mapping = carried.join(links.groupBy("evidence_id").agg(F.sort_array(F.collect_list("change_id")).alias("items")), "evidence_id").select("item_id", F.posexplode("items").alias("idx", "item"))
    else:
        mapping = carried.select("item_id", F.lit(0).alias("idx"), F.col("evidence_id").alias("item"))
    required = gold.select("query_id", "query_type", F.col("required_change_ids" if level == "change" else "relevant_evidence_ids").alias("required"))
    out = None
    for mode, ranking in by_mode.items():
        one = evaluate.evaluated(required, evaluate.listed(evaluate.resolve_items(ranking, mapping))).withColumn("mode", F.lit(mode))
        out = one if out is None else out.unionByName(one)
    return out


def checklist(gold: DataFrame, changes: DataFrame, links: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_type, queries, text): for reviewers, each query's required changes with their evidence, NOT FOUND where missing."""
    wanted = gold.select("query_id", "query_text", "query_type", F.posexplode_outer("required_change_ids").alias("pos", "change_id"))
    named = wanted.join(changes.select("change_id", "symbol_name", "change_type", "summary"), "change_id", "left")
    proof = links.join(chunks.filter("evidence_id is not null").select("evidence_id", "text"), "evidence_id", "left").groupBy("change_id").agg(F.sort_array(F.collect_list(F.coalesce("text", F.lit("NOT FOUND")))).alias("texts"))
    line = F.concat(F.lit("- [ ] "), F.coalesce(F.concat(F.col("symbol_name"), F.lit(" "), F.col("change_type"), F.lit(": "), F.col("summary")), F.lit("NOT FOUND")))
    lines = named.join(proof, "change_id", "left").withColumn("line", F.array_join(F.concat(F.array(line), F.coalesce(F.transform("texts", lambda t: F.concat(F.lit("  > "), t)), F.array().cast("array<string>"))), "\n"))
    by_query = lines.groupBy("query_type", "query_id", "query_text").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda s: s["line"]), "\n").alias("body"))
    titled = F.concat(F.lit("### "), F.col("query_id"), F.lit("\n"), F.col("query_text"), F.lit("\n"), F.col("body"))
    return by_query.withColumn("t", titled).groupBy("query_type").agg(F.count("*").alias("queries"), F.array_join(F.sort_array(F.collect_list("t")), "\n\n").alias("text"))


def _missing(rows: DataFrame, column: str, what: str) -> None:
    gone = [r[0] for r in rows.select(column).distinct().orderBy(column).limit(20).collect()]
    if gone:
        raise ValueError(f"{what}: {gone}")


def gold_rows(wanted: DataFrame, changes: DataFrame, links: DataFrame, order: str = "ord", facts: DataFrame | None = None, chunks: DataFrame | None = None) -> DataFrame:
    """(query_id, required_change_ids, relevant_evidence_ids, stability_evidence_ids) of wanted (query_id, symbols).

    Of the changes of a symbol the last by ``order`` counts. Evidence is listed change by change, each change's in order of ids.
    ``facts`` (query_id, fact) are texts that must be a whole chunk's: their queries get that chunk's id and nothing else. A
    symbol without a change or a fact without a chunk raises.
    """
    last = changes.groupBy("symbol_name").agg(F.max_by("change_id", order).alias("change_id"))
    found = wanted.select("query_id", F.posexplode_outer("symbols").alias("pos", "symbol_name")).join(last, "symbol_name", "left")
    _missing(found.filter("symbol_name is not null and change_id is null"), "symbol_name", "no change for")
    proof = links.groupBy("change_id").agg(F.sort_array(F.collect_list("evidence_id")).alias("proof"))
    listed = F.sort_array(F.collect_list(F.when(F.col("change_id").isNotNull(), F.struct("pos", "change_id", F.coalesce("proof", F.array().cast("array<string>")).alias("proof")))))
    rows = found.join(proof, "change_id", "left").groupBy("query_id").agg(listed.alias("l"))
    none = F.array().cast("array<string>")
    out = rows.select("query_id", F.transform("l", lambda x: x["change_id"]).alias("required_change_ids"), F.flatten(F.transform("l", lambda x: x["proof"])).alias("relevant_evidence_ids"), none.alias("stability_evidence_ids"))
    if facts is None:
        return out
    by_text = chunks.groupBy(stripped(F.col("text")).alias("said")).agg(F.max_by("chunk_id", F.struct("doc_ord", "ord")).alias("chunk_id"))
    stable = facts.withColumn("said", stripped(F.col("fact"))).join(by_text, "said", "left")
    _missing(stable.filter("chunk_id is null"), "fact", "no chunk with the text")
    return out.unionByName(stable.select("query_id", none.alias("required_change_ids"), none.alias("relevant_evidence_ids"), F.array("chunk_id").alias("stability_evidence_ids")))


def run(spark: SparkSession, docs: DataFrame, gold: DataFrame, embed: Callable[[list[str]], np.ndarray] | None = None) -> DataFrame:
    """The whole benchmark: build, rank by every mode, score by changes."""
    tables = build(docs, embed=embed)
    chunks = numbered(tables["chunks"], spark)
    return scored(chunks, tables["evidence_links"], gold, rankings(chunks, gold, embed))
