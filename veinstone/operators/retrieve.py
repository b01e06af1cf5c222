"""BM25, exact vectors, rank fusion, filters and reranking; rankings are (query_id, item_id, score, rank)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as text_functions
from ..functions.mentions import overlap
from ..session import sound

# Fixed constants.
K1, B, RRF_K, CANDIDATES, OUTPUT = 1.5, 0.75, 60, 40, 10
#: Vector queries are scored in blocks of this many, word queries together up to so many words.
QUERY_BLOCK, QUERY_TERMS = 2000, 5_000_000
#: Words times queries up to which their weights are a plain matrix (32 MB).
DENSE_CELLS = 4_000_000

# Fixed pattern: what a token is.
_TOKEN = re.compile(r"[A-Za-z_]\w*(?:[.:#]{1,2}[A-Za-z_]\w*)*|\d+(?:\.\d+)*")
_JOINT = re.compile(r"[.:#]+")


def tokenized(text: str | None) -> list[str]:
    """What ``functions.text.tokens`` gives, for Python workers."""
    out = []
    for t in map(str.lower, _TOKEN.findall(text or "")):
        out.append(t)
        if _JOINT.search(t):
            out += filter(None, _JOINT.split(t))
    return out


def check_depth(output: int, candidates: int = CANDIDATES) -> None:
    if candidates <= 0 or output < 0 or output > candidates:
        raise ValueError(f"output {output} of {candidates} candidates")


def top(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows of each query by a total order, with rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= k)


def best(rows: DataFrame, k: int) -> DataFrame:
    return top(rows, k, F.col("score").desc(), F.col("item_id"))


def idf(n: Column | float, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25(items: DataFrame, queries: DataFrame, k: int = OUTPUT, k1: float = K1, b: float = B, most_terms: int = QUERY_TERMS) -> DataFrame:
    """Top k of every query (query_id, text) over items (item_id, text), by score rounded to 6 places, then item_id.

    Queries with up to ``most_terms`` words in all are sent to the scan as a sparse matrix, and two scans with map-side sums
    do: one counts documents per query word, one scores each text against the queries that share a word with it and
    keeps each batch's top k. More queries than that are joined with the postings by a shuffle (``by_postings``).
    """
    asked = queries.select("query_id", text_functions.tokens(F.col("text")).alias("words"))
    if (asked.agg(F.sum(F.size("words"))).head()[0] or 0) > most_terms:
        return by_postings(items, queries, k, k1, b)
    return _bm25(items.select("item_id", "text"), [(r["query_id"], Counter(r["words"])) for r in asked.collect()], k, k1, b, queries.schema["query_id"].dataType.simpleString())


def by_postings(items: DataFrame, queries: DataFrame, k: int = OUTPUT, k1: float = K1, b: float = B) -> DataFrame:
    """The same ranking by joins: any number of queries, words and postings."""
    words = queries.select("query_id", F.explode(text_functions.tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    sized = items.select("item_id", text_functions.tokens(F.col("text")).alias("t"))
    stats = sized.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("average"))
    postings = sized.select("item_id", F.size("t").alias("dl"), F.explode("t").alias("term")).join(words.select("term").distinct(), "term", "left_semi").groupBy("term", "item_id", "dl").agg(F.count("*").alias("f"))
    frequency = postings.groupBy("term").agg(F.count("*").alias("df"))
    average = F.when(F.col("average") > 0, F.col("average")).otherwise(1.0)
    share = F.col("times") * idf(F.col("n"), F.col("df")) * F.col("f") * (k1 + 1) / (F.col("f") + k1 * (1 - b + b * F.col("dl") / average))
    scored = words.join(frequency, "term").join(postings, "term").crossJoin(F.broadcast(stats)).groupBy("query_id", "item_id").agg(F.round(F.sum(share), 6).alias("score"))  # stats is one row
    return best(scored.filter("score > 0"), k)


def _kept(group: np.ndarray, score: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Indices of the first k of each group by score, largest first, then place."""
    order = np.lexsort((place, -score, group))
    sorted_group = group[order]
    first = np.flatnonzero(np.r_[True, sorted_group[1:] != sorted_group[:-1]]) if len(order) else np.empty(0, np.int64)
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
    return order[rank < k]


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def _bm25(items: DataFrame, asked: list, k: int, k1: float, b: float, id_type: str) -> DataFrame:
    spark = items.sparkSession
    words = spark.sparkContext.broadcast({t: i for i, t in enumerate(sorted({t for _, found in asked for t in found}))})
    index = words.value
    item_type = items.schema["item_id"].dataType.simpleString()

    def count(batches):
        index = words.value
        df, n, total = np.zeros(len(index), np.int64), 0, 0
        for batch in batches:
            for text in batch.column(1).to_pylist():
                found = tokenized(text)
                n, total = n + 1, total + len(found)
                for i in {index[t] for t in found if t in index}:
                    df[i] += 1
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *used.tolist()]), pa.array([n, total, *df[used].tolist()])], ["term", "n"])

    stats = dict(items.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect())  # a row for each word of the queries
    n, total = stats.get(-2, 0), stats.get(-1, 0)
    average = (total / n if n else 0) or 1.0
    # Word by word: which queries ask for it, and with what weight.
    entries = [(index[t], q, times) for q, (_, found) in enumerate(asked) for t, times in found.items()]
    term, query, times = (np.array(x, np.int64) for x in zip(*entries, strict=True)) if entries else (np.empty(0, np.int64),) * 3
    order = np.argsort(term, kind="stable")
    df = np.array([stats.get(i, 0) for i in range(len(index))], np.float64)
    weight = (times * np.log(1 + (n - df[term] + 0.5) / (df[term] + 0.5)))[order]
    starts = np.searchsorted(term[order], np.arange(len(index) + 1))
    cells = None
    if len(index) * len(asked) <= DENSE_CELLS:  # few enough for a plain matrix, which is faster where most queries share words with a text
        cells = np.zeros((len(index), len(asked)))
        cells[term[order], query[order]] = weight
    sent = spark.sparkContext.broadcast((starts, query[order], weight, cells, pa.array([q for q, _ in asked], _arrow(id_type))))

    def score(batches):
        index, (starts, by_word, weights, cells, ids) = words.value, sent.value
        for batch in batches:
            rows, terms, shares = [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                found = tokenized(text)
                held = Counter(t for t in found if t in index)
                if held:
                    f = np.fromiter(held.values(), float, len(held))
                    rows.append(np.full(len(held), row))
                    terms.append(np.fromiter((index[t] for t in held), np.int64, len(held)))
                    shares.append(f * (k1 + 1) / (f + k1 * (1 - b + b * len(found) / average)))
            names = batch.column(0)
            if not rows:
                continue
            place = np.empty(batch.num_rows, np.int64)
            place[pa.compute.sort_indices(names).to_numpy()] = np.arange(batch.num_rows)
            if cells is not None:
                for at in range(0, len(rows), 512):
                    own = np.array([int(r[0]) for r in rows[at : at + 512]])
                    scores = np.stack([s @ cells[t] for s, t in zip(shares[at : at + 512], terms[at : at + 512], strict=True)]).round(6)
                    least = -np.partition(-scores, k - 1, axis=0)[k - 1] if len(own) > k > 0 else np.zeros(len(ids))
                    r, q = np.nonzero((scores > 0) & (scores >= least))
                    keep = _kept(q, scores[r, q], place[own[r]], k)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(q[keep])), names.take(pa.array(own[r[keep]])).cast(_arrow(item_type)), pa.array(scores[r[keep], q[keep]])], ["query_id", "item_id", "score"])
                continue
            # Some millions of (query, row) shares at a time.
            row, term, share = np.concatenate(rows), np.concatenate(terms), np.concatenate(shares)
            many = starts[term + 1] - starts[term]
            cuts = np.searchsorted(np.cumsum(many), np.arange(4_000_000, int(many.sum()) + 4_000_000, 4_000_000))
            bounds = sorted({0, *(int(np.searchsorted(row, row[min(c, len(row) - 1)], "right")) for c in cuts), len(row)})
            for low, high in zip(bounds, bounds[1:], strict=False):
                m = many[low:high]
                at = np.repeat(starts[term[low:high]] - np.r_[0, np.cumsum(m)[:-1]], m) + np.arange(int(m.sum()))
                if low == high:
                    continue
                start, wide = int(row[low]), int(row[high - 1] - row[low]) + 1
                key, value = by_word[at] * wide + np.repeat(row[low:high] - start, m), weights[at] * np.repeat(share[low:high], m)
                if len(ids) * wide <= 8 * len(key):  # most pairs are there: sums by place, else by sorting
                    pair, scores = np.arange(len(ids) * wide), np.bincount(key, value, len(ids) * wide).round(6)
                else:
                    pair, inverse = np.unique(key, return_inverse=True)
                    scores = np.bincount(inverse, value).round(6)
                q, r = np.divmod(pair[scores > 0], wide)
                scores, r = scores[scores > 0], r + start
                keep = _kept(q, scores, place[r], k)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(q[keep])), names.take(pa.array(r[keep])).cast(_arrow(item_type)), pa.array(scores[keep])], ["query_id", "item_id", "score"])

    return best(items.mapInArrow(score, f"query_id {id_type}, item_id {item_type}, score double"), k)


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as a matrix, from the array's own buffer."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def dense(items: DataFrame, queries: DataFrame, k: int = OUTPUT, places: int = 6) -> DataFrame:
    """Top k by squared distance of unit or other vectors (item_id, embedding), smallest first; score is the distance.

    Queries are broadcast in blocks of ``QUERY_BLOCK``; each batch is one matrix product and keeps its top k.
    """
    spark = items.sparkSession
    id_type, item_type = (df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (items, "item_id")))
    asked = queries.select("query_id", F.col("embedding").cast("array<double>")).toArrow().sort_by("query_id").combine_chunks()
    out = None
    for start in range(0, max(1, asked.num_rows), QUERY_BLOCK):
        block = asked.slice(start, QUERY_BLOCK)
        sent = spark.sparkContext.broadcast((block["query_id"].combine_chunks(), _matrix(block["embedding"].combine_chunks())))

        def score(batches, sent=sent):
            ids, q = sent.value
            for batch in batches:
                if not batch.num_rows or not len(ids):
                    continue
                x = _matrix(batch.column(1))
                far = np.round(np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * q @ x.T, 0), places)
                place = np.empty(batch.num_rows, np.int64)
                place[pa.compute.sort_indices(batch.column(0)).to_numpy()] = np.arange(batch.num_rows)
                near = np.arange(batch.num_rows)[None, :].repeat(len(ids), 0) if batch.num_rows <= 4 * k else np.argpartition(far, k, axis=1)[:, : k + 1]
                limit = np.take_along_axis(far, near, 1).max(axis=1, keepdims=True) if batch.num_rows > 4 * k else np.full((len(ids), 1), np.inf)
                i, o = np.nonzero(far <= limit)  # with all that are as near as the last
                keep = _kept(i, -far[i, o], place[o], k)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(i[keep])), batch.column(0).take(pa.array(o[keep])), pa.array(far[i[keep], o[keep]])], ["query_id", "item_id", "score"])

        one = items.select("item_id", F.col("embedding").cast("array<double>")).mapInArrow(score, f"query_id {id_type}, item_id {item_type}, score double")
        out = one if out is None else out.unionByName(one)
    return top(out, k, F.col("score"), F.col("item_id"))


def retrieve_sparse(items: DataFrame, queries: DataFrame, output: int = OUTPUT, candidates: int = CANDIDATES, **filters) -> DataFrame:
    """BM25's candidates, filtered and cut."""
    return _retrieved(lambda: bm25(items, queries, candidates), output, candidates, filters)


def retrieve_dense(items: DataFrame, queries: DataFrame, output: int = OUTPUT, candidates: int = CANDIDATES, **filters) -> DataFrame:
    """The nearest vectors' candidates, filtered and cut."""
    return _retrieved(lambda: dense(items, queries, candidates), output, candidates, filters)


def _retrieved(ranked: Callable[[], DataFrame], output: int, candidates: int, filters: dict) -> DataFrame:
    check_depth(output, candidates)
    found = ranked()
    return (filtered(found, **filters) if filters else found).filter(F.col("rank") <= output)


def fuse(rankings: list[DataFrame], weights: list[float] | None = None, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion; ties go by the place in the first ranking that has the item."""
    weights = weights or [1.0] * len(rankings)
    if len(weights) != len(rankings):
        raise ValueError("a weight for each ranking")
    out = None
    for i, (ranking, w) in enumerate(zip(rankings, weights, strict=True)):
        one = ranking.select("query_id", "item_id", (F.lit(float(w)) / (k + F.col("rank"))).alias("part"), F.struct(F.lit(i).alias("list"), F.col("rank")).alias("place"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no rankings")
    sound(out.sparkSession)
    summed = out.groupBy("query_id", "item_id").agg(F.round(F.sum("part"), 9).alias("score"), F.min("place").alias("place"))
    return top(summed, 1 << 30, F.col("score").desc(), F.col("place.list"), F.col("place.rank")).drop("place")


def filtered(ranking: DataFrame, items: DataFrame, package: str | None = None, wanted: DataFrame | None = None, output: int | None = None) -> DataFrame:
    """Drops ranked items of another known package, or whose known version interval misses the query's; ranks run again from 1.

    ``items``: item_id, package, versions (struct<start, end>); ``wanted``: query_id, wanted (the same struct). To be used
    after the candidates are cut: a filter before the cut would give other results.
    """
    rows = ranking.join(items.select("item_id", "package", "versions"), "item_id")
    if package:
        rows = rows.filter(F.nullif("package", F.lit("")).isNull() | (F.col("package") == package))
    if wanted is not None:
        rows = rows.join(wanted, "query_id", "left").filter(F.col("wanted").isNull() | F.col("versions").isNull() | overlap(F.col("wanted"), F.col("versions"))).drop("wanted")
    return top(rows.drop("package", "versions").withColumnRenamed("rank", "was"), output if output is not None else 1 << 30, F.col("was")).drop("was")


def hybrid(dense_ranking: DataFrame, sparse_ranking: DataFrame, output: int = OUTPUT, candidates: int = CANDIDATES, weights: list[float] | None = None, **filters) -> DataFrame:
    """Fuses the candidates of both, filters, and cuts."""
    check_depth(output, candidates)
    fused = fuse([dense_ranking.filter(F.col("rank") <= candidates), sparse_ranking.filter(F.col("rank") <= candidates)], weights)
    fused = filtered(fused, **filters) if filters else fused
    return fused.filter(F.col("rank") <= output)


Scorer = Callable[[list[tuple[str, str]]], list[float]]


def rerank(candidates: DataFrame, output: int, scorer: Scorer | None = None) -> DataFrame:
    """Orders candidates (query_id, query_text, item_id, text, rank) anew by a model's scores, ties by the old rank."""
    if output < 0:
        raise ValueError("output must not be negative")
    if output == 0:
        return candidates.select("query_id", "item_id", F.lit(0.0).alias("score"), "rank").limit(0)
    scorer = scorer or word_overlap

    @F.pandas_udf("double")
    def scored(query: pd.Series, text: pd.Series) -> pd.Series:
        found = list(scorer(list(zip(query, text, strict=True)))) if len(query) else []
        if len(found) != len(query) or not np.isfinite(np.array(found, float)).all():
            raise ValueError("one finite score for each candidate")
        return pd.Series(found, dtype="float64")

    rows = candidates.withColumn("score", scored("query_text", "text")).withColumnRenamed("rank", "was")
    return top(rows, output, F.col("score").desc(), F.col("was")).select("query_id", "item_id", "score", "rank")


def word_overlap(pairs: list[tuple[str, str]]) -> list[float]:
    """A deterministic stand-in for a cross-encoder: the share of the query's distinct words that the text has."""
    out = []
    for query, text in pairs:
        words, there = set(tokenized(query)), set(tokenized(text))
        out.append(len(words & there) / len(words) if words else 0.0)
    return out


# Fixed text: the prompt before the context, before the question, and after it. Lines are indented by four spaces.
PROMPT = (
    "\n    Answer the question using only the provided context.\n    If the answer cannot be found in the context, say that you do not have enough information.\n    Context:\n    ",
    "\n    Question:\n    ",
    "\n    Answer:\n    ",
)


def prompt(question: Column, contexts: Column) -> Column:
    """The model's prompt for a question and its ordered contexts."""
    return F.concat(F.lit(PROMPT[0]), F.array_join(contexts, "\n"), F.lit(PROMPT[1]), question, F.lit(PROMPT[2]))
