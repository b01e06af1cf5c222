"""Mixing sources to target weights by Sainte-Lague apportionment of equal blocks of words.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and share the words of all sources; no target
exceeds ``MOST_EPOCHS`` times its source's size, and what is over is shared again by weight.

Each source is dealt by a seeded hash into shards of about ``SHARD_DOCS`` documents. A shard's documents, in seeded
order, are one stream of words cut into blocks of ``BLOCK_WORDS``. Seats (blocks) go to sources by the highest quotients
target / (2 k + 1), then each source's seats to regions of ``REGION_SHARDS`` shards and each region's to its shards in the
same way, so that quotas are whole and near their shares. A shard whose quota is q full rounds and r blocks takes every
document q times and r blocks chosen by a seeded permutation of groups of neighbouring blocks; a document's part is the
overlap with its place in the stream.

Equal rows are counted before the shuffle and dealt as runs of up to ``RUN`` copies, each run by a hash of its own, so
neither a hot source nor a row with a third of all repeats is more than many shards. No group has more than about
``SHARD_DOCS`` runs or ``REGION_SHARDS`` shards. What reaches the driver is one row per source.

Defined results: a null or blank text has size 0 and takes 0. A source of null is a source of its own, as is an absent
source column. Repeated rows of a doc_id are documents of their own; rows equal in doc_id, source and text are
interchangeable, and it is not defined which of them (by other columns) takes which part. A null doc_id is a doc_id like
others. Other columns are ignored, or kept by ``mix`` under any name. An empty table gives an empty result. Reruns agree,
as nothing depends on partitions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACES, Sealed, cut, let, n_words, table
from .sharding import permuted

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
SHARD_DOCS = 4000
REGION_SHARDS = 2000
#: Copies of a row that are dealt together.
RUN = 64
#: A source misses its target by a block at most, and by the words that its shards' last blocks lack.
BLOCK_WORDS = 32
#: So many blocks that follow each other are chosen together where the quota allows, so that texts are cut seldom.
TOGETHER = 8
#: Sources beyond this many are refused: their table would not be small.
MOST_SOURCES = 1_000_000


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> list[float]:
    """The target of each source, in order."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    out: list[float | None] = [None] * len(sizes)
    while True:
        open_ = [i for i, x in enumerate(out) if x is None]
        left = sum(sizes) - sum(x for x in out if x is not None)
        total = sum(weight[i] for i in open_)
        over = [i for i in open_ if left * weight[i] / total > most * sizes[i]]
        if not over:
            return [float(left * weight[i] / total) if x is None else float(x) for i, x in enumerate(out)]
        for i in over:
            out[i] = most * sizes[i]


def sainte_lague(votes: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Seats by the highest quotients votes / (2 k + 1), at most ``most`` each; ties go to the first.

    All seats whose quotient is above a threshold are found at once by bisection; the few that share the last threshold are dealt in order.
    """
    votes, most = votes.astype(np.float64), most.astype(np.int64)
    seats = min(seats, int(most[votes > 0].sum()))
    if seats <= 0:
        return np.zeros(len(votes), np.int64)
    held = lambda t: np.minimum(most, np.where(votes > 0, np.floor((votes / t + 1) / 2), 0).astype(np.int64))
    low, high = votes[votes > 0].min() / (4.0 * most.max() + 8), votes.max() * 2
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        low, high = (middle, high) if held(middle).sum() >= seats else (low, middle)
    won = held(high)
    rest = seats - int(won.sum())
    with np.errstate(divide="ignore"):
        quotient = np.where((won < most) & (votes > 0), votes / (2 * won + 1), -1)
    for i in np.argsort(-quotient, kind="stable")[:rest]:
        won[i] += 1
    return won


def _quotas(key: str):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """Seats of a group to its members, in order of ``key``."""
        group = group.sort_values(key, ignore_index=True)
        most = group["blocks"].to_numpy() * MOST_EPOCHS
        return group.assign(quota=sainte_lague(group["words"].to_numpy(), int(group["seats"].iloc[0]), most))[["source_no", key, "quota"]]

    return run


def chosen_blocks(n: int, more: int, seed: int) -> np.ndarray:
    """For each of n blocks whether it is one of the ``more`` that come first when groups of TOGETHER blocks are put in a seeded order."""
    places = permuted(np.arange(-(-n // TOGETHER)), -(-n // TOGETHER), seed)
    picked = np.zeros(n, bool)
    picked[np.argsort(places[np.arange(n) // TOGETHER], kind="stable")[:more]] = True
    return picked


def _laid(block: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """Lays a shard's runs out as a stream and takes its quota: one row for each copy."""
        group = group.sort_values(["draw", "other", "run"], kind="stable", ignore_index=True)
        rows = np.repeat(np.arange(len(group)), group["copies"])
        size = group["size"].to_numpy()[rows]
        start = np.cumsum(group["copies"].to_numpy()) - group["copies"].to_numpy()
        number = group["run"].to_numpy()[rows] * RUN + np.arange(len(rows)) - start[rows]
        ends = np.cumsum(size)
        first, total = ends - size, int(size.sum())
        n = max(1, -(-total // block))
        rounds, more = divmod(int(group["quota"].iloc[0]), n)
        picked = chosen_blocks(n, more, int(group["draw"].iloc[0]) & 0x7FFFFFFF)
        held = np.minimum(np.arange(1, n + 1) * block, total) - np.arange(n) * block
        before = np.concatenate([[0], np.cumsum(np.where(picked, held, 0))])
        inside = lambda x: before[x // block] + np.where(np.append(picked, False)[x // block], x % block, 0)  # noqa: E731  words taken before place x
        taken = rounds * size + inside(ends) - inside(first)
        low, high = first // block, np.where(size > 0, (ends - 1) // block + 1, first // block)
        chosen = [np.flatnonzero(picked[a:b]) + a for a, b in zip(low.tolist(), high.tolist(), strict=True)]
        out = group[["doc_id", "draw", "other", "source_size", "target"]].iloc[rows].reset_index(drop=True)
        return out.assign(number=number, size=size, taken=taken, rounds=rounds, first=first, block=block, chosen=chosen)

    return run


_LAID = "doc_id long, draw long, other long, number long, size long, source_size long, target double, taken long, rounds long, first long, block long, chosen array<long>"


def keyed(sealed: Sealed, seed: int) -> DataFrame:
    """The rows with what names them: doc_id and two hashes of source and text."""
    doc, source, text = sealed.of("doc_id").cast("long"), sealed.of("source", "string"), sealed.of("text")
    return sealed.df.withColumns({"doc_id": doc, "source": source, "draw": F.xxhash64(F.lit(seed), doc, source, text), "other": F.xxhash64(F.lit(seed + 1), text, F.length(text), source)})


def planned(docs: DataFrame, seed: int = 4, weights: tuple[int, ...] = WEIGHTS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` (doc_id, text, source) -> a row for each: doc_id, size, source_size, target, taken; and for ``mix`` its name
    (draw, other, number among equals) and how: rounds, first, block, chosen (block numbers)."""
    spark = docs.sparkSession
    sealed = Sealed(docs)
    rows = keyed(sealed, seed).select("doc_id", "source", "draw", "other", n_words(sealed.of("text")).alias("size"))
    equal = cut(rows.groupBy("doc_id", "source", "draw", "other", "size").agg(F.count("*").alias("n")))
    runs = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {RUN}")))
    dealt = equal.select("doc_id", "source", "draw", "other", "size", "n", runs.alias("run")).withColumn("copies", F.least(F.lit(RUN).cast("long"), F.col("n") - F.col("run") * RUN))
    found = dealt.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count("*").alias("runs")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"over {MOST_SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    aims = targets([r["source_size"] for r in found], weights) if found else []
    most = np.array([MOST_EPOCHS * -(-r["source_size"] // block_words) for r in found], np.int64)
    seats = sainte_lague(np.array(aims), round(sum(aims) / block_words), most) if found else []
    table_ = [(r["source"], i, r["source_size"], float(t), int(s), max(1, -(-r["runs"] // SHARD_DOCS))) for i, (r, t, s) in enumerate(zip(found, aims, seats, strict=True))]
    sources = spark.createDataFrame(table_, "of_source string, source_no long, source_size long, target double, source_seats long, shards long")
    # At most MOST_SOURCES narrow rows.
    placed = dealt.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("of_source"))).drop("source", "of_source").withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "draw", "other", "run"), "shards"))
    shards = cut(placed.groupBy("source_no", "shard", "source_seats").agg(F.sum(F.col("size") * F.col("copies")).alias("words")).withColumns({"blocks": F.ceil(F.col("words") / block_words), "region": F.expr(f"shard div {REGION_SHARDS}")}))
    regions = shards.groupBy("source_no", "region", F.col("source_seats").alias("seats")).agg(F.sum("words").alias("words"), F.sum("blocks").alias("blocks"))
    regional = regions.groupBy("source_no").applyInPandas(_quotas("region"), "source_no long, region long, quota long")
    seated = shards.join(regional.withColumnRenamed("quota", "seats"), ["source_no", "region"])
    quotas = seated.groupBy("source_no", "region").applyInPandas(_quotas("shard"), "source_no long, shard long, quota long")
    stream = placed.join(quotas, ["source_no", "shard"])
    return stream.groupBy("source_no", "shard").applyInPandas(_laid(block_words), _LAID)


def _numbered(rows: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` (doc_id, draw, other and more) with ``number`` from 0 among rows with equal names, however many they are.

    The rows are cut first, so that their partitions stay as they are; each partition counts its own, from where those before it end.
    """
    held = cut(rows.withColumn("mid", F.monotonically_increasing_id())).withColumn("part", F.shiftright("mid", 33))
    counts = held.groupBy(*names, "part").agg(F.count("*").alias("c"))
    before = Window.partitionBy(*names).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("start", F.coalesce(F.sum("c").over(before), F.lit(0))).drop("c")
    own = held.withColumn("place", F.row_number().over(Window.partitionBy(*names, "part").orderBy("mid")) - 1)
    same = F.lit(True)
    for c in [*names, "part"]:
        same = same & F.col(f"o.{c}").eqNullSafe(F.col(f"s.{c}"))
    return own.alias("o").join(starts.alias("s"), same).select("o.*", (F.col("o.place") + F.col("s.start")).alias("number")).drop("mid", "part", "place")


def mix(docs: DataFrame, seed: int = 4, weights: tuple[int, ...] = WEIGHTS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mixed documents, in the columns of ``docs``: whole rounds are the text repeated, then its chosen blocks; none taken: gone."""
    sealed, names = Sealed(docs), ["doc_id", "draw", "other"]
    rows = keyed(sealed, seed)
    every = cut(planned(docs, seed, weights, block_words).select(*names, "number", "taken", F.struct("rounds", "first", "block", "chosen", "size").alias("how")))
    how, twice = every.filter("taken > 0").drop("taken"), every.filter("number > 0").select(*names).distinct()
    if twice.limit(1).count():
        same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["draw"] == b["draw"]) & (a["other"] == b["other"])
        many = cut(twice)
        single = rows.join(many, same(rows, many), "left_anti").withColumn("number", F.lit(0).cast("long"))
        rows = single.unionByName(_numbered(rows.join(many, same(rows, many), "left_semi"), names))
    else:
        rows = rows.withColumn("number", F.lit(0).cast("long"))
    plan = how.select(*[F.col(c).alias(f"of_{c}") for c in [*names, "number"]], "how")
    met = F.col("doc_id").eqNullSafe(F.col("of_doc_id")) & (F.col("draw") == F.col("of_draw")) & (F.col("other") == F.col("of_other")) & (F.col("number") == F.col("of_number"))
    # Words keep the white space after them, so that lines survive.
    source = sealed.of("text")
    worded = F.regexp_extract_all(F.regexp_replace(source, f"^[{SPACES}]+", ""), F.lit(f"[^{SPACES}]+[{SPACES}]*"), F.lit(0))
    part = lambda w, h: F.array_join(F.flatten(F.transform(h["chosen"], lambda j: F.slice(w, (F.greatest(j * h["block"] - h["first"], F.lit(0)) + 1).cast("int"), (F.least((j + 1) * h["block"] - h["first"], h["size"]) - F.greatest(j * h["block"] - h["first"], F.lit(0))).cast("int")))), "")
    parts = F.when(F.size("how.chosen") > 0, F.array(let(worded, lambda w: part(w, F.col("how"))))).otherwise(F.array().cast("array<string>"))
    text = F.array_join(F.concat(F.array_repeat(source, F.col("how.rounds").cast("int")), parts), "\n")
    out = rows.join(plan, met).withColumn("mixed", text)
    counted = {} if sealed.place("n_chars") is None else {"n_chars": F.length("mixed").cast("long")}
    return sealed.opened(out, {"text": F.col("mixed"), **counted})


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return planned(docs).select("doc_id", "size", "source_size", "target", "taken")
