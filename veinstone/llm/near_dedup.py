"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A document is the set of its distinct 5-word shingles (words are runs of non-space, A-Z lower-cased). The sketch has
``COORDS`` coordinates. In round i every shingle is hashed to one coordinate with a value in [i, i+1) and each
coordinate keeps its smallest value; rounds go on until all are filled, and from round ``COORDS`` on round i throws
every shingle at coordinate i - ``COORDS``, so filling is certain. That costs O(size + COORDS log COORDS) instead of
size * COORDS hashes, and agreement of coordinates is concentrated about the Jaccard similarity.

``BANDS`` bands of ``ROWS`` coordinates find candidates: two documents with similarity 0.75 miss all bands with
probability (1 - 0.75**4)**32, about 5e-6. Every candidate pair counts only after it is confirmed on the full sets of
64-bit shingle hashes.

How it stays bounded: documents with equal sets are one node from the start (hash aggregate with map-side combine), so
copies never pair up. In a bucket of a band each node is first paired with the bucket's smallest node only. Then only
nodes that share a bucket but are not yet in one component are compared: in buckets of up to ``SMALL`` nodes as pairs, in
larger ones in blocks. There the nodes outside the bucket's largest component (the strangers) meet blocks of all nodes:
a bucket of m nodes with s strangers makes about (m s / ``BLOCK_NODES``) * 2 rows and not m * m, intersections are
counted as matrices, and only links that unite two components come out. So no link between components is lost. Nothing but
counts reaches the driver.

Defined results: null or blank texts have no shingles, n_shingles 0, and link with nothing. Repeated rows are returned
each; equal texts, and texts under one doc_id, are told apart by doc_id and text alone. component_id is the smallest
non-null doc_id of the component, null if it has none; a row is kept where its doc_id is that, or both are null.
``deduplicated`` keeps one row of each component (the smallest doc_id, null last, then the smallest hash) and all rows
without shingles. Columns other than doc_id and text, under any name, are ignored by the one and passed on by the other.
An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Sealed, cut, mix64, release, table
from .graph import components

SHINGLE = 5
COORDS, ROWS = 128, 4
BANDS = COORDS // ROWS
#: Odd multipliers, one for each place in a shingle.
PLACES = mix64(np.arange(1, SHINGLE + 1, dtype=np.uint64)) | np.uint64(1)
#: Ids of candidates up to this many go to all executors; more are joined by a shuffle of the texts.
BROADCAST_IDS = 2_000_000
#: Buckets up to this many nodes are compared as pairs of rows, larger ones in blocks.
SMALL = 16
#: A block holds about so many shingles and nodes.
BLOCK_SHINGLES, BLOCK_NODES = 250_000, 128
#: Narrow rows of a partition.
TASK_ROWS = 10_000
#: What names a row's text without moving it.
NAME = ["doc_id", "text_hash"]


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a UTF-8 text."""
    words = (text or b"").lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(h) < SHINGLE:
        return mix64(np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=len(h))], np.uint64))
    with np.errstate(over="ignore"):
        n = len(h) - SHINGLE + 1
        total = h[:n] * PLACES[0]
        for k in range(1, SHINGLE):
            total += mix64(h[k : n + k] ^ PLACES[k]) * PLACES[k]
    return np.unique(mix64(total))


def sketch(found: np.ndarray) -> np.ndarray:
    """COORDS values of a non-empty set."""
    out = np.full(COORDS, np.iinfo(np.uint64).max, np.uint64)
    empty = np.ones(COORDS, bool)
    for i in range(2 * COORDS):
        with np.errstate(over="ignore"):
            x = mix64(found + np.uint64(i + 1) * np.uint64(0x9E3779B97F4A7C15))
        if i < COORDS:
            x.sort()
            coordinate = (x >> np.uint64(57)).astype(np.int64)
            first = np.flatnonzero(np.diff(coordinate, prepend=-1))
            at, least = coordinate[first], x[first]
        else:
            at, least = np.array([i - COORDS]), x.min(keepdims=True)
        fresh = empty[at]
        at, least = at[fresh], least[fresh]
        out[at] = (least & np.uint64((1 << 56) - 1)) | np.uint64((i & 255) << 56)
        empty[at] = False
        if not empty.any():
            break
    return mix64(out)


def bands(coordinates: np.ndarray) -> np.ndarray:
    """BANDS hashes; the band's number is part of each."""
    rows = coordinates.reshape(BANDS, ROWS)
    with np.errstate(over="ignore"):
        total = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for k in range(ROWS):
            total = mix64(total ^ rows[:, k])
    return total


def _sketched(batches):
    for batch in batches:
        texts = batch.column(2).cast(pa.binary()).to_pylist()
        sizes, digests, banded = [], [], []
        seen: dict[bytes, tuple] = {}
        for text in texts:
            key = xxhash.xxh3_128_digest(text or b"")
            if key not in seen:
                s = shingles(text)
                if len(s):
                    seen[key] = (len(s), xxhash.xxh3_128_digest(s.tobytes()), bands(sketch(s)).view(np.int64))
                else:
                    seen[key] = (0, None, None)
            n, d, b = seen[key]
            sizes.append(n), digests.append(d), banded.append(b)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(banded, pa.list_(pa.int64()))], ["doc_id", "text_hash", "n_shingles", "digest", "bands"])
    release()


def _sets(batches):
    for batch in batches:
        nodes, found, seen = [], [], set()
        for node, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            if node not in seen:
                seen.add(node)
                nodes.append(node)
                found.append(shingles(text).view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["node", "found"])
    release()


def named(sealed: Sealed) -> DataFrame:
    """The rows with ``NAME``."""
    return sealed.df.withColumns({"doc_id": sealed.of("doc_id").cast("long"), "text_hash": F.xxhash64(sealed.of("text")), "whole": sealed.of("text")})


def same(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])


def fitted(rows: DataFrame) -> DataFrame:
    """Narrow ``rows``, cut, in as many partitions as they ask for: what follows is then not mostly empty tasks."""
    rows = cut(rows)
    return rows.coalesce(-(-rows.count() // TASK_ROWS) or 1)


def bounded(rows: DataFrame) -> DataFrame:
    """``rows`` (cut), to be sent to all executors if they are few enough; more are joined by a shuffle."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows


def sets_of(texts: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, found): the full sets of ``nodes``, made from one text of each class."""
    wanted = bounded(cut(classes.join(nodes, "node", "left_semi").select("node", *NAME)))
    met = texts.join(wanted, same(texts, wanted)).select(wanted["node"], texts["whole"])
    return met.mapInArrow(_sets, "node long, found array<long>").dropDuplicates(["node"])


def verified(texts: DataFrame, classes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose full sets are similar enough; the sets are made once."""
    pairs = fitted(pairs)
    sets = cut(sets_of(texts, classes, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()))
    left, right = sets.select(F.col("node").alias("a"), F.col("found").alias("x")), sets.select(F.col("node").alias("b"), F.col("found").alias("y"))
    n, m = F.size("x"), F.size("y")
    near = pairs.join(left, "a").join(right, "b").filter((n * 100 >= m * percent) & (m * 100 >= n * percent)).withColumn("both", F.size(F.array_intersect("x", "y")))
    return near.filter(F.col("both") * 100 >= (n + m - F.col("both")) * percent).select("a", "b")


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections. Shingles of few sets are counted pair by pair, those of many as a matrix product."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(np.concatenate(sets), kind="stable")
    _, inverse, count = np.unique(np.concatenate(sets)[order], return_inverse=True, return_counts=True)
    owner, many = owner[order], count[inverse]
    total = np.zeros((n, n), np.float32)
    few = many <= 32
    o, g = owner[few], inverse[few]
    for lag in range(1, int(many[few].max(initial=1))):
        same = g[lag:] == g[:-lag]
        if not same.any():
            break
        total += np.bincount(o[:-lag][same] * n + o[lag:][same], minlength=n * n).reshape(n, n)
    total += total.T
    columns, place = np.unique(inverse[~few], return_inverse=True)
    for start in range(0, len(columns), 1024):
        inside = (place >= start) & (place < start + 1024)
        matrix = np.zeros((n, 1024), np.float32)
        matrix[owner[~few][inside], place[inside] - start] = 1
        total += matrix @ matrix.T
    np.fill_diagonal(total, 0)
    return total


def _uniting(percent: int):
    def links(group: pd.DataFrame) -> pd.DataFrame:
        """Links of a block that unite different labels, one for each two that meet: strangers against all of the block."""
        strange = set(group.loc[group["stranger"], "node"])
        group = group.drop_duplicates("node")
        node, label = group["node"].to_numpy(), group["label"].to_numpy().copy()
        out: list[tuple[int, int]] = []
        if len(set(label)) > 1:
            both = intersections(list(group["found"]))
            size = np.array([len(x) for x in group["found"]], np.float64)
            for i in (k for k, x in enumerate(node) if x in strange):
                near = both[i].astype(np.float64) * 100 >= (size[i] + size - both[i]) * percent
                for j in np.flatnonzero(near & (label != label[i])):
                    if label[j] != label[i]:
                        out.append((node[i], node[j]))
                        label[label == label[j]] = label[i]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return links


def _in_blocks(texts: DataFrame, classes: DataFrame, rest: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different labels in buckets (band, node, n, label) of any size."""
    by_label = rest.groupBy("band", "label").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    shape = by_label.groupBy("band").agg(F.max(F.struct("c", "s", "label")).alias("top"), F.sum("c").alias("members"), F.sum("s").alias("total"))
    parts = lambda total, members: F.greatest(F.ceil(total / BLOCK_SHINGLES), F.ceil(members / BLOCK_NODES), F.lit(1)).cast("long")
    shape = shape.select("band", F.col("top.label").alias("main"), parts(F.col("total"), F.col("members")).alias("blocks"), parts(F.col("total") - F.col("top.s"), F.col("members") - F.col("top.c")).alias("asks"))
    placed = rest.join(bounded(cut(shape)), "band").withColumns({"block": F.pmod(F.xxhash64("node"), "blocks"), "ask": F.pmod(F.xxhash64(F.lit(1), "node"), "asks"), "stranger": F.col("label") != F.col("main")})
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    held = placed.select("band", "block", numbers("asks").alias("ask"), "node", "label", F.lit(False).alias("stranger"))
    asked = placed.filter("stranger").select("band", numbers("blocks").alias("block"), "ask", "node", "label", "stranger")
    sets = cut(sets_of(texts, classes, rest.select("node").distinct()))
    return held.unionByName(asked).join(sets, "node").select("band", "block", "ask", "node", "label", "stranger", "found").groupBy("band", "block", "ask").applyInPandas(_uniting(percent), "a long, b long")


def classified(sealed: Sealed, percent: int = 75) -> tuple[DataFrame, DataFrame]:
    """Rows (``NAME``, n_shingles, digest), and (digest, label, component_id) of the classes of equal sets."""
    texts = named(sealed).select(*NAME, "whole")
    meta = fitted(texts.mapInArrow(_sketched, "doc_id long, text_hash long, n_shingles long, digest binary, bands array<long>"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), *NAME)).alias("at")
    classes = meta.filter("digest is not null").groupBy("digest").agg(first)
    classes = fitted(classes.select("digest", "at.doc_id", "at.text_hash").withColumn("node", F.monotonically_increasing_id()))
    nodes = meta.filter("digest is not null").groupBy("digest").agg(F.first("n_shingles").alias("n"), F.first("bands").alias("bands")).join(classes.select("digest", "node"), "digest")
    nodes = fitted(nodes.select("node", "n", "bands"))
    spread = nodes.select(F.explode("bands").alias("band"), "node", "n")
    # What is summed up by band or label is cut before it is joined: only so can the join split a hot one.
    hubs = cut(spread.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("last")).filter("hub != last"))
    shared = fitted(spread.join(bounded(hubs.select("band", "hub")), "band"))
    links = fitted(verified(texts, classes, shared.filter("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), percent))
    # What shares a bucket and is not yet known to be connected.
    known = components(links)
    placed = fitted(shared.join(known, "node", "left").withColumn("label", F.coalesce("label", "node")))
    unsettled = placed.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("members")).filter("lo != hi")
    rest = fitted(placed.join(bounded(cut(unsettled.select("band", "members"))), "band"))
    side = lambda s: rest.filter(F.col("members") <= SMALL).select("band", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "label", "hub")])
    close = (F.col("n_a") * 100 >= F.col("n_b") * percent) & (F.col("n_b") * 100 >= F.col("n_a") * percent)
    fresh = (F.col("node_a") < F.col("node_b")) & (F.col("label_a") != F.col("label_b")) & (F.col("node_a") != F.col("hub_a"))
    pairs = side("a").join(side("b"), "band").filter(fresh & close).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
    more = fitted(verified(texts, classes, pairs, percent).union(_in_blocks(texts, classes, rest.filter(F.col("members") > SMALL).select("band", "node", "n", "label"), percent)))
    final = components(links.union(more)) if more.limit(1).count() else known
    of_all = classes.join(final, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = of_all.groupBy("label").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).filter("n > 1").select("label", "least")
    joined = of_all.join(bounded(cut(least)), "label", "left")
    return meta.drop("bands"), joined.select("digest", "label", F.coalesce("least", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One row per row of ``docs`` (doc_id long, text string): doc_id, n_shingles, component_id, kept."""
    rows, classes = classified(Sealed(docs), percent)
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = rows.join(classes, "digest", "left").withColumn("component", component)
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"))


def deduplicated(docs: DataFrame, percent: int = 75) -> DataFrame:
    """``docs`` without all but one row of each component."""
    sealed = Sealed(docs)
    rows, classes = classified(sealed, percent)
    counted = fitted(rows.filter("digest is not null").groupBy("digest", *NAME).agg(F.count("*").alias("rows")).join(classes, "digest").select("label", *NAME, "rows"))
    first = counted.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), *NAME)).alias("first"))
    told = counted.join(bounded(cut(first)), "label").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash")))
    dropped = bounded(cut(told.filter("not stays").select(*NAME).distinct()))
    every = named(sealed)
    out = every.join(dropped, same(every, dropped), "left_anti")
    again = cut(told.filter("stays and rows > 1").select(*NAME))
    if again.limit(1).count():  # rows equal in doc_id and text: the one with the smallest hash of all its columns
        again = bounded(again)
        once = out.join(again, same(out, again), "left_anti")
        whole = F.struct(F.xxhash64(*sealed.df.columns).alias("h"), F.struct(*sealed.df.columns).alias("row"))
        one = out.join(again, same(out, again), "left_semi").groupBy(*NAME).agg(F.min(whole).alias("m")).select("m.row.*")
        out = once.select(*sealed.df.columns).unionByName(one)
    return sealed.opened(out)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
