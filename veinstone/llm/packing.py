"""Packing documents into fixed sequences: first-fit decreasing over a tournament tree of bin capacities.

Each text is tokenised once, end id 1 is appended, and the ids are cut into whole sequences and one shorter rest. Only
a narrow row for each piece (place, length, checksum) leaves the scan: no ids are shuffled. Documents are dealt to
randomised groups by a seeded hash, and each group is packed by itself: pieces from long to short, each into the first
bin that still holds it, which the tournament tree finds in O(log bins).

Groups hold about ``GROUP_DOCS`` documents, or ``GROUP_PIECES`` pieces if that is less, at any corpus size, so tasks stay equal. Rows that are equal in doc_id and text are counted before the shuffle and dealt in runs of up to ``RUN``, each to
a group of its own, so even a row with a third of all repeats is spread. Reruns agree, whatever the partitions, as the hash is
of contents alone.

Defined results: a null text is empty, so it is one piece with the end id alone. Repeated rows are packed each for itself.
A null doc_id stays null. Other columns, under any name, are ignored. An empty table gives an empty result. Texts in which
the vocabulary's special string occurs, or that the fast encoder refuses, are encoded by the reference encoder whole.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Sealed, cut, release, table

LENGTH = 2048
END_ID = 1
#: A group's documents, and its pieces where documents have many.
GROUP_DOCS, GROUP_PIECES = 4000, 16_000
RUN = 64
BINS_PER_GROUP = 1 << 24
#: Fixed names of public vocabulary files.
VOCABULARY, RANKS, SPECIAL = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "<|endoftext|>"


class Encoder:
    """Ids of the byte-level vocabulary. tiktoken holds the same merges as ranks and is several times faster; tests compare both."""

    def __init__(self, vocabulary: str | None = None, ranks: str | None = None):
        import public_tokenizers
        import tiktoken

        self.vocabulary = vocabulary or public_tokenizers.path(VOCABULARY)
        with open(ranks or public_tokenizers.path(RANKS), "rb") as lines:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("veinstone", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
        self.whole = None

    def __call__(self, text: str) -> list[int]:
        if SPECIAL not in text:
            try:
                return self.fast.encode_ordinary(text)
            except ValueError:  # a text that the fast encoder's pattern engine gives up on
                pass
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.vocabulary)
        return self.whole.encode(text, add_special_tokens=False).ids


def pieces_of(ids: list[int], length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of each piece; ids must not be empty."""
    raw = np.asarray(ids, "<u4")
    return [(i, min(length, len(raw) - i), zlib.crc32(raw[i : i + length].tobytes())) for i in range(0, len(raw), length)]


def first_fit_decreasing(sizes: np.ndarray, capacity: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each size, given from large to small. A leaf of the tree is a bin's room, a node the larger of its two."""
    leaves = 1
    while leaves < max(1, len(sizes)):
        leaves *= 2
    room = [capacity] * (2 * leaves)
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for k, size in enumerate(sizes.tolist()):
        at = 1
        while at < leaves:
            at *= 2
            if room[at] < size:
                at += 1
        bins[k], offsets[k] = at - leaves, capacity - room[at]
        room[at] -= size
        at //= 2
        while at:
            best = max(room[2 * at], room[2 * at + 1])
            if room[at] == best:
                break
            room[at] = best
            at //= 2
    return bins, offsets


_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "doc_key"]


def _tokenised(seed: int, length: int):
    def run(batches):
        encode = Encoder()
        for batch in batches:
            out: list[tuple] = []
            made: dict[str, list] = {}
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or ""
                if text not in made:
                    made[text] = pieces_of([*encode(text), END_ID], length), xxhash.xxh3_64_intdigest(text.encode(), seed=seed)
                pieces, digest = made[text]
                total = pieces[-1][0] + pieces[-1][1]
                key = xxhash.xxh3_64_intdigest(f"{doc}:{digest}".encode(), seed=seed) - (1 << 63)
                out += [(doc, start, n, crc, total, key) for start, n, crc in pieces]
            columns = list(zip(*out, strict=True)) or [[]] * len(_NAMES)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], _NAMES)
        del encode
        release()

    return run


def _packed(length: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.iloc[np.repeat(np.arange(len(group)), group["copies"])]
        group = group.sort_values(["length", "doc_id", "start", "ids_crc32", "doc_key"], ascending=[False, True, True, True, True], kind="stable", ignore_index=True)
        bins, offsets = first_fit_decreasing(group["length"].to_numpy(), length)
        if len(bins) and bins.max() >= BINS_PER_GROUP:
            raise ValueError(f"over {BINS_PER_GROUP} sequences in a group")
        return group.assign(sequence_id=group["pack_group"] * BINS_PER_GROUP + bins, offset=offsets)[[*_NAMES[:-1], "sequence_id", "offset"]]

    return run


def pack(docs: DataFrame, length: int = LENGTH, seed: int = 5, group_docs: int = GROUP_DOCS, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    sealed = Sealed(docs)
    docs = sealed.df.select(sealed.of("doc_id").cast("long").alias("doc_id"), sealed.of("text").alias("text"))
    pieces = docs.mapInArrow(_tokenised(seed, length), ", ".join(f"{n} long" for n in _NAMES))
    equal = cut(pieces.groupBy(*_NAMES).agg(F.count("*").alias("n")))
    total, whole = equal.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("start") == 0, F.col("n"))), F.lit(0))).head()
    groups = max(1, -(-whole // group_docs), -(-total // group_pieces))
    runs = equal.select(*_NAMES, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {RUN}"))).alias("run"))
    dealt = runs.select(*_NAMES, F.least(F.lit(RUN).cast("long"), F.col("n") - F.col("run") * RUN).alias("copies"), F.pmod(F.xxhash64(F.lit(seed), "doc_key", "run"), F.lit(groups)).alias("pack_group"))
    return dealt.groupBy("pack_group").applyInPandas(_packed(length), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
