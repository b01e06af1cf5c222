"""The linker over a stream of claims: each block's changes so far are its state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState

from ..operators.resolve import Embedder, fold, hashed_embedder

OUT = "symbol_name string, symbol_package string, evidence_id string, change_id string, link_type string, review_status string"
_LINK = ["evidence_id", "change_id", "link_type", "review_status"]


def link_stream(claims: DataFrame, embed: Embedder | None = None) -> DataFrame:
    """Links of streamed claims. The state of a block is the claims that became changes, in order; each batch is folded behind them."""
    run = fold(embed or hashed_embedder())

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = pd.DataFrame(json.loads(state.get[0])) if state.exists else pd.DataFrame()
        fresh = pd.concat(list(frames), ignore_index=True)
        fresh = fresh[~fresh["evidence_id"].isin(known["evidence_id"])] if len(known) else fresh
        both = pd.concat([known, fresh], ignore_index=True)
        linked = run(both)
        started = set(linked.loc[linked["kind"] == "change", "evidence_id"])
        state.update((both[both["evidence_id"].isin(started)].to_json(orient="records"),))
        links = linked[(linked["kind"] == "link") & linked["evidence_id"].isin(fresh["evidence_id"])][_LINK]
        yield links.assign(symbol_name=key[0], symbol_package=key[1])[["symbol_name", "symbol_package", *_LINK]]

    return claims.groupBy("symbol_name", "symbol_package").applyInPandasWithState(step, OUT, "changes string", "append", "NoTimeout")
