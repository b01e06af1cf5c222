"""Cannot-link rules, pair scores, and the linker: an ordered fold within each (symbol, package)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed weights and thresholds.
WEIGHTS = {"symbol_exact": 0.35, "version_compatible": 0.25, "change_type_match": 0.15, "semantic_similarity": 0.25}
INFERRED, POSSIBLE = 0.85, 0.55
REASONS = ("EXPLICIT_DIFFERENT_REFERENCES", "INCOMPATIBLE_VERSION_TRANSITION", "NON_OVERLAPPING_SEMANTICS", "SEPARATE_RELEASE_EVENTS")

Embedder = Callable[[list[str]], np.ndarray]


def _set(column: Column) -> Column:
    return F.nullif(column, F.lit("")).isNotNull()


def cannot_link(a: str, b: str, compatible: list[tuple[str, str]] = ()) -> Column:
    """The first rule that forbids linking structs ``a`` and ``b`` (claim fields), null if none does."""
    f = lambda side, name: F.col(f"{side}.{name}")
    refs = (F.size(f(a, "external_refs")) > 0) & (F.size(f(b, "external_refs")) > 0) & ~F.arrays_overlap(f(a, "external_refs"), f(b, "external_refs"))
    differ = lambda name: _set(f(a, name)) & _set(f(b, name)) & (f(a, name) != f(b, name))
    allowed = F.lit(False)
    for x, y in compatible:
        allowed = allowed | ((f(a, "change_type") == x) & (f(b, "change_type") == y)) | ((f(a, "change_type") == y) & (f(b, "change_type") == x))
    same = (f(a, "symbol_name") == f(b, "symbol_name")) & (f(a, "symbol_package") == f(b, "symbol_package"))
    tests = (refs, differ("version_from") & differ("version_to"), (f(a, "change_type") != f(b, "change_type")) & ~allowed, same & differ("version_to"))
    return F.coalesce(*[F.when(test, F.lit(reason)) for test, reason in zip(tests, REASONS, strict=True)])


def cosine(x: Column, y: Column) -> Column:
    """Of two double arrays; 0 if either has no length."""
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: u * v), F.lit(0.0), lambda s, t: s + t)
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(norm > 0, dot(x, y) / norm).otherwise(0.0)


def pair_score(a: str, b: str, similarity: Column, weights: dict[str, float] = WEIGHTS) -> Column:
    """struct<symbol_exact, version_compatible, change_type_match, semantic_similarity, total>."""
    f = lambda side, name: F.col(f"{side}.{name}")
    number = lambda test: F.when(test, 1.0).otherwise(0.0)
    known = _set(f(a, "version_to")) & _set(f(b, "version_to"))
    signals = {"symbol_exact": number((f(a, "symbol_name") == f(b, "symbol_name")) & (f(a, "symbol_package") == f(b, "symbol_package"))), "version_compatible": number(~known | (f(a, "version_to") == f(b, "version_to"))), "change_type_match": number(f(a, "change_type") == f(b, "change_type")), "semantic_similarity": similarity}
    total = sum((F.lit(weights[k]) * v for k, v in signals.items()), F.lit(0.0))
    return F.struct(*[v.alias(k) for k, v in signals.items()], total.alias("total"))


def decision(veto: Column, shared_ref: Column, total: Column, inferred: float = INFERRED, possible: float = POSSIBLE) -> Column:
    """struct<decision, method, score>."""
    said = F.when(veto.isNotNull(), "NO_MATCH").when(shared_ref, "MATCH_EXPLICIT").when(total >= inferred, "MATCH_INFERRED").when(total >= possible, "AMBIGUOUS").otherwise("NO_MATCH")
    method = F.when(veto.isNull() & shared_ref, "EXPLICIT_REFERENCE").otherwise("PAIRWISE_RESOLUTION")
    score = F.when(veto.isNotNull(), 0.0).when(shared_ref, 1.0).otherwise(total)
    return F.struct(said.alias("decision"), method.alias("method"), score.alias("score"))


def hashed_embedder(size: int = 384) -> Embedder:
    """A stand-in for a sentence model: hashed words and letter trigrams, normalised. It does not match any model's numbers."""
    import re

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), size))
        for i, t in enumerate(texts):
            words = re.findall(r"\w+", t.lower())
            padded = " ".join(words)
            for feature in [*(f"w:{w}" for w in words), *(padded[k : k + 3] for k in range(max(0, len(padded) - 2)))]:
                h = int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=8).digest(), "little")
                out[i, h % size] += 2.0 if feature.startswith("w:") else 1.0
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms == 0, 1, norms)

    return embed


#: Models of this process by name.
HELD: dict[str, Callable] = {}


def loaded(name: str, load: Callable[[], Callable]) -> Callable:
    """An embedder or scorer that is loaded where it is used: once in each worker process, at its first call."""

    def run(texts):
        from veinstone.operators import resolve  # the process's own, not one that came with the task

        if name not in resolve.HELD:
            resolve.HELD[name] = load()
        return resolve.HELD[name](texts)

    return run


LINKED = "kind string, evidence_id string, change_id string, link_type string, link_confidence double, confidence_tier string, link_method string, provenance string, review_status string, symbol_name string, symbol_package string, symbol_kind string, version_from string, version_to string, change_type string, summary string, replacement_symbol string, external_refs array<string>, other_change_id string, reason string"
_COLUMNS = [x.split()[0] for x in LINKED.split(", ")]


def _digest(*parts: str | None) -> str:
    return "chg_" + hashlib.sha256("|".join(p or "" for p in parts).encode()).hexdigest()[:16]


def _list(x) -> list:
    return [] if x is None or isinstance(x, float) else list(x)


def fold(embed: Embedder, compatible: tuple[tuple[str, str], ...] = (), weights: dict[str, float] = WEIGHTS) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Links the evidence of one block in order: to one sure match, to all unsure ones for review, or as a change of its own.

    A claim is only judged against changes of its version or of none, found by version. ``compatible``: pairs of change
    types that don't forbid a link.
    """
    allowed = {frozenset(pair) for pair in compatible}

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["doc_ord", "claim_idx"], kind="stable")
        rows = block.astype(object).where(block.notna(), None).to_dict("records")
        summaries = list(dict.fromkeys(r["summary"] for r in rows))
        vectors = dict(zip(summaries, embed(summaries), strict=True))
        by_version: dict[str, list[dict]] = {}
        out: list[dict] = []
        number = 0
        judged: dict[tuple, tuple] = {}
        for r in rows:
            refs, sure, unsure, vetoed = set(_list(r["external_refs"])), [], [], []
            alike = (r["version_to"] or "", r["change_type"], frozenset(refs), r["summary"])
            if alike in judged and judged[alike][0] == number:  # no change since a claim that says the same
                _, sure, unsure, vetoed = judged[alike]
                wanted = []
            else:
                wanted = by_version.values() if not r["version_to"] else [by_version.get(r["version_to"], []), by_version.get("", [])]
            for c in sorted((c for held in wanted for c in held), key=lambda c: c["number"]):
                theirs = set(_list(c["external_refs"]))
                if refs and theirs and not refs & theirs:
                    vetoed.append((c, REASONS[0]))
                elif r["change_type"] != c["change_type"] and frozenset((r["change_type"], c["change_type"])) not in allowed:
                    vetoed.append((c, REASONS[2]))
                elif refs & theirs:
                    sure.append((c, "EXPLICIT", 1.0, "EXPLICIT_REFERENCE", f"shared reference {sorted(refs & theirs)[0]}"))
                else:
                    blank = not (r["summary"] or "").strip() or not (c["summary"] or "").strip()
                    near = 0.0 if blank else float(vectors[r["summary"]] @ vectors[c["summary"]])
                    total = weights["symbol_exact"] + weights["version_compatible"] + weights["change_type_match"] * (r["change_type"] == c["change_type"]) + weights["semantic_similarity"] * near
                    said = f"score {total:.4f}"
                    if total >= INFERRED:
                        sure.append((c, "INFERRED_HIGH_CONFIDENCE", total, "PAIRWISE_RESOLUTION", said))
                    elif total >= POSSIBLE:
                        unsure.append((c, "AMBIGUOUS", total, "PAIRWISE_RESOLUTION", said))
            judged[alike] = number, sure, unsure, vetoed
            link = {"evidence_id": r["evidence_id"], "kind": "link"}
            if sure or unsure:
                review = "UNREVIEWED" if len(sure) == 1 and not unsure else "NEEDS_REVIEW"
                out += [link | {"change_id": c["change_id"], "link_type": "SUPPORTING", "link_confidence": score, "confidence_tier": tier, "link_method": method, "provenance": said, "review_status": review} for c, tier, score, method, said in sure + unsure]
                settled = sure[0][0]["change_id"] if review == "UNREVIEWED" else None
            else:
                settled = _digest(r["symbol_name"], r["symbol_package"], r["version_to"], r["change_type"], r["evidence_id"])
                fields = {k: r[k] for k in ("symbol_name", "symbol_package", "symbol_kind", "version_from", "version_to", "change_type", "summary", "replacement_symbol")}
                number += 1
                made = fields | {"external_refs": _list(r["external_refs"]), "change_id": settled, "number": number}
                by_version.setdefault(r["version_to"] or "", []).append(made)
                out.append(made | {"kind": "change", "evidence_id": r["evidence_id"]})
                out.append(link | {"change_id": settled, "link_type": "PRIMARY", "link_confidence": 1.0, "confidence_tier": "EXPLICIT", "link_method": "ORIGINATING", "provenance": "originating evidence", "review_status": "UNREVIEWED"})
            if settled:
                out += [{"kind": "cannot_link", "change_id": min(settled, c["change_id"]), "other_change_id": max(settled, c["change_id"]), "reason": why} for c, why in vetoed if c["change_id"] != settled]
        return pd.DataFrame([{c: r.get(c) for c in _COLUMNS} for r in out], columns=_COLUMNS)

    return run


def link_evidence(claims: DataFrame, embed: Embedder | None = None, compatible: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """Rows of kind change, link and cannot_link, for claims with evidence_id, doc_ord and claim_idx. One shuffle, by block."""
    return claims.groupBy("symbol_name", "symbol_package").applyInPandas(fold(embed or hashed_embedder(), compatible), LINKED)
