"""Content-derived ids and the link label, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed texts of the confidence tiers and review states.
TIER_TEXT = {"EXPLICIT": "Confirmed by explicit reference", "INFERRED_HIGH_CONFIDENCE": "Likely the same change", "AMBIGUOUS": "Possibly related — needs review"}
REVIEW_TEXT = {"NEEDS_REVIEW": "needs human review before use", "CONFIRMED": "confirmed by a reviewer", "REJECTED": "rejected by a reviewer"}


def content_id(prefix: str, *parts: Column) -> Column:
    """prefix_ and 16 hex digits of the SHA-256 of the parts joined by ``|``; a null part counts as empty."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(joined, 256), 1, 16))


def document_id(source_type: Column, url: Column, text: Column) -> Column:
    return content_id("doc", source_type, url, F.substring(text, 1, 200))


def chunk_id(document: Column, index: Column, text: Column) -> Column:
    return content_id("chunk", document, index, F.substring(text, 1, 100))


def evidence_id(document: Column, index: Column, text: Column) -> Column:
    return content_id("ev", document, index, F.substring(text, 1, 100))


def change_id(name: Column, package: Column, version_to: Column, change_type: Column, evidence: Column) -> Column:
    return content_id("chg", name, package, version_to, change_type, evidence)


def _worded(texts: dict[str, str], value: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in texts.items() for x in kv]), value)


def link_label(tier: Column, review: Column) -> Column:
    """The tier in words, then the review state where there is one; never the number."""
    state = _worded(REVIEW_TEXT, review)
    return F.concat(_worded(TIER_TEXT, tier), F.when(state.isNull(), "").otherwise(F.concat(F.lit(" ("), state, F.lit(")"))))
