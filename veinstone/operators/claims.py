"""Change claims out of documents: sections, statements, then rules for each statement."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, text
from ..functions.mentions import normalized_symbol, symbol_mentions, version_mentions, versions_in
from ..session import sound

# Fixed patterns: a symbol in a replacement, the ways to say so, the vocabulary of changes, each in order of precedence; then parameters, actions, references, conjunctions and signal words.
TOKEN = r"(`[^`]+`|[A-Za-z_]\w*(?:[.:#]{1,2}[A-Za-z_]\w*)+\(\))"
REPLACEMENTS = [
    ("REPLACEMENT", "old new", rf"{TOKEN}\s+(?:was|is|has been)\s+replaced\s+(?:by|with)\s+{TOKEN}"),
    ("DEPRECATED", "old new", rf"{TOKEN}\s+(?:is|was)\s+deprecated\s+in favor of\s+{TOKEN}"),
    ("DEPRECATED", "new old", rf"use\s+{TOKEN}\s+instead of\s+{TOKEN}"),
    ("MOVED", "old new", rf"{TOKEN}\s+was\s+moved\s+to\s+{TOKEN}"),
]
CHANGE_WORDS = [
    ("SIGNATURE_CHANGED", r"\b(?:no longer accepts?|now requires|new (?:required )?parameter|changed signature)\b"),
    ("BEHAVIOR_CHANGED", r"\b(?:now returns|now throws|behavior (?:has )?changed)\b"),
    ("MOVED", r"\b(?:moved to|relocated)\b"),
    ("DEPRECATED", r"\bdeprecated\b"),
    ("RENAMED", r"\b(?:renamed|now (?:called|named))\b"),
    ("REMOVED", r"\bremoved\b"),
    ("BEHAVIOR_CHANGED", r"\bno longer\b"),
]
PARAMETER = r"`([^`]+)`\s+parameter|parameter\s+`([^`]+)`"
ACTION = r";\s*([^;]*?\binstead\b[^;]*?)\.?\s*$"
REFERENCE = r"\bPR\s*#?(\d+)\b|\bGH-(\d+)\b|\bissue\s*#?(\d+)\b|\(#(\d+)\)"
CONJUNCTION = r"\s*(?:;|\band\b)\s*"
SIGNAL = r"\b(?:breaking|note|warning|updated|modified|change[ds]?)\b"

_REPLACEMENTS = [(kind, order.split().index("old"), re.compile(p, re.I)) for kind, order, p in REPLACEMENTS]
_WORDS = [(kind, re.compile(p, re.I)) for kind, p in CHANGE_WORDS]
_PARAMETER, _ACTION, _REFERENCE, _CONJUNCTION, _SIGNAL = (re.compile(p, re.I) for p in (PARAMETER, ACTION, REFERENCE, CONJUNCTION, SIGNAL))

#: (statement, document row) -> claims as dicts of the fields below; for statements with a signal word that no rule reads.
Extractor = Callable[[str, dict], list[dict]]


def declined(statement: str, document: dict) -> list[dict]:
    """The extractor that is used where none is given: no claims, rather than guesses."""
    return []


CLAIM = "symbol_name string, symbol_package string, symbol_kind string, version_from string, version_to string, change_type string, summary string, external_refs array<string>, replacement_symbol string, parameters array<string>, migration_action_text string, raw_text string, extraction_confidence string, extraction_method string"
CLAIM_FIELDS = [x.split()[0] for x in CLAIM.split(", ")]


def change_type(statement: Column) -> Column:
    """The change that a statement's words name, without Python; null if none."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(CHANGE_WORDS):
        out = F.when(F.rlike(statement, F.lit(f"(?i){pattern}")), F.lit(kind)).otherwise(out)
    return out


def _named(statement: str) -> str | None:
    return next((kind for kind, p in _WORDS if p.search(statement)), None)


def _claim(statement: str, kind: str, symbol: dict, replacement: str | None, rule: str, ambient: str | None, refs: list[str]) -> dict:
    found = version_mentions(statement)
    first = found[0] if found else None
    if first:
        low = None if first["qualifier"] == "EXACT" else first["normalized"]
        high = {"EXACT": first["normalized"], "RANGE": first["normalized_end"], "SINCE": None}[first["qualifier"]]
    else:
        low, high = None, ambient
    source = "inline_version" if first else "ambient_version" if ambient else "no_version"
    action = _ACTION.search(statement)
    own = ["#" + next(filter(None, m.groups())) for m in _REFERENCE.finditer(statement)]
    values = [symbol["name"], symbol["package"], symbol["kind"], low, high, kind, statement, list(dict.fromkeys(own + refs)), replacement, [next(filter(None, m.groups())) for m in _PARAMETER.finditer(statement)] if kind == "SIGNATURE_CHANGED" and not replacement else [], action[1].strip() if action else None, statement, "EXPLICIT" if first else "INFERRED", f"regex:{rule}+{source}"]
    return dict(zip(CLAIM_FIELDS, values, strict=True))


def _by_rules(statement: str, package: str | None, ambient: str | None, refs: list[str]) -> dict | None:
    for kind, old, pattern in _REPLACEMENTS:
        if m := pattern.search(statement):
            was, now = (normalized_symbol(m[1 + (old + k) % 2], package) for k in (0, 1))
            return _claim(statement, kind, was, now["name"], "replacement_pattern", ambient, refs)
    kind, symbols = _named(statement), symbol_mentions(statement, package)
    if kind and len(symbols) == 1:
        return _claim(statement, kind, symbols[0], None, "change_keyword", ambient, refs)
    return None


def claims_of(statement: str, document: dict, ambient: str | None = None, package: str | None = None, extractor: Extractor = declined) -> list[dict]:
    """Claims of one statement: by the rules, else by the rules on its conjuncts, else by the extractor, else none."""
    refs = list(document.get("document_refs") if document.get("document_refs") is not None else [])
    if whole := _by_rules(statement, package, ambient, refs):
        return [whole]
    symbols = symbol_mentions(statement, package)
    if not symbols:
        return []
    if _named(statement):
        return [c for part in _CONJUNCTION.split(statement) if part.strip() and (c := _by_rules(part.strip(), package, ambient, refs))] if len(symbols) > 1 else []
    return extractor(statement, document) if _SIGNAL.search(statement) else []


def parts_of(docs: DataFrame, split) -> DataFrame:
    """(all of ``docs``, section, piece_no, piece, ambient): pieces of sections, with the version that the section's heading names first."""
    sectioned = docs.select("*", F.posexplode(text.sections(F.col("raw_text"))).alias("section", "_s"))
    sectioned = sectioned.withColumn("ambient", versions_in(F.coalesce(F.col("_s.heading"), F.lit(""))))
    first = F.when(F.size("ambient") > 0, F.get("ambient", F.lit(0))["normalized"])
    return sectioned.withColumn("ambient", first).select("*", F.posexplode(split(F.col("_s.body"))).alias("piece_no", "piece")).drop("_s")


def extract_claims(docs: DataFrame, package: str | None = None, extractor: Extractor = declined) -> DataFrame:
    """Claims of documents (document_id, source_type, raw_text, version, document_refs, doc_ord), numbered within each document.

    Only statements with a backtick or a call can name a symbol; no others reach the rules.
    """
    pieces = parts_of(docs, text.statements).filter(F.contains("piece", F.lit("`")) | F.contains("piece", F.lit("()"))).withColumn("ambient", F.coalesce("ambient", F.nullif("version", F.lit(""))))
    keep = ["doc_ord", "source_document_id", "source_type", "section", "piece_no"]
    kinds = "doc_ord long, source_document_id string, source_type string, section int, piece_no int, part int"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                ambient = row["ambient"] if isinstance(row["ambient"], str) else None
                out += [{k: row[k] for k in keep} | {"part": i} | c for i, c in enumerate(claims_of(row["piece"], row, ambient, package, extractor))]
            yield pd.DataFrame(out, columns=[*keep, "part", *CLAIM_FIELDS])

    found = pieces.withColumnRenamed("document_id", "source_document_id").mapInPandas(run, f"{kinds}, {CLAIM}")
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("source_document_id").orderBy("section", "piece_no", "part")) - 1
    return found.withColumn("claim_idx", number).drop("section", "piece_no", "part").withColumn("evidence_id", ids.evidence_id(F.col("source_document_id"), F.col("claim_idx"), F.col("raw_text")))


#: Sources whose documents are chunked by sections; all others by paragraphs.
BY_SECTION = ("RELEASE_NOTE", "MIGRATION_GUIDE", "OFFICIAL_DOCS")


def chunks_of(docs: DataFrame, package: str | None = None, sectioned: tuple[str, ...] = BY_SECTION) -> DataFrame:
    """Chunks of documents: bullets or whole bodies of sections for the source types ``sectioned``, paragraphs for all others."""
    from pyspark.sql import Window

    from ..functions.mentions import symbols_in

    by_section = F.coalesce(F.col("source_type").isin(*sectioned), F.lit(False))
    one = parts_of(docs.filter(by_section), text.section_chunks)
    two = docs.filter(~by_section).select("*", F.lit(0).alias("section"), F.lit(None).cast("string").alias("ambient"), F.posexplode(text.paragraphs(F.col("raw_text"))).alias("piece_no", "piece"))
    index = F.row_number().over(Window.partitionBy("document_id").orderBy("section", "piece_no")) - 1
    sound(docs.sparkSession)
    found = one.unionByName(two).withColumn("ord", index).withColumns({"_v": versions_in("piece"), "_s": symbols_in(package)("piece")})
    version = F.coalesce(F.when(F.size("_v") > 0, F.get("_v", F.lit(0))["normalized"]), F.nullif("ambient", F.lit("")), F.nullif("version", F.lit("")))
    symbols = F.array_sort(F.array_distinct(F.transform("_s", lambda s: s["name"])))
    return found.select(ids.chunk_id(F.col("document_id"), F.col("ord"), F.col("piece")).alias("chunk_id"), "doc_ord", "ord", F.col("piece").alias("text"), F.col("document_id").alias("source_document_id"), "source_type", "provenance", F.lit(package).cast("string").alias("package"), version.alias("version"), symbols.alias("symbols"))
