"""Version and symbol mentions with their places, and what follows from them.

Finding is table-driven: kinds of patterns in order of precedence, each a list of patterns; a match counts unless it
overlaps one that an earlier pattern has already claimed; results are in the order of the text.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns.
NUMBER = r"\d+(?:\.\d+)*(?:\.[xX])?"
DOTTED = r"\d+\.\d+(?:\.\d+)*(?:\.[xX])?"
VERSION_PATTERNS = [
    ("RANGE", rf"(?i:\bbetween\s+v?({NUMBER})\s+and\s+v?({NUMBER})\b)"),
    ("RANGE", rf"\bv?({NUMBER})\s*(?:-|–|—|to)\s*v?({NUMBER})\b"),
    ("SINCE", rf"(?i:\b(?:since|as of|starting (?:in|from)|introduced in)\s+v?({NUMBER})\b)"),
    ("EXACT", rf"(?i:\b(?:removed in|deprecated in|changed in|in version|version)\s+v?({NUMBER})\b)"),
    ("EXACT", rf"\bv({NUMBER})\b"),
    ("EXACT", rf"\b({DOTTED})\b"),
]
PATH = r"[A-Za-z_]\w*(?:[.:#]{1,2}[A-Za-z_]\w*)+"
SYMBOL_PATTERNS = [("quoted", rf"`({PATH}\(?\)?|[A-Za-z_]\w*\(\))`"), ("call", rf"\b({PATH}\(\))")]
QUOTED = re.compile(r"`([^`]+)`")

_VERSIONS = [(kind, re.compile(p)) for kind, p in VERSION_PATTERNS]
_SYMBOL = re.compile(rf"(?:{PATH}\(?\)?|[A-Za-z_]\w*\(\))")
_CALL = re.compile(SYMBOL_PATTERNS[1][1])

VERSION_TYPE = "array<struct<raw:string,normalized:string,normalized_end:string,qualifier:string,start:int,end:int,precision:string>>"
SYMBOL_TYPE = "array<struct<raw:string,start:int,end:int,name:string,package:string,kind:string>>"


def _claim(found: list[tuple], spans) -> None:
    """Adds (match, extra) pairs whose place is still free."""
    for m, extra in spans:
        if all(m.end() <= o.start() or o.end() <= m.start() for o, _ in found):
            found.append((m, extra))


def _plain(number: str) -> str:
    return number[:-2] if number[-2:].lower() == ".x" else number


def version_mentions(text: str | None) -> list[dict]:
    found: list[tuple] = []
    if text and any(map(str.isdigit, text)):
        for kind, pattern in _VERSIONS:
            _claim(found, ((m, kind) for m in pattern.finditer(text)))
    out = []
    for m, kind in sorted(found, key=lambda x: x[0].start()):
        start = _plain(m[1])
        out.append({"raw": m[0], "normalized": start, "normalized_end": _plain(m[2]) if kind == "RANGE" else None, "qualifier": kind, "start": m.start(), "end": m.end(), "precision": ("MAJOR", "MINOR", "PATCH")[min(start.count("."), 2)]})
    return out


def normalized_symbol(raw: str, package: str | None = None) -> dict:
    """name, package and kind of a symbol as written; a call or a # makes it a method."""
    text = raw.strip().strip("`")
    bare = text.removesuffix("()")
    kind = "method" if bare != text or "#" in text else None
    return {"name": bare.replace("#", ".").replace("::", ".").removeprefix(f"{package}." if package else ""), "package": package or "", "kind": kind}


def symbol_mentions(text: str | None, package: str | None = None) -> list[dict]:
    found: list[tuple] = []
    if text:
        _claim(found, ((m, m[1]) for m in QUOTED.finditer(text) if re.fullmatch(_SYMBOL, m[1])))
        _claim(found, ((m, m[1]) for m in _CALL.finditer(text)))
    return [{"raw": raw, "start": m.start(), "end": m.end()} | normalized_symbol(raw, package) for m, raw in sorted(found, key=lambda x: x[0].start())]


def _where(values: pd.Series, pattern: str, find: Callable[[str], list[dict]]) -> pd.Series:
    """``find`` of the values that have the pattern; no mentions for the others."""
    hit = values.str.contains(pattern, regex=True, na=False)
    return pd.Series([find(t) if h else [] for t, h in zip(values, hit, strict=True)], dtype=object)


def versions_in(text: Column | str) -> Column:
    """All version mentions; only texts with a digit are read."""

    @F.pandas_udf(VERSION_TYPE)
    def found(values: pd.Series) -> pd.Series:
        return _where(values, r"\d", version_mentions)

    return found(text)


def symbols_in(package: str | None = None):
    """All symbol mentions; only texts with a backtick or a call are read."""

    @F.pandas_udf(SYMBOL_TYPE)
    def found(values: pd.Series) -> pd.Series:
        return _where(values, r"`|\(\)", lambda t: symbol_mentions(t, package))

    return found


def symbol_struct(raw: Column, package: str = "") -> Column:
    """The same normal form of a symbol by itself, without Python."""
    text = F.regexp_replace(F.regexp_replace(raw, "^\\s+|\\s+$", ""), "^`+|`+$", "")
    bare = F.regexp_replace(text, "\\(\\)$", "")
    dotted = F.replace(F.replace(bare, F.lit("#"), F.lit(".")), F.lit("::"), F.lit("."))
    name = F.when(F.startswith(dotted, F.lit(f"{package}.")), F.substring(dotted, len(package) + 2, 1 << 30)).otherwise(dotted) if package else dotted
    return F.struct(name.alias("name"), F.lit(package).alias("package"), F.when((bare != text) | F.contains(text, F.lit("#")), F.lit("method")).alias("kind"))


# Versions as numbers.


def version_key(version: Column) -> Column:
    """array<int> of the leading numeric parts; [0] if there are none."""
    digits = F.regexp_extract(version, "^[0-9]+(\\.[0-9]+)*", 0)
    return F.when(digits == "", F.array(F.lit(0))).otherwise(F.transform(F.split(digits, "\\."), lambda x: x.cast("int")))


def interval(start: Column, end: Column, qualifier: Column) -> Column:
    """struct<start, end> of a mention; a null end is open."""
    low, high = version_key(start), F.when(qualifier == "RANGE", F.when(end.isNotNull(), version_key(end))).when(qualifier == "EXACT", version_key(start))
    return F.when(F.nullif(start, F.lit("")).isNotNull(), F.struct(low.alias("start"), high.alias("end")))


def point(version: Column) -> Column:
    return interval(version, F.lit(None).cast("string"), F.lit("EXACT"))


def _below(a: Column, b: Column) -> Column:
    pad = lambda x, y: F.concat(x, F.array_repeat(F.lit(0), F.greatest(F.size(y) - F.size(x), F.lit(0))))
    return F.coalesce(pad(a, b) < pad(b, a), F.lit(False))


def overlap(a: Column, b: Column) -> Column:
    """Whether two intervals meet, ends included; nulls are unbounded."""
    return ~(_below(a["end"], b["start"]) | _below(b["end"], a["start"]))
