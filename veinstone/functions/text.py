"""Splitters and the tokenizer, as columns. Patterns are in a form that Java and RE2 read alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = "[\\s\\x1c-\\x1f\\x85\\xa0]"
#: Identifier characters and digits, by Unicode class.
NAME, DIGIT = "[\\p{L}\\p{N}_]", "\\p{Nd}"
TOKEN = f"[A-Za-z_]{NAME}*(?:[.:#]{{1,2}}[A-Za-z_]{NAME}*)*|{DIGIT}+(?:\\.{DIGIT}+)*"


def tokens(text: Column) -> Column:
    """Lower-cased names and numbers; a joined name is followed by its parts."""
    found = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.lower)
    whole = lambda t: F.array(t)
    parted = lambda t: F.concat(F.array(t), F.filter(F.split(t, "[.:#]+"), lambda x: x != ""))
    return F.flatten(F.transform(found, lambda t: F.when(F.rlike(t, F.lit("[.:#]")), parted(t)).otherwise(whole(t))))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^{_SPACE}+|{_SPACE}+$", "")


def _inked(pieces: Column) -> Column:
    return F.filter(F.transform(pieces, stripped), lambda x: x != "")


def lines(text: Column) -> Column:
    return _inked(F.split(text, "\n"))


def line_groups(text: Column, size: int = 5) -> Column:
    """Stripped non-blank lines, ``size`` of them joined by spaces to a chunk."""
    groups = lambda x: F.transform(F.sequence(F.lit(0), F.greatest(F.size(x) - 1, F.lit(0)), F.lit(size)), lambda i: F.array_join(F.slice(x, i + 1, F.lit(size)), " "))
    return F.transform(F.array(lines(text)), lambda x: F.when(F.size(x) == 0, F.array().cast("array<string>")).otherwise(groups(x)))[0]


def paragraphs(text: Column) -> Column:
    return _inked(F.split(text, "\n\\s*\n"))


def sentences(text: Column) -> Column:
    return F.split(text, "(?<=[.!?])\\s+")


def bullets(text: Column) -> Column:
    return _inked(F.regexp_extract_all(text, F.lit("(?dm)^\\s*[-*]\\s+(.+)$"), F.lit(1)))


def sections(text: Column) -> Column:
    """array<struct<heading, body>>: what stands before the first heading (null heading, if not blank), then each heading's own body."""
    marked = F.regexp_replace(text, "(?dm)^#{1,6}\\s*(.+)$", "\u0001$1\u0002")
    pieces = F.split(marked, "\u0001")
    parts = F.transform(pieces, lambda p, i: F.struct(F.when(i > 0, F.substring_index(p, "\u0002", 1)).alias("heading"), F.when(i > 0, F.substring_index(p, "\u0002", -1)).otherwise(p).alias("body")))
    return F.filter(parts, lambda s: s["heading"].isNotNull() | (stripped(s["body"]) != "") | (F.size(pieces) == 1))


def statements(body: Column) -> Column:
    """Bullets, if a body has any, else its sentences."""
    return F.transform(F.array(bullets(body)), lambda b: F.when(F.size(b) > 0, b).otherwise(_inked(sentences(body))))[0]


def section_chunks(body: Column) -> Column:
    """Bullets, if a body has any, else the body whole."""
    return F.transform(F.array(bullets(body)), lambda b: F.when(F.size(b) > 0, b).otherwise(_inked(F.array(body))))[0]


def conjuncts(statement: Column) -> Column:
    return _inked(F.split(statement, "(?i)\\s*(?:;|\\band\\b)\\s*"))


def external_refs(text: Column) -> Column:
    """Issue and pull-request numbers as #n, in order."""
    found = F.regexp_extract_all(text, F.lit("(?i)\\bPR\\s*#?[0-9]+\\b|\\bGH-[0-9]+\\b|\\bissue\\s*#?[0-9]+\\b|\\(#[0-9]+\\)"), F.lit(0))
    return F.transform(found, lambda m: F.concat(F.lit("#"), F.regexp_extract(m, "([0-9]+)", 1)))
