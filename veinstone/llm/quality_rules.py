"""Line-first cleaning, in DataFrame functions only.

Every line is judged by itself: punctuation, navigation, symbol, shouting and boilerplate rules. Failing lines are
removed and a document that loses more than ``max_lost`` of its characters that way is rejected, as is one that fails
the base limits (under ``min_words`` words, or over ``max_repeat_pct`` % of its words inside repeated 5-word windows).

Two rules look at short lines only, and their lengths are parameters: a phrase of ``BOILERPLATE`` condemns a line of up to
``boilerplate_chars`` characters (in a long paragraph it is a mention and not a footer), and a line of up to
``fragment_chars`` characters fails without terminal punctuation (a longer one may be a wrapped sentence).

Everything is computed within the row that holds the text, so there is no shuffle and no group: cost is
O(n log n) in a text's own length, and copies or hot sources do not matter. Each line is judged once.

Defined results: a null or empty text has no words, fails the base limits and is rejected. Repeated rows are judged
alike, one result each. Other columns pass through untouched under any name; a column of the input that has the name of a
result is replaced by the result. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Sealed, let, strip, table, words

#: A doc loses a line with these in it, if the line is short.
BOILERPLATE = "(?i)(licensed? under|all rights reserved|copyright|apache license|creative commons|cookie|privacy policy|terms of (use|service)|subscribe|newsletter|click here|read more|sign (in|up)|log in|javascript)"
SYMBOLS = "#*$%&|<>"
TERMINAL = r'[.!?:;…。"”»)\]]$'
WINDOW = 5
BOILERPLATE_CHARS, FRAGMENT_CHARS = 160, 16


def _characters(text: Column) -> Column:
    """How many characters of SYMBOLS there are."""
    return F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", ""))


def _windows(w: Column) -> Column:
    """Hashes of all windows of WINDOW words."""
    at = lambda h: F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW)]))
    return let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.slice(at(h), F.lit(1), F.greatest(F.size(h) - (WINDOW - 1), F.lit(0))))


def _covered(g: Column) -> Column:
    """Words inside windows that occur twice or more."""
    placed = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    twin = lambda s, x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
    starts = lambda s: F.sort_array(F.transform(F.filter(s, lambda x, i: twin(s, x, i - 1) | twin(s, x, i + 1)), lambda x: x["p"]))
    step = lambda p: F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))
    return let(placed, lambda s: let(starts(s), lambda p: F.aggregate(step(p), F.lit(0), lambda a, x: a + x)))


def line_fails(line: Column, symbols: Column, boilerplate_chars: int = BOILERPLATE_CHARS, fragment_chars: int = FRAGMENT_CHARS) -> Column:
    """Whether a stripped line fails; a blank one does not. ``symbols``: how many SYMBOLS the whole text has (without any, no line is tested for them)."""
    size = F.length(line)
    navigation = lambda n: (n >= 2) & (n * 30 > size)
    noisy = (symbols > 0) & let(_characters(line), lambda n: (n * 20 > size) | navigation(F.length(F.regexp_replace(line, "[^|]+", ""))))
    shouting = (size >= 12) & (F.upper(line) == line) & (F.lower(line) != line)
    boilerplate = (size <= boilerplate_chars) & F.rlike(line, F.lit(BOILERPLATE))
    unfinished = (size <= fragment_chars) & ~F.rlike(line, F.lit(TERMINAL))
    return (size > 0) & (noisy | shouting | boilerplate | unfinished)


def apply_rules(docs: DataFrame, text: str = "text", min_words: int = 10, max_repeat_pct: int = 20, max_lost_pct: int = 60, boilerplate_chars: int = BOILERPLATE_CHARS, fragment_chars: int = FRAGMENT_CHARS) -> DataFrame:
    """``docs`` with the base measures, ``lost_chars``, ``cleaned`` (text without failing lines), ``base_failed``, ``kept``."""
    # Each step's columns are used more than once by the next, so the optimiser keeps the steps apart.
    sealed = Sealed(docs)
    source, judge = sealed.of(text), lambda s, n: line_fails(s, n, boilerplate_chars, fragment_chars)
    whole = F.coalesce(source, F.lit(""))
    one = sealed.df.withColumns({"w": words(source), "marks": _characters(whole)})
    judged = lambda x, n: let(strip(x), lambda s: F.struct(x.alias("line"), judge(s, n).alias("fails"), (s != "").alias("inked")))
    two = one.withColumns({"g": _windows(F.col("w")), "lines": let(F.col("marks"), lambda n: F.transform(F.split(whole, "\n", -1), lambda x: judged(x, n)))})
    line = lambda x: x["line"]
    three = two.withColumns({"inked": F.transform(F.filter("lines", lambda x: x["inked"]), line), "failing": F.transform(F.filter("lines", lambda x: x["fails"]), line), "left": F.transform(F.filter("lines", lambda x: ~x["fails"]), line)})
    repeats = F.when(F.size(F.array_distinct("g")) == F.size("g"), F.lit(0)).otherwise(_covered(F.col("g")))
    out = three.withColumns(
        {
            "n_words": F.size("w").cast("long"),
            "word_chars": F.length(F.array_join("w", "")).cast("long"),
            "n_symbols": F.col("marks").cast("long"),
            "n_dup_lines": (F.size("inked") - F.size(F.array_distinct("inked"))).cast("long"),
            "n_repeat_words": repeats.cast("long"),
            "lost_chars": F.length(F.array_join("failing", "")).cast("long"),
            "cleaned": F.when(F.size("failing") == 0, whole).otherwise(F.array_join("left", "\n")),
        }
    )
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_pct)
    verdict = ~failed & (F.col("lost_chars") * 100 <= F.length(whole) * max_lost_pct)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars", "cleaned")
    return sealed.opened(out, {**{n: F.col(n) for n in names}, "base_failed": failed, "kept": verdict})


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return apply_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")
