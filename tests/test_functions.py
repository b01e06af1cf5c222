"""Scalar functions: fixed cases and properties."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veinstone.functions import mentions, text
from veinstone.operators import retrieve
from veinstone.operators.claims import claims_of


def _versions(s):
    return [(m["normalized"], m["normalized_end"], m["qualifier"], m["precision"]) for m in mentions.version_mentions(s)]


def test_version_mentions():
    assert _versions("v2.0") == [("2.0", None, "EXACT", "MINOR")]
    assert _versions("1.2.x is old") == [("1.2", None, "EXACT", "MINOR")]
    assert _versions("since 1.2") == [("1.2", None, "SINCE", "MINOR")]
    assert _versions("removed in 2.0") == [("2.0", None, "EXACT", "MINOR")]
    for s in ("1.2 - 2.0", "1.2 to 2.0", "between 1.2 and 2.0", "since 1.2 to 2.0"):
        assert _versions(s) == [("1.2", "2.0", "RANGE", "MINOR")]
    assert _versions("Python 3 requires 5 minutes.") == []
    assert [v[0] for v in _versions("in 1.2 and again in 3.4")] == ["1.2", "3.4"]
    assert _versions("v2")[0][3] == "MAJOR" and _versions("v2.0.0")[0][3] == "PATCH"
    assert _versions("5 to 10 minutes")[0][2] == "RANGE"
    assert mentions.version_mentions(None) == []


def test_symbols():
    for s in ("FooClient.create()", "foo.FooClient.create", "FooClient#create", "FooClient::create"):
        assert mentions.normalized_symbol(s, "foo")["name"] == "FooClient.create"
    assert mentions.symbol_mentions("set `timeout`, e.g. see our docs.") == []
    assert [m["name"] for m in mentions.symbol_mentions("`A.b` and C.d() and `run()`")] == ["A.b", "C.d", "run"]


def test_claims():
    def kinds(s, **more):
        return [(c["change_type"], c["symbol_name"], c["replacement_symbol"]) for c in claims_of(s, {}, **more)]

    assert kinds("`A.b()` was replaced by `C.d()`.") == [("REPLACEMENT", "A.b", "C.d")]
    assert kinds("use `C.d` instead of `A.b`") == [("DEPRECATED", "A.b", "C.d")]
    assert kinds("`A.b` was moved to `C.d`; more.") == [("MOVED", "A.b", "C.d")]
    assert kinds("`A.b` was removed and `C.d` was renamed.") == [("REMOVED", "A.b", None), ("RENAMED", "C.d", None)]
    assert kinds("`A.b` is nice.") == [] and kinds("it was removed.") == []
    c = claims_of("`A.b()` no longer accepts the `timeout` parameter (#4213); use dicts instead.", {"document_refs": ["PR#100"]}, "3.0")[0]
    assert (c["parameters"], c["external_refs"], c["migration_action_text"], c["version_to"]) == (["timeout"], ["#4213", "PR#100"], "use dicts instead", "3.0")
    assert (c["extraction_confidence"], c["extraction_method"]) == ("INFERRED", "regex:change_keyword+ambient_version")
    called = []
    claims_of("Note: `A.b()` is odd.", {}, extractor=lambda s, d: called.append(s) or [])
    assert len(called) == 1


def test_intervals(spark):
    def meets(a, b):
        row = spark.range(1).select(mentions.overlap(mentions.interval(*[F.lit(x).cast("string") for x in a]), mentions.interval(*[F.lit(x).cast("string") for x in b]))).head()
        return row[0]

    span = ("1.2", "2.0", "RANGE")
    assert [meets(span, (v, None, "EXACT")) for v in ("1.5", "2.5", "1.2", "2.0", "2")] == [True, False, True, True, True]
    assert meets(("1.2", None, "SINCE"), ("99.0", None, "EXACT")) and not meets(("1.2", None, "SINCE"), ("1.0", None, "EXACT"))
    assert meets(("2", None, "EXACT"), ("2.0.0", None, "EXACT")) and not meets(("1.10", None, "EXACT"), ("1.2", None, "EXACT"))
    assert meets(span, (None, None, "EXACT"))


def test_splitters(spark):
    def one(column, s):
        return spark.createDataFrame([(s,)], "t string").select(column(F.col("t"))).head()[0]

    assert one(lambda t: text.line_groups(t, 5), "A\nB\n\n C \nD\nE\nF\nG") == ["A B C D E", "F G"]
    assert one(lambda t: text.line_groups(t, 5), " \n") == []
    assert one(text.paragraphs, "a\nb\n \n\nc") == ["a\nb", "c"]
    assert one(text.sentences, "One. Two! Three") == ["One.", "Two!", "Three"]
    assert [(s.heading, s.body.strip()) for s in one(text.sections, "intro\n# T\nbody\n#123 fix\nx")] == [(None, "intro"), ("T", "body"), ("123 fix", "x")]
    assert [(s.heading, s.body) for s in one(text.sections, "plain")] == [(None, "plain")]
    assert one(text.statements, "- a b\n* c\nprose.") == ["a b", "c"]
    assert one(text.external_refs, "PR #1, GH-2, issue 3 (#4) #5") == ["#1", "#2", "#3", "#4"]
    assert one(text.tokens, "`FooClient.create()` v2.0") == ["fooclient.create", "fooclient", "create", "v2"] + ["0"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aZ_é1.:# \n²", max_size=30), min_size=1, max_size=8))
def test_tokenizers_agree(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.tokens(F.col("t")).alias("x")).collect()
    for r in rows:
        assert r.x == retrieve.tokenized(r.t), re.escape(r.t)
