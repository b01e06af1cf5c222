"""Queries over the driver's tables, one or more for each operator, as callables of (spark, folder)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import ids, mentions, text
from ..operators import claims, evaluate, resolve, retrieve, store, vectors
from ..session import remove, work_folder
from ..sources import documents as sources
from ..sources.tables import spread, table
from ..streaming.linker import link_stream
from . import benchmark

CANDIDATES = retrieve.CANDIDATES


# Text.


def _docs(spark, d):
    return spread(table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "text"))


def bm25_topk(spark, d, k: int = 10):
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retrieve.bm25(_docs(spark, d), queries, k)


def term_stats(spark, d):
    each = _docs(spark, d).select("item_id", F.explode(text.tokens(F.col("text"))).alias("term"))
    return each.groupBy("term", "item_id").agg(F.count("*").alias("tf")).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def doc_stats(spark, d):
    return _docs(spark, d).select(F.col("item_id").alias("doc_id"), F.size(text.tokens(F.col("text"))).cast("long").alias("dl"))


def fixed_line_chunks(spark, d):
    return _docs(spark, d).select(F.col("item_id").alias("doc_id"), F.posexplode(text.line_groups(F.col("text"), 5)).alias("idx", "chunk")).withColumn("idx", F.col("idx").cast("long"))


def sentence_split(spark, d):
    return _docs(spark, d).select(F.col("item_id").alias("doc_id"), F.posexplode(text.sentences(F.col("text"))).alias("idx", "sentence")).withColumn("idx", F.col("idx").cast("long"))


def paragraph_chunks(spark, d):
    spaced = F.replace(F.col("text"), F.lit("\n"), F.lit("\n \n"))
    return _docs(spark, d).select(F.col("item_id").alias("doc_id"), F.posexplode(text.paragraphs(spaced)).alias("idx", "paragraph")).withColumn("idx", F.col("idx").cast("long"))


def content_ids(spark, d):
    docs = table(spark, d, "documents").withColumn("kind", F.lit("OFFICIAL_DOCS"))
    doc = docs.withColumn("document_id", ids.document_id(F.col("kind"), F.lit(None).cast("string"), F.col("text")))
    at = F.lit(0)
    return doc.select("doc_id", "document_id", ids.chunk_id(F.col("document_id"), at, F.col("text")).alias("chunk_id"), ids.evidence_id(F.col("document_id"), at, F.col("text")).alias("evidence_id"))


_KINDS = ["RELEASE_NOTE", "MIGRATION_GUIDE", "OFFICIAL_DOCS", "GITHUB_PR_ISSUE"]


def _raw(spark, d):
    kind = F.get(F.array(*[F.lit(k) for k in _KINDS]), (F.col("doc_id") % 4).cast("int"))
    url = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("local://"), F.col("doc_id")))
    ref = F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("PR#"), F.col("doc_id")))
    return table(spark, d, "documents").select(kind.alias("source_type"), F.col("text").alias("raw_text"), url.alias("url"), F.lit(None).cast("string").alias("version"), F.lit(None).cast("string").alias("date"), ref.alias("reference"), F.col("doc_id").alias("doc_ord"))


def source_documents(spark, d):
    return sources.source_documents(_raw(spark, d)).select(F.col("doc_ord").alias("doc_id"), "document_id", "source_type", "provenance", F.array_join("document_refs", ",").alias("refs"))


# Change notes made of the parts: what the notes say is known from the columns.



def _parts(spark, d):
    name = F.concat(F.regexp_replace("p_brand", "[^A-Za-z0-9]", ""), F.lit(".item_"), F.col("p_partkey"))
    return table(spark, d, "part").select("p_partkey", "p_size", F.regexp_replace("p_brand", "[^A-Za-z0-9]", "").alias("brand"), name.alias("symbol"))


def _spoken(parts):
    """Symbols in four spellings, versions in four, changes in six, by the key's remainder."""
    k = F.col("p_partkey")
    size = F.col("p_size").cast("string")
    brand, item = F.substring_index("symbol", ".", 1), F.substring_index("symbol", ".", -1)
    spelled = F.when(k % 4 == 0, F.concat(brand, F.lit("."), item, F.lit("()"))).when(k % 4 == 1, F.concat(brand, F.lit("#"), item)).when(k % 4 == 2, F.concat(brand, F.lit("::"), item)).otherwise(F.concat(F.lit("pkg."), brand, F.lit("."), item))
    version = F.when(k % 4 == 0, F.concat(F.lit("in v"), size, F.lit(".0"))).when(k % 4 == 1, F.concat(F.lit("since "), size, F.lit(".x"))).when(k % 4 == 2, F.concat(F.lit("from "), size, F.lit(".1 to "), size, F.lit(".5.2"))).otherwise(F.concat(F.lit("between "), size, F.lit(" and 99")))
    verb = F.get(F.array(*[F.lit(v) for v in _VERBS]), (k % 6).cast("int"))
    ref = F.when(k % 3 == 0, F.concat(F.lit(" (#"), (k % 50).cast("string"), F.lit(")"))).otherwise("")
    return parts.withColumns({"spelled": spelled, "note": F.concat(F.lit("`"), spelled, F.lit("` "), verb, F.lit(" "), version, ref, F.lit("."))})


#: Phrases and the changes that they name.
_VERBS = ["was removed", "was deprecated", "was renamed", "now returns other values", "was relocated", "no longer accepts nulls"]


def symbol_normalize(spark, d):
    found = mentions.symbol_struct(F.col("spelled"), "pkg")
    return _spoken(_parts(spark, d)).select("p_partkey", found.alias("s")).select("p_partkey", "s.name", "s.package", "s.kind")


def symbol_mentions(spark, d):
    found = _spoken(_parts(spark, d)).withColumn("m", mentions.symbols_in("pkg")("note")).select("p_partkey", F.size("m").cast("long").alias("n"), F.get("m", F.lit(0)).alias("s"))
    return found.select("p_partkey", "n", "s.raw", F.col("s.start").cast("long").alias("start_at"), "s.name", "s.kind")


def version_mentions(spark, d):
    found = _spoken(_parts(spark, d)).select("p_partkey", mentions.versions_in("note").alias("m"))
    return found.select("p_partkey", F.size("m").cast("long").alias("n"), F.get("m", F.lit(0)).alias("v")).select("p_partkey", "n", "v.normalized", "v.normalized_end", "v.qualifier", "v.precision")


def version_overlap(spark, d):
    """Each part's version against stated query intervals."""
    asked = [("exact", "10.0", None, "EXACT"), ("since", "25", None, "SINCE"), ("range", "5.0.1", "12", "RANGE"), ("open", "40.2", None, "RANGE")]
    own = mentions.point(F.concat(F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, ".0").otherwise("")))
    rows = _parts(spark, d).select("p_partkey", own.alias("own"))
    meets = [F.struct(F.lit(n).alias("asked"), mentions.overlap(mentions.interval(F.lit(a), F.lit(b).cast("string"), F.lit(q)), F.col("own")).alias("meets")) for n, a, b, q in asked]
    return rows.select("p_partkey", F.explode(F.array(*meets)).alias("q")).select("p_partkey", "q.asked", "q.meets")


def change_type_classify(spark, d):
    return _spoken(_parts(spark, d)).select("p_partkey", claims.change_type(F.col("note")).alias("change_type"))


def _note_documents(spark, d, note):
    """One release note for each part, with a version heading for even keys."""
    k = F.col("p_partkey")
    body = F.concat(F.when(k % 2 == 0, F.concat(F.lit("## v"), F.col("p_size").cast("string"), F.lit(".0.0\n\n"))).otherwise(""), F.lit("- "), note, F.lit("\n"))
    raw = _spoken(_parts(spark, d)).select(F.lit("RELEASE_NOTE").alias("source_type"), body.alias("raw_text"), F.concat(F.lit("local://"), k.cast("string")).alias("url"), F.lit(None).cast("string").alias("version"), F.lit(None).cast("string").alias("date"), F.lit(None).cast("string").alias("reference"), k.alias("doc_ord"))
    return sources.source_documents(raw)


def extract_claims(spark, d):
    found = claims.extract_claims(_note_documents(spark, d, F.col("note")), "pkg")
    return found.select(F.col("doc_ord").alias("p_partkey"), "symbol_name", "version_from", "version_to", "change_type", F.array_join("external_refs", ",").alias("refs"), "extraction_confidence", "extraction_method")


def conjunction_claims(spark, d):
    note = F.concat(F.lit("`"), F.col("symbol"), F.lit("` was removed and `other."), F.substring_index("symbol", ".", -1), F.lit("` was renamed."))
    found = claims.extract_claims(_note_documents(spark, d, note), "pkg")
    return found.select(F.col("doc_ord").alias("p_partkey"), F.col("claim_idx").cast("long").alias("claim_idx"), "symbol_name", "version_to", "change_type", "summary")


def replacement_claims(spark, d):
    item = F.substring_index("symbol", ".", -1)
    note = F.concat(F.lit("`"), F.col("symbol"), F.lit("()` was replaced by `New."), item, F.lit("()`; use dicts instead."))
    found = claims.extract_claims(_note_documents(spark, d, note), "pkg")
    return found.select(F.col("doc_ord").alias("p_partkey"), "symbol_name", "symbol_kind", "change_type", "replacement_symbol", "migration_action_text", "version_to")


def section_bullet_chunks(spark, d):
    found = claims.chunks_of(_note_documents(spark, d, F.col("note")), "pkg")
    return found.select(F.col("doc_ord").alias("p_partkey"), F.col("ord").cast("long").alias("idx"), F.col("text").alias("chunk"), "version", F.array_join("symbols", ",").alias("symbols"))


# Documents that say many things: every phrase, form of replacement, form of reference, heading and source type.

#: Phrases and the changes that they name.
_PHRASES = [("no longer accepts nulls", "SIGNATURE_CHANGED"), ("will no longer accept nulls", "SIGNATURE_CHANGED"), ("now requires a key", "SIGNATURE_CHANGED"), ("has a new parameter", "SIGNATURE_CHANGED"), ("has a new required parameter", "SIGNATURE_CHANGED"), ("has a changed signature", "SIGNATURE_CHANGED"), ("now returns lists", "BEHAVIOR_CHANGED"), ("now throws errors", "BEHAVIOR_CHANGED"), ("behavior changed", "BEHAVIOR_CHANGED"), ("behavior has changed", "BEHAVIOR_CHANGED"), ("was moved to another place", "MOVED"), ("was relocated", "MOVED"), ("is deprecated", "DEPRECATED"), ("was renamed", "RENAMED"), ("is now called otherwise", "RENAMED"), ("is now named otherwise", "RENAMED"), ("was removed", "REMOVED"), ("is no longer there", "BEHAVIOR_CHANGED")]
_REPLACED = ["`Old.a_{k}()` was replaced by `New.b_{k}()`", "`Old.a_{k}` is deprecated in favor of `New.b_{k}`", "use `New.b_{k}` instead of `Old.a_{k}`", "`Old.a_{k}()` was moved to `New.b_{k}()`"]
_REFERENCES = [" PR #{n}", " GH-{n}", " issue #{n}", " (#{n})", ""]


def _pick(options: list[str], number, **values):
    """One of the options by a number's remainder, with columns put in."""
    out = F.get(F.array(*[F.lit(o) for o in options]), F.pmod(number, F.lit(len(options))).cast("int"))
    for name, value in values.items():
        out = F.replace(out, F.lit(f"{{{name}}}"), value.cast("string"))
    return out


def _varied_documents(spark, d):
    """A document for each part: two sections, three bullets, a sentence; the source type goes by the key."""
    k = F.col("p_partkey")
    size = F.col("p_size").cast("string")
    head = F.when(k % 3 == 0, F.concat(F.lit("## v"), size, F.lit(".0.0\n\n"))).when(k % 3 == 1, F.concat(F.lit("# Release "), size, F.lit(".1\n\n"))).otherwise("")
    one = F.concat(F.lit("- `"), F.col("spelled"), F.lit("` "), _pick([p for p, _ in _PHRASES], k), F.lit(" with the `size_"), k.cast("string"), F.lit("` parameter"), _pick(_REFERENCES, k, n=k), F.lit(".\n"))
    two = F.concat(F.lit("* "), _pick(_REPLACED, k, k=k), F.when(k % 2 == 0, "; call the new one instead").otherwise(""), F.lit(".\n"))
    three = F.concat(F.lit("- Plain words about `"), F.col("symbol"), F.lit("` only.\n"))
    last = F.concat(F.lit("\n### 9.9 notes\n\nThe `Other.item_"), k.cast("string"), F.lit("()` call was removed. Nothing else.\n"))
    no = F.lit(None).cast("string")
    kind = _pick(_KINDS, k)
    return sources.source_documents(_spoken(_parts(spark, d)).select(kind.alias("source_type"), F.concat(head, one, two, three, last).alias("raw_text"), F.concat(F.lit("local://"), k.cast("string")).alias("url"), no.alias("version"), no.alias("date"), F.when(k % 4 == 3, F.concat(F.lit("PR#"), k.cast("string"))).alias("reference"), k.alias("doc_ord")))


def extract_claims_varied(spark, d):
    found = claims.extract_claims(_varied_documents(spark, d), "pkg")
    return found.select(F.col("doc_ord").alias("p_partkey"), F.col("claim_idx").cast("long").alias("claim_idx"), "symbol_name", "symbol_kind", "change_type", "version_to", "replacement_symbol", F.array_join("parameters", ",").alias("parameters"), "migration_action_text", F.array_join("external_refs", ",").alias("refs"), "extraction_method", "source_type")


def chunks_varied(spark, d):
    found = claims.chunks_of(_varied_documents(spark, d), "pkg")
    return found.select(F.col("doc_ord").alias("p_partkey"), F.col("ord").cast("long").alias("idx"), F.col("text").alias("chunk"), "version", F.array_join("symbols", ",").alias("symbols"), "provenance")


def _many_mentions(spark, d):
    k = F.col("p_partkey")
    more = F.concat(F.lit(" See Api.call_"), k.cast("string"), F.lit("() and `run_"), k.cast("string"), F.lit("()`; between 3."), (k % 7).cast("string"), F.lit(" and v4.0, in version "), (k % 9).cast("string"), F.lit(".1.2.x."))
    return _spoken(_parts(spark, d)).withColumn("note", F.concat("note", more))


def symbol_mentions_all(spark, d):
    found = _many_mentions(spark, d).select("p_partkey", F.posexplode(mentions.symbols_in("pkg")("note")).alias("idx", "s"))
    return found.select("p_partkey", F.col("idx").cast("long").alias("idx"), "s.raw", "s.name", "s.kind")


def version_mentions_all(spark, d):
    found = _many_mentions(spark, d).select("p_partkey", F.posexplode(mentions.versions_in("note")).alias("idx", "v"))
    return found.select("p_partkey", F.col("idx").cast("long").alias("idx"), "v.normalized", "v.normalized_end", "v.qualifier", "v.precision")


def pipeline_statistics(spark, d):
    """Counts of a whole corpus build over one note for each part."""
    docs = _note_documents(spark, d, F.col("note"))
    return benchmark.statistics(docs, benchmark.build(docs, "pkg"))


# Resolution.


def _claims(spark, d):
    """Claims straight from the parts: one symbol for each brand and size."""
    k = F.col("p_partkey")
    return _parts(spark, d).select(k.alias("doc_ord"), F.lit(0).alias("claim_idx"), F.concat(F.lit("ev_"), k.cast("string")).alias("evidence_id"), F.concat("brand", F.lit("."), F.col("p_size").cast("string")).alias("symbol_name"), F.lit("pkg").alias("symbol_package"), F.lit(None).cast("string").alias("symbol_kind"), F.when(k % 3 == 0, F.concat((k % 7).cast("string"), F.lit(".0"))).alias("version_from"), F.when(k % 2 == 0, F.concat((k % 5).cast("string"), F.lit(".0"))).alias("version_to"), F.get(F.array(F.lit("REMOVED"), F.lit("MOVED")), (k % 11 % 2).cast("int")).alias("change_type"), F.concat(F.lit("the same words for "), F.col("brand")).alias("summary"), F.lit(None).cast("string").alias("replacement_symbol"), F.when(k % 4 == 0, F.array(F.concat(F.lit("#"), (k % 3).cast("string")))).otherwise(F.array().cast("array<string>")).alias("external_refs"))


def _next_pairs(spark, d):
    """Each claim with the one before it of the same symbol."""
    rows = _claims(spark, d)
    whole = F.struct(*rows.columns)
    return rows.select(whole.alias("b"), F.lag(whole).over(Window.partitionBy("symbol_name").orderBy("doc_ord")).alias("a")).filter("a is not null")


def cannot_link_pairs(spark, d):
    return _next_pairs(spark, d).select(F.col("a.doc_ord").alias("a_key"), F.col("b.doc_ord").alias("b_key"), resolve.cannot_link("a", "b").alias("reason"))


def pairwise_score(spark, d):
    vectors = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    rows, n = _next_pairs(spark, d), vectors.count()
    for side in "ab":
        rows = rows.join(vectors.select(F.col("vec_id").alias(f"{side}_vec"), F.col("v").alias(f"{side}_v")), F.col(f"{side}.doc_ord") % n == F.col(f"{side}_vec"))
    scored = rows.withColumns({"s": resolve.pair_score("a", "b", resolve.cosine(F.col("a_v"), F.col("b_v"))), "veto": resolve.cannot_link("a", "b")})
    said = resolve.decision(F.col("veto"), F.arrays_overlap("a.external_refs", "b.external_refs"), F.round("s.total", 6))
    return scored.select(F.col("a.doc_ord").alias("a_key"), F.col("b.doc_ord").alias("b_key"), F.round("s.total", 6).alias("total"), said["decision"].alias("decision"), said["method"].alias("method"), F.round(said["score"], 6).alias("score"))


def link_evidence(spark, d):
    """Claims of a brand that say the same: the first originates, the others support it."""
    rows = _claims(spark, d).withColumns({"symbol_name": F.substring_index("symbol_name", ".", 1), "version_to": F.lit(None).cast("string"), "change_type": F.lit("REMOVED"), "external_refs": F.array().cast("array<string>")})
    out = resolve.link_evidence(rows).filter("kind = 'link'")
    return out.select("evidence_id", "change_id", "link_type", "confidence_tier", "link_method", "review_status", F.round("link_confidence", 6).alias("link_confidence"))


def _contested(spark, d):
    """Claims with vetoes, shared references and, as every fifth has no summary, unsure matches."""
    return _claims(spark, d).withColumn("summary", F.when(F.col("doc_ord") % 5 == 0, "").otherwise(F.col("summary")))


def link_evidence_general(spark, d):
    out = resolve.link_evidence(_contested(spark, d))
    return out.select("kind", "evidence_id", "change_id", "link_type", "confidence_tier", "review_status", "other_change_id", "reason")


def blocking_candidates(spark, d):
    """Claims against the first record of each symbol and version."""
    rows = _claims(spark, d)
    first = rows.groupBy("symbol_name", "symbol_package", "version_to").agg(F.min("doc_ord").alias("record"))
    return store.candidates(rows, first).select("doc_ord", F.col("candidate.record").alias("record"))


def cannot_link_upsert(spark, d):
    rows = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("x"), (F.col("o_orderkey") % 41).alias("y"), F.col("o_orderpriority").alias("reason"), F.col("o_orderkey").alias("seq"))
    return store.upsert_pairs(rows, "x", "y", F.col("seq"))


def store_integrity(spark, d):
    """Line items whose part is missing from the even parts, by part: the foreign key check, counted."""
    parents = table(spark, d, "part").filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("l_partkey"))
    return store.orphans(table(spark, d, "lineitem"), parents, "l_partkey").groupBy("l_partkey").agg(F.count("*").alias("n"))


def store_absent(spark, d):
    there = table(spark, d, "orders").filter("o_orderkey % 3 = 0")
    return store.insert_absent(table(spark, d, "orders").select("o_orderkey", "o_custkey"), there, ["o_orderkey"])


def repeated_keys(spark, d):
    return store.repeated_keys(table(spark, d, "orders"), ["o_custkey"])


def _groups_of_five(docs):
    return docs.select(F.col("item_id").alias("source_document_id"), F.posexplode(text.line_groups(F.col("text"), 5)).alias("ord", "text")).withColumn("chunk_id", F.concat_ws("_", "source_document_id", "ord"))


def owning_chunk_lines(spark, d):
    """Every line of every document found again in the document's groups of five lines."""
    docs = _docs(spark, d)
    found = docs.select(F.col("item_id").alias("source_document_id"), F.posexplode(text.lines(F.col("text"))).alias("claim_idx", "raw_text")).withColumn("evidence_id", F.col("source_document_id"))
    return store.owning_chunks(found, _groups_of_five(docs)).select(F.col("evidence_id").alias("doc_id"), F.col("claim_idx").cast("long"), "chunk_id")


def decode_records(spark, d):
    """Change rows whose lists come as JSON text, read as records."""
    k = F.col("p_partkey")
    rows = _parts(spark, d).select(F.concat(F.lit("chg_"), k.cast("string")).alias("change_id"), F.col("symbol").alias("symbol_name"), F.lit("pkg").alias("symbol_package"), F.when(k % 2 == 0, "method").alias("symbol_kind"), F.to_json(F.array(F.concat(F.lit("#"), (k % 7).cast("string")), F.lit('q"\\'))).alias("external_refs"), F.when(k % 3 == 0, '["a","b"]').otherwise("[]").alias("parameters"))
    whole = rows.select("*", *[F.lit(None).cast("string").alias(f.name) for f in store.schema("change_records").fields if f.name not in rows.columns])
    return store.decoded(whole, "change_records").select("change_id", "symbol.name", "symbol.package", "symbol.kind", F.array_join("external_refs", "|").alias("refs"), F.size("parameters").cast("long").alias("n_parameters"))


def links_of_change(spark, d):
    """Line items as links: those of one part, and those of one order."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("evidence_id"), F.col("l_partkey").alias("change_id"), "l_linenumber")
    return store.find(rows, change_id=7).withColumn("asked", F.lit("change")).unionByName(store.find(rows, evidence_id=7).withColumn("asked", F.lit("evidence")))


def vector_metadata(spark, d):
    """Documents as chunks of a collection: default ids and flat metadata, found by equality."""
    k = F.col("doc_id")
    rows = table(spark, d, "documents").select(k, F.lit("notes.v1.md").alias("name"), F.concat(F.lit("doc_"), k.cast("string")).alias("source_document_id"), F.lit("RELEASE_NOTE").alias("source_type"), F.when(k % 4 != 0, F.concat(F.lit("p"), (k % 3).cast("string"))).alias("package"), F.when(k % 3 != 0, F.concat((k % 5).cast("string"), F.lit(".0"))).alias("version"), F.array(F.lit("A.b"), F.concat(F.lit("C."), "lang")).alias("symbols"))
    flat = rows.select("doc_id", vectors.default_id(F.col("name"), k).alias("id"), *[v.alias(m) for m, v in vectors.metadata(rows).items()])
    return vectors.where(flat, package="p1", version="").unionByName(vectors.where(flat, package=""))


def gold_set(spark, d):
    """Gold rows of a query for each brand: the last change of each of its symbols, and the evidence of those."""
    rows = _claims(spark, d).select("symbol_name", F.substring_index("symbol_name", ".", 1).alias("brand"), F.concat(F.lit("chg_"), F.lpad(F.col("doc_ord").cast("string"), 9, "0")).alias("change_id"), "doc_ord")
    links = rows.select("change_id", F.explode(F.array(F.concat(F.lit("ev_"), F.col("doc_ord").cast("string")), F.concat(F.lit("ev_b"), F.col("doc_ord").cast("string")))).alias("evidence_id"))
    wanted = rows.groupBy(F.col("brand").alias("query_id")).agg(F.sort_array(F.collect_set("symbol_name")).alias("symbols"))
    out = benchmark.gold_rows(wanted, rows, links, "doc_ord")
    return out.select("query_id", F.array_join("required_change_ids", ",").alias("changes"), F.array_join("relevant_evidence_ids", ",").alias("evidence"), F.size("stability_evidence_ids").cast("long").alias("n_stable"))


def link_labels(spark, d):
    k = F.col("p_partkey")
    tier = F.get(F.array(*[F.lit(t) for t in ids.TIER_TEXT]), (k % 3).cast("int"))
    review = F.get(F.array(*[F.lit(t) for t in ("UNREVIEWED", *ids.REVIEW_TEXT)]), (k % 4).cast("int"))
    return table(spark, d, "part").select("p_partkey", ids.link_label(tier, review).alias("label"))


# Retrieval: queries are the vectors with ids divisible by 100 and the benchmark's items, numbered alike.


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding", "label")


def _dense(spark, d, k: int = CANDIDATES):
    v = _vectors(spark, d)
    asked = v.filter("item_id % 100 = 0").select((F.col("item_id") / 100).cast("long").alias("query_id"), "embedding")
    return retrieve.dense(v, asked, k)


def dense_topk(spark, d):
    return _dense(spark, d, 10)


def _items(spark, d):
    """Packages and versions for every document and vector id."""
    own = table(spark, d, "documents").select(F.col("doc_id").alias("item_id")).union(_vectors(spark, d).select("item_id")).distinct()
    package = F.when(F.col("item_id") % 4 == 0, None).otherwise(F.concat(F.lit("p"), (F.col("item_id") % 3).cast("string")))
    version = F.when(F.col("item_id") % 7 != 0, F.concat((F.col("item_id") % 5).cast("string"), F.lit("."), (F.col("item_id") % 3).cast("string")))
    return own.select("item_id", package.alias("package"), mentions.point(version).alias("versions"))


def _wanted(spark, d):
    """Since q % 5 for even queries, exactly q % 5 for odd ones."""
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    start = (F.col("query_id") % 5).cast("string")
    return asked.select("query_id", mentions.interval(start, F.lit(None).cast("string"), F.when(F.col("query_id") % 2 == 0, "SINCE").otherwise("EXACT")).alias("wanted"))


def sparse_filtered(spark, d):
    return retrieve.filtered(bm25_topk(spark, d, CANDIDATES), _items(spark, d), package="p1", wanted=_wanted(spark, d), output=10)


def dense_filtered(spark, d):
    return retrieve.filtered(_dense(spark, d), _items(spark, d), package="p2", output=10)


def _both(spark, d):
    return _dense(spark, d), bm25_topk(spark, d, CANDIDATES)


def rrf_fuse(spark, d):
    return retrieve.fuse(list(_both(spark, d)))


def rrf_weighted(spark, d):
    return retrieve.fuse(list(_both(spark, d)), [2.0, 1.0])


def hybrid_topk(spark, d):
    return retrieve.hybrid(*_both(spark, d))


def hybrid_version_filtered(spark, d):
    return retrieve.hybrid(*_both(spark, d), items=_items(spark, d), wanted=_wanted(spark, d))


def rerank_stub(spark, d):
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    pool = bm25_topk(spark, d, CANDIDATES).drop("score").join(asked, "query_id").join(_docs(spark, d), "item_id")
    return retrieve.rerank(pool, 10).withColumn("score", F.round("score", 6))


def prompt_render(spark, d):
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    found = evaluate.listed(bm25_topk(spark, d, 5).join(_docs(spark, d), "item_id"), "text")
    return asked.join(found, "query_id").select("query_id", F.sha2(retrieve.prompt(F.col("question"), F.col("found")), 256).alias("prompt_sha256"))


# Evaluation: the required items of a vector query are the vectors of its label.


def _gold(spark, d):
    v = _vectors(spark, d)
    labelled = v.groupBy("label").agg(F.sort_array(F.collect_list("item_id")).alias("required"))
    return v.filter("item_id % 100 = 0").select((F.col("item_id") / 100).cast("long").alias("query_id"), "label").join(labelled, "label")


def _results(spark, d, ranking):
    found = evaluate.listed(ranking.filter(F.col("rank") <= 10), "item_id")
    return evaluate.evaluated(_gold(spark, d), found)


def eval_metrics(spark, d):
    out = _results(spark, d, _dense(spark, d))
    return out.select("query_id", *[F.round(m, 6).alias(m) for m in evaluate.METRICS])


def metrics_by_type(spark, d):
    return evaluate.summary(_results(spark, d, _dense(spark, d)), "label")


def _modes(spark, d):
    near = _dense(spark, d)
    far = bm25_topk(spark, d, CANDIDATES).join(_gold(spark, d).select("query_id"), "query_id", "left_semi")
    out = None
    for mode, ranking in (("dense", near), ("sparse", far), ("hybrid", retrieve.hybrid(near, far))):
        one = _results(spark, d, ranking).withColumn("mode", F.lit(mode))
        out = one if out is None else out.unionByName(one)
    return out


def aggregate_modes(spark, d):
    return evaluate.summary(_modes(spark, d), "mode")


def _hard_gold(near, far):
    """Queries that one ranking answers, or the other, or only both together, or none; or that ask for something further down."""
    at = lambda ranking, rank, name: ranking.filter(F.col("rank") == rank).select("query_id", F.col("item_id").alias(name))
    q = F.col("query_id")
    required = F.when(q % 5 == 0, F.array("d1")).when(q % 5 == 1, F.array("s1")).when(q % 5 == 2, F.array("d1", "s1")).when(q % 5 == 3, F.array(F.lit(-1).cast("long"))).otherwise(F.array("d8"))
    return at(near, 1, "d1").join(at(far, 1, "s1"), "query_id").join(at(near, 8, "d8"), "query_id").select("query_id", required.alias("required"))


def _hard_results(spark, d):
    near, far = _both(spark, d)
    gold, out = _hard_gold(near, far), None
    for mode, ranking in (("dense", near), ("sparse", far), ("hybrid", retrieve.hybrid(near, far))):
        one = evaluate.evaluated(gold, evaluate.listed(ranking.filter(F.col("rank") <= 10), "item_id")).withColumn("mode", F.lit(mode))
        out = one if out is None else out.unionByName(one)
    return out


def failure_quadrant(spark, d):
    return evaluate.quadrants(_hard_results(spark, d))


def failing_queries(spark, d):
    return evaluate.failing(_hard_results(spark, d).withColumnRenamed("mode", "retrieval_mode"))


def diagnose_ranks(spark, d):
    near, far = _both(spark, d)
    gold = _hard_gold(near, far)
    own = gold.select(F.explode("required").alias("item")).distinct().select(F.col("item").alias("item_id"), "item")
    return evaluate.diagnosis({"dense": near, "sparse": far, "hybrid": retrieve.hybrid(near, far, CANDIDATES)}, own, gold)


def ablation_modes(spark, d):
    """Mean metrics of the fusion weights and of reranking all candidates, over documents' texts."""
    near, far = _both(spark, d)
    gold, out = _hard_gold(near, far), None
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    pool = retrieve.hybrid(near, far, CANDIDATES).drop("score").join(asked, "query_id").join(_docs(spark, d), "item_id")
    ranked = {mode: retrieve.hybrid(near, far, weights=weights) for mode, weights in benchmark.WEIGHTS.items()} | {"hybrid_reranked": retrieve.rerank(pool, 10)}
    for mode, ranking in ranked.items():
        one = evaluate.evaluated(gold, evaluate.listed(ranking, "item_id")).withColumn("mode", F.lit(mode))
        out = one if out is None else out.unionByName(one)
    return evaluate.summary(out, "mode")


def gold_counts(spark, d):
    k = F.col("item_id")
    gold = table(spark, d, "benchmark").select(k.alias("query_id"), _pick(["exact_symbol", "negative", "multi_change"], k).alias("query_type"), F.when(k % 3 == 1, "stability").otherwise("change_retrieval").alias("evaluation_scope"))
    return evaluate.counts(gold)


def resolve_items(spark, d):
    """BM25's documents as their sources: each source once, at its first place."""
    mapping = table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.lit(0).alias("idx"), F.col("source").alias("item"))
    return evaluate.resolve_items(bm25_topk(spark, d, 10), mapping)


def rank_trace(spark, d):
    gold = _gold(spark, d).select("query_id", F.filter("required", lambda x: x % 100 != 0).alias("required"))
    return evaluate.rank_trace(_dense(spark, d), gold)


def stream_event_link(spark, d):
    """Link counts of the claims replayed as a stream of one batch: a row for each type and state of review."""
    root = work_folder(spark, "stream")
    try:
        rows = _contested(spark, d)
        rows.write.parquet(f"{root}/claims")
        stream = link_stream(spark.readStream.schema(rows.schema).parquet(f"{root}/claims"))
        query = stream.writeStream.format("parquet").option("path", f"{root}/links").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        found = spark.read.schema(stream.schema).parquet(f"{root}/links").groupBy("link_type", "review_status").agg(F.count("*").alias("n"))
        return spark.createDataFrame(found.collect(), found.schema)
    finally:
        remove(spark, root)


NAMES = "bm25_topk term_stats doc_stats fixed_line_chunks sentence_split paragraph_chunks content_ids source_documents symbol_normalize symbol_mentions version_mentions version_overlap change_type_classify extract_claims conjunction_claims replacement_claims section_bullet_chunks extract_claims_varied chunks_varied symbol_mentions_all version_mentions_all pipeline_statistics cannot_link_pairs pairwise_score link_evidence link_evidence_general blocking_candidates cannot_link_upsert store_integrity store_absent repeated_keys owning_chunk_lines decode_records links_of_change vector_metadata gold_set link_labels dense_topk sparse_filtered dense_filtered rrf_fuse rrf_weighted hybrid_topk hybrid_version_filtered rerank_stub prompt_render eval_metrics metrics_by_type aggregate_modes failure_quadrant failing_queries diagnose_ranks ablation_modes gold_counts resolve_items rank_trace stream_event_link".split()
QUERIES = {name: globals()[name] for name in NAMES}
