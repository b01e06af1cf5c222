"""A small corpus of our own from files to scores, against plain Python; the store, collections and readers."""

from __future__ import annotations

import json
import math
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from veinstone.operators import evaluate, resolve, retrieve, store, vectors
from veinstone.plans import benchmark
from veinstone.sources import documents as sources
from veinstone.sources import pdf

HERE = Path(__file__).parent / "corpus"
FILES = [("MIGRATION_GUIDE", "migration_guide.md"), ("RELEASE_NOTE", "release_notes.md"), ("OFFICIAL_DOCS", "concepts.md")]
#: id, text, type, symbols, scope.
QUERIES = [
    ("q1", "Client.fetch removed", "exact_symbol", ["Client.fetch"], "change_retrieval"),
    ("q2", "limit parameter of the pool", "natural_language", ["Pool.size"], "change_retrieval"),
    ("q3", "what has replaced Client.open and Client.fetch?", "multi_change", ["Client.open", "Client.fetch"], "change_retrieval"),
    ("q4", "Log.level in 1.5", "exact_symbol", ["Log.level"], "change_retrieval"),
    ("q5", "what does Cache.clear return since 3.0", "exact_symbol", ["Cache.clear"], "change_retrieval"),
]
FACTS = [("q6", "Clients open sessions. `Client.fetch()` talks to a server.")]


@pytest.fixture(scope="module")
def built(spark):
    docs = sources.read_corpus(spark, [(kind, str(HERE / name), f"local://{name}") for kind, name in FILES])
    tables = {k: v.cache() for k, v in benchmark.build(docs, "lib").items()}
    return docs, tables | {"numbered": benchmark.numbered(tables["chunks"]).cache()}


@pytest.fixture(scope="module")
def gold(spark, built, tmp_path_factory):
    _, tables = built
    wanted = spark.createDataFrame([(q, s) for q, _, _, s, _ in QUERIES], "query_id string, symbols array<string>")
    facts = spark.createDataFrame(FACTS, "query_id string, fact string")
    rows = benchmark.gold_rows(wanted, tables["change_records"], tables["evidence_links"], "ord", facts, tables["chunks"]).collect()
    texts = {q: (t, k, s) for q, t, k, _, s in QUERIES} | {"q6": ("is anything new?", "negative", "stability")}
    queries = [{"query_id": r.query_id, "query_text": texts[r.query_id][0], "query_type": texts[r.query_id][1], "required_change_ids": r.required_change_ids, "relevant_evidence_ids": r.relevant_evidence_ids, "stability_evidence_ids": r.stability_evidence_ids, "evaluation_scope": texts[r.query_id][2]} for r in sorted(rows, key=lambda r: r.query_id)]
    path = tmp_path_factory.mktemp("gold") / "gold.json"
    sources.write_gold(str(path), {"name": "own"}, queries, sources.gold_digest(queries))
    with pytest.raises(ValueError):
        sources.write_gold(str(path), {"name": "own"}, queries[1:], sources.gold_digest(queries))
    assert json.loads(path.read_text())["queries"] == queries
    return sources.read_gold(spark, str(path)).cache()


def test_build(built):
    docs, tables = built
    assert {r["table"]: r.n for r in benchmark.statistics(docs, tables).collect()} == {"documents": 3, "chunks": 10, "unresolved_changes": 8, "chunks_with_evidence": 8, "change_records": 6, "evidence_links": 8, "cannot_link_constraints": 0}
    claims = [(r.symbol_name, r.change_type, r.version_to, r.replacement_symbol, r.external_refs, r.parameters) for r in tables["claims"].orderBy("doc_ord", "claim_idx").collect()]
    assert claims[:4] == [("Client.fetch", "REMOVED", "2.0.0", None, ["#11"], []), ("Client.open", "REPLACEMENT", "2.0.0", "Session.open", [], []), ("Pool.size", "SIGNATURE_CHANGED", "2.0.0", None, [], ["limit"]), ("Cache.clear", "BEHAVIOR_CHANGED", None, None, [], [])]
    assert [(c[0], c[1], c[2]) for c in claims[4:]] == [("Client.fetch", "REMOVED", "2.0.0"), ("Pool.size", "SIGNATURE_CHANGED", "2.0.0"), ("Log.level", "DEPRECATED", "2.0.0"), ("Log.level", "RENAMED", "1.5.0")]
    methods = Counter(r.link_method for r in tables["evidence_links"].collect())
    assert methods == {"ORIGINATING": 6, "EXPLICIT_REFERENCE": 1, "PAIRWISE_RESOLUTION": 1}
    assert store.orphans(tables["evidence_links"], tables["change_records"], "change_id").count() == 0


def test_gold(built, gold):
    _, tables = built
    rows = {r.query_id: r for r in gold.collect()}
    named = {r.change_id: r for r in tables["change_records"].collect()}
    assert [named[c].symbol_name for c in rows["q3"].required_change_ids] == ["Client.open", "Client.fetch"]
    assert [named[c].change_type for c in rows["q4"].required_change_ids] == ["RENAMED"]  # the last of the symbol's changes
    assert len(rows["q1"].relevant_evidence_ids) == 2 and rows["q1"].relevant_evidence_ids == sorted(rows["q1"].relevant_evidence_ids)
    assert not rows["q6"].required_change_ids and len(rows["q6"].stability_evidence_ids) == 1 and rows["q6"].evaluation_scope == "stability"
    assert sorted((r.kind, r.value, r.n) for r in evaluate.counts(gold).collect())[:2] == [("evaluation_scope", "change_retrieval", 5), ("evaluation_scope", "stability", 1)]
    spark = gold.sparkSession
    with pytest.raises(ValueError, match="no change"):
        benchmark.gold_rows(spark.createDataFrame([("q", ["No.such"])], "query_id string, symbols array<string>"), tables["change_records"], tables["evidence_links"])
    with pytest.raises(ValueError, match="no chunk"):
        none = spark.createDataFrame([], "query_id string, symbols array<string>")
        benchmark.gold_rows(none, tables["change_records"], tables["evidence_links"], "ord", spark.createDataFrame([("q", "none such")], "query_id string, fact string"), tables["chunks"])


def _bm25(texts: dict[int, str], query: str, k: int) -> list[int]:
    tokens = {i: retrieve.tokenized(t) for i, t in texts.items()}
    average = sum(map(len, tokens.values())) / len(tokens)
    scores = {}
    for i, t in tokens.items():
        for w in retrieve.tokenized(query):
            df = sum(w in x for x in tokens.values())
            f = t.count(w)
            if f:
                scores[i] = scores.get(i, 0) + math.log(1 + (len(tokens) - df + 0.5) / (df + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(t) / average))
    return sorted(scores, key=lambda i: (-round(scores[i], 6), i))[:k]


def test_sparse_scores(built, gold):
    """The sparse mode from texts to metrics in plain Python, by changes and by evidence."""
    _, tables = built
    chunks = tables["numbered"]
    scope = gold.filter("evaluation_scope = 'change_retrieval'")
    texts = {r.n: r.text for r in chunks.collect()}
    of_evidence = {r.n: r.evidence_id for r in chunks.collect() if r.evidence_id}
    changes: dict[str, list[str]] = {}
    for r in tables["evidence_links"].collect():
        changes.setdefault(r.evidence_id, []).append(r.change_id)
    ranked = {"sparse": benchmark.rankings(chunks, scope)["sparse"]}
    for level, of in (("change", lambda n: sorted(changes[of_evidence[n]])), ("evidence", lambda n: [of_evidence[n]])):
        got = {r.query_id: r for r in benchmark.scored(chunks, tables["evidence_links"], scope, ranked, level).collect()}
        assert len(got) == 5
        for q in scope.collect():
            items = list(dict.fromkeys(c for n in _bm25(texts, q.query_text, 10) if n in of_evidence for c in of(n)))
            need = q.required_change_ids if level == "change" else q.relevant_evidence_ids
            hits = [i + 1 for i, c in enumerate(items) if c in need]
            r = got[q.query_id]
            assert r.recall_at_5 == pytest.approx(sum(c in items[:5] for c in need) / len(need)) and r.recall_at_10 == pytest.approx(sum(c in items[:10] for c in need) / len(need))
            assert r.mrr == pytest.approx(1 / hits[0] if hits else 0)
            ideal = sum(1 / math.log2(i + 2) for i in range(min(5, len(set(need)))))
            assert r.ndcg_at_5 == pytest.approx(sum(1 / math.log2(h + 1) for h in hits if h <= 5) / ideal)


def test_modes(built, gold):
    _, tables = built
    chunks = tables["numbered"]
    scope = gold.filter("evaluation_scope = 'change_retrieval'")
    modes = benchmark.rankings(chunks, scope)
    version = {r.n: r.version for r in chunks.collect()}
    seen = [r for r in modes["hybrid_version_filtered"].filter("query_id = 'q4'").collect()]
    assert seen and all(version[r.item_id] in (None, "1.5.0") for r in seen) and sorted(r.rank for r in seen) == list(range(1, len(seen) + 1))
    assert {version[r.item_id] for r in modes["hybrid"].filter("query_id = 'q4'").collect()} > {"2.0.0"}
    assert all(version[r.item_id] is None for r in modes["hybrid_version_filtered"].filter("query_id = 'q5'").collect())  # since 3.0
    ablated = benchmark.ablation(chunks, scope)
    assert list(ablated) == ["rrf_1_1", "rrf_dense2_sparse1", "rrf_dense1_sparse2", "hybrid_reranked"]
    order = lambda df: [(r.query_id, r.item_id) for r in df.orderBy("query_id", "rank").collect()]
    assert order(ablated["rrf_1_1"]) == order(modes["hybrid"])
    results = benchmark.scored(chunks, tables["evidence_links"], scope, ablated)
    assert evaluate.summary(results, "mode").count() == 4 and results.filter("recall_at_5 < 0 or recall_at_5 > 1").count() == 0
    pool = {(r.query_id, r.item_id) for r in retrieve.hybrid(*benchmark.candidates(chunks, scope), retrieve.CANDIDATES).collect()}
    assert {(r.query_id, r.item_id) for r in ablated["hybrid_reranked"].collect()} <= pool


def test_any_retriever(spark):
    """Metrics of a function from texts to items."""
    gold = spark.createDataFrame([("q1", "b a", ["a"]), ("q2", "c", ["x"])], "query_id string, query_text string, required array<string>")
    rows = {r.query_id: r for r in evaluate.evaluated(gold.drop("query_text"), evaluate.listed_by(gold, str.split)).collect()}
    assert (rows["q1"].mrr, rows["q1"].recall_at_5, rows["q2"].mrr) == (0.5, 1.0, 0.0)


def test_reports(spark, built, gold, tmp_path):
    _, tables = built
    chunks, scope = tables["numbered"], gold.filter("evaluation_scope = 'change_retrieval'")
    modes = benchmark.rankings(chunks, scope)
    results = benchmark.scored(chunks, tables["evidence_links"], scope, modes).withColumnRenamed("mode", "retrieval_mode")
    sources.write_csv(results.select("retrieval_mode", "query_id", "recall_at_5", "recall_at_10", "mrr"), str(tmp_path / "csv"))
    back = sources.read_csv(spark, str(tmp_path / "csv"), "retrieval_mode string, query_id string, recall_at_5 double, recall_at_10 double, mrr double")
    assert back.count() == 20 and len(list((tmp_path / "csv").glob("part*.csv"))) == 1
    want = {r.query_id for r in results.filter("retrieval_mode = 'hybrid' and recall_at_5 < 1").collect()}
    assert {r.query_id for r in evaluate.failing(back).collect()} == want
    mapping = chunks.filter("evidence_id is not null").join(tables["evidence_links"], "evidence_id").select(F.col("n").alias("item_id"), F.col("change_id").alias("item"))
    told = evaluate.diagnosis({"sparse": modes["sparse"]}, mapping, scope.select("query_id", F.col("required_change_ids").alias("required"))).collect()
    assert len(told) == 6 and all((r["rank"] is not None and r["rank"] <= 5) == r.within_5 for r in told)
    text = {r.query_type: r.text for r in benchmark.checklist(gold, tables["change_records"], tables["evidence_links"], chunks).collect()}
    assert "Client.open REPLACEMENT" in text["multi_change"] and "> " in text["exact_symbol"] and "NOT FOUND" in text["negative"]


@pytest.mark.parametrize("cells", [0, retrieve.DENSE_CELLS])
def test_bm25_by_joins(spark, monkeypatch, cells):
    monkeypatch.setattr(retrieve, "DENSE_CELLS", cells)
    docs = spark.createDataFrame([(i, f"words {i % 7} here and {'there ' * (i % 3)}") for i in range(60)], "item_id long, text string")
    asked = spark.createDataFrame([("a", "words 3 there there"), ("b", "none of it"), ("c", "")], "query_id string, text string")
    one, two = (sorted(map(tuple, f(docs, asked, 7).collect())) for f in (retrieve.bm25, retrieve.by_postings))
    assert one == two == sorted(map(tuple, retrieve.bm25(docs, asked, 7, most_terms=0).collect())) and len(one) == 7


def test_depths(spark):
    docs = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    vectors_ = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "item_id long, embedding array<double>")
    asked = spark.createDataFrame([("q", "a", [1.0, 0.1])], "query_id string, text string, embedding array<double>")
    for bad in ((-1, 40), (5, 0), (50, 40)):
        for call in (lambda b: retrieve.retrieve_sparse(docs, asked, *b), lambda b: retrieve.retrieve_dense(vectors_, asked, *b)):
            with pytest.raises(ValueError):
                call(bad)
    assert retrieve.retrieve_sparse(docs, asked, 0).count() == 0
    assert [r.item_id for r in retrieve.retrieve_dense(vectors_, asked, 1).collect()] == [1]


def test_nearest_ties(spark):
    """Equal distances go by id, also in batches with more rows than are kept."""
    rng = np.random.default_rng(1)
    points = rng.integers(0, 3, (500, 2)).astype(float)
    rows = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "item_id long, embedding array<double>").coalesce(1)
    asked = spark.createDataFrame([("q", [1.0, 1.0]), ("r", [0.2, 2.0])], "query_id string, embedding array<double>")
    got = {(r.query_id, r["rank"]): r.item_id for r in retrieve.dense(rows, asked, 30).collect()}
    for q, at in (("q", [1.0, 1.0]), ("r", [0.2, 2.0])):
        far = ((points - at) ** 2).sum(1).round(6)
        assert [got[q, k + 1] for k in range(30)] == sorted(range(500), key=lambda i: (far[i], i))[:30]


def test_store(spark, tmp_path):
    held = store.Store(spark, str(tmp_path)).init().init()
    change = {"change_id": "c1", "symbol_name": "A.b", "symbol_package": "p", "symbol_kind": "method", "version_from": None, "version_to": "2.0", "change_type": "REMOVED", "summary": "s", "external_refs": ["#1"], "replacement_symbol": None, "parameters": [], "migration_action_text": None, "source_type": "RELEASE_NOTE", "source_document_id": "d", "raw_text": "r"}
    evidence = {"evidence_id": "e1", "source_type": "RELEASE_NOTE", "source_document_id": "d", "symbol_mentions": [{"name": "A.b", "package": "p", "kind": None}], "raw_text": "r", "external_refs": [], "embedding_id": None}
    link = {"evidence_id": "e1", "change_id": "c1", "link_type": "PRIMARY", "link_confidence": 1.0, "confidence_tier": "EXPLICIT", "link_method": "ORIGINATING", "provenance": "x", "review_status": "UNREVIEWED"}
    frame = lambda name, *rows: spark.createDataFrame([tuple(r[f.name] for f in store.schema(name).fields) for r in rows], store.schema(name))
    with pytest.raises(ValueError, match="is not in"):
        held.insert("evidence_links", frame("evidence_links", link))
    held.insert("change_records", frame("change_records", change, change | {"change_id": "c2", "version_to": None}, change | {"change_id": "c3", "version_to": "3.0"}))
    held.insert("evidence", frame("evidence", evidence))
    held.insert("evidence_links", frame("evidence_links", link))
    with pytest.raises(ValueError, match="repeated key"):
        held.insert("evidence", frame("evidence", evidence))
    loose = spark.createDataFrame([("e9", None, "d", None, "r", None, None)], "evidence_id string, source_type string, source_document_id string, symbol_mentions array<struct<name:string,package:string,kind:string>>, raw_text string, external_refs array<string>, embedding_id string")
    with pytest.raises(ValueError, match="null in"):
        held.insert("evidence", loose)
    got = held.get("change_records", change_id="c1")
    assert got.symbol.asDict() == {"name": "A.b", "package": "p", "kind": "method"} and got.external_refs == ["#1"]
    assert held.get("evidence", evidence_id="e1").symbol_mentions[0].name == "A.b" and held.get("evidence", evidence_id="none") is None
    assert held.links(change_id="c1").count() == held.links(evidence_id="e1").count() == 1 and held.links(change_id="c2").count() == 0
    assert {r.change_id for r in held.candidates("A.b", "p", "2.0").collect()} == {"c1", "c2"} and held.candidates("A.b", "p").count() == 3
    pair = lambda a, b, reason: frame("cannot_link_constraints", {"change_id_a": a, "change_id_b": b, "reason": reason, "provenance": "t", "created_by": "system"})
    held.insert_cannot_link(pair("c2", "c1", "first"))
    held.insert_cannot_link(pair("c1", "c2", "second"))
    assert held.get("cannot_link_constraints", change_id_a="c2", change_id_b="c1").reason == "second" and held.table("cannot_link_constraints").count() == 1
    assert held.get("cannot_link_constraints", change_id_a="c2", change_id_b="c3") is None
    text = held.table("change_records").withColumns({"external_refs": F.to_json("external_refs"), "parameters": F.to_json("parameters")})
    assert store.decoded(text, "change_records").filter("change_id = 'c1'").head().external_refs == ["#1"]


def test_collection(spark, tmp_path):
    held = vectors.Collection(spark, str(tmp_path), "chunks").create().create()
    rows = spark.createDataFrame([(0, "one", [1.0, 0.0], "foo", None, ["A.b", "c"]), (1, "two", [0.0, 1.0], None, "2.0", [])], "ord int, text string, embedding array<double>, package string, version string, symbols array<string>")
    held.add(rows, "sample.pdf")
    got = {r.collection_id: r for r in held.rows().collect()}
    assert set(got) == {"sample_pdf_chunk_0", "sample_pdf_chunk_1"} and held.count() == 2
    assert (got["sample_pdf_chunk_0"].symbols, got["sample_pdf_chunk_0"].version, got["sample_pdf_chunk_1"].package) == ("A.b,c", "", "")
    assert [r.document for r in held.rows(package="foo").collect()] == ["one"] and held.rows(package="bar").count() == 0
    with pytest.raises(ValueError):
        held.add(rows, "sample.pdf")
    held.add(rows.withColumn("key", F.concat(F.lit("x"), "ord")), ids="key")
    asked = spark.createDataFrame([("q", [0.9, 0.1])], "query_id string, embedding array<double>")
    assert [r.item_id for r in held.query(asked, 2).orderBy("rank").collect()] == ["sample_pdf_chunk_0", "x0"]
    assert [r.item_id for r in held.query(asked, 1, version="2.0").collect()] == ["sample_pdf_chunk_1"]
    assert held.reset().count() == 0


def test_models_are_loaded_once_a_process(spark):
    def load():
        import os

        return lambda texts: np.full((len(texts), 1), float(os.getpid()))

    embed = resolve.loaded("test-model", load)
    assert embed(["a"])[0, 0] == embed(["b"])[0, 0] and "test-model" in resolve.HELD
    items = spark.range(20).select("id", F.lit("x").alias("text"))
    assert len({r.embedding[0] for r in benchmark.embedded(items, embed, "id").collect()}) >= 1


def test_linker_settings():
    """A pair of types that is allowed is no veto, and versions part blocks."""
    import pandas as pd

    base = {"claim_idx": 0, "symbol_name": "A.b", "symbol_package": "p", "symbol_kind": None, "version_from": None, "version_to": "2.0", "summary": "A.b is gone", "replacement_symbol": None, "external_refs": []}
    rows = pd.DataFrame([base | {"doc_ord": 1, "evidence_id": "e1", "change_type": "REMOVED"}, base | {"doc_ord": 2, "evidence_id": "e2", "change_type": "DEPRECATED"}, base | {"doc_ord": 3, "evidence_id": "e3", "change_type": "REMOVED", "version_to": None}])
    strict = resolve.fold(resolve.hashed_embedder())(rows)
    assert (strict["kind"] == "change").sum() == 2 and set(strict["reason"].dropna()) == {"NON_OVERLAPPING_SEMANTICS"}
    loose = resolve.fold(resolve.hashed_embedder(), (("DEPRECATED", "REMOVED"),))(rows)
    assert (loose["kind"] == "change").sum() == 1 and loose.loc[loose["evidence_id"] == "e2", "link_confidence"].tolist() == [pytest.approx(0.85)]


def _pdf(pages: list[bytes], packed: bool) -> bytes:
    import zlib

    bodies = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(b"%d 0 R" % (3 + 2 * i) for i in range(len(pages))), len(pages))}
    for i, content in enumerate(pages):
        bodies[3 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (4 + 2 * i)
        data = zlib.compress(content) if packed else content
        bodies[4 + 2 * i] = b"<< /Length %d %s>>\nstream\n%s\nendstream" % (len(data), b"/Filter /FlateDecode " * packed, data)
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, b) for n, b in bodies.items()) + b"trailer << /Root 1 0 R >>\n%%EOF"


@pytest.mark.parametrize("packed", [False, True])
def test_pdf(spark, tmp_path, packed):
    contents = [b"BT /F1 12 Tf 10 700 Td (First \\(line\\)) Tj 0 -14 Td [(Sec) -20 (ond)] TJ T* (caf\\351) Tj ET", b"", b"BT <48692054686572 65> Tj (  ) ' ET"]
    (tmp_path / "a.pdf").write_bytes(_pdf(contents, packed))
    assert [r.line for r in sources.read_lines(spark, str(tmp_path / "a.pdf")).orderBy("line_no").collect()] == ["First (line)", "Second", "café", "Hi There"]
    with pytest.raises(ValueError):
        pdf.pages(b"no pdf")
