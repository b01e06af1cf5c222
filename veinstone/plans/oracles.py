"""SQL for the queries, in DuckDB's dialect, over the tables and without the engine's own columns."""

from __future__ import annotations

_NAME, _DIGIT, _TRIM = "[\\p{L}\\p{N}_]", "\\p{Nd}", "^[\\s\\x1c-\\x1f\\x85\\xa0]+|[\\s\\x1c-\\x1f\\x85\\xa0]+$"
_TOKEN = f"[A-Za-z_]{_NAME}*(?:[.:#]{{1,2}}[A-Za-z_]{_NAME}*)*|{_DIGIT}+(?:\\.{_DIGIT}+)*"


def _tokens(column: str) -> str:
    found = f"list_transform(regexp_extract_all({column}, '{_TOKEN}'), lambda t: lower(t))"
    return f"flatten(list_transform({found}, lambda t: CASE WHEN regexp_matches(t, '[.:#]') THEN list_concat([t], list_filter(string_split_regex(t, '[.:#]+'), lambda x: x <> '')) ELSE [t] END))"


_BM25 = f"""
WITH d AS (SELECT doc_id, {_tokens("text")} AS toks FROM documents),
n AS (SELECT count(*) AS n, CASE WHEN avg(len(toks)) = 0 THEN 1 ELSE avg(len(toks)) END AS avgdl FROM d),
q AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({_tokens("text")}) AS term FROM benchmark) GROUP BY ALL),
tf AS (SELECT doc_id, dl, term, count(*) AS f FROM (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT query_id, doc_id AS item_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN tf USING (term) JOIN df USING (term), n GROUP BY ALL),
bm25 AS (SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM s WHERE score > 0)
"""
_DENSE_ONLY = """
dv AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) AS vv FROM embeddings),
dd AS (SELECT a.vec_id // 100 AS query_id, b.vec_id AS item_id, round(greatest(a.vv + b.vv - 2 * list_inner_product(a.v, b.v), 0), 6) AS score FROM dv a, dv b WHERE a.vec_id % 100 = 0),
dense AS (SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score, item_id) AS rank FROM dd)
"""
_DENSE = "WITH " + _DENSE_ONLY
_BOTH = _BM25 + "," + _DENSE_ONLY


def _fused(sparse_weight: float = 1.0, dense_weight: float = 1.0) -> str:
    return f"""
parts AS (SELECT query_id, item_id, {dense_weight} / (60 + rank) AS part, rank AS dr, NULL AS sr FROM dense WHERE rank <= 40 UNION ALL SELECT query_id, item_id, {sparse_weight} / (60 + rank), NULL, rank FROM bm25 WHERE rank <= 40),
summed AS (SELECT query_id, item_id, round(sum(part), 9) AS score, min(dr) AS dr, min(sr) AS sr FROM parts GROUP BY ALL),
fused AS (SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dr NULLS LAST, sr) AS rank FROM summed)
"""


_ITEMS = """
items AS (SELECT item_id, CASE WHEN item_id % 4 <> 0 THEN 'p' || (item_id % 3) END AS package, CASE WHEN item_id % 7 <> 0 THEN [item_id % 5, item_id % 3] END AS v FROM (SELECT doc_id AS item_id FROM documents UNION SELECT vec_id FROM embeddings)),
wanted AS (SELECT item_id AS query_id, [item_id % 5, 0] AS low, CASE WHEN item_id % 2 = 0 THEN NULL ELSE [item_id % 5, 0] END AS high FROM benchmark)
"""
_MEETS = "(v IS NULL OR w.low IS NULL OR (v >= w.low AND (w.high IS NULL OR v <= w.high)))"

_NOTES = """
WITH p AS (SELECT p_partkey, p_size, regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g') AS brand, p_partkey % 4 AS m FROM part),
notes AS (SELECT *, 'item_' || p_partkey AS item, brand || '.item_' || p_partkey AS name,
  CASE m WHEN 0 THEN brand || '.item_' || p_partkey || '()' WHEN 1 THEN brand || '#item_' || p_partkey WHEN 2 THEN brand || '::item_' || p_partkey ELSE 'pkg.' || brand || '.item_' || p_partkey END AS spelled,
  ['REMOVED','DEPRECATED','RENAMED','BEHAVIOR_CHANGED','MOVED','SIGNATURE_CHANGED'][1 + p_partkey % 6] AS change_type,
  ['was removed','was deprecated','was renamed','now returns other values','was relocated','no longer accepts nulls'][1 + p_partkey % 6] AS verb,
  CASE m WHEN 0 THEN 'in v' || p_size || '.0' WHEN 1 THEN 'since ' || p_size || '.x' WHEN 2 THEN 'from ' || p_size || '.1 to ' || p_size || '.5.2' ELSE 'between ' || p_size || ' and 99' END AS said,
  CASE WHEN p_partkey % 3 = 0 THEN ' (#' || (p_partkey % 50) || ')' ELSE '' END AS ref FROM p)
"""
_V1 = "CASE m WHEN 0 THEN p_size || '.0' WHEN 1 THEN p_size::VARCHAR WHEN 2 THEN p_size || '.1' ELSE p_size::VARCHAR END"
_V2 = "CASE m WHEN 2 THEN p_size || '.5.2' WHEN 3 THEN '99' END"

_CLAIMS = """
WITH c AS (SELECT p_partkey AS k, regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g') AS brand, regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g') || '.' || p_size AS symbol,
  CASE WHEN p_partkey % 3 = 0 THEN (p_partkey % 7) || '.0' END AS vf, CASE WHEN p_partkey % 2 = 0 THEN (p_partkey % 5) || '.0' END AS vt,
  CASE WHEN p_partkey % 11 % 2 = 0 THEN 'REMOVED' ELSE 'MOVED' END AS ct, CASE WHEN p_partkey % 4 = 0 THEN '#' || (p_partkey % 3) END AS r FROM part),
pairs AS (SELECT a.k AS a_key, b.k AS b_key, a.vf AS avf, b.vf AS bvf, a.vt AS avt, b.vt AS bvt, a.ct AS act, b.ct AS bct, a.r AS ar, b.r AS br
  FROM (SELECT k, lag(k) OVER (PARTITION BY symbol ORDER BY k) AS before FROM c) l JOIN c b ON b.k = l.k JOIN c a ON a.k = l.before),
judged AS (SELECT *, CASE WHEN ar <> br THEN 'EXPLICIT_DIFFERENT_REFERENCES' WHEN avf <> bvf AND avt <> bvt THEN 'INCOMPATIBLE_VERSION_TRANSITION' WHEN act <> bct THEN 'NON_OVERLAPPING_SEMANTICS' WHEN avt <> bvt THEN 'SEPARATE_RELEASE_EVENTS' END AS reason FROM pairs)
"""

_GOLD = "gold AS (SELECT q.vec_id // 100 AS query_id, q.label, list(o.vec_id) AS required FROM embeddings q JOIN embeddings o USING (label) WHERE q.vec_id % 100 = 0 GROUP BY ALL)"


def _measured(ranking: str) -> str:
    """Per query: label and metrics of a ranking's first ten."""
    return f"""(SELECT g.query_id, g.label, coalesce(h5, 0) / len(required) AS recall_at_5, coalesce(h10, 0) / len(required) AS recall_at_10, coalesce(1.0 / first, 0) AS mrr,
  coalesce(d5, 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, 1 + least(len(required), 5)) t(i)) AS ndcg_at_5, coalesce(d10, 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, 1 + least(len(required), 10)) t(i)) AS ndcg_at_10
  FROM gold g LEFT JOIN (SELECT r.query_id, count(*) FILTER (rank <= 5) AS h5, count(*) AS h10, min(rank) AS first, sum(1 / log2(rank + 1)) FILTER (rank <= 5) AS d5, sum(1 / log2(rank + 1)) AS d10
    FROM {ranking} r JOIN gold g2 ON r.query_id = g2.query_id AND list_contains(g2.required, r.item_id) WHERE rank <= 10 GROUP BY 1) m USING (query_id))"""


_METRICS = ("recall_at_5", "recall_at_10", "mrr", "ndcg_at_5", "ndcg_at_10")
_ROUNDED = ", ".join(f"round({m}, 6) AS {m}" for m in _METRICS)
_MEANS = ", ".join(f"coalesce(round(avg({m}), 6), 0.0) AS {m}" for m in _METRICS)
_MODES = " UNION ALL ".join(f"SELECT '{m}' AS mode, * FROM {_measured(t)}" for m, t in (("dense", "dense"), ("sparse", "bm25"), ("hybrid", "fused")))
_ALL_MODES = f"{_BOTH}, {_fused()}, {_GOLD}, modes AS ({_MODES})"

_LINES = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '{_TRIM}', '', 'g')), lambda x: x <> '')"
_GROUPS = f"chunks AS (SELECT doc_id, (pos - 1) // 5 AS idx, string_agg(line, ' ' ORDER BY pos) AS chunk FROM (SELECT doc_id, unnest({_LINES}) AS line, generate_subscripts({_LINES}, 1) AS pos FROM documents) GROUP BY ALL)"
_SENTENCES = "string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
_PARAGRAPHS = f"list_filter(list_transform(string_split_regex(replace(text, chr(10), chr(10) || ' ' || chr(10)), chr(10) || '\\s*' || chr(10)), lambda x: regexp_replace(x, '{_TRIM}', '', 'g')), lambda x: x <> '')"

_KIND = "['RELEASE_NOTE','MIGRATION_GUIDE','OFFICIAL_DOCS','GITHUB_PR_ISSUE'][1 + doc_id % 4]"
_TOP = "SELECT query_id, item_id, score, rank::INTEGER AS rank FROM"

_HARD_GOLD = "hg AS (SELECT a.query_id, CASE a.query_id % 5 WHEN 0 THEN [a.item_id] WHEN 1 THEN [b.item_id] WHEN 2 THEN [a.item_id, b.item_id] WHEN 3 THEN [-1] ELSE [e.item_id] END AS required FROM dense a JOIN bm25 b ON b.query_id = a.query_id AND b.rank = 1 JOIN dense e ON e.query_id = a.query_id AND e.rank = 8 WHERE a.rank = 1)"


def _hard_modes(modes) -> str:
    """Metrics of rankings against the hard gold, with repeats in it counted."""
    dcg = lambda k: f"coalesce(list_sum(list_transform(list_filter(found, lambda x: x.rank <= {k} AND list_contains(required, x.item_id)), lambda x: 1 / log2(x.rank + 1))), 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, 1 + least(len(list_distinct(required)), {k})) t(i))"
    recall = lambda k: f"len(list_filter(required, lambda r: list_contains(list_transform(list_filter(found, lambda x: x.rank <= {k}), lambda x: x.item_id), r))) / len(required)"
    mrr = "coalesce(1 / list_min(list_transform(list_filter(found, lambda x: list_contains(required, x.item_id)), lambda x: x.rank)), 0)"
    one = lambda mode, ranking: f"SELECT '{mode}' AS mode, query_id, {recall(5)} AS recall_at_5, {recall(10)} AS recall_at_10, {mrr} AS mrr, {dcg(5)} AS ndcg_at_5, {dcg(10)} AS ndcg_at_10 FROM hg JOIN (SELECT query_id, list({{'item_id': item_id, 'rank': rank}}) AS found FROM {ranking} WHERE rank <= 10 GROUP BY query_id) USING (query_id)"
    return " UNION ALL ".join(one(*m) for m in modes)


_HARD = f"{_BOTH}, {_fused()}, {_HARD_GOLD}, hard AS ({_hard_modes((('dense', 'dense'), ('sparse', 'bm25'), ('hybrid', 'fused')))})"

_PHRASES = [("no longer accepts nulls", "SIGNATURE_CHANGED"), ("will no longer accept nulls", "SIGNATURE_CHANGED"), ("now requires a key", "SIGNATURE_CHANGED"), ("has a new parameter", "SIGNATURE_CHANGED"), ("has a new required parameter", "SIGNATURE_CHANGED"), ("has a changed signature", "SIGNATURE_CHANGED"), ("now returns lists", "BEHAVIOR_CHANGED"), ("now throws errors", "BEHAVIOR_CHANGED"), ("behavior changed", "BEHAVIOR_CHANGED"), ("behavior has changed", "BEHAVIOR_CHANGED"), ("was moved to another place", "MOVED"), ("was relocated", "MOVED"), ("is deprecated", "DEPRECATED"), ("was renamed", "RENAMED"), ("is now called otherwise", "RENAMED"), ("is now named otherwise", "RENAMED"), ("was removed", "REMOVED"), ("is no longer there", "BEHAVIOR_CHANGED")]
_REPLACED = ["'`Old.a_' || k || '()` was replaced by `New.b_' || k || '()`'", "'`Old.a_' || k || '` is deprecated in favor of `New.b_' || k || '`'", "'use `New.b_' || k || '` instead of `Old.a_' || k || '`'", "'`Old.a_' || k || '()` was moved to `New.b_' || k || '()`'"]
_OWN_REFS = ["' PR #' || k", "' GH-' || k", "' issue #' || k", "' (#' || k || ')'", "''"]
_listed = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_VARIED = f"""{_NOTES}, v AS (SELECT *, p_partkey AS k, ['RELEASE_NOTE','MIGRATION_GUIDE','OFFICIAL_DOCS','GITHUB_PR_ISSUE'][1 + m] AS source_type, CASE p_partkey % 3 WHEN 0 THEN p_size || '.0.0' WHEN 1 THEN p_size || '.1' END AS ambient, CASE p_partkey % 3 WHEN 0 THEN '## v' || p_size || '.0.0' WHEN 1 THEN '# Release ' || p_size || '.1' END AS head,
  {_listed(t for _, t in _PHRASES)}[1 + p_partkey % {len(_PHRASES)}] AS type1, {_listed(p for p, _ in _PHRASES)}[1 + p_partkey % {len(_PHRASES)}] AS phrase, CASE WHEN m = 3 THEN 'PR#' || p_partkey ELSE '' END AS more, CASE WHEN p_partkey % 5 = 4 THEN '' ELSE '#' || p_partkey END AS own FROM notes),
v2 AS (SELECT *, '`' || spelled || '` ' || phrase || ' with the `size_' || k || '` parameter' || [{", ".join(_OWN_REFS)}][1 + k % 5] || '.' AS b1, [{", ".join(_REPLACED)}][1 + k % 4] || CASE WHEN k % 2 = 0 THEN '; call the new one instead' ELSE '' END || '.' AS b2, 'Plain words about `' || name || '` only.' AS b3, 'The `Other.item_' || k || '()` call was removed. Nothing else.' AS b4 FROM v),
said AS (SELECT p_partkey, 0::BIGINT AS claim_idx, name AS symbol_name, CASE WHEN m IN (0, 1) THEN 'method' END AS symbol_kind, type1 AS change_type, ambient AS version_to, NULL AS replacement_symbol, CASE WHEN type1 = 'SIGNATURE_CHANGED' THEN 'size_' || k ELSE '' END AS parameters, NULL AS migration_action_text, own, more, 'change_keyword' AS rule, source_type FROM v
UNION ALL SELECT p_partkey, 1, 'Old.a_' || k, CASE WHEN k % 4 IN (0, 3) THEN 'method' END, ['REPLACEMENT','DEPRECATED','DEPRECATED','MOVED'][1 + k % 4], ambient, 'New.b_' || k, '', CASE WHEN k % 2 = 0 THEN 'call the new one instead' END, '', more, 'replacement_pattern', source_type FROM v
UNION ALL SELECT p_partkey, 2, 'Other.item_' || k, 'method', 'REMOVED', '9.9', NULL, '', NULL, '', more, 'change_keyword', source_type FROM v)"""
_SYMBOLS = "name || ',New.b_' || k || ',Old.a_' || k"
_PROVENANCE = "['release note','migration guide','official docs','github pr/issue PR#' || k][1 + m] || ' (local://' || k || ')'"
_VARIED_CHUNKS = f""", pieces AS (SELECT k, m, unnest(CASE WHEN m < 3 THEN [{{'t': b1, 'v': ambient, 's': name}}, {{'t': b2, 'v': ambient, 's': 'New.b_' || k || ',Old.a_' || k}}, {{'t': b3, 'v': ambient, 's': name}}, {{'t': b4, 'v': '9.9', 's': 'Other.item_' || k}}]
  ELSE list_concat(CASE WHEN head IS NULL THEN [] ELSE [{{'t': head, 'v': ambient, 's': ''}}] END, [{{'t': '- ' || b1 || chr(10) || '* ' || b2 || chr(10) || '- ' || b3, 'v': NULL, 's': {_SYMBOLS}}}, {{'t': '### 9.9 notes', 'v': '9.9', 's': ''}}, {{'t': b4, 'v': NULL, 's': 'Other.item_' || k}}]) END) AS p,
  unnest(range(CASE WHEN m = 3 AND head IS NULL THEN 3 ELSE 4 END)) AS idx FROM v2)
SELECT k AS p_partkey, idx, p.t AS chunk, p.v AS version, p.s AS symbols, {_PROVENANCE} AS provenance FROM pieces"""

#: The linker's fold: a list of the block's changes grows claim by claim.
_FOLDED = f"""{_CLAIMS.replace("WITH c AS", "WITH RECURSIVE c AS")}, o AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY k) AS i, k % 5 = 0 AS blank, 'ev_' || k AS ev, 'chg_' || substr(sha256(symbol || '|pkg|' || coalesce(vt, '') || '|' || ct || '|ev_' || k), 1, 16) AS chg FROM c),
f AS (SELECT symbol, i, [{{'chg': chg, 'vt': vt, 'ct': ct, 'r': r, 'blank': blank}}] AS held, []::STRUCT(chg VARCHAR, vt VARCHAR, ct VARCHAR, r VARCHAR, blank BOOLEAN)[] AS before FROM o WHERE i = 1
UNION ALL SELECT o.symbol, o.i, CASE WHEN len(list_filter(f.held, lambda x: (x.vt IS NULL OR o.vt IS NULL OR x.vt = o.vt) AND NOT coalesce(x.r <> o.r, false) AND x.ct = o.ct)) = 0 THEN list_append(f.held, {{'chg': o.chg, 'vt': o.vt, 'ct': o.ct, 'r': o.r, 'blank': o.blank}}) ELSE f.held END, f.held FROM f JOIN o ON o.symbol = f.symbol AND o.i = f.i + 1),
met AS (SELECT o.*, list_filter(f.before, lambda x: (x.vt IS NULL OR o.vt IS NULL OR x.vt = o.vt)) AS cands FROM o JOIN f USING (symbol, i)),
told AS (SELECT *, list_filter(cands, lambda x: NOT coalesce(x.r <> met.r, false) AND x.ct = met.ct) AS fit, list_filter(cands, lambda x: coalesce(x.r <> met.r, false) OR x.ct <> met.ct) AS vetoed FROM met),
sorted AS (SELECT *, list_filter(fit, lambda x: coalesce(x.r = told.r, false) OR NOT (x.blank OR told.blank)) AS sure FROM told),
settled AS (SELECT *, CASE WHEN len(fit) = 0 THEN chg WHEN len(fit) = 1 AND len(sure) = 1 THEN sure[1].chg END AS own FROM sorted),
rows AS (SELECT 'change' AS kind, ev AS evidence_id, chg AS change_id, NULL::VARCHAR AS link_type, NULL::VARCHAR AS confidence_tier, NULL::VARCHAR AS review_status, NULL::VARCHAR AS other_change_id, NULL::VARCHAR AS reason FROM settled WHERE len(fit) = 0
UNION ALL SELECT 'link', ev, chg, 'PRIMARY', 'EXPLICIT', 'UNREVIEWED', NULL, NULL FROM settled WHERE len(fit) = 0
UNION ALL SELECT 'link', ev, x.chg, 'SUPPORTING', CASE WHEN coalesce(x.r = r, false) THEN 'EXPLICIT' WHEN x.blank OR blank THEN 'AMBIGUOUS' ELSE 'INFERRED_HIGH_CONFIDENCE' END, CASE WHEN own IS NULL THEN 'NEEDS_REVIEW' ELSE 'UNREVIEWED' END, NULL, NULL FROM (SELECT *, unnest(fit) AS x FROM settled)
UNION ALL SELECT 'cannot_link', NULL, least(own, x.chg), NULL, NULL, NULL, greatest(own, x.chg), CASE WHEN coalesce(x.r <> r, false) THEN 'EXPLICIT_DIFFERENT_REFERENCES' ELSE 'NON_OVERLAPPING_SEMANTICS' END FROM (SELECT *, unnest(vetoed) AS x FROM settled WHERE own IS NOT NULL) WHERE x.chg <> own)
"""

ORACLES = {
    "bm25_topk": f"{_BM25} {_TOP} bm25 WHERE rank <= 10",
    "term_stats": f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({_tokens('text')}) AS term FROM documents) GROUP BY term",
    "doc_stats": f"SELECT doc_id, len({_tokens('text')}) AS dl FROM documents",
    "fixed_line_chunks": f"WITH {_GROUPS} SELECT doc_id, idx, chunk FROM chunks",
    "sentence_split": f"SELECT doc_id, unnest({_SENTENCES}) AS sentence, generate_subscripts({_SENTENCES}, 1) - 1 AS idx FROM documents",
    "paragraph_chunks": f"SELECT doc_id, unnest({_PARAGRAPHS}) AS paragraph, generate_subscripts({_PARAGRAPHS}, 1) - 1 AS idx FROM documents",
    "content_ids": "WITH a AS (SELECT doc_id, text, 'doc_' || substr(sha256('OFFICIAL_DOCS||' || substr(text, 1, 200)), 1, 16) AS document_id FROM documents) SELECT doc_id, document_id, 'chunk_' || substr(sha256(document_id || '|0|' || substr(text, 1, 100)), 1, 16) AS chunk_id, 'ev_' || substr(sha256(document_id || '|0|' || substr(text, 1, 100)), 1, 16) AS evidence_id FROM a",
    "source_documents": f"WITH a AS (SELECT doc_id, text, {_KIND} AS source_type, CASE WHEN doc_id % 3 <> 0 THEN 'local://' || doc_id END AS url, CASE WHEN doc_id % 5 <> 0 AND doc_id % 4 = 3 THEN 'PR#' || doc_id END AS ref FROM documents) SELECT doc_id, 'doc_' || substr(sha256(source_type || '|' || coalesce(url, '') || '|' || substr(text, 1, 200)), 1, 16) AS document_id, source_type, ['release note','migration guide','official docs','github pr/issue'][1 + doc_id % 4] || coalesce(' ' || ref, '') || coalesce(' (' || url || ')', '') AS provenance, coalesce(ref, '') AS refs FROM a",
    "symbol_normalize": f"{_NOTES} SELECT p_partkey, name, 'pkg' AS package, CASE WHEN m IN (0, 1) THEN 'method' END AS kind FROM notes",
    "symbol_mentions": f"{_NOTES} SELECT p_partkey, 1::BIGINT AS n, spelled AS raw, 0::BIGINT AS start_at, name, CASE WHEN m IN (0, 1) THEN 'method' END AS kind FROM notes",
    "version_mentions": f"{_NOTES} SELECT p_partkey, 1::BIGINT AS n, {_V1} AS normalized, {_V2} AS normalized_end, CASE m WHEN 0 THEN 'EXACT' WHEN 1 THEN 'SINCE' ELSE 'RANGE' END AS qualifier, CASE WHEN m IN (0, 2) THEN 'MINOR' ELSE 'MAJOR' END AS precision FROM notes",
    "version_overlap": "WITH p AS (SELECT p_partkey, p_size AS s FROM part) SELECT p_partkey, 'exact' AS asked, s = 10 AS meets FROM p UNION ALL SELECT p_partkey, 'since', s >= 25 FROM p UNION ALL SELECT p_partkey, 'range', s > 5 AND s <= 12 FROM p UNION ALL SELECT p_partkey, 'open', s > 40 FROM p",
    "change_type_classify": f"{_NOTES} SELECT p_partkey, change_type FROM notes",
    "extract_claims": f"{_NOTES} SELECT p_partkey, name AS symbol_name, CASE m WHEN 0 THEN NULL ELSE {_V1} END AS version_from, CASE m WHEN 0 THEN {_V1} ELSE {_V2} END AS version_to, change_type, CASE WHEN p_partkey % 3 = 0 THEN '#' || (p_partkey % 50) ELSE '' END AS refs, 'EXPLICIT' AS extraction_confidence, 'regex:change_keyword+inline_version' AS extraction_method FROM notes",
    "conjunction_claims": f"{_NOTES} SELECT p_partkey, 0::BIGINT AS claim_idx, name AS symbol_name, CASE WHEN p_partkey % 2 = 0 THEN p_size || '.0.0' END AS version_to, 'REMOVED' AS change_type, '`' || name || '` was removed' AS summary FROM notes UNION ALL SELECT p_partkey, 1, 'other.' || item, CASE WHEN p_partkey % 2 = 0 THEN p_size || '.0.0' END, 'RENAMED', '`other.' || item || '` was renamed.' FROM notes",
    "replacement_claims": f"{_NOTES} SELECT p_partkey, name AS symbol_name, 'method' AS symbol_kind, 'REPLACEMENT' AS change_type, 'New.' || item AS replacement_symbol, 'use dicts instead' AS migration_action_text, CASE WHEN p_partkey % 2 = 0 THEN p_size || '.0.0' END AS version_to FROM notes",
    "section_bullet_chunks": f"{_NOTES} SELECT p_partkey, 0::BIGINT AS idx, '`' || spelled || '` ' || verb || ' ' || said || ref || '.' AS chunk, {_V1} AS version, name AS symbols FROM notes",
    "extract_claims_varied": f"{_VARIED} SELECT p_partkey, claim_idx, symbol_name, symbol_kind, change_type, version_to, replacement_symbol, parameters, migration_action_text, array_to_string(list_filter([own, more], lambda x: x <> ''), ',') AS refs, 'regex:' || rule || CASE WHEN version_to IS NULL THEN '+no_version' ELSE '+ambient_version' END AS extraction_method, source_type FROM said",
    "chunks_varied": f"{_VARIED} {_VARIED_CHUNKS}",
    "symbol_mentions_all": f"{_NOTES} SELECT p_partkey, 0::BIGINT AS idx, spelled AS raw, name, CASE WHEN m IN (0, 1) THEN 'method' END AS kind FROM notes UNION ALL SELECT p_partkey, 1, 'Api.call_' || p_partkey || '()', 'Api.call_' || p_partkey, 'method' FROM notes UNION ALL SELECT p_partkey, 2, 'run_' || p_partkey || '()', 'run_' || p_partkey, 'method' FROM notes",
    "version_mentions_all": f"{_NOTES} SELECT p_partkey, 0::BIGINT AS idx, {_V1} AS normalized, {_V2} AS normalized_end, CASE m WHEN 0 THEN 'EXACT' WHEN 1 THEN 'SINCE' ELSE 'RANGE' END AS qualifier, CASE WHEN m IN (0, 2) THEN 'MINOR' ELSE 'MAJOR' END AS precision FROM notes UNION ALL SELECT p_partkey, 1, '3.' || (p_partkey % 7), '4.0', 'RANGE', 'MINOR' FROM notes UNION ALL SELECT p_partkey, 2, (p_partkey % 9) || '.1.2', NULL, 'EXACT', 'PATCH' FROM notes",
    "pipeline_statistics": 'SELECT unnest([\'documents\', \'chunks\', \'unresolved_changes\', \'chunks_with_evidence\', \'change_records\', \'evidence_links\', \'cannot_link_constraints\']) AS "table", unnest([n, n, n, n, n, n, 0]) AS n FROM (SELECT count(*) AS n FROM part)',
    "cannot_link_pairs": f"{_CLAIMS} SELECT a_key, b_key, reason FROM judged",
    "pairwise_score": f"""{_CLAIMS}, scored AS (SELECT j.*, round(0.35 + CASE WHEN avt <> bvt THEN 0 ELSE 0.25 END + CASE WHEN act = bct THEN 0.15 ELSE 0 END + 0.25 * list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) AS total FROM (SELECT *, coalesce(avt <> bvt, false) AS apart FROM judged) j JOIN embeddings x ON x.vec_id = a_key % (SELECT count(*) FROM embeddings) JOIN embeddings y ON y.vec_id = b_key % (SELECT count(*) FROM embeddings))
SELECT a_key, b_key, total, CASE WHEN reason IS NOT NULL THEN 'NO_MATCH' WHEN ar = br THEN 'MATCH_EXPLICIT' WHEN total >= 0.85 THEN 'MATCH_INFERRED' WHEN total >= 0.55 THEN 'AMBIGUOUS' ELSE 'NO_MATCH' END AS decision, CASE WHEN reason IS NULL AND ar = br THEN 'EXPLICIT_REFERENCE' ELSE 'PAIRWISE_RESOLUTION' END AS method, CASE WHEN reason IS NOT NULL THEN 0.0 WHEN ar = br THEN 1.0 ELSE total END AS score FROM scored""",
    "link_evidence": f"{_CLAIMS}, f AS (SELECT brand, min(k) AS first FROM c GROUP BY brand) SELECT 'ev_' || k AS evidence_id, 'chg_' || substr(sha256(brand || '|pkg||REMOVED|ev_' || first), 1, 16) AS change_id, CASE WHEN k = first THEN 'PRIMARY' ELSE 'SUPPORTING' END AS link_type, CASE WHEN k = first THEN 'EXPLICIT' ELSE 'INFERRED_HIGH_CONFIDENCE' END AS confidence_tier, CASE WHEN k = first THEN 'ORIGINATING' ELSE 'PAIRWISE_RESOLUTION' END AS link_method, 'UNREVIEWED' AS review_status, 1.0::DOUBLE AS link_confidence FROM c JOIN f USING (brand)",
    "link_evidence_general": f"{_FOLDED} SELECT kind, evidence_id, change_id, link_type, confidence_tier, review_status, other_change_id, reason FROM rows",
    "stream_event_link": f"{_FOLDED} SELECT link_type, review_status, count(*) AS n FROM rows WHERE kind = 'link' GROUP BY ALL",
    "blocking_candidates": f"{_CLAIMS}, f AS (SELECT symbol, vt, min(k) AS record FROM c GROUP BY ALL) SELECT k AS doc_ord, record FROM c JOIN f USING (symbol) WHERE c.vt IS NULL OR f.vt IS NULL OR c.vt = f.vt",
    "cannot_link_upsert": "WITH r AS (SELECT least(o_custkey % 50, o_orderkey % 41) AS x, greatest(o_custkey % 50, o_orderkey % 41) AS y, o_orderpriority AS reason, o_orderkey AS seq FROM orders) SELECT x, y, reason, seq FROM r QUALIFY row_number() OVER (PARTITION BY x, y ORDER BY seq DESC) = 1",
    "store_integrity": "SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 2 = 0) GROUP BY l_partkey",
    "store_absent": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0)",
    "repeated_keys": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1",
    "owning_chunk_lines": f"WITH {_GROUPS}, l AS (SELECT doc_id, unnest({_LINES}) AS line, generate_subscripts({_LINES}, 1) - 1 AS claim_idx FROM documents) SELECT doc_id, claim_idx, doc_id || '_' || idx AS chunk_id FROM l JOIN chunks USING (doc_id) WHERE contains(chunk, line) OR contains(line, chunk) QUALIFY row_number() OVER (PARTITION BY doc_id, claim_idx ORDER BY CASE WHEN chunk = line THEN 0 ELSE 1 END, idx) = 1",
    "decode_records": f"{_NOTES} SELECT 'chg_' || p_partkey AS change_id, name, 'pkg' AS package, CASE WHEN p_partkey % 2 = 0 THEN 'method' END AS kind, '#' || (p_partkey % 7) || '|q\"\\' AS refs, CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 0 END::BIGINT AS n_parameters FROM notes",
    "links_of_change": "SELECT l_orderkey AS evidence_id, l_partkey AS change_id, l_linenumber, 'change' AS asked FROM lineitem WHERE l_partkey = 7 UNION ALL SELECT l_orderkey, l_partkey, l_linenumber, 'evidence' FROM lineitem WHERE l_orderkey = 7",
    "vector_metadata": "SELECT doc_id, 'notes_v1_md_chunk_' || doc_id AS id, 'doc_' || doc_id AS source_document_id, 'RELEASE_NOTE' AS source_type, CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'p' || (doc_id % 3) END AS package, CASE WHEN doc_id % 3 = 0 THEN '' ELSE (doc_id % 5) || '.0' END AS version, 'A.b,C.' || coalesce(lang, '') AS symbols, '' AS evidence_id FROM documents WHERE (doc_id % 4 <> 0 AND doc_id % 3 = 1 AND doc_id % 3 = 0) OR doc_id % 4 = 0",
    "gold_set": f"{_CLAIMS}, last AS (SELECT brand, symbol, max(k) AS k FROM c GROUP BY ALL) SELECT brand AS query_id, string_agg('chg_' || lpad(k::VARCHAR, 9, '0'), ',' ORDER BY symbol) AS changes, string_agg(CASE WHEN ('ev_' || k) < ('ev_b' || k) THEN 'ev_' || k || ',ev_b' || k ELSE 'ev_b' || k || ',ev_' || k END, ',' ORDER BY symbol) AS evidence, 0::BIGINT AS n_stable FROM last GROUP BY brand",
    "link_labels": "SELECT p_partkey, ['Confirmed by explicit reference','Likely the same change','Possibly related — needs review'][1 + p_partkey % 3] || ['',' (needs human review before use)',' (confirmed by a reviewer)',' (rejected by a reviewer)'][1 + p_partkey % 4] AS label FROM part",
    "dense_topk": f"{_DENSE} {_TOP} dense WHERE rank <= 10",
    "sparse_filtered": f"{_BM25}, {_ITEMS} SELECT query_id, item_id, score, rank::INTEGER AS rank FROM (SELECT b.query_id, b.item_id, score, row_number() OVER (PARTITION BY b.query_id ORDER BY rank) AS rank FROM bm25 b JOIN items USING (item_id) JOIN wanted w USING (query_id) WHERE rank <= 40 AND (package IS NULL OR package = 'p1') AND {_MEETS}) WHERE rank <= 10",
    "dense_filtered": f"{_DENSE}, {_ITEMS} SELECT query_id, item_id, score, rank::INTEGER AS rank FROM (SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM dense JOIN items USING (item_id) WHERE rank <= 40 AND (package IS NULL OR package = 'p2')) WHERE rank <= 10",
    "rrf_fuse": f"{_BOTH}, {_fused()} {_TOP} fused",
    "rrf_weighted": f"{_BOTH}, {_fused(1.0, 2.0)} {_TOP} fused",
    "hybrid_topk": f"{_BOTH}, {_fused()} {_TOP} fused WHERE rank <= 10",
    "hybrid_version_filtered": f"{_BOTH}, {_fused()}, {_ITEMS} SELECT query_id, item_id, score, rank::INTEGER AS rank FROM (SELECT f.query_id, f.item_id, score, row_number() OVER (PARTITION BY f.query_id ORDER BY rank) AS rank FROM fused f JOIN items USING (item_id) LEFT JOIN wanted w USING (query_id) WHERE {_MEETS}) WHERE rank <= 10",
    "rerank_stub": f"{_BM25}, t AS (SELECT item_id AS query_id, list_distinct({_tokens('text')}) AS qt FROM benchmark), r AS (SELECT query_id, item_id, rank AS was, round(len(list_intersect(qt, toks)) / len(qt), 6) AS score, len(list_intersect(qt, toks)) / len(qt) AS raw FROM bm25 JOIN t USING (query_id) JOIN d ON doc_id = item_id WHERE rank <= 40) SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, was)::INTEGER AS rank FROM r QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, was) <= 10",
    "prompt_render": f"{_BM25}, x AS (SELECT query_id, string_agg(text, chr(10) ORDER BY rank) AS context FROM bm25 JOIN documents ON doc_id = item_id WHERE rank <= 5 GROUP BY query_id) SELECT query_id, sha256(chr(10) || '    Answer the question using only the provided context.' || chr(10) || '    If the answer cannot be found in the context, say that you do not have enough information.' || chr(10) || '    Context:' || chr(10) || '    ' || context || chr(10) || '    Question:' || chr(10) || '    ' || text || chr(10) || '    Answer:' || chr(10) || '    ') AS prompt_sha256 FROM x JOIN benchmark ON item_id = query_id",
    "eval_metrics": f"{_DENSE}, {_GOLD} SELECT query_id, {_ROUNDED} FROM {_measured('dense')}",
    "metrics_by_type": f"{_DENSE}, {_GOLD} SELECT label, count(*) AS n, {_MEANS} FROM {_measured('dense')} GROUP BY label",
    "aggregate_modes": f"{_ALL_MODES} SELECT mode, count(*) AS n, {_MEANS} FROM modes GROUP BY mode",
    "failure_quadrant": f"{_HARD}, w AS (SELECT query_id, max(recall_at_5) FILTER (mode = 'dense') >= 0.999 AS d, max(recall_at_5) FILTER (mode = 'sparse') >= 0.999 AS s, max(recall_at_5) FILTER (mode = 'hybrid') >= 0.999 AS h FROM hard GROUP BY query_id) SELECT query_id, 'dense_only_succeeds' AS quadrant FROM w WHERE d AND NOT s UNION ALL SELECT query_id, 'sparse_only_succeeds' FROM w WHERE s AND NOT d UNION ALL SELECT query_id, 'hybrid_fixes_both' FROM w WHERE h AND NOT d AND NOT s UNION ALL SELECT query_id, 'all_fail' FROM w WHERE NOT h AND NOT d AND NOT s",
    "failing_queries": f"{_HARD} SELECT query_id FROM hard WHERE mode = 'hybrid' AND recall_at_5 < 1",
    "diagnose_ranks": f"{_HARD}, asked AS (SELECT query_id, unnest(required) AS item FROM hg), ranks AS (SELECT 'dense' AS mode, query_id, item_id, rank FROM dense WHERE rank <= 40 UNION ALL SELECT 'sparse', query_id, item_id, rank FROM bm25 WHERE rank <= 40 UNION ALL SELECT 'hybrid', query_id, item_id, rank FROM fused WHERE rank <= 40) SELECT a.query_id, a.item, m.mode, r.rank::INTEGER AS rank, coalesce(r.rank <= 5, false) AS within_5, coalesce(r.rank <= 10, false) AS within_10, coalesce(r.rank <= 20, false) AS within_20 FROM asked a CROSS JOIN (SELECT unnest(['dense', 'sparse', 'hybrid']) AS mode) m LEFT JOIN ranks r ON r.mode = m.mode AND r.query_id = a.query_id AND r.item_id = a.item",
    "ablation_modes": f"{_HARD}, {_fused(1.0, 2.0).replace('parts', 'parts2').replace('summed', 'summed2').replace('fused', 'fused2')}, {_fused(2.0, 1.0).replace('parts', 'parts3').replace('summed', 'summed3').replace('fused', 'fused3')}, t AS (SELECT item_id AS query_id, list_distinct({_tokens('text')}) AS qt FROM benchmark), reranked AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY len(list_intersect(qt, toks)) / len(qt) DESC, rank) AS rank FROM fused JOIN t USING (query_id) JOIN d ON doc_id = item_id WHERE rank <= 40), modes AS ({_hard_modes((('rrf_1_1', 'fused'), ('rrf_dense2_sparse1', 'fused2'), ('rrf_dense1_sparse2', 'fused3'), ('hybrid_reranked', 'reranked')))}) SELECT mode, count(*) AS n, {_MEANS} FROM modes GROUP BY mode",
    "gold_counts": "SELECT 'query_type' AS kind, ['exact_symbol', 'negative', 'multi_change'][1 + item_id % 3] AS value, count(*) AS n FROM benchmark GROUP BY ALL UNION ALL SELECT 'evaluation_scope', CASE WHEN item_id % 3 = 1 THEN 'stability' ELSE 'change_retrieval' END, count(*) FROM benchmark GROUP BY ALL",
    "resolve_items": f"{_BM25}, f AS (SELECT query_id, source AS item, min(rank) AS r FROM bm25 JOIN documents ON doc_id = item_id WHERE rank <= 10 GROUP BY ALL) SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY r)::INTEGER AS rank FROM f",
    "rank_trace": f"{_DENSE}, {_GOLD}, h AS (SELECT g.query_id, min(rank) FILTER (rank <= 40 AND item_id % 100 <> 0 AND list_contains(required, item_id)) AS r FROM gold g LEFT JOIN dense USING (query_id) GROUP BY 1) SELECT query_id, r::INTEGER AS first_rank, coalesce(r <= 5, false) AS within_5, coalesce(r <= 10, false) AS within_10, coalesce(r <= 20, false) AS within_20 FROM h",
}
