"""The registry of this subpackage: queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import table
from .media import op8_media
from .mixing import op4_mixing, planned
from .near_dedup import op3_near_dedup
from .packing import LENGTH, op5_packing
from .pii import op2_pii
from .quality_classifier import op6_quality_classifier
from .quality_rules import BOILERPLATE, TERMINAL, op7_quality_rules
from .sharding import op9_sharding
from .url_graph import RULES, op1_url_graph
from .warc import op10_warc


# What SQL can say of the operators' results that it can't compute whole.


def url_rules(spark, sf_dir):
    """Hosts, paths, rules and the rules' verdicts."""
    out = op1_url_graph(spark, sf_dir)
    return out.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("said"))


def pii_counts(spark, sf_dir):
    """How many base spans of each kind there are."""
    return op2_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def mixing_targets(spark, sf_dir):
    """Size and target of every source, and whether what is taken of it is within 2 % and 100 words of it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    rows = planned(docs).join(docs.select("doc_id", "source"), "doc_id")
    near = F.abs(F.sum("taken") - F.first("target")) <= F.first("target") * 0.02 + 100
    return rows.groupBy("source").agg(F.first("source_size").alias("source_size"), F.round(F.first("target"), 3).alias("target"), near.alias("near"))


def packing_totals(spark, sf_dir):
    """Documents, and how many are cut with gaps, sequences with gaps, and sequences that are too long."""
    rows = op5_packing(spark, sf_dir)
    ends = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda by, order: F.coalesce(F.sum("length").over(ends(by, order)), F.lit(0))
    told = rows.withColumns({"a": before(["doc_id"], "start") != F.col("start"), "b": before(["sequence_id"], "offset") != F.col("offset"), "c": F.col("offset") + F.col("length") > LENGTH})
    one = lambda test: F.count_if(test).alias
    return told.agg(F.count_distinct("doc_id").alias("docs"), one(F.col("a"))("cut_gaps"), one(F.col("b"))("gaps"), one(F.col("c"))("too_long"))


def media_payloads(spark, sf_dir):
    return op8_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "media_bytes")


def sharding_places(spark, sf_dir):
    """Rows and places of every shard."""
    rows = op9_sharding(spark, sf_dir)
    return rows.groupBy("shard", "law").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("places"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"))

QUERIES = {
    "op1_url_graph": op1_url_graph,
    "op10_warc": op10_warc,
    "op2_pii": op2_pii,
    "op3_near_dedup": op3_near_dedup,
    "op4_mixing": op4_mixing,
    "op5_packing": op5_packing,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_quality_rules": op7_quality_rules,
    "op8_media": op8_media,
    "op9_sharding": op9_sharding,
    "url_rules": url_rules,
    "pii_counts": pii_counts,
    "mixing_targets": mixing_targets,
    "packing_totals": packing_totals,
    "media_payloads": media_payloads,
    "sharding_places": sharding_places,
}

_WORDS = "list_filter(string_split_regex({0}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_STRIP = "regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g')"

#: Exact similarity of all pairs that share a shingle, and reachability by recursion.
_NEAR = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM sh x JOIN sh y USING (s) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 75 * (na.n + nb.n - common)),
reach AS (SELECT doc_id AS node, doc_id AS label FROM documents UNION SELECT b, label FROM reach JOIN links ON a = node),
least AS (SELECT node, min(label) AS label FROM reach GROUP BY node)
SELECT doc_id, coalesce(n, 0) AS n_shingles, label AS component_id, doc_id = label AS kept FROM documents JOIN least ON node = doc_id LEFT JOIN n USING (doc_id)
"""

_RULES = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS w, length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]+', '', 'g')) AS marks FROM documents),
grams AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS p, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM d WHERE len(w) >= 5),
twice AS (SELECT doc_id, p FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
repeats AS (SELECT doc_id, count(DISTINCT p + o) AS n FROM twice, range(5) t(o) GROUP BY doc_id),
lines AS (SELECT doc_id, marks, line, {_STRIP} AS s FROM (SELECT doc_id, marks, unnest(string_split(text, chr(10))) AS line FROM d)),
judged AS (SELECT *, length(s) > 0 AND ((marks > 0 AND (length(regexp_replace(s, '[^#*$%&|<>]+', '', 'g')) * 20 > length(s) OR (length(regexp_replace(s, '[^|]+', '', 'g')) >= 2 AND length(regexp_replace(s, '[^|]+', '', 'g')) * 30 > length(s))))
  OR (length(s) >= 12 AND upper(s) = s AND lower(s) <> s) OR (length(s) <= 160 AND regexp_matches(s, '{BOILERPLATE}')) OR (length(s) <= 16 AND NOT regexp_matches(s, '{TERMINAL}'))) AS fails FROM lines),
by_doc AS (SELECT doc_id, count(*) FILTER (s <> '') - count(DISTINCT line) FILTER (s <> '') AS n_dup_lines, coalesce(sum(length(line)) FILTER (fails), 0)::BIGINT AS lost_chars FROM judged GROUP BY doc_id),
m AS (SELECT doc_id, text, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, marks AS n_symbols, n_dup_lines, coalesce(n, 0) AS n_repeat_words, lost_chars FROM d JOIN by_doc USING (doc_id) LEFT JOIN repeats USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_chars, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND lost_chars * 100 <= length(text) * 60 AS kept FROM m
"""

_ARCHIVES = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to FROM g
"""

_fits = " UNION ALL ".join(f"SELECT '{v}' AS said, '{r}' AS rule, '{r.partition('/')[0]}' AS name, '/{r.partition('/')[2]}' AS start" for v, r in RULES)
_URLS = f"""
WITH rules AS ({_fits}), u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(said, length(rule)) AS said FROM p JOIN rules ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start) GROUP BY page_id)
SELECT page_id, host, path, rule, said FROM p LEFT JOIN f USING (page_id)
"""

_DIGITS = "regexp_replace({0}, '[^0-9]', '', 'g')"
_LUHN = "list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(reverse(d), i, 1)::INT ELSE substr(reverse(d), i, 1)::INT * 2 - CASE WHEN substr(reverse(d), i, 1)::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
_PII = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
card AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, {_DIGITS.format("x")} AS d FROM (SELECT doc_id, unnest(regexp_extract_all(t, '[0-9](?:[ -]?[0-9])+')) AS x FROM t)) WHERE length(d) BETWEEN 13 AND 19 AND {_LUHN} GROUP BY doc_id)
SELECT t.doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+')) AS n_email,
  len(list_filter(regexp_extract_all(t, '[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+'), lambda x: len(list_filter(string_split(x, '.'), lambda q: q::HUGEINT > 255)) = 0)) AS n_ip,
  coalesce(card.n, 0) AS n_card, len(list_filter(regexp_extract_all(t, '\\+[0-9][ ().0-9-]+[0-9]'), lambda x: length({_DIGITS.format("x")}) BETWEEN 9 AND 15)) AS n_phone
FROM t LEFT JOIN card USING (doc_id)
"""

_TARGETS = f"""
WITH RECURSIVE s AS (SELECT source, sum(len({_WORDS.format("coalesce(text, '')")}))::DOUBLE AS size FROM documents GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS i, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM s),
l AS (SELECT list(size ORDER BY i) AS sizes, list(w ORDER BY i) AS ws FROM o),
r AS (SELECT sizes, ws, []::BIGINT[] AS fixed FROM l UNION
  SELECT sizes, ws, list_sort(list_concat(fixed, list_filter(range(1, len(sizes) + 1), lambda i: NOT list_contains(fixed, i) AND (list_sum(sizes) - 3 * coalesce(list_sum(list_transform(fixed, lambda k: sizes[k])), 0)) * ws[i] / list_sum(list_transform(list_filter(range(1, len(sizes) + 1), lambda k: NOT list_contains(fixed, k)), lambda k: ws[k])) > 3 * sizes[i]))) FROM r),
last AS (SELECT * FROM r ORDER BY len(fixed) DESC LIMIT 1)
SELECT source, size::BIGINT AS source_size, round(CASE WHEN list_contains(fixed, i) THEN 3 * size ELSE (list_sum(sizes) - 3 * coalesce(list_sum(list_transform(fixed, lambda k: sizes[k])), 0)) * w / list_sum(list_transform(list_filter(range(1, len(sizes) + 1), lambda k: NOT list_contains(fixed, k)), lambda k: ws[k])) END, 3) AS target, true AS near FROM o, last
"""

_PAYLOADS = """
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents), n AS (SELECT *, octet_length(b) AS n, CASE WHEN octet_length(b) = 0 THEN 64 ELSE (64 - octet_length(b) % 64) % 64 END AS more FROM b)
SELECT doc_id, n AS n_bytes, n + more AS payload_bytes, sha256(b || repeat('\\x00'::BLOB, more)) AS payload_sha256, n + more + 44 AS media_bytes FROM n
"""

_PLACES = "SELECT s::INTEGER AS shard, 'rows' AS law, (n - s + 7) // 8 AS n, (n - s + 7) // 8 AS places, 0::BIGINT AS first_slot, (n - s + 7) // 8 - 1 AS last_slot FROM (SELECT count(*) AS n FROM documents), range(8) t(s)"

ORACLES: dict[str, str] = {
    "op3_near_dedup": _NEAR,
    "op7_quality_rules": _RULES,
    "op10_warc": _ARCHIVES,
    "url_rules": _URLS,
    "pii_counts": _PII,
    "mixing_targets": _TARGETS,
    "packing_totals": "SELECT count(DISTINCT doc_id) AS docs, 0::BIGINT AS cut_gaps, 0::BIGINT AS gaps, 0::BIGINT AS too_long FROM documents",
    "media_payloads": _PAYLOADS,
    "sharding_places": _PLACES,
}
