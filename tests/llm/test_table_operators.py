"""Mixing, packing, sharding, media, URL graph, archives and the pipeline against brute force, with odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_text_operators import WORD, frame, odd_texts
from veinstone.llm import media, mixing, packing, sharding, url_graph, warc

SF = "/root/testdata/sf0.001"


def test_sainte_lague():
    rng = random.Random(4)
    for _ in range(200):
        votes = np.array([rng.choice([0, 1, 5, 5, 9, 40, 333.5]) for _ in range(rng.randint(1, 8))])
        most = np.array([rng.randint(0, 20) for _ in votes])
        seats = rng.randint(0, 60)
        won = np.zeros(len(votes), int)
        for _ in range(seats):
            q = [v / (2 * w + 1) if w < m and v > 0 else -1 for v, w, m in zip(votes, won, most, strict=True)]
            if max(q) < 0:
                break
            won[int(np.argmax(q))] += 1
        got = mixing.sainte_lague(votes, seats, most)
        assert got.sum() == won.sum() and (got <= most).all()
        last = [v / (2 * w - 1) for v, w in zip(votes, got, strict=True) if w]
        following = [v / (2 * w + 1) for v, w, m in zip(votes, got, most, strict=True) if w < m]
        assert not last or not following or min(last) >= max(following) - 1e-9


def test_targets():
    assert mixing.targets([100, 100, 100]) == pytest.approx([187.5, 75, 37.5])
    assert mixing.targets([10, 1000, 1000]) == pytest.approx([30, 1980 * 2 / 3, 1980 / 3])
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0, 0]


def test_mixing(spark):
    texts = odd_texts(5, 150)
    docs = frame(spark, texts).withColumn("source", F.when(F.col("doc_id") % 7 == 0, None).when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("doc_id") % 5)))
    got = {r.doc_id: r for r in mixing.planned(docs).collect()}
    again = {r.doc_id: r for r in mixing.planned(docs.repartition(7)).collect()}
    assert {i: r.taken for i, r in got.items()} == {i: r.taken for i, r in again.items()}
    size = [len(WORD.findall(t or "")) for t in texts]
    assert all(r["size"] == size[i] and 0 <= r.taken <= 3 * size[i] for i, r in got.items())
    source = {r.doc_id: r.source for r in docs.collect()}
    taken, target, total = defaultdict(int), {}, defaultdict(int)
    for i, r in got.items():
        taken[source[i]] += r.taken
        total[source[i]] += size[i]
        target[source[i]] = r.target
    names = sorted(total, key=lambda s: (s is None, s or ""))
    assert [target[s] for s in names] == pytest.approx(mixing.targets([total[s] for s in names]))
    for s in names:
        assert abs(taken[s] - target[s]) <= max(60, 0.03 * target[s])
    mixed = {r.doc_id: r for r in mixing.mix(docs).collect()}
    assert {i: len(WORD.findall(r.text)) for i, r in mixed.items()} == {i: r.taken for i, r in got.items() if r.taken}
    for i, r in mixed.items():
        assert set(WORD.findall(r.text)) <= set(WORD.findall(texts[i])) and r.n_chars == len(r.text)
    assert mixing.planned(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0
    assert mixing.planned(frame(spark, [None, ""])).filter("taken > 0").count() == 0


def test_first_fit_decreasing():
    rng = random.Random(1)
    for _ in range(50):
        sizes = sorted((rng.randint(1, 100) for _ in range(rng.randint(1, 60))), reverse=True)
        room: list[int] = []
        want = []
        for s in sizes:
            k = next((k for k, x in enumerate(room) if x >= s), len(room))
            if k == len(room):
                room.append(100)
            want.append((k, 100 - room[k]))
            room[k] -= s
        bins, offsets = packing.first_fit_decreasing(np.array(sizes), 100)
        assert list(zip(bins.tolist(), offsets.tolist(), strict=True)) == want


def test_packing(spark):
    from tokenizers import Tokenizer
    import public_tokenizers

    texts = [*odd_texts(6, 60), "has <|endoftext|> inside", "naïve 文字 \U0001f600  \n\n  x"]
    whole = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    docs = frame(spark, texts)
    rows = packing.pack(docs, group_docs=40).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(range(len(texts)))
    for i, t in enumerate(texts):
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        assert [r.start for r in pieces] == [sum(p.length for p in pieces[:k]) for k in range(len(pieces))]
        assert sum(r.length for r in pieces) == len(ids) == pieces[0].doc_tokens
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in pieces)
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == [sum(p.length for p in pieces[:k]) for k in range(len(pieces))]
        assert sum(r.length for r in pieces) <= packing.LENGTH
    tripled = docs.union(docs).union(docs)
    assert packing.pack(tripled).count() == 3 * len(rows)
    assert packing.pack(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 100, 1000])
def test_permutation(n):
    places = sharding.permuted(np.arange(n), n)
    assert sorted(places) == list(range(n))
    assert all(sharding.row_at(int(p), n) == i for i, p in enumerate(places))


def test_sharding(spark):
    texts = odd_texts(7, 80)
    docs = frame(spark, texts)
    rows = sharding.shard(docs).collect()
    again = {(r.doc_id, r.shard, r.slot) for r in sharding.shard(docs.repartition(9)).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in rows}
    slots = defaultdict(list)
    for r in rows:
        t = texts[r.doc_id]
        assert r["size"] == len((t or "").encode()) + 1 and r.text_crc32 == zlib.crc32((t or "").encode())
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and len(slots) == 8
    same = spark.createDataFrame([(None, "x")] * 50 + [(1, None)] * 30, "doc_id long, text string")
    assert sharding.shard(same).select("shard", "slot").distinct().count() == 80
    assert sharding.shard(docs.limit(0)).count() == 0


def test_media(spark):
    texts = odd_texts(8, 30) + ["a" * 64, "b" * 63]
    got = {r.doc_id: r for r in media.media_columns(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64) if raw else bytes(64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert media.from_wav(bytes(r.media)) == payload and hashlib.sha256(r.media).hexdigest() == r.media_sha256 and len(r.media) == r.media_bytes
    assert media.media_columns(frame(spark, texts).limit(0)).count() == 0
    tone = (128 + 100 * np.sin(np.arange(8000) * 2 * np.pi * 1000 / 8000)).astype(np.uint8).tobytes()
    codes = media.fingerprint(tone)
    assert len(codes) and all(int(c) >> 20 & 0xFFF == 32 for c in codes)


def test_rules_and_hosts(spark):
    urls = ["http://Example.COM/en/7?x", "https://a.b.com/en/1", "http://com/en/", "http://xcom/en/", "http://x.net/de/#t", "http://a.example.net/de/8", "ftp://u.org/es/1?q", None, "nothing", "http://h.com", "x://y.org?z://k", "http://a/b\nc"]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("html", F.lit(None).cast("string"))
    got = {r.page_id: r for r in url_graph.judge(rows).collect()}
    for i, u in enumerate(urls):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.split("[/?#]", rest, maxsplit=1)[0].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        fits = [(len(r), r, v) for v, r in url_graph.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, max(fits)[1] if fits else None)
        if fits:
            assert got[i].verdict == max(fits)[2]
    assert got[7].verdict == "allow"
    assert url_graph.judge(rows.limit(0)).count() == 0


def test_spread(spark):
    """Scores against a dense matrix, and verdicts that links decide."""
    rng = np.random.default_rng(3)
    n = 12
    w = np.where(rng.random((n, n)) < 0.25, rng.integers(1, 5, (n, n)), 0).astype(float)
    np.fill_diagonal(w, 0)
    good, bad = np.zeros(n), np.zeros(n)
    good[:2], bad[5] = 0.5, 1.0
    edges = spark.createDataFrame([(f"h{i}", f"h{j}", float(w[i, j])) for i in range(n) for j in range(n) if w[i, j]], "src string, dst string, weight double")
    seeds = spark.createDataFrame([(f"h{i}", float(good[i]), float(bad[i])) for i in range(n) if good[i] or bad[i]], "host string, trusted double, blocked double")
    along = np.divide(w, w.sum(1, keepdims=True), out=np.zeros_like(w), where=w.sum(1, keepdims=True) > 0)
    against = np.divide(w, w.sum(0, keepdims=True), out=np.zeros_like(w), where=w.sum(0, keepdims=True) > 0)
    t, d = good * 0.15, bad * 0.15
    for _ in range(url_graph.ROUNDS):
        t, d = 0.15 * good + 0.85 * (t @ along), 0.15 * bad + 0.85 * (against @ d)
    got = {r.host: r for r in url_graph.spread(edges, seeds).collect()}
    for i in range(n):
        r = got.get(f"h{i}")
        assert (r.trust if r else 0, r.distrust if r else 0) == pytest.approx((t[i], d[i]), abs=1e-7)
    pages = spark.createDataFrame([(1, "http://spam.com/en/1", None), (2, "http://friend.info/a", '<a href="http://spam.com/x">'), (3, "http://good.net/de/1", '<a HREF=\'https://Liked.info/\'>'), (4, "http://liked.info/", None), (5, "http://other.info/", "<a href='/in'>")], "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in url_graph.judge(pages).collect()} == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow"}


def test_family_without_pages(spark):
    """Hosts meet in ancestors that have no pages; IP addresses and lone top labels are no family."""
    urls = ["http://a.x.example.info/", "http://b.y.example.info/", "http://c.d.e.other.info.", "http://10.9.8.7/", "http://11.9.8.7:80/", "http://two.info/"]
    edges = url_graph.host_edges(spark.createDataFrame([(u.split("/")[2], None) for u in urls], "host string, html string"))
    ups = [("a.x.example.info", "x.example.info"), ("b.y.example.info", "y.example.info"), ("x.example.info", "example.info"), ("y.example.info", "example.info"), ("c.d.e.other.info.", "d.e.other.info."), ("d.e.other.info.", "e.other.info."), ("e.other.info.", "other.info.")]
    assert sorted(tuple(r) for r in edges.collect()) == sorted((*e, url_graph.FAMILY) for a, b in ups for e in ((a, b), (b, a)))
    pages = spark.createDataFrame([(1, "http://m.shop.example.org/es/1", None), (2, "http://www.blog.example.org/a", None), (3, "http://www.blog.other.org/a", None)], "page_id long, url string, html string")
    got = {r.page_id: r for r in url_graph.judge(pages).collect()}
    assert {k: r.verdict for k, r in got.items()} == {1: "block", 2: "block", 3: "allow"} and got[2].distrust > 0 == got[3].distrust


def test_small_scores(spark):
    """Evidence counts however little of the whole it is."""
    links = lambda many, one: [(many, "".join(f"<a href='http://{one}/{i}'>" for i in range(999)))]
    html = [("spam.com/en/1", None), *links("many1.info", "spam.com"), ("few1.info", "<a href='http://spam.com/'>")]
    for k in (2, 3, 4):
        html += [*links(f"many{k}.info", f"few{k - 1}.info"), (f"few{k}.info", f"<a href='http://few{k - 1}.info/'>")]
    html.append(("else.info", None))
    pages = spark.createDataFrame([(i, f"http://{u}", h) for i, (u, h) in enumerate(html)], "page_id long, url string, html string")
    got = {r.host: r for r in url_graph.judge(pages).collect()}
    assert {h for h, r in got.items() if r.verdict == "allow"} == {"else.info"}
    assert got["few4.info"].distrust == pytest.approx(0.15 * 0.85**4 * 1e-12, rel=1e-6)
    share = F.col("t"), F.col("d"), 0.5
    rows = spark.createDataFrame([(1e-30, 1e-30), (0.1 + 0.2, 0.3), (0.3, 0.1 + 0.2), (1e-30, 1.001e-30), (0.0, 1e-300), (0.0, 0.0)], "t double, d double")
    assert [r[0] for r in rows.select(url_graph.suspect(*share)).collect()] == [False, False, False, True, True, False]


def test_archives(spark, tmp_path):
    big, other = "é" * 600, "y" * 1500
    html = [big, None, "", "small", "small", big, other, "\r\n\r\n" + "z" * 1200, big]
    urls = ["http://B.com/x\ty", None, "nothing", "http://a.com/", "http://a.com/", "http://b.com/1", "http://c.org/?q", "http://é.net/", "http://b.com/1"]
    rows = spark.createDataFrame([*((i, u, h) for i, (u, h) in enumerate(zip(urls, html, strict=True))), (6, "http://c.org/?q", other), (None, "http://n.com/", big)], "page_id long, url string, html string")
    root = f"file://{tmp_path}/warc"
    files = warc.write_archives(rows, root)
    got = warc.read_archives(rows, root, files).collect()
    assert len(got) == 11
    for r in got:
        h = (big if r.page_id is None else html[r.page_id] or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(h), hashlib.sha1(h).hexdigest())
        revisit = h == big.encode() and r.page_id != 8
        assert (r.record_type, r.refers_to) == (("revisit", 8) if revisit else ("response", None))
    index = warc.CaptureIndex(root, files)
    assert index.find("zz,zz)/ 00000000000000000000") is None and index.find("") is None
    empty = warc.write_archives(rows.limit(0), f"file://{tmp_path}/none")
    assert warc.read_archives(rows.limit(0), f"file://{tmp_path}/none", empty).count() == 0


def test_index_blocks(spark, tmp_path, monkeypatch):
    """Many blocks: every key is found, and keys between them are not."""
    rows = spark.range(2600).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id") % 37, F.lit(".com/"), F.col("id")).alias("url"), F.col("id").cast("string").alias("html"))
    root = f"file://{tmp_path}/w"
    files = warc.write_archives(rows, root)
    got = warc.read_archives(rows, root, files)
    assert got.filter(F.sha1(F.col("page_id").cast("string")) == F.col("payload_digest")).count() == 2600
    index = warc.CaptureIndex(root, files)
    keys = [r[0] for r in rows.select(warc.key_of(F.col("url"), F.col("page_id"))).limit(200).collect()]
    assert all(index.find(k) and not index.find(k + "!") for k in keys)


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    texts = odd_texts(9, 60) + ["mail me at a.b@c.org, this line is long enough to stay here and more.\n" + f"extra words {i} of a text that goes on for some time, as texts do." for i in range(5)]
    docs = frame(spark, texts).withColumn("source", F.concat(F.lit("s"), F.col("doc_id") % 4))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == columns and 0 < docs.count() <= before, name
        assert docs.filter("n_chars != length(text)").count() == 0
    assert docs.filter("text like '%@c.org%'").count() == 0
    assert corpus_pipeline.packing(spark, docs, SF).select("doc_id").distinct().count() == docs.count()
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_registered(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert sum(bool(re.match(r"op\d+_", n)) for n in names) == 10 and "pipeline" in names


@pytest.mark.parametrize("name", ["op3_near_dedup", "op7_quality_rules", "op10_warc"])
def test_sql(spark, name):
    from tests.compare import differences
    from veinstone.llm.queries import ORACLES, QUERIES

    assert differences(QUERIES[name](spark, SF), ORACLES[name], SF) == ""
