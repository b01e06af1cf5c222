"""Quality rules, personal data, near duplicates and the classifier against brute force, with odd rows."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veinstone.llm import near_dedup, pii, quality_classifier, quality_rules

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def odd_texts(seed: int = 1, n: int = 120) -> list[str | None]:
    """Nulls, empties, blanks, short, repetitive and long texts, copies and near copies."""
    rng = random.Random(seed)
    vocabulary = ["alpha", "Beta", "gamma,", "x|y", "é", "ÀB", "#tag", "be.", "the", "of", "\u00a0z"]
    out: list[str | None] = [None, "", " \t\n", "one", "one two three four", "\n\nend.\n", "a b c d e " * 40, "w " * 30000, "LOUD WORDS HERE!!\n" * 3 + "calm words end here."]
    for _ in range(n):
        words = [rng.choice(vocabulary) + str(rng.randint(0, 60)) * rng.randint(0, 1) for _ in range(rng.randint(1, 120))]
        text = "".join(w + rng.choice([" ", " ", " ", "\n", "\r\n", "\t", "\x0b"]) for w in words)
        out.append(text)
        if rng.random() < 0.4:
            out.append(text)
        while rng.random() < 0.5:
            k = rng.randrange(len(words))
            words[k] = "new" + str(rng.randint(0, 9))
            out.append(" ".join(words))
    return out


def frame(spark, texts, **more):
    rows = [(i, t, "en", "src", len(t) if t is not None else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_quality_rules(spark):
    texts = odd_texts()
    docs = frame(spark, texts).withColumn("kept", F.lit("clash")).withColumn("n_words", F.lit(-1))
    got = {r.doc_id: r for r in quality_rules.apply_rules(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        t = t or ""
        w = WORD.findall(t)
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        counts, inside = Counter(grams), set()
        for k, g in enumerate(grams):
            if counts[g] > 1:
                inside.update(range(k, k + 5))
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 10 or 100 * len(inside) > 20 * len(w))
        assert not (r.kept and r.base_failed)
    good = "This is a calm line of plain words that ends well.\n"
    mixed = spark.createDataFrame([(1, good * 1 + "Another sentence with other things goes on here.\nHome | About | Contact\nLicensed under CC BY 4.0."), (2, "a | b | c | d\n" * 3 + "e | f | g | h | i | j | k"), (3, "THIS!! IS!! ALL!! LOUD!! TEXT!! AND!! NO!! MORE!! OF!! IT!!")], "doc_id long, text string")
    r = {x.doc_id: x for x in quality_rules.apply_rules(mixed).collect()}
    assert r[1].kept and "Home" not in r[1].cleaned and "Licensed" not in r[1].cleaned and r[1].cleaned.startswith(good)
    assert not r[2].kept and not r[3].kept
    assert quality_rules.apply_rules(mixed.limit(0)).count() == 0
    assert "Python" not in quality_rules.apply_rules(mixed)._jdf.queryExecution().executedPlan().toString()


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components_of(sets: dict) -> dict:
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_near_duplicates(spark):
    texts = odd_texts(3, 90)
    rng = random.Random(8)
    base = [f"w{rng.randint(0, 999)}" for _ in range(80)]
    for _ in range(60):  # a big bucket whose members are similar to some of each other only
        words = list(base)
        for k in rng.sample(range(80), rng.randint(0, 4)):
            words[k] = f"v{rng.randint(0, 99)}"
        texts.append(" ".join(words))
    docs = frame(spark, texts)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs.union(docs.limit(5))).collect()}
    sets = {i: shingle_set(t) for i, t in enumerate(texts)}
    want = components_of(sets)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.n_shingles == len(sets[i]) and r.kept == (want[i] == i) for i, r in got.items())
    nameless = spark.createDataFrame([(None, "a b c d e f g"), (4, "a b c d e f g"), (None, "only here it is so"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in near_dedup.near_duplicates(nameless).collect()) == [(-1, -1, True), (-1, -1, True), (-1, 4, False), (4, 4, True)]
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_blocks(spark, monkeypatch):
    """The block comparison alone finds what the pairs find."""
    monkeypatch.setattr(near_dedup, "SMALL", 1)
    monkeypatch.setattr(near_dedup, "BLOCK_NODES", 7)
    test_near_duplicates(spark)


def test_sketches():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 1200).astype(np.uint64)
    a, b = np.unique(pool[:1000]), np.unique(pool[200:])
    same = (near_dedup.sketch(a) == near_dedup.sketch(b)).mean()
    assert abs(same - 800 / 1200) < 0.15
    one = near_dedup.sketch(pool[:1])
    assert len(one) == near_dedup.COORDS and (one == near_dedup.sketch(pool[:1])).all()
    sets = [np.unique(rng.choice(pool[:60], 40)) for _ in range(50)]
    want = np.array([[len(np.intersect1d(x, y)) if i != j else 0 for j, y in enumerate(sets)] for i, x in enumerate(sets)])
    assert (near_dedup.intersections(sets) == want).all()


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_by_patterns(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 13 <= len(d) <= 19 and pii.luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]():  # noqa: B023
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans():
    rng = random.Random(5)
    for _ in range(4000):
        text = "".join(rng.choice("a1 23.@-+()%é\n4") for _ in range(rng.randint(0, 45)))
        text += "4539578763621486"[: rng.randint(10, 16)] + text if rng.random() < 0.5 else ""
        assert base_by_patterns(text) == sorted(pii.base_spans(text), key=lambda x: (pii.KINDS.index(x[0]), x[1]))
    for long in ("1" * 300_000, "@" * 300_000, "a" * 300_000 + "@b.c", "+1 " * 100_000):
        pii.all_spans(long, pii.trained())


def test_field_on_held_out_sentences():
    rng, field = random.Random(99), pii.trained()
    hit = extra = missed = 0
    for _ in range(200):
        text, places = pii._sentence(rng)
        found, want = set(pii.all_spans(text, field)[1]), set(places)
        hit, extra, missed = hit + len(found & want), extra + len(found - want), missed + len(want - found)
    assert hit / (hit + extra) > 0.93 and hit / (hit + missed) > 0.93
    for clean in ("Licensed under Apache License, Version 2.0.", "password=5ad0749aeeb4fff3e7 and more", "in 2019 there were 1,234,567 of 12.5"):
        assert pii.all_spans(clean, field)[1] == []


@pytest.mark.parametrize("at", ["[at]", "[AT]", "(At)", "( at )", "[ at]", "(AT )", "[ @ ]", "(\tat\n)"])
@pytest.mark.parametrize("dot", ["[dot]", "(DOT)", "[Dot]", "( dot )", "[ DOT]", "[ . ]", "( .)"])
def test_spelled_addresses(at, dot):
    """What the marks allow is seen: any case, inner and outer spaces, with and without digits in the name."""
    for name in ("john", "john.7"):
        for mail in (f"{name} {at} Example {dot} com", f"{name}{at}Example{dot}com", f"{name}{at} Example{dot} com", f"{name} {at}Example {dot}com"):
            text = f"please write {mail} about it and then"
            assert ("email", 13, 13 + len(mail)) in pii.all_spans(text, pii.trained())[1], text


def test_pieces_of_long_stretches(monkeypatch):
    """What lies across the end of a piece is found, and the pieces' length changes nothing."""
    field = pii.trained()
    for n in range(4090, 4097):
        text = "12 " * n + "call (212) 555-0199 now"
        assert ("phone", 3 * n + 5, 3 * n + 19) in pii.all_spans(text, field)[1], n
    rng = random.Random(12)
    made = [lambda: str(rng.randint(1, 99)), lambda: "(212) 555-0199", lambda: "736-555-2678", lambda: "a.7 [AT] b ( dot ) com", lambda: "1[.]2[.]3[.]4", lambda: "call", lambda: "4539.5787.6362.1486", lambda: "2019-03-12", lambda: "12 345 678 90 12", lambda: "555 555 0123"]
    texts = [" ".join(rng.choice(made)() for _ in range(200)) for _ in range(15)]
    whole = [pii.all_spans(t, field) for t in texts]
    assert sum(len(spans) for _, spans in whole) > 200
    for piece in (1, 9, 16, 37):
        monkeypatch.setattr(pii, "PIECE", piece)
        assert [pii.all_spans(t, field) for t in texts] == whole


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "to a.b@c.org or (736) 555-2678.", "x", 31), (2, None, None, None), (3, "", "y", 0), (4, "nothing", "z", 7)], "doc_id long, text string, spans string, n_chars long")
    got = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert got[1].text == "to <EMAIL> or <PHONE>." and got[1].n_chars == len(got[1].text) and got[1].spans == "x"
    assert got[2].text is None and got[3].text == "" and got[4].text == "nothing"
    assert pii.redact(docs.limit(0)).count() == 0


def test_classifier(spark):
    rng = random.Random(2)
    words = ["the", "of", "plain", "kind", "house", "tree", "river", "day"]
    rows, labels = [], []
    for i in range(1800):
        text = [rng.choice(words) + str(rng.randint(0, 40)) for _ in range(rng.randint(20, 60))]
        toxic, poor = i % 5 == 0, i % 5 == 1
        if toxic:
            text[3], text[9] = rng.choice(["vile", "nasty"]), rng.choice(["vile", "nasty"])
        rows.append((i, " ".join(f"{w}###" if poor else w for w in text)))
        labels.append((i, int(not poor), int(toxic)))
    docs = spark.createDataFrame([*rows, (10000, None)], "doc_id long, text string")
    rated = quality_classifier.rating(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    model = quality_classifier.trained(docs, rated.filter("doc_id < 1500"))
    assert (np.diff(model.thresholds) >= 0).all()
    got = {r.doc_id: r for r in quality_classifier.graded(docs, model).collect()}
    right = sum(got[i].kept == (i % 5 > 1) for i in range(1500, 1800))
    assert len(got) == 1801 and right >= 285
    assert got[10000].p_best is not None
    none = quality_classifier.trained(docs, rated.limit(0))
    assert quality_classifier.graded(docs, none).filter("kept").count() == 1801
    assert quality_classifier.graded(docs.limit(0), none).count() == 0


@pytest.mark.parametrize("grades", [[2, 2, 2], [0, 0]])
def test_one_grade(grades):
    model = quality_classifier.fit([np.array([1])] * len(grades), np.zeros((len(grades), quality_classifier.SHAPE)), np.array(grades))
    assert model.grades(np.zeros(1))[0].argmax() == grades[0]
