"""Shingle classes against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from depscope.llm import ngram_join as J, shingling as S
from depscope.llm.shingling import mixed


def _sets(rows):
    out = []
    for doc, text in rows:
        words = [w for w in (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).translate(dict.fromkeys((9, 10, 11, 12, 13), " ")).split(" ") if w]
        grams = {tuple(words)} if 0 < len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
        out.append((doc, grams))
    return out


def _brute(rows):
    sets = _sets(rows)
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(sets):
        k = root(i)
        least[k] = doc if least.get(k) is None else least[k] if doc is None else min(least[k], doc)
    linked = lambda i: sum(bool(s) and 100 * len(s & sets[i][1]) >= 80 * len(s | sets[i][1]) for j, (_, s) in enumerate(sets) if j != i)
    return sorted(((doc, len(s), least[root(i)], linked(i)) for i, (doc, s) in enumerate(sets)), key=str)


def _corpus(seed, n, edits):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefghij") + r.choice("klmnop") + str(r.randint(0, 30))
    bases = [[word() for _ in range(r.choice((3, 6, 30, 80, 200)))] for _ in range(n // 8)]
    passage = [word() for _ in range(60)]
    rows = []
    for doc in range(n):
        words = list(r.choice(bases))
        for _ in range(r.choice(edits)):
            words[r.randrange(len(words))] = word()
        if r.random() < 0.3:
            words = passage + words
        rows.append((doc, r.choice((" ", "  ", "\n")).join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_classes_equal_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(J, "SHORT", (2, 4, 16)[seed - 1])  # lists of both kinds
    rows = _corpus(seed, 300, (0, 0, 1, 1, 2, 3, 4, 6))
    got = J.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == _brute(rows)


def test_one_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 32)  # several blocks per list
    monkeypatch.setattr(J, "SETS_AT_ONCE", 50)  # and per component
    monkeypatch.setattr(J, "WORTH", 1)  # one round only
    r = random.Random(7)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for doc in range(400):
        words = list(base)
        for _ in range(r.randint(0, 7)):
            words[r.randrange(150)] = f"x{r.randint(0, 5000)}"
        rows.append((doc, " ".join(words)))
    got = J.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == _brute(rows)


def test_defined_cases(spark):
    rows = [
        (9, None), (8, ""), (7, " \n "), (6, "One two"), (5, "one\ttwo"), (4, "two one"), (None, "a b c d e f g"), (3, "A B c d e f g"), (3, "A B c d e f g"),
        (2, "É é"), (1, "é é"), (0, "x " * 30_000), (10, "x " * 40_000),
    ]
    docs = spark.createDataFrame([(d, t, 1, "k") for d, t in rows], "doc_id long, text string, component_id long, key string")
    assert sorted(map(tuple, J.jaccard_classes(docs).collect()), key=str) == _brute(rows)
    assert J.jaccard_classes(docs.limit(0)).count() == 0


def test_filters_never_lose_a_link():
    r = random.Random(11)
    for _ in range(3000):
        a = {r.randint(0, 400) for _ in range(r.randint(1, 60))}
        b = set(a)
        for _ in range(r.randint(0, 12)):
            (b.discard if r.random() < 0.5 else b.add)(r.randint(0, 400))
        if not b or 100 * len(a & b) < 80 * len(a | b):
            continue
        x, y = sorted(a), sorted(b)
        common = [t for t in x[: J.prefix_size(len(x))] if t in set(y[: J.prefix_size(len(y))])]
        assert common
        one = np.array([1])
        for t in common:
            assert J.may_link(one * len(x), one * len(y), one * x.index(t), one * y.index(t)).all()
        spread = lambda s: np.array([mixed(np.array([t], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[0] for t in s], dtype=np.uint64)
        bits = [np.frombuffer(J.parity(spread(s)), dtype=np.uint64) for s in (x, y)]
        assert J.NUM * int(np.bitwise_count(bits[0] ^ bits[1]).sum()) <= len(x) + len(y)
        for i, j in ((8, 8), (8, 32), (64, 16)):
            assert J.fewest_apart(J.parity(spread(x), i), J.parity(spread(y), j)) <= len(a ^ b)


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(200, 260)] + [(5, 6)]
    got = dict(map(tuple, J.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got[160] == 100 and got[259] == 1 and got[6] == 5 and len(got) == 61 + 61 + 2


def test_stage_keeps_one_of_each(spark):
    rows = [(1, "a b c d e f", "s", 7), (2, "A b c d e f", "s", 8), (2, "A b c d e f", "s", 8), (3, None, "s", 9), (4, "other words here", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, n long")
    assert sorted(r.doc_id for r in J.keep_one_of_each(spark, docs, "").collect()) == [1, 3, 4]


def test_stage_keeps_different_texts_under_one_number(spark):
    text = lambda w: " ".join(f"{w}{i}" for i in range(30))
    a, b, c, d = map(text, "abcd")
    rows = [(5, a), (5, b), (2, b), (None, c), (None, d), (None, c), (None, a), (7, " ".join(d.split()[:29])), (8, c + " end"), (None, text("e")), (None, text("f"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, J.keep_one_of_each(spark, docs, "").collect()), key=repr)
    # Only a class without any number is left to a row without one.
    assert got == sorted([(5, a), (2, b), (8, c + " end"), rows[7], (None, text("e")), (None, text("f"))], key=repr)


def test_stage_keeps_one_of_two_near_copies_under_one_number(spark):
    a = " ".join(f"a{i}" for i in range(60))
    docs = spark.createDataFrame([(3, a), (3, a + " end"), (3, a), (None, "x y z"), (None, "x y z")], "doc_id long, text string")
    got = list(map(tuple, J.keep_one_of_each(spark, docs, "").collect()))
    assert len(got) == 2 and (None, "x y z") in got and sum(r[0] == 3 for r in got) == 1


def test_links_of_a_near_copy_group_stay_few(spark, monkeypatch):
    verified = []
    verify = J._Contents.verified
    monkeypatch.setattr(J._Contents, "verified", lambda self, pairs: (verified.append(pairs.count()), verify(self, pairs))[1])
    for n in (150, 300, 600):
        r, rows = random.Random(n), []
        for doc in range(n):
            words = [f"w{i}" for i in range(150)]
            for _ in range(r.randint(0, 4)):
                words[r.randrange(150)] = f"x{r.randint(0, 50000)}"
            rows.append((doc, " ".join(words)))
        verified.clear()
        classes = J.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"))
        assert classes.groupBy("component_id").count().agg({"count": "max"}).first()[0] > n * 0.8
        assert sum(verified) < 4 * n, verified


def test_linked_pairs_are_whole(spark):
    rows = _corpus(5, 200, (0, 0, 1, 2, 3, 5))
    sets, least = _sets(rows), {}
    for doc, grams in sets:
        least.setdefault(frozenset(grams), doc)
    kinds = list(least)
    expected = sorted(
        (min(least[a], least[b]), max(least[a], least[b]), len(a & b), len(a | b))
        for i, a in enumerate(kinds) for b in kinds[:i] if a and b and 100 * len(a & b) >= 80 * len(a | b))
    assert expected and sorted(map(tuple, J.linked_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == expected


@pytest.mark.parametrize("slice_bytes", [64, 1 << 18])
def test_shingles_equal_plain_splitting(monkeypatch, slice_bytes):
    monkeypatch.setattr(S, "SLICE", slice_bytes)
    monkeypatch.setattr(S, "_UP", S._powers(S._BASE))
    monkeypatch.setattr(S, "_DOWN", S._powers(pow(S._BASE, -1, 1 << 64)))
    r = random.Random(2)
    pieces = ["a", "B", "b", "é", " ", "  ", "\n", "\u00a0", "\x0b", "xyz"]
    texts = [None, "", " \n", "a", "A b", "a b c d e", "q" * 1000 + " a b c " + "z" * 5000, "Q" * 1000 + " a b c " + "z" * 5000]
    texts += ["".join(r.choice(pieces) * r.randint(1, 3) + r.choice(("", " ")) for _ in range(r.randint(0, 60))) for _ in range(400)]
    for column, plain in ((pa.array(texts), texts), (pa.array(texts).slice(3, 200), texts[3:203])):
        got, known = list(S.shingle_sets(column, 5)), {}
        for (_, grams), hashes in zip(_sets(enumerate(plain)), got, strict=True):
            assert len(grams) == len(hashes) and known.setdefault(hashes.tobytes(), grams) == grams
    assert list(S.shingle_sets(pa.array([], pa.string()), 5)) == []
