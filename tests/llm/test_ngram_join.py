import random
import re
from collections import defaultdict

import numpy as np
import pytest

from codewhiff.llm import ngram_join as J
from helpers import prose, rows_of, table


def grams(text, n=3):
    words = [w for w in re.split(r"[\x00-/:-@\[-`{-\x7f]+", text.lower()) if w]
    if not words:
        return frozenset()
    return frozenset([tuple(words)] if len(words) < n else [tuple(words[i : i + n]) for i in range(len(words) - n + 1)])


def expected(rows, t=0.55):
    """(doc_id, class_id, copy_of, n_links) by comparing each two sets."""
    points = defaultdict(set)
    for i, text in rows:
        if i is not None:
            points[grams(text) if text and grams(text) else i].add(i)
    sets = list(points)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(sets)
    for x in range(len(sets)):
        for y in range(x):
            if isinstance(sets[x], frozenset) and isinstance(sets[y], frozenset):
                both = len(sets[x] & sets[y])
                if both >= (t - 1e-12) * (len(sets[x]) + len(sets[y]) - both):
                    links[x] += 1
                    links[y] += 1
                    root[find(x)] = find(y)
    of = defaultdict(list)
    for x, s in enumerate(sets):
        for i in points[s]:
            of[i].append(x)
    for xs in of.values():
        for x in xs:
            root[find(x)] = find(xs[0])
    least = {}
    for x, s in enumerate(sets):
        least[find(x)] = min(least.get(find(x), min(points[s])), min(points[s]))
    return sorted((i, least[find(xs[0])], min(min(points[sets[x]]) for x in xs), sum(links[x] for x in xs)) for i, xs in of.items())


def found(df, **kw):
    return rows_of(J.ngram_jaccard_join(df, **kw))


def families(seed, n):
    """Documents with changed copies at all distances."""
    r, rows = random.Random(seed), []
    while len(rows) < n:
        base = prose(r, r.choice([4, 12, 60, 200])).split()
        for _ in range(r.randrange(1, 7)):
            words = list(base)
            for _ in range(int(len(words) * r.choice([0, 0, 0.02, 0.06, 0.12, 0.3]))):
                words[r.randrange(len(words))] = "changed" + str(r.randrange(10**6))
            rows.append((len(rows) * 3 + 1, " ".join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = families(seed, 250)
    assert found(table(spark, rows)) == expected(rows)


def cluster(seed, n, most=12):
    """Changed copies of one text."""
    r = random.Random(seed)
    base = prose(r, 60).split()
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(r.randrange(most)):
            words[r.randrange(60)] = "x" + str(r.randrange(10**6))
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("block", [8, 40])
def test_large_regions_divide_in_spark(spark, monkeypatch, block):
    """By rounds of pivots, whose sets have a home then, and by pairs of blocks."""
    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J, "LEAF", 6)
    rows = cluster(5, 150) + [(1000 + i, t) for i, t in cluster(6, 90, 5)] + [(2000 + i, t) for i, t in families(8, 60)]
    seen = []
    homes = J._homes
    monkeypatch.setattr(J, "_homes", lambda *a: seen.append(homes(*a)) or seen[-1])
    want = expected(rows)
    assert found(table(spark, rows)) == want
    assert seen and max(w[3] for w in want) > 50


def test_frequent_ngrams_and_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(J, "HOT", 5)
    rows = cluster(2, 200, 8) + [(500 + i, cluster(2, 1)[0][1]) for i in range(300)]
    assert found(table(spark, rows).repartition(6)) == expected(rows)


@pytest.mark.parametrize("leaf,spread", [(12, 0.95), (12, 0.99), (40, 0.97), (5, 0.9)])
def test_regions_divide_by_balls_and_lose_no_link(monkeypatch, leaf, spread):
    monkeypatch.setattr(J, "LEAF", leaf)
    r = np.random.default_rng(3)
    sets, apart = [], []
    for c in range(10):
        base = r.choice(5000, 40, replace=False)
        for _ in range(30):
            keep = base[r.random(40) < spread]
            sets.append(np.unique(np.r_[keep, r.choice(5000, 1)]).astype(np.uint64))
            apart.append([("r", x) for x in np.flatnonzero(r.random(4) < 0.2).tolist()])
    size = np.array([len(s) for s in sets])
    near = np.array([[len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.6 for b in sets] for a in sets]) & ~np.eye(len(sets), dtype=bool)
    here = np.array([[not set(a) & set(b) for b in apart] for a in apart])
    region = J.Region(sets, size, 0.4, apart)
    links, u, v = region.join()
    assert links.tolist() == (near & here).sum(axis=1).tolist() and near[u, v].sum() + len(u) > 0
    assert region.depth > 1 or spread < 0.95

    def groups(pairs):
        root = list(range(len(sets)))
        for a, b in pairs:
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            root[max(a, b)] = min(a, b)
        out = []
        for a in range(len(sets)):
            while root[a] != a:
                a = root[a]
            out.append(a)
        return out

    assert groups(zip(u.tolist(), v.tolist())) == groups(zip(*np.nonzero(near)))


def test_odd_rows(spark):
    long = prose(random.Random(1), 120_000)
    rows = [(1, None), (None, "some text here for you"), (2, ""), (3, " .,; "), (4, "one two"), (5, "One, two!"), (6, "one"), (7, "one two three"), (7, "one two three"), (7, "other words in it"), (8, "ONE two; three"), (9, long), (10, long + " end"), (11, "Ünïcode wörds ñow"), (12, ""), (12, "other words in it")]
    want = expected(rows)
    assert found(table(spark, rows, clash=True)) == want
    assert (5, 4, 4, 0) in want and (8, 7, 7, 0) in want and (10, 9, 10, 1) in want and (12, 7, 7, 0) in want and (1, 1, 1, 0) in want


def test_no_rows(spark):
    assert found(table(spark, [])) == []
    assert found(table(spark, [(1, None), (2, ""), (None, "a b c")])) == [(1, 1, 1, 0), (2, 2, 2, 0)]


def test_keep_one(spark):
    rows = [(5, "a"), (3, "b"), (9, "c"), (1, "d"), (None, "e"), (None, "e"), (9, "c"), (2, "f"), (2, "f")]
    classes = spark.createDataFrame([(3, 3), (5, 3), (9, 3), (1, 1), (2, 2)], "doc_id long, class_id long")
    out = J.keep_one(table(spark, rows, clash=True), classes)
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(3, "b"), (1, "d"), (None, "e"), (None, "e"), (2, "f")], key=str)
    assert out.columns == table(spark, rows, clash=True).columns


@pytest.mark.parametrize("few", [0, 1000])
def test_components_of_chains_and_none(spark, monkeypatch, few):
    monkeypatch.setattr(J, "FEW", few)
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101)], "doc_a long, doc_b long").repartition(4)
    assert rows_of(J.components(chain)) == [(i, 1) for i in range(1, 61)] + [(100, 100), (101, 100)]
    assert rows_of(J.components(chain.limit(0))) == []
