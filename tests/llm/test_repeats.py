import random

import numpy as np
import pytest

from codewhiff.llm import debruijn, repeats, suffix_dedup
from helpers import prose, rows_of, table

OPERATORS = [suffix_dedup.suffix_array_dedup, debruijn.de_bruijn_repeats]


def expected(rows, length):
    seen, spans = {}, []
    texts = sorted({(i, t) for i, t in rows if i is not None and t is not None})
    windows = sorted((i, p, tuple(w[p : p + length])) for i, w in ((i, t.split()) for i, t in texts) for p in range(len(w) - length + 1))
    for i, p, w in windows:
        seen.setdefault(w, (i, p))
    again = sorted({(i, p, *seen[w]) for i, p, w in windows if seen[w] != (i, p)})
    for i, p, si, sp in again:
        if spans and spans[-1][0] == i and p <= spans[-1][1] + spans[-1][2]:
            spans[-1][2] = max(spans[-1][2], p + length - spans[-1][1])
        else:
            spans.append([i, p, length, si, sp])
    return sorted(map(tuple, spans))


def passages(seed, n, length):
    r = random.Random(seed)
    shared = [prose(r, r.randrange(length - 3, 3 * length)) for _ in range(6)]
    loop = " ".join(prose(r, 3).split() * length)
    rows = []
    for i in range(n):
        parts = []
        for _ in range(r.randrange(1, 5)):
            parts.append(prose(r, r.randrange(0, 2 * length)))
            parts.append(r.choice([*shared, shared[0], loop, ""]))
        rows.append((i * 7 + 1, " ".join(parts)))
    return rows


@pytest.mark.parametrize("find", OPERATORS)
@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, find, seed):
    rows = passages(seed, 40, 50)
    assert rows_of(find(table(spark, rows), 50)) == expected(rows, 50)


@pytest.mark.parametrize("base,group", [(40, 50), (300, 400)])
def test_suffix_array_over_many_tasks(spark, monkeypatch, base, group):
    """Rounds of triples, names and merges, with blocks and groups that every string and passage goes through several of."""
    for name, value in (("BASE", base), ("GROUP", group), ("BLOCK_WORDS", 150), ("PER_BLOCK", 20)):
        monkeypatch.setattr(suffix_dedup, name, value)
    levels = []
    names = suffix_dedup._names
    monkeypatch.setattr(suffix_dedup, "_names", lambda *a: levels.append(a[3]) or names(*a))
    r = random.Random(3)
    p = prose(r, 70)
    rows = passages(7, 16, 50) + [(1000 + i, prose(r, 3) + " " + p + " " + prose(r, 3)) for i in range(20)] + [(2000 + i, p) for i in range(6)]
    assert rows_of(suffix_dedup.suffix_array_dedup(table(spark, rows), 50)) == expected(rows, 50)
    assert max(levels) >= 2


@pytest.mark.parametrize("find", OPERATORS)
def test_odd_rows(spark, find):
    r = random.Random(9)
    p = prose(r, 60)
    long = prose(r, 30_000)
    rows = [(1, None), (None, p), (2, ""), (3, p), (4, "x " + p + " y"), (4, "x " + p + " y"), (5, p.replace(" ", "\t\n ")), (6, " ".join(p.split()[:49])), (7, " ".join(p.split()[:50])), (8, long), (9, "a " + long), (10, p + " " + p)]
    assert rows_of(find(table(spark, rows, clash=True), 50)) == expected(rows, 50)
    assert rows_of(find(table(spark, []), 50)) == []


def test_hot_passage(spark, monkeypatch):
    """One passage in many documents, and in many chunks."""
    monkeypatch.setattr(debruijn, "CHUNK_WORDS", 500)
    r = random.Random(4)
    p = prose(r, 55)
    rows = [(i, prose(r, 5) + " " + p + " " + prose(r, 5)) for i in range(300)]
    for find in OPERATORS:
        assert rows_of(find(table(spark, rows), 50)) == expected(rows, 50)


@pytest.mark.parametrize("alphabet", [1, 2, 3, 50])
def test_difference_cover(alphabet):
    r = np.random.default_rng(alphabet)
    for n in [0, 1, 2, 3, 4, 5, 7, 30, 100, 301]:
        s = r.integers(1, alphabet + 1, n)
        assert suffix_dedup.difference_cover(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


def test_stage_cuts_all_but_the_first(spark):
    r = random.Random(2)
    p, a, b = prose(r, 60), prose(r, 10), prose(r, 12)
    rows = [(1, f"{a} {p}"), (2, f"{b} {p} end"), (3, p), (4, None), (5, ""), (None, p), (6, f"  {p}\n")]
    out = {r_.doc_id: r_ for r_ in suffix_dedup.suffix_array_stage(table(spark, rows, clash=True)).collect()}
    assert out[1].text == f"{a} {p}" and out[2].text == f"{b} end"
    assert out[2].n_chars == len(out[2].text) and out[1].n_chars == len(out[1].text)
    assert 3 not in out and 6 not in out and out[4].text is None and out[5].text == "" and out[None].text == p


def test_cut_spans_with_any_column_names(spark):
    found = spark.createDataFrame([(1, 0, 1, 5, 0)], repeats.SPANS)
    df = table(spark, [(1, "a b"), (1, "a c"), (2, "d")]).selectExpr("*", "'x' as __spans", "1 as spans0", "2 as `Spans1`", "3 as `spans2-of`")
    out = repeats.cut_spans(df, found)
    assert out.columns == df.columns and sorted((r.doc_id, r.text, r['__spans'], r.n_chars) for r in out.collect()) == [(1, "b", "x", 1), (1, "c", "x", 1), (2, "d", "x", 1)]


def test_cut_spans_handles_none(spark):
    none = spark.createDataFrame([], repeats.SPANS)
    df = table(spark, [(1, "a b"), (2, None)])
    assert rows_of(repeats.cut_spans(df, none).select("doc_id", "text").where("text is not null")) == [(1, "a b")]
