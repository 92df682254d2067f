import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codewhiff.llm import decontaminate as D
from helpers import prose, rows_of, table


def semi_global(pattern, text):
    """Least edit distance of the pattern to any part of the text, and the first end of such a part."""
    chars, steps = np.array([ord(c) for c in text], dtype=np.int64), np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, dtype=np.int64)
    for i, p in enumerate(pattern, 1):
        best = row + 1
        best[0] = i
        best[1:] = np.minimum(best[1:], row[:-1] + (chars != ord(p)))
        row = np.minimum.accumulate(best - steps) + steps  # steps to the right
    return int(row.min()), int(row.argmin())


@settings(max_examples=150, deadline=None)
@given(st.text("abc", min_size=1, max_size=90), st.text("abc", max_size=120))
def test_myers(pattern, text):
    assert D.myers(pattern, text) == semi_global(pattern, text)


def brute(docs, items, rate=0.1, least=10):
    out = {}
    for i, t in docs:
        for k, b in items:
            if i is None or t is None or k is None or not b or not b.strip():
                continue
            b = D.normal(b)
            d, end = semi_global(b, D.normal(t))
            if d <= D.budget(len(b), rate, least):
                out[i, k] = min(out.get((i, k), (d, end)), (d, end))
    return sorted((*key, *v) for key, v in out.items())


def bench_table(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def edited(r, text, n):
    chars = list(text)
    for _ in range(n):
        at = r.randrange(len(chars))
        r.choice([lambda: chars.insert(at, "q"), lambda: chars.pop(at), lambda: chars.__setitem__(at, "z")])()
    return "".join(chars)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    items = [(i, prose(r, r.randrange(3, 14))) for i in range(12)]
    docs = []
    for i in range(40):
        item = r.choice(items)[1]
        n = len(item) // 10
        hit = edited(r, item, r.choice([0, 1, n, n + 1, 2 * n + 2])) if i % 4 else ""
        docs.append((i, f"{prose(r, 8).upper()}\n {hit}  {prose(r, 8)}"))
    assert rows_of(D.find_contamination(table(spark, docs), bench_table(spark, items))) == brute(docs, items)


def test_odd_rows(spark):
    item = "the quick brown fox jumps over the lazy dog near the river bank"
    items = [(1, item), (1, item), (2, None), (None, item), (3, "  "), (4, "tiny"), (5, "ﬁne ünïcode itëm with several words")]
    docs = [(1, None), (None, item), (2, ""), (3, item), (3, item), (4, item.replace("quick", "quikc")), (5, "a tiny thing"), (6, "x" * 50_000 + " " + item), (7, "FINE"), (8, "so ﬁne ÜNÏCODE itëm with several words"), (3, item.replace("fox", "fax"))]
    assert rows_of(D.find_contamination(table(spark, docs, clash=True), bench_table(spark, items))) == brute(docs, items)
    assert rows_of(D.find_contamination(table(spark, docs), bench_table(spark, []))) == []
    assert rows_of(D.find_contamination(table(spark, []), bench_table(spark, items))) == []


def test_large_benchmarks_take_more_passes(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_CHARS", 60)
    r = random.Random(7)
    items = [(i, prose(r, 6)) for i in range(9)]
    docs = [(i, prose(r, 5) + " " + items[i][1]) for i in range(9)]
    assert rows_of(D.find_contamination(table(spark, docs), bench_table(spark, items))) == brute(docs, items)


def test_drop(spark):
    item = "what is the capital of the country that lies north of here"
    docs = [(1, "clean text"), (2, f"so {item} ok"), (None, item), (3, None)]
    out = D.drop_contaminated(table(spark, docs, clash=True), bench_table(spark, [(1, item)]))
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(1, "clean text"), (None, item), (3, None)], key=str)


def test_pieces_cover_the_item():
    for n in range(1, 60):
        for k in range(0, 5):
            got = D.pieces("x" * n, k)
            assert "".join(p for _, p in got) == "x" * n and len(got) == k + 1
