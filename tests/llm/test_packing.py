import itertools
import random
from collections import Counter, defaultdict

import pytest

from codewhiff.llm import packing as P
from helpers import table


def optimum(sizes, capacity):
    """Fewest bins, by trying all ways."""
    best = [len(sizes)]
    sizes = sorted(sizes, reverse=True)

    def go(i, free):
        if len(free) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(free)
            return
        for j in range(len(free)):
            if free[j] >= sizes[i] and free[j] not in free[:j]:
                go(i + 1, free[:j] + [free[j] - sizes[i]] + free[j + 1 :])
        go(i + 1, free + [capacity - sizes[i]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(40))
def test_optimal_on_small_sets(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 30, 100])
    sizes = [r.randrange(1, capacity + 1) if r.random() < 0.4 else r.randrange(1, capacity // 2 + 1) for _ in range(r.randrange(0, 11))]
    bins = P.bin_completion(sizes, capacity)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= capacity for b in bins)
    assert len(bins) == optimum(sizes, capacity)


def test_better_than_best_fit():
    # best-fit decreasing needs three bins here
    sizes, capacity = [6, 5, 4, 4, 3, 3, 3, 2], 15
    assert len(P.bin_completion(sizes, capacity)) == 2 <= len(P.best_fit(sizes, capacity))


@pytest.mark.parametrize("seed", range(20))
def test_fillings_are_all_that_are_undominated_fullest_first(seed):
    r = random.Random(seed)
    values = sorted(r.sample(range(1, 12), 5), reverse=True)
    counts = [r.randrange(3) for _ in values]
    room = r.randrange(5, 25)
    got = list(P.fillings(values, counts, room, 0))
    sums = [sum(values[at] * k for at, k in f) for f in got]
    assert sums == sorted(sums, reverse=True) and len({tuple(f) for f in got}) == len(got)
    want = set()
    for ks in itertools.product(*[range(n + 1) for n in counts]):
        total = sum(k * v for k, v in zip(ks, values))
        out = [v for v, k, n in zip(values, ks, counts) if k < n]
        if total <= room and not any(v <= room - total or any(k and c < v <= c + room - total for c, k in zip(values, ks)) for v in out):
            want.add(tuple((at, k) for at, k in enumerate(ks) if k))
    assert {tuple(f) for f in got} == want
    least = r.randrange(room)
    assert list(P.fillings(values, counts, room, least)) == [f for f, s in zip(got, sums) if s >= least]


def test_many_equal_sizes():
    sizes = [1] * 3000 + [2100] * 3 + [3000, 1500, 2596]
    bins = P.bin_completion(sizes, 4096)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= 4096 for b in bins)
    assert len(bins) == 5


def test_a_repeated_row_fills_no_group(spark):
    rows = [(7, "w")] * 1100 + [(7, "w " * 2100)] * 3 + [(8, "v")] * 40
    got = check(P.pack(table(spark, rows), group=100), rows, 4096)
    assert len({b.bin_id >> 32 for b in got}) > 5


def check(df, rows, capacity):
    got = df.collect()
    parts = defaultdict(list)
    for b in got:
        assert b.used == sum(b.sizes) <= capacity and b.waste == capacity - b.used
        for d, p, s in zip(b.doc_ids, b.parts, b.sizes):
            parts[d].append((p, s))
    assert len({b.bin_id for b in got}) == len(got)
    want = Counter()
    times = Counter()
    for i, t in rows:
        n = len(t.split()) if i is not None and t else 0
        if n:
            want[i] += n
            times[i] += 1
    assert {d: sum(s for _, s in ps) for d, ps in parts.items()} == dict(want)
    for d, ps in parts.items():
        if times[d] == 1:
            assert sorted(p for p, _ in ps) == list(range(len(ps)))
    return got


def test_every_word_is_packed_once(spark):
    r = random.Random(3)
    rows = [(i, "w " * r.choice([1, 3, 20, 50, 90, 100, 101, 250])) for i in range(300)]
    got = check(P.pack(table(spark, rows), capacity=100, group=60), rows, 100)
    total = sum(len(t.split()) for _, t in rows)
    assert len(got) <= 1.05 * total / 100 + 5
    again = P.pack(table(spark, rows[::-1]).repartition(7), capacity=100, group=60).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)


def test_odd_rows(spark):
    rows = [(1, None), (None, "a b"), (2, ""), (3, " \n "), (4, "a b c"), (4, "a b c"), (5, "x " * 100_000), (6, "y"), (7, "y")]
    check(P.pack(table(spark, rows, clash=True), capacity=64), rows, 64)
    assert P.pack(table(spark, [])).collect() == []
    assert P.pack(table(spark, [(1, None)])).collect() == []
