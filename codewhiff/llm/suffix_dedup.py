"""Repeated passages by a distributed suffix array with the difference-cover algorithm (operator 2)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import repeats as R

GRAM = 10
BASE = 1 << 20  # symbols up to which one task sorts the suffixes
GROUP = 1 << 19  # suffixes of a sorting task
MOST_GROUPS = 1 << 16  # so that splitters and counts of groups, on the driver and in the tasks, are a few MB at most
SAMPLES = 1 << 20  # suffixes at most that splitters are chosen from
PER_BLOCK = 32
BLOCK_WORDS = 1 << 20
WORD = np.uint64(1 << 47)  # words are above this, ends of segments below
ORDERED = "part int, blob binary, n long, distinct long, first array<long>, last array<long>"
TEXT = "blk int, blob binary, n long"
RANKS = "blk int, ranks binary"
WINDOWS = "part int, blob binary, n long, first array<long>, last array<long>"
SEGMENT_RUNS = "code long, check long, lead_start int, doc_id long, start int, n int, src_doc long, src_start int"


def pair_rank(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair of non-negative integers, in the order of the pairs."""
    width = int(b.max()) + 1 if len(b) else 1
    if len(a) and (int(a.max()) + 1) * width >= 1 << 62:
        a = np.unique(a, return_inverse=True)[1]
        b = np.unique(b, return_inverse=True)[1]
        width = int(b.max()) + 1
    return a.astype(np.int64) * width + b.astype(np.int64)


def difference_cover(s: np.ndarray) -> np.ndarray:
    """The suffix array of ``s`` (integers from 1 on): the suffixes' starts in lexicographic order.

    Sorts the triples at starts i with i mod 3 in {1, 2}, recurses on their names unless all differ, sorts the
    remaining suffixes by (symbol, rank of the next start), and merges both.
    """
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), dtype=np.int64)
    t = np.r_[s.astype(np.int64), 0, 0, 0]
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)  # n mod 3 = 1: a dummy start n, for merging
    sample = np.r_[one, two]
    triple = pair_rank(pair_rank(t[sample], t[sample + 1]), t[sample + 2])
    distinct, name = np.unique(triple, return_inverse=True)
    if len(distinct) < len(sample):
        order = difference_cover(name + 1)
        sorted_sample = sample[order]
    else:
        sorted_sample = np.empty(len(sample), dtype=np.int64)
        sorted_sample[name] = sample
    rank = np.zeros(n + 3, dtype=np.int64)
    rank[sorted_sample] = np.arange(1, len(sample) + 1)
    sorted_sample = sorted_sample[sorted_sample < n]
    zero = np.arange(0, n, 3)
    key = pair_rank(t[:n], rank[1 : n + 1])  # compares starts of class 0 and 1
    key2 = pair_rank(pair_rank(t[:n], t[1 : n + 1]), rank[2 : n + 2])  # compares starts of class 0 and 2
    zero = zero[np.argsort(key[zero], kind="stable")]
    kind = sorted_sample % 3
    ones, twos = sorted_sample[kind == 1], sorted_sample[kind == 2]
    place = np.arange(len(zero)) + np.searchsorted(key[ones], key[zero]) + np.searchsorted(key2[twos], key2[zero])
    out = np.empty(n, dtype=np.int64)
    free = np.ones(n, dtype=bool)
    free[place] = False
    out[place] = zero
    out[free] = sorted_sample
    return out


# == the distributed suffix array
#
# A text is a table of blocks (blk, blob, n): the words of some segments, each followed by an end of its own. No comparison goes
# beyond an end, so that a block needs nothing of the next one, and the names of a block's triples, those of class 1
# and then those of class 2, are a block of the next level's text. There blobs hold numbers only.


def _send(x: np.ndarray, wide: bool) -> tuple[np.ndarray, ...]:
    return C.pack48(x.astype(np.uint64)) if wide else (x.astype(np.uint32),)


def _got(arrays: list[np.ndarray], wide: bool) -> np.ndarray:
    """The next number array, taken off the list."""
    return C.unpack48(arrays.pop(0), arrays.pop(0)) if wide else arrays.pop(0).astype(np.uint64)


def _symbols(blk: int, blob: bytes, level: int, wide: bool) -> np.ndarray:
    arrays = C.unpack(blob)
    if level:
        return _got(arrays, wide)
    words, n = C.unpack48(arrays[0], arrays[1]), arrays[2].astype(np.int64)
    out = np.empty(len(words) + len(n), dtype=np.uint64)
    ends = np.cumsum(n + 1) - 1
    out[np.arange(len(words)) + np.repeat(np.arange(len(n)), n)] = words
    out[ends] = np.uint64(blk << 24) + np.arange(len(n), dtype=np.uint64)
    return out


def _place(keys: list[np.ndarray], split: list[np.ndarray]) -> np.ndarray:
    """Of each key, how many of the sorted ``split`` are not above it; keys and splitters are lists of columns."""
    lo = np.searchsorted(split[0], keys[0], side="left")
    hi = np.searchsorted(split[0], keys[0], side="right")
    open_ = np.flatnonzero(lo < hi)
    while len(open_):
        mid = (lo[open_] + hi[open_]) // 2
        above = np.zeros(len(open_), dtype=bool)  # whether the splitter is above the key
        same = np.ones(len(open_), dtype=bool)
        for k, s in zip(keys, split):
            a, b = k[open_], s[mid]
            above |= same & (b > a)
            same &= a == b
        hi[open_] = np.where(above, mid, hi[open_])
        lo[open_] = np.where(above, lo[open_], mid + 1)
        open_ = open_[lo[open_] < hi[open_]]
    return lo


def _quantiles(columns: list[np.ndarray], parts: int) -> list[np.ndarray]:
    """Of sorted columns, the rows that cut them into about equal parts."""
    n = len(columns[0])
    at = np.unique((np.arange(1, parts) * n) // parts) if n else np.zeros(0, dtype=np.int64)
    return [c[at] for c in columns]


def _groups(n: int) -> int:
    return int(min(MOST_GROUPS, max(2, -(-n // GROUP))))


def _names(text: DataFrame, n: int, blocks: int, level: int, wide: bool, length: int):
    """The next level's text: the names of all triples of class 1 and 2, in the order of these. Returns it, how many triples and names
    there are, whether its numbers are wide, and sampled suffixes (symbol, blk, i) of class 1.

    Triples of a level span three times the words of those before. When they span ``length`` words, equal ones get names of their own, in any order.
    """
    last = 3 ** (level + 1) >= length
    per, step = max(1, min(PER_BLOCK, SAMPLES // blocks)), -(-blocks // SAMPLES)

    def triples(blk, blob):
        t = np.r_[_symbols(blk, blob, level, wide), np.zeros(2, np.uint64)]
        pos = np.arange(len(t) - 2)
        pos = pos[pos % 3 > 0]
        return t[pos], t[pos + 1], t[pos + 2], pos

    def sample(batches):
        for batch in batches:
            for blk, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if blk % step:
                    continue
                columns = triples(blk, blob.as_py())
                m = len(columns[3])
                at = np.unique((np.arange(per) * m) // per + (blk * 7919) % max(1, m // per)) if m else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([*[pa.array(c[at].astype(np.int64)) for c in columns[:3]], pa.array(np.full(len(at), blk)), pa.array(columns[3][at])], names=["a", "b", "c", "blk", "i"])

    picked = text.select("blk", "blob").mapInArrow(sample, "a long, b long, c long, blk long, i long").toPandas()
    columns = [picked[c].to_numpy().astype(np.uint64) for c in ("a", "b", "c", "blk", "i")]
    order = np.lexsort(columns[::-1])
    split = _quantiles([c[order] for c in columns], _groups(2 * n // 3))
    parts = len(split[0]) + 1
    first_class = columns[4] % np.uint64(3) == 1
    ones = [columns[c][first_class].astype(np.int64) for c in (0, 3, 4)]

    def spread(batches):
        for batch in batches:
            for blk, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                a, b, c, pos = triples(blk, blob.as_py())
                p = _place([a, b, c, np.full(len(pos), blk, np.uint64), pos.astype(np.uint64)], split)
                yield C.block_batch([(q, C.pack(np.array([blk], np.int32), *_send(x, wide), *_send(y, wide), *_send(z, wide), i.astype(np.uint32))) for q, (x, y, z, i) in C.split_by(p, parts, a, b, c, pos)])

    def sort(key, table):
        found = []
        for blk, *arrays in C.blocks_of(table):
            found.append([*[_got(arrays, wide) for _ in range(3)], arrays[0], np.full(len(arrays[0]), blk[0], np.int32)])
        a, b, c, i, blk = C.joined(found)
        order = np.lexsort((c, b, a))
        a, b, c, i, blk = a[order], b[order], c[order], i[order], blk[order]
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])]
        name = np.arange(1, len(i) + 1, dtype=np.uint32) if last else np.cumsum(new).astype(np.uint32)
        ends = [[int(x[k]) for x in (a, b, c)] for k in (0, -1)]
        return pa.table([[key[0].as_py()], [C.pack(i, blk, name)], [len(i)], [int(name[-1])], [ends[0]], [ends[1]]], schema=_arrow(ORDERED))

    ordered = C.written(text.select("blk", "blob").mapInArrow(spread, C.BLOCK_DDL).groupBy("part").applyInArrow(sort, ORDERED), "triples")
    offset, names, before, total = {}, 0, None, 0
    for row in sorted(ordered.drop("blob").collect(), key=lambda r: r.part):  # cumulative counts; a triple may go on in the next group
        goes_on = not last and row["first"] == before
        offset[row.part] = names - goes_on
        names += row.distinct - goes_on
        before, total = row["last"], total + row.n
    out_wide = names >= 1 << 32

    def home(batches):
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                i, blk, name = C.unpack(blob.as_py())
                name = name.astype(np.uint64) + np.uint64(offset[part])
                yield C.block_batch([(q, C.pack(x, *_send(y, out_wide))) for q, (x, y) in C.split_by(blk, 1 << 24, i, name)])

    def assemble(key, table):
        i, name = _positions(table, out_wide)
        name = name[np.lexsort((i, i % 3))]
        return pa.table([pa.array([key[0].as_py()], pa.int32()), [C.pack(*_send(name, out_wide))], [len(name)]], schema=_arrow(TEXT))

    named = C.written(ordered.select("part", "blob").mapInArrow(home, C.BLOCK_DDL).groupBy("part").applyInArrow(assemble, TEXT), "names", ordered)
    return named, total, names, out_wide, ones


def _positions(table: pa.Table, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    found = []
    for i, *arrays in C.blocks_of(table):
        found.append([i.astype(np.int64), _got(arrays, wide)])
    return tuple(C.joined(found))


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split(" ") for x in ddl.split(", "))])


def _merged(text: DataFrame, ranks: DataFrame, ones: list[np.ndarray], n: int, level: int, wide: bool, rank_wide: bool, length: int = 0):
    """All suffixes in order, from the order of those of class 1 and 2: exchanged between splitters of class 1, and merged in each group.

    A row (part, blob, n) has the places (i, blk) of its suffixes in order. With ``length`` it has those suffixes only that
    have as many words, as :func:`_windows` gives them.
    """
    wanted: dict[int, tuple[list[int], list[int]]] = {}
    for a, blk, i in zip(*(x.tolist() for x in ones)):
        wanted.setdefault(blk, ([], []))[0].append(i)
        wanted[blk][1].append(a)

    def look_up(batches):
        for batch in batches:
            for blk, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if blk in wanted:
                    r = _got(C.unpack(blob.as_py()), rank_wide)
                    i, a = map(np.array, wanted[blk])
                    after = -(-len(r) // 2) + (i - 1) // 3
                    r1 = np.where(after < len(r), r[np.minimum(after, len(r) - 1)], np.uint64(0))
                    yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (r[(i - 1) // 3], a, r1)], names=["r", "a", "r1"])

    found = ranks.mapInArrow(look_up, "r long, a long, r1 long").toPandas()
    columns = [found[c].to_numpy().astype(np.uint64) for c in ("r", "a", "r1")]
    order = np.argsort(columns[0])
    by_rank, by_symbol, by_next = _quantiles([c[order] for c in columns], _groups(n))
    parts = len(by_rank) + 1

    def spread(batches):
        for batch in batches:
            for blk, blob, ranked in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                sym = _symbols(blk, blob.as_py(), level, wide)
                m = len(sym)
                t = np.r_[sym, np.zeros(3, np.uint64)]
                r = np.zeros(m + 3, dtype=np.uint64)
                if ranked.is_valid:
                    r[np.r_[np.arange(1, m, 3), np.arange(2, m, 3)]] = _got(C.unpack(ranked.as_py()), rank_wide)
                pos = np.arange(m)
                if length:
                    n_, doc, start = C.unpack(blob.as_py())[2:5]
                    first = np.r_[0, np.cumsum(n_.astype(np.int64) + 1)]
                    left = np.repeat(first[1:] - 1, n_ + 1) - pos
                    pos = pos[left >= length]
                    mark = _fingerprints(sym, length)
                rows = []
                for kind in range(3):
                    mine = pos[pos % 3 == kind]
                    near = r[mine + 1] if kind < 2 else r[mine + 2]
                    if kind:
                        p = np.searchsorted(by_rank, r[mine], side="right")
                    else:
                        p = _place([t[mine], near], [by_symbol, by_next])
                    for q, (i,) in C.split_by(p, parts, mine):
                        arrays = [np.array([kind, blk], np.int32), i.astype(np.uint32), *_send(t[i], wide)]
                        if kind != 1:
                            arrays += _send(t[i + 1], wide)
                        if kind != 2:
                            arrays += _send(r[i + 1], rank_wide)
                        if kind != 1:
                            arrays += _send(r[i + 2], rank_wide)
                        if kind:
                            arrays += _send(r[i], rank_wide)
                        if length:
                            seg = np.unique(np.searchsorted(first, i, side="right") - 1)
                            arrays += [mark[i], first[seg].astype(np.uint32), doc[seg], start[seg]]
                        rows.append((q, C.pack(*arrays)))
                yield C.block_batch(rows)

    def merge(key, table):
        kinds: list[list[list[np.ndarray]]] = [[], [], []]
        for head, i, *arrays in C.blocks_of(table):
            kind = int(head[0])
            one = [i, np.full(len(i), head[1], np.int32), _got(arrays, wide)]
            one.append(_got(arrays, wide) if kind != 1 else np.zeros(0, np.uint64))
            one.append(_got(arrays, rank_wide) if kind != 2 else np.zeros(0, np.uint64))
            one.append(_got(arrays, rank_wide) if kind != 1 else np.zeros(0, np.uint64))
            one.append(_got(arrays, rank_wide) if kind else np.zeros(0, np.uint64))
            if length:
                mark, first, doc, start = arrays
                seg = np.searchsorted(first, i, side="right") - 1
                one += [mark, doc[seg], (start[seg] + i.astype(np.int64) - first[seg].astype(np.int64)).astype(np.int32)]
            kinds[kind].append(one)
        none = [np.zeros(0, x) for x in (np.uint32, np.int32, *[np.uint64] * 6, np.int64, np.int32)]
        z, o, w = (C.joined(k) or none for k in kinds)
        key1 = pair_rank(np.r_[z[2], o[2]], np.r_[z[4], o[4]])
        key2 = pair_rank(pair_rank(np.r_[z[2], w[2]], np.r_[z[3], w[3]]), np.r_[z[5], w[5]])
        nz = len(z[0])
        zero = np.argsort(key1[:nz], kind="stable")
        place = np.arange(nz) + np.searchsorted(np.sort(key1[nz:]), key1[:nz][zero]) + np.searchsorted(np.sort(key2[nz:]), key2[:nz][zero])
        sampled = np.argsort(np.r_[o[6], w[6]], kind="stable")
        place = np.maximum.accumulate(place - np.arange(nz)) + np.arange(nz)  # suffixes that are equal as far as it matters have no order
        total = nz + len(sampled)
        out = np.empty(total, dtype=np.int64)
        free = np.ones(total, dtype=bool)
        free[place] = False
        out[place] = zero
        out[free] = sampled + nz
        i, blk = (np.r_[z[k], o[k], w[k]][out] for k in (0, 1))
        if length:
            mark, doc, at = (np.r_[z[k], o[k], w[k]][out] for k in (7, 8, 9))
            return _windows(key[0].as_py(), i, blk, mark, doc, at)
        return pa.table([[key[0].as_py()], [C.pack(i, blk)], [total]], schema=_arrow("part int, blob binary, n long"))

    both = text.select("blk", "blob").join(ranks, "blk", "left").mapInArrow(spread, C.BLOCK_DDL)
    return C.written(both.groupBy("part").applyInArrow(merge, WINDOWS if length else "part int, blob binary, n long"), "merged")


def _ranks(text: DataFrame, n: int, blocks: int, level: int, wide: bool, length: int) -> tuple[DataFrame, bool]:
    """``(blk, ranks)``: the rank of each suffix of a text, from 1, and whether the numbers are wide; suffixes with ``length`` equal words are in
    any order. The text is deleted."""
    if n <= BASE:

        def local(key, table):
            syms = [_symbols(b, x.as_py(), level, wide) for b, x in zip(table.column("blk").to_pylist(), table.column("blob"))]
            whole = np.unique(np.concatenate(syms), return_inverse=True)[1] + 1
            rank = np.empty(len(whole), dtype=np.uint64)
            rank[difference_cover(whole)] = np.arange(1, len(whole) + 1, dtype=np.uint64)
            cut = np.cumsum([0, *map(len, syms)])
            return pa.table([table.column("blk"), pa.array([C.pack(*_send(rank[a:b], wide)) for a, b in zip(cut, cut[1:])], pa.binary())], schema=_arrow(RANKS))

        return C.written(text.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(local, RANKS), "ranks", text), wide
    named, total, names, named_wide, ones = _names(text, n, blocks, level, wide, length)
    ranks, rank_wide = (named.select("blk", F.col("blob").alias("ranks")), named_wide) if names == total else _ranks(named, total, blocks, level + 1, named_wide, length)
    merged = _merged(text, ranks, ones, n, level, wide, rank_wide)
    C.drop(text, named if names == total else ranks)
    offset, done = {}, 0
    for row in sorted(merged.select("part", "n").collect(), key=lambda r: r.part):
        offset[row.part] = done
        done += row.n
    out_wide = n >= 1 << 32

    def home(batches):
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                i, blk = C.unpack(blob.as_py())
                rank = np.arange(1, len(i) + 1, dtype=np.uint64) + np.uint64(offset[part])
                yield C.block_batch([(q, C.pack(x, *_send(y, out_wide))) for q, (x, y) in C.split_by(blk, 1 << 24, i, rank)])

    def assemble(key, table):
        i, rank = _positions(table, out_wide)
        return pa.table([pa.array([key[0].as_py()], pa.int32()), [C.pack(*_send(rank[np.argsort(i)], out_wide))]], schema=_arrow(RANKS))

    return C.written(merged.select("part", "blob").mapInArrow(home, C.BLOCK_DDL).groupBy("part").applyInArrow(assemble, RANKS), "ranks", merged), out_wide


# == windows and runs


def _fingerprints(words: np.ndarray, length: int) -> np.ndarray:
    """A hash of the ``length`` words from each word on."""
    return R.word_grams(words, np.array([0, len(words)]), length)


def _windows(part: int, i: np.ndarray, blk: np.ndarray, mark: np.ndarray, doc: np.ndarray, at: np.ndarray) -> pa.Table:
    """Windows in the order of their suffixes: prefixes of neighbours are compared, and windows with equal ones are a group, whose source is its
    least (doc, position). The first and the last group may go on in other parts: (fingerprint, size, source doc, source position) of each."""
    new = np.r_[True, mark[1:] != mark[:-1]][: len(mark)]
    group = np.cumsum(new) - 1
    order = np.lexsort((at, doc, group))
    lead = order[np.flatnonzero(np.r_[True, group[order][1:] != group[order][:-1]])] if len(order) else order
    size = np.bincount(group) if len(group) else group
    edges = [[int(mark[k].view(np.int64)), int(size[g]), int(doc[lead[g]]), int(at[lead[g]])] if len(mark) else None for k, g in ((0, 0), (-1, -1))]
    keep = size[group] > 1
    if len(keep):
        keep |= (group == 0) | (group == group[-1])
    kept, number = np.unique(group[keep], return_inverse=True)
    return pa.table([pa.array([part], pa.int32()), [C.pack(i[keep], blk[keep], number.astype(np.uint32), doc[lead[kept]], at[lead[kept]])], [len(i)], [edges[0]], [edges[1]]], schema=_arrow(WINDOWS))


def _sorted_windows(text: DataFrame, n: int, blocks: int, length: int) -> DataFrame:
    """The windows of ``length`` words of a text in the order of its suffix array, as :func:`_windows` gives them."""
    if n <= BASE:

        def local(key, table):
            found = []
            for blk, blob in zip(table.column("blk").to_pylist(), table.column("blob")):
                sym = _symbols(blk, blob.as_py(), 0, True)
                n_, doc, start = C.unpack(blob.as_py())[2:5]
                n_ = n_.astype(np.int64)
                first = np.r_[0, np.cumsum(n_ + 1)]
                seg = np.repeat(np.arange(len(n_)), n_ + 1)
                i = np.arange(len(sym))
                found.append([sym, i, np.full(len(sym), blk), doc[seg], start[seg] + i - first[seg], first[seg] + n_[seg] - i >= length, _fingerprints(sym, length)])
            sym, i, blk, doc, at, ok, mark = C.joined(found)
            order = difference_cover(np.unique(sym, return_inverse=True)[1] + 1)
            order = order[ok[order]]
            return _windows(0, i[order].astype(np.uint32), blk[order].astype(np.int32), mark[order], doc[order], at[order].astype(np.int32))

        return C.written(text.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(local, WINDOWS), "windows")
    named, total, names, named_wide, ones = _names(text, n, blocks, 0, True, length)
    ranks, rank_wide = (named.select("blk", F.col("blob").alias("ranks")), named_wide) if names == total else _ranks(named, total, blocks, 1, named_wide, length)
    windows = _merged(text, ranks, ones, n, 0, True, rank_wide, length)
    C.drop(named if names == total else ranks)
    return windows


def _sources(windows: DataFrame) -> DataFrame:
    """Blocks (blk, [i, position of the source, number of its document, documents]) of the windows that have others like them."""
    mend: dict[int, list] = {}  # of each part, what its first and its last group are with those that they go on in
    chain: list[tuple[int, int]] = []
    edge: list = []

    def close() -> None:
        for part, end in chain:
            mend.setdefault(part, [None, None])[end] = tuple(edge[1:])

    for row in sorted(windows.where("n > 0").drop("blob").collect(), key=lambda r: r.part):
        if edge and edge[0] == row["first"][0]:
            edge[1] += row["first"][1]
            edge[2:] = min(edge[2:], row["first"][2:])
        else:
            close()
            chain, edge = [], list(row["first"])
        chain.append((row.part, 0))
        if row["first"][1] < row.n:
            close()
            chain, edge = [], list(row["last"])
        chain.append((row.part, 1))
    close()

    def route(batches):
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                i, blk, group, doc, at = C.unpack(blob.as_py())
                size = np.full(len(doc), 2)
                doc, at = doc.copy(), at.copy()
                for g, known in zip((0, -1), mend[part]):
                    size[g], doc[g], at[g] = known
                ok = size[group] > 1
                rows = []
                for q, (x, y) in C.split_by(blk[ok], 1 << 24, i[ok], group[ok]):
                    used, number = np.unique(doc[y], return_inverse=True)
                    rows.append((q, C.pack(x, at[y].astype(np.int32), number.astype(np.uint32), used)))
                yield C.block_batch(rows)

    return windows.where("n > 0").select("part", "blob").mapInArrow(route, C.BLOCK_DDL)


def _runs(text: DataFrame, sources: DataFrame, length: int) -> DataFrame:
    """Runs of windows whose sources follow each other, of each segment; those that are their own source only of segments that occur again."""

    def directory(batches):
        for batch in batches:
            yield C.block_batch([(blk, C.pack(*C.unpack(blob.as_py())[2:])) for blk, blob in zip(batch.column(0).to_pylist(), batch.column(1))])

    def finish(key, table):
        blocks = C.blocks_of(table)
        n, doc, start, code, check, again = next(b for b in blocks if len(b) == 6)
        n = n.astype(np.int64)
        first = np.r_[0, np.cumsum(n + 1)]
        seg = np.repeat(np.arange(len(n)), n + 1)
        i = np.arange(len(seg))
        at = start[seg] + i - first[seg]
        src_doc, src = doc[seg], at.copy()
        for x, y, number, used in (b for b in blocks if len(b) == 4):
            src_doc[x], src[x] = used[number], y
        ok = (first[seg] + n[seg] - i >= length) & ((again[seg] > 0) | (src_doc != doc[seg]) | (src != at))
        i, seg, at, src_doc, src = i[ok], seg[ok], at[ok], src_doc[ok], src[ok]
        new = np.ones(len(i), dtype=bool)
        new[1:] = (i[1:] != i[:-1] + 1) | (seg[1:] != seg[:-1]) | (src_doc[1:] != src_doc[:-1]) | (src[1:] != src[:-1] + 1)
        cut = np.flatnonzero(new)
        s, m = seg[cut], np.diff(np.r_[cut, len(i)])
        columns = [code[s], check[s], start[s], doc[s], at[cut].astype(np.int32), m.astype(np.int32), src_doc[cut], src[cut].astype(np.int32)]
        return pa.table([pa.array(c) for c in columns], schema=_arrow(SEGMENT_RUNS))

    return text.select("blk", "blob").mapInArrow(directory, C.BLOCK_DDL).unionByName(sources).groupBy("part").applyInArrow(finish, SEGMENT_RUNS)


def suffix_array_dedup(df: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of at least ``length`` words that occur before: ``(doc_id, start_word, n_words, src_doc_id, src_word)``.

    Words are runs without ASCII white space. Of equal windows of ``length`` words, the one of least (doc_id, position)
    is the source; all others are repeated, and the spans that these cover are returned, with the
    source of their first window.

    1. Segments: the parts of texts whose windows have a minimiser that occurs more than once (:func:`repeats.repeated_anchors`); no other window
       can be repeated. Equal segments enter the text once, with their least (doc_id, position).
    2. One suffix array over all segments, by the difference cover in rounds of Spark jobs: triples at starts of class 1 and 2 are sorted
       between sampled splitters and named by cumulative counts; unless all names differ, the names are the next round's
       text; then the suffixes of class 0 are merged with those (:func:`_names`, :func:`_ranks`, :func:`_merged`). The recursion ends
       where a triple of names spans ``length`` words, as no more are compared, so that its depth doesn't grow with the texts. A text of at most
       ``BASE`` symbols is sorted by one task. Splitters are whole suffixes, so that a frequent one is divided among tasks.
    3. Neighbours whose first ``length`` words are equal are a group; a group may go on through any number of tasks.

    Words are told apart by 47 bits of a hash, and prefixes of neighbours by 63 bits over all their words.

    Null ids and null texts take no part, nor do texts of fewer words. Very long texts are read whole, in pieces. Repeated rows count once; an id with
    several texts has the spans of all. Of equal windows the least (doc_id, position) wins, so that ties don't arise. Other columns are ignored. No
    rows in, none out.
    """
    C.ship(df.sparkSession)
    docs = R.documents(df, id_col, text_col)
    anchors = C.written(R.repeated_anchors(docs, length, GRAM), "anchors")

    def cut(batches):
        for batch in batches:
            ids = np.asarray(batch.column(0), dtype=np.int64)
            for row, h, first, low, ok in R.candidate_windows(batch.column(1), batch.column(2), length, GRAM):
                a, b, d = R.segments(ok, first, length)
                if not len(a):
                    continue
                words = (h >> np.uint64(17)) | WORD
                place = np.arange(int((b - a).sum())) - np.repeat(np.cumsum(b - a) - (b - a), b - a)
                flat = words[place + np.repeat(a, b - a)]
                at = np.r_[0, np.cumsum(b - a)[:-1]]
                codes = [np.add.reduceat(C.mix(flat * np.uint64(k) + place.astype(np.uint64) * np.uint64(m)), at).view(np.int64) for k, m in ((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD))]
                start = a - first[d]
                order = np.lexsort((start, ids[row + d], *codes))
                again = np.ones(len(order), dtype=bool)  # of equal segments here, the words of the least place are enough
                again[0] = False
                again[1:] = (codes[0][order][1:] == codes[0][order][:-1]) & (codes[1][order][1:] == codes[1][order][:-1])
                again[order] = again.copy()
                blobs = [None if g else b"".join(v.tobytes() for v in C.pack48(words[x:y])) for x, y, g in zip(a.tolist(), b.tolist(), again.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(ids[row + d]), pa.array(start.astype(np.int32)), *map(pa.array, codes), pa.array(blobs, pa.binary())], names=["doc_id", "start", "code", "check", "words"])

    segments = C.written(R.with_anchors(docs, anchors).mapInArrow(cut, "doc_id long, start int, code long, check long, words binary"), "segments", anchors)
    place = F.struct("doc_id", "start")
    places = C.written(segments.select("doc_id", "start", "code", "check").distinct(), "places")
    leads = C.written(places.groupBy("code", "check").agg(F.min(place).alias("lead"), F.count("*").alias("times")), "leads")
    chosen = segments.where("words is not null").join(leads.hint("shuffle_hash"), ["code", "check"]).where(place == F.col("lead")).select("code", "check", "doc_id", "start", (F.col("times") > 1).alias("again"), "words")
    spread = int(min(1 << 15, C.partitions_for(segments, 4 << 20)))

    def lay(batches):
        seq, held, size = 0, [], 0

        def flush():
            nonlocal seq, held, size
            code, check, doc, start, again, words = zip(*held)
            n = np.array([len(w) // 6 for w in words], dtype=np.int32)
            lo = np.frombuffer(b"".join(w[: 4 * k] for w, k in zip(words, n.tolist())), dtype=np.uint32)
            hi = np.frombuffer(b"".join(w[4 * k :] for w, k in zip(words, n.tolist())), dtype=np.uint16)
            blk = TaskContext.get().partitionId() * 256 + seq
            if seq > 255:
                raise ValueError("more than 256 blocks in a partition")
            blob = C.pack(lo, hi, n, np.array(doc, np.int64), np.array(start, np.int32), np.array(code, np.int64), np.array(check, np.int64), np.array(again, np.uint8))
            seq, held, size = seq + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array([blk], pa.int32()), pa.array([blob], pa.binary()), pa.array([len(lo) + len(n)], pa.int64())], names=["blk", "blob", "n"])

        last = None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:2] == last:  # a repeated row
                    continue
                last = row[:2]
                held.append(row)
                size += len(row[5]) // 6
                if size >= BLOCK_WORDS:
                    yield flush()
        if held:
            yield flush()

    text = C.written(chosen.repartition(spread, "code", "check").sortWithinPartitions("code", "check").mapInArrow(lay, TEXT), "text", segments)
    blocks, n = text.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n:
        return R.spans(docs.sparkSession.createDataFrame([], R.RUNS), length)
    windows = _sorted_windows(text, n, blocks, length)
    runs = C.written(_runs(text, _sources(windows), length), "segment-runs", windows, text)
    own = runs.select("doc_id", "start", "n", "src_doc", "src_start")
    others = places.join(leads.where("times > 1"), ["code", "check"]).where(place != F.col("lead")).select("code", "check", F.col("doc_id").alias("other"), F.col("start").alias("other_start"))
    copied = others.join(runs, ["code", "check"]).select(F.col("other").alias("doc_id"), (F.col("other_start") + F.col("start") - F.col("lead_start")).alias("start"), "n", "src_doc", "src_start")
    return R.spans(C.written(own.unionByName(copied).where("doc_id <> src_doc or start <> src_start"), "runs", runs, leads, places), length)


def suffix_array_stage(df: DataFrame, length: int = 50) -> DataFrame:
    """``df`` without its repeated spans: every one but the first occurrence is cut from its text."""
    return R.cut_spans(df, suffix_array_dedup(df, length))
