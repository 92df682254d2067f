"""Best-fit packing by bin completion (operator 5)."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

RESULT = "bin_id long, doc_ids array<long>, parts array<int>, sizes array<int>, used int, waste int"


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each size, largest first, into the fullest bin that it fits; indices of each bin."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (free, bin), sorted
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect.bisect_left(room, (sizes[i], -1))
        if at == len(room):
            bins.append([i])
            bisect.insort(room, (capacity - sizes[i], len(bins) - 1))
        else:
            free, b = room.pop(at)
            bins[b].append(i)
            bisect.insort(room, (free - sizes[i], b))
    return bins


def fillings(values: list[int], counts: list[int], room: int, least: int) -> Iterator[list[tuple[int, int]]]:
    """All undominated ways to fill ``room`` with at least ``least``, fullest first, as (number of the size, how often).

    ``values`` are the different sizes, largest first, and ``counts`` how often each is there. Sums that the sizes from each one on
    can reach are bit sets, so that the search for the fillings of a sum has no dead ends, and nothing is
    enumerated before it is asked for. A filling is dominated if a larger size left out could take the place of one in it, or just fits beside it.
    """
    bits = (1 << (room + 1)) - 1
    reach = [1]
    for v, n in zip(reversed(values), reversed(counts)):
        r, step = reach[-1], 1
        while n > 0 and v * step <= room:
            step = min(step, n)
            r |= (r << (v * step)) & bits
            n, step = n - step, step * 2
        reach.append(r)
    reach.reverse()
    for total in range(room, max(least, 0) - 1, -1):
        if not reach[0] >> total & 1:
            continue
        free = room - total
        stack: list[tuple[int, int, tuple | None]] = [(0, total, None)]
        while stack:
            at, left, chosen = stack.pop()
            if not left:
                taken = []
                while chosen:
                    taken.append(chosen[0])
                    chosen = chosen[1]
                if _undominated(values, counts, dict(taken), free):
                    yield taken[::-1]
                continue
            v = values[at]
            for k in range(min(counts[at], left // v) + 1):  # the last pushed, of most of the larger size, comes first
                if reach[at + 1] >> (left - k * v) & 1:
                    stack.append((at + 1, left - k * v, ((at, k), chosen) if k else chosen))


def _undominated(values: list[int], counts: list[int], taken: dict[int, int], free: int) -> bool:
    out = [v for at, v in enumerate(values) if counts[at] > taken.get(at, 0)]
    if out and out[-1] <= free:
        return False
    out.reverse()
    for at in taken:
        larger = bisect.bisect_right(out, values[at])
        if larger < len(out) and out[larger] <= values[at] + free:
            return False
    return True


def bin_completion(sizes: list[int], capacity: int, nodes: int = 2000) -> list[list[int]]:
    """Few bins for all sizes (each from 1 to ``capacity``): indices of each bin.

    Branch and bound: the largest size left starts a bin, and the undominated fillings around it are tried, fullest first.
    Best-fit decreasing completes each node and gives the incumbent. A node is pruned when its bins and the least number that
    the sizes left need, sum / capacity rounded up, can't beat it; a filling when its waste leaves no better solution. Equal
    sizes are one class. The result is optimal if the search ends within ``nodes`` nodes, and the incumbent otherwise.
    """
    values = sorted(set(sizes), reverse=True)
    number = {v: i for i, v in enumerate(values)}
    counts = [0] * len(values)
    for v in sizes:
        counts[number[v]] += 1
    best = [[sizes[i] for i in b] for b in best_fit(sizes, capacity)]
    least = -(-sum(sizes) // capacity)

    def node(counts: list[int], done: list[list[int]], total: int):
        head = next(i for i, n in enumerate(counts) if n)
        left = counts.copy()
        left[head] -= 1
        slack = (len(best) - 1 - len(done)) * capacity - total
        return left, done, total, head, fillings(values, left, capacity - values[head], capacity - values[head] - slack)

    stack = [node(counts, [], sum(sizes))] if sizes and len(best) > least else []
    while stack and nodes > 0 and len(best) > least:
        left, done, total, head, ways = stack[-1]
        way = next(ways, None)
        if way is None:
            stack.pop()
            continue
        nodes -= 1
        rest = left.copy()
        filled = [values[head]]
        for at, k in way:
            rest[at] -= k
            filled += [values[at]] * k
        now, still = [*done, filled], total - sum(filled)
        if len(now) + -(-still // capacity) >= len(best):
            continue
        open_ = [v for v, n in zip(values, rest) for _ in range(n)]
        greedy = best_fit(open_, capacity)
        if len(now) + len(greedy) < len(best):
            best = now + [[open_[i] for i in b] for b in greedy]
        if open_:
            stack.append(node(rest, now, still))
    waiting = {v: [] for v in values}
    for i in reversed(range(len(sizes))):
        waiting[sizes[i]].append(i)
    return [[waiting[v].pop() for v in b] for b in best]


def pack(df: DataFrame, capacity: int = 4096, group: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(bin_id, doc_ids, parts, sizes, used, waste)``: documents, by number of words, in bins of ``capacity``.

    A document larger than a bin fills whole bins with its first parts, and its last part is packed with the others; ``parts``
    numbers a document's parts from 0. Documents fall in groups of about ``group`` by a hash, and each group is packed by bin
    completion, so tasks need no more than ids and word counts. ``bin_id`` is unique and depends on the rows
    alone. Null ids, null texts and texts without a word aren't packed. Repeated rows are packed each, and fall in groups by their number
    among their like, so that no id fills a group. Very long texts are counted in pieces. Among documents of equal size the least id comes first, and bins of equal
    fullness are filled in the order they were opened. Other columns are ignored. No rows in, none out.
    """
    C.ship(df.sparkSession)

    def measure(batches):
        for batch in batches:
            n = np.zeros(batch.num_rows, dtype=np.int64)
            for at, piece in C.slices(batch.column(1)):
                n[at : at + len(piece)] = np.diff(C.tokens(piece)[1])
            ok = n > 0
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), pa.array(n[ok])], names=["doc_id", "n"])

    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null")
    alike = C.written(docs.mapInArrow(measure, "doc_id long, n long").groupBy("doc_id", "n").agg(F.count("*").alias("times")), "word-counts")
    groups = max(1, -(-int(alike.agg(F.sum("times")).first()[0] or 0) // group))
    each = alike.withColumn("nth", F.explode(F.sequence(F.lit(1), "times")))
    placed = each.select("doc_id", "n", F.pmod(F.xxhash64("doc_id", "n", "nth"), F.lit(groups)).alias("group"))
    tasks = min(groups, max(4 * df.sparkSession.sparkContext.defaultParallelism, groups // 64))

    def complete(key, table):
        doc, n = (np.asarray(table.column(c), dtype=np.int64) for c in ("doc_id", "n"))
        order = np.lexsort((n, doc))
        doc, n = doc[order].tolist(), n[order].tolist()
        items, bins = [], []
        for d, size in zip(doc, n):
            full, last = divmod(size, capacity)
            bins += [[(d, p, capacity)] for p in range(full)]
            if last:
                items.append((d, full, last))
        bins += [[items[i] for i in b] for b in bin_completion([x[2] for x in items], capacity)]
        base = key[0].as_py() << 32
        used = [sum(x[2] for x in b) for b in bins]
        return pa.table({
            "bin_id": pa.array([base + i for i in range(len(bins))], pa.int64()),
            "doc_ids": pa.array([[x[0] for x in b] for b in bins], pa.list_(pa.int64())),
            "parts": pa.array([[x[1] for x in b] for b in bins], pa.list_(pa.int32())),
            "sizes": pa.array([[x[2] for x in b] for b in bins], pa.list_(pa.int32())),
            "used": pa.array(used, pa.int32()),
            "waste": pa.array([capacity - u for u in used], pa.int32()),
        })

    return placed.repartition(tasks, "group").groupBy("group").applyInArrow(complete, RESULT)
