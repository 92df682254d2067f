"""Benchmark decontamination by pigeonhole edit matching (operator 3)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

HITS = "doc_id long, item_id long, distance int, end int"
BLOCK_CHARS = 8 << 20  # benchmark text in one automaton; a larger benchmark takes several passes over the documents


def normal(text: str) -> str:
    """Lower case, with each run of white space as one space."""
    return " ".join(text.lower().split())


def budget(length: int, rate: float, least_piece: int) -> int:
    """Edits allowed for an item: ``rate`` of its length, as far as all pieces keep ``least_piece`` characters."""
    return max(0, min(int(rate * length), length // least_piece - 1))


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """``k + 1`` pieces of nearly equal length, with their offsets. ``k`` edits leave one of them unchanged."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def unions(item: str, k: int) -> list[list[tuple[int, int, int]]]:
    """For each of the ``k + 1`` pieces, unions (begin, end, edits) of ever more neighbouring pieces that hold it, short of the whole.

    Pieces are halved again and again. Of a union of n pieces with fewer than n edits, one half has fewer edits than pieces too, so that
    from the whole item down to some piece without an edit, every union has at most n - 1 edits.
    """
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(k + 1)]

    def halve(i: int, j: int) -> None:
        if j - i > 1:
            halve(i, (i + j) // 2)
            halve((i + j) // 2, j)
            if j - i <= k:
                for leaf in range(i, j):
                    out[leaf].append((cuts[i], cuts[j], j - i - 1))

    halve(0, k + 1)
    return out


def bit_masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def myers(pattern: str, text: str, enough: int = -1, masks: dict[str, int] | None = None) -> tuple[int, int]:
    """(least edit distance of the pattern to any substring of the text, end of the first such substring), by Myers'
    bit-parallel recurrence with one integer for a column. It stops where a distance of ``enough`` is found."""
    m = len(pattern)
    masks = bit_masks(pattern) if masks is None else masks
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    get = masks.get
    for j, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
            if best <= enough:
                break
    return best, end


def find_contamination(df: DataFrame, benchmark: DataFrame, rate: float = 0.1, least_piece: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(doc_id, item_id, distance, end)``: the documents that hold a benchmark item within its error budget.

    Texts are compared in lower case with single spaces. An item of n characters may differ by k = rate * n edits
    (less if pieces would be shorter than ``least_piece``). It is split into k + 1 pieces, of which one must occur exactly; all
    pieces are found in one pass with an automaton. Around a hit Myers' algorithm first holds ever larger unions of pieces against their share of
    the budget (:func:`unions`), which chance hits fail at once, and then finds the least distance of the whole item. ``end``
    is where the first best match ends in the normal text.

    The benchmark is sent to the tasks in blocks of bounded size, one pass over the documents for each block, so that
    what is sent at once doesn't grow with it. Null ids and null or blank texts, of documents or items, take no part; repeated rows
    give one result; of several texts of an id the least distance counts. Other columns are ignored.
    """
    C.ship(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null")
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    out = None
    block: list[tuple[int, str]] = []
    size = 0
    blocks = []
    for row in items.orderBy("item_id", "text").toLocalIterator():
        block.append((row.item_id, normal(row.text)))
        size += len(row.text)
        if size >= BLOCK_CHARS:
            blocks.append(_scan(docs, block, rate, least_piece))
            block, size = [], 0
    if block or not blocks:
        blocks.append(_scan(docs, block, rate, least_piece))
    for one in blocks:
        out = one if out is None else out.unionByName(one)
    return out.groupBy("doc_id", "item_id").agg(F.min(F.struct("distance", "end")).alias("b")).select("doc_id", "item_id", "b.distance", "b.end")


def _scan(docs: DataFrame, items: list[tuple[int, str]], rate: float, least_piece: int) -> DataFrame:
    items = [(i, t) for i, t in items if t]
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches):
        import ahocorasick

        known, where = sent.value, {}
        for n, (_, text) in enumerate(known):
            k = budget(len(text), rate, least_piece)
            for (at, piece), around in zip(pieces(text, k), unions(text, k)):
                where.setdefault(piece, []).append((n, at, [(a - at, b - at, e, text[a:b], bit_masks(text[a:b])) for a, b, e in around]))
        automaton = ahocorasick.Automaton()
        for piece, spots in where.items():
            automaton.add_word(piece, (len(piece), spots))
        if where:
            automaton.make_automaton()
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if where else ():
                text = normal(text)
                hits: dict[int, list[tuple[int, int]]] = {}
                for last, (size, spots) in automaton.iter(text):
                    place = last + 1 - size
                    for n, at, around in spots:
                        if all(myers(union, text[max(0, place + a - e) : place + b + e], e, masks)[0] <= e for a, b, e, union, masks in around):
                            m = len(known[n][1])
                            k = budget(m, rate, least_piece)
                            hits.setdefault(n, []).append((place - at - k, place - at + m + k))
                for n, spans in hits.items():
                    item, text_ = known[n]
                    k = budget(len(text_), rate, least_piece)
                    best = None
                    for a, b in _merged(spans, len(text)):
                        d, end = myers(text_, text[a:b])
                        if d <= k and (best is None or (d, a + end) < best):
                            best = (d, a + end)
                    if best:
                        rows.append((doc, item, *best))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["doc_id", "item_id", "distance", "end"])

    return docs.mapInArrow(run, HITS)


def _merged(spans: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        a, b = max(0, a), min(size, b)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def drop_contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **kw) -> DataFrame:
    """The rows of ``df`` that hold no benchmark item; rows without an id stay."""
    found = find_contamination(df, benchmark, id_col=id_col, **kw).select(F.col("doc_id").alias("__dirty")).distinct()
    return df.join(found, df[id_col] == found["__dirty"], "left_anti")


__all__ = ["find_contamination", "drop_contaminated", "myers", "pieces", "budget"]
