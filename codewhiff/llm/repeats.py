"""What the two substring operators share: candidates for repeated windows, spans from repeated windows, and cutting."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
RUNS = "doc_id long, start int, n int, src_doc long, src_start int"
SPANS = "doc_id long, start_word int, n_words int, src_doc_id long, src_word int"


def documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null")


def word_grams(h: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """A hash of the ``k`` words from each word on; the largest value where the row ends before."""
    out = np.full(len(h), TOP, dtype=np.uint64)
    if len(h) < k:
        return out
    acc = h[: len(h) - k + 1].copy()
    for j in range(1, k):
        acc *= np.uint64(0xD6E8FEB86659FD93)
        acc += h[j : len(h) - k + 1 + j]
    out[: len(acc)] = C.mix(acc) >> np.uint64(1)
    for back in range(1, k):
        at = first[1:] - back
        out[at[at >= 0]] = TOP
    return out


def window_minima(g: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` gram hashes, padded with the largest value to the length of ``g``."""
    out = np.full(len(g), TOP, dtype=np.uint64)
    m = C.sliding_min(g, w)
    out[: len(m)] = m
    return out


def repeated_anchors(docs: DataFrame, length: int, k: int) -> DataFrame:
    """``(doc_id, at)``: the word positions of those window minimisers that occur more than once, for each document.

    A window of ``length`` words has ``length - k + 1`` grams of ``k`` words. Equal windows have the same least gram
    hash at the same place, so a window whose least gram occurs once can't be repeated. Only
    these minimisers, about 2 of ``length - k + 2`` positions, are exchanged.
    """
    parts = C.partitions_for(docs, 32 << 20)
    w = length - k + 1

    def read(batches):
        for batch in batches:
            ids = np.asarray(batch.column(0), dtype=np.int64)
            found = []
            for at, piece in C.slices(batch.column(1)):
                h, first, _, _ = C.tokens(piece)
                g = word_grams(h, first, k)
                if len(g) < w:
                    continue
                low = C.sliding_min(g, w)
                padded = np.zeros(len(low) + 2 * (w - 1), dtype=np.uint64)
                padded[w - 1 : w - 1 + len(low)] = low
                best = TOP - C.sliding_min(TOP - padded, w)  # the largest minimum among the windows over each gram
                row = np.repeat(np.arange(len(piece)), np.diff(first))
                long_ = np.diff(first)[row] >= length
                pos = np.flatnonzero((best == g) & (g != TOP) & long_)
                found.append((g[pos] & np.uint64((1 << 48) - 1), at + row[pos], (pos - first[row[pos]]).astype(np.int32)))
            if not found:
                continue
            g, row, pos = map(np.concatenate, zip(*found))
            rows = []
            for p, (gp, rp, pp) in C.split_by(g % np.uint64(parts), parts, g, row, pos):
                used, inv = np.unique(rp, return_inverse=True)
                rows.append((p, C.pack(*C.pack48(gp), inv.astype(np.uint32), pp, ids[used])))
            yield C.block_batch(rows)

    def count(table: pa.Table) -> pa.Table:
        blocks = C.blocks_of(table)
        g = np.concatenate([C.unpack48(b[0], b[1]) for b in blocks])
        doc = np.concatenate([b[4][b[2]] for b in blocks])
        pos = np.concatenate([b[3] for b in blocks])
        order = np.argsort(g, kind="stable")
        g, doc, pos = g[order], doc[order], pos[order]
        new = np.r_[True, g[1:] != g[:-1]]
        many = ~(new & np.r_[new[1:], True])
        return pa.table({"doc_id": doc[many], "pos": pos[many]})

    hits = docs.mapInArrow(read, C.BLOCK_DDL).groupBy("part").applyInArrow(count, "doc_id long, pos int")
    return hits.groupBy("doc_id").agg(F.collect_set("pos").alias("at"))


def with_anchors(docs: DataFrame, anchors: DataFrame) -> DataFrame:
    """``(doc_id, text, at)`` of the documents that have repeated anchors. The anchors are the built side of a hash join,
    so texts are exchanged but not sorted."""
    return docs.join(anchors.hint("shuffle_hash"), "doc_id")


def candidate_windows(text: pa.Array, at: pa.Array, length: int, k: int):
    """For pieces of a column: (first row, words' hashes, first word of each row, least gram of each window, whether
    that gram is a repeated anchor)."""
    w = length - k + 1
    for row, piece in C.slices(text):
        h, first, _, _ = C.tokens(piece)
        g = word_grams(h, first, k)
        mine = at.slice(row, len(piece))
        n = np.asarray(pa.compute.list_value_length(mine), dtype=np.int64)
        pos = np.asarray(mine.flatten(), dtype=np.int64) + np.repeat(first[:-1], n)
        kept = np.full(len(g), TOP, dtype=np.uint64)
        pos = pos[pos < np.repeat(first[1:], n)]
        kept[pos] = g[pos]
        low = window_minima(g, w)
        left = np.repeat(first[1:], np.diff(first)) - np.arange(len(h))
        ok = (window_minima(kept, w) == low) & (low != TOP) & (left >= length)
        yield row, h, first, low, ok


def segments(ok: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, row) of the parts of texts that the windows ``ok`` cover; windows that overlap or touch are one part."""
    pos = np.flatnonzero(ok)
    doc = np.searchsorted(first, pos, side="right") - 1
    new = np.ones(len(pos), dtype=bool)
    new[1:] = (pos[1:] > pos[:-1] + length) | (doc[1:] != doc[:-1])
    last = np.r_[np.flatnonzero(new)[1:] - 1, len(pos) - 1] if len(pos) else pos
    return pos[new], pos[last] + length, doc[new]


def spans(runs: DataFrame, length: int) -> DataFrame:
    """Repeated windows, as runs of ``n`` windows from word ``start`` on, to the spans that they cover.

    Windows that overlap or touch make one span; its source is that of its first window.
    """
    order = Window.partitionBy("doc_id").orderBy("start", "n", "src_doc", "src_start")
    reach = F.max(F.col("start") + F.col("n") + F.lit(length - 1)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = runs.withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1))
    marked = marked.withColumn("span", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = marked.groupBy("doc_id", "span").agg(F.min("start").alias("start_word"), F.max(F.col("start") + F.col("n") + F.lit(length - 1)).alias("end"), F.min(F.struct("start", "src_doc", "src_start")).alias("s"))
    return out.select("doc_id", "start_word", (F.col("end") - F.col("start_word")).cast("int").alias("n_words"), F.col("s.src_doc").alias("src_doc_id"), F.col("s.src_start").alias("src_word"))


def as_runs(doc: np.ndarray, start: np.ndarray, src_doc: np.ndarray, src: np.ndarray) -> pa.Table:
    """Single windows to runs of windows that follow each other both here and at their source."""
    order = np.lexsort((start, doc))
    doc, start, src_doc, src = doc[order], start[order], src_doc[order], src[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1) | (src_doc[1:] != src_doc[:-1]) | (src[1:] != src[:-1] + 1)
    cut = np.flatnonzero(new)
    n = np.diff(np.r_[cut, len(doc)])
    return pa.table({"doc_id": doc[cut], "start": start[cut].astype(np.int32), "n": n.astype(np.int32), "src_doc": src_doc[cut], "src_start": src[cut].astype(np.int32)})


def cut_spans(df: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``df`` with the spans cut from its texts and the character count set anew; rows of which no word is left go.

    Rows without a span are unchanged, whatever they hold; of repeated rows each is cut. Columns may have any names.
    """
    C.ship(df.sparkSession)
    name = next(x for x in (f"spans{k}" for k in range(len(df.columns) + 1)) if x.lower() not in {c.lower() for c in df.columns})
    lists = found.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start_word", "n_words"))).alias(name)).withColumnRenamed("doc_id", f"{name}-of")
    both = df.join(lists.hint("shuffle_hash"), df[id_col] == lists[f"{name}-of"], "left")

    def cut(batches):
        for batch in batches:
            names = batch.schema.names
            at, text = names.index(name), batch.column(names.index(text_col))
            out = text.to_pylist()
            spans_ = batch.column(at)
            rows = np.flatnonzero(np.asarray(pa.compute.is_valid(spans_)))
            if len(rows):
                picked = text.take(pa.array(rows))
                for first_row, piece in C.slices(picked):
                    _, first, start, end = C.tokens(piece)
                    for i in range(len(piece)):
                        r = int(rows[first_row + i])
                        raw = piece[i].as_py().encode()
                        s = start[first[i] : first[i + 1]]
                        keep, last = [], 0
                        for span in spans_[r].as_py():
                            a, b = span["start_word"], span["start_word"] + span["n_words"]
                            if a >= len(s):
                                continue
                            keep.append(raw[last : s[a]])
                            last = int(s[b]) if b < len(s) else len(raw)
                        keep.append(raw[last:])
                        left = b"".join(keep).decode()
                        out[r] = left if left.strip() else None
            touched = np.zeros(len(out), dtype=bool)
            touched[rows] = True
            gone = np.array([x is None for x in out]) & touched if len(out) else touched
            cols = []
            for c in names[:at]:
                col = batch.column(names.index(c))
                if c == text_col:
                    col = pa.array(out, pa.string())
                elif c == length_col:
                    old = col.to_pylist()
                    col = pa.array([len(out[i]) if touched[i] and out[i] is not None else old[i] for i in range(len(out))], col.type)
                cols.append(col)
            yield pa.RecordBatch.from_arrays(cols, names=names[:at]).filter(pa.array(~gone))

    return both.select(*[df[c] for c in df.columns], lists[name]).mapInArrow(cut, df.schema)


def sql(length: int) -> str:
    """DuckDB SQL for the spans: each window of ``length`` words, but the first occurrence of its words, is repeated."""
    return rf"""
    WITH words AS (
      SELECT DISTINCT doc_id, regexp_extract_all(text, '[^\x09-\x0d\x20]+') AS t FROM documents
      WHERE doc_id IS NOT NULL AND text IS NOT NULL),
    windows AS (SELECT doc_id, i - 1 AS pos, md5(array_to_string(t[i : i + {length - 1}], ' ')) AS w
      FROM (SELECT doc_id, t, unnest(range(1, len(t) - {length - 2})) AS i FROM words WHERE len(t) >= {length})),
    sourced AS (SELECT DISTINCT w, doc_id, pos, first_value(doc_id) OVER o AS src_doc, first_value(pos) OVER o AS src_pos
      FROM windows WINDOW o AS (PARTITION BY w ORDER BY doc_id, pos)),
    again AS (SELECT * FROM sourced WHERE (doc_id, pos) <> (src_doc, src_pos)),
    marked AS (SELECT *, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + {length} THEN 0 ELSE 1 END AS new FROM again),
    islands AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS span FROM marked)
    SELECT doc_id, min(pos)::INT AS start_word, (max(pos) + {length} - min(pos))::INT AS n_words,
      arg_min(src_doc, pos) AS src_doc_id, arg_min(src_pos, pos)::INT AS src_word
    FROM islands GROUP BY doc_id, span"""
