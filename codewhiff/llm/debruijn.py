"""Repeated passages by compaction of the de Bruijn graph of word k-mers (operator 10)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import repeats as R

GRAM = 10
CHUNK_WORDS = 1 << 19
CHUNKS = "chunk long, blob binary"
PLACES = "key long, check long, doc_id long, start int, n int"


def de_bruijn_repeats(df: DataFrame, length: int = 50, k: int = 25, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of at least ``length`` words that occur before: ``(doc_id, start_word, n_words, src_doc_id, src_word)``, with
    the same meaning as those of the suffix array.

    1. Segments: the parts of texts whose windows have a repeated minimiser (:func:`repeats.repeated_anchors`), in chunks of about half a million words.
    2. Graph: each ``k`` words are an edge from their first ``k - 1`` to their last ``k - 1`` words. A node with more than one way
       in or out, counting the ends of segments as ways, is branching. One exchange by node finds these; a chunk sends each of its nodes
       once, with two of its ways where it has more, so that a frequent node is sent as often as there are chunks with it.
    3. Compaction: a join brings the branching nodes back to the chunks, and the path between two of them becomes
       one edge. Every text that enters such a path follows it to its end, so that each is compacted by itself.
    4. A window of ``length`` words is a place on a path and the paths that follow. Windows with equal places are repeated if what is at
       their source coordinates is equal: a 64-bit hash over all their words there, not over the graph. The least coordinates
       of a place are found by a partial aggregation and joined back.

    Nodes are told apart by 48 bits of a hash, where a clash makes a node branching and no more.

    Null ids and null texts take no part, nor do texts of fewer words. Very long texts are read whole, in pieces. Repeated rows count once; an id with
    several texts has the spans of all. Of equal windows the least (doc_id, position) wins. Other columns are ignored. No
    rows in, none out.
    """
    C.ship(df.sparkSession)
    docs = R.documents(df, id_col, text_col)
    anchors = C.written(R.repeated_anchors(docs, length, GRAM), "anchors")

    def cut(batches):
        held, size, seq = [], 0, TaskContext.get().partitionId() << 32

        def flush():
            nonlocal held, size, seq
            words, n, doc, start = C.joined(held)
            out = pa.RecordBatch.from_arrays([pa.array([seq], pa.int64()), pa.array([C.pack(*C.pack48(words), n, doc, start)], pa.binary())], names=["chunk", "blob"])
            held, size, seq = [], 0, seq + 1
            return out

        for batch in batches:
            ids = np.asarray(batch.column(0), dtype=np.int64)
            for row, h, first, low, ok in R.candidate_windows(batch.column(1), batch.column(2), length, GRAM):
                a, b, d = R.segments(ok, first, length)
                if not len(a):
                    continue
                n = b - a
                take = np.arange(int(n.sum())) + np.repeat(a - (np.cumsum(n) - n), n)
                held.append([h[take] >> np.uint64(16), n.astype(np.int32), ids[row + d], (a - first[d]).astype(np.int32)])
                size += len(take)
                if size >= CHUNK_WORDS:
                    yield flush()
        if held:
            yield flush()

    chunks = C.written(R.with_anchors(docs, anchors).mapInArrow(cut, CHUNKS), "chunks", anchors)  # repeated rows give equal segments, and later equal places
    parts = C.partitions_for(chunks, 1 << 20)
    low48 = np.uint64((1 << 48) - 1)

    def nodes(batches):
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                words, first, _, _ = _segments(blob.as_py())
                v = R.word_grams(words, first, k - 1)
                ok = v != R.TOP
                before = np.r_[np.uint64(0), words[:-1]]
                before[first[:-1]] = 0
                after = np.zeros(len(words), dtype=np.uint64)
                after[: max(0, len(words) - k + 1)] = words[k - 1 :]
                last = first[1:] - (k - 1)
                after[last[last >= 0]] = 0
                v, before, after = v[ok] & low48, *((x[ok] >> np.uint64(8)).astype(np.uint32) for x in (before, after))
                order = np.argsort(v, kind="stable")
                v, before, after = v[order], before[order], after[order]
                at = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
                least = [np.minimum.reduceat(x, at) for x in (before, after)]
                most = [np.maximum.reduceat(x, at) for x in (before, after)]
                more = (least[0] != most[0]) | (least[1] != most[1])
                v = v[at]
                v, before, after = np.r_[v, v[more]], *(np.r_[x, y[more]] for x, y in zip(least, most))
                yield C.block_batch([(p, C.pack(np.array([chunk]), *C.pack48(x), y, z)) for p, (x, y, z) in C.split_by(v % np.uint64(parts), parts, v, before, after)])

    def branching(table: pa.Table) -> pa.Table:
        blocks = C.blocks_of(table)
        v = np.concatenate([C.unpack48(b[1], b[2]) for b in blocks])
        before, after = (np.concatenate([b[i] for b in blocks]) for i in (3, 4))
        order = np.argsort(v, kind="stable")
        at = np.flatnonzero(np.r_[True, v[order][1:] != v[order][:-1]])
        fork = [np.minimum.reduceat(x[order], at) != np.maximum.reduceat(x[order], at) for x in (before, after)]
        forks = v[order][at][fork[0] | fork[1]]
        found = []
        for b in blocks:
            mine = C.unpack48(b[1], b[2])
            found.append((int(b[0][0]), np.unique(mine[np.isin(mine, forks)]).tobytes()))
        return pa.table([[c for c, f in found if f], pa.array([f for _, f in found if f], pa.binary())], schema=pa.schema([("chunk", pa.int64()), ("nodes", pa.binary())]))

    forks = chunks.mapInArrow(nodes, C.BLOCK_DDL).groupBy("part").applyInArrow(branching, "chunk long, nodes binary")
    forks = C.written(forks.groupBy("chunk").agg(F.collect_list("nodes").alias("forks")), "forks")  # at most the nodes of a chunk
    edges = length - k + 1

    def paths(batches):
        for batch in batches:
            for blob, known in zip(batch.column(0), batch.column(1)):
                words, first, doc, start = _segments(blob.as_py())
                forks = np.frombuffer(b"".join(known.as_py() or []), dtype=np.uint64)
                e = R.word_grams(words, first, k)
                begins = np.isin(R.word_grams(words, first, k - 1) & low48, forks)
                begins[first[:-1]] = True
                begins &= e != R.TOP
                path = np.cumsum(begins) - 1
                begin = np.flatnonzero(begins)  # a path begins at each fork; its first edge names it
                i = np.flatnonzero(np.repeat(first[1:], np.diff(first)) - np.arange(len(words)) >= length)
                if not len(i):
                    continue
                head, tail = path[i], path[i + edges - 1]
                at = np.flatnonzero(np.r_[True, (i[1:] != i[:-1] + 1) | (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])])
                n = np.diff(np.r_[at, len(i)])
                lo, a, b = i[at], head[at], tail[at]
                power, inverse = C._powers(len(words) + 1)
                names = np.r_[np.uint64(0), np.cumsum(C.mix(e[begin]) * power[: len(begin)])]
                text = np.r_[np.uint64(0), np.cumsum(C.mix(words) * power[: len(words)])]
                key = C.mix((names[b + 1] - names[a]) * inverse[a] + (lo - begin[a]).astype(np.uint64))
                check = C.mix((text[lo + n + length - 1] - text[lo]) * inverse[lo] + n.astype(np.uint64))
                seg = np.searchsorted(first, lo, side="right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(check.view(np.int64)), pa.array(doc[seg]), pa.array((start[seg] + lo - first[seg]).astype(np.int32)), pa.array(n.astype(np.int32))], names=["key", "check", "doc_id", "start", "n"])

    located = chunks.join(forks, "chunk", "left").select("blob", "forks")
    places = C.written(located.mapInArrow(paths, PLACES), "places", chunks, forks)
    least = places.groupBy("key", "check").agg(F.min(F.struct("doc_id", "start")).alias("src"), F.count("*").alias("times")).where("times > 1").drop("times")
    runs = places.join(least, ["key", "check"]).where("doc_id <> src.doc_id or start <> src.start").select("doc_id", "start", "n", F.col("src.doc_id").alias("src_doc"), F.col("src.start").alias("src_start"))
    return R.spans(runs, length)


def _segments(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, first word of each segment plus their number, documents and positions there."""
    lo, hi, n, doc, start = C.unpack(blob)
    return C.unpack48(lo, hi), np.r_[0, np.cumsum(n.astype(np.int64))], doc, start
