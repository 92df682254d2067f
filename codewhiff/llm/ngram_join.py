"""Exact n-gram Jaccard self join over the Jaccard metric space (operator 1)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

LEAF = 256  # regions up to this many sets are compared directly
BLOCK = 2048  # regions above this are divided further, and what can't be divided is cut into pairs of blocks, each its own group
HOT = 256  # an n-gram of so many sets of one flush isn't exchanged set by set
NEVER = 65535  # the frequency that stands for such an n-gram
FEW = 1 << 18  # edges that one task connects
TINY = 1e-9
POINTS = "doc_id long, name long, size int, grams binary, window binary"


def ngram_jaccard_join(df: DataFrame, n: int = 3, threshold: float = 0.55, id_col: str = "doc_id", text_col: str = "text", bytes_each: int = 8 << 20) -> DataFrame:
    """``(doc_id, class_id, copy_of, n_links)`` of each id: documents whose sets of word n-grams are within Jaccard distance
    ``1 - threshold`` are linked.

    Documents with equal n-gram sets are one point of the space; ``copy_of`` is the least id of the point. ``n_links`` counts the
    other points within the distance, each of them, and ``class_id`` is the least id that links and copies connect with this one.

    1. One exchange by n-gram gives document frequencies; an n-gram that only one set has can't be shared, so a set
       with more of these than the distance allows is at a larger distance from every other set, and leaves. An n-gram that many sets of
       one flush have counts as frequent everywhere and isn't exchanged for each of them.
    2. Of each remaining set, the rarest n-grams are its window: two sets within the distance share one of these.
       Of the sets that share such an n-gram, the one of least hash is a pivot, and its region gets all of them; a set on the
       boundary, in several regions, is replicated to each. A pair that meets in several regions counts in the first.
    3. A region divides by balls around pivots (:class:`Region`): by the triangle inequality sets within half the distance of a pivot are
       all linked, sets further than one and a half from it are linked with none of these, and those between visit the ball.
       What is left recurses. Regions too large for a task divide so in rounds of Spark joins (:func:`_homes`), and what that
       can't divide is joined by pairs of blocks.

    Links are counted, never listed, and each task gives a spanning forest of its links, so what is exchanged grows with the sets.

    Null ids take no part; null texts and texts without a word are a class of their own without links; texts of fewer than ``n`` words
    have one n-gram; very long texts are read whole, in pieces. Repeated rows count once. An id with several texts is each of their points: it connects them,
    and has the links of all. Other columns are ignored. No rows in, none out.
    """
    C.ship(df.sparkSession)
    points = C.written(_points(df, n, threshold, id_col, text_col, bytes_each), "ngram-sets")
    used: list[DataFrame] = []
    near = C.written(_near(points.where("doc_id is null").drop("doc_id"), threshold, used), "near")
    C.drop(*used)
    members = points.where("doc_id is not null").select("doc_id", "name").distinct()
    several = members.groupBy("doc_id").agg(F.min("name").alias("u"), F.max("name").alias("v"), F.count("*").alias("n")).where("n > 1")
    tied = members.join(several.select("doc_id", "u"), "doc_id").where("u <> name").select("u", F.col("name").alias("v"))
    group = components(near.where("v is not null").select("u", "v").union(tied), "u", "v").toDF("name", "root")
    links = near.where("v is null").groupBy(F.col("u").alias("name")).agg(F.sum("n").alias("n_links"))
    each = members.groupBy("name").agg(F.min("doc_id").alias("copy_of")).join(group, "name", "left").join(links, "name", "left")
    each = C.written(each.select("name", "copy_of", F.coalesce("root", "name").alias("root"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "points", near)
    classes = each.groupBy("root").agg(F.min("copy_of").alias("class_id"))
    located = members.join(each.join(classes, "root"), "name")
    out = located.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.min("copy_of").alias("copy_of"), F.sum("n_links").alias("n_links"))
    return C.written(out, "classes", points, each)


def _need(size: np.ndarray, t: float) -> np.ndarray:
    """How many of a set's n-grams, rarest first, any set within the distance must share one of."""
    return size - np.ceil(t * size - TINY).astype(np.int64) + 1


def _points(df: DataFrame, n: int, t: float, id_col: str, text_col: str, bytes_each: int) -> DataFrame:
    """Two kinds of rows: (doc_id, name) of each document, and (name, size, grams, window) of each point that may be near another.

    A group is a range of n-gram hashes, of point names or of documents: the documents of a point needn't be in one.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    parts = C.partitions_for(docs, bytes_each)

    def place(h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)

    def read(batches):
        for batch in batches:
            ids = np.asarray(batch.column(0), dtype=np.int64)
            entries, names, sizes, held = [], [], [], 0
            own = C.mix(ids.view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D))  # of documents without a word
            for at, piece in C.slices(batch.column(1)):
                h, first, _, _ = C.tokens(piece, terms=True)
                g, gf = C.grams(h, first, n)
                if not len(g):
                    continue
                row = np.repeat(np.arange(len(piece), dtype=np.uint64), np.diff(gf))
                key = np.unique((row << np.uint64(48)) | (g >> np.uint64(16)))
                row, g = (key >> np.uint64(48)).astype(np.int64), key & np.uint64((1 << 48) - 1)
                cut = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                size = np.diff(np.r_[cut, len(row)])
                name = C.mix(np.add.reduceat(C.mix(g), cut) + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                entries.append((g, np.repeat(np.arange(len(name)) + sum(map(len, names)), size)))
                names.append(name)
                sizes.append(size)
                own[at + row[cut]] = name
                held += len(g)
                if held > 1 << 20:
                    yield flush(entries, names, sizes)
                    entries, names, sizes, held = [], [], [], 0
            if names:
                yield flush(entries, names, sizes)
            if len(ids):
                yield C.block_batch([(2 * parts + p, C.pack(*x)) for p, x in C.split_by(place(C.mix(ids.view(np.uint64))), parts, own, ids)])

    def flush(entries, names, sizes) -> pa.RecordBatch:
        name, size = map(np.concatenate, (names, sizes))
        g, who = map(np.concatenate, zip(*entries))
        lead = np.unique(name, return_index=True)[1]
        once = np.zeros(len(name), dtype=bool)
        once[lead] = True
        keep = once[who]
        g, who = g[keep], who[keep]
        order = np.argsort(g, kind="stable")
        g, who = g[order], who[order]
        cut = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        times = np.diff(np.r_[cut, len(g)])
        hot = np.repeat(times >= HOT, times)
        rows = []
        for p, (gp,) in C.split_by(place(g[cut[times >= HOT]] << np.uint64(16)), parts, g[cut[times >= HOT]]):
            rows.append((p, C.pack(*C.pack48(gp))))
        for p, (gp, wp) in C.split_by(place(name[who[hot]]), parts, g[hot], who[hot]):
            used, at = np.unique(wp, return_inverse=True)
            rows.append((parts + p, C.pack(*C.pack48(gp), np.full(len(gp), NEVER, np.uint16), at.astype(np.uint32), name[used])))
        g, who = g[~hot], who[~hot]
        for p, (gp, wp) in C.split_by(place(g << np.uint64(16)), parts, g, who):
            used, at = np.unique(wp, return_inverse=True)
            rows.append((p, C.pack(*C.pack48(gp), at.astype(np.uint16 if len(used) <= 1 << 16 else np.uint32), name[used])))
        for p, arrays in C.split_by(place(name[lead]), parts, name[lead], size[lead]):
            rows.append((parts + p, C.pack(*arrays)))
        return C.block_batch(rows)

    def count(key, table):
        part = key[0].as_py()
        if part >= parts:
            return pa.table({"part": pa.array([part - parts] * len(table), pa.int32()), "blob": table.column("blob")}, schema=C.BLOCK)
        blocks = C.blocks_of(table)
        hot = np.unique(np.concatenate([np.zeros(0, np.uint64), *[C.unpack48(*b) for b in blocks if len(b) == 2]]))
        blocks = [b for b in blocks if len(b) == 4]
        if not blocks:
            return C.BLOCK.empty_table()
        g = np.concatenate([C.unpack48(b[0], b[1]) for b in blocks])
        who = np.concatenate([b[3][b[2]] for b in blocks])
        order = np.argsort(g)
        g, who = g[order], who[order]
        new = np.r_[True, g[1:] != g[:-1]]
        many = ~(new & np.r_[new[1:], True]) | np.isin(g, hot)
        g, who = g[many], who[many]
        order = np.lexsort((who, g))
        g, who = g[order], who[order]
        keep = np.r_[True, (g[1:] != g[:-1]) | (who[1:] != who[:-1])][: len(g)]
        g, who = g[keep], who[keep]
        cut = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])[: len(g)]
        df_ = np.diff(np.r_[cut, len(g)])
        d = np.minimum(np.repeat(df_, df_), NEVER - 1).astype(np.uint16)
        d[np.isin(g, hot)] = NEVER
        ok = d > 1
        g, who, d = g[ok], who[ok], d[ok]
        rows = []
        for p, (gp, wp, dp) in C.split_by(place(who), parts, g, who, d):
            used, at = np.unique(wp, return_inverse=True)
            rows.append((p, C.pack(*C.pack48(gp), dp, at.astype(np.uint32), used)))
        return pa.Table.from_batches([C.block_batch(rows)])

    out = pa.schema([("doc_id", pa.int64()), ("name", pa.int64()), ("size", pa.int32()), ("grams", pa.binary()), ("window", pa.binary())])

    def build(key, table):
        blocks = C.blocks_of(table)
        if key[0].as_py() >= parts:
            name, ids = C.joined(blocks)
            return pa.table([ids, name.view(np.int64), *[pa.nulls(len(ids), f.type) for f in list(out)[2:]]], schema=out)
        name, size = C.joined([b for b in blocks if len(b) == 2])
        shared = [b for b in blocks if len(b) == 5]
        name, lead = np.unique(name, return_index=True)
        size = size[lead].astype(np.int64)
        g = np.concatenate([np.zeros(0, np.uint64), *[C.unpack48(b[0], b[1]) for b in shared]])
        d = np.concatenate([np.zeros(0, np.uint16), *[b[2] for b in shared]])
        who = np.searchsorted(name, np.concatenate([np.zeros(0, np.uint64), *[b[4][b[3]] for b in shared]]))
        order = np.lexsort((g, d, who))
        g, d, who = g[order], d[order], who[order]
        keep = np.r_[True, (g[1:] != g[:-1]) | (who[1:] != who[:-1])][: len(g)]  # frequent ones come from every flush with the set
        g, who = g[keep], who[keep]
        window = _need(size, t) - (size - np.bincount(who, minlength=len(name)))
        at = np.searchsorted(who, np.arange(len(name) + 1))
        res = []
        for i in np.flatnonzero(window > 0).tolist():
            mine = g[at[i] : at[i + 1]]
            res.append((None, int(name[i].view(np.int64)), int(size[i]), b"".join(x.tobytes() for x in C.pack48(np.sort(mine))), mine[: int(window[i])].tobytes()))
        return pa.table(list(map(list, zip(*res))) if res else [[] for _ in out], schema=out)

    return docs.mapInArrow(read, C.BLOCK_DDL).groupBy("part").applyInArrow(count, C.BLOCK_DDL).groupBy("part").applyInArrow(build, POINTS)


def _near(points: DataFrame, t: float, used: list[DataFrame]) -> DataFrame:
    """Rows (u, null, n): the point u has n more links; and (u, v, 0): links connect u and v. ``used`` gets the written tables it reads."""
    parts = C.partitions_for(points, 4 << 20)

    def spread(batches):
        for batch in batches:
            name = np.asarray(batch.column(0), dtype=np.int64).view(np.uint64)
            wins = [np.frombuffer(b.as_py(), dtype=np.uint64) for b in batch.column(1)]
            if not wins:
                continue
            g, who = np.concatenate(wins), np.repeat(name, list(map(len, wins)))
            yield C.block_batch([(p, C.pack(*x)) for p, x in C.split_by(((g >> np.uint64(16)) * np.uint64(parts)) >> np.uint64(32), parts, g, who)])

    def regions(table: pa.Table) -> pa.Table:
        g, who = C.joined(C.blocks_of(table))
        order = np.lexsort((who, g))
        g, who = g[order], who[order]
        cut = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        n = np.diff(np.r_[cut, len(g)])
        pivot = np.repeat(who[cut], n)  # names are hashes, so the first is the least of them
        ok = np.repeat(n > 1, n)
        both = np.unique(np.stack([pivot[ok], who[ok]], axis=1), axis=0).view(np.int64)
        return pa.table({"region": both[:, 0], "name": both[:, 1]})

    cells = points.select("name", "window").mapInArrow(spread, C.BLOCK_DDL).groupBy("part").applyInArrow(regions, "region long, name long")
    cells = cells.groupBy("name").agg(F.sort_array(F.collect_set("region")).alias("regions")).select("name", "regions", F.explode("regions").alias("region"))
    cells = C.written(cells.select("name", "region", F.filter("regions", lambda r: r < F.col("region")).alias("before")), "cells")
    used.append(cells)
    eps = 1.0 - t
    groups = C.partitions_for(points, 2 << 20)
    large = cells.groupBy("region").count().where(F.col("count") > BLOCK).select("region")
    homes = None
    if not large.isEmpty():
        homes = _homes(cells.join(large, "region"), points.select("name", "size", "grams"), eps)
        used.append(homes)
    if homes is None:
        placed = cells.select("*", F.lit(None).cast("long").alias("home"), *[F.lit(0).alias(c) for c in ("i", "j", "mine")])
    else:
        housed = cells.join(homes, "name", "left")
        sized = housed.groupBy("region", F.coalesce("home", F.lit(0)).alias("h")).count().withColumn("sub", F.explode(F.sequence(F.lit(0), F.floor((F.col("count") - 1) / BLOCK).cast("int"))))
        small = cells.groupBy("region").count().where(F.col("count") <= BLOCK).select("region", F.lit(True).alias("small"))
        blocks = sized.join(small, "region", "left_anti").select("region", "h", F.floor((F.col("count") - 1) / BLOCK + 1).cast("int").alias("subs"), "sub", (F.row_number().over(Window.partitionBy("region").orderBy("h", "sub")) - 1).alias("no"))
        blocks = C.written(blocks, "blocks")
        used.append(blocks)
        mine = housed.withColumn("h", F.coalesce("home", F.lit(0))).join(blocks.where("sub = 0").select("region", "h", "subs", F.col("no").alias("base")), ["region", "h"], "left")
        mine = mine.withColumn("mine", F.when(F.col("base").isNull(), 0).otherwise(F.col("base") + F.pmod(F.xxhash64("name"), F.col("subs"))).cast("int"))
        # two blocks of one home need not meet: all their pairs are links, which the home counts
        whole = mine.where("base is null").select("name", "region", "before", "home", *[F.lit(0).alias(c) for c in ("i", "j", "mine")])
        cut = mine.where("base is not null").alias("a").join(blocks.select("region", F.col("h").alias("with"), "no"), "region").where("h <> with or h = 0")
        placed = whole.unionByName(cut.select("name", "region", "before", "home", F.least("mine", "no").alias("i"), F.greatest("mine", "no").alias("j"), "mine"))
    NEAR = "u long, v long, n long"

    def join(table: pa.Table) -> pa.Table:
        key = np.stack([np.asarray(table.column(c), dtype=np.int64) for c in ("name", "mine", "j", "i", "region")])
        order = np.lexsort(key)
        key = key[2:, order]
        cut = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)]).tolist() + [len(order)]
        name = np.asarray(table.column("name"), dtype=np.int64)
        size, half = np.asarray(table.column("size"), dtype=np.int64), np.asarray(table.column("mine"), dtype=np.int64)
        blobs, before, home = (table.column(c).combine_chunks() for c in ("grams", "before", "home"))
        us, vs, ns = [], [], []
        for a, b in zip(cut, cut[1:]):
            if b - a < 2:
                continue
            rows = order[a:b]
            apart = []  # what two sets of this region have in common when their pair counts elsewhere
            for r in rows.tolist():
                mark = [("r", x) for x in before[r].as_py()]
                if home[r].is_valid:
                    mark.append(("h", home[r].as_py()))
                if key[0, a] != key[1, a]:
                    mark.append(("b", int(half[r])))
                apart.append(mark)
            region = Region([_grams(blobs[r].as_py()) for r in rows.tolist()], size[rows], eps, apart)
            links, u, v = region.join()
            some = np.flatnonzero(links)
            us += [name[rows[some]], name[rows[u]]]
            vs += [np.full(len(some), -1), name[rows[v]]]
            ns += [links[some], np.full(len(u), -1)]
        u, v, n = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (us, vs, ns))
        return pa.table({"u": u, "v": pa.array(v, mask=n >= 0), "n": np.maximum(n, 0)})

    located = placed.join(points.select("name", "size", "grams"), "name").withColumn("task", F.pmod(F.xxhash64("region", "i", "j"), F.lit(groups)))
    out = located.groupBy("task").applyInArrow(join, NEAR)
    if homes is None:
        return out
    at_home = homes.groupBy("home").count()
    certain = homes.join(at_home, "home").select(F.col("name").alias("u"), F.lit(None).cast("long").alias("v"), (F.col("count") - 1).alias("n")).where("n > 0")
    return out.unionByName(certain).unionByName(homes.where("home <> name").select(F.col("name").alias("u"), F.col("home").alias("v"), F.lit(0).cast("long").alias("n")))


def _homes(cells: DataFrame, sets: DataFrame, eps: float) -> DataFrame:
    """``(name, home)`` of the sets of large regions that are within ``eps / 2`` of a pivot, their home: all sets of a home are linked.

    In each round, the sets of a region that have no home yet get the one of least hash as pivot, as long as they are
    more than a block and the last round found homes for a twentieth of them.
    """

    def inner(batches):
        for batch in batches:
            size = [np.asarray(batch.column(i), dtype=np.int64) for i in (2, 3)]
            ok = np.zeros(batch.num_rows, dtype=bool)
            for k, (x, y) in enumerate(zip(batch.column(4), batch.column(5))):
                both = len(np.intersect1d(_grams(x.as_py()), _grams(y.as_py()), assume_unique=True))
                ok[k] = 1.0 - both / max(1, int(size[0][k] + size[1][k]) - both) <= eps / 2 - TINY
            yield batch.select([0, 1]).filter(pa.array(ok))

    pivots = sets.toDF("pivot", "pivot_size", "pivot_grams")
    left = C.written(cells.select("region", "name"), "left")
    homes = None
    while True:
        crowd = C.written(left.groupBy("region").agg(F.count("*").alias("n"), F.min("name").alias("pivot")).where(F.col("n") > BLOCK), "crowd")
        if crowd.isEmpty():
            C.drop(crowd)
            break
        near = left.join(crowd, "region").join(sets, "name").join(pivots, "pivot").select("name", "pivot", "size", "pivot_size", "grams", "pivot_grams")
        found = C.written(near.mapInArrow(inner, "name long, home long").groupBy("name").agg(F.min("home").alias("home")), "found")
        kept = C.written(left.join(found.select("name"), "name", "left_anti").select("region", "name"), "left")
        before, after = left.join(crowd, "region").count(), kept.join(crowd, "region").count()
        homes = found if homes is None else C.written(homes.union(found), "homes", homes, found)
        C.drop(left, crowd)
        left = kept
        if before - after < before / 20:
            break
    C.drop(left)
    return homes


def _grams(blob: bytes) -> np.ndarray:
    n = len(blob) // 6
    return C.unpack48(np.frombuffer(blob, dtype=np.uint32, count=n), np.frombuffer(blob, dtype=np.uint16, count=n, offset=4 * n))


class Region:
    """The sets of one region, as arrays of those n-grams that more than one set has, and their full sizes.

    ``apart`` has marks of each set; a pair with a mark in common counts elsewhere.
    """

    def __init__(self, arrays: list[np.ndarray], size: np.ndarray, eps: float, apart: list[list] | None = None):
        self.n, self.size, self.eps = len(arrays), np.asarray(size, dtype=np.int64), eps
        many = np.array(list(map(len, arrays)))
        self.first = np.r_[0, np.cumsum(many)]
        flat = np.concatenate([np.zeros(0, np.uint64), *arrays])
        self.columns, self.flat = np.unique(flat, return_inverse=True)
        self.owner = np.repeat(np.arange(self.n), many)
        number: dict = {}
        sign: dict[tuple, int] = {}
        kinds = [sign.setdefault(tuple(sorted(number.setdefault(m, len(number)) for m in marks)), len(sign)) for marks in apart or [[]] * self.n]
        self.kind = np.array(kinds, dtype=np.int64)
        marked = np.zeros((len(sign), max(1, len(number))), dtype=np.float32)
        for marks, k in sign.items():
            marked[k, list(marks)] = 1
        self.counts = marked @ marked.T == 0  # whether pairs of two kinds count here
        self.links = np.zeros(self.n, dtype=np.int64)
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []
        self.depth = 0

    def join(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many links of each set count here, and pairs (u, v) that connect all linked sets."""
        rest = np.arange(self.n)
        while len(rest) > LEAF:
            d = self.distance(rest, int(rest[0]))
            ball, shell = d <= self.eps / 2 - TINY, (d > self.eps / 2 - TINY) & (d <= 1.5 * self.eps + TINY)
            if ball.sum() < max(8, len(rest) // 64):
                break
            self.depth += 1
            self._ball(rest[ball], d[ball], rest[shell], d[shell])
            rest = rest[~ball]
        self._leaf(rest)
        u, v = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*self.edges)) if self.edges else (np.zeros(0, np.int64),) * 2
        return self.links, u, v

    def distance(self, idx: np.ndarray, pivot: int) -> np.ndarray:
        """Jaccard distance of each set to the pivot."""
        mark = np.zeros(len(self.columns), dtype=bool)
        mark[self.flat[self.first[pivot] : self.first[pivot + 1]]] = True
        both = np.bincount(self.owner, weights=mark[self.flat], minlength=self.n)[idx]
        return 1.0 - both / np.maximum(1, self.size[idx] + self.size[pivot] - both)

    def _ball(self, ball: np.ndarray, db: np.ndarray, shell: np.ndarray, ds: np.ndarray) -> None:
        """All pairs within a ball are links; those with its shell are, are not, or are looked at, by the triangle inequality."""
        kinds, times = np.unique(self.kind[ball], return_counts=True)
        inside = self.counts[np.ix_(kinds, kinds)]
        each = inside @ times - np.diag(inside)
        self.links[ball] += each[np.searchsorted(kinds, self.kind[ball])]
        self.edges.append((np.full(len(ball) - 1, ball[0]), ball[1:]))
        for at in range(0, len(shell), 1024):
            y, dy = shell[at : at + 1024], ds[at : at + 1024]
            for to in range(0, len(ball), 1024):
                x, dx = ball[to : to + 1024], db[to : to + 1024]
                link = dx[:, None] + dy <= self.eps - TINY
                open_ = ~link & (dy - dx[:, None] <= self.eps + TINY)
                r, c = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
                if len(r):
                    link[np.ix_(r, c)] |= open_[np.ix_(r, c)] & self._within(x[r], y[c])
                self._add(x, y, link)
                some = link.any(axis=0)
                self.edges.append((x[link[:, some].argmax(axis=0)], y[some]))

    def _add(self, x: np.ndarray, y: np.ndarray, link: np.ndarray) -> None:
        link = link & self.counts[np.ix_(self.kind[x], self.kind[y])]
        self.links[x] += link.sum(axis=1)
        self.links[y] += link.sum(axis=0)

    def _within(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether each pair of sets of ``x`` and ``y`` is within the distance, by products of incidence matrices."""
        sides = []
        for idx in (x, y):
            n = self.first[idx + 1] - self.first[idx]
            take = np.arange(n.sum()) + np.repeat(self.first[idx] - (np.cumsum(n) - n), n)
            sides.append((np.repeat(np.arange(len(idx)), n), self.flat[take]))
        in_x, in_y = (np.zeros(len(self.columns), dtype=bool) for _ in range(2))
        in_x[sides[0][1]] = True
        in_y[sides[1][1]] = True
        number = np.cumsum(in_x & in_y) - 1
        both = np.zeros((len(x), len(y)), dtype=np.float32)
        total = int(number[-1]) + 1 if len(number) else 0
        width = max(64, min(4096, (1 << 22) // max(len(x), len(y))))
        ordered = []
        for row, col in sides:
            ok = (in_x & in_y)[col]
            row, col = row[ok], number[col[ok]]
            order = np.argsort(col, kind="stable")
            ordered.append((row[order], col[order]))
        for c in range(0, total, width):
            m = []
            for (row, col), idx in zip(ordered, (x, y)):
                a, b = np.searchsorted(col, [c, c + width])
                one = np.zeros((len(idx), min(width, total - c)), dtype=np.float32)
                one[row[a:b], col[a:b] - c] = 1
                m.append(one)
            both += m[0] @ m[1].T
        both = both.astype(np.float64)
        return both >= (1.0 - self.eps - 1e-12) * (self.size[x][:, None] + self.size[y] - both)

    def _leaf(self, idx: np.ndarray) -> None:
        """All pairs are looked at, a tile at a time, and a breadth-first search finds what links connect."""
        if len(idx) < 2:
            return
        link = np.zeros((len(idx), len(idx)), dtype=bool)
        for at in range(0, len(idx), 1024):
            for to in range(at, len(idx), 1024):
                link[at : at + 1024, to : to + 1024] = self._within(idx[at : at + 1024], idx[to : to + 1024])
        link = np.triu(link, 1)
        self._add(idx, idx, link)
        link |= link.T
        free = link.any(axis=1)
        while free.any():
            start = int(free.argmax())
            seen = np.zeros(len(idx), dtype=bool)
            seen[start], front = True, np.array([start])
            while len(front):
                front = np.flatnonzero(link[front].any(axis=0) & ~seen)
                seen[front] = True
            free &= ~seen
            seen[start] = False
            others = idx[seen]
            self.edges.append((np.full(len(others), idx[start]), others))


def components(pairs: DataFrame, a: str = "doc_a", b: str = "doc_b") -> DataFrame:
    """``(doc_id, root)``: the smallest id that each id of some pair is connected to.

    Each partition first reduces its pairs to a spanning forest, so that dense groups shrink to one edge a member. At most ``FEW`` edges
    then go to one task; with more, large-star and small-star steps alternate until nothing changes. Each step's edges are a written table.
    """
    C.ship(pairs.sparkSession)

    def forest(batches):
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            parent.setdefault(x, x)
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = find(x), find(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
        rows = [(x, find(x)) for x in parent]
        rows = [r for r in rows if r[0] != r[1]]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], names=["u", "v"])

    edges = C.written(pairs.select(F.col(a).cast("long"), F.col(b).cast("long")).mapInArrow(forest, "u long, v long"), "edges")
    before = None
    while True:
        if edges.count() <= FEW:
            roots = C.written(edges.repartition(1).mapInArrow(forest, "u long, root long"), "roots", edges)
            break
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = C.written(small, "edges", edges)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            roots = edges.groupBy("u").agg(F.min("v").alias("root"))
            break
        before = now
    return roots.select(F.col("u").alias("doc_id"), "root").union(roots.select("root", "root").distinct())


def keep_one(df: DataFrame, classes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``df`` whose id is the least of its class, of ``classes (doc_id, class_id, ...)``. Of repeated rows of an
    id one stays; rows without an id stay."""
    out = classes.where("doc_id <> class_id").select(F.col("doc_id").alias("__dropped"))
    kept = df.join(out, df[id_col] == out["__dropped"], "left_anti")
    # repeated ids are rare: only their rows are reduced to one
    again = kept.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").select(F.col(id_col).alias("__again"))
    single = kept.join(again, kept[id_col] == again["__again"], "left_anti")
    repeated = kept.join(again, kept[id_col] == again["__again"], "left_semi").dropDuplicates([id_col])
    return single.unionByName(repeated)


def sql(n: int = 3, threshold: float = 0.55) -> str:
    """DuckDB SQL for :func:`ngram_jaccard_join` over ``documents``: each two distinct sets are compared."""
    gram = " || ' ' || ".join(f"t[i + {k}]" for k in range(n))
    return rf"""
    WITH RECURSIVE words AS (
      SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-/:-@\[-`{{-\x7f]+'), lambda x: x <> '') AS t
      FROM documents WHERE doc_id IS NOT NULL),
    sets AS (
      SELECT DISTINCT doc_id, CASE WHEN len(t) = 0 THEN [doc_id::VARCHAR, ''] ELSE list_sort(list_distinct(CASE WHEN len(t) < {n} THEN [array_to_string(t, ' ')]
        ELSE list_transform(range(1, len(t) - {n} + 2), lambda i: {gram}) END)) END AS g, len(t) > 0 AS real
      FROM words),
    points AS (SELECT row_number() OVER () AS s, g, real, len(g) AS size, min(doc_id) AS copy_of FROM sets GROUP BY g, real),
    members AS (SELECT doc_id, s, copy_of FROM sets JOIN points USING (g, real)),
    items AS (SELECT s, size, unnest(g) AS gram FROM points WHERE real),
    near AS (
      SELECT a.s AS x, b.s AS y FROM items a JOIN items b ON a.gram = b.gram AND a.s <> b.s
      GROUP BY a.s, b.s, a.size, b.size HAVING count(*) >= {threshold} * (a.size + b.size - count(*)) - 1e-9),
    links AS (SELECT x AS s, count(*) AS n FROM near GROUP BY x),
    steps AS (SELECT x, y FROM near UNION SELECT a.s, b.s FROM members a JOIN members b ON a.doc_id = b.doc_id AND a.s <> b.s),
    reach AS (SELECT s AS x, s AS y FROM points UNION SELECT reach.x, steps.y FROM reach JOIN steps ON reach.y = steps.x),
    classes AS (SELECT reach.x AS s, min(p.copy_of) AS class_id FROM reach JOIN points p ON p.s = reach.y GROUP BY reach.x)
    SELECT doc_id, min(class_id) AS class_id, min(copy_of) AS copy_of, sum(coalesce(n, 0))::BIGINT AS n_links
    FROM members JOIN classes USING (s) LEFT JOIN links USING (s) GROUP BY doc_id"""


__all__ = ["ngram_jaccard_join", "components", "keep_one", "sql", "Region"]
