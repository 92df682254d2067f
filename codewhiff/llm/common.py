"""What the corpus operators share: shared storage, block exchanges and a vectorised tokenizer."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import runtime

# == storage


def ship(spark: SparkSession) -> None:
    """Code to the workers, and batches of a size that two workers and their executor can hold with long texts.

    The Parquet reader's vectors grow by doubling, so batches of thousands of texts would leave large arrays to the collector.
    """
    runtime.ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2048)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", 256)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``. Only a local master may do without: it gets a temporary folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir isn't set: intermediate tables need a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="corpus-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_tables: dict[str, SparkSession] = {}  # written tables that are still there


def written(df: DataFrame, name: str, *done: DataFrame) -> DataFrame:
    """``df`` as a written table: cuts the lineage, survives lost executors, and frees the shuffles behind it.

    ``done`` are written tables that nothing needs after this one; they are deleted. Those left go when the process ends.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    if not _tables:
        atexit.unregister(_drop_all)
        atexit.register(_drop_all)
    _tables[path] = spark
    del df
    drop(*done)
    release(spark)
    return out


def publish(fs, temp: str, final: str) -> None:
    """Give a finished file its name. A task that runs again makes the same file, so one that is there already stays."""
    try:
        if fs.get_file_info(final).type == pafs.FileType.NotFound:
            return fs.move(temp, final)
    except OSError:
        if fs.get_file_info(final).type == pafs.FileType.NotFound:
            raise
    fs.delete_file(temp)


def drop(*tables: DataFrame) -> None:
    """Delete written tables."""
    for t in tables:
        _delete(t._written)


def _delete(path: str) -> None:
    spark = _tables.pop(path, None)
    if spark is not None:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _drop_all() -> None:
    for path, spark in list(_tables.items()):
        if spark.sparkContext._jsc is not None:  # a stopped session can't delete any more
            _delete(path)


def release(spark: SparkSession) -> None:
    """Let the context cleaner see that shuffles behind a written table are no longer referenced."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def input_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate, at most what its sources have (a join's estimate is a product). A source of unknown
    size, such as rows made on the driver, is measured by a pass."""
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    if any(x >= 1 << 62 for x in sizes):
        wide = [F.octet_length(c) if kind in ("string", "binary") else F.lit(8) for c, kind in df.dtypes]
        row = df.select(F.sum(sum((F.coalesce(w, F.lit(0)).cast("long") for w in wide), F.lit(0)))).first()
        return int(row[0] or 0)
    return min(int(str(plan.stats().sizeInBytes())), sum(sizes))


def partitions_for(df: DataFrame, bytes_each: int, least: int = 8) -> int:
    """How many groups of about ``bytes_each`` estimated input bytes to use, so that a group's size doesn't grow with the input."""
    return int(max(least, -(-input_bytes(df) // bytes_each)))


# == blocks
#
# A block exchange moves many small records as a few rows: (part INT, blob BINARY). Each blob
# holds numpy arrays, so serialisation costs bytes, not rows.

BLOCK = pa.schema([("part", pa.int32()), ("blob", pa.binary())])
BLOCK_DDL = "part int, blob binary"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of any lengths and plain dtypes as one blob."""
    head = [np.array([len(arrays)], dtype=np.int64)]
    for a in arrays:
        head.append(np.array([ord(a.dtype.kind), a.dtype.itemsize, len(a)], dtype=np.int64))
    return b"".join(x.tobytes() for x in head) + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(blob: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, dtype=np.int64, count=1)[0])
    head = np.frombuffer(blob, dtype=np.int64, count=3 * n, offset=8).reshape(n, 3)
    at, out = 8 + 24 * n, []
    for kind, width, size in head.tolist():
        out.append(np.frombuffer(blob, dtype=np.dtype(f"{chr(kind)}{width}"), count=size, offset=at))
        at += width * size
    return out


def blocks_of(table: pa.Table) -> list[list[np.ndarray]]:
    return [unpack(b.as_py()) for b in table.column("blob")]


def joined(blocks: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Blocks concatenated array by array."""
    return [np.concatenate(x) for x in zip(*blocks)] if blocks else []


def split_by(part: np.ndarray, n: int, *arrays: np.ndarray) -> list[tuple[int, list[np.ndarray]]]:
    """Rows grouped by ``part`` (0 <= part < n), as (part, arrays)."""
    if not len(part):
        return []
    part = part.astype(np.uint16 if n <= 1 << 16 else np.int64)
    order = np.argsort(part, kind="stable")
    part = part[order]
    cuts = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(part)].tolist()
    return [(int(part[a]), [x[order[a:b]] for x in arrays]) for a, b in zip(cuts, cuts[1:])]


def block_batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], schema=BLOCK)


def pack48(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """48-bit values as two arrays, six bytes a value."""
    return (x & np.uint64(0xFFFFFFFF)).astype(np.uint32), (x >> np.uint64(32)).astype(np.uint16)


def unpack48(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return lo.astype(np.uint64) | (hi.astype(np.uint64) << np.uint64(32))


# == tokens

_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
_P = 0x9E3779B97F4A7C15 | 1
_POW = {"n": 0}

_WORD = np.ones(256, dtype=bool)  # a word is a run of bytes that aren't ASCII white space
_WORD[[9, 10, 11, 12, 13, 32]] = False
_ALNUM = np.zeros(256, dtype=bool)  # a term is a run of ASCII letters and digits and of any other character
_ALNUM[128:] = True
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _ALNUM[_a:_b] = True

CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; every bit of the result depends on every bit of ``x``."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n."""
    if _POW["n"] < n:
        n = max(n, CHUNK + 1)
        inv = pow(_P, -1, 1 << 64)
        both = []
        for base in (_P, inv):
            out = np.ones(n, dtype=np.uint64)
            out[1:] = np.uint64(base)
            both.append(np.multiply.accumulate(out))
        _POW.update(n=n, pow=both[0], inv=both[1])
    return _POW["pow"][:n], _POW["inv"][:n]


def slices(column: pa.Array, most: int = CHUNK):
    """(first row, rows) pieces of a string column, each of about ``most`` bytes or one row."""
    if len(column) == 0:
        return
    size = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
    total = np.cumsum(size)
    at = 0
    while at < len(column):
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + most, side="right")))
        yield at, column.slice(at, to - at)
        at = to


def tokens(column: pa.Array, terms: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All tokens of a string column at once.

    Returns (hash of each token, number of the first token of each row plus the total, byte start and
    byte end of each token in its row's UTF-8). Words are runs without ASCII white space; with ``terms`` the text is
    lower-cased and terms are runs of ASCII letters, digits and non-ASCII characters. Null rows have no token.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if terms:
        column = pc.utf8_lower(column)
    n = len(column)
    offs = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    size = int(offs[-1] - offs[0]) if n else 0
    if not size:
        z = np.zeros(0, dtype=np.uint64)
        return z, np.zeros(n + 1, dtype=np.int64), z.astype(np.int64), z.astype(np.int64)
    data = np.frombuffer(raw, dtype=np.uint8)[offs[0] : offs[-1]]
    offs = offs - offs[0]
    inside = np.zeros(size + 2, dtype=bool)
    inside[1:-1] = (_ALNUM if terms else _WORD)[data]
    edge = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    cut = offs[1:-1]
    cut = cut[(cut > 0) & (cut < size)]
    edge[cut] = inside[1:-1][cut]
    last[cut - 1] = inside[1:-1][cut - 1]
    start, end = np.flatnonzero(edge), np.flatnonzero(last) + 1
    power, inverse = _powers(size + 1)
    total = np.zeros(size + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:size], out=total[1:])
    h = mix((total[end] - total[start]) * inverse[start])
    first = np.searchsorted(start, offs)
    row = np.repeat(offs[:-1], np.diff(first))
    return h, first, start - row, end - row


def grams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of each row: (hash, number of each row's first gram plus the total). A row of fewer
    than ``n`` tokens, but one, has one gram: all its tokens."""
    count = np.diff(first)
    rows = np.flatnonzero((count > 0) & (count < n))
    full = np.maximum(count - n + 1, 0)
    if len(h) >= n:
        acc = h[: len(h) - n + 1].copy()
        for k in range(1, n):
            acc = mix(acc * np.uint64(0xD6E8FEB86659FD93) + h[k : len(h) - n + 1 + k])
    else:
        acc = np.zeros(0, dtype=np.uint64)
    out_first = np.zeros(len(first), dtype=np.int64)
    short = np.zeros(len(count), dtype=np.int64)
    short[rows] = 1
    np.cumsum(full + short, out=out_first[1:])
    out = np.empty(int(out_first[-1]), dtype=np.uint64)
    src = np.repeat(first[:-1] - out_first[:-1], full + short) + np.arange(len(out))
    ok = np.repeat(full > 0, full + short)
    out[ok] = acc[src[ok]]
    for r in rows.tolist():
        x = h[first[r] : first[r] + 1].copy()
        for k in range(1, int(count[r])):
            x = mix(x * np.uint64(0xD6E8FEB86659FD93) + h[first[r] + k : first[r] + k + 1])
        out[out_first[r]] = mix(x ^ np.uint64(count[r]))[0]
    return out, out_first


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` consecutive values."""
    if len(x) < w:
        return x[:0]
    have, out = 1, x
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < w:
        out = np.minimum(out[: len(x) - w + 1], out[w - have : w - have + len(x) - w + 1])
    return out
