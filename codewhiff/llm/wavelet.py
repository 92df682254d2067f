"""Token ids in wavelet matrices, one compressed file a shard (operator 8)."""

from __future__ import annotations

import base64
import functools
import json

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

MAGIC = b"WVMX0001"
BLOCK_WORDS = 8192  # 64-bit words of one compressed block of a bit-plane
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RESULT = "doc_id long, shard string, start long, n_tokens long, file string"


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """A tokenizer from a file of byte-pair ranks."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def build(x: np.ndarray, docs: list[tuple[int | None, int, int]], bits: int) -> bytes:
    """A file: the ids' bits, highest plane first, each plane stably ordered by the planes above; planes are
    compressed in blocks, and a directory has each block's place and the ones before it."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1)
    body, at, planes = [], 0, []
    x = np.ascontiguousarray(x)
    for b in range(bits - 1, -1, -1):
        one = ((x >> x.dtype.type(b)) & x.dtype.type(1)).astype(bool)
        raw = np.packbits(one, bitorder="little")
        words = np.zeros(-(-len(x) // 64), dtype=np.uint64)
        words.view(np.uint8)[: len(raw)] = raw
        blocks, ones = [], 0
        for w in range(0, len(words), BLOCK_WORDS):
            part = words[w : w + BLOCK_WORDS]
            data = pack.compress(part.tobytes())
            blocks.append((at, len(data), ones))
            ones += int(np.bitwise_count(part).sum())
            body.append(data)
            at += len(data)
        planes.append({"ones": ones, "blocks": blocks})
        x = np.concatenate([x[~one], x[one]])
    head = json.dumps({"n": len(x), "bits": bits, "planes": planes, "docs": docs}).encode()
    head = pack.compress(head)
    return MAGIC + len(head).to_bytes(8, "little") + head + b"".join(body)


class WaveletFile:
    """Reads one file; blocks are decompressed when they are first needed."""

    def __init__(self, data: bytes):
        import zstandard

        assert data[:8] == MAGIC, "not a wavelet file"
        size = int.from_bytes(data[8:16], "little")
        self._unpack = zstandard.ZstdDecompressor()
        head = json.loads(self._unpack.decompress(data[16 : 16 + size]))
        self.n, self.bits, self.planes, self.docs = head["n"], head["bits"], head["planes"], head["docs"]
        self.data, self.base = data, 16 + size
        self.zeros = [self.n - p["ones"] for p in self.planes]
        self._blocks: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def _block(self, plane: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        if (plane, b) not in self._blocks:
            at, size, ones = self.planes[plane]["blocks"][b]
            words = np.frombuffer(self._unpack.decompress(self.data[self.base + at : self.base + at + size]), dtype=np.uint64)
            self._blocks[plane, b] = words, ones + np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)]
        return self._blocks[plane, b]

    def _bit_rank(self, plane: int, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bit at i, ones before i); i may be n."""
        bit, rank = np.zeros(len(i), dtype=np.int64), np.zeros(len(i), dtype=np.int64)
        which = i // (64 * BLOCK_WORDS)
        for b in np.unique(which).tolist():
            at = which == b
            if b >= len(self.planes[plane]["blocks"]):
                rank[at] = self.planes[plane]["ones"]
                continue
            words, before = self._block(plane, b)
            local = i[at] - b * 64 * BLOCK_WORDS
            w, k = local // 64, (local % 64).astype(np.uint64)
            inside = w < len(words)
            word = np.where(inside, words[np.minimum(w, len(words) - 1)], np.uint64(0))
            rank[at] = before[np.minimum(w, len(words))] + np.bitwise_count(word & ((np.uint64(1) << k) - np.uint64(1)))
            bit[at] = ((word >> k) & np.uint64(1)).astype(np.int64)
        return bit, rank

    def access(self, i) -> np.ndarray:
        """The ids at the given places."""
        i = np.atleast_1d(np.asarray(i, dtype=np.int64))
        if len(i) and (i.min() < 0 or i.max() >= self.n):
            raise IndexError("no such place")
        out = np.zeros(len(i), dtype=np.int64)
        for p in range(self.bits):
            bit, rank = self._bit_rank(p, i)
            out = out << 1 | bit
            i = np.where(bit == 1, self.zeros[p] + rank, i - rank)
        return out

    def _range(self, token: int, i: int, j: int) -> tuple[int, int]:
        for p in range(self.bits):
            _, r = self._bit_rank(p, np.array([i, j]))
            if token >> (self.bits - 1 - p) & 1:
                i, j = self.zeros[p] + int(r[0]), self.zeros[p] + int(r[1])
            else:
                i, j = i - int(r[0]), j - int(r[1])
        return i, j

    def count(self, token: int, i: int = 0, j: int | None = None) -> int:
        """How often an id occurs from place i to before j."""
        if token < 0 or token >> self.bits:
            return 0
        a, b = self._range(token, i, self.n if j is None else j)
        return b - a

    def rank(self, token: int, i: int) -> int:
        return self.count(token, 0, i)

    def occurrences(self, token: int) -> np.ndarray:
        """The places of an id, in order."""
        if token < 0 or token >> self.bits or not self.n:
            return np.zeros(0, dtype=np.int64)
        a, b = self._range(token, 0, self.n)
        return self._back(token, np.arange(a, b))

    def select(self, token: int, k: int) -> int:
        """The place of the k-th occurrence, from 0."""
        a, b = self._range(token, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError("no such occurrence")
        return int(self._back(token, np.array([a + k]))[0])

    def _back(self, token: int, i: np.ndarray) -> np.ndarray:
        for p in range(self.bits - 1, -1, -1):
            one = token >> (self.bits - 1 - p) & 1
            i = self._select_bit(p, one, i - self.zeros[p] if one else i)
        return i

    def _select_bit(self, plane: int, one: int, k: np.ndarray) -> np.ndarray:
        blocks = self.planes[plane]["blocks"]
        size = 64 * BLOCK_WORDS
        ones = np.array([b[2] for b in blocks], dtype=np.int64)
        before = ones if one else np.arange(len(blocks)) * size - ones
        which = np.searchsorted(before, k, side="right") - 1
        out = np.zeros(len(k), dtype=np.int64)
        for b in np.unique(which).tolist():
            words, rank = self._block(plane, b)
            at = which == b
            bits = np.unpackbits(words.view(np.uint8), bitorder="little")
            places = np.flatnonzero(bits == one)
            out[at] = b * size + places[k[at] - before[b]]
        return out

    def document(self, doc_id: int | None) -> np.ndarray:
        """The ids of a document of the shard."""
        for d, start, n in self.docs:
            if d == doc_id:
                return self.access(np.arange(start, start + n)) if n else np.zeros(0, dtype=np.int64)
        raise KeyError(doc_id)


def write_wavelet_shards(df: DataFrame, tokenizer: str = TOKENIZER, path: str | None = None, shard_tokens: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, shard, start, n_tokens, file)`` of every row: where a document's ids are, after writing one wavelet
    matrix for each shard to the shared folder (or ``path``).

    Each task tokenizes its rows in order and cuts a shard at about ``shard_tokens`` ids; texts aren't exchanged. A shard's name follows from
    its partition, and it appears by a rename, so that a task which runs again replaces it by the same file. ``tokenizer`` is a
    file of byte-pair ranks that each worker reads. Null and empty texts have no id and keep a row with
    0 tokens; null ids are kept; repeated rows are stored each. Other columns are ignored. No rows in, none out.
    """
    spark = df.sparkSession
    C.ship(spark)
    path = path or C.fresh_path(spark, "wavelet")

    def run(batches):
        codec = encoder(tokenizer)
        bits = max(1, int(codec.n_vocab - 1).bit_length())
        kind = np.uint16 if bits <= 16 else np.uint32
        fs, root = pafs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        part, seq = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        rows: list[tuple[int | None, int, int]] = []
        total = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, rows, total, seq
            name = f"{part:06d}-{seq:04d}"
            ids = np.concatenate(held) if held else np.zeros(0, dtype=kind)
            final, temp = f"{root}/{name}.wm", f"{root}/.{name}.{TaskContext.get().taskAttemptId()}"
            with fs.open_output_stream(temp) as f:
                f.write(build(ids, rows, bits))
            C.publish(fs, temp, final)
            out = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([name] * len(rows)), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([f"{path}/{name}.wm"] * len(rows))], names=["doc_id", "shard", "start", "n_tokens", "file"])
            held, rows, total, seq = [], [], 0, seq + 1
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = codec.encode_to_numpy(text, disallowed_special=()).astype(kind) if text else np.zeros(0, dtype=kind)
                rows.append((doc, total, len(ids)))
                held.append(ids)
                total += len(ids)
                if total >= shard_tokens:
                    yield flush()
        if rows:
            yield flush()

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, RESULT)


def open_shard(file: str) -> WaveletFile:
    fs, path = pafs.FileSystem.from_uri(file)
    with fs.open_input_stream(path) as f:
        return WaveletFile(f.read())


__all__ = ["build", "WaveletFile", "write_wavelet_shards", "open_shard", "encoder"]
