"""Language identification by a byte convolutional network (operator 4)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

WINDOW = 256  # positions of a window; windows follow each other, so that every byte is a position of one
WIDTHS = (2, 3, 4, 5)
FILTERS = 8  # of each width
EMBED = 6
REACH = max(WIDTHS) - 1  # bytes after a window that its last positions still see
UNKNOWN = "und"
RESULT = "doc_id long, predicted string, confidence double, n_windows int, accepted boolean"


def windows(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of texts in one buffer: (bytes [n, WINDOW + REACH], zero beyond the text's end; text of each; bytes of
    the text at its positions)."""
    size = np.diff(offs)
    n = -(-size // WINDOW)
    text = np.repeat(np.arange(len(size)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    begin = offs[:-1][text] + k * WINDOW
    left = size[text] - k * WINDOW
    at = begin[:, None] + np.arange(WINDOW + REACH)
    x = raw[np.minimum(at, len(raw) - 1)]
    x = np.where(np.arange(WINDOW + REACH) < left[:, None], x, 0).astype(np.uint8)
    return x, text, np.minimum(left, WINDOW)


class ByteConvNet:
    """Byte embedding, filters of several widths over all positions, max pooling, softmax."""

    def __init__(self, classes: list[str], seed: int = 7):
        self.classes = classes
        r = np.random.default_rng(seed)
        self.embed = (r.normal(size=(256, EMBED)) * 0.5).astype(np.float32)
        self.embed[0] = 0
        k = len(WIDTHS) * FILTERS
        self.conv = (r.normal(size=(REACH + 1, EMBED, k)) / np.sqrt(EMBED * 3)).astype(np.float32)
        self.shape = np.zeros((REACH + 1, 1, k), dtype=np.float32)
        for i, w in enumerate(WIDTHS):
            self.shape[:w, :, i * FILTERS : (i + 1) * FILTERS] = 1
        self.conv *= self.shape
        self.bias = np.zeros(k, dtype=np.float32)
        self.dense = (r.normal(size=(k, len(classes))) / np.sqrt(k)).astype(np.float32)
        self.out = np.zeros(len(classes), dtype=np.float32)

    def _pool(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        e = self.embed[x]
        view = np.lib.stride_tricks.sliding_window_view(e.reshape(len(x), -1), (REACH + 1) * EMBED, axis=1)[:, ::EMBED]
        cols = np.ascontiguousarray(view).reshape(-1, (REACH + 1) * EMBED)
        return cols, cols @ self.conv.reshape(-1, self.conv.shape[2]), x

    def logits(self, x: np.ndarray) -> np.ndarray:
        _, y, _ = self._pool(x)
        y = y.reshape(len(x), WINDOW, -1)
        n = WINDOW
        while n > 1:
            n //= 2
            y = np.maximum(y[:, :n], y[:, n : 2 * n])
        return np.maximum(y[:, 0] + self.bias, 0) @ self.dense + self.out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.logits(x)
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 4e-3, seed: int = 3) -> None:
        """Adam on the cross entropy; the gradient goes through the position that each filter's maximum is at."""
        r = np.random.default_rng(seed)
        names = ("embed", "conv", "bias", "dense", "out")
        m = {k: np.zeros_like(getattr(self, k)) for k in names}
        v = {k: np.zeros_like(getattr(self, k)) for k in names}
        step = 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for at in range(0, len(x), batch):
                i = order[at : at + batch]
                cols, z, xb = self._pool(x[i])
                z = z.reshape(len(i), WINDOW, -1)
                best = z.argmax(axis=1)
                top = np.take_along_axis(z, best[:, None], axis=1)[:, 0] + self.bias
                h = np.maximum(top, 0)
                s = h @ self.dense + self.out
                p = np.exp(s - s.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(i)), y[i]] -= 1
                p /= len(i)
                g = {"dense": h.T @ p, "out": p.sum(axis=0)}
                dh = (p @ self.dense.T) * (top > 0)
                g["bias"] = dh.sum(axis=0)
                picked = cols.reshape(len(i), WINDOW, -1)[np.arange(len(i))[:, None], best]  # [b, filter, inputs]
                g["conv"] = np.einsum("bf,bfi->if", dh, picked, optimize=True).reshape(self.conv.shape) * self.shape
                back = (dh[:, :, None] * self.conv.reshape(-1, self.conv.shape[2]).T[None]).reshape(len(i), -1, REACH + 1, EMBED)
                seen = xb[np.arange(len(i))[:, None, None], best[:, :, None] + np.arange(REACH + 1)]
                g["embed"] = np.zeros_like(self.embed)
                np.add.at(g["embed"], seen.ravel(), back.reshape(-1, EMBED))
                g["embed"][0] = 0
                step += 1
                for k in names:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    new = getattr(self, k) - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
                    setattr(self, k, new.astype(np.float32))


def train_on(df: DataFrame, per_language: int = 150, per_text: int = 4, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", seed: int = 11) -> ByteConvNet:
    """A network trained on a bounded sample: ``per_language`` labelled texts of each language, those of least hash of
    their id, and ``per_text`` windows from anywhere in each, of lengths from 8 bytes to a whole window, some of them in capitals. A further class,
    ``und``, gets made-up bytes that are no text."""
    labelled = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(label_col).alias("label"), F.xxhash64(F.col(id_col).cast("long")).alias("h")).where("id is not null and label is not null and length(text) >= 40")
    langs = {x.label: x["count"] for x in labelled.groupBy("label").count().collect()}
    # a bound on the hash that about three times the sample is below, so that what is sent to the driver doesn't grow with the rows
    bound = {k: (1 << 63) - 1 if n <= 3 * per_language else -(1 << 63) + (3 * per_language << 64) // n for k, n in langs.items()}
    had = {x.label: x.n for x in _sample(labelled, bound, per_language).groupBy("label").agg(F.count("*").alias("n")).collect()}
    bound |= {k: (1 << 63) - 1 for k, n in langs.items() if had.get(k, 0) < min(n, per_language)}
    r = np.random.default_rng(seed)
    classes = sorted(langs) + [UNKNOWN]
    xs, ys = [], []

    def add(raw: bytes, label: int) -> None:
        b = np.zeros(WINDOW + REACH, dtype=np.uint8)
        b[: len(raw)] = np.frombuffer(raw, dtype=np.uint8)
        xs.append(b)
        ys.append(label)

    number = {k: i for i, k in enumerate(classes)}
    for row in _least(labelled, bound, per_language):
        for k in range(per_text):
            raw = (row.text.upper() if k == 3 else row.text).encode()
            n = WINDOW + REACH if k % 2 else int(r.integers(8, WINDOW + REACH))
            at = int(r.integers(0, max(1, len(raw) - n + 1)))
            add(raw[at : at + n], number[row.label])
    for k in range(max(1, len(xs) // max(1, len(langs)) // 2)):
        n = int(r.integers(8, WINDOW + REACH))
        pool = [np.arange(1, 256), np.arange(128, 256)][k % 2]
        add(r.choice(pool, size=n).astype(np.uint8).tobytes(), len(classes) - 1)
    net = ByteConvNet(classes)
    net.train(np.array(xs), np.array(ys))
    return net


def _sample(labelled: DataFrame, bound: dict[str, int], most: int) -> DataFrame:
    """Of each label, the ``most`` rows of least hash, all of which should be within the bound."""
    limits = F.broadcast(labelled.sparkSession.createDataFrame(sorted(bound.items()), "label string, most_h long"))
    order = Window.partitionBy("label").orderBy("h", "id", "text")
    return labelled.join(limits, "label").where("h <= most_h").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)


def _least(labelled: DataFrame, bound: dict[str, int], most: int):
    """The rows of :func:`_sample` in order, a partition at a time, so that texts of many labels aren't held at once."""
    return _sample(labelled, bound, most).orderBy("label", "h", "id", "text").toLocalIterator()


def identify(df: DataFrame, net: ByteConvNet, min_confidence: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, predicted, confidence, n_windows, accepted)`` of every row.

    All windows of the whole text are classified; the text's probabilities are the mean of its windows', weighted by their
    bytes. It is accepted if the likeliest class is a language and has at least ``min_confidence``.
    Null and empty texts have no window: ``und``, confidence 0, not accepted. Null ids are kept as they are, repeated rows
    too; ties go to the class that is first in alphabetical order. Other columns are ignored.
    """
    C.ship(df.sparkSession)
    score = _scorer(net, min_confidence)

    def run(batches):
        for batch in batches:
            label, conf, n, ok = score(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), label, conf, n, ok], names=["doc_id", "predicted", "confidence", "n_windows", "accepted"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, RESULT)


def _scorer(net: ByteConvNet, least: float):
    def score(text: pa.Array):
        total = np.zeros((len(text), len(net.classes)))
        count = np.zeros(len(text), dtype=np.int32)
        for row, piece in C.slices(text):
            piece = pc.fill_null(piece.cast(pa.large_string()), "")
            offs = np.frombuffer(piece.buffers()[1], dtype=np.int64)[piece.offset : piece.offset + len(piece) + 1]
            if offs[-1] == offs[0]:
                continue
            raw = np.frombuffer(piece.buffers()[2], dtype=np.uint8)[offs[0] : offs[-1]]
            x, owner, weight = windows(raw, offs - offs[0])
            for at in range(0, len(x), 32):
                p = net.probabilities(x[at : at + 32]) * weight[at : at + 32, None]
                np.add.at(total, row + owner[at : at + 32], p)
            count[row : row + len(piece)] += np.bincount(owner, minlength=len(piece)).astype(np.int32)
        mass = total.sum(axis=1)
        mean = total / np.maximum(mass, 1e-300)[:, None]
        best = mean.argmax(axis=1)
        conf = np.where(mass > 0, mean[np.arange(len(text)), best], 0.0)
        best = np.where(mass > 0, best, len(net.classes) - 1)
        label = pa.array(net.classes, pa.string()).take(pa.array(best, pa.int64()))
        ok = (conf >= least) & (best != len(net.classes) - 1)
        return label, pa.array(conf), pa.array(count), pa.array(ok)

    return score


def keep_identified(df: DataFrame, net: ByteConvNet, min_confidence: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose text is accepted, with all their columns. One pass, no exchange."""
    C.ship(df.sparkSession)
    score = _scorer(net, min_confidence)
    at = df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            yield batch.filter(score(batch.column(at))[3])

    return df.mapInArrow(run, df.schema)
