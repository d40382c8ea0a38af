"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are cut into overlapping chunks that cover the whole of it. Bytes are embedded, learned filters run over each
chunk, each filter keeps its maximum in the chunk, a small layer turns the maxima into the chunk's log-odds, and the mean
over all chunks gives one probability. Null and empty texts are one chunk of padding and get a score like any other.

Training uses a bounded sample of labelled rows: at most SAMPLE of them, and of at most SAMPLE_BYTES bytes of text together, in the order of a hash
of key and text; a row that doesn't fit any more is left out. The rows that are taken are learned from whole, every chunk of them. Repeated
equal rows count once. Scoring reads every chunk of every row.

Labels other than 0 and 1 and null keys aren't learned from; without labels every score is 0.5. Null keys are scored like others, repeated
rows get equal scores, an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, fresh, tune

#: Bytes of a chunk, and from one chunk to the next.
CHUNK, STEP = 512, 448
#: Bytes under a filter, steps between its places, numbers of an embedded byte, filters, hidden units.
WINDOW, STRIDE, EMBED, FILTERS, HIDDEN = 8, 2, 8, 32, 16
#: Bounds of the training sample: rows, and bytes of their texts together.
SAMPLE, SAMPLE_BYTES = 3000, 32 << 20
#: The columns that score adds.
NEW = ("score", "predicted")


def chunk_starts(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text of each chunk and where in it the chunk begins; the last chunk ends with its text."""
    n = np.where(lengths <= CHUNK, 1, -(-(lengths - CHUNK) // STEP) + 1)
    text = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    return text, np.minimum(k * STEP, np.maximum(lengths[text] - CHUNK, 0))


def chunk_bytes(data: np.ndarray, at: np.ndarray, text: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The chunks' bytes as rows, padded with zeros."""
    place = at[text][:, None] + start[:, None] + np.arange(CHUNK)
    inside = place < at[text + 1][:, None]
    if not len(data):
        return np.zeros(place.shape, np.uint8)
    return np.where(inside, data[np.minimum(place, len(data) - 1)], 0).astype(np.uint8)


@dataclass
class ByteConvNet:
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @staticmethod
    def start(seed: int = 7) -> ByteConvNet:
        r = np.random.default_rng(seed)
        f = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
        return ByteConvNet(f(256, EMBED, scale=0.5), f(WINDOW * EMBED, FILTERS, scale=(WINDOW * EMBED) ** -0.5), np.zeros(FILTERS, np.float32), f(FILTERS, HIDDEN, scale=FILTERS**-0.5), np.zeros(HIDDEN, np.float32), f(HIDDEN, scale=HIDDEN**-0.5), np.zeros(1, np.float32))

    def pooled(self, chunks: np.ndarray, where: bool = False):
        """Each filter's maximum over each chunk (and its place)."""
        e = np.ascontiguousarray(self.embed[chunks]).reshape(len(chunks), CHUNK * EMBED)
        places = (CHUNK - WINDOW) // STRIDE + 1
        s = e.strides
        windows = np.lib.stride_tricks.as_strided(e, (len(chunks), places, WINDOW * EMBED), (s[0], s[1] * STRIDE * EMBED, s[1]))
        found = (windows.reshape(-1, WINDOW * EMBED) @ self.filters).reshape(len(chunks), places, FILTERS)
        top = found.max(1)
        return (top, found.argmax(1)) if where else top

    def logits(self, chunks: np.ndarray, block: int = 64) -> np.ndarray:
        out = np.zeros(len(chunks), np.float32)
        for i in range(0, len(chunks), block):
            h = np.maximum(self.pooled(chunks[i : i + block]) + self.bias, 0)
            h = np.maximum(h @ self.hidden + self.hidden_bias, 0)
            out[i : i + block] = h @ self.out + self.out_bias
        return out

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The probability of each whole text."""
        text, start = chunk_starts(np.diff(at))
        total = np.zeros(len(at) - 1)
        for i in range(0, len(text), 1024):
            part = slice(i, i + 1024)
            np.add.at(total, text[part], self.logits(chunk_bytes(data, at, text[part], start[part])))
        return 1 / (1 + np.exp(-total / np.maximum(np.bincount(text, minlength=len(total)), 1)))

    def learn(self, chunks: np.ndarray, label: np.ndarray, weight: np.ndarray, epochs: int = 6, size: int = 64, rate: float = 4e-3, seed: int = 11) -> None:
        """Adam on the log loss of single chunks; a text's chunks share its weight."""
        r = np.random.default_rng(seed)
        names = ("embed", "filters", "bias", "hidden", "hidden_bias", "out", "out_bias")
        first, second = ({n: np.zeros_like(getattr(self, n)) for n in names} for _ in range(2))
        step, steps = 0, epochs * -(-len(chunks) // size)
        for _ in range(epochs):
            order = r.permutation(len(chunks))
            for i in range(0, len(order), size):
                pick = order[i : i + size]
                x, y, w = chunks[pick], label[pick], weight[pick]
                top, place = self.pooled(x, True)
                h0 = np.maximum(top + self.bias, 0)
                z = h0 @ self.hidden + self.hidden_bias
                h1 = np.maximum(z, 0)
                p = 1 / (1 + np.exp(-(h1 @ self.out + self.out_bias)))
                d = ((p - y) * w / w.sum()).astype(np.float32)
                g = {"out": h1.T @ d, "out_bias": d.sum(keepdims=True)}
                d1 = (d[:, None] * self.out) * (z > 0)
                g["hidden"], g["hidden_bias"] = h0.T @ d1, d1.sum(0)
                d0 = (d1 @ self.hidden.T) * (h0 > 0)
                g["bias"] = d0.sum(0)
                seen = np.take_along_axis(x, (place * STRIDE).reshape(len(x), -1, 1).repeat(WINDOW, 2).reshape(len(x), -1) + np.tile(np.arange(WINDOW), FILTERS), 1).reshape(len(x), FILTERS, WINDOW)
                inputs = self.embed[seen].reshape(len(x), FILTERS, WINDOW * EMBED)
                g["filters"] = np.einsum("bfk,bf->kf", inputs, d0)
                back = (d0[:, :, None] * self.filters.T[None]).reshape(-1, EMBED)
                g["embed"] = np.stack([np.bincount(seen.ravel(), back[:, j], 256) for j in range(EMBED)], 1).astype(np.float32)
                step += 1
                pace = rate * min(1, 2 * (1 - step / (steps + 1)))
                for n in names:
                    first[n] += 0.1 * (g[n] - first[n])
                    second[n] += 0.01 * (g[n] ** 2 - second[n])
                    setattr(self, n, (getattr(self, n) - pace * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.99**step)) + 1e-7)).astype(np.float32))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> ByteConvNet | None:
    """Learns from at most `sample` labelled rows (key, label 0 or 1) with at most `sample_bytes` bytes of text; None without any."""
    tune(docs.sparkSession)
    some = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).distinct()
    few = some.orderBy(F.xxhash64("k", F.lit(2)), "k", "y").limit(sample)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(few), "k")  # at most `sample` rows are broadcast
    # a key may be repeated in docs: equal rows count once, and of the others `sample` are taken
    once = rows.groupBy("k", "y", F.xxhash64("t").alias("h")).agg(F.first("t").alias("t"))
    taken = once.orderBy(F.xxhash64("k", "h", F.lit(3)), "y").limit(sample).select("y", "t").coalesce(1)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room = sample_bytes
        for b in batches:
            data, at = flat(b.column(1))
            for i, y in enumerate(b.column(0).to_pylist()):
                if (size := int(at[i + 1] - at[i])) <= room:
                    room -= size
                    yield pa.RecordBatch.from_arrays([pa.array([y], pa.int32()), pa.array([data[at[i] : at[i + 1]].tobytes()], pa.binary())], names=["y", "t"])

    found = sorted((bytes(r["t"]), r["y"]) for r in taken.mapInArrow(pick, "y int, t binary").toLocalIterator())
    if not found:
        return None
    data = np.frombuffer(b"".join(t for t, _ in found), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t) for t, _ in found])])
    own, start = chunk_starts(np.diff(at))
    x, n = chunk_bytes(data, at, own, start), np.bincount(own)
    y = np.array([y for _, y in found], np.float32)
    net = ByteConvNet.start()
    net.learn(x, y[own], (1 / n[own]).astype(np.float32), epochs=max(4, min(60, 1200 * 64 // len(x))))
    return net


def score(docs: DataFrame, net: ByteConvNet | None, key: str = "doc_id", text: str = "text", threshold: float = 0.3, carry: bool = False) -> DataFrame:
    """key, score, predicted (1 if score >= threshold); a row for each row. With carry all columns of docs instead of key, and those two
    after them (with underscores after a name that docs has)."""
    tune(docs.sparkSession)
    own = docs.columns if carry else [key]
    names = [fresh(n, own) for n in NEW]
    rows = docs.select(F.struct(*own).alias("own"), *([] if carry else [F.col(text).alias("body")]))
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a few tens of kB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = flat(b.column(0).field(text) if carry else b.column(1))
            p = np.full(b.num_rows, 0.5) if shared.value is None else shared.value.score(data, at)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], names=["own", *NEW])

    out = rows.mapInArrow(run, f"own {rows.schema['own'].dataType.simpleString()}, score double, predicted int")
    return out.select("own.*", *[F.col(c).alias(n) for c, n in zip(NEW, names)])
