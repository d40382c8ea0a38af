"""Language identification by nearest centroids of TF-IDF n-gram vectors.

Features are hashed trigrams of lower-cased bytes (anything but letters counts as one space), weighted by the square root of
their count and by inverse document frequency over all rows that may be learned from, and normalised. Each language's
sampled vectors are clustered into a few centroids (spherical k-means); a text gets the language of the centroid with
the largest cosine. A text is rejected if that cosine is below a share (NEAR) of what the least typical training text of the
centroid has, or if it is null or has no letter (language `und`, score 0); of texts of fewer than 64 trigrams, whose cosines
are small by nature, less is asked, by the square root of their number.

The sample that centroids are fitted on is bounded: at most PER_LANGUAGE rows of each language, in the order of a hash of key and
text. Without rows to learn from, every text is `und`. Repeated rows get equal results, null keys are rows like others, an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LETTER, flat, fresh, tune

#: Hashed dimensions; training rows of a language (a bound on the sample); centroids of a language.
DIMENSIONS, PER_LANGUAGE, CENTROIDS = 4096, 300, 3

#: A text is rejected below this share of the smallest training cosine.
NEAR = 0.3

#: The columns that identify adds.
NEW = ("lang_pred", "score", "rejected")

_CLASS = np.full(256, 0x20, np.uint32)
_CLASS[0x41:0x5B] = np.arange(0x61, 0x7B)
_CLASS[0x61:0x7B] = np.arange(0x61, 0x7B)
_CLASS[0x80:] = np.arange(0x80, 0x100)


def counts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How often each hashed trigram stands in each text; texts are framed by spaces."""
    n = len(at) - 1
    padded = np.full(len(data) + 2 * n, 0x20, np.uint32)
    own = np.arange(len(data)) + 1 + 2 * np.repeat(np.arange(n), np.diff(at))
    padded[own] = _CLASS[data]
    if len(padded) < 3:
        return np.zeros((n, DIMENSIONS), np.float32)
    a, b, c = padded[:-2], padded[1:-1], padded[2:]
    cell = ((a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77) + c * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)) >> np.uint32(20)
    text = np.repeat(np.arange(n), np.diff(at) + 2)[:-2]
    ends = at[1:] + 2 * np.arange(1, n + 1)
    keep = ~((a == 0x20) & (b == 0x20)) & (b != 0x20)  # around a letter, once
    keep[np.maximum(ends[:-1] - 2, 0)] = False  # not across two texts
    keep[np.minimum(ends[:-1] - 1, len(keep) - 1)] = False
    return np.bincount(text[keep] * DIMENSIONS + cell[keep], minlength=n * DIMENSIONS).reshape(n, DIMENSIONS).astype(np.float32)


@dataclass
class LanguageModel:
    languages: list[str]  # of each centroid
    idf: np.ndarray
    centroids: np.ndarray
    least: np.ndarray  # the smallest cosine of each centroid's training texts

    def vectors(self, found: np.ndarray) -> np.ndarray:
        x = np.sqrt(found) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def predict(self, data: np.ndarray, at: np.ndarray, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine and whether it is rejected, of each text."""
        lettered = np.array([bool(t) and LETTER.search(t) is not None for t in texts], bool)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        found = counts(data, at)
        near = self.vectors(found) @ self.centroids.T
        best = near.argmax(1)
        score = np.clip(near[np.arange(len(best)), best], 0, 1) * lettered
        return [self.languages[k] if ok else "und" for k, ok in zip(best, lettered, strict=True)], score.astype(float), ~lettered | (score < NEAR * self.least[best] * np.sqrt(np.minimum(1, found.sum(1) / 64)))


def _cluster(x: np.ndarray, k: int, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of unit vectors by cosine, and the nearest one of each vector; begins with vectors far from each other."""
    mean = x.mean(0)
    chosen = [int((x @ mean).argmax())]
    while len(chosen) < min(k, len(x)):
        chosen.append(int((x @ x[chosen].T).max(1).argmin()))
    c = x[chosen]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        c = np.stack([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c, (x @ c.T).argmax(1)


def fit(train: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, centroids: int = CENTROIDS) -> LanguageModel:
    """Learns from the rows of train that have a language and a text: document frequencies over all of them, centroids
    from a sample of at most per_language rows of each language."""
    tune(train.sparkSession)
    rows = train.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l"))
    sizes = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return LanguageModel([], np.ones(DIMENSIONS, np.float32), np.zeros((0, DIMENSIONS), np.float32), np.zeros(0))

    def document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIMENSIONS, np.int64)
        for b in batches:
            total += (counts(*flat(b.column(0))) > 0).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMENSIONS, dtype=np.int32)), pa.array(total)], names=["cell", "n"])

    df = np.zeros(DIMENSIONS)
    for r in rows.select("t").mapInArrow(document_frequency, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        df[r["cell"]] = r["n"]
    total = sum(sizes.values())
    idf = (np.log((1 + total) / (1 + df)) + 1).astype(np.float32)

    # a first choice by chance leaves some more than enough rows of each language, of which the first ones by hash are taken
    share = F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, 2 * (per_language + 50) / n)])[F.col("l")]
    dice: Column = F.xxhash64("k", "t", F.lit(9))
    chosen = rows.where(F.pmod(dice, F.lit(1 << 30)) / float(1 << 30) < share).select("t", "l", dice.alias("d"), F.xxhash64("t", F.lit(10)).alias("e"))

    def vector(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = counts(*flat(b.column(0)))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([x.astype("<u2").tobytes() for x in np.minimum(found, 65535)], pa.binary())], names=["l", "d", "e", "v"])

    place = F.row_number().over(Window.partitionBy("l").orderBy("d", "e"))
    first = chosen.mapInArrow(vector, "l string, d long, e long, v binary").withColumn("place", place).where(F.col("place") <= per_language)
    sample: dict[str, list[bytes]] = {}
    for r in first.select("l", "v").collect():  # per_language vectors of each language
        sample.setdefault(r["l"], []).append(bytes(r["v"]))
    model = LanguageModel([], idf, np.zeros((0, DIMENSIONS), np.float32), np.zeros(0))
    for name, vectors in sorted(sample.items()):
        x = model.vectors(np.stack([np.frombuffer(v, "<u2") for v in sorted(vectors)]).astype(np.float32))
        x = x[np.abs(x).sum(1) > 0]
        if not len(x):
            continue
        c, near = _cluster(x, centroids)
        for j in range(len(c)):
            if (near == j).any():
                model.languages.append(name)
                model.centroids = np.vstack([model.centroids, c[j : j + 1]])
                model.least = np.append(model.least, (x[near == j] @ c[j]).min())
    return model


def identify(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """key, lang_pred, score (cosine), rejected; a row for each row. With carry all columns of docs instead of key, and those three
    after them (with underscores after a name that docs has)."""
    tune(docs.sparkSession)
    own = docs.columns if carry else [key]
    names = [fresh(n, own) for n in NEW]
    rows = docs.select(F.struct(*own).alias("own"), *([] if carry else [F.col(text).alias("body")]))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred kB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).field(text) if carry else b.column(1)
            found, score, far = shared.value.predict(*flat(texts), texts.to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string()), pa.array(score), pa.array(far)], names=["own", *NEW])

    out = rows.mapInArrow(run, f"own {rows.schema['own'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")
    return out.select("own.*", *[F.col(c).alias(n) for c, n in zip(NEW, names)])
