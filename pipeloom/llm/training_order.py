"""Token ids in training order, as shards of fixed stride.

Documents are encoded, ended by an end id and cut into sequences of `size` ids. Every sequence has a number: those of one input
split follow each other, and splits follow in the order of their names. A keyed Feistel network permutes the numbers; on
numbers that leave the range it is applied again (cycle-walking), so it is a permutation of exactly 0..N-1. The permuted number
is the sequence's slot. Slots are dealt by range to shards of `slots` records, sorted and written.

A shard is a folder `shard=<n>` that holds one file of records of equal length: document id (8 bytes), number of the
sequence within its document (4), ids in use (4), `size` ids (2 bytes each, little-endian, padded with zeros), and an end mark.
So slot i begins at (i mod slots) * stride of shard i div slots, and reading goes on from any slot: earlier shards aren't read, and
the records before it in its own are passed over. Shards are written by Spark's committer through any storage that Spark writes to,
all or none of a task's.

The folder's manifest says what is being written: seed, sizes, vocabulary, and counts and content sums of the input. A run into a folder
with the same manifest writes only the shards that are missing or short; with another one, or with shards but no manifest, it is refused.

Null and empty texts are a sequence of the end id alone. A null document id is written as -1; ids are whole numbers. Rows with equal ids
are documents of their own. Only key and text are read, so other columns' names don't matter. An empty table gives no shards.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import flat, tune, whole_key
from .vocab import ChunkMemory, byte_level, library

END_MARK = b"\n"
HEAD = 16
ROUNDS = 4


def stride(size: int) -> int:
    return HEAD + 2 * size + len(END_MARK)


def feistel(number: np.ndarray, n: int, key: str) -> np.ndarray:
    """The slots of numbers below n: a permutation of 0..n-1 that the key decides."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(int.from_bytes(hashlib.blake2b(f"{key}/{i}".encode(), digest_size=8).digest(), "big")) for i in range(ROUNDS)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            f = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            f ^= f >> np.uint64(29)
            f *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f >> np.uint64(31)) & mask)
        return (left << np.uint64(half)) | right

    out = once(np.asarray(number, np.uint64))
    while len(outside := np.flatnonzero(out >= n)):
        out[outside] = once(out[outside])
    return out.astype(np.int64)


@lru_cache(maxsize=2)
def _memory(path: str, ranks: str | None) -> ChunkMemory:
    return byte_level(path, ranks)


def _split() -> Column:
    """Names the split of the input that a row comes from; without files, the partition."""
    return F.concat_ws(":", F.input_file_name(), F.lpad(F.input_file_block_start().cast("string"), 20, "0"), F.when(F.input_file_name() == "", F.lpad(F.spark_partition_id().cast("string"), 10, "0")))


def _with_end(ids: np.ndarray, each: np.ndarray, end_id: int) -> np.ndarray:
    out = np.full(len(ids) + len(each), end_id, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(each)), each)] = ids
    return out


def materialise(docs: DataFrame, folder: str, path: str, ranks: str | None = None, key: str = "doc_id", text: str = "text", size: int = 256, slots: int = 32_768, seed: str = "order", end_id: int = 50_256) -> int:
    """Writes the shards to folder and returns the number of sequences.

    docs must give the same rows in the same order in each split when it is read again, as files do: the first pass counts
    sequences by split (two numbers for each split are gathered), the second writes them. A second reading with more, fewer or other
    sequences is an error."""
    if max(library(path).get_vocab(with_added_tokens=True).values()) >= 1 << 16 or not 0 <= end_id < 1 << 16:
        raise ValueError("ids are written in 16 bits; this vocabulary has larger ones")
    spark = docs.sparkSession
    tune(spark)
    rows = docs.select(_split().alias("split"), whole_key(docs, key).alias("id"), F.col(text).alias("body"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}
        for b in batches:
            each, content = _memory(path, ranks).sizes(*flat(b.column("body")))
            for s, m, c in zip(b.column("split").to_pylist(), (-(-(each + 1) // size)).tolist(), content.tolist(), strict=True):
                mine = seen.setdefault(s, [0, 0])
                mine[0] += m
                mine[1] = (mine[1] + c) % SUM
        yield pa.RecordBatch.from_pydict({"split": pa.array(list(seen), pa.string()), "n": pa.array([n for n, _ in seen.values()], pa.int64()), "content": pa.array([c for _, c in seen.values()], pa.int64())})

    # a split is read by one task, so its numbers come in one row
    found = sorted((r["split"], r["n"], r["content"]) for r in rows.mapInArrow(count, "split string, n long, content long").collect())
    first, total = {}, 0
    for s, n, c in found:
        if s in first:
            raise RuntimeError(f"split {s} was read by two tasks")
        first[s] = (total, n, c)
        total += n
    if not total:
        return 0
    shards = -(-total // slots)
    claim(spark, folder, {"seed": seed, "size": size, "slots": slots, "end_id": end_id, "sequences": total, "vocabulary": _file_digest(path), "input": hashlib.sha256(repr(found).encode()).hexdigest()})
    done = present(spark, folder, size, slots, total)
    if done.all():
        return total
    shared = spark.sparkContext.broadcast((first, done))  # three numbers for each split, a byte for each shard

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, ready = shared.value
        used: dict[str, list[int]] = {}
        for b in batches:
            ids, each, content = _memory(path, ranks).runs_and_sums(*flat(b.column("body")))
            ids, each = _with_end(ids, each, end_id), each + 1
            n = -(-each // size)
            doc = np.repeat(np.arange(len(n)), n)
            part = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            splits = b.column("split").to_pylist()
            base = np.empty(len(n), np.int64)
            for i, (s, m, c) in enumerate(zip(splits, n.tolist(), content.tolist(), strict=True)):
                mine = used.setdefault(s, [0, 0])
                if s not in starts or mine[0] + m > starts[s][1]:
                    raise RuntimeError(f"split {s} has more sequences than before; the input has changed")
                base[i] = starts[s][0] + mine[0]
                mine[0] += m
                mine[1] = (mine[1] + c) % SUM
            slot = feistel(base[doc] + part, total, seed)
            length = np.minimum(size, each[doc] - part * size)
            body = np.zeros((len(doc), size), "<u2")
            begin = (np.cumsum(each) - each)[doc] + part * size
            inside = np.arange(size) < length[:, None]
            body[inside] = ids[(begin[:, None] + np.arange(size))[inside]]
            head = np.zeros(len(doc), [("id", "<i8"), ("part", "<i4"), ("n", "<i4")])
            own = np.array([-1 if x is None else x for x in b.column("id").to_pylist()], np.int64)
            head["id"], head["part"], head["n"] = own[doc], part, length
            whole = np.concatenate([head.view(np.uint8).reshape(len(doc), HEAD), body.view(np.uint8)], 1)
            keep = ~ready[slot // slots]
            raw, width = whole[keep].tobytes(), whole.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(slot[keep]), pa.array([raw[i : i + width] for i in range(0, len(raw), width)], pa.binary())], names=["slot", "record"])
        if changed := [s for s, seen in used.items() if tuple(seen) != starts[s][1:]]:
            raise RuntimeError(f"splits {changed[:3]} have other sequences than before; the input has changed")

    made = rows.mapInArrow(records, "slot long, record binary").withColumn("shard", F.floor(F.col("slot") / slots).cast("int"))
    tasks = min(shards, 100_000)
    (
        made.repartitionById(tasks, F.floor(F.col("shard") * tasks / shards).cast("int")).sortWithinPartitions("shard", "slot")
        .select(F.col("record").cast("string").alias("value"), "shard")  # a cast keeps the bytes as they are
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("lineSep", END_MARK.decode()).partitionBy("shard").text(folder)
    )
    if not present(spark, folder, size, slots, total).all():
        raise RuntimeError("shards are missing after the run; the input has changed")
    return total


#: Content sums are kept below this.
SUM = 1 << 62


def _file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def claim(spark: SparkSession, folder: str, manifest: dict) -> None:
    """Writes the folder's manifest, or holds what is there against it."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    where = hadoop.Path(folder)
    fs, note = where.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop.Path(folder, "_manifest.json")
    if fs.exists(note):
        stream = fs.open(note)
        try:
            known = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        if other := sorted(k for k in {*known, *manifest} if known.get(k) != manifest.get(k)):
            raise ValueError(f"{folder} holds shards of another run; different: {', '.join(other)}")
        return
    if fs.exists(where) and any(s.getPath().getName().startswith("shard=") for s in fs.listStatus(where)):
        raise ValueError(f"{folder} holds shards without a manifest")
    stream = fs.create(note, True)
    try:
        stream.write(json.dumps(manifest).encode())
    finally:
        stream.close()


def present(spark: SparkSession, folder: str, size: int, slots: int, total: int) -> np.ndarray:
    """Whether each shard has all its records; one listing of the folder, by tasks if it is large."""
    shards = -(-total // slots)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    shard = F.regexp_extract("path", r"/shard=(\d+)/[^/]*$", 1)
    there = files.select(shard.alias("shard"), "length").where("shard <> ''").groupBy(F.col("shard").cast("long").alias("shard")).agg(F.sum("length").alias("length"))
    expected = F.least(F.lit(slots), F.lit(total) - F.col("shard") * slots) * stride(size)
    whole = there.where((F.col("shard") < shards) & (F.col("length") == expected)).select("shard").toArrow().column(0).to_numpy()
    out = np.zeros(shards, bool)
    out[whole] = True
    return out


def read_shards(spark: SparkSession, folder: str, size: int = 256, slots: int = 32_768, start: int = 0) -> DataFrame:
    """slot, doc_id, part, n_tokens, ids (little-endian unsigned 16-bit integers, without padding) from written shards, from slot
    start on. Files of shards before it are left out; its own shard is loaded as one file and read from the record on."""
    width = stride(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, content in zip(b.column("shard").to_pylist(), b.column("content"), strict=True):
                raw = np.frombuffer(content.as_buffer(), np.uint8)
                if len(raw) % width:
                    raise ValueError(f"shard {shard} is cut off")
                for i in range(max(0, start - shard * slots), len(raw) // width, 4096):
                    part = raw.reshape(-1, width)[i : i + 4096]
                    head = np.ascontiguousarray(part[:, :HEAD]).view([("id", "<i8"), ("part", "<i4"), ("n", "<i4")]).ravel()
                    ids = [bytes(x[HEAD : HEAD + 2 * n]) for x, n in zip(part, head["n"].tolist(), strict=True)]
                    slot = np.arange(i, i + len(part), dtype=np.int64) + shard * slots
                    yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(head["id"].copy()), pa.array(head["part"].copy()), pa.array(head["n"].copy()), pa.array(ids, pa.binary())], names=["slot", "doc_id", "part", "n_tokens", "ids"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").option("basePath", folder).load(folder)
    return files.where(F.col("shard") >= start // slots).select(F.col("shard").cast("long").alias("shard"), "content").mapInArrow(run, "slot long, doc_id long, part int, n_tokens int, ids binary")
