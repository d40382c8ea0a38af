"""Lexical retrieval packing.

Documents are dealt by their content into shards of about SHARD_TOKENS tokens, so that like documents meet however many
shards there are (see topics.py); a cell of like documents that fills several shards is dealt over them by a hash. Each shard keeps an inverted index of
its documents' token ids with BM25 weights, whose document frequencies and mean length are those of the whole corpus. A
window of `size` tokens begins with a seed document; the seed is the query, and its best unused neighbours fill the window one
after another. The document that doesn't fit is cut there; its rest begins the next window, as its seed. If no neighbour is left,
the unused document with the smallest id is next. The shard's last, unfilled window is cut into sequences whose lengths are
powers of two, which need no padding.

A document is its ids and one end id after them; null and empty texts are the end id alone. Documents of over SEGMENT ids are dealt to shards
in segments of as many ids, whole windows each, so that no task holds a giant. Rows with equal ids of null or
repeated keys are documents of their own. Keys are whole numbers. Only key and text are read, so other columns' names don't matter. An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import topics
from .common import flat, kept_table, tune, whole_key
from .vocab import ChunkMemory, take_runs, word_level

#: Tokens of a shard, about; a shard is handled in one task.
SHARD_TOKENS = 500_000
#: Ids of a segment of a long document, a multiple of all usual window sizes.
SEGMENT = 1 << 16
#: BM25's usual constants.
K1, B = 1.2, 0.75


@lru_cache(maxsize=2)
def _memory(path: str) -> ChunkMemory:
    return word_level(path)


def tokenised(data: np.ndarray, at: np.ndarray, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, each followed by end_id, end to end, and how many each text has."""
    ids, each, _, _ = _memory(path).runs(data, at)
    out = np.full(len(ids) + len(each), end_id, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(each)), each)] = ids
    return out, each + 1


def distinct_cells(of: np.ndarray, ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (document, id) of all ids, in order, and how often each occurs."""
    n = int(of[-1]) + 1 if len(of) else 0
    cells = of * width + ids
    cells = np.sort(cells.astype(np.uint32) if n * width < 1 << 32 else cells)
    first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]])) if len(cells) else np.zeros(0, np.int64)
    found = cells[first].astype(np.int64)
    return found // width, found % width, np.diff(np.append(first, len(cells)))


def saturated(tf: np.ndarray, length: np.ndarray, mean: float) -> np.ndarray:
    """BM25's weight of a term without its idf."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def inverse_frequency(df: np.ndarray, n: int) -> np.ndarray:
    return np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)


def vectors(ids: np.ndarray, each: np.ndarray, idf: np.ndarray, mean: float) -> np.ndarray:
    doc, term, tf = distinct_cells(np.repeat(np.arange(len(each)), each), ids.astype(np.int64), len(idf))
    return topics.sums(doc, term, (idf[term] * saturated(tf, each[doc], mean)).astype(np.float32), len(each))


def segments(each: np.ndarray, most: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and length of each segment of documents with so many ids."""
    n = -(-each // most)
    of = np.repeat(np.arange(len(each)), n)
    start = (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)) * most
    return of, start, np.minimum(most, each[of] - start)


def token_table(docs: DataFrame, path: str, end_id: int, key: str, text: str, tree: Broadcast | None = None) -> DataFrame:
    """id, start, doc_tokens (of the whole document), ids (little-endian unsigned 16-bit integers), n (how many) and cell (of the tree) of each segment,
    written once and read again."""
    tune(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, whole = tokenised(*flat(b.column(1)), path, end_id)
            of, start, each = segments(whole)
            raw, ends = ids.astype("<u2").tobytes(), np.concatenate([[0], np.cumsum(each)]).tolist()
            cell = tree.value.cells(vectors(ids, each, tree.value.idf, tree.value.mean)) if tree else np.zeros(len(each), np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(of)), pa.array(start), pa.array(whole[of].astype(np.int64)), pa.array([raw[2 * s : 2 * e] for s, e in zip(ends, ends[1:])], pa.binary()), pa.array(each.astype(np.int64)), pa.array(cell)],
                names=["id", "start", "doc_tokens", "ids", "n", "cell"],
            )

    return kept_table(docs.select(whole_key(docs, key).alias("id"), F.col(text).alias("body")).mapInArrow(encode, "id long, start long, doc_tokens long, ids binary, n long, cell long"))


def content_tree(docs: DataFrame, path: str, end_id: int, key: str, text: str, vocabulary: int, shard_tokens: int) -> topics.Tree:
    """The tree of centres, with about a leaf for each shard and topics.MOST leaves at most, from a sample of the documents. Gathers topics.EACH vectors
    (of DIM bytes) a leaf. With more shards than leaves, a leaf goes by its cells and then by a hash over several shards."""
    total = docs.count()
    rows = lambda share: docs.where(F.pmod(F.xxhash64(key, text, F.lit(9)), F.lit(1 << 24)) < int(share * (1 << 24)) + 1) if share < 1 else docs
    _, n, tokens = corpus_statistics(first := token_table(rows(topics.LEAST / max(1, total)), path, end_id, key, text), vocabulary)
    mean = max(1.0, tokens / max(1, n))
    leaves = min(topics.MOST, max(1, round(total * mean / shard_tokens)))
    wanted = topics.EACH * leaves
    sample = token_table(rows(wanted / total), path, end_id, key, text) if min(wanted, total) > topics.LEAST else first
    df, n, tokens = corpus_statistics(sample, vocabulary)
    idf, mean = inverse_frequency(df, n), max(1.0, tokens / max(1, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = flat(b.column(0))
            x = topics.whole(vectors(data.view("<u2"), np.diff(at) // 2, idf, mean)).astype(np.int8)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary())], names=["x"])

    found = [bytes(r["x"]) for r in sample.select("ids").mapInArrow(run, "x binary").collect()]
    return topics.Tree.grow(np.frombuffer(b"".join(found), np.int8).reshape(-1, topics.DIM).astype(np.float32), leaves, idf, mean)


def corpus_statistics(tokens: DataFrame, vocabulary: int) -> tuple[np.ndarray, int, int]:
    """For each id the number of documents that hold it; documents; tokens. Gathers one number for each id of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total = np.zeros(vocabulary + 2, np.int64), 0, 0
        for b in batches:
            data, at = flat(b.column(0))
            ids, each = data.view("<u2").astype(np.int64), np.diff(at) // 2
            _, terms, _ = distinct_cells(np.repeat(np.arange(len(each)), each), ids, vocabulary)
            df[:vocabulary] += np.bincount(terms, minlength=vocabulary)
            n += len(each)
            total += len(ids)
        df[vocabulary:] = n, total
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(df[some])], names=["id", "n"])

    df = np.zeros(vocabulary + 2, np.int64)
    for r in tokens.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        df[r["id"]] = r["n"]
    return df[:vocabulary], int(df[vocabulary]), int(df[vocabulary + 1])


def fill_windows(ids: np.ndarray, each: np.ndarray, idf: np.ndarray, mean: float, size: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one shard's documents; each id of a document lies in one piece."""
    n = len(each)
    begin = np.cumsum(each) - each
    of = np.repeat(np.arange(n), each)
    width = len(idf)
    doc, term, tf = distinct_cells(of, ids, width)
    weight = (idf[term] * saturated(tf, each[doc], mean)).astype(np.float32)
    terms_at = np.searchsorted(doc, np.arange(n + 1))
    by_term = np.argsort(term, kind="stable")  # the postings of each term, documents ascending
    sorted_term = term[by_term]
    posting_doc, posting_weight = doc[by_term], weight[by_term]
    low, high = np.searchsorted(sorted_term, term, "left"), np.searchsorted(sorted_term, term, "right")

    unused = np.ones(n, bool)
    oldest = 0
    pieces: list[tuple[int, int, int, int, int]] = []
    sequence, offset = 0, 0
    neighbours: Iterator[int] = iter(())

    def ranked(seed: int) -> Iterator[int]:
        part = slice(terms_at[seed], terms_at[seed + 1])
        at = take_runs(np.arange(len(posting_doc)), low[part], high[part])
        score = np.bincount(posting_doc[at], posting_weight[at], n)
        score[~unused] = 0
        wanted = min(64, n)
        while True:  # the best ones first, more only if they are asked for
            top = np.argpartition(-score, wanted - 1)[:wanted] if wanted < n else np.arange(n)
            top = top[np.lexsort((top, -score[top]))]
            for k in top.tolist():
                if score[k] <= 0:
                    return
                if unused[k]:
                    yield k
            if wanted >= n:
                return
            wanted = min(n, wanted * 8)

    left: tuple[int, int] | None = None  # a document that was cut, and where
    while True:
        if left is None:
            k = next(neighbours, None) if offset else None
            if k is None:
                while oldest < n and not unused[oldest]:
                    oldest += 1
                if oldest == n:
                    break
                k = oldest
            unused[k] = False
            at = 0
        else:
            k, at = left
            left = None
        if not offset:
            neighbours = ranked(k)
        m = min(size - offset, int(each[k]) - at)
        pieces.append((k, at, m, sequence, offset))
        offset += m
        if at + m < each[k]:
            left = (k, at + m)
        if offset == size:
            sequence, offset = sequence + 1, 0
    if offset and offset & (offset - 1):  # the last window: lengths that are powers of two
        last = [p for p in pieces if p[3] == sequence]
        pieces = pieces[: len(pieces) - len(last)]
        room, rest = 0, offset
        for k, at, m, _, _ in last:
            while m:
                if not room:
                    room = 1 << (rest.bit_length() - 1)
                    whole, rest = room, rest - room
                    sequence += 1
                take = min(m, room)
                pieces.append((k, at, take, sequence - 1, whole - room))
                at, m, room = at + take, m - take, room - take
    return pieces


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", size: int = 2048, end_id: int = 1, vocabulary: int = 49_408, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """A row for each piece: key, start (ids of its document before it), length, ids (little-endian unsigned 32-bit
    integers), doc_tokens, sequence_id, offset (in its sequence)."""
    assert vocabulary <= 1 << 16
    spark = docs.sparkSession
    tune(spark)
    tree = spark.sparkContext.broadcast(content_tree(docs, path, end_id, key, text, vocabulary, shard_tokens))  # DIM numbers for each leaf: 34 MB at most
    table = token_table(docs, path, end_id, key, text, tree)
    df, n, tokens = corpus_statistics(table, vocabulary)
    idf, mean = inverse_frequency(df, n), max(1.0, tokens / max(1, n))
    shared = spark.sparkContext.broadcast(idf)  # a number for each id of the vocabulary
    # a shard is full by tokens or by rows; the cells, 16 for each leaf and so a million at most, are gathered and broadcast
    load = {r["cell"]: (r["tokens"] + r["n"] * mean) / 2 / shard_tokens for r in table.groupBy("cell").agg(F.sum("n").alias("tokens"), F.count("*").alias("n")).collect()}
    places = spark.createDataFrame(topics.deal(load), "cell long, first long, parts long")
    dealt = table.join(F.broadcast(places), "cell").select("id", "start", "doc_tokens", "ids", (F.col("first") + F.pmod(F.xxhash64("id", "start", "ids", F.lit(5)), F.col("parts"))).alias("shard"))

    def one(group: pa.Table) -> pa.Table:
        group = group.take(pa.compute.sort_indices(group, [("id", "ascending"), ("start", "ascending"), ("ids", "ascending")]))
        shard = group.column("shard")[0].as_py()
        ids = np.frombuffer(b"".join(group.column("ids").to_pylist()), "<u2").astype(np.int64)
        each = np.array([len(x) // 2 for x in group.column("ids").to_pylist()], np.int64)
        begin = np.cumsum(each) - each
        pieces = fill_windows(ids, each, shared.value, mean, size)
        k, start, length, sequence, offset = (np.array(x, np.int64) for x in zip(*pieces))
        raw = ids.astype("<u4").tobytes()
        at = (begin[k] + start).tolist()
        first, total = (group.column(c).to_numpy()[k] for c in ("start", "doc_tokens"))
        return pa.table({
            "id": group.column("id").combine_chunks().take(pa.array(k)), "start": first + start, "length": length,
            "ids": pa.array([raw[4 * s : 4 * (s + m)] for s, m in zip(at, length.tolist())], pa.binary()),
            "doc_tokens": total, "sequence_id": (shard << 32) + sequence, "offset": offset,
        })

    found = dealt.groupBy("shard").applyInArrow(one, "id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return found.withColumnRenamed("id", key)
