"""Byte-level BPE by tree concatenation.

A run that the pattern doesn't split is halved until its parts are short; the parts are encoded on their own and joined pairwise. At a
join, a window of tokens on both sides is encoded again, and grows until its first token and its last are those that stood there
before. Then each pair of neighbours is one that the merges leave alone, within the window as at its edges, so the whole is
the encoding of the whole run.

Texts of up to SPREAD bytes are encoded where they are. Longer ones are cut into parts that become rows of their own and are encoded in
parallel tasks on any executor; the parts of a text meet again for the joins, which only touch the windows. A part ends
where the pattern can't join both sides; only runs of over PART bytes are cut inside (glue).

Null and empty texts have no tokens; special strings inside texts are one token each, as the library's default has it. Rows with repeated
or null keys are rows of their own. Of docs only key and text are read, so other columns' names don't matter. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, tune, width
from .vocab import SPLIT, ChunkMemory, Merges, chunks, merges

#: Runs up to LEAF bytes are encoded as they are; texts of over SPREAD bytes go to several tasks in parts of about PART bytes.
LEAF, SPREAD, PART = 48, 1 << 16, 1 << 15


def even(place: int, size: int) -> int:
    """The place, brought down to a multiple of a power of two of about an eighth of size: in runs of one character, whose tokens have such lengths, both
    sides of a cut there agree at once."""
    step = 1 << max(0, size.bit_length() - 4)
    return max(1, place // step * step)


class TreeEncoder:
    def __init__(self, path: str):
        self.merges: Merges = merges(path)
        self.pieces: dict[bytes, list[int]] = {}
        self.specials = {s.encode(): i for s, i in self.merges.special.items()}
        self.table = [self.merges.bytes_of.get(i) for i in range(max(self.merges.bytes_of) + 1)]
        for s, i in self.merges.special.items():
            self.table += [None] * (i + 1 - len(self.table))
            self.table[i] = s.encode()

    def run(self, data: bytes, leaf: int = LEAF) -> list[int]:
        """The ids of one piece."""
        if len(data) <= leaf:
            return self.merges.plain(data)
        half = even(len(data) // 2, len(data))
        return self.join(self.run(data[:half], leaf), self.run(data[half:], leaf))

    def join_all(self, parts: list[list[int]]) -> list[int]:
        """The ids of a run from those of its parts, pairwise."""
        while len(parts) > 1:
            parts = [self.join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        n = 2
        while True:
            a, b = left[-n:], right[:n]
            window = b"".join(self.table[i] for i in a + b)
            ids = self.merges.plain(window)
            from_start, to_end = len(a) == len(left), len(b) == len(right)
            if (from_start or ids[0] == a[0]) and (to_end or ids[-1] == b[-1]):
                return left[: len(left) - len(a)] + ids + right[len(b) :]
            n *= 2

    def piece(self, piece: bytes) -> list[int]:
        """The ids of a piece of the pattern, or of a special string."""
        special = self.specials.get(piece)
        if special is not None:
            return [special]
        ids = self.pieces.get(piece)
        if ids is None:
            ids = self.run(piece)
            if len(piece) <= 32:
                if len(self.pieces) > 200_000:
                    self.pieces.clear()
                self.pieces[piece] = ids
        return ids

    def split(self, text: str) -> list[bytes]:
        """The pieces of the pattern and the special strings of a text."""
        return [p.encode() for part, special in self.merges.segments(text) for p in ([part] if special is not None else SPLIT.findall(part))]

    def encode(self, text: str) -> list[int]:
        return [i for p in self.split(text) for i in self.piece(p)]

    def of_chunk(self, part: bytes) -> list[int]:
        if part.isalpha() or part[:1] == b" " and part[1:].isalpha():  # one piece
            return self.run(part)
        return self.encode(part.decode())

    def parts(self, data: np.ndarray, most: int = PART) -> Iterator[tuple[bool, bool, list[bytes]]]:
        """(glue, text, pieces) of each part of a long text (its bytes): glue: it goes on in the middle of the run that the part before
        ends in; text: it is a text of its own, not a list of pieces."""
        whole = data.tobytes()
        start, stop, _ = chunks(data, np.array([0, len(data)]), True, not any(s in whole for s in self.specials))
        begin, pieces = 0, []
        for s, e in zip(start.tolist(), stop.tolist(), strict=True):
            if e - s > most:  # a chunk that is too long for a part
                if s > begin:
                    yield False, True, [whole[begin:s]]
                begin, size = e, 0
                for p in self.split(whole[s:e].decode()):
                    if len(p) > most and p not in self.specials:
                        if pieces:
                            yield False, False, pieces
                        n = 1 << (-(-len(p) // most) - 1).bit_length()  # halves of halves
                        edges = [0, *[even(len(p) * k // n, most) for k in range(1, n)], len(p)]
                        for k in range(n):
                            yield k > 0, False, [p[edges[k] : edges[k + 1]]]
                        pieces, size = [], 0
                        continue
                    pieces.append(p)
                    size += len(p)
                    if size >= most:
                        yield False, False, pieces
                        pieces, size = [], 0
                if pieces:
                    yield False, False, pieces
                    pieces = []
            elif e - begin >= most:
                yield False, True, [whole[begin:e]]
                begin = e
        if begin < len(whole):
            yield False, True, [whole[begin:]]

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> TreeEncoder:
    return TreeEncoder(path)


@lru_cache(maxsize=2)
def _memory(path: str) -> ChunkMemory:
    own = encoder(path)
    return ChunkMemory(lambda parts: [own.of_chunk(p) for p in parts], True, list(own.specials))


def _binaries(ids: np.ndarray, each: np.ndarray) -> pa.Array:
    """The ids of each text as little-endian unsigned 32-bit integers."""
    raw, ends = ids.astype("<u4").tobytes(), np.concatenate([[0], np.cumsum(each)]).tolist()
    return pa.array([raw[4 * s : 4 * e] for s, e in zip(ends, ends[1:])], pa.binary())


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", spread: int = SPREAD, part: int = PART) -> DataFrame:
    """key, n_tokens, ids (little-endian unsigned 32-bit integers, end to end) of every whole text; a row for each row."""
    tune(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key), F.col(text).alias("__text"))
    size = F.coalesce(F.octet_length("__text"), F.lit(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _memory(path)
        for b in batches:
            ids, each, _, _ = memory.runs(*flat(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(each.astype(np.int64)), _binaries(ids, each)], names=[key, "n_tokens", "ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for b in batches:
            for i in range(b.num_rows):
                data, _ = flat(b.column(2).slice(i, 1))
                found = list(own.parts(data, part))
                which = pa.array([i] * len(found))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(which), b.column(1).take(which), pa.array(range(len(found)), pa.int32()), pa.array([g for g, _, _ in found]), pa.array([w for _, w, _ in found]), pa.array([p for _, _, p in found], pa.list_(pa.binary()))],
                    names=["__row", key, "place", "glue", "text", "pieces"],
                )

    def encode_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, memory = encoder(path), _memory(path)
        for b in batches:
            out = []
            for as_text, pieces in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True):
                if as_text:
                    ids = memory.runs(np.frombuffer(pieces[0], np.uint8), np.array([0, len(pieces[0])]))[0]
                else:
                    ids = np.array([i for p in pieces for i in own.piece(p)], np.uint32)
                out.append(ids.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(out, pa.binary())], names=["__row", key, "place", "glue", "ids"])

    def gather(group: pa.Table) -> pa.Table:
        group = group.sort_by("place")
        own, runs = encoder(path), []
        for glue, ids in zip(group.column("glue").to_pylist(), group.column("ids").to_pylist(), strict=True):
            found = np.frombuffer(ids, "<u4")
            if glue:
                runs[-1].append(found.tolist())
            else:
                runs.append([found.tolist()])
        ids = np.array([i for r in runs for i in own.join_all(r)], np.uint32)
        return pa.table([group.column(key).slice(0, 1), pa.array([len(ids)], pa.int64()), _binaries(ids, np.array([len(ids)]))], names=[key, "n_tokens", "ids"])

    result = f"`{key}` {kind}, n_tokens long, ids binary"
    short = rows.where(size <= spread).mapInArrow(run, result)
    # the number of a row is made once, before the parts are dealt out, and only serves to bring them together again
    long = rows.where(size > spread).select(F.monotonically_increasing_id().alias("__row"), key, "__text").mapInArrow(cut, f"__row long, `{key}` {kind}, place int, glue boolean, text boolean, pieces array<binary>")
    spread_out = long.repartition(width(docs), "__row", "place").mapInArrow(encode_parts, f"__row long, `{key}` {kind}, place int, glue boolean, ids binary")
    return short.union(spread_out.groupBy("__row").applyInArrow(gather, result))


def decode(encoded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """Adds to the rows of encode() the column decoded: the text of the ids, special strings included; null ids give ''."""
    tune(encoded.sparkSession)
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for b in batches:
            texts = [own.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[key, "n_tokens", "ids", "decoded"])

    return encoded.select(key, "n_tokens", "ids").mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids binary, decoded string")
