"""Token counts by dynamic programming over prefixes.

For each prefix of a piece, the encoding of the prefix ends in exactly one token t such that the encoding of what stands
before t, followed by t, is left alone by the merges; it is enough that t and the token before it are (merges only act
across neighbours). So one pass from left to right finds the last token and the count of every prefix. The counts of all prefixes
of a text are stored with it (prefix_table): a byte a character, as differences. Questions about truncation, budgets and places
are answered from the stored counts alone, without encoding again.

Null and empty texts have no tokens. Special strings inside texts are one token each, as the library's default has it; an
unfinished one is ordinary text. Rows with repeated or null keys are rows of their own, and other columns aren't read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, kept_table, tune
from .vocab import SPLIT, WHITE, ChunkMemory, Merges, merges


class PrefixCounts:
    """Counts of tokens at every prefix under a byte-level vocabulary."""

    def __init__(self, path: str):
        self.merges: Merges = merges(path)
        # tokens whose own bytes are encoded as the token
        self.alone = {b: i for b, i in self.merges.id_of.items() if self.merges.plain(b) == [i]}
        self.fits: dict[tuple[int, int], bool] = {}

    def fit(self, left: int, right: int) -> bool:
        """Whether left, right stays as it is: no merge joins the two while they are being built.

        While left is built, its last part grows through the right ends of its merges; right's first part through the left
        ends. Going back from the finished tokens, the part that was made last is undone first; a merge of the two parts
        that stand side by side, ranked before the next growth of either, would have come first."""
        m, a, b = self.merges, left, right
        until_a = until_b = 1 << 60  # the rank at which the part of a (b) grows further
        good = True
        while True:
            across = m.merged.get((a, b))
            if across is not None and across[0] < until_a and across[0] <= until_b:
                good = False
                break
            ra, rb = m.born[a], m.born[b]
            if ra < 0 and rb < 0:
                break
            if ra > rb:
                until_a, a = ra, m.halves[a][1]
            else:
                until_b, b = rb, m.halves[b][0]
        if len(self.fits) > 2_000_000:
            self.fits.clear()
        self.fits[left, right] = good
        return good

    def piece(self, data: bytes) -> list[int]:
        """Counts of the prefixes of 0, 1, ... bytes of a piece."""
        token, longest, fits, fit = self.alone.get, self.merges.longest, self.fits.get, self.fit
        last, count = [-1], [0]
        for end in range(1, len(data) + 1):
            t = token(data[:end]) if end <= longest else None
            if t is not None:
                last.append(t)
                count.append(1)
                continue
            for begin in range(end - 1, max(0, end - longest - 1), -1):  # exactly one fits; short ones are likelier
                t = token(data[begin:end])
                if t is not None:
                    pair = (last[begin], t)
                    good = fits(pair)
                    if fit(*pair) if good is None else good:
                        last.append(t)
                        count.append(count[begin] + 1)
                        break
        return count

    def _plain(self, text: str) -> int:
        return sum(self.piece(x.encode())[-1] for x in SPLIT.findall(text))

    def prefixes(self, text: str) -> np.ndarray:
        """Tokens of text[:0], text[:1], ..., text[:len(text)], each as if encoded alone."""
        out, before, white, lead = [0], 0, "", 0
        tail, base = "", 0  # the last piece, and the count before it
        for part, special in self.merges.segments(text):
            if special is not None:
                # an unfinished special string is ordinary text; it can only change the last piece before it
                out += [base + self._plain(tail + part[:k]) for k in range(1, len(part))]
                before += 1
                out.append(before)
                white, tail, base = "", "", before
                continue
            for piece in SPLIT.findall(part):
                at = self._by_character(piece)
                for k in range(1, len(piece) + 1):
                    head = piece[:k]
                    if k < len(piece) and piece[0] == "'" and len(piece) == 3 and piece[1].isalpha():
                        out.append(before + self._plain(head))
                    elif white and WHITE.fullmatch(head):
                        out.append(lead + self.piece((white + head).encode())[-1])
                    else:
                        out.append(before + at[k])
                white, lead = (piece, before) if WHITE.fullmatch(piece) else ("", 0)
                tail, base = piece, before
                before += at[-1]
        return np.array(out, np.int64)

    def _by_character(self, piece: str) -> list[int]:
        counts = self.piece(piece.encode())
        at, ends = 0, [0]
        for c in piece:
            at += len(c.encode())
            ends.append(at)
        return [counts[e] for e in ends]

    def of_chunk(self, part: bytes):
        """The counts of the prefixes of 1, 2, ... characters."""
        if part.isalpha() or part[:1] == b" " and part[1:].isalpha():  # one piece, a byte a character
            return self.piece(part)[1:]
        return self.prefixes(part.decode())[1:]


@lru_cache(maxsize=2)
def _memory(path: str) -> ChunkMemory:
    counter = PrefixCounts(path)
    return ChunkMemory(lambda parts: [counter.of_chunk(p) for p in parts], True, [s.encode() for s in counter.merges.special], most=1_200_000)


def pack_counts(counts: np.ndarray) -> bytes:
    """The counts of the prefixes of 1, 2, ... characters as differences: the width of a difference (a byte), then the differences."""
    step = np.diff(counts, prepend=0)
    most = int(np.abs(step).max(initial=0))
    width = 1 if most < 1 << 7 else 2 if most < 1 << 15 else 4
    return bytes([width]) + step.astype(f"<i{width}").tobytes()


def unpack_counts(stored: bytes) -> np.ndarray:
    """The counts of the prefixes of 0, 1, 2, ... characters."""
    step = np.frombuffer(stored, f"<i{stored[0]}", offset=1)
    return np.concatenate([[0], np.cumsum(step, dtype=np.int64)])


def longest(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix of at most `budget` tokens."""
    return int(np.flatnonzero(counts <= budget)[-1]) if budget >= 0 else 0


def prefix_table(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes (UTF-8), n_tokens, prefixes (the counts of all prefixes, packed) of every whole text; one row for each row of docs.
    Stored in the shared folder and read from there."""
    tune(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _memory(path)
        for b in batches:
            data, at = flat(b.column(1))
            counts, chars, length, chunks = memory.runs(data, at)
            ends = np.cumsum(length)
            total = counts[ends - 1].astype(np.int64) if len(ends) else np.zeros(0, np.int64)  # tokens of each chunk; none is empty
            text_ends = np.concatenate([[0], np.cumsum(chunks)])
            done = np.concatenate([[0], np.cumsum(total)])
            n = done[text_ends[1:]] - done[text_ends[:-1]]
            before = done[:-1] - np.repeat(done[text_ends[:-1]], chunks)  # tokens of the text's chunks before each
            whole = counts + np.repeat(before, length)
            step = np.diff(whole, prepend=0)
            first = np.concatenate([[0], np.cumsum(chars)])
            begin = first[:-1][chars > 0]
            step[begin] = whole[begin]
            if np.abs(step).max(initial=0) < 1 << 7:
                raw = step.astype(np.int8).tobytes()
                stored = [b"\x01" + raw[s:e] for s, e in zip(first.tolist(), first[1:].tolist())]
            else:
                stored = [pack_counts(whole[s:e]) for s, e in zip(first.tolist(), first[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(at)), pa.array(n), pa.array(stored, pa.binary())], names=[key, "n_bytes", "n_tokens", "prefixes"])

    return kept_table(docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_tokens long, prefixes binary"))


def truncate(table: DataFrame, budget: int, key: str = "doc_id") -> DataFrame:
    """key, n_bytes, n_tokens, over_limit (n_tokens > budget), kept_chars (of the longest prefix of at most `budget` tokens),
    kept_tokens, from a prefix_table."""
    kind = table.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            chars, tokens = [], []
            for stored in b.column(3):
                counts = unpack_counts(stored.as_buffer())
                chars.append(longest(counts, budget))
                tokens.append(int(counts[chars[-1]]))
            over = np.array(b.column(2)) > budget
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(over, pa.bool_()), pa.array(chars, pa.int64()), pa.array(tokens, pa.int64())], names=[key, "n_bytes", "n_tokens", "over_limit", "kept_chars", "kept_tokens"])

    return table.select(key, "n_bytes", "n_tokens", "prefixes").mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean, kept_chars long, kept_tokens long")


def counts_at(table: DataFrame, places: list[int], key: str = "doc_id") -> DataFrame:
    """key, place, n_tokens (of the prefix of `place` characters, or of the whole text if that is shorter) for each place, from a prefix_table."""
    kind = table.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for stored in b.column(1):
                counts = unpack_counts(stored.as_buffer())
                found += [int(counts[min(max(0, p), len(counts) - 1)]) for p in places]
            which = pa.array(np.repeat(np.arange(b.num_rows), len(places)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(which), pa.array(places * b.num_rows, pa.int64()), pa.array(found, pa.int64())], names=[key, "place", "n_tokens"])

    return table.select(key, "prefixes").mapInArrow(run, f"`{key}` {kind}, place long, n_tokens long")
