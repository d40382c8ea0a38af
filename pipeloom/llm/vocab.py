"""Vocabularies of public tokenizers: cached encoding of whole texts, and the merge tables behind them."""

from __future__ import annotations

import base64
import json
import re
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import regex

from .common import IS_SPACE
from .hashing import HashTable, hash_runs, mix

#: The pattern that splits text before byte-level merges (fixed values of the public vocabulary).
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: The same for Python, whose \s takes U+001C to U+001F in while the vocabulary's doesn't.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WHITE = regex.compile(f"[{_WHITE}]+")
SPLIT = regex.compile(PATTERN.pattern.replace(r"[^\s", f"[^{_WHITE}").replace(r"\S", f"[^{_WHITE}]").replace(r"\s", f"[{_WHITE}]"))


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def library(path: str):
    """The tokenizer of the file as the library has it, without truncation or padding."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


#: Kinds of ASCII bytes: letters, white space, other printable characters but the apostrophe and digits; 0 for all else.
_LETTER, _WHITE_BYTE, _MARK, _OTHER = 1, 2, 3, 4
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = _MARK
_KIND[0x30:0x3A] = _KIND[0x27] = _OTHER
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _LETTER
_KIND[IS_SPACE] = _WHITE_BYTE


def chunks(data: np.ndarray, at: np.ndarray, spaced: bool, marks: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cuts texts (bytes, with the beginning of each) where their encoding can be cut: start and stop of each chunk, and
    how many chunks each text has. Both sides of a cut are ASCII.

    spaced: cuts before white space that follows another character, after a single white space other than \\x20 between two
    such characters, and (marks) between letters and marks. No piece of the byte-level pattern spans such a place, and what its look-ahead sees
    there is the same at a text's end. Else: cuts at white space, and drops it, and (marks) between letters and marks. Marks must be
    off where special strings occur.
    """
    n = len(data)
    border = np.zeros(n + 1, bool)
    border[at] = True
    if n > 1:
        kind = _KIND[data]
        left, right = kind[:-1], kind[1:]
        if marks:
            border[1:n] |= (left == _LETTER) & (right == _MARK) | (left == _MARK) & (right == _LETTER)
        if spaced:
            seen = (left != 0) & (left != _WHITE_BYTE)
            border[1:n] |= seen & (right == _WHITE_BYTE)
            if n > 2:
                alone = seen[:-1] & (left[1:] == _WHITE_BYTE) & (data[1:-1] != 0x20) & (right[1:] != 0) & (right[1:] != _WHITE_BYTE)
                border[2:n] |= alone
    if spaced:
        start = np.flatnonzero(border[:-1])
        stop = np.append(start[1:], n)
    else:
        keep = np.append(~IS_SPACE[data], False)
        start = np.flatnonzero(keep[:-1] & (border[:-1] | ~np.concatenate([[False], keep[: n - 1]])))
        stop = np.flatnonzero(keep[:-1] & (border[1:] | ~keep[1:])) + 1
    return start, stop, np.diff(np.searchsorted(start, at))


class ChunkMemory:
    """Remembers a run of numbers for each distinct chunk of text: `learn` gets the new chunks' bytes and returns their runs.

    Chunks are known by 64-bit hashes. The memory is bounded: once it holds `most` chunks, those that weren't met again since the last time are
    dropped; chunks of over 256 bytes stay out and are learnt each time. specials: strings that chunks must not cut.
    """

    def __init__(self, learn, spaced: bool, specials: list[bytes], most: int = 500_000):
        self.learn, self.spaced, self.specials, self.most = learn, spaced, specials, most
        self._empty()

    def _empty(self) -> None:
        self.table = HashTable()
        self.flat, self.starts, self.n = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), 0
        self.keys, self.again = np.zeros(1 << 14, np.uint64), np.zeros(1 << 14, bool)

    def _drop(self) -> None:
        """Forgets the chunks that weren't met again; all, if that frees too little."""
        keep = np.flatnonzero(self.again[: self.n])
        keys, start, stop = self.keys[keep], self.starts[keep], self.starts[keep + 1]
        flat = take_runs(self.flat, start, stop)
        self._empty()
        if len(keep) > self.most * 3 // 4 or not len(keep):
            return
        self.flat, self.n = flat, len(keep)
        self.starts = np.concatenate([[0], np.cumsum(stop - start)])
        self.keys, self.again = keys, np.zeros(len(keep), bool)
        self.table.add(keys)

    def _store(self, runs: list, keys: np.ndarray) -> None:
        m = np.fromiter(map(len, runs), np.int64, len(runs))
        ends = self.starts[self.n] + np.cumsum(m)
        if self.n + len(m) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros(max(len(m) + 1, len(self.starts)), np.int64)])
        if ends[-1] > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(int(ends[-1]), len(self.flat)), np.uint32)])
        self.flat[self.starts[self.n] : ends[-1]] = np.fromiter(chain.from_iterable(runs), np.uint32, int(m.sum()))
        self.starts[self.n + 1 : self.n + 1 + len(m)] = ends
        if self.n + len(m) > len(self.keys):
            room = max(len(m), len(self.keys))
            self.keys, self.again = np.concatenate([self.keys, np.zeros(room, np.uint64)]), np.concatenate([self.again, np.zeros(room, bool)])
        self.keys[self.n : self.n + len(m)] = keys
        self.again[self.n : self.n + len(m)] = False
        self.n += len(m)

    def _found(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All runs that are known; where in them each chunk's begins and ends; how many chunks each text has; the chunks' hashes."""
        if self.table.n > self.most:
            self._drop()
        whole = data.tobytes()
        start, stop, each = chunks(data, at, self.spaced, not any(s in whole for s in self.specials))
        keys = hash_runs(data, start, stop)
        where = self.table.find(keys)
        self.again[where[where >= 0]] = True
        new = np.flatnonzero((where < 0) & (stop - start <= 256))
        if len(new):
            _, first = np.unique(keys[new], return_index=True)
            pick = new[first]
            self._store(self.learn([whole[s:e] for s, e in zip(start[pick].tolist(), stop[pick].tolist(), strict=True)]), keys[pick])
            self.table.add(keys[pick])
            where[new] = self.table.find(keys[new])
        long = np.flatnonzero(where < 0)
        flat, starts = self.flat, self.starts
        if len(long):
            found = self.learn([whole[s:e] for s, e in zip(start[long].tolist(), stop[long].tolist(), strict=True)])
            more = [np.asarray(x, np.uint32) for x in found]
            flat = np.concatenate([flat[: starts[self.n]], *more])
            starts = np.concatenate([starts[: self.n + 1], starts[self.n] + np.cumsum([len(x) for x in more])])
            where[long] = self.n + np.arange(len(long))
        return flat, starts[where], starts[where + 1], each, keys

    def runs(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For texts (bytes, with the beginning of each): all runs end to end, how long each text's are together, the
        length of each chunk's run, and how many chunks each text has."""
        flat, start, stop, each, _ = self._found(data, at)
        return take_runs(flat, start, stop), _by_text(stop - start, each), stop - start, each

    def sizes(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How long the runs of each text are together, without putting them together, and a 64-bit sum of each text's content."""
        _, start, stop, each, keys = self._found(data, at)
        return _by_text(stop - start, each), _content(keys, each)

    def runs_and_sums(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All runs end to end; what sizes() gives."""
        flat, start, stop, each, keys = self._found(data, at)
        return take_runs(flat, start, stop), _by_text(stop - start, each), _content(keys, each)


def _content(keys: np.ndarray, each: np.ndarray) -> np.ndarray:
    """A number for each text that its chunks and their order decide."""
    place = np.arange(len(keys)) - np.repeat(np.cumsum(each) - each, each)
    return _by_text(mix(keys + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), each)


def _by_text(x: np.ndarray, each: np.ndarray) -> np.ndarray:
    """The sums of each[0], each[1], ... numbers of x."""
    ends = np.concatenate([[0], np.cumsum(each)])
    total = np.concatenate([np.zeros(1, x.dtype), np.cumsum(x, dtype=x.dtype)])
    return total[ends[1:]] - total[ends[:-1]]


def byte_level(path: str, ranks: str | None = None) -> ChunkMemory:
    """Ids of a byte-level vocabulary. ranks: the same vocabulary as a file of ranks, for speed."""
    specials = [s.encode() for s in merges_special(path)]
    if ranks:
        merge, table, pieces = _ranked(ranks)

    def plain(p: bytes) -> list[int]:
        if p.isalpha() or p[:1] == b" " and p[1:].isalpha():  # one piece of the pattern
            known = table.get(p)
            return merge(p) if known is None else [known]
        return pieces(p.decode())

    def learn(parts: list[bytes]) -> list[list[int]]:
        if not ranks:
            return [e.ids for e in library(path).encode_batch([p.decode() for p in parts], add_special_tokens=False)]
        if not any(s in b"\0".join(parts) for s in specials):
            return list(map(plain, parts))
        return [library(path).encode(p.decode(), add_special_tokens=False).ids if any(s in p for s in specials) else plain(p) for p in parts]

    return ChunkMemory(learn, True, specials)


def _ranked(path: str):
    """The merges of one piece, the ids of whole pieces, and the encoding of any text."""
    import tiktoken

    with open(path, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    made = tiktoken.Encoding(path, pat_str=PATTERN.pattern, mergeable_ranks=table, special_tokens={})
    return made._core_bpe.encode_single_piece, table, made.encode_ordinary


def merges_special(path: str) -> dict[str, int]:
    with open(path, encoding="utf-8") as f:
        return {a["content"]: a["id"] for a in json.load(f)["added_tokens"]}


#: Words of the vocabulary with word ends: a contraction, letters, one digit, or other characters (fixed values).
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Characters for which lower() and the library's lower-casing agree without doubt.
PLAIN = re.compile(r"[\x20-\u017f]*\Z")


def word_level(path: str) -> ChunkMemory:
    """Ids of a vocabulary with word ends; white space only separates.

    The merges run in a faster library over the bytes of a word and a byte that never occurs in UTF-8, which stands for the
    word's end; chunks with unusual characters or special strings are left to the tokenizers library."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = _letters()
    vocab, end = spec["model"]["vocab"], "</w>"

    def as_bytes(word: str) -> bytes:
        return bytes(letters[c] for c in word.removesuffix(end)) + (b"\xff" if word.endswith(end) and len(word) > len(end) else b"")

    own = {bytes([b]): b for b in range(256)}  # ranks, and below the vocabulary's id of each rank
    ids = [-1] * 256
    for c, b in letters.items():
        ids[b] = vocab.get(c, -1)
        if b != 0xFF and c + end in vocab:
            own[bytes([b, 0xFF])] = len(ids)
            ids.append(vocab[c + end])
    for a, b in (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]):
        word = a + b
        if as_bytes(word) not in own:
            own[as_bytes(word)] = len(ids)
            ids.append(vocab[word])
    merge = tiktoken.Encoding(path, pat_str=".", mergeable_ranks=own, special_tokens={})._core_bpe.encode_single_piece

    def word_ids(word: bytes) -> list[int]:
        return [ids[r] for r in merge(word + b"\xff")]

    def learn(parts: list[bytes]) -> list[list[int]]:
        out = []
        for p in parts:
            if p.isalpha():  # one word
                out.append(word_ids(p.lower()))
                continue
            text = p.decode()
            if PLAIN.match(text) and "<|" not in text:
                out.append([i for w in WORDS.findall(text.lower()) for i in word_ids(w.encode())])
            else:
                out.append(library(path).encode(text, add_special_tokens=False).ids)
        return out

    return ChunkMemory(learn, False, [s.encode() for s in merges_special(path)])


def take_runs(flat: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """flat[start[0]:stop[0]], flat[start[1]:stop[1]], ... end to end."""
    n = stop - start
    ends = np.cumsum(n)
    if not len(ends) or not ends[-1]:
        return flat[:0]
    return flat[np.arange(ends[-1]) + np.repeat(start - ends + n, n)]


class Merges:
    """The merge table of a byte-level vocabulary file, over ids: bytes of each id, and what each pair merges to."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _letters()
        vocab = spec["model"]["vocab"]
        self.bytes_of: dict[int, bytes] = {i: bytes(letters[c] for c in word) for word, i in vocab.items()}
        self.id_of: dict[bytes, int] = {b: i for i, b in self.bytes_of.items()}
        self.special: dict[str, int] = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.single = [self.id_of[bytes([b])] for b in range(256)]
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}
        self.born: dict[int, int] = dict.fromkeys(self.single, -1)
        self.halves: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = (vocab[x] for x in (pair if isinstance(pair, list) else pair.split(" ")))
            c = self.id_of[self.bytes_of[a] + self.bytes_of[b]]
            self.merged.setdefault((a, b), (rank, c))
            if c not in self.born:
                self.born[c], self.halves[c] = rank, (a, b)
        self.longest = max(map(len, self.id_of))
        self.splitter = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def plain(self, data: bytes) -> list[int]:
        """Merges the lowest-ranked pair, leftmost first, until none is left."""
        if len(data) > 256:
            return self._queued(data)
        ids, rank, none = [self.single[b] for b in data], self.merged.get, (1 << 60, -1)
        pairs = [rank(p, none) for p in zip(ids, ids[1:])]
        while pairs:
            best = min(pairs)
            if best is none or best[0] == none[0]:
                break
            i = pairs.index(best)
            ids[i : i + 2] = [best[1]]
            del pairs[i]
            if i:
                pairs[i - 1] = rank((ids[i - 1], ids[i]), none)
            if i < len(pairs):
                pairs[i] = rank((ids[i], ids[i + 1]), none)
        return ids

    def _queued(self, data: bytes) -> list[int]:
        """The same in n log n steps: a queue of (rank, place, left id, right id) over a linked list of tokens."""
        ids, merged = [self.single[b] for b in data], self.merged
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        queue = [(merged[p][0], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in merged]
        heapify(queue)
        while queue:
            _, i, a, b = heappop(queue)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue  # one of the two has been merged since
            ids[i], ids[j], after[i] = merged[a, b][1], -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else -1
                if right >= 0 and (ids[left], ids[right]) in merged:
                    heappush(queue, (merged[ids[left], ids[right]][0], left, ids[left], ids[right]))
        return [i for i in ids if i >= 0]

    def segments(self, text: str) -> list[tuple[str, int | None]]:
        """Text between special strings, and the special strings with their ids."""
        if not self.splitter or not any(s in text for s in self.special):
            return [(text, None)]
        return [(part, self.special.get(part)) for part in self.splitter.split(text) if part]


def _letters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabulary files: printable bytes for
    themselves, the others in ascending order from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return {chr(b if b in shown else next(rest)): b for b in range(256)}


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)
