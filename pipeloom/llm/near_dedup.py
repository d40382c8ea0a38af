"""Near duplicates by HyperMinHash.

A text's words are the runs of other bytes between \\x20 and \\x09-\\x0D, A-Z lower-cased; its set is that of its five-word
shingles (with fewer words, the whole sequence as one; without words, empty and linked with nothing). Each of 288
buckets keeps the smallest hash of the set under its own permutation, compressed to the count of leading zeros and ten
bits of mantissa. Texts of equal sets are one class. Bands of six registers put classes together; a pair is tried only if
the estimate from the registers, corrected for chance collisions, comes near the threshold, and linked only if the sets of
words themselves, made again from the two whole texts, reach it. (A pair at exactly 0.75 shares no band with a probability of 8e-5; at 0.8,
5e-7. Shingles are known by 64-bit hashes until that last comparison, so classes and sizes rest on them.)

Within a band's group no list of all pairs is made: all members are tried against one, the member that shares most groups.
The members of groups that this doesn't connect are tried further by the exact rule that two sets
of 75% overlap share one of the rarest shingles of both, the first n - ceil(0.75 n) + 1 of n by how many of these sets have it,
and that enough of both sets is left from there on; so texts that merely share a passage don't meet.
To be tried, members travel to their hub; those of a heavy hub go to blocks, and the hub's sketch or text travels once for each block.
Components are found by alternating large and small stars over tables; what heavy nodes need is broadcast.

Keys are whole numbers. Rows of one id are taken as linked. A row without id gets no component and isn't kept. Only key and text are read,
so other columns' names don't matter. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import IS_SPACE, cut, flat, kept_table, tune, whole_key
from .hashing import U, hash_runs, mix

#: Words of a shingle; registers, and registers of a band; bits of a register's mantissa.
WORDS, REGISTERS, BAND, MANTISSA = 5, 288, 6, 10
#: Estimates of this much less than the threshold are still tried: near six standard errors.
MARGIN = 0.15

_random = np.random.default_rng(288)
_FLIP = _random.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)
_TIMES = _random.integers(0, 1 << 32, REGISTERS, dtype=np.uint32) | np.uint32(1)
_PLACES = _random.integers(0, 1 << 63, WORDS, dtype=np.uint64) | U(1)
_SHORT = _random.integers(0, 1 << 63, WORDS, dtype=np.uint64) | U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def shingles(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The set of each text, as sorted distinct 64-bit hashes."""
    data = _LOWER[data]
    word = ~IS_SPACE[data]
    border = np.zeros(len(data) + 1, bool)
    border[at] = True
    if not len(data):
        return [np.zeros(0, np.uint64)] * (len(at) - 1)
    start = np.flatnonzero(word & (border[:-1] | ~np.concatenate([[False], word[:-1]])))
    stop = np.flatnonzero(word & (border[1:] | ~np.concatenate([word[1:], [False]]))) + 1
    hashes = hash_runs(data, start, stop)
    ends = np.searchsorted(start, at)
    run = None
    if len(hashes) >= WORDS:
        run = np.zeros(len(hashes) - WORDS + 1, np.uint64)
        for k in range(WORDS):
            run += hashes[k : k + len(run)] * _PLACES[k]
        run = mix(run)
    out = []
    for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if e - s >= WORDS:
            x = np.sort(run[s : e - WORDS + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        else:
            out.append(mix((hashes[s:e] * _SHORT[: e - s]).sum(keepdims=True) + U(e - s)) if e > s else np.zeros(0, np.uint64))
    return out


def registers(values: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa of each bucket's smallest hash, as 16-bit numbers."""
    x = (values >> U(32)).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    room = np.empty((min(len(x), 256), REGISTERS), np.uint32)
    for i in range(0, len(x), 256):
        part = x[i : i + 256, None]
        r = room[: len(part)]
        np.bitwise_xor(part, _FLIP, out=r)
        np.multiply(r, _TIMES, out=r)
        np.bitwise_xor(r, r >> np.uint32(15), out=r)
        np.minimum(least, r.min(0), out=least)
    size = np.frexp(least.astype(np.float64))[1]  # significant bits
    rest = np.where(size > MANTISSA + 1, least >> np.maximum(size - MANTISSA - 1, 0).astype(np.uint32), least << np.maximum(MANTISSA + 1 - size, 0).astype(np.uint32))
    return (((32 - size) << MANTISSA) | (rest & ((1 << MANTISSA) - 1))).astype("<u2")


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The Jaccard similarity from registers (a row for each pair) and set sizes. Registers of unlike minima agree by chance:
    minima of n hashes are about exponential, so with the chance that two fall into one cell of relative width 2**-MANTISSA."""
    same = (a == b).mean(1)
    chance = 2.0**-MANTISSA * 2 * n_a * n_b / (n_a + n_b) ** 2
    return np.clip((same - chance) / (1 - chance), 0, 1)


#: Up to this number of ids (8 bytes each) are broadcast to pick texts; more are shuffled.
BROADCAST_IDS = 1_000_000
#: A key with more rows than this, and than 1/HEAVY_PART of all rows, is heavy; there are HEAVY_PART of them at most.
HEAVY, HEAVY_PART = 64, 10_000
#: Members of a heavy hub's block, about.
BLOCK = 64


def digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def sketches(rows: DataFrame) -> DataFrame:
    """id, n_shingles, digest (of the set), mark (its first bytes as a number), bands, of rows (id, body). Bands are empty without a set or an id, and where
    an earlier row of the task has an equal set."""
    salt = mix(np.arange(1, REGISTERS // BAND + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a number for each set of the task
        for b in batches:
            ids, digests, marks, bands = b.column(0).to_pylist(), [], [], []
            found = shingles(*flat(b.column(1)))
            for i, s in zip(ids, found, strict=True):
                digests.append(d := digest(s))
                marks.append(m := int.from_bytes(d[:8], "little", signed=True))
                if i is None or not len(s) or m in seen:
                    bands.append([])
                    continue
                seen.add(m)
                r = registers(s).reshape(-1, BAND).astype(np.uint64)
                h = salt.copy()
                for k in range(BAND):
                    h = mix(h ^ (r[:, k] + U(k + 1)) * U(0x9E3779B97F4A7C15))
                bands.append(h.view(np.int64))
            n = pa.array([len(s) for s in found], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), n, pa.array(digests, pa.binary()), pa.array(marks, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["id", "n_shingles", "digest", "mark", "bands"])

    return rows.mapInArrow(run, "id long, n_shingles long, digest binary, mark long, bands array<long>")


def with_registers(rows: DataFrame) -> DataFrame:
    """id, n_shingles, sketch (registers), body of the texts in rows (id, body)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = shingles(*flat(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in found], pa.int64()), pa.array([registers(s).tobytes() for s in found], pa.binary()), b.column(1)], names=["id", "n_shingles", "sketch", "body"])

    return rows.mapInArrow(run, "id long, n_shingles long, sketch binary, body string")


def _heavy(rows: DataFrame, key: str, *aggregates) -> tuple[DataFrame, int]:
    """A row for each key of rows (cut before): key, __n (its rows) and aggregates; and the number of rows from which on a key is heavy."""
    return rows.groupBy(key).agg(F.count("*").alias("__n"), *aggregates), max(HEAVY, rows.count() // HEAVY_PART)


def with_group(rows: DataFrame, key: str, *aggregates) -> DataFrame:
    """rows (cut before) with aggregates over their key's rows. No key's rows are gathered: aggregates are made by parts, those of
    heavy keys are broadcast (HEAVY_PART rows at most), the others joined."""
    per, most = _heavy(rows, key, *aggregates)
    heavy = F.broadcast(per.where(F.col("__n") > most).drop("__n"))
    some = rows.join(heavy, key)
    rest = rows.join(heavy.select(key), key, "left_anti").join(per.where(F.col("__n") <= most).drop("__n"), key)
    return some.unionByName(rest)


def word_shingles(body: str | None) -> set[tuple[bytes, ...]]:
    """The set of a text by its words themselves."""
    w = (body or "").encode().translate(_LOWER.tobytes()).split()  # splits at the same six bytes
    return set(zip(*(w[i:] for i in range(WORDS)))) if len(w) >= WORDS else {tuple(w)} if w else set()


def meet(pairs: DataFrame, whole: DataFrame, columns: list[str], read, fit) -> DataFrame:
    """Those pairs (h, m) that fit(read(row of h), read(row of m)). pairs: cut, distinct. whole: id and the columns that read gets.

    A hub h gets the columns of each member once, and its own once; the members of a heavy hub are dealt over blocks, each of which gets the hub's."""
    per, most = _heavy(pairs, "h")
    heavy = per.where(F.col("__n") > most).select("h", F.ceil(F.col("__n") / BLOCK).alias("parts"))
    blocks = pairs.join(F.broadcast(heavy), "h", "left").select("h", "m", F.pmod(F.xxhash64("m"), F.coalesce("parts", F.lit(1))).alias("block"))  # HEAVY_PART rows at most
    own = whole.select("id", *columns)

    def sent(rows: DataFrame, by: str, role: int) -> DataFrame:
        return own.join(rows.withColumnRenamed(by, "id"), "id").select((F.col("id") if by == "h" else F.col("h")).alias("h"), "block", F.lit(role).alias("role"), "id", *columns)

    both = sent(blocks.select("h", "block").distinct(), "h", 0).union(sent(blocks, "m", 1))
    placed = both.repartition("h", "block").sortWithinPartitions("h", "block", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hubs = None, []
        for b in batches:
            fits = []
            h, block, role = (b.column(k).to_pylist() for k in range(3))
            rest = [x.to_pylist() for x in b.columns[4:]]
            for i in range(b.num_rows):
                if (h[i], block[i]) != at:
                    at, hubs = (h[i], block[i]), []
                mine = read(*[x[i] for x in rest])
                if not role[i]:
                    hubs.append(mine)
                    fits.append(False)
                else:
                    fits.append(any(fit(x, mine) for x in hubs))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3)], names=["h", "m"]).filter(pa.array(fits, pa.bool_()))

    return placed.mapInArrow(run, "h long, m long")


def verified(pairs: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b), a < b, of those (h, m) whose sets overlap by percent or more: registers are compared first, texts only of pairs that come near.
    pairs: cut, distinct. whole: id, n_shingles, sketch, body."""

    def near(x: tuple[int, np.ndarray], y: tuple[int, np.ndarray]) -> bool:
        (n, r), (m, q) = x, y
        if 100 * min(n, m) < percent * max(n, m):
            return False
        return estimate(r[None], q[None], np.array([n], float), np.array([m], float))[0] >= percent / 100 - MARGIN

    def alike(x: set, y: set) -> bool:
        common = len(x & y)
        return common > 0 and 100 * common >= percent * (len(x) + len(y) - common)

    hopeful = cut(meet(pairs, whole, ["n_shingles", "sketch"], lambda n, s: (n, np.frombuffer(s, "<u2")), near).distinct())
    return meet(hopeful, whole, ["body"], word_shingles, alike).select(F.least("h", "m").alias("a"), F.greatest("h", "m").alias("b"))


def rare_pairs(whole: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The pairs (h, m) of members (rep, c) of unlike c that share a rare shingle; every pair with percent of overlap is among them."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                found = shingles(*flat(part.column(2)))
                n = np.array([len(x) for x in found], np.int64)
                rep, c = (np.repeat(np.array(part.column(k).to_pylist(), np.int64), n) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(c), pa.array(np.repeat(n, n)), pa.array(np.concatenate(found).view(np.int64))], names=["rep", "c", "n", "s"])

    rows = whole.select(F.col("id").alias("rep"), "body").join(members, "rep").select("rep", "c", "body").mapInArrow(spread, "rep long, c long, n long, s long")
    common = cut(rows.groupBy("s").agg(F.count("*").alias("df"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("s", "df"))
    # shingles that only one component has are the rarest; they take up places at the front and make no pairs
    met = rows.join(common, "s").select("rep", "c", "n", "s", "df")
    own = F.col("n") - F.count("*").over(Window.partitionBy("rep"))
    place = F.row_number().over(Window.partitionBy("rep").orderBy("df", "s"))
    front = cut(met.withColumn("place", own + place).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).select("rep", "c", "n", "s", (F.col("n") - F.col("place") + 1).alias("rest")))
    other = front.select(F.col("rep").alias("x"), F.col("c").alias("c_x"), F.col("n").alias("n_x"), "s", F.col("rest").alias("rest_x"))
    # from the first common shingle on, no more than the rest of either can be common
    enough = (100 + percent) * F.least("rest", "rest_x") >= percent * (F.col("n") + F.col("n_x"))
    fit = (F.col("rep") < F.col("x")) & (F.col("c") != F.col("c_x")) & (100 * F.least("n", "n_x") >= percent * F.greatest("n", "n_x")) & enough
    return front.withColumnRenamed("s", "s_f").join(other, (F.col("s_f") == F.col("s")) & fit).select(F.col("rep").alias("h"), F.col("x").alias("m"))


def components(links: DataFrame) -> DataFrame:
    """id, root (the smallest id that can be reached) of each id in links (a, b). Alternates large and small stars until the
    edges stay the same; only minima are gathered for a node, never its neighbours."""
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state["n"] == 0 or (state["n"], state["s"]) == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        before = (state["n"], state["s"])
        least = with_group(_both(edges, "u", "v"), "u", F.min("v").alias("m"))
        large = cut(least.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct())
        low = with_group(large, "u", F.min("v").alias("m"))
        small = low.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v")
        edges = cut(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())


def _both(links: DataFrame, a: str, b: str) -> DataFrame:
    return links.select(F.col(a).alias("u"), F.col(b).alias("v")).union(links.select(F.col(b).alias("u"), F.col(a).alias("v")))


def near_labels(links: DataFrame) -> DataFrame:
    """id, label of each id in links (a, b; cut before): the smallest id within two steps. All of a star have one label; equal labels mean connected."""
    one = with_group(_both(links, "a", "b"), "v", F.min("u").alias("m"))
    return one.groupBy(F.col("u").alias("id")).agg(F.least(F.min("u"), F.min("v"), F.min("m")).alias("label"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """key, n_shingles, component_id (the smallest key reachable over links), kept (key = component_id); a row for each row."""
    tune(docs.sparkSession)
    rows = docs.select(whole_key(docs, key).alias("id"), F.col(text).alias("body"))
    sketched = kept_table(sketches(rows))
    classes = cut(sketched.where("n_shingles > 0 and id is not null").groupBy("digest", "mark").agg(F.min("id").alias("rep")))
    hashed = sketched.where(F.size("bands") > 0).select(F.explode("bands").alias("band"), "mark")
    shared = cut(hashed.groupBy("band").agg(F.min("mark").alias("lo"), F.max("mark").alias("hi")).where("lo <> hi").select("band"))
    members = cut(hashed.join(shared, "band").distinct().join(classes, "mark").select("band", "rep"))
    busy = cut(members.groupBy("rep").agg(F.count("*").alias("weight")))
    ids = busy.select(F.col("rep").alias("id"))
    if busy.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    whole = kept_table(with_registers(rows.join(ids, "id").select("id", "body")))
    placed = cut(members.join(busy, "rep").select("band", "rep", "weight"))
    hub = with_group(placed, "band", F.max(F.struct("weight", (-F.col("rep")).alias("x"))).alias("t")).withColumn("h", -F.col("t.x"))
    tried = cut(hub.where("rep <> h").select("h", F.col("rep").alias("m")).distinct())
    links = cut(verified(tried, whole, percent))

    # groups that aren't connected yet: their members may be linked to others than their hub
    label = near_labels(links).withColumnRenamed("id", "rep")
    known = cut(placed.select("band", "rep").join(label, "rep", "left").select("band", "rep", F.coalesce("label", "rep").alias("c")))
    loose = cut(with_group(known, "band", F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("rep", "c").distinct())
    new = rare_pairs(whole, loose, percent).distinct().join(tried.union(tried.select("m", "h")), ["h", "m"], "left_anti")
    more = cut(verified(cut(new), whole, percent))
    root = components(links.union(more)).withColumnRenamed("id", "rep")
    same = classes.select("digest", "rep").join(root, "rep", "left").select("digest", F.coalesce("root", "rep").alias("root"))
    out = sketched.select("id", "n_shingles", "digest").join(same, "digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("id").isNotNull(), F.col("root"))).otherwise(F.col("id"))
    return out.select(F.col("id").alias(key), "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))
