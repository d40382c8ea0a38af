"""Document fingerprints of closed syncmers, in DataFrame functions only.

A text's units are its words (runs other than white space, of at most 16 characters); characters of scripts without spaces and of
longer runs are units of their own, so a unit never depends on where its run began. Units are hashed. Of each K units in a row, the
K-S+1 inner runs of S units are hashed too; the K units are chosen if the smallest of those stands at either edge. The choice depends on the K units alone,
so equal passages have the same anchors wherever they stand. The text is framed by K-S fixed marks on both sides, which makes sure
that every text with a unit has an anchor: of K-S neighbouring runs at least one is chosen.

A fingerprint holds all anchors with their places, in the order of the text: about two for five units. Two
fingerprints are matched by place: anchors, and the steps from each anchor to the next (both hashes and the distance of their places).

Null and empty texts, and texts of white space, have the empty fingerprint; it is like itself (1) and unlike others (0). Rows with repeated
or null keys are rows of their own. Only key and text are read, so other columns' names don't matter. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import whole_key

#: Units of a run, units of an inner run.
K, S = 6, 2
FRAME = K - S
#: Characters of the longest word; those of longer runs stand alone.
LONGEST = 16
_ALONE = r"⺀-鿿가-힯฀-๿"
_IN = rf"[^\s{_ALONE}]"
UNIT = rf"(?<!{_IN}){_IN}{{1,{LONGEST}}}(?!{_IN})|\S"
#: The marks before and after each text.
_MARKS = [-(i + 1) for i in range(2 * FRAME)]


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def anchors(text: Column) -> Column:
    """The chosen runs of a text: array of (place, hash) in the order of places. A place is that of the run's first unit (below 0 in the frame)."""
    units = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(UNIT), F.lit(0))
    marks = [F.lit(m).cast("long") for m in _MARKS]

    def chosen(h: Column, inner: Column) -> Column:
        last = K - S  # inner runs of a run, less one
        smallest = lambda i: F.least(inner[i], inner[i + last]) <= F.least(*[inner[i + j] for j in range(1, last)])
        places = F.filter(F.sequence(F.lit(0), F.size(h) - K), smallest)
        return F.transform(places, lambda i: F.struct((i - FRAME).alias("place"), F.xxhash64(*[h[i + j] for j in range(K)]).alias("hash")))

    def of(h: Column) -> Column:
        inner = F.transform(F.sequence(F.lit(0), F.size(h) - S), lambda i: F.xxhash64(*[h[i + j] for j in range(S)]))
        return _let(inner, lambda s: chosen(h, s))

    framed = lambda u: F.concat(F.array(*marks[:FRAME]), F.transform(u, lambda w: F.xxhash64(w)), F.array(*marks[FRAME:]))
    none = F.array().cast("array<struct<place:int,hash:bigint>>")
    return _let(units, lambda u: F.when(F.size(u) == 0, none).otherwise(_let(framed(u), of)))


def fingerprint(text: Column) -> Column:
    """All anchors of a text: array of (place, hash), in the order of their places."""
    return anchors(text)


def as_text(f: Column) -> Column:
    """A fingerprint as text: for each anchor its place and its hash in hexadecimal digits; empty for the empty one."""
    return F.array_join(F.transform(f, lambda a: F.concat_ws(":", a["place"], F.hex(a["hash"]))), " ")


def steps(f: Column) -> Column:
    """From each anchor to the next: a hash of both anchors' hashes and the distance of their places."""

    def step(a: Column, i: Column) -> Column:
        after = f[i + 1]
        return F.xxhash64(a["hash"], after["hash"], after["place"] - a["place"])

    return F.when(F.size(f) > 1, F.transform(F.slice(f, 1, F.size(f) - 1), step)).otherwise(F.array().cast("array<bigint>"))


def _parts(f: Column) -> Column:
    """The distinct hashes of anchors and of steps."""
    return F.array_distinct(F.concat(f["hash"], steps(f)))


def likeness(a: Column, b: Column) -> Column:
    """From 0 to 1: twice the number of anchors and steps that both fingerprints have, by the sum of their numbers (Dice). Steps agree only
    where two neighbouring anchors stand at the same distance in both."""
    both = _let(F.struct(_parts(a).alias("x"), _parts(b).alias("y")), lambda p: F.size(F.array_intersect(p["x"], p["y"])) * 2 / (F.size(p["x"]) + F.size(p["y"])))
    return F.when(a == b, F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both)


def ranges(docs: DataFrame, key: str, group: int, most: int) -> tuple[Column, Column]:
    """A number for each row that grows with the key (about `group` rows share one; at most about `most` numbers), and the key with null below all."""
    spread = docs.agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    n, lo, hi = spread["n"], spread["lo"] or 0, spread["hi"] or 0
    value = F.coalesce(F.col(key).cast("long"), F.lit(lo - 1))
    parts = min(most, max(1, n // group))
    if parts == 1 or hi - lo + 1 <= 4 * n:
        return F.floor((value - lo) / max(1, -(-(hi - lo + 1) // parts))).cast("long"), value
    # keys with gaps: sampled splitters, and steps of equal width between two of them
    coarse = min(parts, 200)
    points = sorted({lo, *docs.agg(F.percentile_approx(key, [i / coarse for i in range(1, coarse)], 10_000)).first()[0], hi + 1})
    fine = max(1, parts // coarse)
    at = F.aggregate(F.array(*map(F.lit, points[1:-1])), F.lit(0), lambda s, p: s + F.when(value >= p, 1).otherwise(0))
    low, wide = F.array(*map(F.lit, points[:-1])), F.array(*[F.lit(b - a) for a, b in zip(points, points[1:])])
    return (at * fine + F.floor((value - low[at]) * fine / wide[at])).cast("long"), value


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", group: int = 512, most: int = 1_000_000) -> DataFrame:
    """key, body (the text, null as empty), fingerprint, next_body and next_fingerprint (those of the row with the next
    larger key, null keys first; after the last row the first; equal keys in a fixed order), a row for each row of docs.

    Rows move once, into ranges of the key; each range also gets a copy of the row that follows its last one. The table of
    first keys, one for each range (three numbers each, `most` at most), is broadcast. Beyond group * most rows (512 million) ranges grow; they are
    sorted externally. Rows of one key share a range. Keys are whole numbers."""
    whole_key(docs, key)
    number, value = ranges(docs.select(key), key, group, most)
    keyed = docs.select(F.col(key), F.coalesce(text, F.lit("")).alias("body"), number.alias("range"), value.alias("value"))
    order = Window.orderBy("range")
    firsts = keyed.groupBy("range").agg(F.min("value").alias("first"))  # at most one row a range
    before = firsts.select("range", "first", F.coalesce(F.lag("range").over(order), F.max("range").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("before"))
    twice = F.array_compact(F.array(F.struct(F.col("range").alias("r"), F.lit(0).alias("copy")), F.when(F.col("value") == F.col("first"), F.struct(F.col("before").alias("r"), F.lit(1).alias("copy")))))
    placed = keyed.join(F.broadcast(before), "range").select(key, "body", "value", F.explode(twice).alias("e")).select(key, "body", "value", "e.*")
    sort = ["copy", "value", "tie"]
    ready = placed.withColumn("tie", F.xxhash64("body")).repartition("r").sortWithinPartitions("r", *sort).withColumn("fingerprint", fingerprint(F.col("body")))
    follow = Window.partitionBy("r").orderBy(*sort)
    out = ready.withColumns({"next_body": F.lead("body").over(follow), "next_fingerprint": F.lead("fingerprint").over(follow)})
    return out.where("copy = 0").select(key, "body", "fingerprint", "next_body", "next_fingerprint")
