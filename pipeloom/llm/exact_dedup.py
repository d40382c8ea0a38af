"""Exact duplicates by a content sort.

Texts are equal when they agree after every byte of \\x20 and \\x09-\\x0D is deleted. Rows are range-partitioned by sampled
splitters over (first bytes of the normalised text, its SHA-256, longest original first, smallest id first, place in the input) and sorted
externally within partitions, so equal texts stand side by side; since the splitters go on beyond the text, a group that
holds a third of all rows is dealt over many partitions, even if its ids are equal too. Each row's whole normalised text is compared with
its neighbour's. The first row of a run of equal texts is the one that stays, so rows go on at once and none is held; the size of a run that
goes beyond a batch follows in a row of its own. Groups that go across partitions are put together from the first and last run of each
partition, whose whole texts are compared: two texts a partition.

Null and empty texts, and texts of white space, form one group of equal texts. Of rows with the same id and equal texts one stays.
An id of null comes after all others; ids are whole numbers. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, fresh, kept_table, tune, whole_key

HEAD = 24  # bytes of the normalised text in the splitters; whole texts may be too long to be sampled
#: Up to this number of runs (of some 100 bytes each) are broadcast; more are shuffled.
BROADCAST_RUNS = 250_000
#: The columns that exact_groups adds.
NEW = ("keep_id", "group_size", "kept", "text_sha256")


def normalised(text: str | None) -> bytes:
    return (text or "").encode().translate(None, SPACES)


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """One row for each row of docs: key, keep_id (the key of the row that stays), group_size, kept, text_sha256
    (of the normalised text); with carry all columns of docs instead of key, and those four after them (with underscores
    after a name that docs has). The longest original text stays, then the smallest key."""
    tune(docs.sparkSession)
    own = docs.columns if carry else [key]
    names = [fresh(n, own) for n in NEW]
    whole = docs.select(F.struct(*own).alias("own"), whole_key(docs, key).alias("id"), *([] if carry else [F.col(text).alias("body")]))
    kind = whole.schema["own"].dataType.simpleString()

    def bodies_of(b: pa.RecordBatch) -> list:
        return (b.column("own").field(text) if carry else b.column("body")).to_pylist()

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bodies = bodies_of(b)
            plain = [normalised(t) for t in bodies]
            chars, head, sha = pa.array([len(t or "") for t in bodies], pa.int64()), pa.array([p[:HEAD] for p in plain], pa.binary()), pa.array([hashlib.sha256(p).digest() for p in plain], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, chars, head, sha], names=[*b.schema.names, "chars", "head", "digest"])

    body = "" if carry else "body string, "
    keyed = whole.mapInArrow(prepare, f"own {kind}, id long, {body}chars long, head binary, digest binary").withColumn("row", F.monotonically_increasing_id())
    order = [F.col("head").asc(), F.col("digest").asc(), F.col("chars").desc(), F.col("id").asc_nulls_last(), F.col("row").asc()]
    placed = keyed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.spark_partition_id().cast("long"))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with the run that they are in, and its size where the run is neither the partition's first or last nor goes beyond its batch.
        Such runs get a row of their own (without own): run, size, and their text if they are the first or last."""
        previous: bytes | None = None
        number, size = -1, 0
        best: tuple = ()  # id, characters and digest of the run's first row, and the run

        def rows(part: pa.RecordBatch, first: bool, known: int | None) -> pa.RecordBatch:
            m = part.num_rows
            return pa.RecordBatch.from_arrays(
                [part.column("own"), pa.array([best[3]] * m, pa.int64()), pa.array([first] + [False] * (m - 1)), pa.array([known] * m, pa.int64()), pa.array([best[0]] * m, pa.int64()), pa.array([best[1]] * m, pa.int64()), pa.array([best[2].hex()] * m), pa.nulls(m, pa.binary()), pa.array([False] * m)],
                names=["own", "run", "first", "size", "best", "chars", "text_sha256", "body", "of_run"],
            )

        def of_run(like: pa.DataType, edge: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.nulls(1, like), pa.array([best[3]], pa.int64()), pa.array([False]), pa.array([size], pa.int64()), pa.array([best[0]], pa.int64()), pa.array([best[1]], pa.int64()), pa.array([best[2].hex()]), pa.array([previous if edge else None], pa.binary()), pa.array([True])],
                names=["own", "run", "first", "size", "best", "chars", "text_sha256", "body", "of_run"],
            )

        for b in batches:
            like = b.column("own").type
            start, begun = 0, False  # where in the batch the run's rows begin, and whether the run itself does
            for i, t in enumerate(bodies_of(b)):
                mine = normalised(t)
                if mine != previous:
                    if i > start:
                        inside = begun and number > 0
                        size += i - start
                        yield rows(b.slice(start, i - start), begun, size if inside else None)
                        if not inside:
                            yield of_run(like, number == 0)
                    elif number >= 0:
                        yield of_run(like, number == 0)
                    number += 1
                    size, start, begun, previous = 0, i, True, mine
                    best = (b.column("id")[i].as_py(), b.column("chars")[i].as_py(), b.column("digest")[i].as_py(), (b.column("place")[i].as_py() << 36) + number)
            if b.num_rows > start:
                yield rows(b.slice(start), begun, None)
                size += b.num_rows - start
        if number >= 0:
            yield of_run(like, True)

    kept = [] if carry else ["body"]
    found = kept_table(placed.select("own", "id", *kept, "chars", "digest", "place").mapInArrow(runs, f"own {kind}, run long, first boolean, size long, best long, chars long, text_sha256 string, body binary, of_run boolean"))
    open_runs = found.where("of_run").select("run", "size", "best", "chars", "text_sha256", "body")
    # the first and last run of each partition, with their texts: at most twice as many as partitions
    edges = (
        open_runs.where("body is not null").groupBy("text_sha256", "body")
        .agg(F.sum("size").alias("all_size"), F.min(F.struct(-F.col("chars"), F.col("best").isNull(), F.col("best").alias("all_best"), F.col("run").alias("all_run"))).alias("top"))
        .select("text_sha256", "body", "all_size", "top.all_best", "top.all_run")
    )
    resolved = open_runs.join(edges, ["text_sha256", "body"], "left").select(
        F.col("run").alias("of"), F.coalesce("all_size", "size").alias("total"), F.when(F.col("all_run").isNotNull(), F.col("all_best")).otherwise(F.col("best")).alias("keep"), F.coalesce("all_run", "run").alias("front")
    )
    few = F.broadcast(resolved) if open_runs.count() <= BROADCAST_RUNS else resolved
    rows_ = found.where("not of_run")
    done = rows_.where("size is not null").select("own", F.col("best").alias("keep"), "size", F.col("first").alias("kept"), "text_sha256")
    late = rows_.where("size is null").join(few, F.col("run") == F.col("of")).select("own", "keep", F.col("total").alias("size"), (F.col("first") & (F.col("run") == F.col("front"))).alias("kept"), "text_sha256")
    return done.union(late).select("own.*", *[F.col(c).alias(n) for c, n in zip(("keep", "size", "kept", "text_sha256"), names)])
