"""What the operators share: session settings, durable cuts of lineage, flat views of Arrow text."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes that separate words: \x20 and \x09-\x0D.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True


def tune(spark: SparkSession) -> None:
    """Bounds the Arrow batches, so that very long texts don't pile up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    except Exception as e:  # the setting is absent in older releases
        if "maxBytesPerBatch" not in str(e):
            raise


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset, a temporary one, but only where driver and executors are one
    process (tests); elsewhere that is an error, since executors don't see each other's folders."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        base = sc._jsc.sc().getCheckpointDir()
        base = base.get() if base.isDefined() else None
    if not base:
        if not sc._jsc.sc().isLocal():
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="checkpoints-")
        atexit.register(shutil.rmtree, base, True)
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared checkpoint folder and read from there from now on."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        folder = shared_dir(spark)
        if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
            spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def kept_table(df: DataFrame) -> DataFrame:
    """The rows of df, written as a compressed table to the shared folder and read from there; for wide rows."""
    folder = shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def width(df: DataFrame) -> int:
    """Shuffle partitions of the session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(column: str, n: int):
    """crc32 of the column as text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts of an Arrow column, and where each begins (one more for the end); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]] if len(at) else whole, at - at[0] if len(at) else np.zeros(1, np.int64)


def whole_key(docs: DataFrame, key: str):
    """The key as long. Keys are whole numbers; others are an error before anything runs."""
    kind = docs.schema[key].dataType
    if not isinstance(kind, (T.IntegralType, T.NullType)):
        raise TypeError(f"{key} is {kind.simpleString()}; a whole number is needed")
    return F.col(key).cast("long")


def fresh(name: str, taken) -> str:
    """The name, with underscores after it while it is taken."""
    while name in taken:
        name += "_"
    return name


#: A letter, of any script.
LETTER = regex.compile(r"\p{L}")
