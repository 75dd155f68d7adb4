"""Shared helpers of the training-data operators: the shared folder, cut points and Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Lower-cases A-Z and leaves all other bytes.
_IDENTITY = bytes(range(256))
ASCII_LOWER = _IDENTITY.lower()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one the cluster names in ``spark.checkpoint.dir``; only where that is unset (tests,
    a laptop) a folder of our own becomes the checkpoint folder.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if not current:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: what is above is never computed again,
    and a lost executor costs a re-read only."""
    path = f"{shared_dir(df.sparkSession)}/tessera/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Remove a table written by :func:`cut` that no later step reads."""
    spark = df.sparkSession
    jvm = spark._jvm
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def map_batches(df: DataFrame, schema: T.StructType, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> DataFrame:
    """``mapInArrow`` of a function on one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def text_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def text_strings(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def slices(column: pa.Array, size: int = 32 << 20) -> Iterator[pa.Array]:
    """The texts of a column, nulls as empty ones, in runs of about ``size`` bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(column):
        done = int(ends[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + size, side="right")))
        yield pc.fill_null(column.slice(begin, end - begin), "")
        begin = end


def pieces(batches: Iterator[pa.RecordBatch], column: int, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in runs of about ``size`` bytes of one column, so that no more of them is held as Python objects."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < batch.num_rows:
            done = int(ends[begin - 1]) if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, done + size, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """Rows reach Python in Arrow batches of at most about ``size`` from now on, whatever the length of a text."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def distinct_words(lists: pa.ListArray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The different words of texts that are split into lists, the place among them of each word, and the first word of each text."""
    words = lists.flatten().dictionary_encode()
    bounds = lists.offsets.to_numpy().astype(np.int64)
    return words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy().astype(np.int64), bounds - bounds[0]


def held_out_bucket(doc_id: str, modulus: int):
    """crc32 of the decimal doc_id, modulo ``modulus``; a null id is the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(modulus)).cast("int")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
