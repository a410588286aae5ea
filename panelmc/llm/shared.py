"""What several operators share: the shared folder, and Arrow batches as flat byte arrays."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = b" \t\n\x0b\x0c\r"
#: Words are runs of bytes outside WHITE; bytes of multi-byte characters all count as word bytes.
NOT_WHITE = np.array([b not in WHITE for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir, which the driver and all executors share.

    Only where the session names none, as in local tests, a temporary folder is taken."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="panelmc-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/panelmc-{uuid.uuid4().hex}"


def opened(uri: str, mode: str):
    """A file of the shared folder, to be read or written by a task."""
    fs, path = pafs.FileSystem.from_uri(uri)
    if mode == "w":
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        return fs.open_output_stream(path, compression=None)
    return fs.open_input_file(path)


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """df written to the shared folder and read again: cuts lineage, and outlives lost executors. The shuffle files of the job that wrote it are of no more
    use and are removed at its end, else they would stay until the driver collects garbage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    was = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of one key from which on the key's row is sent to them, not they to it.
HOT_ROWS = 1 << 20


def looked_up(rows: DataFrame, key: str, table: DataFrame, value: str) -> DataFrame:
    """rows with the column `value` of table (key, n, value: one row a key, n how many of rows have it), null where it has none. Keys of more than HOT_ROWS rows, of
    which there is one for so many rows at most, are broadcast; rows that found theirs so are spread over the join of the others."""
    hot = F.broadcast(table.where(f"n > {HOT_ROWS}").select(F.col(key).alias("_hot_key"), F.col(value).alias("_hot")))
    cold = table.where(f"n <= {HOT_ROWS}").select(F.col(key).alias("_cold_key"), F.lit(0).alias("_cold_at"), F.col(value).alias("_cold"))
    rows = rows.join(hot, F.col(key) == F.col("_hot_key"), "left")
    rows = rows.withColumn("_at", F.when(F.col("_hot_key").isNull() & F.col(key).isNotNull(), F.lit(0)).otherwise(F.spark_partition_id() + 1))
    rows = rows.join(cold, (F.col(key) == F.col("_cold_key")) & (F.col("_at") == F.col("_cold_at")), "left")
    return rows.withColumn(value, F.coalesce("_hot", "_cold")).drop("_hot_key", "_hot", "_at", "_cold_key", "_cold_at", "_cold")


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one after the other, and where each begins (one offset more than texts); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def parts(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes, one text at least, so that temporary arrays stay small."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


def spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, as begin and end in data; and for each text the number of words before it (one more than texts)."""
    inside = is_word[data]
    begins, ends = inside.copy(), inside.copy()
    if len(data):
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edge = offsets[1:-1]
        edge = edge[(edge > 0) & (edge < len(data))]
        begins[edge] = inside[edge]
        ends[edge - 1] = inside[edge - 1]
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return begin, end, np.searchsorted(begin, offsets)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


BYTE_VALUE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BASE = 0x2545F4914F6CDD1D


def word_hashes(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each stretch values[begin:end] (stretches in order, not overlapping, not empty)."""
    if not len(begin):
        return np.empty(0, np.uint64)
    size = end - begin
    # polynomial in the place inside the word, so that equal words are equal wherever they stand
    powers = np.ones(int(size.max()), np.uint64)
    powers[1:] = BASE
    powers = np.multiply.accumulate(powers)
    total = int(size.sum())
    first = np.zeros(len(size), np.int64)
    np.cumsum(size[:-1], out=first[1:])
    place = np.arange(total) - np.repeat(first, size)
    picked = values[place + np.repeat(begin, size)]
    picked *= powers[place]
    return mixed(np.add.reduceat(picked, first) + size.astype(np.uint64))
