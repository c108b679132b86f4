"""Small helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_AT_ONCE = 500
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(name: str = "text") -> Column:
    """The text, where null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only, whatever the locale."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def in_parts(batches: Iterator[pa.RecordBatch], most: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most so many rows: whole texts as Python strings and their words take a multiple of an Arrow batch."""
    for batch in batches:
        for start in range(0, batch.num_rows, most):
            yield batch.slice(start, most)


def give_back() -> None:
    """Gives the system what this process has freed: Arrow's pool and malloc keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow(run, schema), whose tasks give back memory at their end: Python workers wait for further tasks beside an executor's heap."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(task, schema)


def map_texts(df: DataFrame, make: Callable[[], Callable[[list[str]], list[pa.Array]]], schema: str, text: str = "text", after: Callable[[], None] | None = None) -> DataFrame:
    """Runs a function over batches of texts and puts its columns after those of df (null: empty text).

    make is called once a task and returns the function, so that models and caches
    live as long as the task; after, if given, is called when the task's rows are done,
    to empty what is kept beyond it (Python workers serve many tasks). At most ROWS_AT_ONCE
    texts are Python strings at a time. schema names the new columns. Columns of df with
    the same names are replaced.
    """
    new = df.sparkSession.createDataFrame([], schema).schema
    kept = [c for c in df.columns if c not in new.names]
    out = df.select(*[F.col(f"`{c}`") for c in kept]).schema
    for field in new:
        out = out.add(field)
    sent = kept if text in kept else [*kept, text]
    source = df.select(*[F.col(f"`{c}`") for c in sent])
    at, n, names = sent.index(text), len(kept), out.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        try:
            for batch in in_parts(batches):
                made = work([t or "" for t in batch.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], *made], names=names)
        finally:
            if after is not None:
                after()

    return map_arrow(source, run, out)


class Memo(dict):
    """A dict that computes what is missing and holds at most `most` values, so its memory is bounded.

    It fills one half while the other keeps what was met before; a full half takes the other's place, so frequent keys stay.
    """

    def __init__(self, compute: Callable, most: int = 400_000):
        super().__init__()
        self.compute, self.most, self.before = compute, most, {}

    def __missing__(self, key):
        if len(self) >= max(1, self.most // 2):
            self.before = None  # gone before the copy is made
            self.before = self.copy()
            self.clear()
        value = self.before[key] if key in self.before else self.compute(key)
        self[key] = value
        return value

    def forget(self) -> None:
        self.clear()
        self.before = {}


def list_array(values: np.ndarray, counts: list[int], kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors see; unset, a local folder serves a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


COMPACT_BYTES = 4 << 20


def cut(df: DataFrame, instead_of: DataFrame | None = None, compact: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts the lineage, and survives the loss of an executor.

    instead_of: an earlier result of this function that nothing else reads; its folder is removed once df is written.
    compact: for tables of ids and numbers, which may be small in many files: read in parts of about COMPACT_BYTES
    at least, so that a small one is one part and needs no shuffle.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    if instead_of is not None:
        remove(instead_of)
    out = spark.read.schema(df.schema).parquet(path)
    if compact:
        out = out.coalesce(1 + written_bytes(spark, path) // COMPACT_BYTES)
    out._written_to = path
    return out


def written_bytes(spark: SparkSession, path: str) -> int:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()


def remove(df: DataFrame) -> None:
    """Removes the folder of a result of cut, if it is one."""
    path = df.__dict__.get("_written_to")
    if path:
        hadoop = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(hadoop, True)


FEW_ROWS = 10_000


def beside(df: DataFrame, rows: int) -> DataFrame:
    """df, of at most so many rows, as a join's side: sent to all tasks by way of the driver where they are few, else both sides are dealt out and merged.

    Spark itself goes by the bytes of compressed files, and takes what mapInArrow or an
    explode makes for as many rows as it was given: tables of any size may go to the driver.
    """
    return df.hint("broadcast" if rows <= FEW_ROWS else "merge")


def row_keys(doc_id: Column, text: Column) -> list[Column]:
    """Two 64-bit hashes that tell rows apart by id and text together; a null differs from any value.

    Rows of one id with different texts have different keys; rows alike in both have the same.
    """
    null = F.when(text.isNull(), 0).otherwise(1)
    return [F.xxhash64(doc_id, null, text), F.xxhash64(text, null, F.lit(1), doc_id)]


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


BITS_LEAST, BITS_MOST = 1 << 16, 1 << 27


def bitmap(hashes: DataFrame, least: int = BITS_LEAST, most: int = BITS_MOST) -> np.ndarray:
    """A bit for each hash, by its lowest bits: about 32 a row, within the bounds. Its words are put together by Spark, and come to the driver thousands a row."""
    n = hashes.count()
    size = min(most, max(least, 1 << (32 * n).bit_length()))
    place = F.col("hash").bitwiseAND(F.lit(size - 1))
    words = hashes.select(F.shiftright(place, 6).alias("word"), F.expr("shiftleft(1L, cast(hash & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([column.to_numpy(zero_copy_only=False).astype("<i8").tobytes()]) for column in batch.columns], names=["words", "bits"])

    out = np.zeros(size // 64, np.uint64)
    for r in map_arrow(words, packed, "words binary, bits binary").collect():  # at most size / 64 words in all
        out[np.frombuffer(r["words"], "<i8")] = np.frombuffer(r["bits"], "<u8")
    return out


def held(hashes: pa.Array, bits: np.ndarray) -> pa.Array:
    """Which of the hashes the bitmap lets pass."""
    place = hashes.to_numpy(zero_copy_only=False).view(np.uint64) & np.uint64(len(bits) * 64 - 1)
    return pa.array((bits[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool))


def passing(df: DataFrame, key: Column, bits: np.ndarray) -> DataFrame:
    """The rows of df whose key's hash the bitmap lets pass: all that it was made of, and few others. A null key passes where its hash does."""
    shared, hashed = df.sparkSession.sparkContext.broadcast(bits), free_name(df, "hashed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(batch.columns[1:], names=batch.schema.names[1:]).filter(held(batch.column(0), shared.value))

    return map_arrow(df.select(F.xxhash64(key).alias(hashed), "*"), run, df.schema)
