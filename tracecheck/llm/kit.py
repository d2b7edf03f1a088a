"""Helpers shared by the text operators: slicing Arrow batches and mapping texts."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes that one call of a mapped function sees at most (one text may be longer).
SLICE_BYTES = 2 << 20


def text_array(column: pa.Array) -> pa.Array:
    """A string array without nulls: a null text counts as an empty one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    return column.cast(pa.large_string())


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, memoryview]:
    """Offsets (from zero) and bytes of a large_string array."""
    n = len(texts)
    if not n:
        return np.zeros(1, np.int64), memoryview(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = memoryview(texts.buffers()[2] or b"")[int(offsets[0]) : int(offsets[-1])]
    return offsets - offsets[0], data


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` text bytes each, one row at least."""
    ends = text_buffers(texts)[0][1:]
    at, n = 0, len(texts)
    while at < n:
        base = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield at, to
        at = to


def per_document(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of values[starts[i]:starts[i+1]]; empty ranges give 0."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[starts[1:]] - total[starts[:-1]]


def map_texts(df: DataFrame, text: str, fn: Callable[[pa.Array], list[pa.Array]], fields: list[tuple[str, T.DataType]], keep: list[str] | None = None) -> DataFrame:
    """`keep` columns of df (all by default) and `fields`, which fn computes from slices of texts.

    fn gets a large_string array without nulls and returns one array a field, in the order of `fields`.
    Rows keep their other columns, so nothing has to be joined back. A column that has the name of a new one, case
    aside, is replaced by it.
    """
    new = {n.lower() for n, _ in fields}
    names = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    source = df.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = T.StructType([source.schema[i] for i in range(len(names))] + [T.StructField(n, t) for n, t in fields])
    width = len(names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_array(batch.column(width))
            for at, to in slices(texts):
                found = fn(texts.slice(at, to - at))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(at, to - at) for i in range(width)), *found], names=[*names, *(n for n, _ in fields)])
            pa.default_memory_pool().release_unused()  # workers live on, beside those of other stages

    return source.mapInArrow(run, schema)


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores in front until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken or any(t.startswith(name.lower()) for t in taken):
        name = "_" + name
    return name


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def shared_base(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Only a local master may go without."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        place = "/tmp/checkpoints"
    return place.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Written to the shared folder, and read from there by what follows."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_base(df.sparkSession))
    return df.checkpoint(eager=True)


def table(df: DataFrame) -> DataFrame:
    """Written to the shared folder as Parquet, and read from there by what follows.

    For tables that are joined: Spark knows their sizes, so small ones are broadcast without a shuffle of the other side,
    and many small files are read by few tasks.
    """
    spark = df.sparkSession
    place = f"{shared_base(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(place)
    return spark.read.schema(df.schema).parquet(place)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
