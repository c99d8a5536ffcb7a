"""Plumbing shared by the corpus operators: pass-through Arrow maps, shared folders, blocks.

A text operator here is a function from an Arrow string column to a few new columns. `map_text`
applies it to every partition, in slices of bounded bytes, and keeps all other columns as they
are, whatever their names.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Text bytes that one vectorised step looks at; a longer text is a step of its own.
SLICE_BYTES = 2 << 20


def column_index(df: DataFrame, name: str) -> int:
    """Position of a column: the exact name first, then ignoring case. The first of several wins."""
    names = df.columns
    if name in names:
        return names.index(name)
    folded = [n.lower() for n in names]
    if name.lower() in folded:
        return folded.index(name.lower())
    raise ValueError(f"no column {name!r} in {names}")


def fresh(name: str, taken: list[str]) -> str:
    """The name, or the name with the first free suffix _1, _2, ... if it is taken (ignoring case)."""
    used = {n.lower() for n in taken}
    out, k = name, 0
    while out.lower() in used:
        k += 1
        out = f"{name}_{k}"
    return out


def positional(df: DataFrame) -> DataFrame:
    """The same rows under the names c0, c1, ..., so that repeated names do no harm."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the given columns, under the given new names: pick(df, id="doc_id", text="text")."""
    at = {new: column_index(df, old) for new, old in columns.items()}
    flat = positional(df)
    return flat.select(*(flat[f"c{i}"].alias(new) for new, i in at.items()))


def texts_of(column: pa.Array) -> pa.Array:
    """The column as strings, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    return pc.fill_null(column, "")


def slices(batch: pa.RecordBatch, index: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Pieces of the batch whose texts hold `limit` bytes at most, or one row."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(index)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    yield batch.slice(start)


def map_text(df: DataFrame, column: str, make: Callable[[], Callable], fields: list[tuple[str, T.DataType]], limit: int = SLICE_BYTES) -> DataFrame:
    """df with columns appended that `make()`'s function computes from the texts of `column`.

    make runs once in each task; its function takes an Arrow string array without nulls and
    returns one array for each of `fields`. A new name that df has already gets a suffix (`fresh`).
    No shuffle; memory is bound by `limit` or the longest text.
    """
    index, names = column_index(df, column), list(df.columns)
    for name, _ in fields:
        names.append(fresh(name, names))
    flat = positional(df)
    schema = T.StructType(flat.schema.fields + [T.StructField(f"n{i}", t) for i, (_, t) in enumerate(fields)])
    labels = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in batches:
            for piece in slices(batch, index, limit):
                new = apply(texts_of(piece.column(index)))
                yield pa.RecordBatch.from_arrays([*piece.columns, *new], names=labels)

    return flat.mapInArrow(run, schema).toDF(*names)


def shared_folder(spark: SparkSession) -> str:
    """A new folder's path under spark.checkpoint.dir, which every executor shares.

    Where the setting is missing (tests, one machine) a folder of the warehouse serves.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return f"{base.rstrip('/')}/ferrolens-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "t") -> DataFrame:
    """df written to the shared folder and read back: its lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return what this worker has freed to the system. Workers live on between tasks, and keep the freed arrays of many
    sizes as their own otherwise, beside the next task's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def collected(df: DataFrame) -> dict[str, np.ndarray]:
    """The columns of a small, bounded result as arrays, through Arrow."""
    rows = df.toArrow()
    return {name: rows.column(name).to_numpy() for name in rows.column_names}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
