"""Session helpers: table access and lineage cuts that survive the loss of executors."""

from __future__ import annotations

import copy
import gc
import tempfile
import time
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where the session names none, a temporary one is made in local
    mode only; on a cluster no executor but the driver's machine would see it, so that fails."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="stratadoc-checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read on from there: computed once, safe against lost executors.

    What is written goes when its frame is no longer used, if the session is started with
    ``spark.cleaner.referenceTracking.cleanCheckpoints``; else with the folder.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def squeezed(df: DataFrame, vector: str) -> DataFrame:
    """``df`` with its vectors as compressed bytes, so that a shuffle moves less; ``Packed`` reads them back."""
    at = df.columns.index(vector)
    kind = np.float32 if isinstance(df.schema[vector].dataType.elementType, T.FloatType) else np.float64

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in batches:
            column = batch.column(at)
            ends, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).astype(kind)
            made = [len(v := values[lo:hi].tobytes()).to_bytes(4, "little") + codec.compress(v, asbytes=True) if valid else None for lo, hi, valid in zip(ends[:-1], ends[1:], column.is_valid().to_pylist())]
            columns = [*batch.columns]
            columns[at] = pa.array(made, pa.binary())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return df.mapInArrow(run, T.StructType([T.StructField(f.name, T.BinaryType()) if f.name == vector else f for f in df.schema.fields]))


def _vectors(column: pa.Array, kind: type) -> pa.Array:
    codec = pa.Codec("zstd")
    parts = [None if b is None else codec.decompress(b[4:], int.from_bytes(b[:4], "little"), asbytes=True) for b in column.to_pylist()]
    sizes = np.array([len(b or b"") // np.dtype(kind).itemsize for b in parts], dtype=np.int32)
    ends = np.concatenate([np.zeros(1, dtype=np.int32), np.cumsum(sizes, dtype=np.int32)])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(b or b"" for b in parts), dtype=kind)), mask=pa.array([b is None for b in parts]))


class Packed:
    """The rows of ``df``, written once to the checkpoint folder as compressed batches, a fraction of the room ``cut``
    takes where rows hold texts and vectors. ``rows`` gives columns of them as a frame; ``mapInArrow`` hands them to
    Python without one. Columns that are not selected are not unpacked."""

    def __init__(self, df: DataFrame, rows: int = 2000, vector: str = "", number: T.DataType = T.FloatType()):
        """``vector`` is a column of ``squeezed`` vectors of numbers of the type ``number``, if there is one."""
        self.schema, self.sparkSession, self.places = T.StructType([T.StructField(f.name, T.ArrayType(number)) if f.name == vector else f for f in df.schema.fields]), df.sparkSession, list(range(len(df.columns)))
        at, kind = df.columns.index(vector) if vector else -1, np.float32 if isinstance(number, T.FloatType) else np.float64

        def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for lo in range(0, whole.num_rows, rows):
                    sink, some = pa.BufferOutputStream(), whole.slice(lo, rows)
                    if at >= 0:
                        some = pa.RecordBatch.from_arrays([_vectors(c, kind) if i == at else c for i, c in enumerate(some.columns)], names=some.schema.names)
                    with pa.ipc.new_stream(sink, some.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                        out.write_batch(some)
                    yield pa.RecordBatch.from_arrays([pa.array([some.num_rows], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["n", "batch"])

        self.batches = cut(df.mapInArrow(pack, "n int, batch binary"))

    def select(self, *columns: str) -> Packed:
        some, at = copy.copy(self), self.schema.names
        some.places = [self.places[at.index(c)] for c in columns]
        some.schema = T.StructType([self.schema[c] for c in columns])
        return some

    def coalesce(self, tasks: int) -> Packed:
        some = copy.copy(self)
        some.batches = self.batches.coalesce(tasks)
        return some

    def count(self) -> int:
        return self.batches.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def mapInArrow(self, run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:  # noqa: N802
        names, places = self.schema.names, self.places

        def unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for one in batch.column(0):
                    for some in pa.ipc.open_stream(one.as_buffer(), options=pa.ipc.IpcReadOptions(included_fields=places)):
                        yield some.select(names)

        return self.batches.select("batch").mapInArrow(lambda batches: run(unpack(batches)), schema)

    def rows(self, *columns: str) -> DataFrame:
        """The given columns, or all."""
        some = self.select(*columns) if columns else self
        return some.mapInArrow(lambda batches: batches, some.schema)


def release(df: DataFrame) -> None:
    """Let Spark remove the shuffle files and checkpoints of frames that are no longer used; else they stay until the
    driver happens to collect its garbage."""
    for _ in range(2):
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()
        time.sleep(0.5)
