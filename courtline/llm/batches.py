"""Arrow plumbing and shared-folder tables used by the corpus operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Text bytes that one step handles at once; a single longer text is a step of its own.
SLICE_BYTES = 2 << 20


def binary_lists(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, None for null."""
    return column.cast(pa.binary()).to_pylist()


def slices(batch: pa.RecordBatch, name: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about `limit` bytes in column `name`."""
    sizes = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False)
    steps = np.cumsum(sizes.astype(np.int64) + 64) // limit
    cuts = [0, *(np.flatnonzero(np.diff(steps)) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def give_back() -> None:
    """Freed memory goes back to the system, which a long-lived process else keeps."""
    gc.collect()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


#: The operator that this Python worker last worked for, and what it keeps over that operator's tasks.
_KEPT: dict[str, dict] = {}


def kept_for(operator: str) -> dict:
    """Models and caches that this Python worker keeps over an operator's tasks. The first task of another operator forgets them."""
    if operator not in _KEPT:
        _KEPT.clear()
        give_back()
        _KEPT[operator] = {}
    return _KEPT[operator]


def schema_of(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def map_texts(
    df: DataFrame,
    text: str,
    outputs: str,
    make: Callable[[], Callable[[list[bytes | None], pa.RecordBatch], dict[str, Iterable]]],
    keep: list[str],
    also: tuple[str, ...] = (),
) -> DataFrame:
    """`df`'s columns `keep` and the `outputs` (DDL) that a step makes from the whole texts in column `text`.

    `make` runs once a task and returns the step, which gets the UTF-8 texts of some rows (None for null)
    and those rows, with the columns `also` that are not kept. An output replaces a kept column of the same name,
    in any letter case.
    """
    out = schema_of(outputs)
    taken = {f.name.lower() for f in out.fields}
    kept = [c for c in keep if c.lower() not in taken]
    source = "__text"
    schema = StructType([df.schema[c] for c in kept] + out.fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_for(make.__module__)
        step = make()
        for batch in batches:
            for part in slices(batch, source):
                made = step(binary_lists(part.column(source)), part)
                columns = [part.column(c).cast(arrow.field(c).type) for c in kept]
                for f in out.fields:
                    value, kind = made[f.name], arrow.field(f.name).type
                    columns.append(value.cast(kind) if isinstance(value, pa.Array) else pa.array(value, type=kind, from_pandas=False))
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.select(*[F.col(f"`{c}`") for c in (*kept, *also)], F.col(f"`{text}`").cast("string").alias(source)).mapInArrow(run, schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; one of our own only where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="courtline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session is gone
        pass


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """`df` as a table in the shared folder: cuts lineage and outlives any executor. Deleted when the driver ends."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_delete, df.sparkSession, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes a table that written() made and nothing reads any more."""
    if path := getattr(df, "_written_at", None):
        _delete(df.sparkSession, path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
