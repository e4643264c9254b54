"""What the operators of this subpackage share: durable intermediate tables and Arrow helpers."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.pandas.types import to_arrow_schema

#: A word is a run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor and the driver can reach, from ``spark.checkpoint.dir``.

    Where the session names none, the checkpoint folder set on its context counts; where there is none
    either, one is made and set, which only a session on one machine can do.
    """
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path.rstrip("/")
    if made := spark.sparkContext.getCheckpointDir():
        return made.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="winnow-checkpoint-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def durable(df: DataFrame, label: str, few_files: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends here.

    A lost executor costs no recomputation above this point, and several readers share one
    evaluation. With ``few_files``, for tables that are small beside the work above them, at most two
    tasks a core write, each what several of the last shuffle's partitions come to, one after another.
    The shuffle files of the write go when it ends, not when the driver next collects garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/winnow/{label}-{uuid.uuid4().hex}"
    if few_files:
        df = df.coalesce(2 * spark.sparkContext.defaultParallelism)
    # nobody waits for the marker of a finished write: the table is read by this call's own plan
    write = df.write.option("compression", "zstd").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._winnow_path = path
    if _scratch:
        _scratch[-1].append(path)
    return out


#: Tables written inside the open ``scratch`` blocks, by path.
_scratch: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Delete the tables written inside, when the block ends. Gives a function to keep a table by, for
    those that what is handed out still reads."""
    made, kept = [], set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._winnow_path)
        return df

    _scratch.append(made)
    try:
        yield keep
    finally:
        _scratch.pop()
        for path in made:
            if path not in kept:
                delete(spark, path)
            elif _scratch:
                _scratch[-1].append(path)


def delete(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_winnow_path", None):
            delete(t.sparkSession, path)


@contextlib.contextmanager
def settings(spark: SparkSession, **conf: str) -> Iterator[None]:
    """SQL settings (dots written as double underscores) that hold for the jobs run inside."""
    names = {k.replace("__", "."): v for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def with_bytes(docs: DataFrame, *columns: str, text: str = "text") -> DataFrame:
    """The named columns and the text's UTF-8 bytes as ``utf8`` (null text: empty)."""
    return docs.select(*columns, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("utf8"))


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict | None]], schema: str) -> DataFrame:
    """Apply a batch function made once per task; it returns a column dict for each Arrow batch."""
    spark_schema = StructType.fromDDL(schema)
    arrow = to_arrow_schema(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            if batch.num_rows and (out := f(batch)) is not None:
                yield record(out, arrow)

    return df.mapInArrow(run, spark_schema)


def map_slices(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict | None]], schema: str, column: str = "utf8", limit: int = 1 << 20, rows: int = 4096) -> DataFrame:
    """As map_batches, but in slices of about ``limit`` bytes of a binary column and ``rows`` rows, each put out at once,
    so that a worker holds the arrays of one slice whatever the batch."""
    spark_schema = StructType.fromDDL(schema)
    arrow = to_arrow_schema(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for part in byte_slices(batch, column, limit, rows):
                if (out := f(part)) is not None:
                    yield record(out, arrow)

    return df.mapInArrow(run, spark_schema)


def byte_slices(batch: pa.RecordBatch, column: str = "utf8", limit: int = 1 << 20, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch: about ``limit`` bytes of the column, ``rows`` rows at most, one at least."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < batch.num_rows:
        before = int(ends[a - 1]) if a else 0
        b = min(max(a + 1, int(np.searchsorted(ends, before + limit, side="right"))), a + rows)
        yield batch.slice(a, b - a)
        a = b


def record(columns: dict, arrow: pa.Schema) -> pa.RecordBatch:
    arrays = []
    for field in arrow:
        x = columns[field.name]
        if isinstance(x, pa.ChunkedArray):
            x = x.combine_chunks()
        if not isinstance(x, pa.Array):
            x = pa.array(x, type=field.type)
        arrays.append(x if x.type == field.type else x.cast(field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=arrow)


def in_slices(values: list[bytes], limit: int = 3 << 20) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of texts of about ``limit`` bytes in total, to bound a task's memory."""
    a, held = 0, 0
    for i, v in enumerate(values):
        if held and held + len(v) > limit:
            yield a, i
            a, held = i, 0
        held += len(v)
    if a < len(values):
        yield a, len(values)
