"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.graph import settle, unsettle

#: Bytes of an Arrow batch: texts are long, and both sides of a task hold several batches.
BATCH = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches of this session hold BATCH bytes at most; a lower limit of its own stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).rstrip("b")
    if not now.isdigit() or int(now) > BATCH:
        spark.conf.set(name, BATCH)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: a table in the shared folder that survives lost executors, read again."""
    small_batches(df.sparkSession)
    return settle(df)


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a table that ``cut`` wrote and no plan reads any more."""
    unsettle(df)


def n_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def with_columns(df: DataFrame, new: str, compute) -> DataFrame:
    """df with the columns of the DDL ``new``; compute(batch) gives their arrays for a RecordBatch.

    Columns of df that have a new column's name are replaced. One narrow pass; nothing is gathered.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    small_batches(df.sparkSession)
    fields = StructType.fromDDL(new)
    names = {f.name.lower() for f in fields}
    kept = [f for f in df.schema if f.name.lower() not in names]
    schema = StructType([*kept, *fields])

    def run(batches):
        types = [f.type for f in to_arrow_schema(fields)]
        for batch in sliced(batches):
            old = [batch.column(batch.schema.names.index(f.name)) for f in kept]
            made = [pa.array(x, t) if not isinstance(x, pa.Array) else x.cast(t) for x, t in zip(compute(batch), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*old, *made], names=[f.name for f in schema])

    return df.mapInArrow(run, schema)


def sliced(batches, rows: int = 512):
    """The batches in pieces of some rows, so that what Python holds of long texts at once stays small. Behind the last,
    what the task doesn't use any more goes back to the system: workers live on, and share an executor's memory."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    release()


def release() -> None:
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps what it has
        pass


def give_back(spark: SparkSession) -> None:
    """What the driver doesn't use any more goes back to the system: shuffles and broadcasts that only its garbage still
    holds, the free part of its heap, and freed native memory. For steps of many jobs, between them."""
    import gc

    from py4j.protocol import Py4JError

    gc.collect()
    release()
    jvm = spark.sparkContext._jvm
    jvm.System.gc()
    try:
        name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer().invoke(name, "systemTrimNativeHeap", None, None)
    except Py4JError:  # another JVM: it keeps what it has
        pass


def column(batch, name: str) -> list:
    """The Python values of a batch's column."""
    return batch.column(batch.schema.names.index(name)).to_pylist()
