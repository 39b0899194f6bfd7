"""Things shared by the training-data operators: shared storage, text forms, batches.

Conventions of every operator in this subpackage
------------------------------------------------
* Input columns are selected by name first, so other columns, clashing names
  included, never reach the plan; an operator's own output columns win.
* Null texts count as empty unless the operator says otherwise.
* Nothing is written to a machine-local folder: tables that cut lineage go to
  ``spark.checkpoint.dir``, so they survive the loss of any executor.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch while a table is written; the executors' buffers for it are up to three times as large while they grow.
_BATCH, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"
#: Bytes and rows of a slice of an Arrow batch.
SLICE, ROWS = 1 << 19, 1000
_OWN: dict[str, str] = {}
#: This process, and the folders that are deleted when it ends.
_RUN, _KEPT = uuid.uuid4().hex[:12], set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Unset, and on one machine (master ``local`` or ``local[n]``), a temporary
    folder takes its place; on a cluster that is an error.
    """
    context = spark.sparkContext
    if found := context.getConf().get("spark.checkpoint.dir"):
        return found.rstrip("/")
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by driver and executors")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="marginalia-")
    return _OWN[context.applicationId]


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back, which cuts its lineage.

    The tables of an application are in one folder, which is deleted when it ends; a result
    that is needed longer has to be written before.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/marginalia/{spark.sparkContext.applicationId}-{_RUN}"
    if folder not in _KEPT:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)  # no other way to any Hadoop file system from Python
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
        _KEPT.add(folder)
    path = f"{folder}/{uuid.uuid4().hex}-{tag}"
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, BATCH)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_driver(spark: SparkSession, rows: list[tuple], schema: pa.Schema) -> DataFrame:
    """Rows that the driver has, as a table. They go by Arrow: a plain list is passed through Python workers of a kind of their own, which executors then keep."""
    columns = zip(*rows, strict=True) if rows else ([] for _ in schema)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema))


def slices(batches: Iterator[pa.RecordBatch], most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Parts of Arrow batches, of about this many bytes of texts and ROWS rows at most, for operators whose working memory is a multiple of them.

    Spark bounds the bytes of the batches themselves (spark.sql.execution.arrow.maxBytesPerBatch);
    a single text is never cut.
    """
    for batch in batches:
        size = np.ones(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
                size += np.asarray(pc.fill_null(pc.binary_length(column), 0))
        part = np.maximum(np.cumsum(size) // most, np.arange(batch.num_rows) // ROWS)
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                yield batch.slice(a, b - a)
