"""Session helpers shared by every operator: where intermediate tables live.

Lineage is cut only by tables written to the folder that the cluster names in
``spark.checkpoint.dir``; it is reliable storage, so a lost executor costs a
re-read and nothing else.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    Reads ``spark.checkpoint.dir``. Where it is unset, a temporary folder is
    used, and only if driver and executors are one machine (``local[...]``).
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="framewright-")
    spark.sparkContext.setCheckpointDir(root)
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def few_rows_a_batch(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts go to Python ``rows`` at a time at most: a batch is held by the executor and by its worker, read and written."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= rows:
        spark.conf.set(name, str(rows))


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a DataFrame over the files.

    The files are removed when the driver's Python ends, or by :func:`release`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/framewright/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove the files of tables that :func:`materialize` made and nothing will read again."""
    for df in tables:
        path = getattr(df, "_written_to", None)
        if path in _written:
            _remove(_written.pop(path), path)


def _remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _remove_written() -> None:
    for path, spark in _written.items():
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone at exit
            return


atexit.register(_remove_written)
