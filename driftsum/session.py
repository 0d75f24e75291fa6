"""Session helpers: tables, shared scratch folders and materialised intermediate results.

Everything an executor must read back later goes to a folder that all nodes share: the one
named by ``spark.checkpoint.dir``. Only where that setting is absent (unit tests on one
machine) a folder of our own is used.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from contextlib import suppress
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_FILE = 250_000
_shipped: set[str] = set()
_made: list[tuple[SparkSession, str]] = []


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, unless their Python finds it: by PYTHONPATH, or in the working folder."""
    root = Path(__file__).resolve().parent.parent
    context = spark.sparkContext
    places = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    if any(p and Path(p).resolve() == root for p in places) or context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    folder = tempfile.mkdtemp(prefix="driftsum-package-")  # the driver serves the file from here as long as it lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.addPyFile(shutil.make_archive(f"{folder}/driftsum-package", "zip", root, Path(__file__).resolve().parent.name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir`` (any path Spark can open)."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, read from the session; without one, a local folder if all runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
        found = f"file://{tempfile.mkdtemp(prefix='driftsum-checkpoints-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; it is deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/driftsum/{label}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def splittable(grouped: DataFrame, *keys: str) -> DataFrame:
    """The rows of an aggregate, with its keys as new expressions.

    A join of an aggregate on its own keys reuses the aggregate's shuffle, and then Spark's skew rule, which
    wants a plain shuffle on both sides, cannot split a hot key of the other side. Keys that the planner does
    not recognise (and does not simplify, as it would x + 0) cost one more shuffle of the aggregate, which is
    the small side. Keys are strings or whole numbers.
    """
    kind = dict(grouped.dtypes)
    again = lambda c: F.concat(F.col(c), F.lit("")) if kind[c] == "string" else F.col(c).bitwiseXOR(F.lit(0).cast(kind[c]))
    return grouped.withColumns({c: again(c) for c in keys})


def small_batches(spark: SparkSession) -> None:
    """Batches for columns of long texts: Arrow batches of 8 MB instead of 64, scans of 512 rows at once instead of 4096.

    Both bound what a task holds, in Python and in the JVM; a session's own settings stay.
    """
    ship(spark)
    for key, default, own in (("spark.sql.execution.arrow.maxBytesPerBatch", ("67108864b", "67108864", "64m", "64MB"), "8m"), ("spark.sql.parquet.columnarReaderBatchSize", ("4096",), "512")):
        if spark.conf.get(key, None) in default:
            spark.conf.set(key, own)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path early; a path that is already gone is no error."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def _file_system(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def list_files(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds; none if there is no such folder."""
    system, folder = _file_system(spark, path)
    return sorted(x.getPath().getName() for x in system.listStatus(folder)) if system.exists(folder) else []


def read_text(spark: SparkSession, path: str) -> str:
    system, file = _file_system(spark, path)
    stream = system.open(file)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there whole or not at all: it is written under another name first."""
    system, file = _file_system(spark, path)
    _, other = _file_system(spark, f"{path}.{uuid.uuid4().hex}")
    stream = system.create(other, True)
    try:
        stream.write(text.encode())
    finally:
        stream.close()
    system.delete(file, False)
    if not system.rename(other, file):
        raise OSError(f"cannot write {path}")


def materialize(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage durably.

    ``rows``, a bound of its rows if one is known, decides the number of files, so that a small result does
    not become a file for each task; its rows are then dealt out evenly after they are computed.
    """
    spark = df.sparkSession
    ship(spark)
    path = scratch_path(spark, label)
    (df if rows is None else df.repartition(1 + rows // ROWS_PER_FILE)).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._driftsum_path = path  # for release()
    return out


def release(*frames: DataFrame) -> None:
    """Delete what :func:`materialize` wrote for these frames; nothing may read them later."""
    for df in frames:
        if path := getattr(df, "_driftsum_path", None):
            drop_path(df.sparkSession, path)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        with suppress(Exception):  # the JVM may have ended before us
            drop_path(spark, path)
