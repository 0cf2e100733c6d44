"""Written intermediate tables in the folder that driver and executors share, and the package itself on executors."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import functools
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_OPEN: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("open recordings", default=())


def shipped(spark: SparkSession) -> None:
    """Give executors this package, once per application, so that it need not be installed on them."""
    context = getattr(spark, "sparkContext", None)
    if context is None or context.applicationId in _SHIPPED:
        return
    top = Path(__file__).parent
    folder = tempfile.mkdtemp(prefix="lumenpress-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = Path(folder) / f"{top.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, str(f.relative_to(top.parent)))
    context.addPyFile(str(path))
    _SHIPPED.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session that names none gets a temporary folder of this machine, a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = getattr(spark, "sparkContext", None)
        if context is None or not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="lumenpress-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        base = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; nothing is written yet."""
    return f"{shared_dir(spark)}/lumenpress/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, and its rows are then fixed."""
    shipped(df.sparkSession)
    path = scratch_path(df.sparkSession, name)
    for made in _OPEN.get():
        made.append(path)
    # nobody reads a _SUCCESS file here; on a local file system the driver starts processes to set its permissions
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """Like ``saved``, in buckets by key, so that grouping or joining by key reads the rows where they lie."""
    spark = df.sparkSession
    shipped(spark)
    path = scratch_path(spark, name)
    for made in _OPEN.get():
        made.append(path)
    table = f"lumenpress_{uuid.uuid4().hex}"
    df.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(buckets, key).saveAsTable(table)
    return spark.table(table)


@contextlib.contextmanager
def recording() -> Iterator[list[str]]:
    """The paths of the tables that this thread saves meanwhile."""
    made: list[str] = []
    before = _OPEN.set((*_OPEN.get(), made))
    try:
        yield made
    finally:
        _OPEN.reset(before)


def discard(spark: SparkSession, paths: list[str], keep: DataFrame) -> list[str]:
    """Delete saved tables, but none that keep reads: these are given back."""
    if not paths:
        return []
    read = {f.rsplit("/", 2)[-2] for f in keep.inputFiles()}  # folders' own names are unique
    used = [p for p in paths if p.rpartition("/")[2] in read]
    for p in set(paths) - set(used):
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return used


def tidied(f):
    """A function that gives a DataFrame; of the tables it saves, those that its result doesn't read are deleted."""

    @functools.wraps(f)
    def run(*args, **kwargs) -> DataFrame:
        with recording() as made:
            out = f(*args, **kwargs)
        discard(out.sparkSession, made, out)
        return out

    return run
