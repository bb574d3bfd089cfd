"""Writing an intermediate table once, in storage that all executors share."""

from __future__ import annotations

import atexit
import re
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it's unset, a local master uses its warehouse folder and a cluster is told to set it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/.checkpoints"
    return path.rstrip("/")


def new_dir(spark: SparkSession, what: str) -> str:
    """A fresh folder under :func:`shared_dir`, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"

    def drop() -> None:
        try:
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # the session is gone; the folder's owner cleans it
            pass

    atexit.register(drop)
    return path


def arrow_uri(uri: str) -> str:
    """Arrow's name of a folder that Hadoop calls ``uri``: other schemes for object stores; ``dbfs:`` is mounted."""
    scheme, _, rest = uri.partition(":")
    if scheme in ("s3a", "s3n"):
        return "s3:" + rest
    if scheme == "dbfs":
        return "file:///dbfs/" + rest.lstrip("/")
    return uri if "://" in uri or uri.startswith("file:") else "file://" + uri


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder, for Python code outside Spark's readers."""
    return pafs.FileSystem.from_uri(arrow_uri(uri))


def _store(uri: str) -> tuple[str, str]:
    """A file's store, as :func:`open_folder` takes it, and its name there, as it stands: nothing in it is an escape."""
    scheme, host, name = re.fullmatch(r"(?:([a-z][a-z0-9+.-]*):)?(?://([^/]*))?/*(.*)", uri, re.S).groups()
    return f"{scheme or 'file'}://{host or ''}/", name


def open_file(uri: str, stores: dict[str, tuple[pafs.FileSystem, str]]) -> pa.NativeFile:
    """A file's bytes as a stream; ``stores`` remembers the file systems that files were on."""
    top, name = _store(uri)
    if top not in stores:
        stores[top] = open_folder(top)
    fs, at = stores[top]
    return fs.open_input_stream(f"{at.rstrip('/')}/{name}", compression=None)


def readable(uris: list[str]) -> bool:
    """Whether Arrow knows the stores of all these files; some only Spark does."""
    try:
        return all(open_folder(top) for top in {_store(u)[0] for u in uris})
    except (pa.ArrowException, OSError, ValueError):
        return False


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back; values such as row marks stay as written."""
    path = new_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
