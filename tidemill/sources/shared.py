"""The folder that driver and executors share."""

import re
import tempfile
import uuid
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new place below spark.checkpoint.dir. Where that is unset, a local session (tests) gets a temporary folder, and a
    cluster an error, as its machines would not see each other's."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again, for plans that use it several times."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(path: str):
    """The file system of a path and the path within it, without escapes."""
    from pyarrow import fs

    path = re.sub("^file:/(?=[^/])", "file:///", path)
    files, within = fs.FileSystem.from_uri(quote(path if "://" in path else f"file://{path}", safe="/:%@?&=+,;~"))
    return files, unquote(within)


def file_of(path: str):
    """The file system of a file as Spark names it (a local one's name has no escapes) and the path within it."""
    from pyarrow import fs

    local = re.fullmatch("(?:file:(?://)?)?(/.*)", path, re.DOTALL)
    return (fs.LocalFileSystem(), local[1]) if local else file_system(path)
