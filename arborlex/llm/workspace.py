"""Tables between the steps of an operator, in the folder that the cluster shares.

The folder is ``spark.checkpoint.dir`` of the session.  Only a local session
(tests) that names none gets a temporary one.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="arborlex-")
        atexit.register(shutil.rmtree, found.removeprefix("file://"), True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_MADE: list[Workspace] = []


class Workspace:
    """Named Parquet tables of one run; written tables cut the lineage and outlive lost executors.

    A result is lazy and reads them, so they stay until :func:`releasing` says that it has been written.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        _MADE.append(self)

    def save(self, df: DataFrame, name: str, *partition_by: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.partitionBy(*partition_by).option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path) if not partition_by else self.spark.read.parquet(path)

    def drop(self, *names: str) -> None:
        """Removes tables that nothing will read again; without names, all of them."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names or ("",):
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
            path.getFileSystem(conf).delete(path, True)


@contextlib.contextmanager
def releasing():
    """Removes the workspaces that operators make inside, at the end: for who writes their results inside."""
    mark = len(_MADE)
    yield
    for ws in _MADE[mark:]:
        ws.drop()
    del _MADE[mark:]


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, lengthened until no column has them (Spark compares names without case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def buckets_for(items: int, each: int) -> int:
    """Powers of two only, so that a bucket is a prefix of a hash."""
    return 1 << max(0, (max(1, items) - 1) // each).bit_length()


__all__ = ["Workspace", "buckets_for", "fresh", "releasing", "shared_dir"]
