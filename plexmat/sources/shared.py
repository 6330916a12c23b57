"""Tables in the folder that all executors share, which cut lineage and survive lost executors; bounds of what a Python worker gets."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or in local mode alone a temporary one."""
    if found := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    key = spark.sparkContext.applicationId
    if key not in _OWN_DIRS:
        own = tempfile.TemporaryDirectory(prefix="plexmat-")
        atexit.register(own.cleanup)
        _OWN_DIRS[key] = own.name
    return _OWN_DIRS[key]


class Scratch:
    """Stored tables to delete: `with Scratch() as own: ...` deletes at its end all that stored() wrote inside, but what keep() names.

    What is kept goes to the enclosing block, if any. Nothing that is read later may still depend on a deleted table.
    """

    _open: ContextVar[tuple[Scratch, ...]] = ContextVar("open_scratch", default=())

    def __init__(self) -> None:
        self.paths: dict[str, DataFrame] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        """A result of stored(), which stays."""
        outer = self._open.get()[:-1]
        for path, own in list(self.paths.items()):
            if own is df:
                del self.paths[path]
                if outer:
                    outer[-1].paths[path] = df
        return df

    def __enter__(self) -> Scratch:
        self._token = self._open.set((*self._open.get(), self))
        return self

    def __exit__(self, *_: object) -> None:
        self._open.reset(self._token)
        for path, df in self.paths.items():
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back."""
    path = f"{shared_dir(df.sparkSession)}/plexmat-{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    if blocks := Scratch._open.get():
        blocks[-1].paths[path] = out
    return out


def small(df: DataFrame, most: int) -> DataFrame:
    """A stored table, with a broadcast hint if its counted rows are at most `most`."""
    return F.broadcast(df) if df.count() <= most else df


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches by rows and bytes, so that long texts or vectors cannot fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
