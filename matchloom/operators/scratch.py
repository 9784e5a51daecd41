"""Tables between the rounds of an iteration, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders of local sessions that name none, by application.
_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.

    Where it is unset, a session on one machine, as in tests, gets a temporary folder; on a cluster that is an error, as
    no folder of one machine reaches the others.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _local:
        _local[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="matchloom-")
    return _local[context.applicationId]


def written(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read back; forget() removes them."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Removes tables that written() made and that nothing reads any more; other frames are left alone."""
    for table in tables:
        if path := table.__dict__.pop("scratch_path", None):
            jvm_path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            jvm_path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(jvm_path, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of a query go as soon as it has ended, not when the driver next collects its garbage: for rounds whose frames are used once."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)
