"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "beatwire", master: str | None = None,
                  **settings: str) -> SparkSession:
    """A session with the settings the operators rely on.

    On a cluster leave ``master`` unset and let ``spark-submit`` decide;
    shuffle partitions and memory belong to the deployment.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster
    another executor could not read it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="run-")
        spark.conf.set("spark.checkpoint.dir", folder)
        return folder
    raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")


# Paths handed out by this driver and not yet removed.
_HANDED_OUT: list[str] = []


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared folder; nothing is created yet."""
    path = f"{shared_dir(spark)}/beatwire/{purpose}-{uuid.uuid4().hex}"
    _HANDED_OUT.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of any file system that Spark knows; an absent one is no error."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop.getFileSystem(conf).delete(hadoop, True)


def remove_intermediate(spark: SparkSession) -> None:
    """Delete what :func:`work_dir` handed out so far.

    To be called when the results that read it are written or collected.
    """
    while _HANDED_OUT:
        remove(spark, _HANDED_OUT.pop())


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The same rows, computed once and kept as a table in the shared folder.

    For an intermediate result that is read several times and dear to
    compute: it outlives the executors that computed it.
    """
    path = work_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
