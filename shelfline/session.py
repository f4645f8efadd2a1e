"""Session construction and durable lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


# How the names of work folders begin.
WORK = "work-"


def build_session(app: str, master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators rely on.

    ``master`` is given only by tests and the local benchmark; on a cluster it
    comes from ``spark-submit`` together with executor sizing.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="shelfline-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage through a reliable checkpoint, so a lost executor costs no recomputation."""
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_side(df: DataFrame, most: int = 100_000) -> DataFrame:
    """A stored ``df`` hinted for broadcast if it has at most ``most`` rows; beyond that the join is Spark's choice."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for written tables and stream progress, beside the checkpoints."""
    _ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{WORK}{name}-{uuid.uuid4().hex}"


def _place(spark: SparkSession, path: str):
    """The file system of ``path`` and its place there."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def is_folder(spark: SparkSession, path: str) -> bool:
    files, place = _place(spark, path)
    return files.exists(place) and files.getFileStatus(place).isDirectory()


def remove_folder(spark: SparkSession, path: str) -> None:
    files, place = _place(spark, path)
    files.delete(place, True)


def file_exists(spark: SparkSession, path: str) -> bool:
    files, place = _place(spark, path)
    return files.exists(place)


def touch(spark: SparkSession, path: str) -> None:
    """Leave an empty file at ``path``."""
    files, place = _place(spark, path)
    files.create(place, True).close()


def list_folders(spark: SparkSession, path: str) -> list[str]:
    files, place = _place(spark, path)
    return [status.getPath().getName() for status in files.listStatus(place) if status.isDirectory()]


def replace_file(spark: SparkSession, written_folder: str, target: str) -> None:
    """Move the one part file of ``written_folder`` to ``target``, replacing it in one step."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    files, folder = _place(spark, written_folder)
    (part,) = [s.getPath() for s in files.listStatus(folder) if s.getPath().getName().startswith("part-")]
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(folder.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(part, jvm.org.apache.hadoop.fs.Path(target), options)
    files.delete(folder, True)


def remove_work_folders(spark: SparkSession) -> None:
    """Remove all work folders and written tables of this session, for when its results are stored elsewhere."""
    folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        return
    files, place = _place(spark, folder)
    for status in files.listStatus(place):
        if status.getPath().getName().startswith(WORK):
            files.delete(status.getPath(), True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table beside the checkpoints, for results that several later jobs scan."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
