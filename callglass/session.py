"""Session settings the jobs rely on, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runtime SQL settings every job needs. Times are UTC. A repeated key in a JSON
#: object keeps its last value, as common JSON readers do.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build(master: str = "local[*]", shuffle_partitions: int | None = None, **extra: str) -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    builder = SparkSession.builder.master(master).appName("callglass")
    builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, named by ``spark.checkpoint.dir``.

    Only a session on one machine that names none gets a temporary one. Elsewhere
    executors would write to their own disks, so a missing setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master!r} share")
        folder = tempfile.mkdtemp(prefix="callglass-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _located(spark: SparkSession, name: str):
    """A Hadoop path and the file system it lies in."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def delete_path(spark: SparkSession, pattern: str) -> None:
    """Deletes what a path pattern names, in whatever file system it lies."""
    path, files = _located(spark, pattern)
    for found in files.globStatus(path) or []:
        files.delete(found.getPath(), True)


def delete_exactly(spark: SparkSession, paths: list[str]) -> None:
    """Deletes these paths, as many as exist, without listing any folder."""
    for name in paths:
        path, files = _located(spark, name)
        files.delete(path, True)


def exist(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of the paths that are there."""
    return [name for name in paths if (at := _located(spark, name))[1].exists(at[0])]


def write_text(spark: SparkSession, name: str, text: str) -> None:
    """Writes a small file so that it appears whole or not at all: under another name first, then renamed."""
    draft, files = _located(spark, f"{name}.{uuid.uuid4().hex}.draft")
    out = files.create(draft, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    path, _ = _located(spark, name)
    files.delete(path, False)
    if not files.rename(draft, path):
        raise OSError(f"could not write {name}")


def read_text(spark: SparkSession, name: str) -> str | None:
    """A small file's text; None if it is not there."""
    path, files = _located(spark, name)
    if not files.exists(path):
        return None
    source = files.open(path)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of the finished files of a folder, in order; none if there is no folder."""
    path, files = _located(spark, folder)
    if not files.exists(path):
        return []
    return sorted(n for n in (f.getPath().getName() for f in files.listStatus(path)) if not n.endswith(".draft"))


def broadcast_if_small(df: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """Mark ``df`` for broadcast when a count shows at most ``max_rows`` rows.

    A larger frame is returned as it is, so that the join shuffles. Meant for narrow
    key frames, as those of a micro-batch, where the frame is already persisted.
    """
    if df.count() <= max_rows:
        return F.broadcast(df)
    return df
