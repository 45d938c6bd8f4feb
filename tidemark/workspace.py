"""Shared scratch space and the one file-system primitive the jobs rely on.

Everything that outlives a task (stream checkpoints, landed tables, cut lineage) lies in
the folder named by `spark.checkpoint.dir`, which every executor and any restarted driver
can see. Only a session whose tasks run inside the driver may fall back to a temporary folder.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


#: Masters without executors of their own; local-cluster is not one of them.
ONE_PROCESS = re.compile(r"local(\[[^\]]*\])?")


def shared_root(spark: SparkSession) -> str:
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root:
        return root
    if not ONE_PROCESS.fullmatch(context.master):
        raise ValueError("spark.checkpoint.dir must name a folder shared by all nodes")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return context.getCheckpointDir()


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder per run; nothing is ever cleared or reused."""
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return _fs(spark, path).exists(_path(spark, path))


def child_names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path), _path(spark, path)
    if not fs.exists(p):
        return []
    return [s.getPath().getName() for s in fs.listStatus(p)]


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    out = _fs(spark, path).create(_path(spark, path), False)
    try:
        out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
    finally:
        out.close()


def read_json(spark: SparkSession, path: str) -> dict:
    stream = _fs(spark, path).open(_path(spark, path))
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def drop_folder(spark: SparkSession, path: str) -> bool:
    return _fs(spark, path).delete(_path(spark, path), True)


def set_age(spark: SparkSession, path: str, second: int) -> None:
    """Give a file, or the files of a folder, a modification time, in seconds since 1970 plus one day."""
    fs = _fs(spark, path)
    for status in fs.listStatus(_path(spark, path)):
        fs.setTimes(status.getPath(), (86_400 + second) * 1000, -1)


def publish(spark: SparkSession, staged: str, target: str) -> bool:
    """Make a finished folder visible under its final name in one rename.

    Returns False when the target is already there; it is never replaced.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = _fs(spark, target)
    fs.mkdirs(_path(spark, target).getParent())
    no_overwrite = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    no_overwrite[0] = hadoop.Options.Rename.NONE
    context = hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(_path(spark, staged), _path(spark, target), no_overwrite)
        return True
    except Py4JJavaError:
        if fs.exists(_path(spark, target)):
            return False
        raise
