"""Folders for data that several executors write and read."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import SparkSession

_local: list[str] = []
_made: list[str] = []


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder path under the cluster's checkpoint folder.

    The cluster names that shared folder in `spark.checkpoint.dir`. Where it is unset, a
    folder of this machine serves a local session; on a cluster that is an error, since
    every executor would write to its own disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a shared folder for master {master}")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="vocspark-"))
        base = _local[0]
    path = f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"
    _made.append(path)
    return path


def clear(spark: SparkSession, keep: Iterable[str] = ()) -> None:
    """Delete the folders made so far in this process, but for `keep`.

    Frames that read them end with them: call it when results are written, between jobs.
    """
    kept = set(keep)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in [p for p in _made if p not in kept]:
        folder = hadoop(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        _made.remove(path)
