"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # file sizes are of compressed columns: without this, tables many times the broadcast
    # threshold in memory would pass its check
    "spark.sql.sources.fileCompressionFactor": "6.0",
    "spark.ui.enabled": "false",
}


def get_session(app: str = "statspine", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """A session with this package's defaults; ``conf`` wins over them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_open_scopes: list[list[str]] = []


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Scratch folders named inside are deleted when it is left, but for those that ``outlives`` names.

    For steps whose result is a written table: nothing that they wrote before is read again.
    """
    _open_scopes.append([])
    try:
        yield
    finally:
        for folder in _open_scopes.pop():
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def outlives(folder: str) -> None:
    """Leave a scratch folder to the scope around the present one, if there is any."""
    if _open_scopes and folder in _open_scopes[-1]:
        _open_scopes[-1].remove(folder)
        if len(_open_scopes) > 1:
            _open_scopes[-2].append(folder)


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder name under the shared folder named by ``spark.checkpoint.dir``, or under the checkpoint
    folder that the session was given.

    Without either, a local master writes to a temporary folder; on a cluster that would be a
    folder of each machine's own, so it is an error there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="statspine-")
    folder = f"{root.rstrip('/')}/statspine/{purpose}-{uuid.uuid4().hex}"
    if _open_scopes:
        _open_scopes[-1].append(folder)
    return folder
