"""Session helpers: a configured session, lineage cuts and shared scratch folders."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from gridscope.errors import TableError

CHECKPOINT_CONF = "spark.checkpoint.dir"
_scratch: list[tuple[SparkSession, str]] = []


def local_session(cores: int | str = 8, app: str = "gridscope", **conf: str) -> SparkSession:
    """A local session for tests and the benchmark. On a cluster, bring your own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8" if cores == "*" else str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only where that setting is absent and the master is local (tests) a temporary folder is
    made and registered as the checkpoint folder. On a cluster a folder of one machine would
    be lost with it, so a missing setting is an error there.
    """
    context = spark.sparkContext
    named, current = spark.conf.get(CHECKPOINT_CONF, None), context.getCheckpointDir()
    if named:
        if not current:
            context.setCheckpointDir(named)
        return named
    if current:
        return current
    if not context.master.split("[")[0] == "local":
        raise TableError(f"set {CHECKPOINT_CONF} to a folder that every executor sees", "NO_SHARED_FOLDER")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="gridscope-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below :func:`shared_dir`, visible to every executor; removed when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    if not _scratch:
        atexit.register(drop_scratch)
    _scratch.append((spark, path))
    return path


def drop_scratch() -> None:
    """Delete every scratch path made so far."""
    while _scratch:
        spark, path = _scratch.pop()
        if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
            continue
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder and forget how it was made."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def run_together(spark: SparkSession, *jobs: Callable[[], Any]) -> list[Any]:
    """Results of independent jobs, submitted at once so that none waits for another's tail."""
    with ThreadPoolExecutor(max_workers=max(1, len(jobs))) as pool:
        futures = [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]
        return [f.result() for f in futures]
