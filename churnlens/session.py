"""Session helpers: a local session for tests/bench and the shared scratch folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int | None = None,
                  app_name: str = "churnlens", shared: str | None = None) -> SparkSession:
    """A ``local[N]`` session for tests and the bench (UI off, AQE on). shared: its checkpoint folder."""
    parts = shuffle_partitions or (cores if isinstance(cores, int) else 8)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
    )
    if shared:
        builder = builder.config("spark.checkpoint.dir", shared)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, read from the session. Where it is
    unset, a folder in the session's warehouse, which every cluster shares, is set for it."""
    sc = spark.sparkContext
    cur = sc.getCheckpointDir()
    if cur:
        return cur
    sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_checkpoints"))
    return sc.getCheckpointDir()


_ROOTS: dict[str, str] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for a written table. The application's paths lie in one folder, which its
    file system removes when the application ends."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        root = os.path.join(shared_dir(spark), f"churnlens-{app}-{uuid.uuid4().hex[:8]}")
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _ROOTS[app] = root
    return os.path.join(_ROOTS[app], f"{name}-{uuid.uuid4().hex[:12]}")
