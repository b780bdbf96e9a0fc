"""Session helper for local runs; on a cluster the session is passed in."""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def per_session(build):
    """Caches expressions for the life of a Spark application: building them costs many calls to the JVM."""
    cache: dict[str, object] = {}

    @functools.wraps(build)
    def cached():
        app = SparkSession.getActiveSession().sparkContext.applicationId
        if app not in cache:
            cache.clear()
            cache[app] = build()
        return cache[app]

    return cached


def local_session(cores: str = "8", app: str = "faultlines", memory: str = "8g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir. Without that setting a local master gets a temporary
    folder, removed when Python ends, and any other master an error."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        given = os.environ.get("FAULTLINES_SHARED_DIR")
        _LOCAL_FOLDERS[app] = given or tempfile.mkdtemp(prefix="faultlines-")
        if not given:
            atexit.register(shutil.rmtree, _LOCAL_FOLDERS[app], ignore_errors=True)
    return _LOCAL_FOLDERS[app]
