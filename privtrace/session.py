"""Session helpers: settings for tests and benches, and the shared work folder."""
from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "privtrace", memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench, with a work folder of its own; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
        # the test tables are single files of one row group
        .config("spark.privtrace.spreadTexts", str(cores))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="privtrace-"))
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where the setting is missing, a purely local master, whose executors share
    the machine, takes a fresh folder once per session; any other master has to
    name one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^,]*(,[^,]*)?\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="privtrace-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def new_work_path(spark: SparkSession, label: str) -> str:
    return f"{work_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Cut the lineage with a table in the shared work folder.

    Used where a costly result is read more than once, and between the rounds
    of an iteration. The table outlives lost executors.
    """
    path = new_work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
