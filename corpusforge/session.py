"""Spark sessions and the folder that executors share."""

from __future__ import annotations

import os
import re
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def build(master: str | None = None, shuffle_partitions: int | None = None, name: str = "corpusforge") -> SparkSession:
    """A session with adaptive execution and UTC; on a cluster the submitter's settings hold for the rest."""
    b = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def workers_import(spark: SparkSession) -> None:
    """Python workers look for the package where the driver has it, too, whatever their working directory.

    Where executors don't have that folder, install the package there or pass it by --py-files.
    """
    root = str(Path(__file__).resolve().parent.parent)
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def shared_folder(spark: SparkSession) -> None:
    """Makes checkpoint() usable: the folder that the cluster names in spark.checkpoint.dir; in local mode, where driver
    and workers are one machine, a temporary one if none is named. On a cluster a missing name is an error."""
    workers_import(spark)
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[.*)?$", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
