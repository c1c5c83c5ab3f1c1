"""The folder that every executor can reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTING = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir.

    Where none is named, a session on one machine gets a temporary one; on a cluster, whose executors
    could not reach that, it is an error.
    """
    root = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"name a folder that all executors share in {SETTING}")
        root = tempfile.mkdtemp(prefix="tallyframe-")
        spark.conf.set(SETTING, root)
    return root.rstrip("/")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_root(spark)}/{purpose}-{uuid.uuid4().hex}"
