"""Working tables in the folder the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset a session on one machine gets a folder of its own; a cluster is told to name one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="mdloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def staging_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder name in the shared folder."""
    return f"{shared_folder(spark)}/mdloom/{purpose}-{uuid.uuid4().hex}"
