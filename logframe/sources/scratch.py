"""Where work tables lie."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below the cluster's shared checkpoint folder; a local one only where none is set."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared}/{uuid.uuid4().hex}"
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("Set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="logframe-")
