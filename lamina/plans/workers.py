"""What Python workers need: this package on their path, batches that are not too large, memory given back."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

HOME = str(Path(__file__).resolve().parents[2])
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Workers live on between tasks: what they free must go back to the system, not stay in pools.
ALLOCATORS = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": str(2 << 20), "MALLOC_TRIM_THRESHOLD_": str(16 << 20)}


def let_workers_import(spark: SparkSession) -> SparkSession:
    """Adds the package's folder to the path of workers on this machine, wherever the driver was
    started. On a cluster the package is shipped (--py-files) or installed; this then does no harm.
    A session that leaves the size of batches at Spark's 10,000 rows gets 2,000: of documents, a batch
    and its copy in each worker are then some 10 MB."""
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if HOME not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([HOME, *filter(None, paths)])
    for name, value in ALLOCATORS.items():
        environment.setdefault(name, value)
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, "2000")
    return spark
