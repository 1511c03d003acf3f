"""Session settings for standalone use; on a cluster the caller's session is used as it is."""
from __future__ import annotations

import pyspark.errors.utils as error_utils
from pyspark.sql import SparkSession


def without_call_sites() -> None:
    """Stop recording the Python line of every column expression.

    The recording costs milliseconds per expression on the driver and the plans here are built from thousands. It is
    the effect of ``spark.python.sql.dataFrameDebugging.enabled=false``, which cannot be set once a session runs.
    """
    if hasattr(error_utils, "_enable_debugging_cache"):
        error_utils._enable_debugging_cache = False


#: Texts that travel to a Python worker at once. Without a limit by bytes, 10,000 documents would.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Let batches for Python end by bytes too, unless the session has a smaller limit already."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def local_session(cores: int | str = "*", memory: str = "8g") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]").appName("lectern")
        .config("spark.sql.shuffle.partitions", "8" if cores == "*" else str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
