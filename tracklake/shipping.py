"""Gives executors this package and bounds Arrow batches."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Bytes of an Arrow batch: a worker holds a few batches at a time, whatever the length of texts.
BATCH_BYTES = "8m"
_SHIPPED: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Add the package to the session's Python files, so that functions are pickled by reference and worker caches live across tasks.

    Also bounds the bytes of Arrow batches in this session, unless it has its own bound.
    """
    if spark.conf.get("tracklake.batch.bytes", None) is None:
        spark.conf.set("tracklake.batch.bytes", BATCH_BYTES)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="tracklake-code-")) / "tracklake_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)
