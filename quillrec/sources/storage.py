"""Working folders that driver and executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_made: list[str] = []


def working_folder(spark: SparkSession, name: str) -> str:
    """A new local path under spark.checkpoint.dir; in local mode under a temporary folder where that is unset. Removed at exit."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="quillrec-")
        spark.conf.set("spark.checkpoint.dir", base)
    top = os.path.join(base.removeprefix("file://").rstrip("/"), f"quillrec-{uuid.uuid4().hex}")
    os.makedirs(top)
    _made.append(top)
    return os.path.join(top, name)


@atexit.register
def _clean() -> None:
    for path in _made:
        shutil.rmtree(path, ignore_errors=True)
