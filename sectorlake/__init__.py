"""sectorlake: disk-image and corpus analytics on PySpark."""

from __future__ import annotations

import os
import tempfile
import zipfile

_shipped: set[str] = set()
_BATCH, _DEFAULT, _SMALL = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "16777216b"


def small_batches(spark, wanted: bool = True) -> None:
    """Images come to Python in batches of 16 MB, of which a worker has two at a time, whatever their number; or in Spark's again
    (``wanted`` false).  A session's own setting stays."""
    now = spark.conf.get(_BATCH)
    if wanted and now == _DEFAULT:
        spark.conf.set(_BATCH, _SMALL)
    elif not wanted and now == _SMALL:
        spark.conf.unset(_BATCH)


def ship(spark) -> None:
    """Give the executors this package, once an application, unless they find it by PYTHONPATH as the driver does."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    context = spark.sparkContext
    known = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root in known or context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    path = os.path.join(tempfile.mkdtemp(prefix="sectorlake-"), "sectorlake.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(os.path.join(root, "sectorlake")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
        if os.path.exists(extra := os.path.join(root, "corpus_pipeline.py")):
            z.write(extra, "corpus_pipeline.py")
    context.addPyFile(path)
