"""Session helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; also made the context's checkpoint folder if
    it has none.

    ``spark.checkpoint.dir`` names it.  Where that is unset and the master is local (as in
    tests), a temporary folder of the driver stands in; on a cluster it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        sc = spark.sparkContext
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if sc.applicationId not in _own:
            _own[sc.applicationId] = tempfile.mkdtemp(prefix="pathweave-")
            atexit.register(shutil.rmtree, _own[sc.applicationId], ignore_errors=True)
        base = _own[sc.applicationId]
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def cut(frame: DataFrame) -> DataFrame:
    """The frame, computed and written to the shared folder, without its lineage."""
    shared_dir(frame.sparkSession)
    return frame.checkpoint()


def ship_package(spark: SparkSession) -> None:
    """Give the workers of this application the package, once; they may not have it installed."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory() as tmp:
        kept = Path(tempfile.mkdtemp(prefix="pathweave-ship-"))
        shutil.copytree(root, Path(tmp, root.name), ignore=shutil.ignore_patterns("__pycache__", "*.pyc"))
        sc.addPyFile(shutil.make_archive(str(kept / root.name), "zip", tmp))
    _shipped.add(sc.applicationId)
