"""Session helpers: where intermediate tables live, and how lineage is cut."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share, as the cluster names it in
    ``spark.checkpoint.dir``; only where that is unset and all runs in one
    process, a fresh temporary folder that is removed at exit."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="covergrid-"))
        atexit.register(shutil.rmtree, _LOCAL[0], True)
    return f"file://{_LOCAL[0]}"


#: Tables of this driver that nothing has dropped yet, and their sessions.
_KEPT: dict[str, SparkSession] = {}


def _remove(path: str) -> None:
    spark = _KEPT.pop(path, None)
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone by then
        pass


@atexit.register
def _remove_all() -> None:
    for path in list(_KEPT):
        _remove(path)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage like ``checkpoint()``, survives the loss of executors, and
    gives the planner real sizes and column pruning. The table is deleted by
    ``discard``, or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/covergrid-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _KEPT[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._covergrid_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables of ``materialise`` that no later plan reads."""
    for t in tables:
        path = getattr(t, "_covergrid_path", None)
        if path in _KEPT:
            _remove(path)


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_covergrid_shipped", False):
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="covergrid-zip-")
    atexit.register(shutil.rmtree, folder, True)
    sc.addPyFile(shutil.make_archive(f"{folder}/covergrid", "zip", package.parent, package.name))
    sc._covergrid_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
