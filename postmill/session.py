"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_live: dict[str, SparkSession] = {}  # folders that were written and nobody has removed yet
_scopes = threading.local()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """The rows of a table's scan over all cores, for costly functions, where a small one comes in fewer partitions.

    A file of one row group is one task whatever its rows cost. Only tables of less than a file's opening cost
    (``spark.sql.files.openCostInBytes``) per core are sent around; larger ones stay as they are read. The rows are
    the same either way. What is no plain scan (projections and filters of a file table) is given back as it is.
    """
    spark = scan.sparkSession
    cores = spark.sparkContext.defaultParallelism
    plan = scan._jdf.queryExecution()
    node = plan.optimizedPlan()
    small = int(node.stats().sizeInBytes()) <= cores * int(spark._jsparkSession.sessionState().conf().filesOpenCostInBytes())
    while node.nodeName() in ("Project", "Filter"):
        node = node.child()
    if not small or node.nodeName() != "LogicalRelation":
        return scan
    return scan.repartition(cores) if plan.toRdd().getNumPartitions() < cores else scan


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints.

    A cluster names a shared folder in ``spark.checkpoint.dir``; only a local master, all of whose tasks run on
    this machine, may go without: a temporary folder is made for it. Any other master without one is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="postmill-checkpoint-"))
    return sc.getCheckpointDir()


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new name below the checkpoint folder, removed like the tables of ``cut``."""
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _live[path] = spark
    if getattr(_scopes, "open", None):
        _scopes.open[-1].append(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as a table into the checkpoint folder and read back: its lineage is cut, every executor
    can read it again, and readers take only the columns they need. Removed by ``release``, at the end of the
    innermost ``scratch`` or, outside of any, when the application ends.
    """
    spark = df.sparkSession
    path = scratch_folder(spark, "table")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def release(df: DataFrame) -> None:
    """Removes the table of a ``cut`` that nothing will read again, as of an earlier round."""
    if path := getattr(df, "_cut_path", None):
        _remove(path)


@contextmanager
def scratch() -> Iterator[None]:
    """Removes at its end the tables that ``cut`` wrote inside, for calls of an application that goes on. A
    DataFrame that reads one of them must not leave the block.
    """
    if not hasattr(_scopes, "open"):
        _scopes.open = []
    _scopes.open.append([])
    try:
        yield
    finally:
        for path in _scopes.open.pop():
            _remove(path)


def _remove(path: str) -> None:
    spark = _live.pop(path, None)
    if spark is not None and spark.sparkContext._jsc is not None:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _remove_all() -> None:
    for path in list(_live):
        try:
            _remove(path)
        except Exception as e:  # the JVM may have gone before; the other tables are tried all the same
            print(f"could not remove {path}: {type(e).__name__}")
            if isinstance(e, ConnectionError):
                return
