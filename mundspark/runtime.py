"""Session plumbing: table paths, shipping the package, cutting lineage, shuffle width."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables; a file or a folder of files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers, once per session."""
    sc = spark.sparkContext
    if getattr(sc, "_mundspark_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="mundspark")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "mundspark_pkg.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path("mundspark") / p.relative_to(root)))
    sc.addPyFile(archive)
    sc._mundspark_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session. Where none is set, a temporary one, which only a local session may use: the
    executors of a cluster would each write to their own disk."""
    sc = spark.sparkContext
    known = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        known = getattr(sc, "_mundspark_dir", None)
        if not known:
            known = tempfile.mkdtemp(prefix="mundspark-ckpt")
            atexit.register(shutil.rmtree, known, ignore_errors=True)
            sc._mundspark_dir = known
    return known


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which clear deletes."""
    path = f"{checkpoint_dir(spark)}/mundspark/{name}-{uuid.uuid4().hex}"
    _staged(spark).append(path)
    return path


def staged(df: DataFrame, name: str = "stage", partition_by: list[str] | None = None) -> DataFrame:
    """Write df to the shared checkpoint folder and read it back: its lineage ends there, and a lost executor costs
    no recomputation before it. Column pruning and filters work on what is read back."""
    spark = df.sparkSession
    path = scratch(spark, name)
    w = df.write.option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _staged(spark: SparkSession) -> list[str]:
    sc = spark.sparkContext
    if not hasattr(sc, "_mundspark_staged"):
        sc._mundspark_staged = []
        atexit.register(_leave, spark)
    return sc._mundspark_staged


def _leave(spark: SparkSession) -> None:
    """At the end of the program: delete what is still staged, if the session can still reach it or it is on this disk."""
    try:
        if spark.sparkContext._jsc is not None:
            clear(spark)
    except Exception:  # a session that is gone leaves its files to the folder's owner
        pass
    for path in _staged(spark):
        shutil.rmtree(path.removeprefix("file:"), ignore_errors=True)


def clear(spark: SparkSession) -> None:
    """Delete the tables that this session has staged. DataFrames that read them are of no use after it, so long-running
    sessions call it between jobs; the end of the program does it too."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = _staged(spark)
    while paths:
        path = jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(conf).delete(path, True)


def width(df: DataFrame, part_bytes: int = 256 << 20) -> int:
    """Partitions for a shuffle of df whose tasks run Python and so should not be coalesced: the session's setting, or
    as many as keep a partition at part_bytes of the files that the plan reads. Estimates of joins are products and say
    nothing of a result's size, so only the scans count."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    # a leaf of unknown size is estimated at the largest number there is
    return max(least, -(-sum(x for x in sizes if x < 1 << 62) // part_bytes))
