"""Helpers shared by operators: key cleaning, the shared folder, written intermediate tables."""

from __future__ import annotations

import atexit
import gc
import io
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that trimming removes (ASCII controls and the Unicode space separators).
WHITE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0                　"


def trimmed(col: Column | str) -> Column:
    """The string without white space of any kind at either end; null stays null."""
    return F.btrim(F.col(col) if isinstance(col, str) else col, F.lit(WHITE))


def clean_key(col: Column | str) -> Column:
    """Trimmed key, null where it is null or empty after trimming."""
    t = trimmed(col)
    return F.when(t != "", t)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Only where that is unset and the master is local (tests on one machine) a temporary folder is made and set; on a
    cluster an unset folder is an error, as executors would each write to a disk of their own.
    """
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_minegrid_shared", None)
    if not at:
        if not (sc.master or "").startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="minegrid-")
        sc._minegrid_shared = at
        sc.setCheckpointDir(at)
    return at.rstrip("/")


_made: list[tuple[SparkSession, str]] = []


@contextmanager
def scope(keep: int = 0):
    """What is written below the shared folder within the block is removed at its end, but for the last ``keep`` tables; other results must have been read or stored by then."""
    before = {path for _, path in _made}
    try:
        yield
    finally:
        made = [x for x in _made if x[1] not in before and not x[1].endswith(".zip")]
        for spark, path in made[: len(made) - keep]:
            remove_dir(spark, path)
            _made.remove((spark, path))
        if keep and made:
            tidy(made[0][0])


def tidy(spark: SparkSession) -> None:
    """Shuffle files of plans that nobody holds go at once, not when the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; what is written there is removed when the program ends."""
    path = f"{shared_dir(spark)}/minegrid-{name}-{uuid.uuid4().hex[:12]}"
    _made.append((spark, path))
    return path


def remove_dir(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _made:
        try:
            remove_dir(spark, path)
        except Exception:  # the JVM may be gone already; the folder is the cluster's to clean then
            return


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    ship(spark)
    path = new_dir(spark, name)
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, so their Python workers need not have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_minegrid_shipped", False):
        return
    sc._minegrid_shipped = True
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    path = f"{shared_dir(spark)}/minegrid-package-{uuid.uuid4().hex[:12]}.zip"
    _made.append((spark, path))
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(sc._jsc.hadoopConfiguration()).create(p)
    out.write(bytearray(packed.getvalue()))
    out.close()
    sc.addPyFile(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
