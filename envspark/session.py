"""Session helpers.

The library never creates a global session; jobs receive one.  ``build_session``
is for tests, the bench and local runs.  ``checkpoint_dir`` reads the cluster's
shared ``spark.checkpoint.dir`` and only sets a local one when it is unset.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

UTC = "UTC"


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "envspark") -> SparkSession:
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", UTC)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.maxMetadataStringLength", "2000")  # plans show the filters of a scan whole
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors (once for each Spark context), so that Python workers
    import it wherever the driver was started."""
    sc = spark.sparkContext
    if getattr(sc, "_envspark_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="envspark-package-")  # the driver's; Spark copies the file to every executor
    path = os.path.join(folder, "envspark.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(base, name)
                    z.write(full, os.path.join("envspark", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._envspark_shipped = True


def pin_utc(spark: SparkSession) -> None:
    """Day and hour boundaries are UTC (one ``tz`` for every job)."""
    if spark.conf.get("spark.sql.session.timeZone") != UTC:
        spark.conf.set("spark.sql.session.timeZone", UTC)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder from the session; a scratch folder is set only when
    none is configured and the master is local (tests)."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local"):
        # a machine-local folder would not survive executor loss: require the shared one
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster (HDFS/S3/ABFS/GCS)")
    path = tempfile.mkdtemp(prefix="envspark-ckpt-")  # local mode only (tests, laptops)
    sc.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def env_int(name: str, default: int) -> int:
    try:
        return int(os.environ.get(name, default))
    except ValueError:
        return default
