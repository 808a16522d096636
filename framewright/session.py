"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_FALLBACK = "spark.framewright.scratch"


def local_session(cores: str = "*", app: str = "framewright") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder named by the cluster in ``spark.checkpoint.dir``.

    A local session that names none gets a fresh local folder, which goes when the process ends.  Any other master must
    name one: executors on other machines would not see a local folder.
    """
    path = spark.conf.get(_KEY, None) or spark.conf.get(_FALLBACK, None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError(f"set {_KEY} to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set(_FALLBACK, path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/framewright/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Fixes values that depend on the physical layout (partition ids) and cuts
    lineage; the copy survives the loss of executors.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
