"""Session helpers: building a local session and cutting lineage safely."""

from __future__ import annotations

import gc
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 4, shuffle_partitions: int = 8, app: str = "noteweave") -> SparkSession:
    """A session for tests and benches. On a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, as a URI.

    It is the one that the cluster names in ``spark.checkpoint.dir``. Only a
    local session (tests, a laptop) may leave that unset and gets a temporary
    folder; on a cluster this raises, as executors cannot share one.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="noteweave_"))
    folder = context._jsc.sc().getCheckpointDir().get()
    return re.sub("^file:/*", "file:///", folder if re.match("[A-Za-z][A-Za-z0-9+.-]*:", folder) else f"file:{folder}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the files.

    The files outlive executors, so a lost executor costs no recomputation.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def free_shuffles(spark: SparkSession) -> None:
    """Has the files of shuffles that nothing refers to deleted now; else they stay until the driver happens to collect its garbage."""
    for _ in range(2):  # Python's references first, then what they held
        gc.collect()
        spark.sparkContext._jvm.System.gc()
