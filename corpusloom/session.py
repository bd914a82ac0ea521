"""Session settings, table access and the shared folder for cut lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build(master: str = "local[8]", partitions: int = 8, app: str = "corpusloom") -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` under `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's `spark.checkpoint.dir`. Only
    in local mode, as in tests, a folder of this machine stands in for one that is unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        at = sc.getConf().get("spark.checkpoint.dir")
        if not at and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: a folder of the driver's machine is none that executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="corpusloom-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """`df` computed once and kept in the shared folder, so that no later failure goes back
    beyond it. spark.cleaner.referenceTracking.cleanCheckpoints removes what is out of use."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """`df` dealt out by columns over as many tasks as a shuffle has, however few its bytes are:
    for rows that cost much more to work on than to send, which size alone would put together."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)
