"""Session defaults."""

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, app: str = "flowtally", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; repeated map keys take the last value, as in detector records."""
    b = SparkSession.builder.appName(app)
    b = b.master(master) if master else b
    held = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.mapKeyDedupPolicy": "LAST_WIN"} | conf
    for k, v in held.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Where that is unset and all runs in one process (master local[...]), as in tests, a folder of its own is set.
    """
    sc, key = spark.sparkContext, "spark.checkpoint.dir"
    found = spark.conf.get(key, None) or sc.getConf().get(key)
    if not found:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError(f"{key} is not set")
        found = "file://" + tempfile.mkdtemp(prefix="flowtally-")
        spark.conf.set(key, found)
    return found.rstrip("/")


def lineage_cut(df: DataFrame) -> DataFrame:
    """df computed and checkpointed in the shared folder. What it shuffled is deleted then, as its plan isn't run again."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        return df.select("*").checkpoint()
    finally:
        spark.conf.set(key, before)
