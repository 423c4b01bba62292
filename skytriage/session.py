"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def build_session(app: str = "skytriage", master: str | None = None, partitions: int | None = None,
                  **conf: str) -> SparkSession:
    """A session with UTC timestamps, adaptive execution and Arrow transfer.

    On a cluster leave ``master`` and ``partitions`` unset so that the submit
    configuration decides; tests and the bench pass local values.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster, or a private one when none is set."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="skytriage-ckpt-")
    spark.sparkContext.setCheckpointDir(configured)
    return configured


def durable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder and cut its lineage.

    Used where a plan needs the very same rows twice (block numbers taken from a
    range partitioning) or grows round by round; survives executor loss.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with more columns that are computed once per row.

    Filters are pushed below plain columns, and every mention there computes a column anew:
    a parsed document once per field that is looked at. They are not pushed below a generator.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
