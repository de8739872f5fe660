"""Sessions, tables and the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def session(cores: int = 8, partitions: int | None = None) -> SparkSession:
    """A local session; on a cluster, use the session the cluster gives."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_checkpoint(spark: SparkSession) -> None:
    """Makes checkpoint() usable: by spark.checkpoint.dir, or by a folder of its own where that is unset."""
    shared_base(spark)


def shared_base(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset and everything runs in one process, as in tests, a folder of its own; on
    a cluster that is an error.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        base = f"file://{tempfile.mkdtemp(prefix='tidemill-')}"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def shared_folder(spark: SparkSession, name: str = "rows") -> str:
    """A new folder's path below the shared one."""
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"
