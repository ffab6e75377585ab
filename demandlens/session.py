"""Session and lineage helpers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", partitions: int = 8, app: str = "demandlens") -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named in ``spark.checkpoint.dir``; where it is unset and the master is local, one in the warehouse."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints")
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")


def pin(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table into the shared checkpoint folder and go on from the files.

    Used where a result feeds several branches or an iterative loop.  The files survive a lost executor, cut the lineage, and are
    read back with column pruning and real sizes, so later joins are planned on what is there.
    """
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pin_ordered(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: partitions and the order of rows in them come back as they were."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
