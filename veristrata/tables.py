"""Reading the tables of a data folder, broadcasts by a checked size, and cuts of lineage in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes a side may have at most to be sent to every executor; beyond them the operators shuffle instead.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only where a bounded count of rows and of their bytes proves the side small; otherwise leave the join to the planner."""
    size = sum((F.coalesce(F.length(c), F.lit(0)) if t in ("string", "binary") else F.length(F.to_json(F.struct(c))) if t.startswith(("array", "map", "struct")) else F.lit(8) for c, t in df.dtypes), F.lit(16))
    n, b = df.limit(limit + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if n <= limit and b <= most_bytes else df


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Checkpoints go to the folder the cluster names; a local one is set only where none is (tests), and removed at the end."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import atexit
        import shutil
        import tempfile

        where = tempfile.mkdtemp(prefix="veristrata-checkpoint-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
    sc.setCheckpointDir(where)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh place for a table in the folder that all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write an intermediate result to the shared checkpoint folder and go on from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
