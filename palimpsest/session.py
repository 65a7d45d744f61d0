"""Session helpers: local sessions for tests and benches, and lineage cuts that survive executor loss."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_scratch: list[tuple[SparkSession, str]] = []


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and local measurements. On a cluster the caller's own session is used instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("palimpsest")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    The folder comes from ``spark.checkpoint.dir`` (shared by all executors). A machine-local folder is used only where
    nothing is configured and the master is a local one, as in tests.
    """
    context = spark.sparkContext
    have = context._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="palimpsest-ckpt-")
        atexit.register(shutil.rmtree, configured, True)
    context.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint (shared storage), so a lost executor never forces the whole lineage to run again."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared checkpoint folder. What is written there is removed when the driver's Python ends."""
    path = f"{ensure_checkpoint_dir(spark)}/palimpsest-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


def _remove_scratch() -> None:
    for spark, path in _scratch:
        try:
            location = spark._jvm.org.apache.hadoop.fs.Path(path)
            location.getFileSystem(spark._jsc.hadoopConfiguration()).delete(location, True)
        except Exception:  # noqa: BLE001 - the session may be gone; the folder is then the cluster's to clean
            pass
    _scratch.clear()


atexit.register(_remove_scratch)


def materialize(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared checkpoint folder and read back: a table that two consumers need is made once, and a
    lost executor costs a read instead of the lineage. Columns, types and rows are the same."""
    path = scratch_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def barrier(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with the columns computed once a row, however often they are used after it. A plain projection may be merged into
    its consumers, which then compute it again for each use; a generator of one row is not."""
    names = list(columns)
    made = F.inline(F.array(F.struct(*[columns[n].alias(n) for n in names])))
    return df.select(*[c for c in df.columns if c not in names], made.alias(*names) if len(names) > 1 else made.alias(names[0]))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
