"""Session, table access and lineage helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Bytes of estimated input that one task of a Python operator should get.
TASK_BYTES = 24 << 20

_shipped: set[str] = set()


def session(app: str = "corpusmill", cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the operators are tuned for."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of a data directory; columns and filters are pruned by the scan."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of every executor, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    if root.suffix != ".zip" and root.is_dir():
        archive = os.path.join(tempfile.mkdtemp(prefix="corpusmill-"), "corpusmill.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, Path("corpusmill") / p.relative_to(root))
        sc.addPyFile(archive)  # the driver serves the file to all executors
    _shipped.add(sc.applicationId)


def cut(df: DataFrame) -> DataFrame:
    """Materialize `df` in the shared checkpoint folder, so that a lost executor costs no recomputation of its lineage.

    The folder is the one in spark.checkpoint.dir. Where the session names none, a temporary one is made in local mode (tests);
    on a cluster, whose machines don't share such a folder, this is an error.
    """
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _shared_folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not folder and not is_local(sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="corpusmill-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{_shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def is_local(master: str) -> bool:
    """Whether driver and executors are one process."""
    return master == "local" or master.startswith("local[")


def partitions_for(spark: SparkSession, n_bytes: int, task_bytes: int = TASK_BYTES, most: int = 200_000) -> int:
    """Number of partitions in which each holds about `task_bytes` of counted bytes, and no fewer than the shuffle setting.

    Bytes are counted, as rows times their compact size, by the caller: Catalyst's estimates are off by orders of magnitude
    past a join, an explode or a checkpoint.
    """
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(most, -(-n_bytes // task_bytes)))
