"""Session helpers shared by every operator: shipping code, checkpoints, table reads."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


#: Rows and bytes of one Arrow batch between the JVM and Python: long texts must not multiply by ten thousand rows.
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python workers can import it wherever they run, and bound the session's Arrow batches."""
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if rows > BATCH_ROWS or rows <= 0:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="pkg-"), f"{PACKAGE.name}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(PACKAGE.rglob("*.py")):
            z.write(f, f"{PACKAGE.name}/{f.relative_to(PACKAGE).as_posix()}")
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, a temporary one on a local master, and an error on a cluster, whose machines share none."""
    if set_to := spark.conf.get("spark.checkpoint.dir", None):
        return set_to.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is unset: this cluster needs a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="checkpoint-")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder of ``spark.checkpoint.dir``; only where that is unset (tests) a folder of our own is used."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; columns are pruned and filters pushed down by the Parquet scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Rows of a side of a join beyond which it is never sent whole to the driver and every task.
BROADCAST_ROWS = 1 << 18


def join_hint(rows: int) -> str | None:
    """How a side of so many rows is to be joined: the planner guesses its size by compressed files, of which a few MB may hold millions of rows."""
    return "merge" if rows > BROADCAST_ROWS else None


def hinted(df: DataFrame, by: str | None) -> DataFrame:
    """``df`` as a side of a join that is done so; without a hint as the planner likes."""
    return df.hint(by) if by else df


#: Rows of a task where a table is dealt by their number.
TASK_ROWS = 1 << 19


def parts_of(df: DataFrame) -> int:
    """How many tasks a table is dealt to, of ``TASK_ROWS`` rows or fewer each, but no fewer than there are cores; of Parquet only the footers are read."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))


def dealt(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """``df`` by keys in so many parts, which adaptive execution doesn't join into larger ones again; without a number as it is."""
    return df.repartition(parts, *keys) if parts else df
