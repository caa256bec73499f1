"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def get_session(app: str = "answerrec", **conf: str) -> SparkSession:
    """A session with adaptive execution, skew-join splitting and UTC timestamps."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, which need not see the folder it was imported from.

    `get_session` does so; call it for a session that was made elsewhere. Once per context.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="answerrec-")) / "answerrec.zip"  # of the driver; Spark hands it on
    with zipfile.ZipFile(archive, "w") as file:
        for source in sorted(package.rglob("*.py")):
            file.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir.

    Only a local master may fall back to a folder of this machine, because there
    driver and executors are one process.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    folder = tempfile.mkdtemp(prefix="answerrec-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a Parquet table in the shared folder and read it back.

    The lineage ends at files that outlive a lost executor, and readers get column
    pruning and real size statistics.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.stored_at = path
    return found


def discard(*tables: DataFrame) -> None:
    """Delete the files of written tables that nothing will read again; other frames are left alone."""
    for table in tables:
        if path := getattr(table, "stored_at", None):
            folder, fs = file_system(table.sparkSession, path)
            fs.delete(folder, True)


def file_system(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """A Hadoop path and its file system."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


TEXT_PARTITIONS = "answerrec.text.partitions"


def spread(df: DataFrame) -> DataFrame:
    """Deal texts to as many tasks as the setting `answerrec.text.partitions` says, if it is set.

    Without it the scan's own splits stay. It helps with files of a single row group.
    """
    number = df.sparkSession.conf.get(TEXT_PARTITIONS, None)
    return df.repartition(int(number)) if number else df


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Deal whole documents by their key, before their words become rows.

    What is then grouped by the key and something else stays where it is: the texts are
    shuffled once, instead of a row for every word of every document. As many tasks as
    `spread`, or as shuffles have.
    """
    number = df.sparkSession.conf.get(TEXT_PARTITIONS, None) or shuffle_partitions(df.sparkSession)
    return df.repartition(int(number), key)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
