"""Sessions, tables and the shared folder in which lineage is cut."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: A side of a join up to this size is copied to every executor.
BROADCAST_BYTES = 32 << 20


def local_session(cores: int = 8, memory: str = "12g") -> SparkSession:
    """A session for tests and benchmarks on one machine; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("ladoga")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One of the given tables, cut to ``columns`` so that the scan reads no others."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the cluster's shared checkpoint folder and read from there.

    The folder is ``spark.checkpoint.dir``. A session on one machine that names none gets a temporary one; on a cluster
    that would be the driver's own disk, so there it is an error. The copy outlives any executor, and what follows
    neither recomputes nor re-plans what came before. Spark removes copies that nothing refers to any more where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` says so.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", "") and not spark.sparkContext.getCheckpointDir():
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


def bytes_of(df: DataFrame) -> int:
    """About as many bytes as the rows of ``df`` take in memory, arrays and maps included; counted where the rows are."""
    size = F.octet_length(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})) + F.lit(16)
    return df.agg(F.sum(size.cast("long")).alias("bytes")).head()["bytes"] or 0


def broadcast_within(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if its rows take at most ``most`` bytes; else as it is, so that Spark joins by shuffle.

    Counting is a small job over what is usually an aggregate; pass the result of ``cut`` to have nothing run twice.
    """
    return F.broadcast(df) if bytes_of(df) <= most else df


def once(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` with one row for each value of ``keys``, nulls being one value.

    Only rows whose key is repeated are shuffled with all their columns; the keys of all rows are counted by themselves.
    """
    twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*[F.col(k).alias(f"{k}_twice") for k in keys])
    twice = broadcast_within(cut(twice))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_twice"))
    return df.join(twice, same, "left_anti").unionByName(df.join(twice, same, "left_semi").dropDuplicates(list(keys)))
