"""Size checks that decide between two exact plans."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Inputs up to this many stored bytes are not counted: a task sorts all their rows, spilling if it must.
SMALL_INPUT_BYTES = 1 << 26
#: Rows one task sorts comfortably; larger groups are cut into ranges.
GROUP_ROWS = 5_000_000


def input_bytes(df: DataFrame) -> int:
    """Stored bytes of all sources below ``df``, as Spark's statistics report them."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves().iterator()
    total = 0
    while leaves.hasNext():
        total += int(str(leaves.next().stats().sizeInBytes()))
    return total


def largest_group(df: DataFrame, by: Sequence[str]) -> int:
    """Rows in the largest group: counted map-side first, one row comes back."""
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("c"))
    return counts.agg(F.max("c")).first()[0] or 0


def has_large_group(df: DataFrame, by: Sequence[str], most: int = GROUP_ROWS) -> bool:
    """True when some group may exceed ``most`` rows.

    Free for small inputs (statistics only); larger inputs pay one aggregation.
    """
    if input_bytes(df) <= SMALL_INPUT_BYTES:
        return False
    return largest_group(df, by) > most


_LOCAL: dict[str, str] = {}  # application id -> temporary folder of a local session


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only in a local session."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="pitfactors-")
    return _LOCAL[context.applicationId]


def stable(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    For small tables that several branches of a plan read, and where later passes must see
    the very same rows.  Unlike a cached table it survives lost executors, and unlike an
    RDD checkpoint it keeps file statistics and column pruning.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
