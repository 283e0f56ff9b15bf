"""Sessions and tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(master: str = "local[*]", **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName("spanloom")
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir. Where that is unset, a temporary one on one machine; on a
    cluster a folder of each machine's own would lose rows, so that is an error."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not where:
        found = sc._jsc.sc().getCheckpointDir()
        if not found.isDefined() and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        where = found.get() if found.isDefined() else tempfile.mkdtemp(prefix="spanloom-")
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def materialised(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back, so that its row numbers stay what they are."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most_rows: int = 200_000) -> DataFrame:
    """df marked for broadcast if it has at most so many rows; otherwise as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


#: What a task handles, about, of the files behind rows that are dealt out.
TASK_BYTES = 64 << 20


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt out evenly before work that costs far more than moving them, since a small file is one partition. There
    are four partitions a core, or, where the files behind the rows are large, one for each TASK_BYTES of them."""
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    size = sum(n for n in sizes if n < 1 << 60)  # rows that are in no file have no known size
    return rows.repartition(max(4 * rows.sparkSession.sparkContext.defaultParallelism, size // TASK_BYTES))
