"""Session helpers: where intermediate tables live, and how large something is allowed to be.

Two limits steer every physical choice in this package. They are row counts, measured on the
data before a choice is made, never guessed:

* ``HOT_ROWS`` -- rows one task may sort or buffer. A group above it is spread over many tasks.
* ``BROADCAST_ROWS`` -- rows a table may hold and still be shipped to every executor.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

HOT_ROWS = 5_000_000
BROADCAST_ROWS = 200_000
#: Rows one task should produce when a small table is about to be multiplied.
TASK_ROWS = 2_000_000


def stage_root(spark: SparkSession) -> str:
    """The shared folder the session names in ``spark.checkpoint.dir``.

    A machine-local folder is used only where the setting is absent and the master is local.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="rankloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage (a lost executor re-reads files instead of recomputing the plan) and fixes
    the values of anything that depended on how rows were laid out when they were written.
    """
    spark = df.sparkSession
    path = f"{stage_root(spark)}/rankloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_bucketed(df: DataFrame, key: str, buckets: int, dealt: bool = False) -> DataFrame:
    """Like :func:`stage`, as a table bucketed by ``key``: joins of such tables on it move no rows.

    ``dealt`` says that ``df`` comes from such a join and its rows lie in their buckets already.
    """
    spark = df.sparkSession
    name = f"rankloom_{uuid.uuid4().hex}"
    rows = df if dealt else df.repartition(buckets, key)
    (rows.write.format("parquet").option("path", f"{stage_root(spark)}/rankloom/{name}")
     .bucketBy(buckets, key).saveAsTable(name))
    return spark.table(name)


def measured(df: DataFrame) -> tuple[DataFrame, int]:
    """Stage an aggregate and count it: ``(table, rows)``.

    The count comes from file footers, the table is computed once however often it is read, and
    plans built on it start from a file scan instead of dragging the whole history along.
    """
    kept = stage(df)
    return kept, kept.count()


def spread(df: DataFrame, rows_out: int, *columns: str) -> DataFrame:
    """Distribute a small table over enough tasks to produce ``rows_out`` rows from it.

    A staged table of a few thousand rows is a single file; exploding it as it stands would be the
    work of a single task.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, rows_out // TASK_ROWS)
    return df.repartition(tasks, *columns)
