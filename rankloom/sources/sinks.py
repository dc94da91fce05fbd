"""Writers, the order-free table digest and the read-through cache."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_entity(df: DataFrame, path: str, partition: str = "city") -> None:
    """Processed entity as parquet, one folder per market."""
    df.write.mode("overwrite").partitionBy(partition).parquet(path)


def write_feature_table(
    df: DataFrame, path: str, group: str = "query_group", id_column: str = "id"
) -> None:
    """Feature table sorted by group then id.

    The id is part of the range key, so one very large group still splits over several files.
    """
    (
        df.repartitionByRange(group, id_column)
        .sortWithinPartitions(group, id_column)
        .write.mode("overwrite")
        .parquet(path)
    )


def write_report_csv(df: DataFrame, path: str) -> None:
    """A finished report (tens of rows) as a single CSV file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines."""
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines with a declared schema."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_columns(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A parquet table narrowed to the columns a step needs."""
    return spark.read.parquet(path).select(*columns)


def table_digest(df: DataFrame) -> DataFrame:
    """One row identifying a table's content whatever order its rows come in: ``rows, digest``.

    A row is the MD5 of its values as text in order of their names, each with its length (null: ``-``); the
    first 60 bits are summed exactly, so neither partitioning nor the engine matters.
    """
    texts = [F.col(c).cast("string") for c in sorted(df.columns)]
    row = F.md5(F.concat(*[
        F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))
    number = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")
    total = F.coalesce(F.sum(number), F.lit(0).cast("decimal(38,0)"))
    return df.agg(F.count(F.lit(1)).alias("rows"), total.alias("_sum")).select(
        "rows", F.sha2(F.concat_ws(":", "rows", "_sum"), 256).alias("digest"))


def missing_from_cache(wanted: DataFrame, cached: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Documents not scored yet."""
    return wanted.join(cached.select(*keys).distinct(), list(keys), "left_anti")


def read_through(
    wanted: DataFrame,
    cached: DataFrame,
    keys: Sequence[str],
    score: Callable[[DataFrame], DataFrame],
    refresh: bool = False,
) -> DataFrame:
    """Cached responses for the wanted documents, scoring only what the cache lacks.

    ``refresh`` ignores the cache. The result has the cache's columns; append it to keep it.
    """
    if refresh:
        return score(wanted).select(*cached.columns)
    held = cached.join(wanted.select(*keys).distinct(), list(keys), "left_semi")
    fresh = score(missing_from_cache(wanted, cached, keys)).select(*cached.columns)
    return held.unionByName(fresh)
