"""Raw snapshot reads: gzip CSV per market and entity, plus the file manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.functions.parsing import NULL_TOKENS
from rankloom.operators.quality import CheckFailed
from rankloom.sources import chained, schemas

#: Bytes of a file that one task may read as one value.
WHOLE_BYTES = 1 << 27


def raw_path(root: str, city: str, entity: str, as_of: str | None = None) -> str:
    """Where one market's file lives: ``root/city/as_of/file``."""
    if city not in schemas.SNAPSHOTS:
        raise CheckFailed(f"unknown city {city!r}; expected one of {sorted(schemas.SNAPSHOTS)}")
    if entity not in schemas.FILES:
        raise CheckFailed(f"unknown entity {entity!r}; expected one of {sorted(schemas.FILES)}")
    return f"{root}/{city}/{as_of or schemas.SNAPSHOTS[city]}/{schemas.FILES[entity]}"


def _read_text(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("mode", "FAILFAST")
        .option("enforceSchema", False)  # the header must match, in order
        .csv(path)
    )


def load_raw(
    spark: SparkSession,
    path: str,
    entity: str,
    partitions: int | None = None,
) -> DataFrame:
    """Typed raw entity. Missing-value tokens become null and a null id stops the run.

    A gzip file is one task whatever its size, so rows are spread right after the read.
    """
    target = schemas.schema(schemas.ENTITIES[entity])
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in target.fields])
    raw = _read_text(spark, path, text)
    if entity == "listings":  # file order, which decides the first of repeated ids
        raw = raw.withColumn("_row", F.monotonically_increasing_id())
    raw = raw.repartition(partitions) if partitions else raw.hint("rebalance")
    typed = [
        F.when(~F.col(f.name).isin(*NULL_TOKENS), F.col(f.name)).try_cast(f.dataType).alias(f.name)
        if not isinstance(f.dataType, T.StringType)
        else F.when(~F.col(f.name).isin(*NULL_TOKENS), F.col(f.name)).alias(f.name)
        for f in target.fields
    ]
    return raw.select(*typed, *(["_row"] if "_row" in raw.columns else []))


def load_neighbourhoods(spark: SparkSession, path: str) -> DataFrame:
    """The loadable but unprocessed neighbourhood list."""
    return _read_text(spark, path, schemas.schema(schemas.NEIGHBOURHOODS))


def require_ids(df: DataFrame, entity: str) -> DataFrame:
    """Stop when a pinned id column holds a null (or a value that is not a whole number)."""
    columns = schemas.NOT_NULL[entity]
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise CheckFailed(f"{entity}: pinned columns are absent: {missing}")
    nulls = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns]).first()
    broken = {c: nulls[c] for c in columns if nulls[c]}
    if broken:
        raise CheckFailed(f"{entity}: null ids would join nothing and hash alike: {broken}")
    return df


def manifest(spark: SparkSession, path: str, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """``(path, size_bytes, sha256)`` per file under ``path``, hashed where the file is read.

    A file of up to ``whole_bytes`` is read by one task; the hash of a larger one goes from task to task
    (:mod:`rankloom.sources.chained`), but for compressed ones, which Spark's line reader would unpack.
    """
    def hashed(files: DataFrame) -> DataFrame:
        return files.select("path", F.col("length").alias("size_bytes"), F.sha2(F.col("content"), 256).alias("sha256"))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    large = files.where(F.col("length") > whole_bytes).select("path", "length")
    names = large.withColumn("packed", F.col("path").rlike(chained.COMPRESSED)).collect()  # of large files, no content
    if not names:
        return hashed(files)
    out = hashed(files.where(F.col("length") <= whole_bytes))  # by this condition alone the reader skips content
    packed = [chained.literal(r.path) for r in names if r.packed]
    if packed:
        out = out.union(hashed(spark.read.format("binaryFile").load(packed)))
    apart = [(r.path, r.length) for r in names if not r.packed]
    if apart:
        rows = [(*file, digest) for file, digest in zip(apart, chained.digests(spark, apart))]
        out = out.union(spark.createDataFrame(rows, out.schema))
    return out
