"""Document selection, cost, batching and aggregation around an external scoring service."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.parsing import document_pieces, text_records
from rankloom.operators import ordering

MAX_DOCUMENTS_PER_REQUEST = 10
FREE_TIER_RECORDS = 5_000


def select_documents(
    documents: DataFrame,
    items: DataFrame,
    key: str,
    text: str,
    order: Sequence[Column],
    per_item: int,
) -> DataFrame:
    """The latest ``per_item`` non-null documents of every item in ``items``, in pieces numbered by ``piece``."""
    wanted = documents.filter(F.col(text).isNotNull()).join(
        items.select(key).distinct(), key, "left_semi"
    )
    latest = ordering.top_k(wanted, [key], order, per_item, "_latest").drop("_latest")
    kept = [c for c in latest.columns if c != text]
    return latest.select(*kept, F.posexplode(document_pieces(F.col(text))).alias("piece", text))


def records_needed(documents: DataFrame, text: str, by: Sequence[str] = ()) -> DataFrame:
    """Documents and billable records, the number to check before calling the service."""
    sums = [F.count(F.lit(1)).alias("documents"), F.sum(text_records(F.col(text))).alias("records")]
    return documents.groupBy(*by).agg(*sums) if by else documents.agg(*sums)


def request_batches(
    documents: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    size: int = MAX_DOCUMENTS_PER_REQUEST,
    name: str = "batch_id",
    hot_rows: int | None = None,
) -> DataFrame:
    """Number the request each document travels in, per language."""
    if size < 1:
        raise ValueError(f"size={size}: a batch needs at least one document")
    placed = ordering.running_total(documents, by, order, before=name, hot_rows=hot_rows)
    return placed.withColumn(name, F.floor(F.col(name) / size) + 1)


def aggregate_sentiment(
    responses: DataFrame,
    key: Sequence[str],
    positive: str = "positive",
    negative: str = "negative",
    sentiment: str = "sentiment",
) -> DataFrame:
    """Per item: documents scored, mean positive minus mean negative, share labelled positive."""
    is_positive = (F.col(sentiment) == "positive").cast("double")
    return responses.groupBy(*key).agg(
        F.count(F.lit(1)).alias("reviews_scored"),
        (F.avg(positive) - F.avg(negative)).alias("sentiment_score"),
        F.avg(F.coalesce(is_positive, F.lit(0.0))).alias("positive_share"),
        F.avg(positive).alias("mean_positive"),
        F.avg(negative).alias("mean_negative"),
    )
