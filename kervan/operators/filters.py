"""Filters, lookups and candidate predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kervan.functions.text import fold_ascii, strip


def where_equal(df: DataFrame, **terms) -> DataFrame:
    """Conjunction of the equality terms that are given; a term of None doesn't filter."""
    for name, value in terms.items():
        if value is not None:
            df = df.filter(F.col(name) == F.lit(value))
    return df


def lookup_by_name(df: DataFrame, name: str, name_col: str, id_col: str) -> DataFrame:
    """The row with the lowest id whose name equals the stripped argument, A-Z case ignored; empty if there is none."""
    return df.filter(fold_ascii(F.col(name_col)) == fold_ascii(strip(F.lit(name)))).orderBy(id_col).limit(1)


def current_model(model: Column, current: str) -> Column:
    """Vectors whose model is unknown (null or '') or the current one; others are stale."""
    return F.coalesce(model, F.lit("")).isin("", current)


def is_stale(embedding: Column, model: Column, current: str) -> Column:
    return embedding.isNotNull() & ~current_model(model, current)


def require(df: DataFrame, condition: Column, message: str, carrier: str) -> DataFrame:
    """df, failing at run time on the first row that breaks the condition; carrier is any column of df."""
    kind = df.schema[carrier].dataType
    checked = F.when(F.coalesce(condition, F.lit(False)), F.col(carrier)).otherwise(F.raise_error(F.lit(message)).cast(kind))
    return df.withColumn(carrier, checked)


def quarantine(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that meet the condition, rows that don't or can't tell)."""
    ok = F.coalesce(condition, F.lit(False))
    return df.filter(ok), df.filter(~ok)


def check_limits(top_k: int, min_score: float) -> None:
    if isinstance(top_k, bool) or not isinstance(top_k, int) or top_k < 1:
        raise ValueError("top_k must be a positive integer")
    if not (-1.0 <= min_score <= 1.0):
        raise ValueError("min_score must lie in [-1, 1]")


def check_arguments(query: str, top_k: int, min_score: float) -> None:
    """The same for one question given as a text."""
    if not isinstance(query, str) or not query.strip():
        raise ValueError("query must be a non-blank text")
    check_limits(top_k, min_score)


def ordered_chunks(chunks: DataFrame, medicines: DataFrame, medicine_id: int | None = None, chunk_type: str | None = None) -> DataFrame:
    """The chunks of existing records with the record's name and source, by chunk_id, optionally of one record or category.

    Filters are on the chunks' side, so they reach its scan; the sort is by range, each task its own.
    """
    shown = medicines.select("medicine_id", "medicine_name", "source_name", "source_reference")
    rows = where_equal(chunks, medicine_id=medicine_id, chunk_type=chunk_type).join(shown, "medicine_id")
    return rows.select("chunk_id", "medicine_id", "chunk_text", "chunk_type", "embedding", "embedding_model", "medicine_name", "source_name", "source_reference").orderBy("chunk_id")
