"""Which records a question names: whole name, else its brand word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kervan.functions.udfs import match_key_udf

# Words of a name that are no brand. The accented form of the fourth pair can't meet mark-free tokens.
GENERIC_WORDS = ("ampul", "film", "flakon", "kapsul", "kapsül", "mg", "ml", "saşe", "surup", "şurup", "tablet")


def brand_word(key: Column) -> Column:
    """First word of a match key with three characters or more that is neither a number nor generic; null if none."""
    words = F.filter(F.split(key, " "), lambda w: (F.length(w) >= 3) & ~w.rlike("^\\p{Nd}+$") & ~w.isin(*GENERIC_WORDS))
    return F.get(words, F.lit(0))


def contains_words(text_key: Column, phrase_key: Column) -> Column:
    """Whether a match key holds another as a run of whole words; an empty phrase is in no text."""
    pad = F.lit(" ")
    return (phrase_key != "") & F.contains(F.concat(pad, text_key, pad), F.concat(pad, phrase_key, pad))


def named_in(queries: DataFrame, records: DataFrame, query_id: str, query_text: str, record_id: str, name: str) -> DataFrame:
    """(query_id, record_id) of every record a query names.

    Joined on a single word, as a name can only match if the query holds its brand word or, for a name without one,
    its first word; the query side is the exploded one. Blank or null names and queries match nothing.
    """
    q = queries.select(query_id, match_key_udf(query_text).alias("_q")).filter(F.col("_q") != "")
    r = records.select(record_id, match_key_udf(name).alias("_n")).filter(F.col("_n") != "")
    r = r.withColumn("_brand", brand_word(F.col("_n"))).withColumn("_word", F.coalesce("_brand", F.split("_n", " ")[0]))
    words = q.select(query_id, "_q", F.explode(F.array_distinct(F.split("_q", " "))).alias("_word"))
    hit = F.coalesce(F.col("_brand") == F.col("_word"), F.lit(False)) | contains_words(F.col("_q"), F.col("_n"))
    return words.join(r, "_word").filter(hit).select(query_id, record_id).distinct()
