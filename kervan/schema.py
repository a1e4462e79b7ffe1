"""Table schemas, the section map and additive migration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Input key -> (table field, chunk category), in the order that decides precedence and chunk order.
SECTIONS = (
    ("active_ingredient", "active_ingredient", "active_ingredient"),
    ("indications", "indications", "indications"),
    ("usage_information", "usage_information", "usage"),
    ("dosage_information", "dosage_information", "dosage"),
    ("dosage", "dosage_information", "dosage"),
    ("frequency_information", "frequency_information", "frequency"),
    ("frequency", "frequency_information", "frequency"),
    ("route_of_administration", "route_of_administration", "route_of_administration"),
    ("common_side_effects", "common_side_effects", "side_effects"),
    ("serious_side_effects", "serious_side_effects", "serious_side_effects"),
    ("side_effects", "common_side_effects", "side_effects"),
    ("warnings", "warnings", "warnings"),
    ("contraindications", "contraindications", "contraindications"),
    ("interactions", "interactions", "interactions"),
)

INPUT_KEYS = tuple(key for key, _, _ in SECTIONS)
SECTION_FIELDS = tuple(dict.fromkeys(field for _, field, _ in SECTIONS))
MEDICINE_FIELDS = ("medicine_name", *SECTION_FIELDS, "source_name", "source_reference")
CHUNK_TYPES = tuple(dict.fromkeys(kind for _, _, kind in SECTIONS))

MEDICINES = T.StructType(
    [T.StructField("medicine_id", T.LongType(), False), T.StructField("medicine_name", T.StringType(), False)]
    + [T.StructField(f, T.StringType()) for f in MEDICINE_FIELDS[1:]]
)

CHUNKS = T.StructType(
    [
        T.StructField("chunk_id", T.LongType(), False),
        T.StructField("medicine_id", T.LongType(), False),
        T.StructField("chunk_text", T.StringType(), False),
        T.StructField("chunk_type", T.StringType(), False),
        T.StructField("embedding", T.ArrayType(T.DoubleType())),
        T.StructField("embedding_model", T.StringType()),
    ]
)

HIT_FIELDS = ("medicine_name", "chunk_type", "chunk_text", "similarity_score", "source_name")


def migrate(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Add the schema's missing nullable columns as nulls and put known columns in its order; extra columns stay last.

    A missing column that may not be null raises ValueError.
    """
    missing = [f for f in schema if f.name not in df.columns]
    bad = [f.name for f in missing if not f.nullable]
    if bad:
        raise ValueError(f"columns without a default are missing: {bad}")
    df = df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing}) if missing else df
    return df.select(*schema.names, *[c for c in df.columns if c not in schema.names])
