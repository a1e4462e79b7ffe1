"""JSON record sources: recursive discovery, byte-order-mark tolerant parsing, validation, normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kervan.functions.text import optional_text
from kervan.functions.udfs import parse_document_udf
from kervan.schema import MEDICINE_FIELDS, SECTION_FIELDS, SECTIONS


def read_json_files(spark: SparkSession, directory: str) -> DataFrame:
    """Every *.json below directory as (file_path, record_no, record_json), one row per file.

    Names that start with "_" or "." are skipped, as every file source of Spark does.
    """
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(directory, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("file_path"), F.lit(0).alias("record_no"), F.col("value").alias("record_json"))


def path_order(path: Column) -> Column:
    """Sort key of a path: by component, not by character."""
    return F.split(path, "/")


def parse(raw: DataFrame) -> DataFrame:
    """raw (.., record_json) plus `error` (null where fine) and `records`.

    Null, empty or broken JSON and arrays that hold anything but objects become rows with an error.
    """
    return raw.withColumn("_p", parse_document_udf("record_json")).withColumns({"records": F.col("_p.records"), "error": F.col("_p.error")}).drop("_p")


def bad_documents(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("error").isNotNull()).drop("records")


def records(parsed: DataFrame, *, strict: bool = False) -> DataFrame:
    """One row per record with `rec` and its place in the document (`pos`); example records are kept.

    strict raises on the first bad document, naming its file; otherwise bad documents are left out (see bad_documents).
    """
    rows = parsed
    if strict:
        message = F.concat(F.lit("invalid JSON document: "), F.coalesce("file_path", F.lit("?")), F.lit(": "), F.col("error"))
        rows = rows.withColumn("records", F.when(F.col("error").isNotNull(), F.raise_error(message).cast(rows.schema["records"].dataType)).otherwise(F.col("records")))
    else:
        rows = rows.filter(F.col("error").isNull())
    keep = [c for c in rows.columns if c not in ("records", "error", "record_json")]
    return rows.select(*keep, F.posexplode("records").alias("pos", "rec"))


def without_examples(rows: DataFrame) -> DataFrame:
    """Drop records whose is_example is the boolean true; 1, "true" and the like don't count."""
    return rows.filter(~F.col("rec.is_example"))


def normalised(rows: DataFrame) -> DataFrame:
    """Table fields from `rec`: first filled alias wins, explicit source fields win over the source object."""

    def first(*keys: str) -> Column:
        return F.coalesce(*[F.nullif(F.col(f"rec.{k}"), F.lit("")) for k in keys])

    fields = {"medicine_name": F.nullif(F.col("rec.medicine_name"), F.lit(""))}
    fields |= {f: first(*[k for k, field, _ in SECTIONS if field == f]) for f in SECTION_FIELDS}
    fields["source_name"] = first("source_name", "source_object_name")
    fields["source_reference"] = first("source_reference", "source_object_reference")
    return rows.withColumns({f: fields[f] for f in MEDICINE_FIELDS})


def named(rows: DataFrame, *, strict: bool = False) -> DataFrame:
    """Rows with a medicine name; strict raises on the first one without."""
    if strict:
        return rows.withColumn("medicine_name", F.coalesce("medicine_name", F.raise_error(F.lit("medicine_name is required")).cast("string")))
    return rows.filter(F.col("medicine_name").isNotNull())


def section_values(rows: DataFrame) -> Column:
    """Array of (ordinal, chunk_type, text) of the filled sections of `rec`, in input-key order, one per table field."""
    out = []
    for i, (key, field, kind) in enumerate(SECTIONS):
        earlier = [k for k, f, _ in SECTIONS[:i] if f == field]
        shown = F.col(f"rec.{key}") != ""
        for k in earlier:
            shown = shown & (F.col(f"rec.{k}") == "")
        out.append(F.when(shown, F.struct(F.lit(i).alias("ordinal"), F.lit(kind).alias("chunk_type"), F.col(f"rec.{key}").alias("text"))))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def validate_form(values: dict) -> dict:
    """One form's values: only the medicine fields, strings only, blanks as None, a name required."""
    unknown = sorted(set(values) - set(MEDICINE_FIELDS))
    if unknown:
        raise ValueError(f"unknown fields: {unknown}")
    wrong = sorted(k for k, v in values.items() if v is not None and not isinstance(v, str))
    if wrong:
        raise TypeError(f"fields must be text: {wrong}")
    clean = {f: (values.get(f) or "").strip() or None for f in MEDICINE_FIELDS}
    if clean["medicine_name"] is None:
        raise ValueError("medicine_name is required")
    return clean


def optional_fields(df: DataFrame, *names: str) -> DataFrame:
    """Blank text as null in the named columns."""
    return df.withColumns({n: optional_text(F.col(n)) for n in names})
