"""Readers and sinks: tables, document folders, postal reference data and evaluation records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of the postal reference data, in the order of its tab-separated form.
POSTAL_COLUMNS = ("kode_pos", "address", "locality", "sifat_pos", "city_code", "city_name", "province_code", "province_name", "district_code", "district_name")
#: File names of documents.
IMAGE_GLOB = "*.{jpg,jpeg,png,bmp,webp,JPG,JPEG,PNG,BMP,WEBP}"
IMAGE_OR_PDF_GLOB = "*.{jpg,jpeg,png,bmp,webp,pdf,JPG,JPEG,PNG,BMP,WEBP,PDF}"

_ATTEMPT = "index INT, max_side INT, strategy STRING, document_type STRING, detected_document_type STRING, decision STRING, warnings ARRAY<STRING>"
_TIMING = "prepare_ms DOUBLE, ocr_ms DOUBLE, parse_ms DOUBLE, quality_ms DOUBLE, assessment_ms DOUBLE, total_ms DOUBLE"

#: Schema of one evaluation record, a line of JSON.
RECORD_SCHEMA = f"""
file STRING, status STRING, document_type STRING, needs_review BOOLEAN, processing_time_ms DOUBLE,
stnk_structure_score DOUBLE, stnk_usage_class STRING, stnk_usage_reasons ARRAY<STRING>, warnings ARRAY<STRING>, error STRING,
input_assessment STRUCT<decision STRING, can_auto_publish BOOLEAN, expected_document_type STRING, detected_document_type STRING, reason_codes ARRAY<STRING>, message STRING>,
fields MAP<STRING, STRUCT<value STRING, confidence DOUBLE, status STRING, evidence ARRAY<STRING>, raw STRING, metadata MAP<STRING,STRING>>>,
quality STRUCT<image STRUCT<width INT, height INT>, flags ARRAY<STRING>, metrics STRUCT<ocr_token_count INT, text_density DOUBLE, blur_score DOUBLE, overall_score DOUBLE, pre_ocr BOOLEAN>>,
ocr STRUCT<provider STRING, token_count INT, processing_mode STRING, raw_text_masked STRING,
  nik_fallback STRUCT<attempted BOOLEAN, passes INT, value STRING>,
  preprocess STRUCT<selected_max_side INT, retry_count INT, attempts ARRAY<STRUCT<{_ATTEMPT}>>>,
  timings STRUCT<total_ms DOUBLE, preflight_ms DOUBLE, selected_attempt_index INT, nik_fallback_ms DOUBLE, attempts ARRAY<STRUCT<{_TIMING}>>>>
"""


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table; timestamps without a zone become timestamps, which watermarks need."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in df.schema if isinstance(f.dataType, T.TimestampNTZType)})


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to as many partitions as there are cores, where a small table has fewer: for work that costs far more than a read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def scan_files(spark: SparkSession, path: str, recursive: bool = False, include_pdf: bool = False, limit: int = 0, seed: int | None = None) -> DataFrame:
    """Files of a folder in path order, or in a seeded order; limit 0 takes all.

    The order is this library's own: a hash of path and seed.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", IMAGE_OR_PDF_GLOB if include_pdf else IMAGE_GLOB).option("recursiveFileLookup", str(recursive).lower()).load(path)
    ordered = files.orderBy("path") if seed is None else files.orderBy(F.xxhash64("path", F.lit(seed)), "path")
    return ordered.limit(limit) if limit else ordered


def read_postal_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Postal reference rows; empty cells are empty strings."""
    raw = spark.read.csv(path, sep="\t", header=True, schema=", ".join(f"{c} STRING" for c in POSTAL_COLUMNS), quote="")
    return raw.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in POSTAL_COLUMNS))


def write_postal_tsv(postal: DataFrame, path: str) -> None:
    """Localities only, as tab-separated text with a header."""
    kept = postal.where(F.lower(F.trim("sifat_pos")).startswith("kel"))
    kept.select(*POSTAL_COLUMNS).write.mode("overwrite").csv(path, sep="\t", header=True, emptyValue="", quote="")


def postal_star(postal: DataFrame, cities: DataFrame, provinces: DataFrame, districts: DataFrame) -> DataFrame:
    """Join the four reference sheets.

    postal(kode_pos, address, city_code, district_code, sifat_pos), cities(city_code,
    city_name, province_code), provinces(province_code, province_name),
    districts(district_code, district_name).  Codes that are not five digits and
    rows of unknown cities go; a missing province or district leaves "".
    """
    code = F.when(F.col("district_code") != "0", F.col("district_code"))
    rows = postal.where(F.col("kode_pos").rlike(r"^\d{5}$")).withColumn("district_code", code)
    joined = rows.join(cities, "city_code").join(provinces, "province_code", "left").join(districts, "district_code", "left")
    locality = F.when(F.lower(F.trim("sifat_pos")).startswith("kel"), F.trim(F.substring_index("address", ",", 1))).otherwise("")
    return joined.withColumn("locality", locality).select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in POSTAL_COLUMNS))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation records, one JSON object a line."""
    return spark.read.schema(RECORD_SCHEMA).json(path)


def write_records(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").json(path)


def summary_json(summary: DataFrame) -> Column:
    """The whole summary as one JSON object."""
    return F.to_json(F.struct(*summary.columns))
