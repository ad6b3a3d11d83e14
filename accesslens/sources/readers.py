"""Readers with explicit schemas, and column checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accesslens import schemas


#: The raw line of a row with a value that its type cannot hold.
RAW = "_raw_line"
CSV_OPTIONS = {"header": True, "enforceSchema": False, "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]", "multiLine": False, "escape": '"'}


def header_schema(spark: SparkSession, path: str, schema: T.StructType) -> T.StructType:
    """The columns of the files' header, with the types of ``schema`` where it knows them."""
    header = spark.read.csv(path, header=True).columns
    return T.StructType([schema[name] if name in schema.names else T.StructField(name, T.StringType()) for name in header])


def read_csv(spark: SparkSession, path: str, schema: T.StructType, optional: tuple[str, ...] = ()) -> DataFrame:
    """CSV with a header; columns are matched to ``schema`` by name in any order, blanks read as null.

    Columns that ``schema`` does not know are not read. A missing column is an
    error, or null if it is ``optional``; every file must have the same header.
    A value that its type cannot hold ends the read with an error; see ``quarantined``.
    """
    rows = spark.read.schema(header_schema(spark, path, schema)).csv(path, mode="FAILFAST", **CSV_OPTIONS)
    return matched(rows, schema, optional, path)


def quarantined(spark: SparkSession, path: str, schema: T.StructType, optional: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """CSV rows that can be read, and those that cannot: their file, line, bad columns and all values as text.

    Both are plain scans of the files; no row is lost and none is nulled in silence.
    """
    found = header_schema(spark, path, schema)
    marked = T.StructType([*found.fields, T.StructField(RAW, T.StringType())])
    rows = spark.read.schema(marked).csv(path, mode="PERMISSIVE", columnNameOfCorruptRecord=RAW, **CSV_OPTIONS)
    # Spark parses only the columns that a plan needs; a condition on all of them, always true, has every value looked at.
    rows = rows.filter(F.hash(*found.names) >= -(2**31))
    good = matched(rows.filter(F.col(RAW).isNull()), schema, optional, path)
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in found.fields])
    line = F.from_csv(F.col(RAW), texts.toDDL(), {"escape": '"'})
    bad = rows.filter(F.col(RAW).isNotNull()).select(F.input_file_name().alias("file"), F.col(RAW).alias("line"), line.alias("values"), F.struct(*found.names).alias("_typed"))
    # A column is bad where a value stands in the line that did not become one; none is where the line has too few or too many values.
    columns = F.array(*[F.when(F.col(f"values.{n}").isNotNull() & F.col(f"_typed.{n}").isNull(), F.lit(n)) for n in found.names if n in schema.names])
    return good, bad.select("file", "line", F.array_compact(columns).alias("bad_columns"), "values")


def matched(rows: DataFrame, schema: T.StructType, optional: tuple[str, ...] = (), what: str = "table") -> DataFrame:
    """``rows`` with the columns of ``schema``, matched by name; raises for missing ones that are not ``optional``."""
    require_columns(rows, tuple(name for name in schema.names if name not in optional), what)
    return rows.select(
        *[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
    )


def read_table(spark: SparkSession, path: str, schema: T.StructType, optional: tuple[str, ...] = ()) -> DataFrame:
    """Parquet if the path ends in .parquet, else CSV; columns by name."""
    if path.rstrip("/").endswith(".parquet"):
        return matched(spark.read.parquet(path), schema, optional, path)
    return read_csv(spark, path, schema, optional)


def scan_events(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.event_schema(), schemas.OPTIONAL_EVENT_COLUMNS)


def scan_events_quarantined(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The events of CSV files, and the lines with a duration, timestamp or shape that cannot be read."""
    return quarantined(spark, path, schemas.event_schema(), schemas.OPTIONAL_EVENT_COLUMNS)


def scan_entities(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.entity_schema())


def scan_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.ground_truth_schema())


def scan_alert_documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Exported alert documents: JSON lines, or files that hold one JSON array each."""
    start = spark.read.text(path).filter(F.trim("value") != "").select(F.substring(F.trim("value"), 1, 1).alias("c")).first()
    return spark.read.schema(schema).json(path, multiLine=bool(start and start.c == "["))


def require_columns(df: DataFrame, required: tuple[str, ...], what: str = "table") -> DataFrame:
    missing = [name for name in required if name not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks required columns: {missing}")
    return df


def add_optional_columns(df: DataFrame, optional: tuple[str, ...] = schemas.OPTIONAL_EVENT_COLUMNS) -> DataFrame:
    return df.select("*", *[F.lit(None).cast("string").alias(name) for name in optional if name not in df.columns])
