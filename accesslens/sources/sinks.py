"""Writers: one place for formats, array flattening and run partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accesslens.functions.text import LIST_JOINER


def flat(df: DataFrame) -> DataFrame:
    """Join string arrays to text, for formats that hold scalars only."""
    return df.select(
        *[
            F.array_join(f.name, LIST_JOINER).alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def sink_csv(df: DataFrame, path: str) -> str:
    flat(df).write.mode("overwrite").csv(
        path, header=True, timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", escape='"', emptyValue=""
    )
    return path


def sink_parquet(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").parquet(path)
    return path


def sink_json(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").json(path, ignoreNullFields=False)
    return path


def sink_both(df: DataFrame, path: str) -> tuple[str, str]:
    """Parquet first, then CSV from the written copy, so that the work behind ``df`` runs once."""
    parquet = sink_parquet(df, path + ".parquet")
    stored = df.sparkSession.read.schema(df.schema).parquet(parquet)
    return sink_csv(stored, path + ".csv"), parquet


def sink_run_partition(df: DataFrame, path: str, run_id: str) -> str:
    """Append a run under its own ``run_id=...`` directory."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)
    return path
