"""Reading usage logs: guarded paths, aliases, identifiers as text, times of any unit."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.operators.release import LeakError

#: Column names that are read under another one, and identifier columns (fixed values).
ALIASES = {"enb_id": "enb"}
IDENTIFIERS = ("msisdn", "imsi", "imei", "enb")
DEVICE_DIGITS = 8
#: Upper bounds of epoch values in seconds, milliseconds and microseconds.
UNITS = ((1e11, "seconds"), (1e14, "millis"), (1e17, "micros"))


def guarded(path: str, root: str) -> str:
    """`path` resolved, or LeakError if it lies outside `root`."""
    resolved, top = Path(path).resolve(), Path(root).resolve()
    if top != resolved and top not in resolved.parents:
        raise LeakError("the path is outside the secure folder")
    return str(resolved)


def rename_aliases(df: DataFrame, aliases: dict[str, str] = ALIASES) -> DataFrame:
    return df.withColumnsRenamed({a: b for a, b in aliases.items() if a in df.columns and b not in df.columns})


def text_identifiers(df: DataFrame, columns: tuple[str, ...] = IDENTIFIERS) -> DataFrame:
    """Identifiers as trimmed text."""
    return df.withColumns({c: F.trim(F.col(c).cast("string")) for c in columns if c in df.columns})


def epoch_unit(df: DataFrame, column: str) -> str:
    """The unit of an epoch column, by its largest magnitude (one small action)."""
    most = df.agg(F.max(F.abs(F.col(column).cast("double"))).alias("m")).first()["m"] or 0.0
    return next((unit for bound, unit in UNITS if most < bound), "nanos")


def parse_time(df: DataFrame, column: str = "time_start") -> DataFrame:
    """The column as a timestamp. Numbers are epochs of a unit found from the data; text
    is parsed; what cannot be read becomes null."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return df.withColumn(column, F.col(column).cast("timestamp"))
    if isinstance(kind, T.NumericType):
        value = F.col(column).cast("long")
        made = {"seconds": F.timestamp_seconds(value), "millis": F.timestamp_millis(value), "micros": F.timestamp_micros(value), "nanos": F.timestamp_micros(F.floor(value / 1000))}
        return df.withColumn(column, made[epoch_unit(df, column)])
    return df.withColumn(column, F.try_to_timestamp(F.col(column)))


def add_device_model(df: DataFrame, device: str = "imei", name: str = "tac") -> DataFrame:
    return df.withColumn(name, F.substring(F.col(device), 1, DEVICE_DIGITS))


def normalise(df: DataFrame) -> DataFrame:
    df = text_identifiers(rename_aliases(df))
    return parse_time(df) if "time_start" in df.columns else df


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return normalise(reader.parquet(path))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Identifier columns are read as text, so leading zeros stay. Without a schema every
    column is text at first, and metrics are cast by name."""
    reader = spark.read.option("header", True)
    if schema:
        return normalise(reader.schema(schema).csv(path))
    df = reader.csv(path)
    metrics = [c for c in df.columns if c not in (*IDENTIFIERS, *ALIASES) and c not in ("province", "radio_access_type", "application_category", "time_start")]
    df = df.withColumns({c: F.expr(f"try_cast(`{c}` AS double)") for c in metrics})
    if "time_start" in df.columns and df.where(F.col("time_start").isNotNull() & F.expr("try_cast(time_start AS bigint) IS NULL")).isEmpty():
        df = df.withColumn("time_start", F.col("time_start").cast("long"))
    return normalise(df)


def read_release(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_json(path: str) -> dict | None:
    """A report, or None where there is none."""
    file = Path(path)
    return json.loads(file.read_text()) if file.exists() else None


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def read_config(path: str | None, kind: type, defaults: dict | None = None):
    """A configuration dataclass from a YAML or JSON file, defaults where absent."""
    values = dict(defaults or {})
    if path and Path(path).exists():
        text = Path(path).read_text()
        try:
            import yaml

            values |= yaml.safe_load(text) or {}
        except ImportError:
            values |= json.loads(text)
    names = set(kind.__dataclass_fields__)
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items() if k in names})
