"""Sources and sinks: the four CSV tables, Parquet, JSON documents, fingerprints."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import TABLES


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means missing here; Spark would rank it above all numbers and let it poison means."""
    kinds = {f.name: f.dataType for f in df.schema}
    return df.select(*[F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) if isinstance(t, (T.DoubleType, T.FloatType)) else F.col(c) for c, t in kinds.items()])


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Columns by the header's names in the header's order; columns that schema doesn't name are strings, those the file lacks are left out."""
    header = spark.read.option("header", True).csv(path).columns
    known = {f.name: f for f in schema}
    own = T.StructType([known.get(c, T.StructField(c, T.StringType())) for c in header])
    return nan_to_null(spark.read.schema(own).option("header", True).option("nullValue", "").csv(path))


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def load_raw_tables(spark: SparkSession, data_dir: str, schemas: dict[str, T.StructType] = TABLES) -> dict[str, DataFrame]:
    """Every table of schemas from data_dir; FileNotFoundError names the first that isn't there."""
    for name in schemas:
        if not exists(spark, f"{data_dir}/{name}.csv"):
            raise FileNotFoundError(f"{data_dir}/{name}.csv")
    return {name: read_csv(spark, f"{data_dir}/{name}.csv", schema) for name, schema in schemas.items()}


def save_raw_tables(tables: dict[str, DataFrame], data_dir: str) -> dict[str, str]:
    return {name: write_csv(df, f"{data_dir}/{name}.csv") for name, df in tables.items()}


def write_csv(df: DataFrame, path: str) -> str:
    """A folder of CSV parts with headers, written by the executors."""
    df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)
    return path


def write_text(text: str, path: str, spark: SparkSession | None = None) -> str:
    """One small file, in UTF-8, on whatever store the path names; without a session, on this machine's."""
    if spark is None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(text, encoding="utf-8")
        return path
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return path


def write_json(payload: dict, path: str, spark: SparkSession | None = None) -> str:
    """UTF-8, two spaces, keys as they come, newline at the end."""
    return write_text(json.dumps(payload, ensure_ascii=False, indent=2, default=str) + "\n", path, spark)


def read_json(spark: SparkSession, path: str) -> dict | None:
    """What write_json wrote; None if there is no such file."""
    if not exists(spark, path):
        return None
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def fingerprint(df: DataFrame) -> str:
    """64 hex digits that change with any cell and with the number of equal rows, but not with the rows' order."""
    parts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for c in df.columns]
    row = F.xxhash64(*parts) if parts else F.lit(0).cast("long")
    got = df.agg(F.count(F.lit(1)).alias("n"), F.sum(row.cast("decimal(38,0)")).alias("s"), F.bit_xor(row).alias("x"))
    return got.select(F.sha2(F.concat_ws("|", F.lit(",".join(df.columns)), "n", F.coalesce(F.col("s").cast("string"), F.lit("")), F.coalesce(F.col("x").cast("string"), F.lit(""))), 256).alias("f")).first()["f"]
