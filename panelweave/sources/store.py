"""Base tables and factor results on storage."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession

from panelweave.functions.nulls import finite

ROOT_VARIABLE = "PANELWEAVE_DATA"


def data_root(given: str | None = None) -> str:
    """The folder of the tables: as given, else from the environment, else ./data."""
    return given or os.environ.get(ROOT_VARIABLE) or "data"


def read_table(spark: SparkSession, root: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """A base table; a missing one raises FileNotFoundError that names the path."""
    path = f"{root}/{name}.parquet"
    try:
        df = spark.read.parquet(path)
    except Exception as e:
        raise FileNotFoundError(f"no table {name!r} at {path}") from e
    return df.select(*columns) if columns else df


def write_table(df: DataFrame, root: str, name: str, by: list[str] | None = None, overwrite: bool = True) -> str:
    """Parquet with zstd, by folder of the given columns; without overwrite an existing table is an error."""
    path = f"{root}/{name}.parquet"
    w = df.write.mode("overwrite" if overwrite else "errorifexists").option("compression", "zstd")
    (w.partitionBy(*by) if by else w).parquet(path)
    return path


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_bytes(spark: SparkSession, path: str, content: bytes) -> str:
    """One small file, wherever the path's file system is."""
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(content))
    out.close()
    return path


def write_text(spark: SparkSession, path: str, text: str) -> str:
    return write_bytes(spark, path, text.encode())


def factor_dir(root: str, name: str) -> str:
    """Where a factor's results lie below the data root."""
    return f"{root.rstrip('/')}/factors/{name}"


def save_factor(exposure: DataFrame, folder: str, meta: dict, tables: dict[str, DataFrame] | None = None) -> str:
    """exposure (date, asset_id, exposure) without missing values, further tables, and meta.json beside them."""
    spark = exposure.sparkSession
    exposure.select("date", "asset_id", finite("exposure").alias("exposure")).where("exposure is not null").write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/exposure.parquet")
    for name, df in (tables or {}).items():
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/{name}.parquet")
    write_text(spark, f"{folder}/meta.json", json.dumps(meta, indent=1, default=str))
    return folder


def load_factor(spark: SparkSession, folder: str, table: str = "exposure") -> tuple[DataFrame, dict]:
    rows = spark.read.text(f"{folder}/meta.json", wholetext=True).collect()
    return spark.read.parquet(f"{folder}/{table}.parquet"), json.loads(rows[0][0])
