"""Readers of raw files."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str, where: str | None = None) -> DataFrame:
    """CSV with a header; columns are picked by name, unreadable numbers become null, `where` filters at the scan."""
    df = spark.read.option("header", "true").option("mode", "PERMISSIVE").csv(path)
    cols = [c.strip().split() for c in schema.split(",")]
    out = df.select(*[F.expr(f"try_cast(`{n}` as {t})").alias(n) for n, t in cols])
    return out.where(where) if where else out


def write_by_year(df: DataFrame, date: str, folder: str) -> str:
    """Parquet in one folder per year; rows of a year meet before they are written, split over several tasks if there are many."""
    df.withColumn("year", F.year(date)).repartition("year", F.pmod(F.xxhash64(date), F.lit(8))).write.mode("overwrite").partitionBy("year").parquet(folder)
    return folder


def read_glob(spark: SparkSession, pattern: str, base: str | None = None) -> DataFrame:
    """All parquet files of a pattern as one table, put together by column name; base is the folder above any partition folders."""
    r = spark.read.option("mergeSchema", "true")
    return (r.option("basePath", base) if base else r).parquet(pattern)


def read_nested_zip(spark: SparkSession, path: str, columns: list[str], rows: int = 50_000) -> DataFrame:
    """Rows of the first CSV in each zip, also where that zip lies in another; all columns as strings.

    A zip can't be split, so one file is one task; its rows stream out in pieces of `rows`.
    """

    def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for raw in pdf["content"]:
                f = io.BytesIO(raw)
                while True:
                    z = zipfile.ZipFile(f)
                    name = next((n for n in z.namelist() if n.lower().endswith((".csv", ".zip"))), None)
                    if name is None:
                        break
                    f = z.open(name)
                    if name.lower().endswith(".zip"):
                        f = io.BytesIO(f.read())
                        continue
                    part = []
                    for r in csv.DictReader(io.TextIOWrapper(f, "utf-8", errors="replace")):
                        part.append([r.get(c) for c in columns])
                        if len(part) >= rows:
                            yield pd.DataFrame(part, columns=columns)
                            part = []
                    if part:
                        yield pd.DataFrame(part, columns=columns)
                    break

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(unzip, ", ".join(f"`{c}` string" for c in columns))


def read_factor_text(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """(date, names...) of a text whose monthly lines begin with six digits; per cent to decimals, other lines skipped."""
    t = spark.read.text(path).where(F.trim(F.split("value", ",")[0]).rlike("^[0-9]{6}$"))
    f = F.split("value", ",")
    day = F.last_day(F.to_date(F.concat(F.trim(f[0]), F.lit("01")), "yyyyMMdd"))
    return t.select(day.alias("date"), *[(F.expr(f"try_cast(trim(split(value, ',')[{i + 1}]) as double)") / 100).alias(n) for i, n in enumerate(names)])


def read_code_ranges(spark: SparkSession, path: str, expect: int | None = None) -> DataFrame:
    """(sic_low, sic_high, industry) from a text of numbered heads, each followed by code ranges; order kept in `line`.

    Raises ValueError if `expect` industries are not found.
    """
    t = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line", "v"))
    head = F.regexp_extract("v", r"^\s*(\d+)\s+([A-Za-z0-9]+)\s+", 1)
    is_span = F.col("v").rlike(r"^\s*\d{4}-\d{4}\s")
    name = F.when(~is_span & (head != ""), F.concat(F.lpad(head.cast("int").cast("string"), 2, "0"), F.lit("_"), F.regexp_extract("v", r"^\s*(\d+)\s+([A-Za-z0-9]+)\s+", 2)))
    d = t.select("line", "v", is_span.alias("s"), name.alias("n"))
    w = W.orderBy("line").rowsBetween(W.unboundedPreceding, 0)  # one small file
    d = d.withColumn("industry", F.last("n", ignorenulls=True).over(w)).where("s and industry is not null")
    out = d.select(F.regexp_extract("v", r"(\d{4})-(\d{4})", 1).cast("int").alias("sic_low"), F.regexp_extract("v", r"(\d{4})-(\d{4})", 2).cast("int").alias("sic_high"), "industry", "line")
    if expect is not None and out.select("industry").distinct().count() != expect:
        raise ValueError(f"{path}: not {expect} industries")
    return out
