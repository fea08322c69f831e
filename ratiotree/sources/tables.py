"""Scans and sinks for flat tables, settings and results."""

from __future__ import annotations

import csv
import json
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: StructType | str, header: bool = True, sep: str = ",") -> DataFrame:
    """A CSV table with a stated schema; a value that does not fit it stops the read."""
    return spark.read.csv(path, schema=schema, header=header, sep=sep, mode="FAILFAST", enforceSchema=False)


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict[str, str] | None = None, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8) -> DataFrame:
    """A database table; with a numeric ``key`` and its ``bounds``, read by so many tasks."""
    if key and bounds:
        return spark.read.jdbc(url, table, column=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts, properties=properties or {})
    return spark.read.jdbc(url, table, properties=properties or {})


def typed(df: DataFrame, share: float = 1.0) -> DataFrame:
    """String columns as doubles where at least ``share`` of all non-empty values are numbers, counted over the whole table in one pass.

    With a share of 1 no value is lost; with less, those that are no numbers become null, which is what the caller asked for.
    """
    names = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    if not names:
        return df
    counts = [F.count(F.expr(f"nullif(trim(`{n}`), '')")).alias(f"all_{i}") for i, n in enumerate(names)]
    counts += [F.count(F.expr(f"try_cast(trim(`{n}`) as double)")).alias(f"num_{i}") for i, n in enumerate(names)]
    row = df.agg(*counts).first()
    numeric = [n for i, n in enumerate(names) if row[f"all_{i}"] and row[f"num_{i}"] >= share * row[f"all_{i}"]]
    return df.withColumns({n: F.expr(f"try_cast(trim(`{n}`) as double)") for n in numeric})


def read_settings(path: str) -> dict[str, str]:
    """Settings from a file with a row of names and a row of values, with or without a byte order mark."""
    with open(path, encoding="utf-8-sig", newline="") as file:
        names, values, *_ = csv.reader(file)
    return {n.strip(): v.strip() for n, v in zip(names, values, strict=True) if n.strip()}


def write_rows(df: DataFrame, path: str, header: bool = False) -> None:
    """Scored rows as CSV parts, one for each partition."""
    df.write.mode("overwrite").csv(path, header=header)


def write_report(report: dict[str, DataFrame], folder: str) -> None:
    """A report's tables, a parquet table each."""
    for name, df in report.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def write_prepared(prepared, folder: str) -> None:  # noqa: ANN001
    """A prepared table: its rows, its levels, and its description."""
    prepared.rows.write.mode("overwrite").parquet(f"{folder}/rows")
    prepared.levels.write.mode("overwrite").parquet(f"{folder}/levels")
    spark = prepared.rows.sparkSession
    spark.createDataFrame([(json.dumps({"numeric": prepared.numeric, "categorical": prepared.categorical}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/about")


def read_prepared(spark: SparkSession, folder: str):  # noqa: ANN201
    from ..operators.prepare import Prepared

    about = json.loads(spark.read.text(f"{folder}/about").first()[0])
    return Prepared(spark.read.parquet(f"{folder}/rows"), spark.read.parquet(f"{folder}/levels"), about["numeric"], about["categorical"])


def unzip_files(archive: str, folder: str) -> list[str]:
    """The files of an archive, unpacked into a folder; a name that leads out of it is refused."""
    root = Path(folder).resolve()
    with zipfile.ZipFile(archive) as found:
        for name in found.namelist():
            if not (root / name).resolve().is_relative_to(root):
                raise ValueError(f"not inside the archive's folder: {name}")
        found.extractall(root)
        return [str(root / n) for n in found.namelist()]


def zip_files(files: list[str], target: str) -> str:
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in files:
            archive.write(file, Path(file).name)
    return target
