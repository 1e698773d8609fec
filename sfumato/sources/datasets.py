"""Readers of public series files that the user has on disk or in a store; nothing is downloaded."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Dataset:
    file: str
    sep: str
    field: str | None
    time: str | None = None
    time_format: str | None = None


#: File layouts.  Fixed values: file name, separator, default field, time column and its format.
DATASETS = {
    "air_passengers": Dataset("AirPassengers.csv", ",", "Passengers", "Month", "yyyy-MM"),
    "bitcoin": Dataset("BTCUSD.csv", ",", "AVG", "Date", "yyyy-MM-dd"),
    "dow_jones": Dataset("DowJones.csv", ",", "AVG", "Date", "yyyy-MM-dd"),
    "enrollments": Dataset("Enrollments.csv", ";", "Enrollments", "Year", "yyyy"),
    "ethereum": Dataset("ETHUSD.csv", ",", "AVG", "Date", "yyyy-MM-dd"),
    "eurgbp": Dataset("EURGBP.csv", ",", "avg", "Date", "yyyy-MM-dd"),
    "eurusd": Dataset("EURUSD.csv", ",", "avg", "Date", "yyyy-MM-dd"),
    "gbpusd": Dataset("GBPUSD.csv", ",", "avg", "Date", "yyyy-MM-dd"),
    "inmet": Dataset("INMET.csv.bz2", ";", None, "DataHora", "dd/MM/yyyy HH:mm"),
    "malaysia": Dataset("malaysia.csv", ";", "load", "time", "MM/dd/yy hh:mm a"),
    "nasdaq": Dataset("NASDAQ.csv.bz2", ",", "avg", "Date", "yyyy-MM-dd"),
    "sonda": Dataset("SONDA_BSB.csv.bz2", ";", None, "datahora", "yyyy-MM-dd HH:mm:ss"),
    "sp500": Dataset("SP500.csv.bz2", ",", "Avg", "Date", "yyyy-MM-dd"),
    "sunspots": Dataset("sunspots.csv", ",", "SUNACTIVITY", "YEAR", None),
    "taiex": Dataset("TAIEX.csv.bz2", ",", "avg", "Date", "yyyy-MM-dd"),
}


def frame(spark: SparkSession, name: str, folder: str) -> DataFrame:
    """All columns of a dataset, numbers as double and the time column parsed; bzip2 files are read as they are.

    Column names come from the header and types from the layout, so there is no pass to infer them.
    """
    d = DATASETS[name]
    raw = spark.read.csv(f"{folder}/{d.file}", sep=d.sep, header=True)
    cols = []
    for c in raw.columns:
        if c == d.time:
            cols.append((F.try_to_timestamp(F.col(f"`{c}`"), F.lit(d.time_format)) if d.time_format else F.col(f"`{c}`")).alias(c))
        else:
            number = F.col(f"`{c}`").try_cast("double")
            cols.append((number if c == d.field else F.col(f"`{c}`")).alias(c))
    return raw.select(*cols)


def series(spark: SparkSession, name: str, folder: str, field: str | None = None) -> DataFrame:
    """(ts, x) of one field, its default if there is one."""
    d = DATASETS[name]
    field = field or d.field
    if field is None:
        raise ValueError(f"{name} has no default field")
    df = frame(spark, name, folder)
    return df.select(F.col(d.time).alias("ts"), F.col(f"`{field}`").try_cast("double").alias("x"))
