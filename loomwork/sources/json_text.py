"""JSON in and out: nested responses with parallel arrays, report rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The parts of a forecast response that are read.
FORECAST = "latitude double, longitude double, current struct<time:string,temperature_2m:double,weather_code:int>, hourly struct<time:array<string>,temperature_2m:array<double>,precipitation_probability:array<double>>, daily struct<time:array<string>,temperature_2m_max:array<double>,temperature_2m_min:array<double>,weather_code:array<int>>"


def parsed(df: DataFrame, column: str, schema: str = FORECAST) -> DataFrame:
    """df with the column read as JSON; malformed text gives nulls."""
    return df.withColumn(column, F.from_json(column, schema))


def zipped(df: DataFrame, keys: list[str], part: str, columns: list[str], since: Column | None = None, limit: int | None = None) -> DataFrame:
    """A row for each position of parallel arrays, from the time `since` on, at most `limit` of each record; shorter arrays give nulls."""
    rows = F.arrays_zip(*[F.col(f"{part}.{c}").alias(c) for c in columns])
    if since is not None:
        rows = F.filter(rows, lambda r: r[columns[0]] >= since)
    if limit is not None:
        rows = F.slice(rows, 1, limit)
    return df.select(*keys, F.inline(rows))


def report_rows(df: DataFrame, name: str = "report") -> DataFrame:
    """Each row as one JSON object."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


#: Weather codes and their texts: fixed values.
CODES = {0: "clear", 1: "mainly clear", 2: "partly cloudy", 3: "overcast", 45: "fog", 48: "rime fog", 51: "light drizzle", 61: "light rain", 63: "rain", 65: "heavy rain", 71: "light snow", 73: "snow", 75: "heavy snow", 80: "showers", 95: "thunderstorm"}


def code_text(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, c), F.lit("unknown"))


def error_kind(message: Column, status: Column) -> Column:
    """What went wrong with a request, by the first rule that applies."""
    m = F.lower(F.coalesce(message, F.lit("")))
    return F.when(status == 401, "bad key").when(status == 404, "not found").when(status == 429, "too many requests").when(status >= 500, "server").when(m.contains("abort") | m.contains("timeout"), "timeout").when(m.contains("network") | m.contains("fetch"), "offline").otherwise("unknown")
