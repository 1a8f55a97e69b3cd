"""Telemetry replay: a Python data source over JSON-lines logs, and the records' normal form."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class LogReader(DataSourceReader):
    """One partition for each log. BAD_DATA and other types than asked for are passed over; a limit ends the log."""

    def __init__(self, options: dict):
        self.paths = [p for p in options["path"].split(",") if p]
        self.types = {t for t in options.get("types", "").upper().split(",") if t}
        self.limit = int(options["limit"]) if "limit" in options else None

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        n = 0
        with open(partition.value, encoding="utf-8") as lines:
            for seq, line in enumerate(lines):
                message = json.loads(line) if line.strip() else {}
                kind = str(message.get("mavpackettype") or message.get("type") or "").upper()
                if not kind or kind == "BAD_DATA" or self.types and kind not in self.types:
                    continue
                if self.limit is not None and n >= self.limit:
                    return
                n += 1
                yield partition.value, seq, kind, json.dumps(message, sort_keys=True)


class TelemetryLog(DataSource):
    """``spark.read.format("telemetry_log").option("path", "a.jsonl,b.jsonl")``."""

    @classmethod
    def name(cls) -> str:
        return "telemetry_log"

    def schema(self) -> str:
        return "source string, seq bigint, kind string, payload string"

    def reader(self, schema) -> LogReader:
        return LogReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TelemetryLog)


def field(*names: str) -> Column:
    """The first alias that the payload holds."""
    return F.coalesce(*(F.get_json_object("payload", f"$.{n}") for n in names))


INT32_MAX = 2147483647


def scaled(value: Column, scale: float) -> Column:
    """An integer field as a measure; the largest 32-bit number means unknown."""
    number = value.try_cast("bigint")
    return F.when(F.abs(number) != INT32_MAX, number / scale)


def exact_ns(value: Column, multiplier: int) -> Column:
    """A decimal time as integer nanoseconds, halves to even."""
    return F.bround(value.try_cast("decimal(28,9)") * F.lit(multiplier).cast("decimal(10,0)"), 0).cast("bigint")


def normalized(messages: DataFrame) -> DataFrame:
    """Ids, both clocks in nanoseconds, position and fix of each message. Times of zero are unknown; large microseconds are UTC."""
    usec = field("time_usec").try_cast("bigint")
    utc = F.when(usec > 10**12, usec * 1000)
    boot = F.coalesce(exact_ns(field("time_boot_ms"), 10**6), F.when(usec <= 10**12, usec * 1000))
    system, component = field("system_id", "sysid").try_cast("int"), field("component_id", "compid").try_cast("int")
    fix = field("fix_type").try_cast("int")
    domain = F.coalesce(field("clock_domain"), F.format_string("mavlink:system:%d:component:%d:boot", system, component))
    return messages.select(
        "source", "seq", "kind", system.alias("system_id"), component.alias("component_id"),
        F.nullif(utc, F.lit(0)).alias("utc_ns"), F.nullif(boot, F.lit(0)).alias("boot_ns"), F.when(system.isNotNull(), domain).alias("boot_domain"),
        scaled(field("lat"), 1e7).alias("latitude_deg"), scaled(field("lon"), 1e7).alias("longitude_deg"), scaled(field("alt"), 1e3).alias("altitude_m"),
        fix.alias("fix_type"), F.when(fix >= 6, "rtk_fixed").when(fix == 5, "rtk_float").when(fix == 4, "dgps").when(fix == 3, "3d").when(fix == 2, "2d").when(fix >= 0, "none").alias("fix_quality"),
        file_name(field("file_url", "filename")).alias("filename"),
    )


def file_name(value: Column) -> Column:
    """Base name of a url, POSIX or Windows path, percent-decoded."""
    bare = F.regexp_replace(F.regexp_replace(value, r"[?#].*$", ""), r"\\", "/")
    return F.try_url_decode(F.regexp_replace(F.element_at(F.split(bare, "/"), -1), r"\+", "%2B"))
