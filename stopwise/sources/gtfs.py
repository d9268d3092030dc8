"""Static timetable feeds: zip archives of CSV files as typed DataFrames.

Archives are read with Spark's binary file source, so any store that Spark reads will do; one task reads one archive and
yields its rows as text by column name, the typed tables are projections of that.
"""

from __future__ import annotations

import csv
import datetime as dt
import io
import zipfile
from collections.abc import Iterator
from zoneinfo import available_timezones

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.timeutil import gtfs_date, gtfs_seconds
from ..operators.calendar import services_in_range
from ..operators.timetable import interpolate
from ..shipping import ship

#: Largest size of an entry once unpacked, in bytes.
CAPS = {"stop_times.txt": 4 << 30}
CAP = 512 << 20
REQUIRED = ("stops.txt", "stop_times.txt")
BATCH = 20_000


def find_entry(names: list[str], wanted: str) -> str | None:
    """First entry whose last path part is ``wanted``, whatever its case."""
    return next((n for n in names if n.rsplit("/", 1)[-1].lower() == wanted), None)


def validate(content: bytes) -> None:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        missing = [w for w in REQUIRED if find_entry(archive.namelist(), w) is None]
    if missing:
        raise ValueError(f"not a timetable archive, without {', '.join(missing)}")


def entry_rows(content: bytes, wanted: str, optional: bool = True, cap: int | None = None) -> Iterator[tuple[int, dict[str, str]]]:
    """(row number, fields) of a CSV entry. Ragged rows are allowed; a byte order mark goes; an absent optional entry has no rows."""
    cap = cap or CAPS.get(wanted, CAP)
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        name = find_entry(archive.namelist(), wanted)
        if name is None:
            if optional:
                return
            raise ValueError(f"the archive has no {wanted}")
        if archive.getinfo(name).file_size > cap:
            raise ValueError(f"{wanted} is larger than {cap} bytes")
        with archive.open(name) as raw:
            lines = io.TextIOWrapper(raw, "utf-8-sig", errors="strict", newline="")
            reader = csv.reader(lines)
            header = [h.strip() for h in next(reader, [])]
            for k, row in enumerate(reader):
                if row:
                    yield k, {h: v for h, v in zip(header, row, strict=False) if h}


class Feed:
    """One or more archives under a path; each table has ``feed_id`` and namespaced ids.

    With ``horizon`` (first and last date; yesterday belongs to it, as its late trips still run) only trips whose service runs on a day of it
    are kept, and with them only their stop times.
    """

    def __init__(self, spark: SparkSession, path: str, feed_id: str | None = None, horizon: tuple[dt.date, dt.date] | None = None):
        self.spark, self.feed_id, self.horizon = spark, feed_id, horizon
        self.archives = spark.read.format("binaryFile").load(path).select("path", "content")

    def raw(self, entry: str, optional: bool = True) -> DataFrame:
        """(feed_id, row, fields map) of one entry of each archive."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kind = pa.map_(pa.string(), pa.string())
            for batch in batches:
                for feed, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    numbers, fields = [], []
                    for number, row in entry_rows(content.as_py(), entry, optional):
                        numbers.append(number)
                        fields.append(list(row.items()))
                        if len(numbers) == BATCH:
                            yield pa.RecordBatch.from_arrays([pa.array([feed] * BATCH), pa.array(numbers, pa.int64()), pa.array(fields, kind)], ["feed_id", "row", "f"])
                            numbers, fields = [], []
                    yield pa.RecordBatch.from_arrays([pa.array([feed] * len(numbers), pa.string()), pa.array(numbers, pa.int64()), pa.array(fields, kind)], ["feed_id", "row", "f"])

        ship(self.spark)
        feed = F.lit(self.feed_id) if self.feed_id else F.regexp_extract("path", r"([^/]+)\.zip$", 1)
        return self.archives.select(feed.alias("feed_id"), "content").mapInArrow(run, "feed_id string, row long, f map<string,string>")

    @staticmethod
    def _text(name: str, default: str | None = None) -> Column:
        value = F.nullif(F.trim(F.try_element_at("f", F.lit(name))), F.lit(""))
        return value if default is None else F.coalesce(value, F.lit(default))

    def _id(self, name: str) -> Column:
        return F.when(self._text(name).isNotNull(), F.concat_ws(":", "feed_id", self._text(name)))

    def _number(self, name: str, kind: str = "int", default: float | None = None) -> Column:
        value = F.expr(f"try_cast(trim(try_element_at(f, '{name}')) as {kind})")
        return value if default is None else F.coalesce(value, F.lit(default).cast(kind))

    @property
    def stops(self) -> DataFrame:
        t, n = self._text, self._number
        return self.raw("stops.txt", False).where(t("stop_id").isNotNull()).select(
            "feed_id", self._id("stop_id").alias("stop_id"), t("stop_id").alias("raw_id"), F.coalesce(t("stop_name"), t("stop_id")).alias("name"), n("stop_lat", "double").alias("lat"), n("stop_lon", "double").alias("lon"),
            self._id("parent_station").alias("parent_id"), n("location_type", "int", 0).alias("location_type"), t("platform_code").alias("platform_code"), t("stop_code").alias("stop_code"), t("stop_desc").alias("stop_desc"),
            t("level_id").alias("level_id"), t("zone_id").alias("zone_id"), n("wheelchair_boarding", "int", 0).alias("wheelchair"), t("stop_timezone").alias("timezone"),
        )

    @property
    def routes(self) -> DataFrame:
        t = self._text
        return self.raw("routes.txt", False).where(t("route_id").isNotNull()).select("feed_id", self._id("route_id").alias("route_id"), t("route_short_name").alias("short_name"), t("route_long_name").alias("long_name"), self._number("route_type", "int", 3).alias("route_type"), t("agency_id").alias("agency_id"), t("route_color").alias("color"), t("route_text_color").alias("text_color"))

    @property
    def trips(self) -> DataFrame:
        """The last row of a repeated trip id counts."""
        t, n = self._text, self._number
        rows = self.raw("trips.txt", False).where(t("trip_id").isNotNull() & t("route_id").isNotNull()).select(
            "row", "feed_id", self._id("trip_id").alias("trip_id"), self._id("route_id").alias("route_id"), t("service_id").alias("service_id"), t("trip_headsign").alias("headsign"), t("trip_short_name").alias("short_name"),
            t("block_id").alias("block_id"), t("shape_id").alias("shape_id"), n("direction_id").alias("direction_id"), n("wheelchair_accessible", "int", 0).alias("wheelchair"), n("bikes_allowed", "int", 0).alias("bikes_allowed"),
        )
        last = F.row_number().over(W.partitionBy("trip_id").orderBy(F.desc("row")))
        rows = rows.withColumn("n", last).where("n = 1").drop("n", "row")
        if self.horizon is None:
            return rows
        own = F.concat_ws(":", "feed_id", "service_id").alias("service_id")
        runs = services_in_range(self.services.select(own, "days", "start_date", "end_date"), self.calendar_dates.select(own, "date", "exception_type"), *self.horizon)
        return rows.join(runs.select(F.col("service_id").alias("runs")).distinct(), F.concat_ws(":", "feed_id", "service_id") == F.col("runs"), "left_semi")

    def stop_times(self, trips: DataFrame | None = None) -> DataFrame:
        """Stop events of the kept ``trips`` at known stops, blank times filled."""
        t, n = self._text, self._number
        rows = self.raw("stop_times.txt", False).select(
            "feed_id", self._id("trip_id").alias("trip_id"), self._id("stop_id").alias("stop_id"), n("stop_sequence").alias("stop_sequence"), gtfs_seconds(t("arrival_time")).alias("arrival_s"), gtfs_seconds(t("departure_time")).alias("departure_s"),
            n("pickup_type", "int", 0).alias("pickup_type"), n("drop_off_type", "int", 0).alias("drop_off_type"), t("stop_headsign").alias("stop_headsign"), n("shape_dist_traveled", "double").alias("shape_dist"),
        )
        rows = rows.join(self.stops.select("stop_id", "lat", "lon"), "stop_id").join((self.trips if trips is None else trips).select("trip_id"), "trip_id", "left_semi")
        rows = rows.withColumn("off", F.row_number().over(W.partitionBy("trip_id").orderBy("stop_sequence", "stop_id")) - 1)
        return interpolate(rows).drop("lat", "lon")

    @property
    def services(self) -> DataFrame:
        week = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
        days = sum((F.when(self._text(d) == "1", 1 << k).otherwise(0) for k, d in enumerate(week)), F.lit(0))
        first = F.coalesce(gtfs_date(self._text("start_date")), F.lit("1970-01-01").cast("date"))
        last = F.coalesce(gtfs_date(self._text("end_date")), F.lit("2099-12-31").cast("date"))
        return self.raw("calendar.txt").where(self._text("service_id").isNotNull()).select("feed_id", self._text("service_id").alias("service_id"), days.alias("days"), first.alias("start_date"), last.alias("end_date"))

    @property
    def calendar_dates(self) -> DataFrame:
        kind = self._number("exception_type")
        rows = self.raw("calendar_dates.txt").select("feed_id", self._text("service_id").alias("service_id"), gtfs_date(self._text("date")).alias("date"), kind.alias("exception_type"))
        return rows.where("exception_type in (1, 2) and date is not null")

    @property
    def timezone(self) -> DataFrame:
        """(feed_id, timezone): the first agency's zone that is one."""
        zone = self._text("agency_timezone")
        rows = self.raw("agency.txt").where(zone.isin(*sorted(available_timezones())))
        return rows.groupBy("feed_id").agg(F.min_by(zone, "row").alias("timezone"))

    @property
    def agencies(self) -> DataFrame:
        t = self._text
        return self.raw("agency.txt").select("feed_id", t("agency_id", "default").alias("agency_id"), t("agency_name").alias("agency_name"), t("agency_url").alias("url"), t("agency_timezone").alias("timezone"), t("agency_phone").alias("phone"))

    @property
    def transfers(self) -> DataFrame:
        rows = self.raw("transfers.txt").select(self._id("from_stop_id").alias("from_stop"), self._id("to_stop_id").alias("to_stop"), self._number("min_transfer_time", "int", 120).alias("duration_s"), self._number("transfer_type", "int", 0).alias("transfer_type"))
        return self._between_stops(rows)

    def _between_stops(self, rows: DataFrame) -> DataFrame:
        known = self.stops.select("stop_id")
        rows = rows.join(known.withColumnRenamed("stop_id", "from_stop"), "from_stop", "left_semi")
        return rows.join(known.withColumnRenamed("stop_id", "to_stop"), "to_stop", "left_semi")

    @property
    def pathways(self) -> DataFrame:
        from ..operators.timetable import pathway_seconds

        n = self._number
        key = F.coalesce(self._text("pathway_id"), F.concat(self._text("from_stop_id"), F.lit("->"), self._text("to_stop_id")))
        seconds = pathway_seconds(n("traversal_time"), n("length", "double"))
        rows = self.raw("pathways.txt").select(key.alias("pathway_id"), self._id("from_stop_id").alias("from_stop"), self._id("to_stop_id").alias("to_stop"), n("pathway_mode", "int", 1).alias("mode"), (n("is_bidirectional", "int", 0) == 1).alias("is_bidirectional"), seconds.alias("duration_s"), F.coalesce(n("length", "double"), seconds * 1.2).alias("distance_m"))
        return self._between_stops(rows)

    @property
    def levels(self) -> DataFrame:
        return self.raw("levels.txt").select("feed_id", self._text("level_id").alias("level_id"), self._number("level_index", "double").alias("level_index"), self._text("level_name").alias("level_name"))

    @property
    def frequencies(self) -> DataFrame:
        rows = self.raw("frequencies.txt").select(self._id("trip_id").alias("trip_id"), gtfs_seconds(self._text("start_time")).alias("start_s"), gtfs_seconds(self._text("end_time")).alias("end_s"), self._number("headway_secs").alias("headway_s"))
        return rows.where("headway_s > 0 and start_s is not null and end_s is not null")

    @property
    def shapes(self) -> DataFrame:
        """(shape_id, points): latitude before longitude, in the order of the sequence."""
        n = self._number
        rows = self.raw("shapes.txt").select(self._text("shape_id").alias("shape_id"), n("shape_pt_sequence").alias("k"), n("shape_pt_lat", "double").alias("lat"), n("shape_pt_lon", "double").alias("lon")).where("lat is not null and lon is not null")
        return rows.groupBy("shape_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "lat", "lon"))), lambda p: F.struct(p["lat"], p["lon"])).alias("points"))

    @property
    def feed_info(self) -> DataFrame:
        t = self._text
        first = F.row_number().over(W.partitionBy("feed_id").orderBy("row"))
        rows = self.raw("feed_info.txt").select("feed_id", "row", t("feed_publisher_name").alias("publisher"), t("feed_lang").alias("lang"), gtfs_date(t("feed_start_date")).alias("start_date"), gtfs_date(t("feed_end_date")).alias("end_date"))
        return rows.withColumn("n", first).where("n = 1").drop("n", "row")

    @property
    def fare_attributes(self) -> DataFrame:
        n = self._number
        rows = self.raw("fare_attributes.txt").select(self._text("fare_id").alias("fare_id"), n("price", "double").alias("price"), self._text("currency_type").alias("currency"), n("transfers").alias("transfers"), n("transfer_duration").alias("transfer_duration"))
        return rows.where("fare_id is not null and price is not null and currency is not null")

    @property
    def fare_rules(self) -> DataFrame:
        t = self._text
        return self.raw("fare_rules.txt").where(t("fare_id").isNotNull()).select(t("fare_id").alias("fare_id"), self._id("route_id").alias("route_id"), t("origin_id").alias("origin_id"), t("destination_id").alias("destination_id"), t("contains_id").alias("contains_id"))

    @property
    def aliases(self) -> DataFrame:
        """(key, object_id): each spelling of an object's codes in other systems, the first of a spelling."""
        t = self._text
        rows = self.raw("object_codes_extension.txt").select("row", t("object_id").alias("object_id"), t("object_code").alias("code")).where("object_id is not null and code is not null")
        keys = F.explode(F.array_distinct(F.array(F.col("code"), F.regexp_replace("code", ":$", ""), F.element_at(F.split("code", ":"), -1))))
        rows = rows.select("object_id", "row", keys.alias("key")).where("key <> ''")
        return rows.groupBy("key").agg(F.min_by("object_id", "row").alias("object_id"))


def addresses(spark: SparkSession, path: str) -> DataFrame:
    """Address files with ``;`` between the fields; rows without finite coordinates go."""
    rows = spark.read.csv(path, sep=";", header=True, mode="PERMISSIVE", encoding="UTF-8")
    lat, lon = (F.expr(f"try_cast({c} as double)") for c in ("lat", "lon"))
    rows = rows.select(F.expr("try_cast(numero as int)").alias("num"), F.coalesce("rep", F.lit("")).alias("rep"), F.col("nom_voie").alias("street"), F.col("code_postal").alias("postcode"), F.col("nom_commune").alias("city"), lat.alias("lat"), lon.alias("lon"))
    return rows.where("street is not null and lat is not null and lon is not null and not isnan(lat) and not isnan(lon)")
