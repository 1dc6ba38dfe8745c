"""Schedule edges: packages, merging, hours past 24, day types, versions, a full run."""

import datetime as dt
import itertools
import random
import zipfile

from pyspark.sql import functions as F

from lateline.constants import NO_SCHEDULE
from lateline.operators import schedule as ops
from lateline.plans.schedule_run import WarehousePaths, schedule_run
from lateline.schema import DELAY_FACT, SCHEDULE_LOOKUP, SCHEDULE_VERSION
from lateline.sources.packages import (
    UNPACKED_LAYOUT, read_feed_period, read_package_table, select_packages, unpack_packages,
)

TODAY = dt.date(2024, 3, 20)


def walk(packages, today, horizon):
    """The same choice by going through the packages, newest first."""
    days = {today + dt.timedelta(i) for i in range(horizon)}
    covered, kept = set(), []
    for rank, name, start, end in sorted(packages, reverse=True):
        own = {d for d in days if start <= d <= end} - covered
        if own:
            kept.append((name, len(own)))
            covered |= own
    return sorted(kept)


def test_select_packages_equals_newest_first_walk(spark):
    random.seed(7)
    for _ in range(3):
        packages = []
        for i in range(30):
            d, seq = random.randint(1, 28), random.randint(1, 12)
            start = TODAY + dt.timedelta(random.randint(-10, 20))
            packages.append(((2024, 2, d, seq), f"schedule_ZTM_2024.02.{d:02}_{seq}_{i}.zip",
                             start, start + dt.timedelta(random.randint(-1, 6))))
        df = spark.createDataFrame([p[1:] for p in packages] + [("notes.zip", TODAY, TODAY)],
                                   "name string, start_date date, end_date date")
        got = select_packages(df, TODAY).collect()
        assert sorted((r.name, r.n_days) for r in got) == walk(packages, TODAY, 14)
        assert [r.start_date for r in got] == sorted(r.start_date for r in got)


def test_lookup_edges(spark):
    stop_times = spark.createDataFrame(
        [("t1", "s1", "1", "23:59:00"), ("t1", "s2", "2", "25:30:00"), ("t1", "s3", "x", None),
         ("gone", "s1", "1", "10:00:00"), ("t2", "s1", "1", "48:00:00")],
        "trip_id string, stop_id string, stop_sequence string, arrival_time string")
    trips = spark.createDataFrame(
        [("t1", "r", "0", "x"), ("t2", "r", None, "y")],
        "trip_id string, route_id string, direction_id string, trip_headsign string")
    ext = spark.createDataFrame([("t1", "6")], "trip_id string, operator_id string")
    rows = {(r.trip_id, r.stop_id): r for r in
            ops.build_schedule_lookup(stop_times, trips, ext).collect()}
    assert len(rows) == 4
    assert rows["t1", "s2"].day_offset == 1 and rows["t2", "s1"].day_offset == 2
    assert rows["t1", "s3"].stop_sequence is None and rows["t1", "s3"].day_offset == 0
    assert rows["t2", "s1"].operator_id is None


def test_stop_defaults(spark):
    stops = spark.createDataFrame([("a", "A", " 50.1 ", "1e1"), ("b", "B", "x", "1.5d")],
                                  "stop_id string, stop_name string, stop_lat string, stop_lon string")
    ext = spark.createDataFrame([("a", "city", "7_8", None)],
                                "stop_id string, city string, community_ids string, "
                                "stop_attribute_ids string")
    comm = spark.createDataFrame([("7", "seven")], "community_id string, community_name string")
    attr = spark.createDataFrame([("1", "x")], "stop_type_id string, stop_attr_name string")
    a, b = ops.build_dim_stop(stops, ext, comm, attr).orderBy("stop_id").collect()
    assert (a.lat, a.lon, a.commune, a.stop_type) == (50.1, 10.0, "seven", "Standardowy")
    assert (b.lat, b.lon, b.commune, b.stop_type) == (None, None, None, None)


def test_day_types(spark):
    week = ["1"] * 7
    calendar = spark.createDataFrame(
        [("2", "20240318", "20240324", *week), ("10", "20240320", "20240320", *week),
         ("9", "20240320", "20240320", *week), ("1", "20240301", "20240331", *["0"] * 7)],
        "service_id string, start_date string, end_date string, monday string, tuesday string, "
        "wednesday string, thursday string, friday string, saturday string, sunday string")
    services = spark.createDataFrame([("2", "dni robocze"), ("9", "święto")],
                                     "service_id string, name string")
    rows = {r.date: r for r in ops.build_dim_date(
        calendar, services, dt.date(2024, 3, 17), dt.date(2024, 3, 20)).collect()}
    assert rows[dt.date(2024, 3, 17)].day_type == NO_SCHEDULE
    assert rows[dt.date(2024, 3, 17)].weekday == 7
    assert rows[dt.date(2024, 3, 18)].day_type == "dni robocze"
    assert rows[dt.date(2024, 3, 20)].day_type == "święto"
    assert rows[dt.date(2024, 3, 20)].day_name == "środa"


def test_fingerprint_ignores_order_only(spark):
    rows = [(1, f"t{i}", "s", i % 3, None if i % 2 else "", "l", "0", "h", "6", 0)
            for i in range(50)]

    def digest(data, parts):
        df = spark.createDataFrame(data, SCHEDULE_LOOKUP).repartition(parts)
        return ops.schedule_fingerprint(df).first().digest

    base = digest(rows, 1)
    shuffled = rows[::-1]
    assert digest(shuffled, 5) == base
    assert digest(rows[1:], 2) != base
    assert digest(rows + rows[:1], 2) != base
    changed = [r if i else (*r[:4], "" if r[4] is None else None, *r[5:])
               for i, r in enumerate(rows)]
    assert digest(changed, 2) != base


def test_upsert_nulls_overwrite(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, name string, n int")
    new = spark.createDataFrame([(2, None, 5), (3, "c", None)], "id int, name string, n int")
    assert sorted(tuple(r) for r in ops.upsert(old, new, ["id"]).collect()) == [
        (1, "a", 1), (2, None, 5), (3, "c", None)]


def test_register_first_version(spark):
    empty = spark.createDataFrame([], SCHEDULE_VERSION)
    print_ = spark.createDataFrame([(1, "fp")], "n_rows long, digest string")
    now = dt.datetime(2024, 3, 20, tzinfo=dt.timezone.utc)
    row = ops.register_version(empty, print_, "p", TODAY, TODAY, now).collect()
    assert [(r.version_id, r.fingerprint) for r in row] == [(1, "fp")]


def package(folder, name, start, end, extra_trip="t2", arrival="08:00:00"):
    tables = {
        "feed_info": f'"feed_publisher_name","feed_start_date","feed_end_date"\n"x, y","{start}","{end}"\n',
        "routes": "route_id, route_short_name,route_long_name,route_type\nr1,1,One,0\nr2,2,,7\n",
        "routes_ext": "route_id,route_type_1\nr2,Nocna\n",
        "stops": 'stop_id,stop_name,stop_lat,stop_lon\ns1,"A, B",50.1,19\ns2,C,,\n',
        "stops_ext": "stop_id,community_ids,city,stop_attribute_ids\ns1,7_8,K,\n",
        "stops_attributes_ext": "stop_type_id,stop_attr_name\n1,x\n",
        "communities_ext": "community_id,community_name\n7,Seven\n",
        "trips": f"trip_id,route_id,direction_id,trip_headsign\nt1,r1,0,x\n{extra_trip},r2,1,y\n",
        "trips_ext": f"trip_id,operator_id\nt1,6\n{extra_trip},7\n",
        "stop_times": "trip_id,stop_id,stop_sequence,arrival_time\n"
                      f"t1,s1,1,{arrival}\nt1,s2,2,25:10:00\n{extra_trip},s1,1,09:00:00\n",
        "calendar": "service_id,start_date,end_date,monday,tuesday,wednesday,thursday,friday,"
                    f"saturday,sunday\n1,{start},{end},1,1,1,1,1,1,1\n",
        "service_ext": "service_id,name\n1,dni robocze\n",
        "operators_ext": "operator_id,operator_name\n6,Six\n7,Seven\n",
    }
    folder.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(folder / name, "w") as archive:
        for table, text in tables.items():
            archive.writestr(f"{table}.txt", ("﻿" + text).replace("\n", "\r\n"))


def test_schedule_run_from_zips(spark, tmp_path):
    first, second = "a.zip", "b.zip"
    package(tmp_path / "in", first, "20240320", "20240322")
    package(tmp_path / "in", second, "20240323", "20240401", "t3", "08:30:00")
    root = str(tmp_path / "unpacked")
    unpack_packages(spark, str(tmp_path / "in" / "*.zip"), root)
    read = read_package_table(spark, root, [first, second], "feed_info", UNPACKED_LAYOUT)
    periods = {r.package: (r.start_date, r.end_date) for r in read_feed_period(read).collect()}
    assert periods[second] == (dt.date(2024, 3, 23), dt.date(2024, 4, 1))

    paths = WarehousePaths(str(tmp_path / "warehouse"), str(tmp_path / "lookups"))
    fact = spark.createDataFrame([], DELAY_FACT)
    now = dt.datetime(2024, 3, 20, 4, tzinfo=dt.timezone.utc)

    def run(day, facts=fact):
        return schedule_run(spark, root, [first, second], paths, TODAY + dt.timedelta(day),
                            now + dt.timedelta(day), facts, layout=UNPACKED_LAYOUT)

    def table(name):
        return spark.read.parquet(f"{paths.tables}/{name}")

    assert run(0) == 1
    lookup = {(r.trip_id, r.stop_id): r for r in table("schedule_lookup").collect()}
    assert set(lookup) == {("t1", "s1"), ("t1", "s2"), ("t2", "s1"), ("t3", "s1")}
    assert lookup["t1", "s1"].arrival == "08:00:00"      # the first package's record
    assert lookup["t1", "s2"].day_offset == 1
    lines = {r.line_id: r for r in table("dim_line").collect()}
    assert (lines["r1"].transport_mode, lines["r1"].line_type) == ("tram", "Normalna")
    assert (lines["r2"].transport_mode, lines["r2"].line_type) == ("other", "Nocna")
    assert {r.stop_id: r.name for r in table("dim_stop").collect()}["s1"] == "A, B"

    assert run(1) == 1                                    # same content: version extended
    versions = table("schedule_version").collect()
    assert [(r.version_id, r.valid_to) for r in versions] == [(1, TODAY + dt.timedelta(14))]
    assert table("schedule_lookup").count() == 4

    package(tmp_path / "in", second, "20240323", "20240401", "t4")
    unpack_packages(spark, str(tmp_path / "in" / "*.zip"), root)
    assert run(2) == 2                                    # changed: version 1 has no facts, goes
    assert {r.version_id for r in table("schedule_lookup").collect()} == {2}
    assert table("dim_date").where("day_type = 'dni robocze'").count() == 13
