import json

import pytest

from tidegrid.sources.tables import ensure_table, first_available
from tidegrid.sources.trips import missing_months, read_trips
from tidegrid.sources.weather import read_weather_payload
from tidegrid.sources.zones import read_zone_lookup, read_zone_outlines


def test_absent_sources_raise(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_trips(spark, str(tmp_path / "none"))
    with pytest.raises(FileNotFoundError):
        read_zone_lookup(spark, str(tmp_path / "none.csv"))
    with pytest.raises(FileNotFoundError):
        first_available(spark, [(str(tmp_path / "none"), lambda df: df)])


def test_trip_files_and_months(spark, tmp_path):
    spark.sql("select timestamp'2024-07-01' as tpep_pickup_datetime, 4 as PULocationID, 1 as fare").write.parquet(
        str(tmp_path / "yellow_tripdata_2024-07.parquet")
    )
    assert read_trips(spark, str(tmp_path)).columns == ["pickup_dt", "PULocationID"]
    assert [r["month"] for r in missing_months(spark, str(tmp_path), ["2024-07", "2024-08"]).collect()] == ["2024-08"]


def test_first_ingest_misses_every_month(spark, tmp_path):
    assert [r["month"] for r in missing_months(spark, str(tmp_path), ["2024-07", "2024-08"]).collect()] == ["2024-07", "2024-08"]


def test_lookup_outlines_and_payload(spark, tmp_path):
    (tmp_path / "zones.csv").write_text('LocationID,Borough,Zone,service_zone\n264,Unknown,N/A,N/A\n1,EWR,"Newark Airport",EWR\n')
    rows = {r["LocationID"]: r for r in read_zone_lookup(spark, str(tmp_path / "zones.csv")).collect()}
    assert rows[264]["Zone"] is None and rows[1]["Zone"] == "Newark Airport"

    outlines = {"features": [{"geometry": {"type": "Point"}, "properties": {"location_id": "7"}},
                             {"geometry": {"type": "Point"}, "properties": {"LocationID": 8}}]}
    (tmp_path / "geo.json").write_text(json.dumps(outlines, indent=1))
    assert sorted(r["zone_id"] for r in read_zone_outlines(spark, str(tmp_path / "geo.json")).collect()) == ["7", "8"]

    payload = {"hourly": {"time": ["2024-07-01T00:00", "2024-07-01T01:00"], "temperature_2m": [20.5, 21.0]}}
    (tmp_path / "weather.json").write_text(json.dumps(payload))
    got = read_weather_payload(spark, str(tmp_path / "weather.json")).orderBy("hour").collect()
    assert [r["temperature_2m"] for r in got] == [20.5, 21.0] and got[0]["snowfall"] is None


def test_table_is_built_once(spark, panel, tmp_path):
    path, calls = str(tmp_path / "panel"), []

    def build():
        calls.append(1)
        return panel

    assert ensure_table(spark, path, build).count() == ensure_table(spark, path, build).count() == 672
    assert len(calls) == 1
