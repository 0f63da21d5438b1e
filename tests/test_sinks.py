"""Framed documents: one valid collection, one header, nothing left by a failed job."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tidemark.sources import sinks


@pytest.fixture
def points(spark):
    return spark.range(0, 500, 1, 7).select("id", (F.col("id") * 0.1).alias("lon"), (F.col("id") * 0.2).alias("lat"), F.when(F.col("id") % 3 != 0, F.concat(F.lit('na"me|'), "id")).alias("name"))


def joined(path):
    return "".join(open(f"{path}/{n}").read() for n in sorted(os.listdir(path)) if not n.startswith(("_", ".")))


@pytest.mark.parametrize("single_bytes", [1 << 20, 10])
def test_feature_collection(points, tmp_path, single_bytes):
    path = str(tmp_path / "out")
    for _ in range(2):                                                              # written over itself
        sinks.write_geojson(points.orderBy("id"), path, "lon", "lat", single_bytes=single_bytes)
    names = sorted(n for n in os.listdir(path) if not n.startswith("."))
    assert (names == ["_SUCCESS", "features.geojson"]) == (single_bytes > 10)
    doc = json.loads(joined(path))
    assert doc["type"] == "FeatureCollection" and [f["properties"]["id"] for f in doc["features"]] == list(range(500))
    assert doc["features"][4] == {"type": "Feature", "geometry": {"type": "Point", "coordinates": [0.4, 0.8]}, "properties": {"id": 4, "name": 'na"me|4'}}


def test_one_markdown_header(points, tmp_path):
    path = str(tmp_path / "out")
    sinks.write_markdown(points.select("id", "name").orderBy("id"), path)
    lines = open(f"{path}/table.md").read().splitlines()
    assert lines[:3] == ["| id | name |", "|---|---|", "| 0 | n/a |"] and len(lines) == 502
    assert sum(x.startswith("| id") for x in lines) == 1 and lines[3] == '| 1 | na"me\\|1 |'


def test_empty_and_file_uri(points, tmp_path):
    path = f"file://{tmp_path}/empty"
    sinks.write_geojson(points.where("id < 0"), path, "lon", "lat")
    assert json.loads(joined(str(tmp_path / "empty"))) == {"type": "FeatureCollection", "features": []}


def test_a_failed_job_leaves_nothing(points, tmp_path):
    path = str(tmp_path / "out")
    sinks.write_geojson(points.where("id < 10"), path, "lon", "lat")
    before = joined(path)
    bad = points.withColumn("name", F.when(F.col("id") == 499, F.raise_error(F.lit("broken row"))).otherwise(F.col("name")))
    with pytest.raises(Exception, match="broken row"):
        sinks.write_geojson(bad, path, "lon", "lat")
    assert joined(path) == before and not any(n.startswith("_job") for n in os.listdir(path))
