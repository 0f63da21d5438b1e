"""Point assets from GeoJSON and CSV, with defaults by asset type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Asset types and their default sensitivity.
SENSITIVITY = {"DESALINATION_INTAKE": 1.0, "DESALINATION_PLANT": 1.0, "POWER_PLANT": 0.7, "OIL_TERMINAL": 0.6, "AQUACULTURE": 0.95,
               "PUBLIC_BEACH": 0.8, "MARINE_PROTECTED_AREA": 0.9, "PORT": 0.5, "INDUSTRIAL_INTAKE": 0.7, "CUSTOM": 0.6}

FEATURE = ("struct<type:string,geometry:struct<type:string,coordinates:array<double>>,"
           "properties:struct<id:string,name:string,type:string,sensitivity:double,notes:string>>")


def known_type(c: Column) -> Column:
    up = F.upper(F.coalesce(c, F.lit("CUSTOM")))
    return F.when(up.isin(list(SENSITIVITY)), up).otherwise("CUSTOM")


def with_defaults(df: DataFrame) -> DataFrame:
    """Unknown types become CUSTOM; a missing sensitivity follows the type."""
    t = known_type(F.col("type"))
    default = F.lit(None).cast("double")
    for name, s in SENSITIVITY.items():
        default = F.when(t == name, F.lit(s)).otherwise(default)
    return df.withColumns({"type": t, "sensitivity": F.coalesce("sensitivity", default)})


def from_features(features: DataFrame, column: str = "feature") -> DataFrame:
    """Assets from one GeoJSON feature (struct) per row; anything but a point is dropped."""
    f = F.col(column)
    pts = features.where(f["geometry"]["type"] == "Point")
    return with_defaults(pts.select(
        f["properties"]["id"].alias("id"), f["properties"]["name"].alias("name"), f["properties"]["type"].alias("type"),
        F.get(f["geometry"]["coordinates"], 0).alias("lon"), F.get(f["geometry"]["coordinates"], 1).alias("lat"),
        f["properties"]["sensitivity"].alias("sensitivity"), F.coalesce(f["properties"]["notes"], F.lit("")).alias("notes")))


def from_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Read FeatureCollection files."""
    raw = spark.read.schema(f"type string, features array<{FEATURE}>").json(path, multiLine=True)
    return from_features(raw.select(F.explode("features").alias("feature")))


def from_csv(spark: SparkSession, path: str) -> DataFrame:
    """Read CSV with lon / longitude / x and lat / latitude / y; rows without coordinates are dropped."""
    return from_table(spark.read.csv(path, header=True))


def from_table(raw: DataFrame) -> DataFrame:
    """The same rules for any table of strings."""
    have = {c.strip().lower(): F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in raw.columns}
    pick = lambda *names: F.coalesce(*[have[n] for n in names if n in have], F.lit(None).cast("string"))         # noqa: E731
    out = raw.select(pick("id").alias("id"), pick("name").alias("name"), pick("type").alias("type"),
                     pick("lon", "longitude", "x").try_cast("double").alias("lon"), pick("lat", "latitude", "y").try_cast("double").alias("lat"),
                     pick("sensitivity").try_cast("double").alias("sensitivity"), F.coalesce(pick("notes"), F.lit("")).alias("notes"))
    return with_defaults(out.where(F.col("lon").isNotNull() & F.col("lat").isNotNull()))
