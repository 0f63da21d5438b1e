"""Writers: tables, quoted CSV, JSON lines, GeoJSON collections and Markdown tables."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.document import SINGLE_BYTES, write_document


def feature(lon: Column, lat: Column, properties: Column) -> Column:
    """One GeoJSON point feature as text."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")))


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_geojson(df: DataFrame, path: str, lon: str, lat: str, mode: str = "overwrite", single_bytes: int = SINGLE_BYTES,
                  about: Mapping | None = None) -> None:
    """One GeoJSON FeatureCollection: pieces written in parallel, framed when all are complete; ``about`` becomes its own properties."""
    props = F.struct(*[F.col(c) for c in df.columns if c not in (lon, lat)])
    head = '{"type":"FeatureCollection",' + (f'"properties":{json.dumps(about)},' if about else "") + '"features":[\n'
    write_document(df.select(feature(F.col(lon), F.col(lat), props).alias("value")), path, head, "\n]}\n", ",\n", "features.geojson", mode, single_bytes)


def markdown_line(columns: Sequence[str]) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.replace(F.coalesce(F.col(c).cast("string"), F.lit("n/a")), F.lit("|"), F.lit("\\|")) for c in columns]), F.lit(" |\n"))


def write_markdown(df: DataFrame, path: str, mode: str = "overwrite", single_bytes: int = SINGLE_BYTES) -> None:
    """One Markdown table: a single header before the rows of all partitions."""
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns) + "\n"
    write_document(df.select(markdown_line(df.columns).alias("value")), path, head, "", "", "table.md", mode, single_bytes)
