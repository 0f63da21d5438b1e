"""Reading the input tables and the domain views made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.blocks import in_tasks, tasks_for


def line_tasks(spark: SparkSession, sf_dir: str) -> int | None:
    """Tasks for views of the lines (``tasks_for``; the count comes from the files' footers)."""
    return tasks_for(table(spark, sf_dir, "lineitem"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per pixel and calendar day: same-day passes are averaged (a map-side
    combine), so a pixel's history is bounded by the calendar whatever its row count."""
    return (table(spark, sf_dir, "lineitem")
            .groupBy(F.col("l_partkey").alias("px"), F.to_date("l_shipdate").alias("d"))
            .agg(F.avg("l_quantity").alias("ndci"),
                 F.avg(F.col("l_extendedprice") / 1000).alias("tur"),
                 F.avg("l_discount").alias("mci")))


BAND_COLUMNS = ["b01", "b02", "b03", "b04", "b05", "b06", "b8a", "b11", "b12"]


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixel table: reflectance bands as fixed affine combinations of the line measures."""
    q, p, d, t = (F.col(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("ok"), F.col("l_partkey").alias("px"),
        F.col("l_linenumber").alias("ln"), F.to_date("l_shipdate").alias("d"),
        (F.col("l_suppkey") % 12).cast("int").alias("scl"),
        F.when(F.col("l_linestatus") == "O", "Sentinel-2A").otherwise("Sentinel-2B").alias("platform"),
        F.col("l_returnflag").alias("aoi"),
        (0.03 + 0.00041 * q).alias("b01"), (0.025 + 0.00073 * q).alias("b02"),
        (0.02 + 0.00113 * q).alias("b03"),
        (0.83 * d + 0.00047 * (F.col("l_linenumber") - 1)).alias("b04"),
        (0.012 + 0.71 * t + 0.00061 * q).alias("b05"),
        (0.008 + 0.0000003 * p + 0.11 * d).alias("b06"),
        (0.006 + 0.0000006 * p).alias("b8a"),
        (0.002 + 0.93 * t + 0.00021 * F.col("l_linenumber")).alias("b11"),
        (0.001 + 0.27 * t).alias("b12"))


GRID_COLS = 50


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raster stack: one cell per part, one scene per year; values are sums over the lines."""
    return (table(spark, sf_dir, "lineitem")
            .groupBy(F.year("l_shipdate").alias("scene"), F.col("l_partkey").alias("px"))
            .agg(F.sum("l_quantity").alias("q"), F.count(F.lit(1)).alias("n"),
                 F.avg("l_discount").alias("disc"))
            .select("scene", (F.floor(F.col("px") / GRID_COLS)).cast("int").alias("row"),
                    (F.col("px") % GRID_COLS).cast("int").alias("col"), "q", "n", "disc"))


def stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raster stack of quarterly composites: scene number, nominal day, five features."""
    year, quarter = F.year("l_shipdate"), F.quarter("l_shipdate")
    lines = table(spark, sf_dir, "lineitem").select(
        (year * 4 + quarter - 1).alias("scene"), F.make_date(year, quarter * 3 - 2, F.lit(15)).alias("d"),
        F.floor(F.col("l_partkey") / GRID_COLS).cast("int").alias("row"), (F.col("l_partkey") % GRID_COLS).cast("int").alias("col"),
        "l_quantity", "l_discount", "l_extendedprice", "l_tax", "l_linenumber")
    return (in_tasks(lines, line_tasks(spark, sf_dir), ["row", "col"]).groupBy("scene", "d", "row", "col")
            .agg((F.avg("l_quantity") / 50).alias("ndci"), F.avg("l_discount").alias("mci"), (F.avg("l_extendedprice") / 1000).alias("tur"),
                 (F.avg("l_tax") / 10 - 0.004).alias("fai"), (40 + 10 * F.avg("l_linenumber")).alias("hue")))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site series: one value per supplier and calendar day."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("site"), F.to_date("l_shipdate").alias("d"), "l_quantity", "l_discount")
    return (in_tasks(lines, line_tasks(spark, sf_dir), ["site", "d"]).groupBy("site", "d")
            .agg(F.avg("l_quantity").alias("v"), F.avg("l_discount").alias("w")))


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long spectra: band ``ix`` at 400 + 8 ix nm, reflectance and a per-band sigma."""
    return (table(spark, sf_dir, "embeddings")
            .select("vec_id", "label", F.posexplode("embedding").alias("ix", "e"))
            .select("vec_id", "label", "ix", (400 + 8 * F.col("ix")).cast("double").alias("nm"),
                    (0.06 + 0.1 * F.col("e").cast("double")).alias("refl"),
                    (0.004 + 0.0003 * F.col("ix")).alias("sigma")))


# The same views for the SQL side, written independently as WITH parts.
SQL_OBS = """obs AS (SELECT l_partkey AS px, CAST(l_shipdate AS DATE) AS d, avg(l_quantity) AS ndci,
  avg(l_extendedprice / 1000) AS tur, avg(l_discount) AS mci FROM lineitem GROUP BY 1, 2)"""

SQL_BANDS = """bands AS (SELECT l_orderkey AS ok, l_partkey AS px, l_linenumber AS ln,
  CAST(l_shipdate AS DATE) AS d, CAST(l_suppkey % 12 AS INTEGER) AS scl,
  CASE WHEN l_linestatus = 'O' THEN 'Sentinel-2A' ELSE 'Sentinel-2B' END AS platform, l_returnflag AS aoi,
  CAST(0.03 AS DOUBLE) + CAST(0.00041 AS DOUBLE) * l_quantity AS b01,
  CAST(0.025 AS DOUBLE) + CAST(0.00073 AS DOUBLE) * l_quantity AS b02,
  CAST(0.02 AS DOUBLE) + CAST(0.00113 AS DOUBLE) * l_quantity AS b03,
  CAST(0.83 AS DOUBLE) * l_discount + CAST(0.00047 AS DOUBLE) * (l_linenumber - 1) AS b04,
  CAST(0.012 AS DOUBLE) + CAST(0.71 AS DOUBLE) * l_tax + CAST(0.00061 AS DOUBLE) * l_quantity AS b05,
  CAST(0.008 AS DOUBLE) + CAST(0.0000003 AS DOUBLE) * l_extendedprice + CAST(0.11 AS DOUBLE) * l_discount AS b06,
  CAST(0.006 AS DOUBLE) + CAST(0.0000006 AS DOUBLE) * l_extendedprice AS b8a,
  CAST(0.002 AS DOUBLE) + CAST(0.93 AS DOUBLE) * l_tax + CAST(0.00021 AS DOUBLE) * l_linenumber AS b11,
  CAST(0.001 AS DOUBLE) + CAST(0.27 AS DOUBLE) * l_tax AS b12 FROM lineitem)"""

SQL_SCENES = """scenes AS (SELECT year(l_shipdate) AS scene, CAST(l_partkey // 50 AS INTEGER) AS row,
  CAST(l_partkey % 50 AS INTEGER) AS col, sum(l_quantity) AS q, count(*) AS n, avg(l_discount) AS disc
  FROM lineitem GROUP BY 1, 2, 3)"""

SQL_STACK = """stack AS MATERIALIZED (SELECT CAST(year(l_shipdate) * 4 + quarter(l_shipdate) - 1 AS INTEGER) AS scene,
  make_date(year(l_shipdate), quarter(l_shipdate) * 3 - 2, 15) AS d, CAST(l_partkey // 50 AS INTEGER) AS row, CAST(l_partkey % 50 AS INTEGER) AS col,
  avg(l_quantity) / 50 AS ndci, avg(l_discount) AS mci, avg(l_extendedprice) / 1000 AS tur,
  avg(l_tax) / 10 - CAST(0.004 AS DOUBLE) AS fai, 40 + 10 * avg(l_linenumber) AS hue FROM lineitem GROUP BY 1, 2, 3, 4)"""

SQL_SITES = """sites AS MATERIALIZED (SELECT l_suppkey AS site, CAST(l_shipdate AS DATE) AS d, avg(l_quantity) AS v, avg(l_discount) AS w FROM lineitem GROUP BY 1, 2)"""

SQL_SPECTRA = """spectra AS (SELECT vec_id, label, ix, CAST(400 + 8 * ix AS DOUBLE) AS nm,
  CAST(0.06 AS DOUBLE) + CAST(0.1 AS DOUBLE) * CAST(embedding[ix + 1] AS DOUBLE) AS refl,
  CAST(0.004 AS DOUBLE) + CAST(0.0003 AS DOUBLE) * ix AS sigma
  FROM (SELECT vec_id, label, embedding, unnest(generate_series(0, len(embedding) - 1)) AS ix FROM embeddings))"""
