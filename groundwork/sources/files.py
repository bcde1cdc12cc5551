"""Tables, JSON inventories, sitemaps and landed payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INVENTORY = "kind string, slug string, title string, date string, source_url string, local_path string, sha256 string, bytes bigint, extraction string, words int, pdf_pages int, listed_on string, gated boolean"
FAQ = "map<string, array<struct<question:string, answer:string>>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of inventory entries, with a fixed schema."""
    return spark.read.schema(INVENTORY).json(path, multiLine=True)


def read_faq(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of categories, one row for each file, as column `faq`."""
    return spark.read.text(path, wholetext=True).select(F.from_json("value", FAQ).alias("faq"))


def sitemap_slugs(spark: SparkSession, path: str) -> DataFrame:
    """(loc, slug) of each url element of a sitemap; malformed input fails as a whole."""
    from groundwork.functions.exprs import url_slug

    rows = spark.read.format("xml").option("rowTag", "url").option("mode", "FAILFAST").schema("loc string").load(path)
    return rows.select(F.trim("loc").alias("loc"), url_slug(F.trim("loc")).alias("slug"))


def stream_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Landed JSON payloads as a stream."""
    return spark.readStream.schema(schema).json(path)


def stream_parquet(spark: SparkSession, folder: str, glob: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)


def write_version(df: DataFrame, folder: str, version: str) -> str:
    """Write a table beside its earlier versions; readers switch to the returned path."""
    path = f"{folder}/v={version}"
    df.write.mode("errorifexists").parquet(path)
    return path
