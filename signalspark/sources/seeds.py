"""The table of companies: its faults, and the pages to read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEED = "slug string, name string, segment string, homepage_url string, pricing_url string, hq_country string, audience string, target_size string, category string, meta_confidence string"
LABEL = "slug string, sections array<struct<heading:string,type:string>>"
REQUIRED = ("slug", "name", "segment", "homepage_url")


def read_seed(spark: SparkSession, path: str, key: str = "companies") -> DataFrame:
    """Companies of a seed file: a JSON document that is a list of them, or holds one under ``key``."""
    return _listed(spark, path, key, SEED)


def read_labels(spark: SparkSession, path: str, key: str = "labels") -> DataFrame:
    """``(slug, heading, type)`` of a file of labelled sections; the hero's heading is ``__hero__``."""
    rows = _listed(spark, path, key, LABEL).select("slug", F.explode("sections").alias("s"))
    return rows.select("slug", F.coalesce("s.heading", F.lit("__hero__")).alias("heading"), "s.type")


def _listed(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    text = spark.read.text(path, wholetext=True)
    item = f"array<struct<{', '.join(c.replace(' ', ':', 1) for c in _fields(schema))}>>"
    plain, nested = F.from_json("value", item), F.from_json("value", f"struct<`{key}`:{item}>")[key]
    rows = F.when(F.ltrim("value").startswith("["), plain).otherwise(nested)
    return text.select(F.explode(rows).alias("r")).select("r.*")


def _fields(schema: str) -> list[str]:
    """Top-level fields of a schema text."""
    out, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [f.strip() for f in out]


def faults(seeds: DataFrame, least: int = 40, most: int = 260) -> DataFrame:
    """``(slug, fault)`` for each broken rule: missing fields, odd or repeated slugs, urls that
    aren't https or have a query or fragment, and a count out of bounds."""
    found = [F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(f"no {c}")) for c in REQUIRED]
    found.append(F.when(~F.col("slug").rlike("^[a-z0-9-]+$"), F.lit("odd slug")))
    for c in ("homepage_url", "pricing_url"):
        found += [F.when(~F.col(c).startswith("https://"), F.lit(f"{c} is not https")), F.when(F.col(c).rlike("[?#]"), F.lit(f"{c} has a query or fragment"))]
    rows = seeds.select("slug", F.explode(F.array_compact(F.array(*found))).alias("fault"))
    twice = seeds.groupBy("slug").count().where("count > 1").select("slug", F.lit("repeated slug").alias("fault"))
    size = seeds.agg(F.count("*").alias("n")).where(~F.col("n").between(least, most)).select(F.lit(None).cast("string").alias("slug"), F.concat(F.col("n").cast("string"), F.lit(" companies")).alias("fault"))
    return rows.union(twice).union(size)


def targets(seeds: DataFrame) -> DataFrame:
    """``(slug, name, segment, kind, url, host)``: a row for each page that a company has."""
    pages = F.array(F.struct(F.lit("home").alias("kind"), F.col("homepage_url").alias("url")), F.struct(F.lit("pricing").alias("kind"), F.col("pricing_url").alias("url")))
    rows = seeds.select("slug", "name", "segment", F.explode(pages).alias("p")).select("slug", "name", "segment", "p.*").where("url is not null")
    return rows.withColumn("host", F.lower(F.regexp_extract("url", "://([^/?#]+)", 1)))
