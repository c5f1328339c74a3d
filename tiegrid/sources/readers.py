"""Readers of labels, match files, manifests and search responses, and the tile catalog's writer."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tiegrid.operators.catalog import infer_sensor

#: Names under which labels carry the ground distance, in the order in which they count: fixed values.
GSD_ALIASES = ("pixel_resolution", "gsd", "ground_sample_distance", "spatial_resolution", "map_scale")


def whole_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, text) of every file below ``root`` that fits ``pattern``."""
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return read.text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def screened(files: DataFrame) -> DataFrame:
    """Adds ``reason``, NULL for well-formed XML."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            reasons = []
            for text in b["text"]:
                try:
                    ElementTree.fromstring(text)
                    reasons.append(None)
                except (ElementTree.ParseError, TypeError, ValueError):
                    reasons.append("malformed")
            yield b.assign(reason=reasons)

    return files.mapInPandas(run, "path string, text string, reason string")


def xml_value(text: Column, *names: str) -> Column:
    """The text of the first element with one of these local names."""
    return F.coalesce(*(F.nullif(F.trim(F.xpath_string(text, F.lit(f"//*[local-name()='{n}']"))), F.lit("")) for n in names))


def read_xml_labels(spark: SparkSession, root: str, pattern: str = "*.xml") -> tuple[DataFrame, DataFrame]:
    """(products, rejected): a product row for each label, and (path, reason) of labels that are malformed, name no sensor or have no footprint.

    Elevation falls back to 90 - incidence. Of labels with the same product and
    sensor the first path counts.
    """
    files = screened(whole_files(spark, root, pattern))
    number = lambda *n: F.expr("NULL").cast("double") if not n else xml_value(F.col("text"), *n).try_cast("double")
    good = files.filter("reason IS NULL")
    incidence = number("incidence_angle", "solar_incidence_angle")
    read = good.select(
        "path", xml_value(F.col("text"), "logical_identifier", "product_id").alias("product_id"),
        infer_sensor(xml_value(F.col("text"), "instrument", "instrument_name", "name"), F.element_at(F.split("path", "/"), -1), F.col("path")).alias("sensor"),
        number("sun_azimuth", "solar_azimuth").alias("sun_azimuth"), F.coalesce(number("sun_elevation", "solar_elevation"), 90 - incidence).alias("sun_elevation"),
        incidence.alias("incidence"), number(*GSD_ALIASES).alias("gsd"), xml_value(F.col("text"), "start_date_time").try_cast("timestamp").alias("acquired"),
        *(number(f"{side}_bounding_coordinate", f"{side}most_{kind}").alias(name) for side, kind, name in (
            ("west", "longitude", "west_lon"), ("east", "longitude", "east_lon"), ("south", "latitude", "south_lat"), ("north", "latitude", "north_lat"))),
    )
    footprint = F.col("west_lon").isNotNull() & F.col("east_lon").isNotNull() & F.col("south_lat").isNotNull() & F.col("north_lat").isNotNull()
    reason = F.when(F.col("sensor") == "UNKNOWN", "no_sensor").when(~footprint, "no_footprint")
    judged = read.withColumn("reason", reason)
    first = Window.partitionBy("product_id", "sensor").orderBy("path")
    products = judged.filter("reason IS NULL").withColumn("_k", F.row_number().over(first)).filter("_k = 1").drop("_k", "reason")
    rejected = files.filter("reason IS NOT NULL").select("path", "reason").union(judged.filter("reason IS NOT NULL").select("path", "reason"))
    return products, rejected


def read_keyvalue_labels(spark: SparkSession, root: str, pattern: str = "*.lbl") -> DataFrame:
    """(path, object_path, key, value) of ``KEY = VALUE`` labels.

    Comments go, units in angle brackets go, OBJECT blocks nest, a line without
    a key goes on with the value before it, END ends a label.
    """
    clean = F.regexp_replace("text", r"(?s)/\*.*?\*/", "")
    lines = whole_files(spark, root, pattern).select("path", F.posexplode(F.split(clean, r"\r?\n")).alias("n", "line")).withColumn("line", F.trim("line")).filter("line <> ''")
    by_file = Window.partitionBy("path").orderBy("n")
    key = F.regexp_extract("line", r"^\^?([A-Za-z][A-Za-z0-9_:]*)\s*=", 1)
    ended = F.max((F.col("line") == "END").cast("int")).over(by_file)
    keyed = lines.withColumns({"ended": ended, "key": F.upper(key)}).filter("ended = 0")
    keyed = keyed.withColumn("key", F.when(F.col("line").isin("END_OBJECT", "END_GROUP"), F.col("line")).otherwise(F.col("key")))
    keyed = keyed.withColumn("entry", F.sum((F.col("key") != "").cast("int")).over(by_file))
    part = F.when(F.col("key") != "", F.regexp_replace("line", r"^[^=]*=\s*", "")).otherwise(F.col("line"))
    entries = keyed.withColumn("part", part).groupBy("path", "entry").agg(
        F.max("key").alias("key"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "part"))), lambda s: s["part"]), " ").alias("value")
    )
    value = F.trim(F.regexp_replace(F.regexp_replace("value", r"\s*<[^<>]*>", ""), r'^"|"$', ""))
    entries = entries.withColumns({"value": value, "opens": F.col("key").isin("OBJECT", "GROUP"), "closes": F.col("key").isin("END_OBJECT", "END_GROUP")})
    order = Window.partitionBy("path").orderBy("entry").rowsBetween(Window.unboundedPreceding, 0)
    events = entries.withColumn("events", F.collect_list(F.when(F.col("opens") | F.col("closes"), F.struct("opens", "value"))).over(order))
    stack = F.aggregate("events", F.array().cast("array<string>"), lambda s, e: F.when(e["opens"], F.concat(s, F.array(e["value"]))).otherwise(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))))
    return events.filter("NOT opens AND NOT closes AND key <> ''").select("path", F.array_join(stack, "/").alias("object_path"), "key", "value")


def read_match_files(spark: SparkSession, root: str, pattern: str = "*matches.json") -> DataFrame:
    """(path, match fields): bare lists, or lists under all_matches, matches or correspondences; unreadable files are left out.

    The older names image1_x, ... stand in for missing source_x, ...
    """
    fields = {
        "source_x": "image1_x", "source_y": "image1_y", "target_x": "image2_x", "target_y": "image2_y", "confidence": "score",
    }
    row = "struct<" + ",".join(f"{n}:double,{a}:double" for n, a in fields.items()) + ",is_inlier:boolean,covariance_xy:array<array<double>>>"
    text = F.trim(F.col("text"))
    wrapped = F.from_json(text, f"struct<all_matches:array<{row}>,matches:array<{row}>,correspondences:array<{row}>>")
    listed = F.when(text.startswith("["), F.from_json(text, f"array<{row}>")).otherwise(F.coalesce(wrapped["all_matches"], wrapped["matches"], wrapped["correspondences"]))
    found = whole_files(spark, root, pattern).select("path", F.posexplode(listed).alias("match_id", "m"))
    return found.select("path", F.col("match_id").cast("bigint").alias("match_id"), *(F.coalesce(f"m.{n}", f"m.{a}").alias(n) for n, a in fields.items()), "m.is_inlier", "m.covariance_xy")


def read_manifests(spark: SparkSession, root: str, pattern: str = "manifest.json") -> DataFrame:
    """One row for each region manifest; the region's id falls back to the name of its folder."""
    bounds = "struct<west_lon:double,east_lon:double,south_lat:double,north_lat:double>"
    parsed = F.from_json("text", f"struct<region_id:string,ohrc_product_id:string,tmc2_product_id:string,iirs_product_id:string,sun_azimuth_mismatch_deg:double,bounds:{bounds}>")
    files = whole_files(spark, root, pattern).select("path", parsed.alias("m")).filter("m IS NOT NULL")
    return files.select("path", F.coalesce("m.region_id", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)).alias("region_id"), "m.ohrc_product_id", "m.tmc2_product_id", "m.iirs_product_id", "m.sun_azimuth_mismatch_deg", "m.bounds")


#: Names that archive responses use for the same thing, in the order in which they count: fixed values.
RESPONSE_ALIASES = {
    "product_id": ("product_id", "pdsid", "id", "ProductId"), "label_url": ("label_url", "LabelURL", "labelurl"), "west_lon": ("west_lon", "Westernmost_longitude", "min_lon"),
    "east_lon": ("east_lon", "Easternmost_longitude", "max_lon"), "south_lat": ("south_lat", "Minimum_latitude", "min_lat"), "north_lat": ("north_lat", "Maximum_latitude", "max_lat"),
    "incidence": ("incidence", "Incidence_angle", "incidence_angle"), "emission": ("emission", "Emission_angle", "emission_angle"), "phase": ("phase", "Phase_angle", "phase_angle"),
}


def parse_candidate_responses(responses: DataFrame, column: str = "json") -> DataFrame:
    """Candidates from saved search responses whose key names vary; an unknown id becomes UNKNOWN_PRODUCT."""
    v = F.try_parse_json(F.col(column))
    items = F.coalesce(*(F.try_variant_get(v, p, "array<variant>") for p in ("$.ODEResults.Products.Product", "$.products", "$.results", "$")))
    each = responses.select(F.explode(items).alias("p"))
    get = lambda name, kind: F.coalesce(*(F.try_variant_get("p", f"$.{a}", kind) for a in RESPONSE_ALIASES[name]))
    texts, numbers = ("product_id", "label_url"), [n for n in RESPONSE_ALIASES if n not in ("product_id", "label_url")]
    out = each.select(*(get(n, "string").alias(n) for n in texts), F.coalesce(F.try_variant_get("p", "$.urls", "array<string>"), F.array().cast("array<string>")).alias("urls"), *(get(n, "double").alias(n) for n in numbers))
    return out.withColumn("product_id", F.coalesce("product_id", F.lit("UNKNOWN_PRODUCT")))


def write_tile_catalog(tiles: DataFrame, path: str) -> None:
    """The catalog as JSON, and as CSV with flat columns: bbox joined by spaces, footprint as JSON text, one file_<key> column a key.

    The distinct keys of the file map, a handful of band and mask names, are the
    one thing that reaches the driver.
    """
    keys = sorted(r[0] for r in tiles.select(F.explode(F.map_keys("files"))).distinct().collect())
    flat = tiles.select(
        *(c for c in tiles.columns if c not in ("bbox", "footprint", "files")), F.array_join(F.transform("bbox", lambda x: x.cast("string")), " ").alias("bbox"),
        F.to_json("footprint").alias("footprint"), *(F.col("files")[k].alias(f"file_{k}") for k in keys),
    )
    tiles.write.mode("overwrite").json(f"{path}/json")
    flat.select(*sorted(flat.columns)).write.mode("overwrite").option("header", True).csv(f"{path}/csv")
