"""GeoJSON and JSON configuration."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.functions.scalar import round_even
from ridgeline.operators.sampling import numbered

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])


#: Bytes of a file's beginning that show how its features begin.
HEAD = 1 << 16


def _feature(properties: T.StructType) -> T.StructType:
    geometry = T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType()))))])
    return T.StructType([T.StructField("properties", properties), T.StructField("geometry", geometry)])


def _drawn(f: Column) -> Column:
    return f["geometry"].isNotNull() & (F.size(f["geometry"]["coordinates"]) > 0)


def _opening(spark: SparkSession, path: str) -> str | None:
    """How a collection's features begin, letter by letter, if with their type."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(conf).open(p)
    try:
        head = bytes(stream.readNBytes(HEAD)).decode("utf-8", "replace")
    finally:
        stream.close()
    found = re.search(r'"features"\s*:\s*\[\s*(\{\s*"type"\s*:\s*"Feature")', head)
    return found[1] if found else None


def read_features(spark: SparkSession, path: str, properties: T.StructType) -> DataFrame:
    """Properties and ``rings`` of a collection's polygons, in file order as a
    dense ``idx``; features without geometry are dropped before numbering.

    Where features begin with their type, as writers have it, the file is split
    where they begin, so that many tasks read it; the beginning is never part of
    a text, as quotes in texts are escaped, and must not open an object inside a
    feature.  A collection that begins its features otherwise is one row.
    """
    opening = _opening(spark, path)
    if opening is None:
        whole = spark.read.schema(T.StructType([T.StructField("features", T.ArrayType(_feature(properties)))])).json(path, multiLine=True)
        rows = whole.select(F.posexplode(F.filter("features", _drawn)).alias("idx", "f"))
    else:
        parts = spark.read.option("lineSep", opening).text(path).select("value", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n")).alias("at"))
        parts = parts.where(~F.ltrim("value").startswith("{"))  # what comes before the first feature
        # what follows a feature's end is not read
        rows = parts.select("at", F.from_json(F.concat(F.lit(opening), "value"), _feature(properties)).alias("f")).where(_drawn(F.col("f")))
        rows = numbered(rows, "at").withColumn("idx", F.col("idx").cast("int"))
    rings = F.transform("f.geometry.coordinates", lambda r: F.transform(r, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))))
    return rows.select("idx", "f.properties.*", rings.alias("rings"))


def feature(properties: list[str], rings: Column, digits: int = 6) -> Column:
    """One GeoJSON feature as text; ``rings`` is an array of arrays of (x, y)."""
    points = F.transform(rings, lambda r: F.transform(r, lambda p: F.array(round_even(p["x"], digits), round_even(p["y"], digits))))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), F.struct(F.lit("Polygon").alias("type"), points.alias("coordinates")).alias("geometry")))


def write_features(df: DataFrame, path: str, properties: list[str], rings: str = "rings", digits: int = 6) -> None:
    """One feature per line, in as many files as there are partitions."""
    df.select(feature(properties, F.col(rings), digits).alias("value")).write.text(path)


DESTINATIONS = T.StructType(
    [
        T.StructField("schema_version", T.IntegerType()),
        T.StructField("description", T.StringType()),
        T.StructField(
            "groups",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("id", T.StringType()),
                        T.StructField("label", T.StringType()),
                        T.StructField("points", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())]))),
                    ]
                )
            ),
        ),
    ]
)


def read_destinations(spark: SparkSession, path: str) -> DataFrame:
    """(id, label, name, lat, lon) per destination point; a file without
    groups raises."""
    cfg = spark.read.schema(DESTINATIONS).json(path, multiLine=True)
    return destination_points(cfg)


def destination_points(cfg: DataFrame) -> DataFrame:
    checked = F.when(F.size(F.coalesce("groups", F.array())) > 0, F.col("groups")).otherwise(F.raise_error(F.lit("no destination groups")))
    g = cfg.select(F.explode(checked).alias("g"))
    return g.select("g.id", "g.label", F.explode("g.points").alias("p")).select("id", "label", "p.*")


MEMBERS = "elements array<struct<type:string,members:array<struct<type:string,role:string,geometry:array<struct<lon:double,lat:double>>>>>>"


def read_relation(spark: SparkSession, path: str) -> DataFrame:
    """``relation_ways`` of a stored map-feature answer."""
    return relation_ways(spark.read.schema(MEMBERS).json(path, multiLine=True))


def relation_ways(doc: DataFrame) -> DataFrame:
    """Ways of the first relation of a map-feature answer ``elements``:
    (outer, way), those with a geometry of two points or more; a way is an
    inner one only if its role says so."""
    rel = doc.select(F.filter("elements", lambda e: e["type"] == "relation").alias("r"))
    first = rel.select(F.when(F.size("r") > 0, F.get("r", F.lit(0))).otherwise(F.raise_error(F.lit("no relation"))).alias("r"))
    m = first.select(F.explode("r.members").alias("m")).where((F.col("m.type") == "way") & (F.size(F.coalesce("m.geometry", F.array())) >= 2))
    return m.select(F.coalesce(F.col("m.role") != "inner", F.lit(True)).alias("outer"), F.transform("m.geometry", lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y"))).alias("way"))
