"""Province polygons.

``read_geojson_polygons`` (A10) cuts GeoJSON feature collections between their features,
parses each and explodes it into vertex rows.  ``nation_polygons`` derives a
polygon set from the driver's ``nation`` table (one quadrilateral per nation in
a latitude band per region; the first nation of each region has a hole) so the point-in-polygon
job runs on data that comes from the given tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.positional import positional_index
from .tables import read_table


#: Text between two features of a collection; files are cut there, so that many tasks read one file.
FEATURE_MARK = '"Feature"'
_HEAD = r'\[\s*\{\s*"type"\s*:\s*$'  # before the first feature
_NEXT = r'\}\s*,\s*\{\s*"type"\s*:\s*$'  # before every other one
_FEATURE = "properties struct<shapeName: string>, geometry struct<type: string, coordinates: string>"


def _read_features(spark: SparkSession, path: str) -> DataFrame:
    """(_file, _block, _row, name, gtype, coords): the features of every file, in order of the first three.

    A piece between two marks is one feature and the opening of the next; the parser stops at the end of the
    feature.  A file whose pieces are not of that form (another order of members, a mark inside a property,
    features without geometry) is read whole instead, with the same result."""
    text = spark.read.option("lineSep", FEATURE_MARK).text(path)
    pieces = text.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                         F.monotonically_increasing_id().alias("_row"))
    parsed = pieces.select(
        "_file", "_block", "_row", F.col("value").rlike(_HEAD).alias("_head"), F.col("value").rlike(_NEXT).alias("_next"),
        F.from_json(F.concat(F.lit('{"type":' + FEATURE_MARK), "value"), _FEATURE).alias("f"))
    fine = F.col("f.geometry.type").isNotNull() & F.col("f.geometry.coordinates").isNotNull()
    checks = parsed.groupBy("_file").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("_head").alias("heads"), F.count_if(~F.col("_head") & F.col("_next")).alias("nexts"),
        F.count_if(~F.col("_head") & fine).alias("fine"))
    odd = [r["_file"] for r in checks.where("heads <> 1 OR nexts <> n - 2 OR fine <> n - 1").select("_file").collect()]  # file names
    features = parsed.where(~F.col("_head") & ~F.col("_file").isin(odd)) if odd else parsed.where(~F.col("_head"))
    if odd:
        whole = spark.read.option("wholetext", True).text(odd).select(
            F.col("_metadata.file_path").alias("_file"), F.from_json("value", f"features array<struct<{_FEATURE.replace(' struct', ': struct')}>>").alias("c"))
        whole = whole.select("_file", F.lit(0).cast("long").alias("_block"), F.posexplode("c.features").alias("_row", "f"))
        features = features.select("_file", "_block", "_row", "f").unionByName(whole.withColumn("_row", F.col("_row").cast("long")))
    name = F.col("f.properties.shapeName")
    return features.select("_file", "_block", "_row", F.when(name != "", name).otherwise(F.lit("Unknown")).alias("name"),
                           F.col("f.geometry.type").alias("gtype"), F.col("f.geometry.coordinates").alias("coords"))


def read_geojson_polygons(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A10: (polygons(polygon_id, name, sort_order), rings(polygon_id, ring, seq, lng, lat)) of one file or a
    folder of feature collections, numbered in order of file name and place.  Polygon and MultiPolygon geometries
    (others have no rings); name from properties.shapeName, default 'Unknown'."""
    placed = positional_index(_read_features(spark, path).withColumn("_all", F.lit(0)), ["_all"], ["_file", "_block", "_row"], "polygon_id")
    polys = placed.select(F.col("polygon_id").cast("int").alias("polygon_id"), "name", F.col("polygon_id").cast("int").alias("sort_order"), "gtype", "coords")
    # coordinates: Polygon = [ring][vertex][xy]; MultiPolygon = [poly][ring][vertex][xy]
    rings = polys.select("polygon_id", F.posexplode(
        F.when(F.col("gtype") == "MultiPolygon", F.flatten(F.from_json("coords", "array<array<array<array<double>>>>")))
        .when(F.col("gtype") == "Polygon", F.from_json("coords", "array<array<array<double>>>"))).alias("ring", "pts"))
    # without the closing vertex (equal to the first) - edges close rings themselves
    opened = F.slice("pts", F.lit(1), F.greatest(F.size("pts") - 1, F.lit(0)))
    vertices = rings.select("polygon_id", "ring", F.posexplode(opened).alias("seq", "xy"))
    return (polys.select("polygon_id", "name", "sort_order"),
            vertices.select("polygon_id", "ring", "seq", F.col("xy")[0].alias("lng"), F.col("xy")[1].alias("lat")))


def write_geojson(polygons: DataFrame, rings: DataFrame, path: str, folder: str) -> None:
    """Polygons as GeoJSON, one collection for each value of ``folder`` (a column of ``polygons``), in their
    order; polygons of odd ``polygon_id`` as MultiPolygon."""
    vertex = F.struct("seq", F.array("lng", "lat").alias("xy"))
    ring = F.transform(F.array_sort(F.collect_list(vertex)), lambda v: v["xy"])
    closed = rings.groupBy("polygon_id", "ring").agg(ring.alias("pts")).select("polygon_id", F.struct(
        "ring", F.concat("pts", F.slice("pts", 1, 1)).alias("pts")).alias("r"))
    shapes = closed.groupBy("polygon_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["pts"])).alias("shape"))
    multi = F.col("polygon_id") % 2 == 1
    feature = F.concat(
        F.lit('{"type": "Feature", "properties": '), F.to_json(F.struct(F.col("name").alias("shapeName"))),
        F.lit(', "geometry": {"type": "'), F.when(multi, F.lit("MultiPolygon")).otherwise(F.lit("Polygon")), F.lit('", "coordinates": '),
        F.when(multi, F.concat(F.lit("["), "shape", F.lit("]"))).otherwise(F.col("shape")), F.lit("}}"))
    listed = polygons.join(shapes, "polygon_id").groupBy(folder).agg(
        F.array_sort(F.collect_list(F.struct("sort_order", "polygon_id", feature.alias("text")))).alias("features"))
    body = F.array_join(F.transform("features", lambda f: f["text"]), ", ")
    listed.select(folder, F.concat(F.lit('{"type": "FeatureCollection", "features": ['), body, F.lit("]}")).alias("value")) \
        .write.partitionBy(folder).text(path)


def nation_polygons(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nat = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    n = nat.withColumn("k", F.row_number().over(w) - 1)
    base = n.select(
        F.col("n_nationkey").cast("int").alias("polygon_id"), F.col("n_name").alias("name"), "k",
        F.col("n_nationkey").cast("int").alias("sort_order"),
        # vertices sit on odd tenths of a degree, never on a 0.2-degree lattice line
        (F.lit(8.5) + F.col("n_regionkey") * 3.2).alias("y0"), (F.lit(8.5) + (F.col("n_regionkey") + 1) * 3.2).alias("y1"),
        (F.lit(102.1) + F.col("k") * 1.6).alias("x0"), (F.lit(103.7) + F.col("k") * 1.6).alias("x1"),
    )
    outer = F.array(
        F.struct(F.lit(0).alias("seq"), F.col("x0").alias("lng"), F.col("y0").alias("lat")),
        F.struct(F.lit(1).alias("seq"), F.col("x1").alias("lng"), F.col("y0").alias("lat")),
        F.struct(F.lit(2).alias("seq"), (F.col("x1") + 0.3).alias("lng"), F.col("y1").alias("lat")),
        F.struct(F.lit(3).alias("seq"), (F.col("x0") + 0.3).alias("lng"), F.col("y1").alias("lat")),
    )
    hole = F.array(
        F.struct(F.lit(0).alias("seq"), (F.col("x0") + 0.4).alias("lng"), (F.col("y0") + 1.0).alias("lat")),
        F.struct(F.lit(1).alias("seq"), (F.col("x0") + 1.1).alias("lng"), (F.col("y0") + 1.0).alias("lat")),
        F.struct(F.lit(2).alias("seq"), (F.col("x0") + 1.1).alias("lng"), (F.col("y0") + 2.0).alias("lat")),
        F.struct(F.lit(3).alias("seq"), (F.col("x0") + 0.4).alias("lng"), (F.col("y0") + 2.0).alias("lat")),
    )
    r0 = base.select("polygon_id", F.lit(0).alias("ring"), F.explode(outer).alias("v"))
    r1 = base.filter(F.col("k") == 0).select("polygon_id", F.lit(1).alias("ring"), F.explode(hole).alias("v"))
    rings = r0.unionByName(r1).select("polygon_id", "ring", "v.seq", "v.lng", "v.lat")
    return base.select("polygon_id", "name", "sort_order"), rings
