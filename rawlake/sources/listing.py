"""Folder listings (S6) and still-frame manifests (K5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rawlake.functions import matrix as mx
from rawlake.functions import numeric, text
from rawlake.operators.catalog import listing_order, visible
from rawlake.session import small_table


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a folder tree with name and size; contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("length").alias("size"))


def entries_of(paths: DataFrame, folder: str, include_hidden: bool = False) -> DataFrame:
    """Direct entries of a folder (files, sub-folders, parent row), ordered."""
    root = folder.rstrip("/") + "/"
    below = paths.where(F.col("path").startswith(root))
    rest = F.substring(F.col("path"), F.lit(len(root) + 1), F.length("path"))
    name = F.element_at(F.split(rest, "/"), 1)
    is_dir = rest.contains("/")
    found = below.select(name.alias("name"), is_dir.alias("is_dir"), F.when(is_dir, F.lit(0)).otherwise(F.col("size")).alias("size"))
    found = found.groupBy("name", "is_dir").agg(F.max("size").alias("size"))
    found = visible(found, include_hidden).withColumn("is_parent", F.lit(False))
    parent = small_table(paths.sparkSession, [("..", True, 0, True)], "name string, is_dir boolean, size bigint, is_parent boolean")
    return found.unionByName(parent).orderBy(*listing_order())


def _numbers(*values: Column) -> Column:
    return F.array_join(F.array(*[v.cast("string") for v in values]), " ")


def _rational(value: Column) -> Column:
    r = numeric.signed_rational(value)
    return F.concat(r["n"].cast("string"), F.lit("/"), r["d"].cast("string"))


def _rationals(values: Column, n: int) -> Column:
    return F.array_join(F.array(*[_rational(F.get(values, i)) for i in range(n)]), " ")


def still_name(path: Column, frame: Column) -> Column:
    """K5: ``{stem}_{frame:06}.dng``."""
    number = frame.cast("string")
    padded = F.when(F.length(number) < 6, F.lpad(number, 6, "0")).otherwise(number)
    return F.concat(text.clip_stem(path), F.lit("_"), padded, F.lit(".dng"))


def still_manifest(frames: DataFrame) -> DataFrame:
    """K5: the tag values of every still as ``file, tag, value`` rows.

    Frames carry their clip's columns, ``ordinal``, ``neutral`` and the estimated
    ``data_bytes``. Offsets in the file are not part of the manifest.
    """
    c = F.col
    cfa = numeric.cfa_shifted(c("pattern"), c("active_offset_x"), c("active_offset_y"))
    bottom, right = c("active_offset_y") + c("active_height"), c("active_offset_x") + c("active_width")
    black = F.least(F.greatest(F.floor("black_level"), F.lit(0)), F.lit(65535))
    identity = F.expr(mx.constant(mx.IDENTITY))
    ver = F.lit("1 4 0 0")
    tags: list[tuple[int, Column]] = [
        (256, c("width").cast("string")),
        (257, c("height").cast("string")),
        (258, F.lit("16")),
        (259, F.lit("7")),
        (262, F.lit("32803")),
        (277, F.lit("1")),
        (278, c("height").cast("string")),
        (279, c("data_bytes").cast("string")),
        (33421, F.lit("0 1 2")),
        (33422, F.array_join(cfa.cast("array<string>"), " ")),
        (50706, ver),
        (50707, ver),
        (50708, F.coalesce(c("camera_model"), F.lit("Unknown"))),
        (50714, _numbers(black, black, black, black)),
        (50717, F.greatest(F.floor("white_level"), F.lit(0)).cast("string")),
        (50718, F.lit("1/1 1/1")),
        (50719, F.concat(_numbers(c("active_offset_x")), F.lit("/1 "), _numbers(c("active_offset_y")), F.lit("/1"))),
        (50720, F.concat(_numbers(c("active_width")), F.lit("/1 "), _numbers(c("active_height")), F.lit("/1"))),
        (50721, _rationals(F.coalesce(c("color_matrix"), identity), 9)),
        (50722, F.when(c("color_matrix2").isNotNull(), _rationals(c("color_matrix2"), 9))),
        (50728, _rationals(c("neutral"), 3)),
        (50778, F.coalesce(c("illuminant1"), F.lit(21)).cast("string")),
        (50779, c("illuminant2").cast("string")),
        (50830, _numbers(c("active_offset_y"), c("active_offset_x"), bottom, right)),
    ]
    entries = F.array(*[F.struct(F.lit(t).alias("tag"), v.alias("value")) for t, v in tags])
    grid = F.when(
        c("lens_grid").isNotNull(),
        F.concat_ws("x", c("grid_w").cast("string"), c("grid_h").cast("string")),
    )
    entries = F.concat(entries, F.array(F.struct(F.lit(0xC61B).alias("tag"), grid.alias("value"))))
    out = frames.select(still_name(c("path"), c("ordinal")).alias("file"), F.explode(entries).alias("e"))
    return out.select("file", "e.tag", "e.value").where(F.col("value").isNotNull())
