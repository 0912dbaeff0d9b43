"""Listings, imports and the clip pool (F1-F3, F14, J1, J2, A7, U*, O*, W6, W7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rawlake import vocab
from rawlake.functions.numeric import non_zero_matrix, wb_gains
from rawlake.operators.timeline import stored_timeline
from rawlake.session import BROADCAST_LIMIT, plan_bytes


def visible(listing: DataFrame, include_hidden: bool = False, name: str = "name") -> DataFrame:
    """hide names that start with a dot."""
    return listing if include_hidden else listing.where(~F.col(name).startswith("."))


def clips_only(listing: DataFrame, name: str = "name") -> DataFrame:
    """keep clip containers, whatever the case of the extension."""
    return listing.where(F.lower(name).endswith(vocab.CLIP_SUFFIX))


def listing_order() -> list[Column]:
    """O1: parent row, then files before folders, then names without case."""
    return [F.col("is_parent").desc(), F.col("is_dir").asc(), F.lower("name").asc(), F.col("name").asc()]


def is_complete(c=F.col) -> Column:
    """size, frames, first timestamp and white balance are all known."""
    known = (c("width") > 0) & (c("height") > 0) & (c("frame_count") > 0)
    return F.coalesce(known, F.lit(False)) & c("first_ts").isNotNull() & c("wb_gains").isNotNull()


def first_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """First row of every key. An aggregate, so copies are dropped before the shuffle."""
    others = [c for c in rows.columns if c != key]
    best = F.min_by(F.struct(*others), order).alias("_row")
    return rows.groupBy(key).agg(best).select(key, "_row.*").select(*rows.columns)


def new_imports(imports: DataFrame, pool: DataFrame, key: str = "path", order: str = "seq") -> DataFrame:
    """Imports that the pool does not have yet, the first of each path."""
    fresh = first_per_key(imports, key, order)
    return fresh.join(pool.select(key).distinct(), key, "left_anti")


def merged_pool(pool: DataFrame, imports: DataFrame, key: str = "path", order: str = "seq") -> DataFrame:
    """The pool followed by its new imports."""
    return pool.unionByName(new_imports(imports, pool, key, order), allowMissingColumns=True)


def without(rows: DataFrame, names: DataFrame, key: str = "name") -> DataFrame:
    """Drop rows by name."""
    return rows.join(names.select(key).distinct(), key, "left_anti")


def one_catalog(headed: DataFrame, legacy: DataFrame) -> DataFrame:
    """U4: clips of both container generations in one table."""
    return headed.unionByName(legacy, allowMissingColumns=True)


def import_outcomes(imports: DataFrame, pool: DataFrame, key: str = "path", order: str = "seq") -> DataFrame:
    """Number of imported, failed and duplicate paths.

    Readable imports are counted per path first, so a path that was dropped a
    million times is one row when it meets the pool.
    """
    per_path = imports.groupBy(key).agg(
        F.sum(F.when(F.col("ok"), 1).otherwise(0)).alias("_ok"),
        F.sum(F.when(F.col("ok"), 0).otherwise(1)).alias("_bad"),
    )
    known = pool.select(key).distinct().withColumn("_known", F.lit(True))
    joined = per_path.join(known, key, "left")
    is_new = F.when(F.col("_known").isNull() & (F.col("_ok") > 0), 1).otherwise(0)
    return joined.agg(
        F.coalesce(F.sum(is_new), F.lit(0)).alias("imported"),
        F.coalesce(F.sum("_bad"), F.lit(0)).alias("failed"),
        F.coalesce(F.sum(F.col("_ok") - is_new), F.lit(0)).alias("duplicate"),
    )


def upsert(stored: DataFrame, changes: DataFrame, key: str = "name", pos: str = "pos") -> DataFrame:
    """Replace by name; the last change wins and keeps the old position."""
    cols = [c for c in stored.columns if c not in (key, pos)]
    ranked = stored.withColumn("_gen", F.lit(0)).unionByName(changes.withColumn("_gen", F.lit(1)))
    latest = F.max_by(F.struct(*cols), F.struct("_gen", pos)).alias("_row")
    first = F.min(F.struct("_gen", pos))
    merged = ranked.groupBy(key).agg(latest, first.alias("_at"))
    return merged.select(key, F.col(f"_at.{pos}").alias(pos), F.col("_at._gen").alias("generation"), "_row.*")


def valid_presets(presets: DataFrame) -> DataFrame:
    """drop presets with an unknown gamut, curve or codec; fill unknown profiles."""
    known = (
        F.col("color_space").isin([g[0] for g in vocab.GAMUT])
        & F.col("transfer_function").isin([t[0] for t in vocab.TRANSFER])
        & F.col("codec_family").isin(vocab.CODEC_FAMILIES)
    )
    filled = {}
    for family, column in vocab.PROFILE_COLUMN.items():
        names = [p for f, p, _, _ in vocab.CODEC_PROFILE if f == family]
        default = next(p for f, p, _, d in vocab.CODEC_PROFILE if f == family and d)
        filled[column] = F.when(F.col(column).isin(names), F.col(column)).otherwise(F.lit(default))
    return presets.where(known).withColumns(filled)


def last_or_null(values: Column) -> Column:
    """Last entry of a list, null for an empty one."""
    return F.try_element_at(values, F.lit(-1))


def enriched(clips: DataFrame, container: DataFrame, frame_meta: DataFrame, frame_index: DataFrame) -> DataFrame:
    """Fill clips from the container block and from their first frame.

    Complete clips skip the joins. The container block counts only where the
    header has no colour matrix; size only where it is zero; gains only where
    null; dynamic levels always; the lens grid from the first frame as a last
    resort; frame count and rate always.
    """
    todo = clips.where(~is_complete())
    done = clips.where(is_complete())
    keys = todo.select("clip_id")

    def needed(rows: DataFrame) -> DataFrame:
        """Rows of incomplete clips, where that filter is cheap. Else all rows are
        aggregated first, so a clip with a third of the frames never moves whole."""
        few = plan_bytes(keys) <= BROADCAST_LIMIT
        return rows.join(F.broadcast(keys), "clip_id", "left_semi") if few else rows

    block = needed(container).select(
        "clip_id", *[F.col(c).alias(f"c_{c}") for c in container.columns if c != "clip_id"]
    )
    times = stored_timeline(needed(frame_index)).select(
        "clip_id", F.col("frame_count").alias("t_count"), F.col("first_ts").alias("t_first"), F.col("fps").alias("t_fps")
    )
    wanted = ["width", "height", "neutral", "dynamic_black", "dynamic_white", "lens_grid"]
    first = (
        needed(frame_meta)
        .groupBy("clip_id")
        .agg(F.min_by(F.struct(*wanted), "ordinal").alias("f"))
    )
    j = todo.join(block, "clip_id", "left").join(times, "clip_id", "left").join(first, "clip_id", "left")
    use_block = F.col("color_matrix").isNull() & F.col("c_color_matrix").isNotNull()
    levels = use_block & (F.size("c_black_levels") > 0)
    matrices = ["color_matrix2", "forward_matrix1", "forward_matrix2", "calibration_matrix1", "calibration_matrix2"]
    no_size = (F.col("width") == 0) | (F.col("height") == 0)
    has_first = F.col("f").isNotNull()
    fps = F.when(F.col("t_fps") > 0, F.col("t_fps")).otherwise(F.col("fps"))
    changes = {
        "white_level": F.when(use_block & (F.col("c_white_level") > 0), F.col("c_white_level")).otherwise(
            F.col("white_level")
        ),
        "black_level": F.when(levels, F.get("c_black_levels", 0)).otherwise(F.col("black_level")),
        "black_levels": F.when(
            levels, F.array(*[F.coalesce(F.get("c_black_levels", i), F.lit(0.0)) for i in range(4)])
        ).otherwise(F.col("black_levels")),
        "lens_grid": F.coalesce(F.when(use_block, F.col("c_lens_grid")).otherwise(F.col("lens_grid")), "f.lens_grid"),
        "color_matrix": F.coalesce("color_matrix", "c_color_matrix"),
        **{
            m: F.when(use_block, F.coalesce(non_zero_matrix(F.col(f"c_{m}")), F.col(m))).otherwise(F.col(m))
            for m in matrices
        },
        "frame_count": F.coalesce("t_count", "frame_count"),
        "fps": fps,
        "width": F.when(no_size & has_first, F.col("f.width")).otherwise(F.col("width")),
        "height": F.when(no_size & has_first, F.col("f.height")).otherwise(F.col("height")),
        "wb_gains": F.coalesce("wb_gains", wb_gains(F.col("f.neutral"))),
        "dynamic_black": F.coalesce("f.dynamic_black", "dynamic_black"),
        "dynamic_white": F.coalesce("f.dynamic_white", "dynamic_white"),
    }
    filled = j.select(
        *[(changes[c] if c in changes else F.col(c)).alias(c) for c in clips.columns]
    )
    return done.unionByName(filled)
