"""Registry, table bindings and small helpers shared by the queries.

Each binding exists twice: as a DataFrame over the given Parquet tables and as
the text of the same relation in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rawlake import vocab
from rawlake.functions import numeric
from rawlake.session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, and the SQL that gives the same rows."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def micro(value: Column) -> Column:
    """Millionths as a whole number, so both engines' last bits agree."""
    return F.floor(value * 1e6 + 0.5).cast("bigint")


def micro_sql(expr: str) -> str:
    return f"CAST(floor(({expr}) * 1e6 + 0.5) AS BIGINT)"


def pick_sql(expr: str, names: list[str]) -> str:
    """The n-th of some texts, counted from 0."""
    listed = ", ".join("'" + n.replace("'", "''") + "'" for n in names)
    return f"([{listed}])[({expr}) + 1]"


def pick(index: Column, names: list[str]) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), index.cast("int"))


def case_sql(expr: str, mapping: dict, default: str | None) -> str:
    """A fixed mapping in SQL."""

    def lit(v) -> str:
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    arms = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in mapping.items())
    tail = "" if default is None else f" ELSE {default}"
    return f"(CASE {expr} {arms}{tail} END)"


# --- frame index: one frame per event ---------------------------------------


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    day = F.unix_date(ts.cast("date")).cast("bigint") * 86_400_000_000
    clock = F.hour(ts).cast("bigint") * 3_600_000_000 + F.minute(ts).cast("bigint") * 60_000_000
    return day + clock + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")


def frame_index(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("user_id").alias("clip_id"), F.col("event_id").alias("offset"), (epoch_micros(F.col("ts")) * 1000).alias("ts_ns")
    )


FRAME_INDEX = "(SELECT user_id AS clip_id, event_id AS \"offset\", epoch_us(ts) * 1000 AS ts_ns FROM events)"

# --- phase events: one sample per line item ---------------------------------


def phase_events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("run_id"),
        pick(F.col("l_partkey") % 11, vocab.PHASES).alias("phase"),
        F.col("l_orderkey").alias("frame_id"),
        F.floor(F.col("l_extendedprice") * 1000).alias("ns"),
    )


PHASE_EVENTS = (
    f"(SELECT l_suppkey AS run_id, {pick_sql('l_partkey % 11', vocab.PHASES)} AS phase, l_orderkey AS frame_id, "
    "CAST(floor(l_extendedprice * 1000) AS BIGINT) AS ns FROM lineitem)"
)


def runs(spark: SparkSession, sf: str) -> DataFrame:
    e = phase_events(spark, sf)
    return e.groupBy("run_id").agg(
        F.count_if(F.col("phase") == "decode").alias("frames_total"), F.count_if(F.col("phase") == "gpu").alias("gpu_frames")
    )


RUNS = (
    "(SELECT run_id, count(*) FILTER (phase = 'decode') AS frames_total, count(*) FILTER (phase = 'gpu') AS gpu_frames "
    f"FROM {PHASE_EVENTS} GROUP BY run_id)"
)

# --- pixels: one per line item, channels in 0..1 ----------------------------


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("clip_id"),
        F.col("l_orderkey").alias("frame_id"),
        F.col("l_linenumber").alias("x"),
        (F.col("l_extendedprice") / 105000.0).alias("r"),
        (F.col("l_discount") * 10.0).alias("g"),
        (F.col("l_tax") / 0.08).alias("b"),
    )


PIXELS = (
    "(SELECT l_suppkey AS clip_id, l_orderkey AS frame_id, l_linenumber AS x, l_extendedprice / 105000.0::DOUBLE AS r, "
    "l_discount * 10.0::DOUBLE AS g, l_tax / 0.08::DOUBLE AS b FROM lineitem)"
)

# --- mosaics: one 8x8 frame per embedding -----------------------------------

PATTERNS = [name for _, name, _, _ in vocab.BAYER]


def mosaics(spark: SparkSession, sf: str) -> DataFrame:
    e = spread(table(spark, sf, "embeddings").select("vec_id", "label", "embedding"), "vec_id")
    px = F.transform("embedding", lambda v: F.floor((v.cast("double") + 1.0) * 8192.0).cast("int"))
    return e.select(
        F.col("vec_id").alias("frame_id"),
        F.col("label").alias("clip_id"),
        numeric.bayer_name(F.col("vec_id") % 8).alias("pattern"),
        F.lit(8).alias("frame_w"),
        F.lit(8).alias("frame_h"),
        px.alias("px"),
    )


MOSAICS = (
    f"(SELECT vec_id AS frame_id, label AS clip_id, {pick_sql('vec_id % 8', PATTERNS)} AS pattern, "
    "list_transform(embedding, lambda e: CAST(floor((CAST(e AS DOUBLE) + 1.0) * 8192.0) AS BIGINT)) AS px FROM embeddings)"
)
MOSAIC_PIXELS = (
    "(SELECT frame_id, clip_id, pattern, i // 8 AS y, i % 8 AS x, px, px[i + 1] AS v "
    f"FROM {MOSAICS} m, range(64) t(i))"
)

# --- queue: one job per order -----------------------------------------------

STATUS = {"F": "Completed", "O": "Waiting", "P": "Rendering"}


def queue(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    status = F.when((F.col("o_orderstatus") == "F") & F.col("o_orderpriority").startswith("1"), "Failed").otherwise(
        vocab.lookup(F.col("o_orderstatus"), STATUS)
    )
    return o.select(
        F.col("o_orderkey").alias("job_id"),
        F.col("o_custkey").alias("owner"),
        F.col("o_orderkey").alias("seq"),
        status.alias("status"),
        (F.col("o_orderkey") % 3 != 0).alias("selected"),
        F.lit(0.0).alias("progress"),
    )


QUEUE = (
    "(SELECT o_orderkey AS job_id, o_custkey AS owner, o_orderkey AS seq, CASE WHEN o_orderstatus = 'F' AND "
    f"o_orderpriority LIKE '1%' THEN 'Failed' ELSE {case_sql('o_orderstatus', STATUS, None)} END AS status, "
    "o_orderkey % 3 <> 0 AS selected, 0.0::DOUBLE AS progress FROM orders)"
)

# --- imports and pool: documents and their labels ---------------------------


def imports(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    path = F.concat(F.lit("/footage/"), F.col("lang"), F.lit("/clip"), (F.col("n_chars") % 700).cast("string"), F.lit(".mcraw"))
    return d.select(path.alias("path"), F.col("doc_id").alias("seq"), (F.col("n_chars") % 7 != 0).alias("ok"))


def pool(spark: SparkSession, sf: str) -> DataFrame:
    marked = table(spark, sf, "labels").where(F.col("quality") == 1).select(F.col("doc_id").alias("seq"))
    return imports(spark, sf).join(marked.distinct(), "seq", "left_semi").groupBy("path").agg(F.min("seq").alias("seq"))


IMPORTS = (
    "(SELECT '/footage/' || lang || '/clip' || CAST(n_chars % 700 AS VARCHAR) || '.mcraw' AS path, doc_id AS seq, "
    "n_chars % 7 <> 0 AS ok FROM documents)"
)
POOL = (
    f"(SELECT path, min(seq) AS seq FROM {IMPORTS} WHERE seq IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY path)"
)

# --- clips with matrices: one per embedding ---------------------------------

CLIP_MATRICES = {
    "color_matrix": (0, 0.5, (1.0, 1.0, 1.0), 7),
    "color_matrix2": (9, 0.5, (1.0, 1.0, 1.0), 3),
    "forward_matrix1": (18, 0.2, (0.96422, 1.0, 0.82521), 2),
    "forward_matrix2": (27, 0.6, (0.96422, 1.0, 0.82521), 4),
    "calibration_matrix1": (36, 0.1, (1.0, 1.0, 1.0), 5),
    "calibration_matrix2": (45, 0.1, (1.0, 1.0, 1.0), 3),
}


def clip_matrices(spark: SparkSession, sf: str) -> DataFrame:
    """Clips whose matrices are near a diagonal; some clips lack some of them."""
    e = spread(table(spark, sf, "embeddings").select("vec_id", "embedding"), "vec_id")
    e = e.withColumn("_e", F.col("embedding").cast("array<double>"))

    def matrix(start: int, scale: float, diagonal, gap: int) -> Column:
        cells = [f"_e[{start + i}] * {scale}D + {diagonal[i // 3] if i % 4 == 0 else 0.0}D" for i in range(9)]
        return F.expr(f"CASE WHEN vec_id % {gap} <> 0 THEN array({', '.join(cells)}) END")

    return e.select(
        F.col("vec_id").alias("clip_id"),
        *[matrix(*spec).alias(name) for name, spec in CLIP_MATRICES.items()],
        F.transform(F.slice("_e", 55, 4), lambda v: F.floor(F.abs(v) * 1000.0).cast("double")).alias("black_levels"),
        F.when(F.col("vec_id") % 2 == 0, 4).otherwise(1).alias("black_level_count"),
        F.lit(16383.0).alias("white_level"),
        F.lit(4000).alias("width"),
        F.lit(3000).alias("height"),
        F.when(F.col("vec_id") % 3 == 0, 0).otherwise(3840).alias("active_width"),
        F.when(F.col("vec_id") % 3 == 0, 0).otherwise(2160).alias("active_height"),
        F.array(*[F.abs(F.get("_e", 58 + i)) + 0.3 for i in range(3)]).alias("neutral"),
        pick(F.col("vec_id") % 16, [g[0] for g in vocab.GAMUT]).alias("gamut"),
    )


def _matrix_sql(start: int, scale: float, diagonal, gap: int) -> str:
    cells = [
        f"CAST(embedding[{start + i + 1}] AS DOUBLE) * {scale}::DOUBLE + {diagonal[i // 3] if i % 4 == 0 else 0.0}::DOUBLE"
        for i in range(9)
    ]
    return f"CASE WHEN vec_id % {gap} <> 0 THEN [{', '.join(cells)}] END"


CLIPS = (
    "(SELECT vec_id AS clip_id, "
    + ", ".join(f"{_matrix_sql(*spec)} AS {name}" for name, spec in CLIP_MATRICES.items())
    + ", list_transform(embedding[55:58], lambda v: floor(abs(CAST(v AS DOUBLE)) * 1000.0)) AS black_levels, "
    "CASE WHEN vec_id % 2 = 0 THEN 4 ELSE 1 END AS black_level_count, 16383.0::DOUBLE AS white_level, 4000 AS width, 3000 AS height, "
    "CASE WHEN vec_id % 3 = 0 THEN 0 ELSE 3840 END AS active_width, CASE WHEN vec_id % 3 = 0 THEN 0 ELSE 2160 END AS active_height, "
    "[abs(CAST(embedding[59] AS DOUBLE)) + 0.3::DOUBLE, abs(CAST(embedding[60] AS DOUBLE)) + 0.3::DOUBLE, "
    "abs(CAST(embedding[61] AS DOUBLE)) + 0.3::DOUBLE] AS neutral, "
    f"{pick_sql('vec_id % 16', [g[0] for g in vocab.GAMUT])} AS gamut FROM embeddings)"
)

# --- lens grids: one 4x4 grid with four channels per embedding ---------------


def grids(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    gains = F.transform("embedding", lambda v: F.abs(v.cast("double")) + 1.0)
    return e.select(
        F.col("vec_id").alias("clip_id"),
        F.array(*[F.slice(gains, 16 * c + 1, 16) for c in range(4)]).alias("lens_grid"),
        F.lit(4).alias("grid_w"),
        F.lit(4).alias("grid_h"),
    )


GRIDS = (
    "(SELECT vec_id AS clip_id, ch, i // 4 AS gy, i % 4 AS gx, abs(CAST(embedding[16 * ch + i + 1] AS DOUBLE)) + 1.0 AS gain "
    "FROM embeddings, range(4) c(ch), range(16) t(i))"
)
